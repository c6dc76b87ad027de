"""Small graphs for tests."""

NODE = "id string, name string, qualified_name string, symbol_type string, file_path string, line_start int, line_end int, docstring string, signature string, is_dead boolean, is_proposed boolean, metadata string"
EDGE = "source string, target string, edge_type string, is_dead boolean, is_proposed boolean, line int, metadata string, seq bigint"


def nodes(spark, **kinds):
    """Nodes of the given ids by symbol type."""
    return spark.createDataFrame([(i, i.split(".")[-1], i, k, None, 1, 2, None, None, False, False, None) for k, ids in kinds.items() for i in ids.split()], NODE)


def edges(spark, text, default="calls"):
    """Edges written as source>target or source>target:type."""
    rows = []
    for k, part in enumerate(text.split()):
        ends, _, kind = part.partition(":")
        s, t = ends.split(">")
        rows.append((s, t, kind or default, False, False, k + 1, None, k))
    return spark.createDataFrame(rows, EDGE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())
