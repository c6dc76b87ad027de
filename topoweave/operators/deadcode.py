"""Unused symbols: what no entry point reaches and nobody reads.

Execution flows along calls and reads, and from a reached class into what it
contains.  Every result is recomputed from the graph; no stored flag is trusted
or kept.  Names beginning with test or exempt by convention are never dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.functions.names import last_part, parent, prefixes
from topoweave.operators.graph import PropertyGraph
from topoweave.operators.traverse import reach
from topoweave.plans.tables import keep

#: Names that frameworks call by themselves (fixed values).
EXEMPT = [
    "__init__", "__new__", "__del__", "__repr__", "__str__", "__enter__", "__exit__", "__aenter__", "__aexit__", "__iter__", "__next__",
    "__len__", "__getitem__", "__setitem__", "__contains__", "__hash__", "__eq__", "__ne__", "__lt__", "__gt__", "__le__", "__ge__", "__bool__",
    "__call__", "__get__", "__set__", "__post_init__", "main", "setup", "teardown", "setUp", "tearDown", "setUpClass", "tearDownClass",
]
#: Base classes whose fields serialisation reads (fixed values).
SERIALISED = ["BaseModel", "Model", "Schema"]


def live(graph: PropertyGraph, exports: DataFrame | None = None) -> DataFrame:
    """(id) reached from modules, exempt names and exported symbols."""
    n, e = graph.all_nodes(False), graph.edges
    roots = n.where((F.col("symbol_type") == "module") | F.col("name").isin(EXEMPT)).select("id")
    if exports is not None:
        roots = roots.union(exports.select("id"))
    classes = n.where("symbol_type = 'class'").select(F.col("id").alias("source"))
    flow = e.where("edge_type in ('calls', 'reads')").unionByName(e.where("edge_type = 'contains'").join(classes, "source", "left_semi").select(e.columns))
    flow, _ = keep(flow.select("source", "target").distinct(), "flow")
    return reach(flow, roots).select("id")


def dead_symbols(graph: PropertyGraph, exports: DataFrame | None = None) -> DataFrame:
    """(id, symbol_type, reason): unreachable definitions, their and unread parameters, variables written but never read."""
    n, e = graph.all_nodes(False).select("id", "name", "symbol_type"), graph.edges
    alive, _ = keep(live(graph, exports), "live")
    spared = F.col("name").startswith("test_") | F.col("name").startswith("Test") | F.col("name").isin(EXEMPT)
    dead = n.where(F.col("symbol_type").isin("function", "method", "class") & ~spared).join(alive, "id", "left_anti")
    if exports is not None:
        dead = dead.join(exports.select("id"), "id", "left_anti")
    dead, _ = keep(dead, "dead")
    use = e.where("edge_type in ('reads', 'writes')").groupBy(F.col("target").alias("id")).agg(F.max(F.col("edge_type") == "reads").alias("read"), F.max(F.col("edge_type") == "writes").alias("written"))
    use, _ = keep(use, "use")
    owned = n.where("symbol_type in ('parameter', 'variable')").withColumn("owner", parent(F.col("id")))

    params = owned.where("symbol_type = 'parameter' and name not in ('self', 'cls')")
    buried = params.join(dead.select(F.col("id").alias("owner")), "owner", "left_semi").select("id", "symbol_type", F.lit("dead owner").alias("reason"))
    rest = params.join(dead.select(F.col("id").alias("owner")), "owner", "left_anti").join(use.where("read").select(F.col("id").alias("owner")), "owner", "left_anti")
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    unread = rest.join(use.where("read"), "id", "left_anti").join(ends, "id", "left_semi").select("id", "symbol_type", F.lit("never read").alias("reason"))

    served = e.where("edge_type = 'inherits'").where(last_part(F.col("target")).isin(SERIALISED)).select(F.col("source").alias("owner"))
    served = served.join(n.where("symbol_type = 'class'").select(F.col("id").alias("owner")), "owner", "left_semi")
    written = owned.where("symbol_type = 'variable'").join(use.where("written and not read"), "id", "left_semi").join(served, "owner", "left_anti")
    return (
        dead.select("id", "symbol_type", F.lit("unreachable").alias("reason")).unionByName(buried).unionByName(unread)
        .unionByName(written.select("id", "symbol_type", F.lit("written, never read").alias("reason")))
    )


def dead_returns(graph: PropertyGraph, dead: DataFrame) -> DataFrame:
    """(source, target) of returns of live functions none of whose returned values is read."""
    r = graph.edges.where("edge_type = 'returns'").select("source", "target")
    own = graph.nodes_by_type("function", "method").select(F.col("id").alias("source"))
    r = r.join(own, "source", "left_semi").join(dead.select(F.col("id").alias("source")), "source", "left_anti")
    read = graph.edges.where("edge_type = 'reads'").select("target").distinct()
    used = r.join(read, "target", "left_semi").select("source").distinct()
    return r.join(used, "source", "left_anti")


def dead_imports(graph: PropertyGraph) -> DataFrame:
    """(source, target) of imports whose target is no node but a dotted prefix of one."""
    i = graph.edges.where("edge_type = 'imports' and not is_proposed").select("source", "target").join(graph.nodes.select(F.col("id").alias("target")), "target", "left_anti")
    heads = graph.nodes.select(F.explode(prefixes(F.col("id"))).alias("target")).distinct()
    return i.join(heads, "target", "left_semi").select("source", "target")
