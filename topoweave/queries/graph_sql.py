"""Shared SQL of the graph queries: the current graph and the symbols that queries ask about."""

_N = "id, name, qualified_name, symbol_type, file_path, line_start, line_end, docstring"
GRAPH = f"""
WITH RECURSIVE cn AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, seq DESC) AS rn FROM (
      SELECT {_N}, signature, is_dead, is_proposed, observed_at, seq FROM nodes WHERE deleted_at IS NULL
      UNION ALL SELECT {_N}, NULL, false, false, observed_at, 0 FROM shared_nodes WHERE deleted_at IS NULL) x) y
  WHERE rn = 1),
ce AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target, edge_type ORDER BY seq DESC) AS rn FROM (
      SELECT trim(source, chr(32) || chr(9)) AS source, trim(target, chr(32) || chr(9)) AS target, lower(edge_type) AS edge_type, is_dead, is_proposed, line, edge_id AS seq FROM edges) x
    WHERE source <> '' AND target <> '' AND edge_type IS NOT NULL) y
  WHERE rn = 1),
ge AS (SELECT * FROM ce WHERE source IN (SELECT id FROM cn)),
calls AS (SELECT source, target FROM ge WHERE edge_type = 'calls'),
hub AS (SELECT target AS id FROM calls WHERE target IN (SELECT id FROM cn) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
mid AS (
  SELECT i.id FROM (SELECT target AS id, count(*) AS n FROM calls WHERE target IN (SELECT id FROM cn) GROUP BY 1) i
  JOIN (SELECT source AS id, count(*) AS n FROM calls WHERE target IN (SELECT id FROM cn) GROUP BY 1) o ON i.id = o.id
  ORDER BY i.n * o.n DESC, i.id LIMIT 1),
busy AS (SELECT split_part(source, '.', 1) AS p FROM ge GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
"""


def sql(body: str, *ctes: str) -> str:
    """A query over the current graph, with further common tables."""
    return GRAPH + "".join(f", {c}" for c in ctes) + "\n" + body


NODE = "id, name, qualified_name, symbol_type"


def reached(name: str, seed: str, where: str = "true", backward: bool = False, both: bool = False) -> str:
    """A recursive table of the ids reached from ``seed`` along the edges that meet ``where``."""
    a, b = ("target", "source") if backward else ("source", "target")
    step = f"SELECT e.{b} FROM {name} r JOIN ge e ON e.{a} = r.id WHERE {where}"
    if both:
        step = f"SELECT e.o FROM {name} r JOIN (SELECT source AS s, target AS o, edge_type FROM ge UNION SELECT target, source, edge_type FROM ge) e ON e.s = r.id WHERE {where}"
    return f"{name}(id) AS ({seed} UNION {step})"
