"""Queries on reachability, paths, components, cycles, ranks, unused code, similarity, layouts and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from topoweave.operators import layout
from topoweave.operators.centrality import betweenness, pagerank
from topoweave.operators.components import components
from topoweave.operators.cycles import all_cycles, cycles, is_cyclic, layers, strong_components
from topoweave.operators.deadcode import EXEMPT, dead_imports, dead_returns, dead_symbols, live
from topoweave.operators.graph import SHOWN, induced
from topoweave.operators.similarity import bands, candidates, classes, count_cosine, duplicate_groups, neighbourhood, neighbourhood_kernel, record_pairs, scored
from topoweave.operators.fingerprints import flags, max_depth, minhash, node_counts, shingles
from topoweave.operators.traverse import call_chain, connected, directed, distances, reach, reachable, shortest_path, simple_paths, trace_function, trace_variable
from topoweave.plans.tables import keep, table
from topoweave.queries import graph_queries as gq
from topoweave.queries.graph_sql import NODE, reached, sql
from topoweave.streaming.changes import Versions, apply_edge_delta, apply_node_delta, as_of, counts_by_stream, edge_delta, edges_as_of, latest_by_stream, node_delta, refresh, remove_module, replace_files, table_stream, windowed_counts
from topoweave.sources.files import latest_files
from topoweave.sources.pysource import extract, relationships, symbols

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None, graph: bool = True):
    def add(f):
        QUERIES[name] = (lambda spark, d: f(gq.kept_graph(spark, d), spark, d)) if graph else f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _one(spark, x):
    return spark.createDataFrame([(x,)], "id string")


MID = "SELECT id FROM mid"


@register("g1_subgraph_around", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT id FROM b)", f"""b(id, d) AS ({MID.replace('id', 'id, 0', 1)}
  UNION SELECT e.o, r.d + 1 FROM b r JOIN (SELECT source AS s, target AS o FROM ge WHERE edge_type = 'calls' UNION SELECT target, source FROM ge WHERE edge_type = 'calls') e ON e.s = r.id WHERE r.d < 2)"""))
def _(g, spark, d):
    ids = distances(directed(g.edges_of_types("calls"), "both"), _one(spark, gq.middle(g)), 2)
    return g.nodes.join(ids.select("id"), "id", "left_semi").select(*SHOWN)


@register("g2_isolate", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT id FROM b) OR starts_with(qualified_name, (SELECT id FROM mid) || '.')", f"""b(id, d) AS ({MID.replace('id', 'id, 0', 1)}
  UNION SELECT e.o, r.d + 1 FROM b r JOIN (SELECT source AS s, target AS o FROM ge UNION SELECT target, source FROM ge) e ON e.s = r.id WHERE r.d < 1)"""))
def _(g, spark, d):
    m = gq.middle(g)
    ids = distances(directed(g.edges, "both"), _one(spark, m), 1).select("id")
    inside = g.nodes.where(F.col("qualified_name").startswith(m + ".")).select("id")
    return g.nodes.join(ids.union(inside), "id", "left_semi").select(*SHOWN)


@register("g5_impact", sql(f"SELECT id FROM r WHERE id NOT IN ({MID})", reached("r", MID, "e.edge_type NOT IN ('contains', 'inherits')")))
def _(g, spark, d):
    m = gq.middle(g)
    return reach(g.edges.where("edge_type not in ('contains', 'inherits')"), _one(spark, m)).where(F.col("id") != m).select("id")


@register("g6_feeds_into", sql(f"SELECT id FROM r WHERE id NOT IN ({MID})", reached("r", MID, backward=True)))
def _(g, spark, d):
    m = gq.middle(g)
    return reach(g.edges, _one(spark, m), "backward").where(F.col("id") != m).select("id")


_FAR = f"""dist(id, d) AS ({MID.replace('id', 'id, 0', 1)} UNION SELECT e.target, r.d + 1 FROM dist r JOIN calls e ON e.source = r.id WHERE r.d < 6 AND e.target IN (SELECT id FROM cn)),
near AS (SELECT id, min(d) AS d FROM dist GROUP BY 1), far AS (SELECT id FROM near WHERE d > 0 ORDER BY d DESC, id LIMIT 1)"""


def _far(g, spark):
    m = gq.middle(g)
    inner = g.edges.where("edge_type = 'calls'").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    inner, _ = keep(inner, "inner-calls")
    return m, distances(directed(inner), _one(spark, m), 6).where("depth > 0").orderBy(F.desc("depth"), "id").first()["id"], inner


@register("g10_call_distances", sql("SELECT id, d AS depth FROM near", _FAR))
def _(g, spark, d):
    m, _, inner = _far(g, spark)
    return distances(directed(inner), _one(spark, m), 6)


_FAR8 = """inner_steps AS (SELECT DISTINCT source AS u, target AS v FROM ge WHERE __TYPES__ AND source <> target AND target IN (SELECT id FROM cn)),
dist(id, d) USING KEY (id) AS (SELECT id, 0 FROM mid UNION SELECT DISTINCT e.v, r.d + 1 FROM dist r JOIN inner_steps e ON e.u = r.id WHERE e.v NOT IN (SELECT id FROM recurring.dist)__BOUND__),
far AS (SELECT id FROM dist WHERE d > 0 ORDER BY d DESC, id LIMIT 1)"""
_CALLED = _FAR8.replace("__TYPES__", "edge_type = 'calls'")
# Walks are cut where the end is out of reach, so that only the paths asked for are walked to the end.
_WALK8 = """home(id, d) USING KEY (id) AS (SELECT id, 0 FROM far UNION SELECT DISTINCT e.u, r.d + 1 FROM home r JOIN inner_steps e ON e.v = r.id WHERE r.d < 8 AND e.u NOT IN (SELECT id FROM recurring.home)),
walk(id, path) AS (SELECT id, [id] FROM mid UNION ALL SELECT e.v, list_append(w.path, e.v) FROM walk w JOIN inner_steps e ON e.u = w.id JOIN home h ON h.id = e.v
  WHERE len(w.path) + h.d <= 8 AND w.id NOT IN (SELECT id FROM far) AND NOT list_contains(w.path, e.v))"""


_WALK = "walk(id, path) AS (SELECT id, [id] FROM mid UNION SELECT e.target, list_append(w.path, e.target) FROM walk w JOIN calls e ON e.source = w.id WHERE len(w.path) <= 6 AND NOT list_contains(w.path, e.target) AND e.target IN (SELECT id FROM cn))"


@register("g7_shortest_path", sql("SELECT path FROM walk WHERE id IN (SELECT id FROM far) ORDER BY len(path), path LIMIT 1", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return shortest_path(inner, m, far)


@register("g8_all_paths", sql("SELECT path FROM walk WHERE id IN (SELECT id FROM far)", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return simple_paths(inner, _one(spark, m), _one(spark, far), 6)


@register("g12_call_chain", sql("SELECT DISTINCT unnest(path) AS id FROM walk WHERE id IN (SELECT id FROM far)", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return simple_paths(inner, _one(spark, m), _one(spark, far), 6).select(F.explode("path").alias("id")).distinct()


# The queries above stop where their SQL does; those below have the reference's own bounds.


def _ends(g, spark, *types):
    """The middle, the vertex farthest from it within 8 steps of the given types (all if none), and those edges between nodes."""
    m = gq.middle(g)
    inner = (g.edges_of_types(*types) if types else g.edges).join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    inner, _ = keep(inner, "inner-edges")
    return m, distances(directed(inner), _one(spark, m), 8).where("depth > 0").orderBy(F.desc("depth"), "id").first()["id"], inner


@register("g2_isolate_deep", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT id FROM b) OR starts_with(qualified_name, (SELECT id FROM mid) || '.')", f"""b(id, d) AS ({MID.replace('id', 'id, 0', 1)}
  UNION SELECT e.o, r.d + 1 FROM b r JOIN (SELECT source AS s, target AS o FROM ge UNION SELECT target, source FROM ge) e ON e.s = r.id WHERE r.d < 3)"""))
def isolate_deep(g, spark, d):
    m = gq.middle(g)
    ids = distances(directed(g.edges, "both"), _one(spark, m), 3).select("id")
    inside = g.nodes.where(F.col("qualified_name").startswith(m + ".")).select("id")
    return g.nodes.join(ids.union(inside), "id", "left_semi").select(*SHOWN)


@register("g10_all_call_distances", sql("SELECT id, d AS depth FROM dist", _CALLED.replace("__BOUND__", "")))
def all_call_distances(g, spark, d):
    """Every node called from the middle, over chains of any length."""
    inner = g.edges_of_types("calls").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return distances(keep(directed(inner), "inner-calls")[0], _one(spark, gq.middle(g)))


@register("g7_shortest_path_all_types", sql("SELECT path FROM walk WHERE id IN (SELECT id FROM far) ORDER BY len(path), path LIMIT 1", _FAR8.replace("__TYPES__", "true").replace("__BOUND__", " AND r.d < 8"), _WALK8))
def shortest_path_all_types(g, spark, d):
    m, far, inner = _ends(g, spark)
    return shortest_path(inner, m, far)


@register("g8_all_paths_all_types", sql("SELECT path FROM walk WHERE id IN (SELECT id FROM far)", _FAR8.replace("__TYPES__", "true").replace("__BOUND__", " AND r.d < 8"), _WALK8))
def all_paths_all_types(g, spark, d):
    m, far, inner = _ends(g, spark)
    return simple_paths(inner, _one(spark, m), _one(spark, far), 8)


@register("g12_call_chain_deep", sql("SELECT DISTINCT unnest(path) AS id FROM walk WHERE id IN (SELECT id FROM far)", _CALLED.replace("__BOUND__", " AND r.d < 8"), _WALK8))
def call_chain_deep(g, spark, d):
    m, far, inner = _ends(g, spark, "calls")
    return simple_paths(inner, _one(spark, m), _one(spark, far), 8).select(F.explode("path").alias("id")).distinct()


@register("g9_connected", sql(f"SELECT m.id AS a, h.id AS b, h.id IN (SELECT id FROM ahead) OR h.id IN (SELECT id FROM behind) AS connected FROM mid m, hub h", reached("ahead", MID), reached("behind", MID, backward=True)))
def _(g, spark, d):
    m, h = gq.middle(g), gq.hub(g)
    return spark.createDataFrame([(m, h, connected(g.edges, m, h))], "a string, b string, connected boolean")


@register("g10_reachable", sql("SELECT m.id AS source, f.id AS target, true AS reachable, len(w.path) - 1 AS path_length, w.path, CAST(NULL AS VARCHAR) AS reason FROM mid m, far f, (SELECT path FROM walk WHERE id IN (SELECT id FROM far) ORDER BY len(path), path LIMIT 1) w", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return reachable(inner, m, far, 20)


@register("g12_chain_roles", sql("SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM mid) THEN 'origin' WHEN id IN (SELECT id FROM far) THEN 'destination' ELSE 'passthrough' END AS role FROM (SELECT unnest(path) AS id FROM walk WHERE id IN (SELECT id FROM far)) x", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return call_chain(inner, m, far, 6)[0]


@register("g18_path_labels", sql("SELECT array_to_string(list_transform(path, lambda x: string_split(x, '.')[-1]), ' > ') AS label, len(path) AS hops FROM walk WHERE id IN (SELECT id FROM far) ORDER BY len(path), path LIMIT 1", _FAR, _WALK))
def _(g, spark, d):
    m, far, inner = _far(g, spark)
    return shortest_path(inner, m, far).select(F.array_join(F.transform("path", lambda x: F.substring_index(x, ".", -1)), " > ").alias("label"), F.size("path").alias("hops"))


@register("g1_subgraph_edges", sql("SELECT source, target, edge_type FROM ge WHERE source IN (SELECT id FROM b) AND target IN (SELECT id FROM b)", f"""b(id, d) AS ({MID.replace('id', 'id, 0', 1)}
  UNION SELECT e.o, r.d + 1 FROM b r JOIN (SELECT source AS s, target AS o FROM ge WHERE edge_type = 'calls' UNION SELECT target, source FROM ge WHERE edge_type = 'calls') e ON e.s = r.id WHERE r.d < 2)"""))
def _(g, spark, d):
    ids, _ = keep(distances(directed(g.edges_of_types("calls"), "both"), _one(spark, gq.middle(g)), 2), "around")
    return induced(g.edges, ids).select("source", "target", "edge_type")


_AROUND = f"""b(id, d) AS ({MID.replace('id', 'id, 0', 1)} UNION SELECT e.o, r.d + 1 FROM b r JOIN (SELECT source AS s, target AS o FROM ge UNION SELECT target, source FROM ge) e ON e.s = r.id WHERE r.d < 2)"""
_VIS = "vis AS (SELECT id FROM cn WHERE symbol_type IN ('function', 'method') AND NOT is_dead AND NOT is_proposed AND id IN (SELECT id FROM b))"


def _view(g, spark):
    m = gq.middle(g)
    around, _ = keep(distances(directed(g.edges, "both"), _one(spark, m), 2).select("id"), "around")
    return g.snapshot("function", False, False, around, trace_function(g.edges, m)[0])


_UPDOWN = (reached("up", MID, "e.edge_type = 'calls'", backward=True), reached("down", MID, "e.edge_type = 'calls'"))
_ROLES = "roles AS (SELECT id, CASE WHEN id IN (SELECT id FROM mid) THEN 'origin' WHEN id IN (SELECT id FROM up) AND id IN (SELECT id FROM down) THEN 'mutator' WHEN id IN (SELECT id FROM up) THEN 'passthrough' ELSE 'destination' END AS role FROM (SELECT id FROM up UNION SELECT id FROM down) x)"


@register("g11_trace_function", sql("SELECT id, role FROM roles", *_UPDOWN, _ROLES))
def _(g, spark, d):
    return trace_function(g.edges, gq.middle(g))[0]


@register("g11_trace_function_edges", sql("""SELECT source, target, CASE min(CASE edge_type WHEN 'writes' THEN 0 WHEN 'reads' THEN 1 ELSE 2 END) WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'flow' END AS role
  FROM ge WHERE edge_type <> 'contains' AND source IN (SELECT id FROM roles) AND target IN (SELECT id FROM roles) GROUP BY 1, 2""", *_UPDOWN, _ROLES))
def _(g, spark, d):
    return trace_function(g.edges, gq.middle(g))[1]


def _variable(g):
    e = g.edges.where("edge_type in ('reads', 'writes')").groupBy(F.substring_index("target", ".", -1).alias("v")).agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "v").first()["v"]


@register("y5_snapshot_nodes", sql("""SELECT v.id, CASE min(CASE r.role WHEN 'origin' THEN 1 WHEN 'mutator' THEN 2 WHEN 'passthrough' THEN 3 WHEN 'destination' THEN 4 END) WHEN 1 THEN 'origin' WHEN 2 THEN 'mutator' WHEN 3 THEN 'passthrough' WHEN 4 THEN 'destination' END AS role
  FROM vis v LEFT JOIN (SELECT a.shown, x.role FROM roles x JOIN anc3 a ON a.id = x.id) r ON r.shown = v.id GROUP BY 1""", _AROUND, _VIS, *_UPDOWN, _ROLES, gq._ANC.replace("anc AS", "anc3 AS").replace("SELECT source AS id FROM ge UNION SELECT target FROM ge", "SELECT id FROM roles")))
def _(g, spark, d):
    """The view of live functions around the middle, with the roles of its trace."""
    return _view(g, spark)[0].select("id", "role")


@register("y5_snapshot_edges", sql("""SELECT DISTINCT a.shown AS source, b2.shown AS target, e.edge_type FROM ge e JOIN anc a ON a.id = e.source JOIN anc b2 ON b2.id = e.target
  WHERE e.edge_type <> 'contains' AND a.shown <> b2.shown AND NOT e.is_dead AND NOT e.is_proposed
  UNION SELECT source, target, edge_type FROM ge WHERE edge_type = 'contains' AND NOT is_dead AND NOT is_proposed AND source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)""", _AROUND, _VIS, gq._ANC))
def _(g, spark, d):
    return _view(g, spark)[1]


@register("a10_trace_role_counts", sql("SELECT role, count(*) AS n FROM roles GROUP BY 1", *_UPDOWN, _ROLES))
def _(g, spark, d):
    return trace_function(g.edges, gq.middle(g))[0].groupBy("role").agg(F.count("*").alias("n"))


_TRACE_EDGES = """te AS (SELECT source, target, CASE min(CASE edge_type WHEN 'writes' THEN 0 WHEN 'reads' THEN 1 ELSE 2 END) WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'flow' END AS role
  FROM ge WHERE edge_type <> 'contains' AND source IN (SELECT id FROM roles) AND target IN (SELECT id FROM roles) GROUP BY 1, 2)"""


@register("j18_module_edge_roles", sql("""SELECT a.shown AS source, b.shown AS target, CASE min(CASE t.role WHEN 'write' THEN 0 WHEN 'read' THEN 1 ELSE 2 END) WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'flow' END AS role
  FROM te t JOIN anc a ON a.id = t.source JOIN anc b ON b.id = t.target WHERE a.shown <> b.shown GROUP BY 1, 2""", *_UPDOWN, _ROLES, _TRACE_EDGES, "vis AS (SELECT id FROM cn WHERE symbol_type = 'module')", gq._ANC))
def _(g, spark, d):
    """Roles of the middle's trace on edges between modules."""
    return g.rolled_up_edge_roles(trace_function(g.edges, gq.middle(g))[1], g.visible("module"))


_VAR = ["""vn AS (SELECT string_split(target, '.')[-1] AS v FROM ge WHERE edge_type IN ('reads', 'writes') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
  """fl AS (SELECT source, target, edge_type, line FROM ge WHERE edge_type IN ('reads', 'writes') AND string_split(target, '.')[-1] IN (SELECT v FROM vn))""",
  """en AS (SELECT source AS id, bool_or(edge_type = 'writes') AS w, bool_or(edge_type = 'reads') AS r, min(CASE WHEN edge_type = 'writes' THEN coalesce(line, 9999) END) AS fline FROM fl GROUP BY 1)""",
  """pe AS (SELECT DISTINCT source, target FROM ge WHERE edge_type NOT IN ('contains', 'inherits') AND source <> target)"""]  # fmt: skip
for _n, _seed, _from, _to in (("wa", "w", "source", "target"), ("rb", "r", "target", "source"), ("ra", "r", "source", "target"), ("wb", "w", "target", "source")):
    _VAR.append(f"{_n}(id, d) AS (SELECT id, 0 FROM en WHERE {_seed} UNION SELECT e.{_to}, x.d + 1 FROM {_n} x JOIN pe e ON e.{_from} = x.id WHERE x.d < 5)")
_VAR += ["""onp AS (SELECT a.id FROM (SELECT id, min(d) AS d FROM wa GROUP BY 1) a JOIN (SELECT id, min(d) AS d FROM rb GROUP BY 1) b ON a.id = b.id WHERE a.d + b.d BETWEEN 1 AND 5
  UNION SELECT a.id FROM (SELECT id, min(d) AS d FROM ra GROUP BY 1) a JOIN (SELECT id, min(d) AS d FROM wb GROUP BY 1) b ON a.id = b.id WHERE a.d + b.d BETWEEN 1 AND 5 UNION SELECT id FROM en UNION SELECT target FROM fl)""",
  """fw AS (SELECT id FROM en WHERE w AND NOT r ORDER BY fline, id LIMIT 1)"""]  # fmt: skip


@register("g13_trace_variable", sql("""SELECT o.id, CASE WHEN o.id IN (SELECT target FROM fl) THEN 'origin' WHEN e.w AND e.r THEN 'mutator' WHEN e.w THEN CASE WHEN o.id IN (SELECT id FROM fw) THEN 'origin' ELSE 'mutator' END
  WHEN e.r THEN CASE WHEN o.id IN (SELECT source FROM ge WHERE edge_type = 'calls' AND source <> target AND target IN (SELECT id FROM onp)) THEN 'passthrough' ELSE 'destination' END ELSE 'passthrough' END AS role
  FROM onp o LEFT JOIN en e ON e.id = o.id""", *_VAR))
def _(g, spark, d):
    return trace_variable(g.nodes, g.edges, _variable(g))[0]


@register("g15_trace_variable_edges", sql("""SELECT source, target, CASE min(CASE edge_type WHEN 'writes' THEN 0 WHEN 'reads' THEN 1 ELSE 2 END) WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'flow' END AS role
  FROM ge WHERE edge_type <> 'contains' AND source IN (SELECT id FROM onp) AND target IN (SELECT id FROM onp) GROUP BY 1, 2""", *_VAR))
def _(g, spark, d):
    return trace_variable(g.nodes, g.edges, _variable(g))[1]


@register("g16_unreachable_from", sql("SELECT id FROM cn WHERE symbol_type IN ('function', 'method') AND NOT is_proposed AND id NOT IN (SELECT id FROM r)", reached("r", MID)))
def _(g, spark, d):
    return g.nodes_by_type("function", "method").select("id").join(reach(g.edges, _one(spark, gq.middle(g))).select("id"), "id", "left_anti")


@register("g17_truly_dead", sql("SELECT id FROM cn WHERE id NOT IN (SELECT id FROM r)", reached("r", "SELECT id FROM cn WHERE symbol_type = 'module'")))
def _(g, spark, d):
    return g.nodes.select("id").join(reach(g.edges, g.nodes.where("symbol_type = 'module'")).select("id"), "id", "left_anti")


# Least ids are passed on, one row a vertex.
_CC = "cc(id, comp) USING KEY (id) AS (SELECT id, id FROM (SELECT source AS id FROM ge UNION SELECT target FROM ge) v UNION SELECT s.o, min(c.comp) FROM cc c JOIN und s ON s.s = c.id JOIN recurring.cc k ON k.id = s.o WHERE c.comp < k.comp GROUP BY 1)"
_UND = "und AS (SELECT source AS s, target AS o FROM ge WHERE source <> target UNION SELECT target, source FROM ge WHERE source <> target)"


@register("c1_clusters", sql("SELECT comp AS component, count(*) AS n FROM cc WHERE id IN (SELECT s FROM und) GROUP BY 1", _UND, _CC))
def _(g, spark, d):
    return components(g.edges, "source", "target").groupBy("component").agg(F.count("*").alias("n"))


def _mutual(name, where="true"):
    """SQL: (id, component) of the vertices on cycles, named by the least id that reaches them and is reached."""
    return (f"{name}s AS (SELECT DISTINCT source AS a, target AS b FROM ge WHERE source <> target AND {where})", f"{name}r(a, b) AS (SELECT a, b FROM {name}s UNION SELECT r.a, s.b FROM {name}r r JOIN {name}s s ON s.a = r.b)",
            f"{name} AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM {name}r x JOIN {name}r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)")


@register("c2_circular_clusters", sql("SELECT id, component FROM scc", *_mutual("scc")))
def _(g, spark, d):
    return strong_components(g.edges)


_LAYERS = """nm AS (SELECT v.id, coalesce(s.component, v.id) AS c FROM (SELECT source AS id FROM ge WHERE edge_type IN ('imports', 'inherits') UNION SELECT target FROM ge WHERE edge_type IN ('imports', 'inherits')) v LEFT JOIN dep s ON s.id = v.id),
cs AS (SELECT DISTINCT a.c AS u, b.c AS v FROM deps s JOIN nm a ON a.id = s.a JOIN nm b ON b.id = s.b WHERE a.c <> b.c),
lay(c, d) AS (SELECT DISTINCT c, 0 FROM nm UNION SELECT s.v, l.d + 1 FROM lay l JOIN cs s ON s.u = l.c)"""


@register("c3_dependency_layers", sql("SELECT n.id, n.c AS component, max(l.d) AS layer FROM nm n JOIN lay l ON l.c = n.c GROUP BY 1, 2", *_mutual("dep", "edge_type IN ('imports', 'inherits')"), _LAYERS))
def _(g, spark, d):
    i = g.edges_of_types("imports", "inherits")
    return layers(i, i.select(F.explode(F.array("source", "target")).alias("id")).distinct())


_CYC = """st AS (SELECT DISTINCT source AS u, target AS v FROM ge WHERE edge_type IN ('calls', 'imports') AND source IN (SELECT id FROM cn) AND target IN (SELECT id FROM cn) AND source <> target),
cy(first, cur, path) AS (SELECT u, v, [u, v] FROM st WHERE v > u UNION ALL SELECT c.first, s.v, list_append(c.path, s.v) FROM cy c JOIN st s ON s.u = c.cur WHERE c.cur <> c.first AND s.v >= c.first AND len(c.path) <= 4 AND (s.v = c.first OR NOT list_contains(c.path, s.v)))"""


@register("c4_cycles", sql("SELECT path[1:len(path) - 1] AS path FROM cy WHERE cur = first UNION SELECT DISTINCT [source] FROM ge WHERE edge_type IN ('calls', 'imports') AND source = target", _CYC))
def _(g, spark, d):
    return cycles(g.edges_of_types("calls", "imports"), 4)


@register("c3_all_layers", sql("SELECT n.id, n.c AS component, max(l.d) AS layer FROM nm n JOIN lay l ON l.c = n.c GROUP BY 1, 2", *_mutual("dep"), _LAYERS.replace(" WHERE edge_type IN ('imports', 'inherits')", "")))
def all_layers(g, spark, d):
    """Layers over relationships of every type."""
    return layers(g.edges, g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct())


@register("c4_all_cycles")
def _(g, spark, d):
    """Cycles of any length; those of components too dense to be walked to the end are flagged."""
    return all_cycles(g.edges_of_types("calls", "imports"))


@register("c5_has_circular_dependencies", sql("SELECT EXISTS (SELECT 1 FROM cyc) OR EXISTS (SELECT 1 FROM ge WHERE edge_type IN ('calls', 'imports') AND source = target) AS cyclic", *_mutual("cyc", "edge_type IN ('calls', 'imports')")))
def _(g, spark, d):
    return spark.createDataFrame([(is_cyclic(g.edges_of_types("calls", "imports")),)], "cyclic boolean")


_R = 8
_PR = ["vx AS (SELECT source AS id FROM ge UNION SELECT target FROM ge)", "ew AS (SELECT source, target, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source) AS share FROM ge GROUP BY 1, 2)",
       "cnt AS (SELECT count(*) * 1.0 AS n FROM vx)", "r0 AS (SELECT id, CAST(1 AS DOUBLE) / (SELECT n FROM cnt) AS rank FROM vx)"]
for _i in range(1, _R + 1):
    _PR.append(f"""r{_i} AS (SELECT v.id, 0.85 * (coalesce(x.g, 0) + (SELECT coalesce(sum(rank), 0) FROM r{_i - 1} WHERE id NOT IN (SELECT source FROM ew)) / (SELECT n FROM cnt)) + 0.15 / (SELECT n FROM cnt) AS rank
      FROM vx v LEFT JOIN (SELECT e.target AS id, sum(p.rank * CAST(e.share AS DOUBLE)) AS g FROM ew e JOIN r{_i - 1} p ON p.id = e.source GROUP BY 1) x ON x.id = v.id)""")


@register("c6_pagerank", sql(f"SELECT id, round(rank, 8) AS rank FROM r{_R}", *_PR))
def _(g, spark, d):
    v = g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return pagerank(g.edges, v, rounds=_R, tolerance=None).select("id", F.round("rank", 8).alias("rank"))


@register("c6_critical_nodes")
def _(g, spark, d):
    v = g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return pagerank(g.edges, v).orderBy(F.desc("rank"), "id").limit(20)


_BETWEEN = """st AS (SELECT DISTINCT source AS u, target AS v FROM ge WHERE edge_type = 'imports' AND source <> target), vs AS (SELECT source AS id FROM ge WHERE edge_type = 'imports' UNION SELECT target FROM ge WHERE edge_type = 'imports'),
sp(s, v, d, n) USING KEY (s, v) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM vs UNION SELECT r.s, e.v, r.d + 1, sum(r.n) FROM sp r JOIN st e ON e.u = r.v LEFT JOIN recurring.sp k ON k.s = r.s AND k.v = e.v WHERE k.s IS NULL GROUP BY 1, 2, 3),
bt AS (SELECT a.v AS id, sum(a.n * b.n / t.n) / ((SELECT count(*) - 1 FROM vs) * (SELECT count(*) - 2 FROM vs)) AS score FROM sp a JOIN sp b ON b.s = a.v JOIN sp t ON t.s = a.s AND t.v = b.v WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = t.d GROUP BY 1)"""


@register("c7_import_bottlenecks", sql("SELECT id, round(score, 9) AS score FROM bt", _BETWEEN))
def _(g, spark, d):
    i = g.edges_of_types("imports")
    v = i.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return betweenness(i, v).where("score > 0").withColumn("score", F.round("score", 9))


_EX = "name IN (" + ", ".join(f"'{x}'" for x in EXEMPT) + ")"
_LIVE = f"""pn AS (SELECT * FROM cn WHERE NOT is_proposed),
flow AS (SELECT source, target FROM ge WHERE edge_type IN ('calls', 'reads') UNION SELECT source, target FROM ge WHERE edge_type = 'contains' AND source IN (SELECT id FROM pn WHERE symbol_type = 'class')),
lv(id) AS (SELECT id FROM pn WHERE symbol_type = 'module' OR {_EX} UNION SELECT f.target FROM lv r JOIN flow f ON f.source = r.id),
dd AS (SELECT id, symbol_type FROM pn WHERE symbol_type IN ('function', 'method', 'class') AND NOT starts_with(name, 'test_') AND NOT starts_with(name, 'Test') AND NOT ({_EX}) AND id NOT IN (SELECT id FROM lv)),
rd AS (SELECT DISTINCT target FROM ge WHERE edge_type = 'reads'), wr AS (SELECT DISTINCT target FROM ge WHERE edge_type = 'writes'),
ow AS (SELECT *, regexp_extract(id, '^(.*)[.][^.]*$', 1) AS owner FROM pn)"""


@register("d3_dead_symbols", sql("""SELECT id, symbol_type, 'unreachable' AS reason FROM dd
  UNION ALL SELECT id, symbol_type, 'dead owner' FROM ow WHERE symbol_type = 'parameter' AND name NOT IN ('self', 'cls') AND owner IN (SELECT id FROM dd)
  UNION ALL SELECT id, symbol_type, 'never read' FROM ow WHERE symbol_type = 'parameter' AND name NOT IN ('self', 'cls') AND owner NOT IN (SELECT id FROM dd) AND owner NOT IN (SELECT target FROM rd)
    AND id NOT IN (SELECT target FROM rd) AND id IN (SELECT source FROM ge UNION SELECT target FROM ge)
  UNION ALL SELECT id, symbol_type, 'written, never read' FROM ow WHERE symbol_type = 'variable' AND id IN (SELECT target FROM wr) AND id NOT IN (SELECT target FROM rd)
    AND owner NOT IN (SELECT source FROM ge WHERE edge_type = 'inherits' AND string_split(target, '.')[-1] IN ('BaseModel', 'Model', 'Schema') AND source IN (SELECT id FROM pn WHERE symbol_type = 'class'))""", _LIVE))
def _(g, spark, d):
    return dead_symbols(g)


@register("d2_live_symbols", sql("SELECT id FROM lv", _LIVE))
def _(g, spark, d):
    return live(g)


@register("d6_dead_returns", sql("""SELECT source, target FROM ge r WHERE edge_type = 'returns' AND source IN (SELECT id FROM pn WHERE symbol_type IN ('function', 'method')) AND source NOT IN (SELECT id FROM dd)
  AND NOT EXISTS (SELECT 1 FROM ge x WHERE x.edge_type = 'returns' AND x.source = r.source AND x.target IN (SELECT target FROM rd))""", _LIVE))
def _(g, spark, d):
    return dead_returns(g, dead_symbols(g).where("reason = 'unreachable'"))


@register("d7_dead_imports", sql("""SELECT source, target FROM ge WHERE edge_type = 'imports' AND NOT is_proposed AND target NOT IN (SELECT id FROM cn)
  AND EXISTS (SELECT 1 FROM cn WHERE starts_with(cn.id, ge.target || '.'))"""))
def _(g, spark, d):
    return dead_imports(g)


@register("a5_health", sql("""SELECT count(*) AS total_nodes, count(*) FILTER (is_dead) AS dead,
  count(*) FILTER (symbol_type = 'module') AS modules, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type = 'function') AS functions,
  count(*) FILTER (symbol_type = 'method') AS methods, count(*) FILTER (symbol_type = 'variable') AS variables, count(*) FILTER (symbol_type = 'parameter') AS parameters,
  (SELECT count(*) FROM ge) AS total_edges, (SELECT count(*) FROM ge WHERE edge_type = 'calls' AND target NOT IN (SELECT id FROM cn)) AS external_calls,
  (SELECT count(DISTINCT component) FROM scc) AS n_circular, (SELECT count(DISTINCT comp) FROM cc WHERE id IN (SELECT s FROM und)) AS n_clusters,
  count(*) FILTER (id NOT IN (SELECT id FROM r)) AS truly_dead, (SELECT count(*) FILTER (target IN (SELECT id FROM cn)) / count(*) FROM ge WHERE edge_type IN ('reads', 'writes')) AS share FROM cn""",
  _UND, _CC, *_mutual("scc"), reached("r", "SELECT id FROM cn WHERE symbol_type = 'module'")))
def _(g, spark, d):
    """One row of figures; the ranked lists are queries of their own."""
    strong, _ = keep(strong_components(g.edges), "strong")
    n = strong.agg(F.countDistinct("component").alias("n_circular"))
    w = components(g.edges, "source", "target").agg(F.countDistinct("component").alias("n_clusters"))
    t = g.nodes.select("id").join(reach(g.edges, g.nodes.where("symbol_type = 'module'")).select("id"), "id", "left_anti").agg(F.count("*").alias("truly_dead"))
    return g.stats().crossJoin(n).crossJoin(w).crossJoin(t).crossJoin(g.flow_resolution().select("share"))  # one row each


# -- fingerprints ------------------------------------------------------------------


def _fingerprints(spark, d):
    fp = table(spark, d, "fingerprints")
    last = fp.groupBy("node_id").agg(F.max("fp_id").alias("fp_id")).select("fp_id")
    return keep(fp.join(last, "fp_id", "left_semi").drop("source_snippet", "docstring"), "fingerprints")[0]


_FP = "fp AS (SELECT * FROM fingerprints WHERE fp_id IN (SELECT max(fp_id) FROM fingerprints GROUP BY node_id))"


@register("m5_bands", f"""WITH {_FP} SELECT fp_id, b AS band, minhash[b * 5 + 1:b * 5 + 5] AS value FROM (SELECT fp_id, minhash, unnest(generate_series(0, 19)) AS b FROM fp WHERE len(minhash) = 100) x""", graph=False)
def _(spark, d):
    return bands(_fingerprints(spark, d))


@register("m8_neighbourhood_sizes", f"""WITH {_FP}, l AS (
  SELECT fp_id, 'calls:' || string_split(v, '.')[-1] AS x FROM (SELECT fp_id, unnest(callees) AS v FROM fp) a WHERE v IS NOT NULL UNION SELECT fp_id, 'reads:' || string_split(v, '.')[-1] FROM (SELECT fp_id, unnest(reads) AS v FROM fp) a WHERE v IS NOT NULL
  UNION SELECT fp_id, 'writes:' || string_split(v, '.')[-1] FROM (SELECT fp_id, unnest(writes) AS v FROM fp) a WHERE v IS NOT NULL UNION SELECT fp_id, 'caller:' || string_split(v, '.')[-1] FROM (SELECT fp_id, unnest(callers) AS v FROM fp) a WHERE v IS NOT NULL)
  SELECT f.fp_id, count(l.x) AS n FROM fp f LEFT JOIN l ON l.fp_id = f.fp_id GROUP BY 1""", graph=False)
def _(spark, d):
    return _fingerprints(spark, d).select("fp_id", F.size(neighbourhood()).cast("bigint").alias("n"))


def _jac(a, b):
    a, b = (f"list_distinct(list_filter(coalesce({x}, []), lambda v: v IS NOT NULL))" for x in (a, b))
    return f"len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)"


def _short(f, label):
    return f"list_transform(list_filter(coalesce({f}, []), lambda v: v IS NOT NULL), lambda v: '{label}' || string_split(v, '.')[-1])"


_NEAR = f"list_distinct(list_concat({_short('callees', 'calls:')}, {_short('reads', 'reads:')}, {_short('writes', 'writes:')}, {_short('callers', 'caller:')}))"
_SCORED = f"""bd AS (SELECT fp_id, b, minhash[b * 5 + 1:b * 5 + 5] AS v FROM (SELECT fp_id, minhash, unnest(generate_series(0, 19)) AS b FROM fp WHERE len(minhash) = 100) x),
nd AS (SELECT fp_id, i, ast_tree[i].depth AS d, ast_tree[i].label AS label FROM (SELECT fp_id, ast_tree, unnest(generate_series(1, len(ast_tree))) AS i FROM fp WHERE len(ast_tree) > 0) x),
pa AS (SELECT a.*, b.i AS pi, b.label AS pl FROM nd a ASOF LEFT JOIN nd b ON a.fp_id = b.fp_id AND a.d - 1 = b.d AND a.i > b.i),
sb AS (SELECT a.*, c.i AS si, c.label AS sl FROM pa a ASOF LEFT JOIN nd c ON a.fp_id = c.fp_id AND a.d = c.d AND a.i > c.i),
gr AS (SELECT s.fp_id, coalesce(q.pl, '') || chr(1) || coalesce(s.pl, '') || chr(1) || CASE WHEN s.si > coalesce(s.pi, 0) THEN s.sl ELSE '' END || chr(1) || s.label AS g FROM sb s LEFT JOIN pa q ON q.fp_id = s.fp_id AND q.i = s.pi),
gn AS (SELECT fp_id, g, row_number() OVER (PARTITION BY fp_id, g) AS nth FROM gr), gc AS (SELECT fp_id, count(*) AS n FROM gr GROUP BY 1),
cand AS (__CAND__),
gb AS (SELECT c.a, c.b, count(*) AS k FROM cand c JOIN gn x ON x.fp_id = c.a JOIN gn y ON y.fp_id = c.b AND x.g = y.g AND x.nth = y.nth GROUP BY 1, 2),
f2 AS (SELECT *, {_NEAR} AS nb, list_sum(list_transform(map_values(ast_node_counts), lambda x: CAST(x AS DOUBLE) * x)) AS sq FROM fp),
sg AS (SELECT c.a, c.b, [
  CASE WHEN cardinality(x.ast_node_counts) > 0 AND cardinality(y.ast_node_counts) > 0 THEN coalesce(list_sum(list_transform(map_keys(x.ast_node_counts), lambda k: CAST(x.ast_node_counts[k] AS DOUBLE) * coalesce(y.ast_node_counts[k], 0))) / (sqrt(x.sq) * sqrt(y.sq)), 0) END,
  CASE WHEN len(x.nb) = 0 OR len(y.nb) = 0 THEN NULL WHEN 2 * len(list_intersect(x.nb, y.nb)) = len(x.nb) + len(y.nb) THEN 1.0 ELSE (1 + 2 * len(list_intersect(x.nb, y.nb))) / CAST(7 + 4 * (len(x.nb) + len(y.nb)) - 2 * len(list_intersect(x.nb, y.nb)) AS DOUBLE) END,
  {_jac('x.callees', 'y.callees')}, {_jac('x.arg_names', 'y.arg_names')},
  CASE WHEN coalesce(x.arg_count, 0) + coalesce(y.arg_count, 0) > 0 THEN 1 - abs(coalesce(x.arg_count, 0) - coalesce(y.arg_count, 0)) / CAST(coalesce(x.arg_count, 0) + coalesce(y.arg_count, 0) AS DOUBLE) END,
  (CAST(x.has_loops IS NOT DISTINCT FROM y.has_loops AS INT) + CAST(x.has_conditionals IS NOT DISTINCT FROM y.has_conditionals AS INT) + CAST(x.has_try_except IS NOT DISTINCT FROM y.has_try_except AS INT) + CAST(x.has_yield IS NOT DISTINCT FROM y.has_yield AS INT) + CAST(x.has_await IS NOT DISTINCT FROM y.has_await AS INT)) / 5.0,
  {_jac('x.reads', 'y.reads')},
  CASE WHEN coalesce(x.line_count, 0) > 0 AND coalesce(y.line_count, 0) > 0 THEN 1 - abs(x.line_count - y.line_count) / CAST(greatest(x.line_count, y.line_count) AS DOUBLE) END,
  CASE WHEN coalesce(x.max_nesting_depth, 0) > 0 OR coalesce(y.max_nesting_depth, 0) > 0 THEN 1 - abs(coalesce(x.max_nesting_depth, 0) - coalesce(y.max_nesting_depth, 0)) / CAST(greatest(coalesce(x.max_nesting_depth, 0), coalesce(y.max_nesting_depth, 0)) AS DOUBLE) END,
  CASE WHEN g.k > 0 THEN 2.0 * g.k / (gx.n + gy.n) END] AS s, [2.0, 2.5, 2.0, 1.5, 0.5, 1.5, 1.0, 0.5, 0.5, 3.5] AS w
  FROM cand c JOIN f2 x ON x.fp_id = c.a JOIN f2 y ON y.fp_id = c.b LEFT JOIN gb g ON g.a = c.a AND g.b = c.b LEFT JOIN gc gx ON gx.fp_id = c.a LEFT JOIN gc gy ON gy.fp_id = c.b),
sc AS (SELECT a, b, round(list_sum(list_transform(generate_series(1, 10), lambda i: coalesce(s[i], 0) * w[i])) / list_sum(list_transform(generate_series(1, 10), lambda i: CASE WHEN s[i] IS NULL THEN 0 ELSE w[i] END)), 9) AS score FROM sg)"""
_BANDED = "SELECT DISTINCT x.fp_id AS a, y.fp_id AS b FROM bd x JOIN bd y ON x.b = y.b AND x.v = y.v AND x.fp_id < y.fp_id"
_TWIN = "SELECT t.id AS a, fp_id AS b FROM fp, (SELECT min(fp_id) AS id FROM fp WHERE len(minhash) = 100 GROUP BY minhash ORDER BY count(*) DESC, 1 LIMIT 1) t WHERE fp_id <> t.id"
_ONE = "SELECT (SELECT min(fp_id) FROM fp) AS a, fp_id AS b FROM fp WHERE fp_id > (SELECT min(fp_id) FROM fp)"


@register("m10_candidate_scores", f"WITH {_FP}, {_SCORED.replace('__CAND__', _BANDED)} SELECT a, b, score FROM sc WHERE score >= 0.6", graph=False)
def _(spark, d):
    """Every pair of records of one band with a score of at least 0.6."""
    fp = _fingerprints(spark, d)
    same, _ = keep(classes(fp), "classes")
    return record_pairs(keep(scored(candidates(fp, same=same), fp, least=0.6), "similar-pairs")[0], same).withColumn("score", F.round("score", 9))


@register("m11_duplicate_groups", f"""WITH RECURSIVE {_FP}, {_SCORED.replace('__CAND__', _BANDED)}, und AS (SELECT a AS s, b AS o FROM sc WHERE score >= 0.6 UNION SELECT b, a FROM sc WHERE score >= 0.6),
cc(id, comp) USING KEY (id) AS (SELECT s, s FROM (SELECT DISTINCT s FROM und) v UNION SELECT u.o, min(c.comp) FROM cc c JOIN und u ON u.s = c.id JOIN recurring.cc k ON k.id = u.o WHERE c.comp < k.comp GROUP BY 1) SELECT id, comp AS group FROM cc""", graph=False)
def _(spark, d):
    return duplicate_groups(_fingerprints(spark, d), 0.6)[0]


_EQUAL = "minhash, ast_tree, list_sort(map_entries(ast_node_counts)), callees, callers, reads, writes, arg_names, arg_count, line_count, max_nesting_depth, has_loops, has_conditionals, has_try_except, has_yield, has_await"


@register("m11_duplicate_summary", SQL["m11_duplicate_groups"].split(" SELECT id, comp AS group")[0] + f""", hd AS (SELECT fp_id, min(fp_id) OVER (PARTITION BY {_EQUAL}) AS head FROM fp WHERE len(minhash) = 100)
SELECT c.comp AS group, count(*) FILTER (x.head = s.a AND (y.head = s.b OR y.head = s.a)) AS n_pairs, count(*) AS n_record_pairs, round(avg(s.score), 6) AS similarity
FROM sc s JOIN cc c ON c.id = s.a JOIN hd x ON x.fp_id = s.a JOIN hd y ON y.fp_id = s.b WHERE s.score >= 0.6 GROUP BY 1""", graph=False)
def _(spark, d):
    fp = table(spark, d, "fingerprints")
    return duplicate_groups(fp, 0.6, only=fp.groupBy("node_id").agg(F.max("fp_id").alias("fp_id")).select("fp_id"))[1].withColumn("similarity", F.round("similarity", 6))


@register("m12_similar_to_twinned", f"WITH {_FP}, {_SCORED.replace('__CAND__', _TWIN)} SELECT a, b, score FROM sc WHERE score >= 0.5 ORDER BY score DESC, b LIMIT 10", graph=False)
def _(spark, d):
    """The ten fingerprints most similar to the one whose signature most others have, all being scored."""
    fp = _fingerprints(spark, d)
    one = fp.where(F.size("minhash") == 100).groupBy("minhash").agg(F.count("*").alias("n"), F.min("fp_id").alias("id")).orderBy(F.desc("n"), "id").first()["id"]
    pairs = fp.where(F.col("fp_id") != one).select(F.lit(one).cast("bigint").alias("a"), F.col("fp_id").alias("b"))
    return scored(pairs, fp, least=0.5, one=fp.where(F.col("fp_id") == one)).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "b").limit(10)


@register("m12_similar_to", f"WITH {_FP}, {_SCORED.replace('__CAND__', _ONE)} SELECT a, b, score FROM sc WHERE score >= 0.5 ORDER BY score DESC, b LIMIT 10", graph=False)
def _(spark, d):
    """The ten fingerprints most similar to the first one, all being scored."""
    fp = _fingerprints(spark, d)
    one = fp.agg(F.min("fp_id")).first()[0]
    pairs = fp.where(F.col("fp_id") != one).select(F.lit(one).cast("bigint").alias("a"), F.col("fp_id").alias("b"))
    return scored(pairs, fp, least=0.5, one=fp.where(F.col("fp_id") == one)).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "b").limit(10)


_SHAPE = ["ast_tree", "arg_count", "has_loops", "has_conditionals", "has_try_except", "has_yield", "has_await"]


@register("a14_tree_counts", f"""WITH {_FP}, n AS (SELECT fp_id, unnest(ast_tree) AS x FROM fp) SELECT fp_id, x.label AS label, count(*) AS n FROM n GROUP BY 1, 2""", graph=False)
def _(spark, d):
    """Node counts of every stored tree, made again from the tree."""
    return _fingerprints(spark, d).select("fp_id", F.explode(node_counts(F.col("ast_tree"))).alias("label", "n")).withColumn("n", F.col("n").cast("bigint"))


@register("a15_tree_flags", f"""WITH {_FP}, n AS (SELECT fp_id, unnest(ast_tree) AS x FROM fp) SELECT fp_id, max(x.depth) AS depth, bool_or(x.label IN ('For', 'While', 'AsyncFor')) AS has_loops, bool_or(x.label IN ('If', 'IfExp')) AS has_conditionals,
  bool_or(x.label IN ('Try', 'ExceptHandler')) AS has_try_except, bool_or(x.label IN ('Yield', 'YieldFrom')) AS has_yield, bool_or(x.label = 'Await') AS has_await FROM n GROUP BY 1""", graph=False)
def _(spark, d):
    t = F.col("ast_tree")
    return _fingerprints(spark, d).where(F.size(t) > 0).select("fp_id", max_depth(t).alias("depth"), *[c.alias(k) for k, c in flags(t).items()])


@register("m4_minhash", f"""WITH {_FP}, nd AS (SELECT fp_id, i, ast_tree[i].depth AS d, ast_tree[i].label AS label FROM (SELECT fp_id, ast_tree, unnest(generate_series(1, len(ast_tree))) AS i FROM fp WHERE len(ast_tree) > 0) x),
pa AS (SELECT a.*, b.label AS pl FROM nd a ASOF LEFT JOIN nd b ON a.fp_id = b.fp_id AND a.d - 1 = b.d AND a.i > b.i),
sh AS (SELECT fp_id, 'ast:' || label AS s FROM nd WHERE d <= 6 UNION SELECT fp_id, 'ast:' || pl || '>' || label FROM pa WHERE d BETWEEN 1 AND 7 UNION SELECT fp_id, 'args:' || coalesce(arg_count, 0) FROM fp WHERE len(ast_tree) > 0
  UNION SELECT fp_id, 'flow:' || f FROM (SELECT fp_id, unnest(list_filter([CASE WHEN has_loops THEN 'has_loops' END, CASE WHEN has_conditionals THEN 'has_conditionals' END, CASE WHEN has_try_except THEN 'has_try_except' END, CASE WHEN has_yield THEN 'has_yield' END, CASE WHEN has_await THEN 'has_await' END], lambda v: v IS NOT NULL)) AS f FROM fp WHERE len(ast_tree) > 0) x)
SELECT fp_id, seed, min(CAST('0x' || substr(md5(seed || ':' || s), 1, 8) AS BIGINT)) AS h FROM sh, (SELECT unnest(generate_series(0, 99)) AS seed) k GROUP BY 1, 2""", graph=False)
def _(spark, d):
    """Signatures made from the stored trees, flags and argument counts, a row per seed."""
    fp = keep(_fingerprints(spark, d).where("size(ast_tree) > 0").select("fp_id", shingles(F.col("ast_tree"), {k: F.col(k) for k in _SHAPE[2:]}, F.col("arg_count")).alias("s")), "shingles")[0]
    return fp.select("fp_id", F.posexplode(minhash(F.col("s"))).alias("seed", "h"))


@register("m9_count_cosines", f"""WITH {_FP}, one AS (SELECT ast_node_counts AS m FROM fp ORDER BY fp_id LIMIT 1),
  k AS (SELECT fp_id, unnest(map_entries(ast_node_counts)) AS e FROM fp), o AS (SELECT unnest(map_entries(m)) AS e FROM one)
  SELECT k.fp_id, round(coalesce(sum(k.e.value * coalesce(o.e.value, 0)) / (sqrt(sum(k.e.value * k.e.value)) * sqrt((SELECT sum(e.value * e.value) FROM o))), 0), 9) AS cosine
  FROM k LEFT JOIN o ON o.e.key = k.e.key GROUP BY 1""", graph=False)
def _(spark, d):
    fp = _fingerprints(spark, d).select("fp_id", "ast_node_counts")
    m = fp.orderBy("fp_id").select(F.col("ast_node_counts").alias("m")).limit(1)
    return fp.where(F.size("ast_node_counts") > 0).crossJoin(F.broadcast(m)).select("fp_id", F.round(count_cosine(F.col("ast_node_counts"), F.col("m")), 9).alias("cosine"))  # m is one row


@register("m15_nearest_vectors", """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (
  SELECT vec_id, list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS s FROM embeddings, q)
  SELECT vec_id, round(s, 6) AS similarity FROM s WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) AND s >= 0.1 ORDER BY s DESC, vec_id LIMIT 20""", graph=False)
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.orderBy("vec_id").select(F.col("vec_id").alias("own"), F.col("embedding").alias("q")).limit(1)
    s = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    x = e.crossJoin(F.broadcast(q)).where("vec_id != own").withColumn("s", s).where("s >= 0.1")  # q is one row
    return x.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("similarity"))


@register("m16_uncached_vectors", """SELECT node_id, source_hash FROM (SELECT node_id, substr(sha256(source_snippet), 1, 16) AS source_hash FROM fingerprints WHERE fp_id IN (SELECT max(fp_id) FROM fingerprints GROUP BY node_id) AND source_snippet IS NOT NULL) f
  WHERE NOT EXISTS (SELECT 1 FROM function_vectors v WHERE v.function_id = f.node_id AND v.source_hash = f.source_hash AND v.model_name = 'codemini-2')""", graph=False)
def _(spark, d):
    """Functions whose vector is missing or was made from another source."""
    fp = table(spark, d, "fingerprints").groupBy("node_id").agg(F.max_by("source_snippet", "fp_id").alias("s")).where("s is not null")
    fp = fp.select("node_id", F.substring(F.sha2("s", 256), 1, 16).alias("source_hash"))
    have = table(spark, d, "function_vectors").where("model_name = 'codemini-2'").select(F.col("function_id").alias("node_id"), "source_hash")
    return fp.join(have, ["node_id", "source_hash"], "left_anti")


_STORED = """SELECT function_id, arg_max(vec_id, (created_at, vec_id)) AS vec_id FROM function_vectors WHERE model_name = 'codemini-2' AND function_id IN (SELECT id FROM nodes WHERE deleted_at IS NULL) GROUP BY 1"""


@register("m17_vector_store", _STORED, graph=False)
def _(spark, d):
    """The keyed store after all upserts, vectors of symbols deleted since being taken out."""
    v = table(spark, d, "function_vectors").where("model_name = 'codemini-2'")
    alive = table(spark, d, "nodes").where("deleted_at is null").select(F.col("id").alias("function_id"))
    return v.join(alive, "function_id", "left_semi").groupBy("function_id").agg(F.max(F.struct("created_at", "vec_id")).alias("m")).select("function_id", "m.vec_id")


@register("m17_kept_store", _STORED, graph=False)
def _(spark, d):
    """The same by the stored table itself: vectors upserted, those of symbols no longer there deleted, the rest read."""
    v = table(spark, d, "function_vectors").where("model_name = 'codemini-2' and function_id is not null").select("function_id", "vec_id", "created_at")
    alive = table(spark, d, "nodes").where("deleted_at is null").select(F.col("id").alias("function_id"))
    store = Versions(spark)
    store.upsert(v, "function_id", ["created_at", "vec_id"])
    store.delete(store.rows(v.schema).select("function_id").join(alive, "function_id", "left_anti"), v.schema)
    return store.rows(v.schema).select("function_id", "vec_id")


# -- layouts -------------------------------------------------------------------------

_FIT = "SELECT id, round((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) * (1200 * 2 * sqrt(n) - 160) + 80, 2) AS x, round((y - min(y) OVER ()) / nullif(max(y) OVER () - min(y) OVER (), 0) * (800 * 2 * sqrt(n) - 160) + 80, 2) AS y FROM p"


def _rounded(df):
    return df.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@register("l2_spiral", sql(_FIT, "rk AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM cn)", "p AS (SELECT id, n, sqrt((i + 1) / n) * cos(i * pi() * (3 - sqrt(5))) AS x, sqrt((i + 1) / n) * sin(i * pi() * (3 - sqrt(5))) AS y FROM rk)"))
def _(g, spark, d):
    return _rounded(layout.spiral(g.nodes))


@register("l3_circular", sql(_FIT, "rk AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM cn)", "p AS (SELECT id, n, cos(i * (2 * pi() / n)) AS x, sin(i * (2 * pi() / n)) AS y FROM rk)"))
def _(g, spark, d):
    return _rounded(layout.circular(g.nodes))


@register("l4_hierarchical", sql(_FIT, """rk AS (SELECT id, count(*) OVER () AS n, list_position(['module', 'class', 'function', 'method', 'variable', 'parameter'], symbol_type) AS layer FROM cn)""",
  "p AS (SELECT id, n, row_number() OVER (PARTITION BY layer ORDER BY id) * 1.0 / (count(*) OVER (PARTITION BY layer) + 1) AS x, dense_rank() OVER (ORDER BY layer) - 1 AS y FROM rk)"))
def _(g, spark, d):
    return _rounded(layout.hierarchical(g.nodes))


# -- changes and streams -------------------------------------------------------------


@register("t2_latest_files", "SELECT path, file_id, content_hash FROM source_files WHERE file_id IN (SELECT arg_max(file_id, (mtime, file_id)) FROM source_files GROUP BY path)", graph=False)
def _(spark, d):
    s = table_stream(spark, d, "source_files").select("path", "file_id", "content_hash", "mtime")
    return latest_by_stream(s, "path", ["mtime", "file_id"]).select("path", "file_id", "content_hash")


_A, _B = "2024-06-01", "2024-09-01"
_ASOF = "{n} AS (SELECT * FROM (SELECT id, name, symbol_type, line_start, line_end, is_dead, row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, seq DESC) AS rn FROM nodes WHERE observed_at <= TIMESTAMP '{t}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{t}')) x WHERE rn = 1)"
_AB = "WITH " + _ASOF.format(n="o", t=_A) + ", " + _ASOF.format(n="n", t=_B)


_EAS = "e{n} AS (SELECT DISTINCT s AS source, t AS target, lower(edge_type) AS edge_type FROM (SELECT trim(source, chr(32) || chr(9)) AS s, trim(target, chr(32) || chr(9)) AS t, edge_type, observed_at FROM edges) x WHERE observed_at <= TIMESTAMP '{t}' AND s <> '' AND t <> '' AND edge_type IS NOT NULL AND s IN (SELECT id FROM {n}))"
_EAB = _AB + ", " + _EAS.format(n="o", t=_A) + ", " + _EAS.format(n="n", t=_B)
_CHANGED = """dn AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'updated' END AS change, n.name, n.symbol_type, n.line_start, n.line_end, n.is_dead FROM o FULL JOIN n ON o.id = n.id
  WHERE o.id IS NULL OR n.id IS NULL OR (o.name, o.symbol_type, o.line_start, o.line_end, o.is_dead) IS DISTINCT FROM (n.name, n.symbol_type, n.line_start, n.line_end, n.is_dead)),
de AS (SELECT *, 'added' AS change FROM (SELECT * FROM en EXCEPT SELECT * FROM eo) x UNION ALL SELECT *, 'removed' FROM (SELECT * FROM eo EXCEPT SELECT * FROM en) x)"""


def _snapshots(spark, d):
    """Nodes and edges at two times."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    old, new = (keep(as_of(n, t), "snapshot")[0] for t in (_A, _B))
    return old, new, *(keep(edges_as_of(e, x, t), "snapshot-edges")[0] for x, t in ((old, _A), (new, _B)))


@register("t5_snapshot_delta", f"{_EAB}, {_CHANGED} SELECT * FROM dn", graph=False)
def _(spark, d):
    n = table(spark, d, "nodes")
    return node_delta(as_of(n, _A), as_of(n, _B))


@register("t5_edge_delta", f"{_EAB}, {_CHANGED} SELECT * FROM de", graph=False)
def _(spark, d):
    return edge_delta(*_snapshots(spark, d)[2:])


@register("t5_refresh", f"{_EAB}, {_CHANGED} SELECT (SELECT count(*) FROM o) + (SELECT count(*) FROM eo) AS n_old, (SELECT count(*) FROM dn) + (SELECT count(*) FROM de) AS n_changed, (SELECT count(*) FROM dn) + (SELECT count(*) FROM de) > 0.6 * greatest(1, (SELECT count(*) FROM o) + (SELECT count(*) FROM eo)) AS whole", graph=False)
def _(spark, d):
    old, new, eo, en = _snapshots(spark, d)
    return refresh(old, eo, node_delta(old, new), edge_delta(eo, en))


@register("t6_applied_delta", _AB + " SELECT id, name, symbol_type, line_start, line_end, is_dead FROM n", graph=False)
def _(spark, d):
    """The later snapshot from the earlier one and the delta, which holds the new rows."""
    old, new, _, _ = _snapshots(spark, d)
    return apply_node_delta(old, keep(node_delta(old, new), "delta")[0])


@register("t6_applied_edges", _EAB + " SELECT source, target, edge_type FROM en", graph=False)
def _(spark, d):
    old, new, eo, en = _snapshots(spark, d)
    nodes = apply_node_delta(old, keep(node_delta(old, new), "delta")[0])
    return apply_edge_delta(eo, keep(edge_delta(eo, en), "edge-delta")[0], nodes)


@register("t3_removed_scope", sql("SELECT source, target, edge_type FROM ge WHERE NOT (source = (SELECT p FROM busy) OR starts_with(source, (SELECT p FROM busy) || '.') OR target = (SELECT p FROM busy) OR starts_with(target, (SELECT p FROM busy) || '.'))"))
def _(g, spark, d):
    return remove_module(g.nodes, g.edges, gq.busy(g))[1].select("source", "target", "edge_type")


@register("t4_updated_graph", graph=False)
def updated_graph(spark, d):
    """Relationships after the later half of the file changes came as an update; only changed files are parsed again."""
    files = keep(table(spark, d, "source_files").where("path is not null"), "files")[0]
    half = files.where("mtime is not null").agg(F.percentile_approx("mtime", 0.5)).first()[0]
    early = F.col("mtime").isNull() | (F.col("mtime") <= F.lit(half))
    rows, _ = keep(extract(files.where(early)), "facts")
    later = files.where(~early)
    rows, _ = keep(replace_files(rows, latest_files(later)), "facts")
    return relationships(rows, keep(symbols(rows), "symbols")[0])


@register("t11_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def _(spark, d):
    """Hourly counts; the complete mode keeps every window, so none waits for a later watermark."""
    return windowed_counts(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")


@register("t11_event_stream", SQL["t11_event_windows"], graph=False)
def _(spark, d):
    """The same from a stream: counts are updated with every file, in whatever order of time the files come."""
    return counts_by_stream(table_stream(spark, d, "events"), "ts", "1 hour", "event_type")
