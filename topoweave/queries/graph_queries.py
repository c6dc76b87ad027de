"""Queries on the current graph: lookups, predicates, joins, counts and views.

The symbols asked about are picked from the data (the most called symbol, the
busiest caller among the called, the busiest project), so that every query works
on whole tables of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.functions.names import common_parts, jaccard, last_part, module_of_path, parent, prefixes
from topoweave.operators.graph import SHOWN, PropertyGraph, proposal
from topoweave.operators.resolve import BUILTIN_METHODS, resolve_targets
from topoweave.plans.ask import ask, banner, context
from topoweave.plans.tables import table
from topoweave.queries.graph_sql import NODE, sql
from topoweave.sources.files import SKIPPED, latest_files, snippets
from topoweave.sources.tables import current_edges, current_nodes, kept_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(f: Callable[[PropertyGraph, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, d: f(kept_graph(spark, d), spark, d)
        if oracle:
            SQL[name] = oracle
        return f

    return add


def hub(g: PropertyGraph) -> str:
    """The most called node."""
    n = g.edges.where("edge_type = 'calls'").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi").groupBy("target").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "target").first()["target"]


def middle(g: PropertyGraph) -> str:
    """The node of most callers times callees."""
    c = g.edges.where("edge_type = 'calls'").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")
    i, o = c.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("i")), c.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("o"))
    return i.join(o, "id").orderBy((F.col("i") * F.col("o")).desc(), "id").first()["id"]


def busy(g: PropertyGraph) -> str:
    """The project of most edges."""
    p = g.edges.groupBy(F.substring_index("source", ".", 1).alias("p")).agg(F.count("*").alias("n"))
    return p.orderBy(F.desc("n"), "p").first()["p"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN)


@register("f1_node", sql(f"SELECT {NODE}, signature, line_start FROM cn WHERE id IN (SELECT id FROM mid)"))
def _(g, spark, d):
    return g.node(middle(g)).select(*SHOWN, "signature", "line_start")


@register("f2_all_nodes", sql(f"SELECT {NODE}, is_dead FROM cn WHERE NOT is_proposed"))
def _(g, spark, d):
    return g.all_nodes(False).select(*SHOWN, "is_dead")


@register("f3_functions_and_methods", sql(f"SELECT {NODE} FROM cn WHERE symbol_type IN ('function', 'method') AND NOT is_proposed"))
def _(g, spark, d):
    return shown(g.nodes_by_type("function", "method"))


@register("f4_all_edges", sql("SELECT source, target, edge_type, is_dead, line, seq FROM ge"))
def _(g, spark, d):
    return g.edges.select("source", "target", "edge_type", "is_dead", "line", "seq")


@register("f5_edges_to_hub", sql("SELECT source, target, edge_type, line FROM ge WHERE target IN (SELECT id FROM hub) AND edge_type IN ('calls', 'imports')"))
def _(g, spark, d):
    return g.edges_to(hub(g), "calls", "imports").select("source", "target", "edge_type", "line")


@register("f6_zoom_live_classes", sql(f"SELECT {NODE} FROM cn WHERE symbol_type = 'class' AND NOT is_dead"))
def _(g, spark, d):
    return shown(g.visible("class", show_dead=False))


@register("f8_filter", sql(f"""SELECT {NODE} FROM cn WHERE symbol_type = 'method' AND regexp_matches(qualified_name, '(?i)flush|seal') AND len(string_split(id, '.')) - 1 <= 4"""))
def _(g, spark, d):
    return shown(g.filtered(edge_type="calls", symbol_type="method", max_depth=4, name_pattern="flush|seal").nodes)


@register("f8_filter_edges", sql("""SELECT source, target FROM ge WHERE edge_type = 'calls'
  AND source IN (SELECT id FROM cn WHERE symbol_type IN ('function')) AND target IN (SELECT id FROM cn WHERE symbol_type IN ('function'))"""))
def _(g, spark, d):
    return g.filtered(edge_type="calls", symbol_type="function").edges.select("source", "target")


@register("f13_scope", sql(f"SELECT {NODE} FROM cn WHERE starts_with(qualified_name, (SELECT p FROM busy))"))
def _(g, spark, d):
    return shown(g.nodes.where(F.col("qualified_name").startswith(busy(g))))


@register("f14_search", sql(f"SELECT {NODE} FROM cn WHERE contains(lower(qualified_name), 'retry') OR contains(lower(name), 'retry')"))
def _(g, spark, d):
    return shown(g.search("RETRY"))


@register("f16_resolve", sql(f"SELECT {NODE} FROM cn WHERE contains(lower(qualified_name), 'flush') ORDER BY id <> 'flush', len(qualified_name), id LIMIT 1"))
def _(g, spark, d):
    return shown(g.resolve("flush"))


@register("f18_functions_returning", """WITH fp AS (SELECT * FROM fingerprints WHERE fp_id IN (SELECT max(fp_id) FROM fingerprints GROUP BY node_id))
SELECT node_id, name, return_annotation FROM fp WHERE contains(lower(return_annotation), (SELECT lower(return_annotation) FROM fp WHERE return_annotation <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))""")
def _(g, spark, d):
    """Functions whose annotation holds the most frequent one."""
    fp = table(spark, d, "fingerprints").select("fp_id", "node_id", "name", "return_annotation")
    last = fp.groupBy("node_id").agg(F.max_by(F.struct("name", "return_annotation"), "fp_id").alias("r")).select("node_id", "r.*")
    top = last.where("return_annotation != ''").groupBy(F.lower("return_annotation").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(1)
    return last.join(F.broadcast(top.select("kind")), F.lower("return_annotation").contains(F.col("kind"))).drop("kind")  # one row


@register("f19_dead_functions_in_scope", sql(f"SELECT {NODE} FROM cn WHERE is_dead AND symbol_type IN ('function', 'method') AND starts_with(qualified_name, (SELECT p FROM busy))"))
def _(g, spark, d):
    return shown(g.dead("function", "method", scope=busy(g)))


@register("f20_external_calls", sql("SELECT source, target, line FROM ge WHERE edge_type = 'calls' AND target NOT IN (SELECT id FROM cn)"))
def _(g, spark, d):
    return g.external_calls().select("source", "target", "line")


@register("j1_callers", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT source FROM calls WHERE target IN (SELECT id FROM hub))"))
def _(g, spark, d):
    return shown(g.callers_of(hub(g)))


@register("j2_callees", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT target FROM calls WHERE source IN (SELECT id FROM mid))"))
def _(g, spark, d):
    return shown(g.callees_of(middle(g)))


@register("j3_parameters", sql(f"""SELECT {NODE} FROM cn WHERE symbol_type = 'parameter'
  AND id IN (SELECT target FROM ge WHERE edge_type = 'contains' AND source IN (SELECT id FROM mid))"""))
def _(g, spark, d):
    return shown(g.parameters_of(middle(g)))


@register("j4_returns", sql("SELECT e.source, n.id, n.symbol_type FROM ge e JOIN cn n ON e.target = n.id WHERE e.edge_type = 'returns'"))
def _(g, spark, d):
    return g.edges.where("edge_type = 'returns'").join(g.nodes.withColumnRenamed("id", "target"), "target").select("source", F.col("target").alias("id"), "symbol_type")


@register("j5_imports", sql("SELECT source, target, line FROM ge WHERE edge_type = 'imports'"))
def _(g, spark, d):
    return g.edges_of_types("imports").select("source", "target", "line")


@register("j7_name_index", sql("""SELECT key, count(*) AS n_ids, min(id) AS first_id FROM (
  SELECT DISTINCT id, array_to_string(p[k:], '.') AS key FROM (SELECT id, string_split(id, '.') AS p, unnest(generate_series(1, len(string_split(id, '.')))) AS k FROM cn) x) y GROUP BY 1"""))
def _(g, spark, d):
    return g.name_index().groupBy("key").agg(F.count("*").alias("n_ids"), F.min("id").alias("first_id"))


_PRE = "SELECT DISTINCT t AS target, array_to_string(p[1:k], '.') AS id FROM (SELECT target AS t, string_split(target, '.') AS p, unnest(generate_series(1, len(string_split(target, '.')))) AS k FROM ge) x"


@register("j11_longest_known_prefix", sql(f"""SELECT target, arg_max(id, len(id)) AS known FROM ({_PRE}) y WHERE id IN (SELECT id FROM cn) AND target NOT IN (SELECT id FROM cn) GROUP BY 1"""))
def _(g, spark, d):
    lost = g.edges.select("target").distinct().join(g.nodes.select(F.col("id").alias("target")), "target", "left_anti")
    return g.longest_known_prefix(lost, "target").where("known is not null").select("target", "known")


_KEYS = """kn AS (SELECT DISTINCT key, id FROM (SELECT id, unnest(list_append(list_transform(generate_series(2, len(p)), lambda k: array_to_string(p[k:], '.')), name)) AS key
  FROM (SELECT id, name, string_split(id, '.') AS p FROM cn) x) y WHERE key IS NOT NULL)"""
_BUILTIN = ", ".join(f"'{x}'" for x in BUILTIN_METHODS)
_BEST = f"""hits AS (SELECT e.source, e.target, k.id, k.id = e.source AS own, len(string_split(k.id, '.')) AS parts,
    len(list_filter(generate_series(1, least(len(string_split(e.source, '.')), len(string_split(k.id, '.')))), lambda i: string_split(e.source, '.')[1:i] = string_split(k.id, '.')[1:i])) AS common
  FROM (SELECT DISTINCT source, target FROM ge WHERE target NOT IN (SELECT id FROM cn)) e JOIN kn k ON k.key = e.target
  WHERE string_split(e.target, '.')[-1] NOT IN ({_BUILTIN}) AND (NOT contains(e.target, '.') OR split_part(e.target, '.', 1) IN (SELECT key FROM kn UNION SELECT id FROM cn))),
best AS (SELECT source, target, id FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY own, common DESC, parts, id) AS rn FROM hits) x WHERE rn = 1)"""


@register("j6_resolve_edges", sql("SELECT e.source, e.target, e.edge_type, coalesce(b.id, e.target) AS resolved FROM ge e LEFT JOIN best b ON b.source = e.source AND b.target = e.target", _KEYS, _BEST))
def _(g, spark, d):
    """Edges of known sources with the symbols their targets name."""
    return resolve_targets(g.edges, g.nodes).select("source", "target", "edge_type", "resolved")


@register("j14_edges_between", sql("""SELECT source, target, edge_type, line FROM (
  SELECT e.*, coalesce(n.qualified_name, e.target) AS tn FROM ge e LEFT JOIN cn n ON n.id = e.target WHERE NOT e.is_proposed) x
  WHERE source IN (SELECT id FROM cn WHERE starts_with(qualified_name, (SELECT p FROM busy))) AND NOT starts_with(tn, (SELECT p FROM busy))"""))
def _(g, spark, d):
    return g.edges_between(busy(g))


@register("j15_coupling", sql("""SELECT source, target, edge_type FROM ge WHERE edge_type <> 'contains'
  AND ((starts_with(source, (SELECT p FROM busy)) AND starts_with(target, 'corelib')) OR (starts_with(source, 'corelib') AND starts_with(target, (SELECT p FROM busy))))"""))
def _(g, spark, d):
    return g.coupling(busy(g), "corelib").select("source", "target", "edge_type")


_ANC = """anc AS (SELECT id, arg_max(s, len(s)) AS shown FROM (
  SELECT id, array_to_string(p[1:k], '.') AS s FROM (SELECT id, string_split(id, '.') AS p, unnest(generate_series(1, len(string_split(id, '.')))) AS k
  FROM (SELECT source AS id FROM ge UNION SELECT target FROM ge) v) x) y WHERE s IN (SELECT id FROM vis) GROUP BY 1)"""


@register("j16_module_snapshot_edges", sql("""SELECT DISTINCT a.shown AS source, b.shown AS target, e.edge_type FROM ge e JOIN anc a ON a.id = e.source JOIN anc b ON b.id = e.target
  WHERE e.edge_type <> 'contains' AND a.shown <> b.shown
  UNION SELECT source, target, edge_type FROM ge WHERE edge_type = 'contains' AND source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)""", "vis AS (SELECT id FROM cn WHERE symbol_type = 'module')", _ANC))
def _(g, spark, d):
    return g.rolled_up_edges(g.visible("module"))


@register("j18_class_roles", sql("""SELECT shown AS id, CASE min(p) WHEN 1 THEN 'origin' WHEN 2 THEN 'mutator' WHEN 3 THEN 'passthrough' ELSE 'destination' END AS role FROM (
  SELECT a.shown, CASE WHEN r.t = 'module' THEN 1 WHEN r.t = 'class' THEN 2 WHEN r.t = 'method' THEN 3 ELSE 4 END AS p
  FROM (SELECT id, symbol_type AS t FROM cn) r JOIN anc2 a ON a.id = r.id) x GROUP BY 1""", "vis AS (SELECT id FROM cn WHERE symbol_type = 'class')", _ANC.replace("anc AS", "anc2 AS").replace("SELECT source AS id FROM ge UNION SELECT target FROM ge", "SELECT id FROM cn")))
def _(g, spark, d):
    role = F.when(F.col("symbol_type") == "module", "origin").when(F.col("symbol_type") == "class", "mutator").when(F.col("symbol_type") == "method", "passthrough").otherwise("destination")
    return g.rolled_up_roles(g.nodes.select("id", role.alias("role")), g.visible("class"))


@register("j19_rich_context", sql("""SELECT n.id, n.qualified_name, n.docstring, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees, i.f AS first_caller FROM cn n
  LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS n, min(source) AS f FROM calls WHERE source IN (SELECT id FROM cn) GROUP BY 1) i ON i.id = n.id
  LEFT JOIN (SELECT source AS id, count(DISTINCT target) AS n FROM calls WHERE target IN (SELECT id FROM cn) GROUP BY 1) o ON o.id = n.id
  WHERE n.symbol_type = 'method'"""))
def _(g, spark, d):
    c = g.rich_context(g.nodes.where("symbol_type = 'method'"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return c.select("id", "qualified_name", "docstring", F.when(F.col("callers").isNull(), F.lit(0)).otherwise(n("callers")).cast("bigint").alias("n_callers"), F.when(F.col("callees").isNull(), F.lit(0)).otherwise(n("callees")).cast("bigint").alias("n_callees"), F.try_element_at("callers", F.lit(1)).alias("first_caller"))


@register("a1_stats", sql("""SELECT count(*) AS total_nodes, count(*) FILTER (is_dead) AS dead,
  count(*) FILTER (symbol_type = 'module') AS modules, count(*) FILTER (symbol_type = 'class') AS classes, count(*) FILTER (symbol_type = 'function') AS functions,
  count(*) FILTER (symbol_type = 'method') AS methods, count(*) FILTER (symbol_type = 'variable') AS variables, count(*) FILTER (symbol_type = 'parameter') AS parameters,
  (SELECT count(*) FROM ge) AS total_edges, (SELECT count(*) FROM ge WHERE edge_type = 'calls' AND target NOT IN (SELECT id FROM cn)) AS external_calls FROM cn"""))
def _(g, spark, d):
    return g.stats()


@register("a3_type_histogram", sql("SELECT symbol_type, count(*) AS n FROM cn GROUP BY 1"))
def _(g, spark, d):
    return g.nodes.groupBy("symbol_type").agg(F.count("*").alias("n"))


@register("a4_top_modules", sql("SELECT DISTINCT split_part(qualified_name, '.', 1) AS top FROM cn WHERE contains(lower(qualified_name), 'flush')"))
def _(g, spark, d):
    return g.search("flush").select(F.substring_index("qualified_name", ".", 1).alias("top")).distinct()


@register("a6_flow_resolution", sql("""SELECT count(*) AS n_flow, count(*) FILTER (target IN (SELECT id FROM cn)) AS n_resolved, count(*) FILTER (target IN (SELECT id FROM cn)) / count(*) AS share
  FROM ge WHERE edge_type IN ('reads', 'writes')"""))
def _(g, spark, d):
    return g.flow_resolution()


@register("a7_external_roots", sql("SELECT split_part(target, '.', 1) AS root, count(*) AS n_calls FROM ge WHERE edge_type = 'calls' AND target NOT IN (SELECT id FROM cn) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(g, spark, d):
    return g.external_roots(10)


@register("a8_most_coupled", sql("SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ge UNION ALL SELECT target FROM ge) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(g, spark, d):
    return g.most_coupled(20)


@register("a9_links_out", sql("""SELECT CASE WHEN contains(target, '.') THEN split_part(target, '.', 1) || '.' || split_part(target, '.', 2) ELSE target END AS target_module, count(*) AS n_edges FROM (
  SELECT e.target, coalesce(n.qualified_name, e.target) AS tn, e.source FROM ge e LEFT JOIN cn n ON n.id = e.target WHERE NOT e.is_proposed) x
  WHERE source IN (SELECT id FROM cn WHERE starts_with(qualified_name, (SELECT p FROM busy))) AND NOT starts_with(tn, (SELECT p FROM busy)) GROUP BY 1"""))
def _(g, spark, d):
    return g.links_out(busy(g))


@register("a12_class_profiles", sql("""SELECT parent AS class_id, count(*) AS n_methods, string_agg(name, ',' ORDER BY name, id) AS methods FROM (
  SELECT id, name, regexp_extract(id, '^(.*)[.][^.]*$', 1) AS parent FROM cn WHERE symbol_type = 'method') x WHERE parent IN (SELECT id FROM cn WHERE symbol_type = 'class') GROUP BY 1"""))
def _(g, spark, d):
    m = g.nodes.where("symbol_type = 'method'").select("id", "name", parent(F.col("id")).alias("class_id"))
    m = m.join(g.nodes.where("symbol_type = 'class'").select(F.col("id").alias("class_id")), "class_id", "left_semi")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]), ",")
    return m.groupBy("class_id").agg(F.count("*").alias("n_methods"), names.alias("methods"))


@register("a13_function_sets", sql("""SELECT source AS id, count(DISTINCT CASE WHEN edge_type = 'calls' THEN target END) AS n_callees, count(DISTINCT CASE WHEN edge_type = 'reads' THEN target END) AS n_reads,
  count(DISTINCT CASE WHEN edge_type = 'writes' THEN target END) AS n_writes FROM ge WHERE source IN (SELECT id FROM cn WHERE symbol_type IN ('function', 'method') AND NOT is_proposed) GROUP BY 1"""))
def _(g, spark, d):
    own = g.nodes_by_type("function", "method").select(F.col("id").alias("source"))
    own = g.edges.join(own, "source", "left_semi").groupBy(F.col("source").alias("id"))
    return own.agg(*[F.count_if(F.col("edge_type") == t).alias(n) for t, n in (("calls", "n_callees"), ("reads", "n_reads"), ("writes", "n_writes"))])


@register("a18_sidebar", sql("""SELECT symbol_type, nth, id, n FROM (SELECT symbol_type, id, row_number() OVER (PARTITION BY symbol_type ORDER BY qualified_name, id) AS nth, count(*) OVER (PARTITION BY symbol_type) AS n FROM cn) x WHERE nth <= 100"""))
def _(g, spark, d):
    return g.sidebar(100)


@register("s6_module_of_path", """SELECT file_id, CASE WHEN m = '' THEN '__root__' ELSE m END AS module_id FROM (
  SELECT file_id, replace(regexp_replace(path, '(^|/)__init__[.]py$|[.]py$', ''), '/', '.') AS m FROM source_files) x""")
def _(g, spark, d):
    return table(spark, d, "source_files").select("file_id", module_of_path(F.col("path")).alias("module_id"))


_SKIP = ", ".join(f"'{x}'" for x in SKIPPED)


@register("s2_pruned_sources", f"SELECT file_id, path FROM source_files WHERE NOT list_has_any(string_split(path, '/'), [{_SKIP}])")
def _(g, spark, d):
    """Sources outside skipped folders."""
    skip = F.array(*[F.lit(x) for x in SKIPPED])
    return table(spark, d, "source_files").where(~F.arrays_overlap(F.split("path", "/"), skip)).select("file_id", "path")


@register("s21_source_hash", "SELECT fp_id, substr(sha256(source_snippet), 1, 16) AS source_hash FROM fingerprints WHERE source_snippet IS NOT NULL")
def _(g, spark, d):
    return table(spark, d, "fingerprints").where("source_snippet is not null").select("fp_id", F.substring(F.sha2("source_snippet", 256), 1, 16).alias("source_hash"))


_LASTFILE = "lf AS (SELECT * FROM source_files WHERE file_id IN (SELECT arg_max(file_id, (mtime, file_id)) FROM source_files GROUP BY path) AND content IS NOT NULL)"


@register("s9_snippets", sql("""SELECT n.id, array_to_string(string_split(replace(f.content, chr(13) || chr(10), chr(10)), chr(10))[n.line_start:n.line_end], chr(10)) AS snippet
  FROM cn n JOIN lf f ON f.path = n.file_path WHERE n.symbol_type IN ('function', 'method') AND NOT n.is_proposed AND n.line_start >= 1 AND n.line_end >= n.line_start""", _LASTFILE))
def _(g, spark, d):
    return snippets(g.nodes_by_type("function", "method"), latest_files(table(spark, d, "source_files")))


@register("p_overlay", sql("""SELECT id, symbol_type, true AS is_proposed FROM (VALUES ('corelib.trace.audit_all', 'function')) t(id, symbol_type)
  UNION ALL SELECT id, symbol_type, is_proposed FROM cn WHERE id IN (SELECT id FROM mid)"""))
def _(g, spark, d):
    m = middle(g)
    over = proposal(g, "audit_all", "corelib.trace", calls=[m])
    ends = over.edges.where(F.col("source") == "corelib.trace.audit_all").select(F.explode(F.array("source", "target")).alias("id"))
    return over.nodes.join(ends, "id", "left_semi").select("id", "symbol_type", "is_proposed")


@register("e6_common_prefix", sql("""SELECT source, target, len(list_filter(generate_series(1, least(len(string_split(source, '.')), len(string_split(target, '.')))),
  lambda k: string_split(source, '.')[1:k] = string_split(target, '.')[1:k])) AS shared FROM ge WHERE edge_type = 'calls'"""))
def _(g, spark, d):
    return g.edges.where("edge_type = 'calls'").select("source", "target", common_parts(F.col("source"), F.col("target")).alias("shared"))


@register("e1_short_names", sql("SELECT id, string_split(id, '.')[-1] AS last, regexp_extract(id, '^(.*)[.][^.]*$', 1) AS parent, len(string_split(id, '.')) - 1 AS dots FROM cn"))
def _(g, spark, d):
    return g.nodes.select("id", last_part(F.col("id")).alias("last"), parent(F.col("id")).alias("parent"), (F.size(F.split("id", r"\.")) - 1).alias("dots"))


@register("y1_ask_callers", sql(f"SELECT {NODE} FROM cn WHERE id IN (SELECT source FROM calls WHERE target IN (SELECT id FROM hub))"))
def _(g, spark, d):
    return shown(ask(g, f"Callers of {hub(g)}"))


@register("y1_ask_dead_methods", sql(f"SELECT {NODE} FROM cn WHERE is_dead AND symbol_type IN ('function', 'method') AND starts_with(qualified_name, (SELECT p FROM busy))"))
def _(g, spark, d):
    return shown(ask(g, f"dead functions in {busy(g)}"))


@register("y1_ask_classes_in_scope", sql(f"SELECT {NODE} FROM cn WHERE symbol_type = 'class' AND starts_with(qualified_name, (SELECT p FROM busy))"))
def _(g, spark, d):
    return shown(ask(g, f"classes in {busy(g)}"))


@register("y2_banner", sql("SELECT symbol_type, count(*) AS n FROM cn WHERE contains(lower(qualified_name), 'flush') GROUP BY 1"))
def _(g, spark, d):
    return banner(ask(g, "flush"))


@register("j12_known_imports", sql("""SELECT source, target FROM ge WHERE edge_type = 'imports' AND (target IN (SELECT id FROM cn) OR EXISTS (SELECT 1 FROM cn WHERE starts_with(cn.id, ge.target || '.')))"""))
def _(g, spark, d):
    heads = g.nodes.select(F.explode(prefixes(F.col("id"))).alias("target")).distinct()
    return g.edges_of_types("imports").join(heads, "target", "left_semi").select("source", "target")


@register("f15_slim_fingerprints", "SELECT fp_id, node_id, name, symbol_type, arg_count, line_count, max_nesting_depth, has_loops, coalesce(len(callees), 0) AS n_callees FROM fingerprints")
def _(g, spark, d):
    fp = table(spark, d, "fingerprints").drop("ast_tree", "minhash", "ast_node_counts", "source_snippet")
    n = F.when(F.col("callees").isNull(), F.lit(0)).otherwise(F.size("callees")).cast("bigint")
    return fp.select("fp_id", "node_id", "name", "symbol_type", "arg_count", "line_count", "max_nesting_depth", "has_loops", n.alias("n_callees"))


@register("e12_call_read_overlap", """SELECT fp_id, round(len(list_intersect(c, r)) / nullif(len(list_distinct(list_concat(c, r))), 0), 9) AS overlap FROM (
  SELECT fp_id, list_distinct(list_filter(coalesce(reads, []), lambda v: v IS NOT NULL)) AS c, list_distinct(list_filter(coalesce(writes, []), lambda v: v IS NOT NULL)) AS r FROM fingerprints) x""")
def _(g, spark, d):
    return table(spark, d, "fingerprints").select("fp_id", F.round(jaccard(F.col("reads"), F.col("writes")), 9).alias("overlap"))


@register("u3_raw_only_edges", """SELECT DISTINCT source, target FROM (SELECT trim(source, chr(32) || chr(9)) AS source, trim(target, chr(32) || chr(9)) AS target FROM edges) e
  WHERE source <> '' AND target <> '' AND source NOT IN (SELECT id FROM nodes WHERE deleted_at IS NULL) AND source NOT IN (SELECT id FROM shared_nodes WHERE deleted_at IS NULL)""")
def _(g, spark, d):
    return current_edges(spark, d).join(current_nodes(spark, d).select(F.col("id").alias("source")), "source", "left_anti").select("source", "target").distinct()


@register("f5_edges_from_middle", sql("SELECT source, target, edge_type, line FROM ge WHERE source IN (SELECT id FROM mid)"))
def _(g, spark, d):
    return g.edges_from(middle(g)).select("source", "target", "edge_type", "line")


@register("f17_focus", sql("""SELECT CASE WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS status, id FROM (SELECT id, count(*) OVER () AS n FROM cn WHERE contains(lower(qualified_name), 'flush')) x ORDER BY id LIMIT 10"""))
def _(g, spark, d):
    return g.focus("flush")


@register("y4_context", sql("""SELECT 'what' AS part, symbol_type AS value, count(*) AS n FROM cn WHERE contains(lower(qualified_name), 'flush') GROUP BY 2
  UNION ALL SELECT 'why', 'flush', count(*) FROM cn WHERE contains(lower(qualified_name), 'flush') UNION ALL SELECT 'where', split_part(qualified_name, '.', 1), count(*) FROM cn WHERE contains(lower(qualified_name), 'flush') GROUP BY 2"""))
def _(g, spark, d):
    return context(ask(g, "flush"), "flush")


@register("a9_link_members", sql("""SELECT DISTINCT CASE WHEN contains(target, '.') THEN split_part(target, '.', 1) || '.' || split_part(target, '.', 2) ELSE target END AS target_module, source, target, edge_type FROM (
  SELECT e.target, e.edge_type, coalesce(n.qualified_name, e.target) AS tn, e.source FROM ge e LEFT JOIN cn n ON n.id = e.target WHERE NOT e.is_proposed) x
  WHERE source IN (SELECT id FROM cn WHERE starts_with(qualified_name, (SELECT p FROM busy))) AND NOT starts_with(tn, (SELECT p FROM busy))"""))
def _(g, spark, d):
    """The members of the groups of a9_links_out, a row each, so that no group is held as one list."""
    return g.edges_between(busy(g)).select(F.substring_index("target", ".", 2).alias("target_module"), "source", "target", "edge_type").distinct()


@register("a12_class_unions", sql("""SELECT DISTINCT regexp_extract(m.id, '^(.*)[.][^.]*$', 1) AS class_id, x.kind, string_split(x.other, '.')[-1] AS name FROM (
    SELECT source AS id, 'callee' AS kind, target AS other FROM calls UNION SELECT target, 'caller', source FROM calls) x JOIN cn m ON m.id = x.id AND m.symbol_type = 'method'
  WHERE regexp_extract(m.id, '^(.*)[.][^.]*$', 1) IN (SELECT id FROM cn WHERE symbol_type = 'class')"""))
def _(g, spark, d):
    """Short names that the methods of a class call and are called by."""
    c = g.edges_of_types("calls")
    ends = c.select(F.col("source").alias("id"), F.lit("callee").alias("kind"), F.col("target").alias("other")).union(c.select("target", F.lit("caller"), "source"))
    m = g.nodes.where("symbol_type = 'method'").select("id", parent(F.col("id")).alias("class_id"))
    m = m.join(g.nodes.where("symbol_type = 'class'").select(F.col("id").alias("class_id")), "class_id", "left_semi")
    return ends.join(m, "id").select("class_id", "kind", last_part(F.col("other")).alias("name")).distinct()


@register("a13_function_members", sql("""SELECT DISTINCT source AS id, edge_type, target FROM ge WHERE edge_type IN ('calls', 'reads', 'writes') AND source IN (SELECT id FROM cn WHERE symbol_type IN ('function', 'method') AND NOT is_proposed)"""))
def _(g, spark, d):
    own = g.nodes_by_type("function", "method").select(F.col("id").alias("source"))
    return g.edges_of_types("calls", "reads", "writes").join(own, "source", "left_semi").select(F.col("source").alias("id"), "edge_type", "target").distinct()


@register("j13_edges_of_known_ends", sql("SELECT source, target, edge_type FROM ge WHERE target IN (SELECT id FROM cn)"))
def _(g, spark, d):
    """What an update of single files keeps: edges of which both ends are known."""
    return g.edges.join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "edge_type")


@register("j19_context_members", sql("""SELECT n.id, x.kind, x.other, substr(n.docstring, 1, 200) AS doc, n.line_start || '-' || n.line_end AS lines FROM cn n JOIN (
    SELECT target AS id, 'caller' AS kind, source AS other FROM calls WHERE source IN (SELECT id FROM cn) UNION SELECT source, 'callee', target FROM calls WHERE target IN (SELECT id FROM cn)) x ON x.id = n.id WHERE n.symbol_type = 'method'"""))
def _(g, spark, d):
    """Callers and callees of every method, a row each, with the start of its documentation and its lines."""
    c = g.edges_of_types("calls").select("source", "target")
    known = g.nodes.select("id")
    into = c.join(known.toDF("source"), "source", "left_semi").select(F.col("target").alias("id"), F.lit("caller").alias("kind"), F.col("source").alias("other"))
    out = c.join(known.toDF("target"), "target", "left_semi").select(F.col("source").alias("id"), F.lit("callee").alias("kind"), F.col("target").alias("other"))
    n = g.nodes.where("symbol_type = 'method'").select("id", F.substring("docstring", 1, 200).alias("doc"), F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("lines"))
    return n.join(into.unionByName(out).distinct(), "id").select("id", "kind", "other", "doc", "lines")


@register("e16_json_rows", sql("""SELECT id, '{"id":"' || id || '","symbol_type":"' || symbol_type || '"}' AS j FROM cn WHERE symbol_type = 'class'"""))
def _(g, spark, d):
    return g.nodes.where("symbol_type = 'class'").select("id", F.to_json(F.struct("id", "symbol_type")).alias("j"))
