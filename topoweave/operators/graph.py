"""Relational operators on the property graph: lookups, predicates, joins, counts.

A graph is two DataFrames.  Every method returns a DataFrame and runs nothing;
filters and columns reach the scans by themselves.  Vertices outside the nodes
(libraries, builtins) exist as edge ends only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoweave.functions.names import prefixes, suffixes
from topoweave.plans.tables import keep
from topoweave.schema import EDGE_TYPES, ZOOM

SHOWN = ["id", "name", "qualified_name", "symbol_type"]


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    # -- lookups and predicates ------------------------------------------------

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def all_nodes(self, include_proposed: bool = True) -> DataFrame:
        return self.nodes if include_proposed else self.nodes.where(~F.col("is_proposed"))

    def nodes_by_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("symbol_type").isin(*types) & ~F.col("is_proposed"))

    def edges_of_types(self, *types: str) -> DataFrame:
        """Edges of the valid types named; all edges if none is valid."""
        valid = [t for t in types if t in EDGE_TYPES]
        return self.edges.where(F.col("edge_type").isin(*valid)) if valid else self.edges

    def edges_from(self, node_id: str, *types: str) -> DataFrame:
        return self.edges_of_types(*types).where(F.col("source") == node_id)

    def edges_to(self, node_id: str, *types: str) -> DataFrame:
        return self.edges_of_types(*types).where(F.col("target") == node_id)

    def filtered(self, edge_type: str | None = None, symbol_type: str | None = None, min_depth: int | None = None, max_depth: int | None = None, name_pattern: str | None = None) -> PropertyGraph:
        """Nodes by type, dotted depth and case-insensitive pattern; edges of the type with both ends left."""
        n, depth = self.nodes, F.size(F.split("id", r"\.")) - 1
        if symbol_type:
            n = n.where(F.col("symbol_type") == symbol_type)
        if min_depth is not None:
            n = n.where(depth >= min_depth)
        if max_depth is not None:
            n = n.where(depth <= max_depth)
        if name_pattern:
            n = n.where(F.col("qualified_name").rlike(f"(?i){name_pattern}") | F.col("name").rlike(f"(?i){name_pattern}"))
        e = self.edges.where(F.col("edge_type") == edge_type) if edge_type else self.edges
        return PropertyGraph(n, induced(e, n.select("id")))

    def search(self, text: str) -> DataFrame:
        low = text.lower()
        return self.nodes.where(F.lower("qualified_name").contains(low) | F.lower("name").contains(low))

    def resolve(self, name: str) -> DataFrame:
        """The node of that id, else of the shortest qualified name that holds it, as one row."""
        hit = self.nodes.where((F.col("id") == name) | F.lower("qualified_name").contains(name.lower()))
        return hit.orderBy(F.col("id") != name, F.length("qualified_name"), "id").limit(1)

    def focus(self, name: str, most: int = 10) -> DataFrame:
        """(status, id): the node of that id, else the only one whose qualified name holds it, else up to ``most`` of several as ambiguous, else not found."""
        hit = self.nodes.where((F.col("id") == name) | F.lower("qualified_name").contains(name.lower())).select("id", (F.col("id") != name).alias("part"))
        first = hit.orderBy("part", "id").limit(most + 1)
        one = first.agg(F.count("*").alias("n"), F.count_if(~F.col("part")).alias("exact"))  # one row
        x = first.crossJoin(one).where("exact = 0 or not part").orderBy("part", "id").limit(most)
        found = x.select(F.when(F.col("exact") > 0, "exact").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), "id")
        return found.unionByName(one.where("n = 0").select(F.lit("not found").alias("status"), F.lit(None).cast("string").alias("id")))

    def snapshot(self, level: str = "function", show_dead: bool = True, show_proposed: bool = True, around: DataFrame | None = None, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a view: a zoom level, flags, only what ``around`` (id) names, and roles put on visible ancestors."""
        nodes, _ = keep(self.visible(level, show_dead, show_proposed, around), "snapshot-nodes")
        kept = self.edges
        if not show_dead:
            kept = kept.where("not is_dead")
        if not show_proposed:
            kept = kept.where("not is_proposed")
        edges = replace(self, edges=kept).rolled_up_edges(nodes)
        if roles is not None:
            nodes = nodes.join(self.rolled_up_roles(roles, nodes), "id", "left")
        return nodes, edges

    def visible(self, level: str = "function", show_dead: bool = True, show_proposed: bool = True, among: DataFrame | None = None) -> DataFrame:
        """Nodes of a zoom level; unknown levels show functions and methods."""
        n = self.nodes.where(F.col("symbol_type").isin(*ZOOM.get(level, ZOOM["function"])))
        if not show_dead:
            n = n.where(~F.col("is_dead"))
        if not show_proposed:
            n = n.where(~F.col("is_proposed"))
        return n.join(among.select("id"), "id", "left_semi") if among is not None else n

    def dead(self, *types: str, scope: str = "") -> DataFrame:
        n = self.nodes.where("is_dead")
        n = n.where(F.col("symbol_type").isin(*types)) if types else n
        return n.where(F.col("qualified_name").startswith(scope)) if scope else n

    def external_calls(self, scope: str = "") -> DataFrame:
        """Calls whose target is no node."""
        e = self.edges.where("edge_type = 'calls'")
        e = e.where(F.col("source").startswith(scope)) if scope else e
        return e.join(self.nodes.select(F.col("id").alias("target")), "target", "left_anti")

    # -- joins -------------------------------------------------------------------

    def _ends(self, edges: DataFrame, end: str) -> DataFrame:
        return self.nodes.join(edges.select(F.col(end).alias("id")), "id", "left_semi")

    def callers_of(self, node_id: str) -> DataFrame:
        return self._ends(self.edges_to(node_id, "calls"), "source")

    def callees_of(self, node_id: str) -> DataFrame:
        return self._ends(self.edges_from(node_id, "calls"), "target")

    def parameters_of(self, node_id: str) -> DataFrame:
        return self._ends(self.edges_from(node_id, "contains"), "target").where("symbol_type = 'parameter'")

    def returns_of(self, node_id: str) -> DataFrame:
        return self._ends(self.edges_from(node_id, "returns"), "target")

    def imports_of(self, node_id: str) -> DataFrame:
        return self.edges_from(node_id, "imports")

    def edges_between(self, source_scope: str, target_scope: str | None = None, *types: str) -> DataFrame:
        """Edges that leave one scope (for another); a scope is a plain prefix of qualified names."""
        e = self.edges_of_types(*types).where(~F.col("is_proposed"))
        inside = self.nodes.where(F.col("qualified_name").startswith(source_scope)).select(F.col("id").alias("source"))
        names = self.nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("target_name"))
        e = e.join(inside, "source", "left_semi").join(names, "target", "left").withColumn("target_name", F.coalesce("target_name", "target"))
        e = e.where(~F.col("target_name").startswith(source_scope))
        e = e.where(F.col("target_name").startswith(target_scope)) if target_scope else e
        return e.select("source", "target", "edge_type", "line")

    def coupling(self, a: str, b: str) -> DataFrame:
        """Edges other than containment between two scopes, in either direction."""
        s, t = F.col("source"), F.col("target")
        across = (s.startswith(a) & t.startswith(b)) | (s.startswith(b) & t.startswith(a))
        return self.edges.where(across & (F.col("edge_type") != "contains"))

    def rich_context(self, ids: DataFrame) -> DataFrame:
        """Nodes with their callers and callees as sorted lists."""
        calls = self.edges.where("edge_type = 'calls'").select("source", "target")
        n = self.nodes.join(ids.select("id"), "id", "left_semi")
        names = self.nodes.select("id")
        into = calls.join(ids.select(F.col("id").alias("target")), "target", "left_semi").join(names.toDF("source"), "source", "left_semi")
        out = calls.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(names.toDF("target"), "target", "left_semi")
        into = into.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("callers"))
        out = out.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("callees"))
        return n.join(into, "id", "left").join(out, "id", "left")

    # -- names -------------------------------------------------------------------

    def name_index(self) -> DataFrame:
        """(key, id): every dotted suffix of every id."""
        return self.nodes.select("id", F.explode(suffixes(F.col("id"))).alias("key")).distinct()

    def longest_known_prefix(self, names: DataFrame, column: str) -> DataFrame:
        """``names`` with ``known``, the longest dotted prefix of ``column`` that is a node."""
        tried = names.select(column).distinct().withColumn("id", F.explode(prefixes(F.col(column))))
        best = tried.join(self.nodes.select("id"), "id", "left_semi").groupBy(column).agg(F.max_by("id", F.length("id")).alias("known"))
        return names.join(best, column, "left")

    # -- counts ------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """Counts per symbol type, dead symbols, nodes, edges and external calls, in one row."""
        by = self.nodes.agg(
            F.count("*").alias("total_nodes"), F.count_if("is_dead").alias("dead"),
            *[F.count_if(F.col("symbol_type") == t).alias(k) for t, k in (("module", "modules"), ("class", "classes"), ("function", "functions"), ("method", "methods"), ("variable", "variables"), ("parameter", "parameters"))],
        )
        e = self.edges.agg(F.count("*").alias("total_edges"))
        return by.crossJoin(e).crossJoin(self.external_calls().agg(F.count("*").alias("external_calls")))  # one row each

    def external_roots(self, top: int = 10) -> DataFrame:
        return self.external_calls().groupBy(F.substring_index("target", ".", 1).alias("root")).agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "root").limit(top)

    def flow_resolution(self) -> DataFrame:
        """Share of reads and writes whose target is a node."""
        e = self.edges.where("edge_type in ('reads', 'writes')")
        known = e.join(self.nodes.select(F.col("id").alias("target"), F.lit(1).alias("hit")), "target", "left")
        return known.agg(F.count("*").alias("n_flow"), F.count("hit").alias("n_resolved"), (F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("share"))

    def degrees(self) -> DataFrame:
        """Edges in and out of every vertex, parallel types counted each."""
        return self.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

    def most_coupled(self, top: int = 20) -> DataFrame:
        return self.degrees().orderBy(F.desc("degree"), "id").limit(top)

    def links_out(self, scope: str) -> DataFrame:
        """Edges that leave a scope by the first two parts of their target."""
        group = F.substring_index("target", ".", 2)
        return self.edges_between(scope).groupBy(group.alias("target_module")).agg(F.count("*").alias("n_edges"))

    def sidebar(self, per_type: int = 100) -> DataFrame:
        """The first names of every symbol type with the type's size."""
        by = Window.partitionBy("symbol_type").orderBy("qualified_name", "id")
        first = self.nodes.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_type)
        sizes = self.nodes.groupBy("symbol_type").agg(F.count("*").alias("n"))
        return first.join(sizes, "symbol_type").select("symbol_type", "nth", "id", "n")

    # -- views -------------------------------------------------------------------

    def nearest_visible(self, ids: DataFrame, visible: DataFrame, column: str = "id") -> DataFrame:
        """(column, shown): the nearest ancestor of each id (or itself) among the visible ones."""
        tried = ids.select(column).distinct().withColumn("shown", F.explode(prefixes(F.col(column))))
        hit = tried.join(visible.select(F.col("id").alias("shown")), "shown", "left_semi")
        return hit.groupBy(column).agg(F.max_by("shown", F.length("shown")).alias("shown"))

    def rolled_up_edges(self, visible: DataFrame, *types: str) -> DataFrame:
        """Edges between visible ancestors of their ends; containment only between nodes visible themselves."""
        e = self.edges_of_types(*types)
        v = visible.select("id")
        inner = induced(e.where("edge_type = 'contains'"), v).select("source", "target", "edge_type")
        up = e.where("edge_type != 'contains'").select("source", "target", "edge_type")
        ends = up.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        shown, _ = keep(self.nearest_visible(ends, v), "nearest-visible")
        up = up.join(shown.toDF("source", "s"), "source").join(shown.toDF("target", "t"), "target").where("s != t")
        return up.select(F.col("s").alias("source"), F.col("t").alias("target"), "edge_type").distinct().unionByName(inner.distinct())

    def rolled_up_roles(self, roles: DataFrame, visible: DataFrame) -> DataFrame:
        """(id, role): roles on visible ancestors, the first of origin, mutator, passthrough, destination winning."""
        order = F.array_position(F.array(*[F.lit(r) for r in ("origin", "mutator", "passthrough", "destination")]), F.col("role"))
        shown = self.nearest_visible(roles.select("id"), visible)
        return roles.join(shown, "id").groupBy(F.col("shown").alias("id")).agg(F.min_by("role", order).alias("role"))

    def rolled_up_edge_roles(self, roles: DataFrame, visible: DataFrame) -> DataFrame:
        """(source, target, role) between visible ancestors of the ends; write before read before flow."""
        ends = roles.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        shown, _ = keep(self.nearest_visible(ends, visible), "nearest-visible")
        up = roles.join(shown.toDF("source", "s"), "source").join(shown.toDF("target", "t"), "target").where("s != t")
        order = F.array_position(F.array(F.lit("write"), F.lit("read"), F.lit("flow")), F.col("role"))
        return up.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.min_by("role", order).alias("role"))

    def with_overlay(self, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """The graph with proposed nodes and edges; the stored graph is left as it is."""
        return replace(self, nodes=self.nodes.unionByName(nodes), edges=self.edges.unionByName(edges))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def proposal(graph: PropertyGraph, name: str, module: str, calls: list[str] = (), called_by: list[str] = (), signature: str | None = None) -> PropertyGraph:
    """The graph with a proposed function and its proposed calls."""
    spark = graph.nodes.sparkSession
    own = f"{module}.{name}"
    n = spark.createDataFrame([(own, name, own, "function", signature)], "id string, name string, qualified_name string, symbol_type string, signature string")
    n = n.select(*[F.col(c) if c in n.columns else F.lit(c == "is_proposed") if c in ("is_dead", "is_proposed") else F.lit(None).cast(graph.nodes.schema[c].dataType).alias(c) for c in graph.nodes.columns]).toDF(*graph.nodes.columns)
    e = spark.createDataFrame([(own, c) for c in calls] + [(c, own) for c in called_by], "source string, target string").withColumn("edge_type", F.lit("calls"))
    e = e.select(*[F.col(c) if c in e.columns else F.lit(c == "is_proposed") if c in ("is_dead", "is_proposed") else F.lit(None).cast(graph.edges.schema[c].dataType).alias(c) for c in graph.edges.columns]).toDF(*graph.edges.columns)
    return graph.with_overlay(n, e)
