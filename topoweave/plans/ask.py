"""The short query language of the command surface, as a table of phrases.

Each phrase maps to an operator of the graph; the first that matches wins, so
any text with ``dead`` in it asks for dead symbols, and what matches nothing is
a search by name.  Results are DataFrames without any limit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.operators.graph import SHOWN, PropertyGraph

_LISTS = {
    "modules": ("module",), "classes": ("class",), "functions": ("function", "method"), "methods": ("function", "method"),
    "parameters": ("parameter",), "variables": ("variable",),
}


def _resolved(g: PropertyGraph, name: str, then) -> DataFrame:
    hit = g.resolve(name.strip()).select("id").first()
    return then(hit["id"]) if hit else g.nodes.limit(0)


def _listed(g: PropertyGraph, kind: str, scope: str | None) -> DataFrame:
    n = g.nodes.where(F.col("symbol_type").isin(*_LISTS[kind.lower()]))
    return n.where(F.col("qualified_name").startswith(scope.strip())) if scope else n


def _dead(g: PropertyGraph, text: str) -> DataFrame:
    kinds = next((t for k, t in _LISTS.items() if k in text.lower()), ())
    scope = re.search(r"\bin\s+(\S+)", text)
    return g.dead(*kinds, scope=scope[1] if scope else "")


PHRASES = [
    (r"callers of\s+(.+)", lambda g, m: _resolved(g, m[1], g.callers_of)),
    (r"callees of\s+(.+)", lambda g, m: _resolved(g, m[1], g.callees_of)),
    (r"(?:parameters|params) of\s+(.+)", lambda g, m: _resolved(g, m[1], g.parameters_of)),
    (r"returns of\s+(.+)", lambda g, m: _resolved(g, m[1], g.returns_of)),
    (r"external calls(?:\s+(?:in|of)\s+(\S+))?", lambda g, m: g.external_calls(m[1] or "")),
    (r"(.*(?:dead|uncalled).*)", lambda g, m: _dead(g, m[1])),
    (r"imports of\s+(.+)", lambda g, m: _resolved(g, m[1], g.imports_of)),
    (r"(modules|classes|functions|methods|parameters|variables)(?:\s+in\s+(\S+))?", lambda g, m: _listed(g, m[1], m[2])),
    (r"(.+)", lambda g, m: g.search(m[1].strip())),
]


def ask(g: PropertyGraph, text: str) -> DataFrame:
    for pattern, plan in PHRASES:
        m = re.fullmatch(pattern, text.strip(), re.IGNORECASE | re.DOTALL)
        if m:
            return plan(g, m)
    return g.nodes.limit(0)


def banner(result: DataFrame) -> DataFrame:
    """Symbol types of a result and their counts."""
    return result.groupBy("symbol_type").agg(F.count("*").alias("n"))


def context(result: DataFrame, text: str) -> DataFrame:
    """(part, value, n): what a result holds, why (the words asked) and where (its top modules)."""
    what = result.groupBy(F.col("symbol_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("what").alias("part"), "value", "n")
    where = result.groupBy(F.substring_index("qualified_name", ".", 1).alias("value")).agg(F.count("*").alias("n")).select(F.lit("where").alias("part"), "value", "n")
    why = result.agg(F.count("*").alias("n")).select(F.lit("why").alias("part"), F.lit(text).alias("value"), "n")
    return what.unionByName(why).unionByName(where)


def shown(result: DataFrame) -> DataFrame:
    return result.select(*[c for c in SHOWN if c in result.columns] or result.columns)
