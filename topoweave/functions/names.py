"""Column functions on dotted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(c: Column) -> Column:
    return F.split(c, r"\.")


def last_part(c: Column) -> Column:
    return F.element_at(parts(c), -1)


def parent(c: Column) -> Column:
    """All but the last part; empty if there is only one."""
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


def prefixes(c: Column) -> Column:
    """Every dotted prefix, the whole name included."""
    p = parts(c)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "."))


def suffixes(c: Column) -> Column:
    """Every dotted suffix, the whole name included."""
    p = parts(c)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))


def common_parts(a: Column, b: Column) -> Column:
    """Number of leading parts that two names share."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def module_of_path(path: Column) -> Column:
    """Dotted module of a source path: a package for its __init__, __root__ for none."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"(^|/)__init__\.py$|\.py$", ""), "/", ".")
    return F.when(dotted == "", "__root__").otherwise(dotted)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; null if both are empty."""
    a, b = (F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull()) for x in (a, b))
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
