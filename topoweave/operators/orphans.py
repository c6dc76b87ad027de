"""References to records that do not exist.

A reference is a value in a child row that should name a parent valid at the
child's time.  The keys are first made distinct per period (a hot key becomes
one row per period, combined before the shuffle) and anti-joined with the
parents' validity; only the few (key, period) groups not wholly covered are
joined back to the child rows, where each row is judged at its own time.  Child
rows are joined on (key, period), so that no key, however hot, meets one task;
on the key alone run only joins of what was reduced before: a row per key and
month, and the parents' disjoint spans of validity, made per key and day.

Defined results: null and blank keys are no references; surrounding blanks and
tabs are not part of a key.  A reference without a time is an orphan (nothing
is known to exist at an unknown time).  Parents without ``valid_from`` never
exist; ``valid_to`` null means still valid; empty intervals are ignored.
Repeated child rows are each reported; with no parents every reference is an
orphan, with no children the result is empty.  Only the columns named by the
caller are read, so further columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoweave.plans.tables import at_most, keep

#: A scope table of at most so many rows is broadcast; with a larger one the references are joined by shuffle.
SCOPE_BROADCAST_ROWS = 10_000

_FOREVER = "9999-12-31 00:00:00"
_NO_TIME = "0001-01-01 00:00:00"


def stripped(c: Column) -> Column:
    """``c`` without blanks and tabs around it."""
    return F.btrim(c, F.lit(" \t"))


def reference_rows(df: DataFrame, table: str, row_id: str, columns: list[str], observed_at: str) -> DataFrame:
    """One row per non-null foreign key: table, row_id, endpoint, key, observed_at."""
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("endpoint"), stripped(F.col(c)).alias("key")) for c in columns]))
    return (
        df.select(F.col(row_id).alias("row_id"), F.col(observed_at).cast("timestamp_ntz").alias("observed_at"), ends.alias("e"))
        .select(F.lit(table).alias("table"), "row_id", F.col("e.endpoint").alias("endpoint"), F.col("e.key").alias("key"), "observed_at")
        .where("key is not null and key != ''")
    )


def parent_rows(df: DataFrame, key: str, valid_from: str, valid_to: str | None) -> DataFrame:
    to = F.col(valid_to).cast("timestamp_ntz") if valid_to else F.lit(None).cast("timestamp_ntz")
    return df.select(F.col(key).alias("key"), F.col(valid_from).cast("timestamp_ntz").alias("valid_from"), to.alias("valid_to"))


def _coverage(parents: DataFrame) -> DataFrame:
    """Validity spans per key, disjoint among those that begin on one day."""
    p = (
        parents.where("key is not null and valid_from is not null")
        .withColumn("valid_to", F.coalesce("valid_to", F.lit(_FOREVER).cast("timestamp_ntz")))
        .where("valid_to > valid_from")
        .groupBy("key", "valid_from")
        .agg(F.max("valid_to").alias("valid_to"))
        .withColumn("day", F.to_date("valid_from"))
    )
    w = Window.partitionBy("key", "day").orderBy("valid_from")
    before = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("opens", (before.isNull() | (F.col("valid_from") > before)).cast("int"))
    p = p.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("key", "day", "island").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).select("key", "valid_from", "valid_to")


def with_period(refs: DataFrame) -> DataFrame:
    """References with the month of their time; those without a time share one period."""
    month = F.date_trunc("month", F.col("observed_at").cast("timestamp")).cast("timestamp_ntz")
    return refs.withColumn("period", F.coalesce(month, F.lit(_NO_TIME).cast("timestamp_ntz")))


def in_scope(refs: DataFrame, scope: DataFrame) -> DataFrame:
    """References whose first dotted part is a value of ``scope`` (one column, ``root``)."""
    roots = scope.where("root is not null").distinct()
    if at_most(roots, SCOPE_BROADCAST_ROWS):
        roots = F.broadcast(roots)
    return refs.withColumn("root", F.substring_index("key", ".", 1)).join(roots, "root", "left_semi").drop("root")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references (see :func:`reference_rows`) that name no parent valid at their time, with their period."""
    refs = with_period(refs)
    cover = _coverage(parents)
    groups = refs.groupBy("key", "period").agg(
        F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"), F.max(F.col("observed_at").isNull()).alias("untimed")
    )
    whole = (F.col("g.key") == F.col("c.key")) & (F.col("c.valid_from") <= F.col("g.lo")) & (F.col("c.valid_to") > F.col("g.hi")) & ~F.col("g.untimed")
    suspects, _ = keep(groups.alias("g").join(cover.alias("c"), whole, "left_anti"), "orphan-suspects")
    touching = (F.col("s.key") == F.col("c.key")) & (F.col("c.valid_from") <= F.col("s.hi")) & (F.col("c.valid_to") > F.col("s.lo"))
    spans = suspects.alias("s").join(cover.alias("c"), touching).select(F.col("s.key").alias("key"), "s.period", "c.valid_from", "c.valid_to")
    doubtful = refs.join(suspects.select("key", "period"), ["key", "period"], "left_semi")
    r, v = doubtful.alias("r"), spans.alias("v")
    valid = (
        (F.col("r.key") == F.col("v.key")) & (F.col("r.period") == F.col("v.period"))
        & (F.col("v.valid_from") <= F.col("r.observed_at")) & (F.col("v.valid_to") > F.col("r.observed_at"))
    )
    return r.join(v, valid, "left_anti").select("table", "row_id", "endpoint", "key", "observed_at", "period")


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table, endpoint and month: references, orphans among them, and distinct orphan keys."""
    by = ["table", "endpoint", "period"]
    total = with_period(refs).groupBy(*by).agg(F.count("*").alias("n_references"))
    # Distinct keys first: a hot orphan key is one row per group before the final count.
    lost = orphans.groupBy(*by, "key").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_orphan_keys"))
    return (
        total.join(lost, by, "left")
        .fillna(0, ["n_orphans", "n_orphan_keys"])
        .withColumn("period", F.when(F.col("period") > F.lit(_NO_TIME).cast("timestamp_ntz"), F.date_format("period", "yyyy-MM")))
    )


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
