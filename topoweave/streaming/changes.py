"""Incremental maintenance: file changes and events as streams, snapshots and their differences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.plans.tables import drop, keep, shared_dir
from topoweave.sources.pysource import parse_files


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A stored table, one file or a folder of files, as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path) if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_MANIFEST = "bucket int, version bigint"


class Versions:
    """A keyed state table in a folder, from which a restarted driver goes on.

    Rows lie in a fixed number of buckets by their key.  A batch writes the buckets it touches as a new version and
    then a manifest of which version holds which bucket; the last complete manifest is the state.  A batch that is
    repeated after a failure writes the same version again, or nothing where its manifest is there already.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.folder = (folder or f"{shared_dir(spark)}/state-{uuid.uuid4().hex}").rstrip("/")
        done = [int(str(s.getPath().getParent().getName()).partition("=")[2]) for s in self._found(f"{self.folder}/manifest/v=*/_SUCCESS")]
        self.version, self.where, self.replaced = max(done, default=-1), {}, []
        if done:
            rows = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v={self.version}").collect()  # a row per bucket
            self.where = {r["bucket"]: r["version"] for r in rows}

    def _found(self, pattern: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return list(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or [])

    def rows(self, schema, buckets=None) -> DataFrame:
        """The state, or what some buckets hold of it."""
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(self.where.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, key: str | list[str], order: list[str], version: int | None = None) -> None:
        """Keep per key the row of greatest ``order``, of the state and the batch together."""
        version = self.version + 1 if version is None else version
        if version <= self.version:
            return
        keys, columns = [key] if isinstance(key, str) else key, batch.columns
        new, path = keep(batch, "batch")
        touched = self._buckets(new, keys)
        rows = self.rows(batch.schema, touched).select(*columns).unionByName(new)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")
        self._write(best.select(*columns), keys, touched, version)
        drop(self.spark, path)

    def get(self, keys: DataFrame, schema) -> DataFrame:
        """The rows of some keys (the columns of ``keys``, without nulls); only their buckets are read."""
        return self.rows(schema, self._buckets(keys, keys.columns)).join(keys.distinct(), keys.columns, "left_semi")

    def delete(self, keys: DataFrame, schema) -> None:
        """Take out the rows of some keys (the columns of ``keys``, without nulls), rewriting only their buckets."""
        gone, path = keep(keys.distinct(), "gone")
        touched = self._buckets(gone, keys.columns) & set(self.where)
        self._write(self.rows(schema, touched).join(gone, keys.columns, "left_anti"), keys.columns, touched, self.version + 1)
        drop(self.spark, path)

    def clear(self) -> None:
        """Take out all rows."""
        self._publish({}, self.version + 1)

    def count(self, schema) -> int:
        return self.rows(schema).count()

    def _bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame, keys: list[str]) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket(keys).alias("b")).distinct().collect()}  # at most ``buckets`` rows

    def _write(self, rows: DataFrame, keys: list[str], touched: set[int], version: int) -> None:
        """``rows`` become all that the touched buckets hold."""
        data = f"{self.folder}/data/v={version}"
        rows.withColumn("bucket", self._bucket(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        held = {int(str(f.getPath().getName()).partition("=")[2]) for f in self._found(f"{data}/bucket=*")}  # an emptied bucket has no folder
        self._publish({b: v for b, v in self.where.items() if b not in touched} | dict.fromkeys(held, version), version)

    def _publish(self, where: dict[int, int], version: int) -> None:
        manifest = self.spark.createDataFrame(sorted(where.items()), _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")
        for p in self.replaced:
            drop(self.spark, p)
        # What this version replaced goes with the next one, when nothing reads it any more.
        self.replaced = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in self.where.items() if where.get(b) != v]
        self.version, self.where = version, where


def latest_by_stream(stream: DataFrame, key: str | list[str], order: list[str], mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream of changes to its end; the latest row of each key.

    Given the ``folder`` of an earlier run, which holds its state and how far it came, goes on from there.
    """
    spark = stream.sparkSession
    versions = Versions(spark, folder)
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: versions.upsert(b, key, order, i))
        .option("checkpointLocation", f"{versions.folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return versions.rows(stream.schema)


def windowed_counts(events: DataFrame, time: str, width: str, late: str | None, *by: str) -> DataFrame:
    """Counts per tumbling window of event time, rows of a stream later than ``late`` being left out; works on streams and tables."""
    t = events.withColumn("_t", F.col(time).cast("timestamp"))
    t = t.withWatermark("_t", late) if events.isStreaming and late is not None else t
    return t.groupBy(F.window("_t", width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n")


def counts_by_stream(stream: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    """Run a stream of events to its end; the counts of :func:`windowed_counts`, no row being too late and no window left open.

    A window's count only grows, so of its updates the greatest is the last.
    """
    return latest_by_stream(windowed_counts(stream, time, width, None, *by), ["start", *by], ["n"], "update")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def as_of(nodes: DataFrame, when: str) -> DataFrame:
    """Per id the latest row that exists at a time."""
    t = F.lit(when).cast("timestamp_ntz")
    there = nodes.where((F.col("observed_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)))
    return there.groupBy("id").agg(F.max_by(F.struct("name", "symbol_type", "line_start", "line_end", "is_dead"), F.struct("observed_at", "seq")).alias("r")).select("id", "r.*")


def edges_as_of(edges: DataFrame, nodes: DataFrame, when: str) -> DataFrame:
    """(source, target, edge_type) of the relationships observed until a time between named ends, whose source exists then (``nodes``)."""
    end = lambda c: F.btrim(c, F.lit(" \t")).alias(c)
    e = edges.where(F.col("observed_at") <= F.lit(when).cast("timestamp_ntz")).select(end("source"), end("target"), F.lower("edge_type").alias("edge_type"))
    e = e.where("source != '' and target != '' and edge_type is not null").distinct()
    return e.join(nodes.select(F.col("id").alias("source")), "source", "left_semi")


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change, ..): added, removed and updated nodes between two snapshots of equal columns, with their new values (null if removed)."""
    values = [c for c in new.columns if c != "id"]
    row = lambda df, n: df.select("id", F.struct(*values).alias(n))
    x = row(old, "o").join(row(new, "n"), "id", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "updated")
    return x.select("id", change.alias("change"), "n.*").where("change is not null")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, edge_type, change): edges added and removed."""
    key = ["source", "target", "edge_type"]
    come = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return come.unionByName(old.join(new, key, "left_anti").withColumn("change", F.lit("removed"))).select(*key, "change")


def apply_node_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The new snapshot from the old one and a delta alone."""
    return old.join(delta.select("id"), "id", "left_anti").unionByName(delta.where("change != 'removed'").select(*old.columns))


def apply_edge_delta(old: DataFrame, delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """The new edges from the old ones and a delta alone; edges whose source is not among ``nodes`` go with it."""
    key = ["source", "target", "edge_type"]
    rest = old.join(delta.where("change = 'removed'"), key, "left_anti").unionByName(delta.where("change = 'added'").select(*key))
    return rest.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select(*key)


def refresh(nodes: DataFrame, edges: DataFrame, nodes_changed: DataFrame, edges_changed: DataFrame, share: float = 0.6) -> DataFrame:
    """One row (n_old, n_changed, whole): whether so much of a snapshot changed that all of it is cheaper than its delta."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    x = count(nodes, "a").crossJoin(count(edges, "b")).crossJoin(count(nodes_changed, "c")).crossJoin(count(edges_changed, "d"))  # one row each
    x = x.select((F.col("a") + F.col("b")).alias("n_old"), (F.col("c") + F.col("d")).alias("n_changed"))
    return x.withColumn("whole", F.col("n_changed") > share * F.greatest("n_old", F.lit(1)))


def remove_module(nodes: DataFrame, edges: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """Graph without a module, what lies below it, and all edges that touch either."""
    inside = lambda c: (F.col(c) == module) | F.col(c).startswith(module + ".")
    return nodes.where(~inside("id")), edges.where(~inside("source") & ~inside("target"))


def replace_files(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of symbols, relationships and facts (see :mod:`topoweave.sources.pysource`) after changes of files.

    ``changes``: (path, module, content, ..), null content for a deleted file; only these files are parsed.  Rows go
    by their file, not by a prefix of their names, so a package's own file takes none of its modules with it.  As
    rows hold names as they are written, resolving them anew gives what a rebuild of all files gives: relationships
    into a changed file from others find its new symbols again.
    """
    gone = changes.select(F.col("path").alias("file_path")).where("file_path is not null").distinct()
    return rows.join(gone, "file_path", "left_anti").unionByName(parse_files(changes.where("content is not null")))
