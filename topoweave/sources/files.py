"""Source files: reading a project folder, current versions, and texts by line range."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topoweave.functions.names import module_of_path

#: Folders whose files are no sources of a project (fixed values).
SKIPPED = [".venv", "venv", "env", ".env", "node_modules", ".git", "__pycache__", ".tox", ".nox", ".eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", "build", "dist", ".build"]


def read_project(spark: SparkSession, root: str) -> DataFrame:
    """path, module, content, content_hash, mtime of the .py files below a folder, skipped folders left out by their path below it.

    Paths are listed once, texts are read by the tasks (Spark's own file sources pass over names that begin
    with an underscore, and so over every package's own file).  Bytes that are no UTF-8 are replaced.
    """
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    found = []
    for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        rel = f.path[len(base.rstrip("/")) + 1 :]
        if f.type == pafs.FileType.File and rel.endswith(".py") and not set(rel.split("/")) & set(SKIPPED):
            found.append((rel, f.mtime.replace(tzinfo=None) if f.mtime else None))
    paths = spark.createDataFrame(found, "path string, mtime timestamp_ntz").repartition(max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base.rstrip('/')}/{row['path']}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pylist([row | {"content": text}], pa.schema([*batch.schema, ("content", pa.string())]))

    rows = paths.mapInArrow(read, "path string, mtime timestamp_ntz, content string")
    return rows.select("path", module_of_path(F.col("path")).alias("module"), "content", source_hash(F.col("content")).alias("content_hash"), "mtime")


def source_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def latest_files(files: DataFrame) -> DataFrame:
    """The current version of each path: greatest (mtime, file_id); contents are joined by file, so that a path of many versions is no hot key."""
    last = files.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "file_id")).alias("m")).select("m.file_id")
    return files.join(last, "file_id", "left_semi")


def spread(files: DataFrame, key: str) -> DataFrame:
    """Files over as many partitions as there are tasks for them: parsing costs far more than the bytes that partitions are sized by."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def lines(content: Column) -> Column:
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, snippet): the lines of each node in its file."""
    f = files.where("content is not null").select(F.col("path").alias("file_path"), lines(F.col("content")).alias("ls"))
    n = nodes.where("line_start >= 1 and line_end >= line_start").select("id", "file_path", "line_start", "line_end")
    return n.join(f, "file_path").select("id", F.array_join(F.slice("ls", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n").alias("snippet"))


def comment_above(content: Column, line: Column) -> Column:
    """The unbroken # lines directly above a line (from 1), joined; null if there are none."""
    before = F.reverse(F.slice(lines(content), 1, F.greatest(line - 1, F.lit(0))))
    run = F.aggregate(
        before,
        F.struct(F.array().cast("array<string>").alias("got"), F.lit(True).alias("on")),
        lambda s, x: F.struct(F.when(s["on"] & F.ltrim(x).startswith("#"), F.concat(F.array(x), s["got"])).otherwise(s["got"]).alias("got"), (s["on"] & F.ltrim(x).startswith("#")).alias("on")),
        lambda s: s["got"],
    )
    return F.when(F.size(run) > 0, F.array_join(run, "\n"))
