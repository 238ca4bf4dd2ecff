"""Helpers shared by the corpus operators: staging, files, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlex.session import checkpoint_dir

# An Arrow batch sent to Python ends at this many rows or bytes, so that a batch
# of very long documents stays within a worker's memory.
ARROW_ROWS, ARROW_BYTES = 2048, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Limit the rows and bytes of one Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder.

    It is removed when the JVM that made it ends; results read from it are
    valid until then.
    """
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/corpus-{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return fs.makeQualified(hpath).toString()


def stage(df: DataFrame, folder: str, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below ``folder`` and read it back: cuts the lineage with
    files every executor can read, so that a lost executor costs a task only."""
    path = f"{folder}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)


# -- files written and read by tasks ---------------------------------------

def open_fs(uri: str):
    """(filesystem, path) of a URI, by pyarrow; a bare path is a local one."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts) -> str:
    """Write ``parts`` (bytes) under a name no other attempt uses and return
    the full URI.  A file counts only once its task's manifest row is kept,
    so files of failed or repeated attempts are never read."""
    final = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    fs, path = open_fs(final)
    with fs.open_output_stream(path) as out:
        for p in parts:
            out.write(p)
    return final


def join_counted(rows: DataFrame, side: DataFrame, key: str, total: int, share: int = 10_000) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and ``n``, how
    many of the ``total`` rows have it.

    Keys with more than one row in ``share`` are joined from a broadcast:
    there are fewer than ``share`` of them, whatever the input.  The rest is
    a shuffle join in which no key is hot.  ``n`` is dropped.
    """
    hot = F.broadcast(side.where(F.col("n") * share > total).drop("n"))
    cold = side.where(F.col("n") * share <= total).drop("n").hint("merge")
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(left)


# -- connected components ---------------------------------------------------

def connected_components(edges: DataFrame, folder: str, label: str,
                         max_rounds: int = 60) -> DataFrame:
    """Alternating large-star and small-star over ``edges(u, v)`` (long ids).

    Returns (node, root) for every node that has an edge; ``root`` is the
    smallest node of its component.  Each round is written to ``folder``;
    rounds end when the edges no longer change (count and checksum).
    Both steps only need the minimum of each neighbourhood, which is taken
    by a partial aggregate and joined back (``join_counted``), so no
    neighbourhood is gathered and no hot node lands in one task.
    """
    spark = edges.sparkSession

    def large_star(e: DataFrame, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return (join_counted(both, m, "u", 2 * n).where(F.col("v") > F.col("u"))
                .select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct())

    def small_star(e: DataFrame, n: int) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return (join_counted(down, m, "u", n)
                .select(F.explode(F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                .select("e.u", "e.v").where("u <> v").distinct())

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return r["n"], r["h"]

    cur = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                             F.least("u", "v").alias("v")).distinct(),
                folder, f"{label}-0")
    seen = mark(cur)
    for i in range(1, max_rounds + 1):
        if seen[0] == 0:
            break
        mid = stage(large_star(cur, seen[0]), folder, f"{label}-{i}-large")
        nxt = stage(small_star(mid, mid.count()), folder, f"{label}-{i}")
        now = mark(nxt)
        drop_stage(spark, folder, f"{label}-{i}-large")
        if i > 1:
            drop_stage(spark, folder, f"{label}-{i - 1}")
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")))
            .distinct())
