"""Adapters from the driver tables to the shapes the workload expects.

Each adapter is a deterministic DataFrame derivation of the given Parquet
tables (see FIXTURES.md), so work grows with the input.  DuckDB equivalents
live in ``voxlex.plans.oracle_sql``.

TOK   transcript tokens     documents -> (seq, pos, word, onset, offset, tr)
RESP  response long table   lineitem  -> (subject, tr, voxel, value)
STIM  frame stimulus rows   embeddings-> (tr, vec_id, x ARRAY<DOUBLE>)
PART  participants          customer  -> (participant_id, task)
MASK  cortex mask           supplier  -> (voxel, mask)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlex.functions.scalar import to_frame

# Fixed values of the adapters (FIXTURES.md part 3).
WORD_SECONDS = 0.375     # onset = pos * 0.375 s
WORD_LENGTH = 0.25       # offset = onset + 0.25 s
FIRST_ONSET = 3.0        # scanner start offset added before binning
FRAME_SECONDS = 1.5      # one frame ("TR")
STIM_FRAMES = 83         # embeddings are dealt to frames by vec_id % 83
EXCLUDED_IDS = ("000000004", "000000013")
TASK = "U"            # substring test: FURNITURE, HOUSEHOLD, BUILDING, AUTOMOBILE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(spark: SparkSession, sf_dir: str, by_seq: bool = False) -> DataFrame:
    """Whitespace tokens of every document, timed at a fixed word rate.

    ``by_seq``: all words of a sequence in one partition, by position; the documents
    are dealt out, not their words, and what is sorted lies in order but for repeated ids.
    """
    from voxlex.operators.blocks import partitions
    from voxlex.sources.files import balance
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(partitions(docs), "doc_id").sortWithinPartitions("doc_id") if by_seq else balance(docs)
    t = docs.select(F.col("doc_id").alias("seq"),
                    F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    if by_seq:
        t = t.sortWithinPartitions("seq", "pos")
    onset = F.col("pos").cast("double") * F.lit(WORD_SECONDS)
    return (t.withColumn("pos", F.col("pos").cast("int"))
             .withColumn("onset", onset)
             .withColumn("offset", onset + F.lit(WORD_LENGTH))
             .withColumn("tr", to_frame("onset", FIRST_ONSET, FRAME_SECONDS)))


def tok_bad(spark: SparkSession, sf_dir: str, by_seq: bool = False) -> DataFrame:
    """TOK with injected missing words/onsets and unknown-word markers."""
    t = tok(spark, sf_dir, by_seq)
    p = F.col("pos")
    return (t.withColumn("word", F.when(p % 19 == 7, F.lit(None))
                         .when(p % 29 == 3, F.lit("<unk>")).otherwise(F.col("word")))
             .withColumn("onset", F.when(p % 23 == 5, F.lit(None).cast("double"))
                         .otherwise(F.col("onset"))))


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, tr, voxel, value): mean quantity per line number, month, supplier."""
    li = table(spark, sf_dir, "lineitem")
    tr = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return (li.select(F.col("l_linenumber").cast("int").alias("subject"),
                      tr.cast("int").alias("tr"),
                      F.col("l_suppkey").cast("int").alias("voxel"),
                      F.col("l_quantity"))
              .groupBy("subject", "tr", "voxel")
              .agg(F.avg("l_quantity").alias("value")))


def resp_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESP with NaN holes and dead (all-zero) series."""
    r = resp(spark, sf_dir)
    return r.withColumn(
        "value",
        F.when(F.col("voxel") % 17 == 0, F.lit(0.0))
         .when((F.col("tr") + F.col("voxel") + F.col("subject")) % 23 == 0, F.lit(float("nan")))
         .otherwise(F.col("value")))


def resp_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject mean of RESP; cells without a response are absent (ridge takes them as 0)."""
    from voxlex.operators.series import mean_over_subjects
    return mean_over_subjects(resp(spark, sf_dir))


def resp_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject mean of RESP on the full frame x series grid, holes 0.0."""
    from voxlex.operators.series import mean_over_subjects, densify
    return densify(mean_over_subjects(resp(spark, sf_dir)), ["voxel"])


def stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % STIM_FRAMES).cast("int").alias("tr"), "vec_id",
                    F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def stim_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame mean of the first two stimulus elements: (tr, x0, x1)."""
    return (stim(spark, sf_dir)
            .groupBy("tr")
            .agg(F.avg(F.col("x")[0]).alias("x0"), F.avg(F.col("x")[1]).alias("x1")))


def stim_k2_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STIM_K2 as (tr, x ARRAY<DOUBLE>) for the matrix operators."""
    return stim_k2(spark, sf_dir).select("tr", F.array("x0", "x1").alias("x"))


def stim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame mean of the full stimulus vector: (tr, x ARRAY<DOUBLE>)."""
    from voxlex.operators.embed import mean_vector
    return mean_vector(stim(spark, sf_dir), "tr", "x")


def stim_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tr, x): every element of the stimulus, its square and its product with the next
    (the last with the first): 192 features, more than there are frames."""
    rows = stim_frames(spark, sf_dir)
    after = F.transform("x", lambda v, i: v * F.element_at("x", F.when(i + 1 < F.size("x"), i + 2).otherwise(1)))
    return rows.select("tr", F.concat("x", F.transform("x", lambda v: v * v), after).alias("x"))


def scores_wide(spark: SparkSession, sf_dir: str, y: DataFrame | None = None, keys=("voxel",)) -> DataFrame:
    """(run, keys..., corr): correlation of every series of ``y`` (RESP_DENSE) with each of the
    64 stimulus elements, runs f00 to f63."""
    from voxlex.operators.crossed import series_corr_wide
    s = series_corr_wide(resp_dense(spark, sf_dir) if y is None else y, stim_frames(spark, sf_dir), list(keys))
    return s.select(F.format_string("f%02d", "j").alias("run"), *keys, "corr")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("participant_id"), F.col("c_mktsegment").alias("task"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("voxel"),
                    F.when(F.col("s_acctbal") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("mask"))


def n_series(spark: SparkSession, sf_dir: str) -> int:
    """Number of suppliers (the fixture grid size); a one-row aggregate."""
    return table(spark, sf_dir, "supplier").count()


def hemis(spark: SparkSession, sf_dir: str):
    """Split RESP into left (voxel < n/2) and right (re-based) halves."""
    half = n_series(spark, sf_dir) // 2
    r = resp(spark, sf_dir)
    left = r.where(F.col("voxel") < half)
    right = r.where(F.col("voxel") >= half).withColumn("voxel", F.col("voxel") - F.lit(half))
    return left, right, half


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series groups sharing one penalty; voxel % 11 == 0 stay ungrouped."""
    v = resp(spark, sf_dir).select("voxel").distinct()
    return v.where(F.col("voxel") % 11 != 0).select("voxel", (F.col("voxel") % 5).cast("int").alias("grp"))


def scores_pair(spark: SparkSession, sf_dir: str):
    """SCORES_A / SCORES_B: per-series correlation of RESP_DENSE with x0 and x1."""
    from voxlex.operators.stats import series_corr
    d = resp_dense(spark, sf_dir).join(stim_k2(spark, sf_dir), "tr")
    a = series_corr(d, ["voxel"], "value", "x0")
    b = series_corr(d, ["voxel"], "value", "x1")
    return a, b
