"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes what its predecessor kept (a DataFrame with the columns of
``documents``) and its decisions take effect: rejected, duplicate and
contaminated documents go, personal data is replaced, and the last stage packs
the rest.  Every stage is written as Parquet in the shared folder and read
again, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlex.llm import decontam, language_id, minhash, packing, pii, registry
from voxlex.llm.common import join_counted, stage, table, workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the nearest-centroid model rejects go."""
    return language_id.predict(docs, language_id.fit(docs)).where("NOT rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup of rows: of each group one row stays, the one with the
    smallest doc_id (null last).  Repeated, ambiguous and null ids get the
    decision of their own text, since groups are built on a row key."""
    rows = stage(docs.withColumn("row", F.monotonically_increasing_id()), workspace(spark, "rows"), "rows")
    near = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    near = near.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    near = stage(near.join(rows.select("row", "doc_id"), "row"), workspace(spark, "groups"), "groups")
    first = (near.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("m"),
                                       F.count("*").alias("n"))
             .where("n > 1").select("group", "n", F.col("m.row").alias("stays")))
    first = stage(first, workspace(spark, "first"), "first")
    gone = join_counted(near.select("row", "group"), first, "group", near.count()).where("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a benchmark item go, whatever
    their doc_id: a decision belongs to an id and a text."""
    key = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    bad = decontam.matches(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.withColumn("key", key).join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is replaced by its kind; n_chars follows the new text."""
    found = pii.find(docs).withColumn("n_spans", F.size("spans"))
    return pii.redact(found).withColumn(
        "n_chars", F.when(F.col("n_spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece with its sequence and offset."""
    return packing.pack(docs, registry.WORDS, end_id=0, capacity=2048)


STAGES = [
    ("language ID", keep_known_languages),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]

#: The model, the bands and the tokenizer have no SQL form; tests compare run()
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    folder = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), folder, f"stage-{i}")
    return docs
