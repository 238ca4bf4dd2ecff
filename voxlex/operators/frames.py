"""Transcript-side operators (survey B1-B8, C1).

Positions are dense, 0-based and per sequence (``seq``).  Positional code in
the original (``reset_index``, ``subs[2]``, ``pd.unique``) becomes explicit
order columns here: file order is not a Spark concept.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.functions.scalar import subject_code, replace_token, to_frame


def renumber(df: DataFrame, seq_cols, order_col: str, out_col: str = "pos",
             block: int = 1 << 20) -> DataFrame:
    """Dense 0-based rank of ``order_col`` inside each ``seq_cols`` group.

    Skew-safe replacement for ``row_number() over (partition by seq order by
    o)``: rows are cut into blocks of ``block`` consecutive order values, a
    small per-block count table gets running offsets, and the final
    ``row_number`` runs per (seq, block).  No task ever holds more than one
    block, even when one sequence carries a third of all rows.  ``order_col``
    must be integral and unique inside a sequence.
    """
    seq_cols = list(seq_cols)
    keyed = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)).cast("long"))
    counts = keyed.groupBy(*seq_cols, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_off = (Window.partitionBy(*seq_cols) if seq_cols else Window).orderBy("_blk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*seq_cols, "_blk",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*seq_cols, "_blk").orderBy(order_col)
    out = keyed.join(offsets, [*seq_cols, "_blk"])
    return (out.withColumn(out_col, (F.col("_off") + F.row_number().over(w_in) - 1).cast("int"))
               .drop("_blk", "_off"))


def number_in_order(df: DataFrame, seq_col: str = "seq", out_col: str = "pos") -> DataFrame:
    """``renumber`` of rows that lie as they are to be numbered: all rows of a group in one
    partition, in order.  No row is moved; a task keeps one count per group."""
    # rows taken out below it would not be counted: no filter may pass it
    return df.withColumn(out_col, _running_count()(F.col(seq_col)))


def _running_count():
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = {}
        for b in batches:
            n = len(b)
            s = b.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])[:n]
            size = np.diff(np.append(first, n))
            before = np.zeros(len(first), np.int64)
            for i, (k, m) in enumerate(zip(b.take(pa.array(first)).to_pylist(), size.tolist())):
                before[i] = seen.get(k, 0)
                seen[k] = before[i] + m
            yield pa.array((np.arange(n) + np.repeat(before - first, size)).astype(np.int32))

    return F.arrow_udf(number, "int").asNondeterministic()


def drop_incomplete(df: DataFrame, cols=None, seq_cols=("seq",), pos_col: str = "pos", in_order: bool = False) -> DataFrame:
    """Drop rows with any missing field, then renumber positions densely; rows that lie
    in order already (``in_order``) are numbered where they are."""
    cols = list(cols) if cols else [c for c in df.columns if c not in (*seq_cols, pos_col)]
    kept = df.na.drop("any", subset=cols)
    if in_order:
        return number_in_order(kept, *seq_cols, out_col=pos_col)
    return renumber(kept, list(seq_cols), pos_col, pos_col)


def filter_task(df: DataFrame, task: str, col: str = "task") -> DataFrame:
    """Participants whose task string *contains* ``task`` (substring test)."""
    return df.where(F.col(col).contains(task))


def with_subject(df: DataFrame, sep: str = "-", col: str = "participant_id",
                 out: str = "subject") -> DataFrame:
    return df.withColumn(out, subject_code(col, sep))


def exclude(df: DataFrame, ids, col: str = "subject", strict: bool = False) -> DataFrame:
    """Remove listed ids (a small literal list, broadcast as a semi-join side).

    ``strict=True`` raises like ``list.remove`` when an id is not present.
    """
    spark = df.sparkSession
    ids_df = spark.createDataFrame([(str(i),) for i in ids], f"{col} string")
    if strict:
        missing = ids_df.join(df.select(col).distinct(), col, "left_anti").collect()
        if missing:
            raise ValueError(f"ids not present: {[r[0] for r in missing]}")
    return df.join(F.broadcast(ids_df), col, "left_anti")


def nth_row(df: DataFrame, order_cols, k: int, by=None) -> DataFrame:
    """The k-th row (0-based) in an explicit order, optionally per group.

    ``row_number() = k+1`` is planned by Catalyst as a per-partition group
    limit followed by a tiny final window, not as a full sort of the input.
    """
    w = (Window.partitionBy(*by) if by else Window).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == k + 1).drop("_rn")


def replace_unknown(df: DataFrame, col: str = "word", old: str = "<unk>", new: str = "<|endoftext|>") -> DataFrame:
    """Replace the transcript's unknown-word marker by the model's unknown token."""
    return df.withColumn(col, replace_token(col, old, new))


def with_frames(df: DataFrame, first=0.0, tr: float = 1.5) -> DataFrame:
    """Onset/offset seconds -> ``tr_onset`` / ``tr_offset`` frame indices."""
    return (df.withColumn("tr_onset", to_frame("onset", first, tr))
              .withColumn("tr_offset", to_frame("offset", first, tr)))


def frames(df: DataFrame, seq_cols=("seq",), frame_col: str = "tr", pos_col: str = "pos") -> DataFrame:
    """Distinct frames per sequence with their first-appearance position."""
    return (df.groupBy(*seq_cols, frame_col)
              .agg(F.min(pos_col).alias("first_pos"), F.count(F.lit(1)).alias("n_words")))


def gather_frames(resp: DataFrame, frames_df: DataFrame, frame_col: str = "tr") -> DataFrame:
    """Response rows at the listed frames (semi join; frames never duplicate rows)."""
    return resp.join(frames_df.select(frame_col).distinct(), frame_col, "left_semi")


def missing_frames(resp: DataFrame, frames_df: DataFrame, frame_col: str = "tr") -> DataFrame:
    """Listed frames that have no response row (reported instead of wrapping)."""
    return frames_df.select(frame_col).distinct().join(resp.select(frame_col), frame_col, "left_anti")
