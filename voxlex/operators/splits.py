"""Ordered splits, chunking and the bootstrap hold-out draw (E7, E8, F1, F2).

These work on the distinct-frame table, whose size is the recording length.
The hold-out draw is seeded through ``md5`` so every engine (and every
retry of a lost task) sees the same permutation; ``rand()`` would not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.operators.frames import renumber


def ordered_split(df: DataFrame, frame_col: str = "tr", test_size: float = 0.2) -> DataFrame:
    """Distinct frames -> (tr, idx, is_test): the last ``ceil(test_size*n)`` are test.

    Unshuffled, so no seed is involved.  ``idx`` is the 0-based position in
    frame order; ``train_idx`` the position inside the training part.
    """
    fr = df.select(frame_col).distinct()
    idx = renumber(fr, [], frame_col, "idx")
    n = fr.agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    j = idx.withColumn("_g", F.lit(0)).join(F.broadcast(n), "_g").drop("_g")  # one row
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    return (j.withColumn("is_test", F.col("idx") >= F.col("_n") - n_test)
             .withColumn("train_idx", F.when(~F.col("is_test"), F.col("idx")))
             .drop("_n"))


def chunk_ids(split: DataFrame, chunklen: int, idx_col: str = "train_idx") -> DataFrame:
    """Fixed-length chunks of the training rows; a short tail chunk gets NULL.

    The tail is never held out and is always trained on.
    """
    tr = split.where(F.col(idx_col).isNotNull())
    n = tr.agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    j = tr.withColumn("_g", F.lit(0)).join(F.broadcast(n), "_g").drop("_g")  # one row
    c = F.floor(F.col(idx_col) / F.lit(chunklen)).cast("int")
    full = F.floor(F.col("_n") / F.lit(chunklen))
    return j.withColumn("chunk", F.when(c < full, c)).drop("_n")


def shuffled_chunks(full: int, nboots: int, nchunks: int, seed: int = 42) -> list:
    """Per bootstrap the chunks a shuffle of ``0 .. full - 1`` puts first, by one
    Mersenne Twister for all bootstraps (as the analysed code draws them when
    its generator is seeded)."""
    import random
    rng, out = random.Random(seed), []
    for _ in range(nboots):
        order = list(range(full))
        rng.shuffle(order)
        out.append(order[:nchunks])
    return out


def holdout_chunks(chunks: DataFrame, nboots: int, nchunks: int, seed: int = 42, draw: str = "md5") -> DataFrame:
    """(boot, chunk): ``nchunks`` distinct full chunks per bootstrap.

    ``draw='shuffle'`` takes them from ``shuffled_chunks``, which needs only the
    number of chunks; ``draw='md5'`` (the default):

    Per bootstrap the chunks are ordered by ``md5(seed|boot|chunk)`` (ties
    by chunk) and the first ``nchunks`` are held out: sampling without
    replacement inside a draw, independent draws across bootstraps.
    """
    if draw == "shuffle":
        full = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1 if chunks.where("chunk IS NOT NULL").limit(1).count() else 0
        rows = [(b, c) for b, held in enumerate(shuffled_chunks(full, nboots, nchunks, seed)) for c in held]
        return chunks.sparkSession.createDataFrame(rows, "boot int, chunk int")
    if draw != "md5":
        raise ValueError("draw must be 'md5' or 'shuffle'")
    c = chunks.where(F.col("chunk").isNotNull()).select("chunk").distinct()
    boots = c.select(F.explode(F.sequence(F.lit(0), F.lit(nboots - 1))).alias("boot"), "chunk")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("boot").cast("string"), F.col("chunk").cast("string")))
    w = Window.partitionBy("boot").orderBy(key, F.col("chunk"))
    return (boots.withColumn("_r", F.row_number().over(w))
                 .where(F.col("_r") <= nchunks).drop("_r"))


def holdout_rows(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """(boot, tr, train_idx) of the held-out rows."""
    return chunks.join(held, "chunk").select("boot", "tr", "train_idx")


def train_rows(chunks: DataFrame, held: DataFrame, nboots: int) -> DataFrame:
    """Complement of the held-out rows inside the training part, per bootstrap."""
    allrows = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(nboots - 1))).alias("boot"), "tr", "train_idx")
    return allrows.join(holdout_rows(chunks, held), ["boot", "tr", "train_idx"], "left_anti")


def default_nchunks(n_train: int, chunklen: int, frac: float = 0.2) -> int:
    """Chunks to hold out: ``int(frac * n_train / chunklen)``."""
    return int(frac * n_train / chunklen)


def design_indices(frames: list, test_size: float, chunklen: int, nboots: int, nchunks: int | None,
                   seed: int, draw: str = "md5") -> tuple[int, list]:
    """The split and hold-out draw of a known (bounded) frame list, without a job.

    Same rules as ``ordered_split`` / ``chunk_ids`` / ``holdout_chunks``
    (tested equal): returns ``(n_train, held)`` where ``held[b]`` lists the
    held-out positions inside the training part for bootstrap ``b``.  Used
    where the frame list is on the driver anyway (it is part of the ridge
    broadcast), so no extra Spark stages are spent on metadata.
    """
    import hashlib
    import math
    n = len(frames)
    n_train = n - int(math.ceil(float(test_size) * n))
    full = n_train // chunklen
    k = nchunks if nchunks is not None else default_nchunks(n_train, chunklen)
    if draw == "shuffle":
        return n_train, [sorted(i for c in h for i in range(c * chunklen, (c + 1) * chunklen))
                         for h in shuffled_chunks(full, nboots, k, seed)]
    held = []
    for b in range(nboots):
        order = sorted(range(full), key=lambda c: (hashlib.md5(f"{seed}|{b}|{c}".encode()).hexdigest(), c))
        held.append(sorted(i for c in order[:k] for i in range(c * chunklen, (c + 1) * chunklen)))
    return n_train, held
