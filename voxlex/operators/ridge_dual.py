"""Ridge with more features than frames: the dual plan (survey G2-G8).

Scores and penalties depend on a stimulus X (frames x features) only through
``X X^T``.  Where X is too wide to broadcast and its features x features
products are too many, X^T is a tall matrix: its features are folded by the QR
tree of ``factor`` into one factor R, frames x frames at most, with
``R^T R = X X^T``.  The rows of ``R^T`` then stand for the frames, and the packed
plan runs on them as on any other stimulus: same penalties, scores, groups,
options.

Weights come back through the dual coefficients.  With ``Z = R^T`` and a fitted
``u`` (in the span of Z's rows) the weights are ``X^T c``, ``c = pinv(Z)^T u``: a
blocked product of series and feature blocks.

Shuffled: the stimulus once (cut into feature blocks), and for weights once more
with the dual coefficients, which are copied to every feature block.  A task
holds one feature block (``BLOCK_BYTES``) and a factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.operators.factor import triangles
from voxlex.operators.ridge import Design, RidgeParams, Source, _list_array, collect_x, packed_source
from voxlex.operators.ridge_moments import BLOCK_BYTES
from voxlex.operators.splits import design_indices
from voxlex.session import cut_lineage


def feature_blocks(x_df: DataFrame, frames: list, width: int, frame_col: str = "tr", x_col: str = "x",
                   features: int | None = None) -> DataFrame:
    """(_b, _i, part): the stimulus at ``frames`` cut into blocks of features
    (``_i``: place of the frame)."""
    spark = x_df.sparkSession
    step = features or max(1, BLOCK_BYTES // (8 * max(1, len(frames))))
    places = spark.createDataFrame([(int(t), i) for i, t in enumerate(frames)], f"{frame_col} int, _i int")
    rows = x_df.select(frame_col, F.col(x_col).cast("array<double>").alias("x")).join(F.broadcast(places), frame_col)
    cut = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-width // step) - 1))),
                      lambda b: F.slice("x", b * F.lit(step) + F.lit(1), F.lit(step)))
    return rows.select("_i", F.posexplode(cut).alias("_b", "part"))


def _block_matrices(rows, frames: int):
    """(block, frames x features) of rows (_b, _i, part) sorted by block."""
    from itertools import groupby
    for b, group in groupby(rows, key=lambda r: r[0]):
        out = None
        for _, i, part in group:
            if out is None:
                out = np.zeros((frames, len(part)))
            out[i] = part
        yield b, out


def _unrolled(batches, names):
    for batch in batches:
        lists = [batch.column(c) for c in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) and c[k].is_valid
                        else c[k].as_py() for c in lists)


def rotate(x_df: DataFrame, frames: list, width: int, frame_col: str = "tr", x_col: str = "x",
           features: int | None = None) -> DataFrame:
    """(frame, x): rows Z, at most as wide as there are frames, with
    ``Z Z^T = X X^T``."""
    n = len(frames)
    blocks = feature_blocks(x_df, frames, width, frame_col, x_col, features)

    def tall(batches):
        for _, m in _block_matrices(_unrolled(batches, ["_b", "_i", "part"]), n):
            step = max(1, (8 << 20) // (8 * n))
            for a in range(0, m.shape[1], step):
                part = np.ascontiguousarray(m[:, a:a + step].T)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), _list_array(part)],
                                                 names=["s", "x"])

    columns = (blocks.repartition("_b").sortWithinPartitions("_b").select("_b", "_i", "part")
               .mapInArrow(tall, "s int, x array<double>"))
    r = triangles(columns, n)
    # rows of R are columns of Z: turned in one task, frames x frames numbers
    kind = x_df.schema[frame_col].dataType.simpleString()
    ordered = [int(t) for t in frames]

    def turn(batches):
        rows = [b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n) for b in batches]
        if rows:
            z = np.vstack(rows).T
            step = max(1, (8 << 20) // (8 * max(1, z.shape[1])))
            for a in range(0, n, step):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ordered[a:a + step]).cast({"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.int64())),
                     _list_array(np.ascontiguousarray(z[a:a + step]))], names=[frame_col, "x"])

    spec = f"{frame_col} {kind if kind in ('int', 'bigint') else 'bigint'}, x array<double>"
    return r.select("x").repartition(1).mapInArrow(turn, spec)


def feature_weights(coef: DataFrame, keys, x_df: DataFrame, frames: list, width: int, frame_col: str = "tr",
                    x_col: str = "x", coef_col: str = "_c", out: str = "weights", features: int | None = None,
                    buckets: int | None = None) -> DataFrame:
    """(keys, weights = X^T c) of rows (keys, c): blocked products of buckets of
    series and blocks of features."""
    keys, n = list(keys), len(frames)
    spark = x_df.sparkSession
    blocks = feature_blocks(x_df, frames, width, frame_col, x_col, features)
    step = features or max(1, BLOCK_BYTES // (8 * max(1, n)))
    many = max(1, -(-width // step))
    share = buckets or max(1, -(-2 * spark.sparkContext.defaultParallelism // many))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = [F.lit(None).cast(coef.schema[k].dataType).alias(k) for k in keys]
    left = blocks.select("_b", spread(share).alias("_s"), F.lit(0).alias("_kind"), "_i", F.col("part").alias("_v"), *none)
    right = coef.select(spread(many).alias("_b"), F.pmod(F.xxhash64(*keys), F.lit(share)).cast("int").alias("_s"),
                        F.lit(1).alias("_kind"), F.lit(0).alias("_i"), F.col(coef_col).alias("_v"), *keys)
    both = left.unionByName(right).repartition("_b", "_s").sortWithinPartitions("_b", "_s", "_kind")
    spec = T.StructType([coef.schema[k] for k in keys] + [T.StructField("_b", T.IntegerType()),
                                                          T.StructField("_w", T.ArrayType(T.DoubleType()))])

    def run(batches):
        at, m = None, None
        for batch in batches:
            b, s = (batch.column(c).to_numpy() for c in ("_b", "_s"))
            kind, place = (batch.column(c).to_numpy() for c in ("_kind", "_i"))
            edge = np.flatnonzero((np.diff(b, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for lo, hi in zip(edge, np.append(edge[1:], batch.num_rows)):
                part = batch.slice(int(lo), int(hi - lo))
                v = part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if kind[lo] == 0:
                    if at != (b[lo], s[lo]):
                        at, m = (b[lo], s[lo]), np.zeros((n, v.shape[1]))
                    m[place[lo:hi]] = v
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(k) for k in keys] + [pa.array(b[lo:hi], pa.int32()), _list_array(v @ m)],
                        names=keys + ["_b", "_w"])

    parts = both.mapInArrow(run, spec)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_w"))), lambda e: e["_w"]))
    return parts.groupBy(*keys).agg(whole.alias(out))


def dual_source(x_df: DataFrame, y_df: DataFrame, keys, p: RidgeParams, frames: list, width: int,
                frame_col: str = "tr", x_col: str = "x", value: str = "value") -> Source:
    """The packed plan on rotated frames; ``finish`` turns weights back."""
    n = len(frames)
    if n * min(n, width) * 8 > p.max_broadcast_bytes:
        raise ValueError(f"{n} frames in the dual exceed the broadcast limit of {p.max_broadcast_bytes} bytes")
    z = collect_x(cut_lineage(rotate(x_df, frames, width, frame_col, x_col)), frames, frame_col, "x", p.max_broadcast_bytes)
    n_train, held = design_indices(frames, p.test_size, p.chunklen, p.nboots, p.nchunks, p.seed, p.draw)
    design = Design(frames=frames, n_train=n_train, held=[np.array(h, dtype=int) for h in held], x=z)
    src = packed_source(y_df, keys, design, p, frame_col, value)
    token = y_df.sparkSession.sparkContext.broadcast(np.linalg.pinv(z, rcond=1e-12))

    def finish(fitted: DataFrame) -> DataFrame:
        """Weights of the rotated stimulus -> weights of the features."""
        own = list(src.keys)
        rest = [c for c in fitted.columns if c not in (*own, "weights")]
        spec = T.StructType([fitted.schema[c] for c in own + rest] +
                            [T.StructField("_c", T.ArrayType(T.DoubleType()))])

        def dual(batches):
            back = token.value                       # width of Z x frames
            for b in batches:
                u = b.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in own + rest] + [_list_array(u @ back)],
                                                 names=own + rest + ["_c"])

        coef = cut_lineage(fitted.select(*own, *rest, "weights").mapInArrow(dual, spec))
        w = feature_weights(coef, own, x_df, frames, width, frame_col, x_col)
        return coef.select(*own, *rest).join(w, own)

    src.finish = finish
    return src
