"""Every series against every element of a stimulus (survey D12, C3).

A pair of them is a cell of a matrix product here, not rows to be joined and
grouped: responses are packed to one row per series, the stimulus (frames x
elements, size-checked) is broadcast, and a task multiplies block by block.
Beyond the limits the joined rows are aggregated (``stats``); both give the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.operators import stats as st
from voxlex.session import cut_lineage

#: Bytes of scratch arrays a block of series may take; frames up to which series are packed;
#: predictions up to which a table of them is collected.
SCRATCH_BYTES, MAX_PACKED, MAX_CELLS = 16 << 20, 20_000, 1 << 20


def _packed(y: DataFrame, keys, frames: list, frame_col: str, value: str, chunk: str | None = None) -> DataFrame:
    """(keys, _r): the rows of every series at ``frames`` (place, value, chunk)."""
    places = y.sparkSession.createDataFrame([(t, i) for i, t in enumerate(frames)],
                                            T.StructType([T.StructField("_f", y.schema[frame_col].dataType), T.StructField("_i", T.IntegerType())]))
    row = [F.col("_i").alias("i"), F.col(value).cast("double").alias("v")] + ([F.col(chunk).cast("bigint").alias("c")] if chunk else [])
    return (y.join(F.broadcast(places), F.col(frame_col) == F.col("_f"))
            .groupBy(*keys).agg(F.collect_list(F.struct(*row)).alias("_r")))


def _blocks(batch: pa.RecordBatch, step: int):
    """(rows, ends, fields, validity, series alike) of ``step`` series at a time, a series'
    rows in order of place; alike: all have the same places and no NULL."""
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        r = part.column("_r")
        e = r.flatten()
        size = np.diff(r.offsets.to_numpy())
        fields = {f.name: e.field(f.name) for f in e.type}
        valid = np.asarray(fields["v"].is_valid())
        fields = {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}
        order = np.lexsort((fields["i"], np.repeat(np.arange(len(size)), size)))
        fields, valid = {k: v[order] for k, v in fields.items()}, valid[order]
        alike = bool((size == size[0]).all() and valid.all())
        for k in ("i", "c"):
            if alike and k in fields:
                every = fields[k].reshape(len(size), -1)
                alike = bool((every == every[0]).all())
        yield part, np.cumsum(size), fields, valid, alike


def _spread(x: np.ndarray):
    """(centred columns, population std, exactly 0 for a constant column)."""
    with np.errstate(invalid="ignore"):
        centred = x - x.mean(0)
    std = np.sqrt(np.square(centred).mean(0))
    return centred, np.where(x.max(0) == x.min(0), 0.0, std)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; NaN where b is 0, which callers turn into NULL."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def series_corr_wide(y: DataFrame, x: DataFrame, keys, frame_col: str = "tr", value: str = "value", x_col: str = "x",
                     out: str = "corr", max_bytes: int | None = None) -> DataFrame:
    """(j, keys, corr): ``stats.series_corr`` of every series with each of the elements of
    ``x`` (frame, array; one row per frame)."""
    from voxlex.operators.ridge import MAX_BROADCAST_BYTES
    keys = list(keys)
    x = cut_lineage(x.select(frame_col, x_col).where(F.col(frame_col).isNotNull() & F.col(x_col).isNotNull()))
    most = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    n, frames, lo, hi, gaps = x.agg(F.count("*"), F.countDistinct(frame_col), F.min(F.size(x_col)), F.max(F.size(x_col)),
                                    F.count_if(F.exists(x_col, lambda v: v.isNull()))).first()
    if not n or n != frames or lo != hi or gaps or n > MAX_PACKED or 8 * n * hi > most:
        long = x.select(frame_col, F.posexplode(x_col).alias("j", "_x"))
        return st.series_corr(y.join(long, frame_col), ["j", *keys], value, "_x", out)
    got = sorted(x.collect(), key=lambda r: r[0])
    bc = y.sparkSession.sparkContext.broadcast(np.array([r[1] for r in got], dtype=float).reshape(n, hi))
    packed = _packed(y, keys, [r[0] for r in got], frame_col, value)
    spec = T.StructType([packed.schema[k] for k in keys] + [T.StructField("_c", T.ArrayType(T.DoubleType()))])
    step = max(1, SCRATCH_BYTES // (8 * (4 * n + 4 * hi)))

    def run(batches):
        xs = bc.value
        for batch in batches:
            for part, ends, f, valid, alike in _blocks(batch, step):
                m = part.num_rows
                if alike:
                    v = f["v"].reshape(m, -1).T
                    (xc, sx), (vc, sv) = _spread(xs[f["i"][:len(v)]]), _spread(v)
                    den = sv[:, None] * sx
                    r = _over(vc.T @ xc / len(v), den)
                else:
                    r, den = np.zeros((m, hi)), np.zeros((m, hi))
                    for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                        ok = valid[a:b]
                        if ok.any():
                            rows = xs[f["i"][a:b]]
                            vc, sv = _spread(f["v"][a:b][ok][:, None])
                            den[s] = sv * _spread(rows)[1]
                            r[s] = _over((_spread(rows[ok])[0] * vc).mean(0), den[s])
                flat = pa.array(r.ravel(), pa.float64(), mask=(den == 0).ravel())
                offsets = pa.array(np.arange(0, r.size + 1, hi, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keys] + [pa.ListArray.from_arrays(offsets, flat)],
                                                 names=spec.fieldNames())

    return packed.mapInArrow(run, spec).select(*keys, F.posexplode("_c").alias("j", out)).select("j", *keys, out)


def sign_flips(y: DataFrame, x_a: DataFrame, x_b: DataFrame, by, chunk: str, actual: str = "value", pred: str = "x",
               nperm: int = 999, seed: int = 42, max_cells: int = MAX_CELLS) -> DataFrame | None:
    """``stats.sign_flip_test`` of the ``stats.score_parts`` of two tables of predictions
    (frame, other keys, pred) that hold every frame for all of the same other keys.  A series'
    parts, one per chunk, element and table, exist only in the task that tests them.

    None where the tables are of another shape, or have more than ``max_cells`` rows.
    """
    by = [by] if isinstance(by, str) else list(by)
    on = [c for c in x_a.columns if c in y.columns and c != pred]
    own = [c for c in x_a.columns if c not in (*on, pred)]
    keys = [k for k in by if k not in own]
    if (len(on) != 1 or sorted(x_a.columns) != sorted(x_b.columns) or on[0] in by or not own or not keys
            or not set(own) <= set(by) or not {*keys, chunk} <= set(y.columns) or pred in y.columns):
        return None
    tables = []
    for x in (x_a, x_b):
        rows = x.select(on[0], *own, F.col(pred).cast("double"))
        n = rows.count()
        if not 0 < n <= max_cells:
            return None
        tables.append({(r[0], tuple(r[1:-1])): r[-1] for r in rows.collect()})
        if len(tables[-1]) != n or any(v is None or f is None or None in e for (f, e), v in tables[-1].items()):
            return None
    frames, elements = (sorted({k[i] for k in tables[0]}) for i in (0, 1))
    if tables[0].keys() != tables[1].keys() or len(tables[0]) != len(frames) * len(elements) or len(frames) > MAX_PACKED:
        return None
    mats = [np.array([[t[f, e] for e in elements] for f in frames]) for t in tables]
    bc = y.sparkSession.sparkContext.broadcast((mats, elements))
    packed = _packed(y.dropna(subset=keys), keys, frames, on[0], actual, chunk)
    kinds = [x_a.schema[c] for c in own]
    spec = T.StructType([packed.schema[k] for k in keys] + kinds + [T.StructField("diff", T.DoubleType()), T.StructField("hits", T.LongType())])
    wide = len(elements)
    step = max(1, SCRATCH_BYTES // (8 * max(6 * len(frames) + 4 * wide, wide * nperm)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        mats, elements = bc.value
        names = [pa.array([e[i] for e in elements], to_arrow_type(k.dataType)) for i, k in enumerate(kinds)]
        known: dict = {}                       # chunk -> its signs, one per permutation
        for batch in batches:
            for part, ends, f, valid, alike in _blocks(batch, step):
                m = part.num_rows
                chunks, at = np.unique(f["c"], return_inverse=True)
                d = np.zeros((len(chunks), m, wide))
                found = np.zeros((m, wide), bool)
                for xs, sign in zip(mats, (1.0, -1.0)):
                    if alike:
                        v = f["v"].reshape(m, -1).T
                        (xc, sx), (vc, sv) = _spread(xs[f["i"][:len(v)]]), _spread(v)
                        den = sv[:, None] * sx * len(v)
                        for c in range(len(chunks)):
                            mine = at[:len(v)] == c
                            d[c] += sign * np.where(den == 0, 0.0, _over(vc[mine].T @ xc[mine], den))
                        found |= den != 0
                        continue
                    for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                        ok = valid[a:b]
                        if ok.any():
                            xc, sx = _spread(xs[f["i"][a:b]])
                            vc, sv = _spread(f["v"][a:b][ok][:, None])
                            den = sv * sx * ok.sum()
                            np.add.at(d[:, s], at[a:b][ok], sign * np.where(den == 0, 0.0, _over(xc[ok] * vc, den)))
                            found[s] |= den != 0
                for x in chunks.tolist():
                    if x not in known:
                        known[x] = np.array([st.flips(seed, p, x) for p in range(nperm)], np.int8)
                signs = np.array([known[x] for x in chunks.tolist()], float).reshape(len(chunks), nperm)
                d = d.transpose(1, 2, 0)[found]          # rows by chunks
                diff = d.sum(1)
                hits = (np.abs(d @ signs) >= np.abs(diff)[:, None] - 1e-9).sum(1)
                series, element = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(series)) for k in keys] + [n.take(pa.array(element)) for n in names]
                                                 + [pa.array(diff), pa.array(hits, pa.int64())], names=spec.fieldNames())

    out = packed.mapInArrow(run, spec).select(*by, "diff", "hits")
    return out.withColumn("p", (F.col("hits") + 1) / F.lit(float(nperm + 1)))
