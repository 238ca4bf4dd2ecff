"""Language identification by nearest centroid.

A text becomes a vector of its letter n-grams (1 to 3 letters, words bounded by
one separator, case folded), hashed to ``dims`` places, weighted ``(1 + log tf)
* idf`` and normalised.  Each language has up to ``clusters`` centroids from a
spherical k-means; a text gets the language of the nearest centroid by cosine.

Document frequencies are counted over all labelled training rows.  k-means runs
per language on a bounded sample of them (``sample`` rows, those with the
smallest hash of their key), inside Spark.  The model has languages x clusters
x dims numbers, whatever the input.

Rejection is by distance: a text is rejected if it has no letter, or if its
cosine, divided by ``evidence`` (short texts have few n-grams and so lie far
from every centroid), is below the language's floor: half of that value at the
``outliers`` quantile of the language's sample.

A null text or one without letters is ``und`` with score 0 (rejected).  Without
any labelled row nothing can be learned: all texts are ``und``.  Rows are
independent (repeated rows get equal results); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.functions.cache import worker_cache
from voxlex.llm.common import bound_arrow


def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 for all others (once a worker)."""
    cache = worker_cache("letters")
    if "t" not in cache:
        n = 0x40000       # no letters beyond
        t = np.zeros(0x110000, np.uint32)
        t[:n] = np.fromiter((i if chr(i).isalpha() else 0 for i in range(n)), np.uint32, n)
        cache["t"] = t
    return cache["t"]


def grams(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of the text's hashed n-grams; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[np.minimum(c, 0x10FFFF)]
    gap = c == 0
    c = c[~(gap & np.concatenate([[True], gap[:-1]]))] if len(c) else c
    if not len(c) or not c.any():
        return None
    c = np.concatenate([[0], c[:-1] if c[-1] == 0 else c, [0]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
    three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1) + np.uint32(77)
    one = c[1:-1][c[1:-1] > 0] * np.uint32(0x9E3779B1)
    x = np.concatenate([one, two, three])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount((x ^ (x >> np.uint32(13))) & np.uint32(dims - 1), minlength=dims)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(counts), np.float32)
    k = np.flatnonzero(counts)
    v[k] = (1 + np.log(counts[k])) * idf[k]
    return v / np.linalg.norm(v)


def evidence(counts: np.ndarray, enough: int = 150) -> float:
    """1 from ``enough`` distinct n-grams on, in proportion below."""
    return min(1.0, np.count_nonzero(counts) / enough)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from points far from each other."""
    first = x.mean(0)
    c = [x[int(np.argmax(x @ first))]]
    while len(c) < min(k, len(x)):
        far = np.max(x @ np.stack(c).T, 1)
        if far.min() > 0.9999:
            break
        c.append(x[int(np.argmin(far))])
    c = np.stack(c)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        dims: int = 8192, clusters: int = 4, sample: int = 500, outliers: float = 0.002) -> dict:
    """The model, as bounded arrays: idf, centroids, their languages, floors."""
    bound_arrow(train.sparkSession)
    train = train.where(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(key_col).alias("key"))

    def tally(batches):
        df = np.zeros(dims + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                g = grams(t, dims)
                if g is not None:
                    df[:-1] += g > 0
                    df[-1] += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(df[k], pa.int64())], names=["dim", "n"])

    df = np.zeros(dims + 1, np.int64)
    for r in (train.select("text").mapInArrow(tally, "dim int, n bigint")
              .groupBy("dim").agg(F.sum("n").alias("n")).collect()):     # dims + 1 rows at most
        df[r["dim"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    # a row is a candidate if its hash is in a share that holds about twice the sample
    share = train.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * sample / F.count("*")).alias("share"))
    few = train.join(F.broadcast(share), "lang").where(
        F.pmod("key", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit(1)), "key"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank", "key")

    def learn(pdf):
        import pandas as pd
        x = [g for g in (grams(t, dims) for t in pdf["text"]) if g is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        weight = np.array([evidence(g) for g in x])
        x = np.stack([vector(g, idf) for g in x])
        c = spherical_kmeans(x, clusters)
        near = np.sort(np.max(x @ c.T, 1) / weight)
        floor = 0.5 * float(near[int(outliers * len(near))])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": [r.tolist() for r in c],
                             "floor": [floor] * len(c)})

    rows = few.groupBy("lang").applyInPandas(learn, "lang string, centroid array<float>, floor double").collect()
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    return {"dims": dims, "idf": idf, "langs": [r["lang"] for r in rows],
            "floors": np.array([r["floor"] for r in rows]),
            "centroids": np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), dims)}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to the columns of ``docs`` (columns
    of these names are replaced); no shuffle."""
    bound_arrow(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    dims, idf, langs, floors, cents = (model[k] for k in ("dims", "idf", "langs", "floors", "centroids"))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        # dense vectors of 256 texts at a time
        for b in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            n = b.num_rows
            lang, score, rej = ["und"] * n, [0.0] * n, [True] * n
            x, who, weight = np.zeros((n, dims), np.float32), [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                g = grams(t, dims) if langs else None
                if g is not None:
                    x[len(who)] = vector(g, idf)
                    who.append(i)
                    weight.append(evidence(g))
            if who:
                sim = x[:len(who)] @ cents.T
                best = np.argmax(sim, 1)
                for i, j, e, s in zip(who, best, weight, sim[np.arange(len(who)), best].astype(float)):
                    lang[i], score[i], rej[i] = langs[j], min(1.0, max(0.0, float(s))), bool(s < floors[j] * e)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rej, pa.bool_())],
                names=[*names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add(
        "score", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(run, schema)


def fold(key_col: str = "doc_id"):
    """The hold-out fold of a row: crc32 of the key as text, modulo 4."""
    return F.crc32(F.col(key_col).cast("string").cast("binary")) % 4
