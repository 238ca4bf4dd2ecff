"""Near-duplicate documents: MinHash bands, signatures, full-set confirmation.

A document's set holds its distinct shingles of five words (``A-Z`` lowered,
words between ASCII white space); a shorter text is one shingle of all its
words; no words, no set and no link.  Two documents are linked when
``100 * |A n B| >= 85 * |A u B|`` (whole-number test on the full sets).

1. One pass hashes every set to ``bands * rows`` universal minima; a band's
   minima form a bucket key.  Equal sets collapse to their smallest doc_id.
2. Every bucket links its members to its smallest one; alternating large-star
   and small-star turn these candidate edges into blocks.  Any linked pair
   shares a bucket except with probability ``(1 - 0.85^rows)^bands`` (1.3e-10
   by default), so it lies in one block.
3. Within a block, pairs that share a bucket, whose signatures agree on
   ``agree`` of the minima (ten standard deviations below the threshold) and
   that are not connected yet are confirmed on their full sets.  Pairs are
   never emitted, only one edge to the smallest connected document.
4. A block with more than ``unit_shingles`` shingles or ``unit_documents``
   documents is split into parts, each with a copy of the block's smallest
   document.  Documents not connected to
   it inside their part (the rest) are then compared with all other parts;
   pairs of documents that are both connected to it need no comparison.
   This is exact for any block size; no task holds a whole hot block.
5. Large-star and small-star over the confirmed edges give the components.

Null or blank text: n_shingles 0, own component.  Rows that repeat a doc_id
count as one document with all their sets, whatever the order of the rows;
each row gets that document's component.  A null
doc_id has a null component and is kept.  Extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.llm.common import bound_arrow, connected_components, join_counted, stage, workspace

K = 5
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < K:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    s = h[:n - K + 1].copy()
    for j in range(1, K):
        s = s * _ODD[0] + h[j:n - K + 1 + j]
    return np.unique(mix(s))


class Minima:
    """``size`` universal hash functions ``a x + b`` on 32-bit values."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]

    def of(self, s: np.ndarray, step: int = 512) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        out = None
        for i in range(0, len(x), step):
            v = self.a * x[None, i:i + step]
            v += self.b
            m = v.min(1)
            out = m if out is None else np.minimum(out, m)
        return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    k = np.arange(bands, dtype=np.uint64)
    for col in sig.reshape(bands, rows).T.astype(np.uint64):
        k = mix(k * _ODD[0] + col)
    return k.view(np.int64)


def sketch(docs: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) per row; no shuffle."""
    def run(batches):
        import xxhash
        minima = Minima(bands * rows, seed)
        for b in batches:
            n, key, band = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band.append(band_keys(minima.of(s), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def confirm(ids: list, sets: list, rest: np.ndarray | None, minima: Minima, agree: float,
            percent: int, bands: int) -> list[tuple[int, int]]:
    """Edges (document, smallest connected document) of one unit; an id may come
    with several sets.

    ``rest`` None: all pairs of the unit count; else only pairs between a
    document that is in the rest and one that is not, or two of the rest.
    Pairs are looked for in the unit's buckets; a bucket whose members are all
    connected costs one look.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids = [ids[i] for i in order]
    sets = [sets[i] for i in order]
    m = len(ids)
    rest = np.ones(m, bool) if rest is None else rest[order]
    sig = np.stack([minima.of(s) for s in sets])
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(m)
    need = agree * sig.shape[1]
    done = np.zeros((m, m), bool)       # pairs looked at: units are bounded in documents

    def compare(i: int, members: np.ndarray) -> None:
        j = members[(root[members] != root[i]) & ~done[i, members]]
        if not rest[i]:
            j = j[rest[j]]
        done[i, j] = done[j, i] = True
        # |A n B| <= min(|A|, |B|), so very different sizes cannot be linked
        j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
        j = j[(sig[j] == sig[i]).sum(1) >= need]
        if not len(j):
            return
        flat = np.concatenate([sets[k] for k in j])
        at = np.searchsorted(sets[i], flat)
        at[at == len(sets[i])] = 0
        hit = np.concatenate([[0], np.cumsum(sets[i][at] == flat)])
        end = np.cumsum(size[j])
        both = hit[end] - hit[end - size[j]]
        for k in j[100 * both >= percent * (size[j] + size[i] - both)]:
            a, z = sorted((root[i], root[k]))
            if a != z:
                root[root == z] = a

    keys = np.stack([band_keys(s, bands, sig.shape[1] // bands) for s in sig])
    for column in keys.T:
        by = np.argsort(column, kind="stable")
        edge = np.flatnonzero(np.diff(column[by], prepend=column[by[0]] - 1))
        for a, z in zip(edge, np.append(edge[1:], m)):
            members = by[a:z]
            for i in members:
                if (root[members] == root[members[0]]).all():
                    break
                compare(i, members)
    return [(ids[i], ids[root[i]]) for i in range(m) if root[i] != i]


def _units(rows: DataFrame, docs: DataFrame, bands: int, rows_per_band: int, seed: int,
           agree: float, percent: int) -> DataFrame:
    """Confirmed edges of all units of ``rows(rep, comp, b, c, rest)``."""
    def run(batches):
        import xxhash
        minima = Minima(bands * rows_per_band, seed)
        unit, ids, sets, rest, seen = None, [], [], [], set()
        out = []

        def end():
            if len(ids) > 1:
                r = np.array(rest, bool)
                out.extend(confirm(ids, sets, r if unit[2] >= 0 else None, minima, agree, percent, bands))

        for b in batches:
            for comp, p, c, rep, text, rst in zip(*(x.to_pylist() for x in b.columns)):
                if (comp, p, c) != unit:
                    end()
                    unit, ids, sets, rest, seen = (comp, p, c), [], [], [], set()
                s = shingles(text)
                key = rep, xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and key not in seen:      # else a repeated row of one document
                    seen.add(key)
                    ids.append(rep)
                    sets.append(s)
                    rest.append(rst)
            if out:
                u, v = zip(*out)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        end()
        if out:
            u, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # both sides grow with the corpus: a shuffle join at every size
    return (docs.join(rows.hint("merge"), docs["doc_id"] == rows["rep"])
            .select("comp", "b", "c", "rep", "text", "rest")
            .repartition(n, "comp", "b", "c").sortWithinPartitions("comp", "b", "c")
            .mapInArrow(run, "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 48, rows: int = 6,
                    agree: float = 0.64, unit_shingles: int = 2_000_000, unit_documents: int = 1000,
                    seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    spark = docs.sparkSession
    bound_arrow(spark)
    folder = workspace(spark, "near")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sk = stage(sketch(docs, bands, rows, seed), folder, "sketch")
    full = sk.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = stage(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), folder, "reps")
    total = sk.count()
    one = (full.select("doc_id", "n_shingles", "bands")
           .join(reps.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    keyed = one.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    low = (keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top"), F.count("*").alias("n"))
           .where("low < top").drop("top"))
    low = stage(low, folder, "buckets")
    edges = (join_counted(keyed, low, "key", bands * total).where("rep <> low")
             .select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    blocks = connected_components(edges, folder, "blocks")
    sized = one.select(F.col("doc_id").alias("rep"), "n_shingles").distinct().join(
        blocks.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "rep")
    sized = stage(sized, folder, "sized")
    units = lambda s, m: F.ceil(F.greatest(F.col(s) / unit_shingles, F.col(m) / unit_documents)).cast("int")
    per = sized.groupBy("comp").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"), F.count("*").alias("m"))
    member = stage(
        join_counted(sized, per, "comp", total).withColumn("parts", units("s", "m"))
        .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), folder, "members")
    pivot = (member.where("parts > 1 AND rep = comp")
             .select("rep", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b")))
    first = (member.select("rep", "comp", "b").unionByName(pivot).distinct()
             .withColumn("c", F.lit(-1)).withColumn("rest", F.lit(False)))
    args = (bands, rows, seed, agree, percent)
    links = stage(_units(first, docs, *args), folder, "confirmed-1")
    split = member.where("parts > 1")
    if split.limit(1).count():
        tied = links.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
        rest = split.where("rep <> comp").join(tied, ["rep", "comp"], "left_anti")
        cut = rest.groupBy("comp").agg(F.sum("n_shingles").alias("rs"), F.count("*").alias("rm")).withColumn(
            "cuts", units("rs", "rm"))
        rest = rest.join(cut, "comp").withColumn("c", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cuts")).cast("int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        second = (rest.select("rep", "comp", each("parts").alias("b"), "c", F.lit(True).alias("rest"))
                  .unionByName(split.join(cut, "comp").select("rep", "comp", "b", each("cuts").alias("c"),
                                                              F.lit(False).alias("rest")))
                  .groupBy("rep", "comp", "b", "c").agg(F.max("rest").alias("rest")))
        links = links.unionByName(stage(_units(second, docs, *args), folder, "confirmed-2"))
    comps = connected_components(links, folder, "links")
    named = reps.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "set_key", "n", F.coalesce("root", "rep").alias("component_id"))
    named = stage(named, folder, "named")
    # rows that repeat a doc_id with another text take the smallest component
    got = join_counted(full.select("doc_id", "n_shingles", "set_key"), named, "set_key", total)
    bare = sk.where("set_key IS NULL OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id"]
    return (got.select(*cols).unionByName(bare.select(*cols))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
