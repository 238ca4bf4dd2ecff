"""Repeated byte strings across a corpus, by a hash-compared suffix sort.

A byte is removed when it lies in a string of ``length`` bytes that also starts
at another place of the corpus (same document included).  Texts are UTF-8
bytes; a match never crosses documents; strings are judged on the input.

Sorting every suffix of a large corpus moves far more data than the input, so
the sort gets the suffixes that can matter, exactly:

1. *Anchors.*  Prefix polynomial hashes give every ``k``-gram a hash; of each
   string of ``length`` bytes the rightmost smallest ``k``-gram is its anchor.
   Equal strings have the same anchor at the same offset, so a string whose
   anchor hash occurs once in the corpus is unique.  The strings of one anchor
   occurrence start at consecutive places; together they are its *context*.
2. Occurrences of repeated anchors are grouped by (anchor, context hash) with a
   partial aggregate.  All strings of a context that occurs twice are repeated.
   Of a context that occurs once, strings may still equal some of another
   context of the same anchor: those suffixes are sorted.
3. *Suffix sort.*  A merge sort over the suffixes of the distinct contexts of
   an anchor, aligned by their offset to it.  Two suffixes are compared by
   their longest common extension, found by binary search over prefix hashes
   (eight steps for 200 bytes), and the byte after it.  Neighbours with an
   extension of ``length`` bytes are repeats; their bytes are compared, and a
   hash collision makes the sort run again with another base.
4. An anchor with more than ``unit`` distinct contexts is sorted in parts;
   what is unique in its part is matched across parts by the 128-bit hash of
   the string, with a partial aggregate.

Texts are kept once, compressed, in a table bucketed by row, so that joins of
positions with texts do not shuffle the texts.  Null texts are empty (nothing
removed).  Rows are independent: a repeated row repeats all its strings.  Extra
columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.functions.cache import worker_cache
from voxlex.llm.common import bound_arrow, stage, workspace
from voxlex.llm.minhash import mix


#: Suffixes compared at a time.
SLICE = 1 << 16


def powers(n: int, seed: int = 0):
    """(byte values, base^i, base^-i) modulo 2^64, for i < n at least."""
    cache = worker_cache("powers")
    got = cache.get(seed)
    if got is None or len(got[1]) < n:
        rng = np.random.default_rng(1000 + seed)
        value = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 5          # odd, invertible
        size = max(1 << 17, 1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            p = np.full(size, base, np.uint64)
            q = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            got = value, np.multiply.accumulate(p), np.multiply.accumulate(q)
        cache[seed] = got
    return got


def prefix_hashes(b: np.ndarray, seed: int = 0):
    """(sums, inverse powers): the string [s, s+n) has the hash
    ``(sums[s+n] - sums[s]) * inverse[s]``."""
    value, p, q = powers(len(b) + 1, seed)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value[b] * p[:len(b)], out=sums[1:])
    return sums, q


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (running minima of blocks)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(b: np.ndarray, length: int, k: int, span: int = 1 << 20):
    """(hash, position, largest offset, smallest offset) of every anchor.

    A string starting at p with anchor q has the offset q - p.  Long texts
    are handled in overlapping spans of ``span`` places.
    """
    n = len(b)
    if n < length:
        return [np.zeros(0, np.int64)] * 4
    w = length - k + 1
    out = []
    for a in range(0, n - length + 1, span):
        z = min(n, a + span + length - 1)
        sums, inv = prefix_hashes(b[a:z])
        m = z - a - k + 1
        h = mix((sums[k:] - sums[:-k]) * inv[:m])
        # hash above, place from the right below: ties go to the rightmost
        place = np.arange(m, dtype=np.uint64)
        packed = (h & ~np.uint64((1 << 21) - 1)) | (np.uint64((1 << 21) - 1) - place)
        low = _sliding_min(packed, w)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [len(low)]]) - 1
        q = ((1 << 21) - 1) - (low[first] & np.uint64((1 << 21) - 1)).astype(np.int64)
        out.append((h[q].view(np.int64), q + a, q - first, q - last))
    return [np.concatenate(c) for c in zip(*out)]


def compare(s: np.ndarray, t: np.ndarray, sums: np.ndarray, inv: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension (at most ``length``) of suffix pairs."""
    lo = np.zeros(len(s), np.int64)
    hi = np.full(len(s), length, np.int64)
    a, b, ia, ib = sums[s], sums[t], inv[s], inv[t]
    for _ in range(int(length).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (sums[s + mid] - a) * ia == (sums[t + mid] - b) * ib
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def _less(s, t, text, sums, inv, length):
    """Whether suffix s sorts before suffix t; equal up to ``length``: no."""
    n = compare(s, t, sums, inv, length)
    end = n >= length
    n = np.minimum(n, length - 1)
    return ~end & (text[s + n] < text[t + n])


def suffix_sort(group: np.ndarray, at: np.ndarray, text: np.ndarray, sums, inv, length: int) -> np.ndarray:
    """Order of the suffixes ``at`` by (group, first ``length`` bytes).

    Bottom-up merge sort of all groups at once: in every round, an element's
    place in its merged run is its place in its own run plus its rank in the
    neighbour run, found by binary search with hash comparisons.
    """
    order = np.argsort(group, kind="stable")
    n = len(order)
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [n]]))
    first = np.repeat(start, size)
    stop = first + np.repeat(size, size)
    run = 1
    place = np.arange(n)
    while n and run < size.max():
        local = place - first
        mine = first + local // run * run
        left = (local // run) % 2 == 0
        other = np.where(left, mine + run, mine - run)
        every = np.flatnonzero((other >= first) & (other < stop))
        to = place.copy()
        for c in range(0, len(every), SLICE):          # short scratch arrays
            act = every[c:c + SLICE]
            lo = other[act]
            hi = np.minimum(lo + run, stop[act])
            base, s, before = lo.copy(), at[order[act]], left[act]
            for _ in range(int(run).bit_length() + 1):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                t = at[order[mid]]
                x = s[open_]
                # stable: an element of the left run goes before its equals
                go = np.where(before[open_], _less(t, x, text, sums, inv, length),
                              ~_less(x, t, text, sums, inv, length))
                lo[open_] = np.where(go, mid + 1, lo[open_])
                hi[open_] = np.where(go, hi[open_], mid)
            to[act] = np.minimum(mine[act], base) + (act - mine[act]) + (lo - base)
        nxt = np.empty_like(order)
        nxt[to] = order
        order = nxt
        run *= 2
    return order


def repeated(contexts: list[bytes], q: np.ndarray, big: np.ndarray, small: np.ndarray,
             anchor: np.ndarray, length: int):
    """(context index, offset, leader) of every suffix that equals another
    context's suffix at the same offset of the same anchor, and the rest.

    ``leader`` marks one of each set of equals.  ``q`` is the anchor's place
    in its context.  Returns (index, offset, repeated, leader) of all suffixes.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum([0] + [len(c) for c in contexts])[:-1]
    n = big - small + 1
    idx = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(small, n)
    at = base[idx] + q[idx] - off
    _, rank = np.unique(anchor, return_inverse=True)
    group = rank[idx] * np.int64(length) + off
    for seed in range(1, 9):
        sums, inv = prefix_hashes(text, seed)
        order = suffix_sort(group, at, text, sums, inv, length)
        near = np.flatnonzero(group[order[1:]] == group[order[:-1]])
        near = np.concatenate([near[:0]] + [
            c[compare(at[order[c]], at[order[c + 1]], sums, inv, length) >= length]
            for c in (near[i:i + SLICE] for i in range(0, len(near), SLICE))])
        ok = True
        for i in range(0, len(near), 20_000):     # collision verification
            c = near[i:i + 20_000]
            ar = np.arange(length)
            ok &= bool((text[at[order[c]][:, None] + ar] == text[at[order[c + 1]][:, None] + ar]).all())
        if ok:
            break
    else:
        raise RuntimeError("hash collisions in eight bases")
    rep = np.zeros(len(at), bool)
    follow = np.zeros(len(at), bool)
    rep[order[near]] = rep[order[near + 1]] = True
    follow[order[near + 1]] = True
    return idx, off, rep, ~follow


# -- distributed steps --------------------------------------------------------

def text_and_anchors(docs: DataFrame, folder: str, length: int, k: int) -> DataFrame:
    """One pass over the texts.  Each task writes its rows, compressed, to one
    file and returns per row (part, row, h, ctx, at) arrays of its anchors;
    its last row names the file (``uri``).

    ``at`` packs position (upper bits), largest and smallest offset (8 bits
    each, so ``length`` is at most 255).
    """
    if not k < length < 256:
        raise ValueError("k < length < 256 is required")

    def run(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        from voxlex.llm.common import open_fs
        part, row = TaskContext.get().partitionId(), 0
        uri = f"{folder}/texts-{part:06d}-{uuid.uuid4().hex[:8]}.parquet"
        fs, path = open_fs(uri)
        names = ["part", "row", "h", "ctx", "at", "uri"]
        arrays = pa.list_(pa.int64())
        with fs.open_output_stream(path) as f:
            schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
            with pq.ParquetWriter(f, schema, compression="zstd", use_dictionary=False) as out:
                for b in batches:
                    raws = [(t or "").encode() for t in b.column(1).to_pylist()]
                    out.write_table(pa.Table.from_arrays([b.column(0), pa.array(raws, pa.binary())], schema=schema))
                    hs, cs, ats = [], [], []
                    for raw in raws:
                        x = np.frombuffer(raw, np.uint8)
                        h, q, big, small = anchors(x, length, k)
                        if len(h):
                            lo, hi = q - big, q - small + length
                            sums, inv = prefix_hashes(x, 1)
                            c = mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(np.uint64)).view(np.int64)
                            cs.append(c)
                        else:
                            cs.append(h)
                        hs.append(h)
                        ats.append(q << 16 | big << 8 | small)
                    n = len(raws)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()),
                         pa.array(hs, arrays), pa.array(cs, arrays), pa.array(ats, arrays),
                         pa.array([None] * n, pa.string())], names=names)
                    row += n
        if row:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([-1], pa.int64()), *(pa.array([None], arrays),) * 3,
                 pa.array([uri])], names=names)

    return docs.mapInArrow(run, "part int, row bigint, h array<bigint>, ctx array<bigint>, "
                                "at array<bigint>, uri string")


def _with_texts(rows: DataFrame, files: DataFrame, cols: list[str], job, schema: str) -> DataFrame:
    """Bring ``rows(part, row, *cols)`` to the texts of their part.

    The rows and one marker per text file (its uri) are dealt out by part;
    each task opens the files of its parts.  Texts are read, never
    shuffled.  ``job(rows of one document, doc_id, raw)`` yields result rows.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = dict(rows.dtypes)
    mark = files.select("part", F.lit(-1).cast("bigint").alias("row"), "uri",
                        *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    both = rows.select("part", "row", F.lit(None).cast("string").alias("uri"), *cols).unionByName(mark)
    out_schema = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)

    def run(batches):
        import pyarrow.parquet as pq

        from voxlex.llm.common import open_fs
        out: list = []

        def texts(uri):
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                i = 0
                for b in pq.ParquetFile(f).iter_batches(batch_size=64):
                    for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        yield i, d, t
                        i += 1

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return b

        reader, doc, held = None, None, []

        def settle():
            """The results of the current document."""
            if doc is not None:
                out.extend(job(held, doc[1], doc[2]))
                held.clear()

        for b in batches:
            for _, row, uri, *vals in zip(*(c.to_pylist() for c in b.columns)):
                if uri is not None:
                    if reader is not None:
                        settle()
                        for doc in reader:
                            settle()
                    reader = texts(uri)
                    doc = next(reader, None)
                    continue
                while doc[0] < row:
                    settle()
                    doc = next(reader)
                    if len(out) >= 2000:
                        yield flush()
                held.append(vals)
            if out:
                yield flush()
        if reader is not None:
            settle()
            for doc in reader:
                settle()
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return (both.repartition(n, "part").sortWithinPartitions("part", "row")
            .mapInArrow(run, schema))


def _sort_units(ctxs: DataFrame, length: int, batch_items: int) -> DataFrame:
    """Suffix sort of every unit (h, salt) of ``ctxs``; rows of kind

    0: (part, row, first, last): starts first..last are repeated strings;
    1: one string of a split anchor, by its hash, for the match across parts.
    """
    n = max(1, int(ctxs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        held, items = [], 0

        def work():
            raws = [r[4] for r in held]
            q, big, small, start = (np.array([r[i] for r in held], np.int64) for i in (5, 6, 7, 8))
            unit = np.array([r[0] for r in held], np.int64)
            idx, off, rep, lead = repeated(raws, q, big, small, unit, length)
            cols = [[] for _ in range(9)]

            def put(i, kind, a, z, w1, w2, u):
                for c, v in zip(cols, (kind, held[i][2], held[i][3], a, z, w1, w2, u, held[i][9])):
                    c.append(v)

            one = np.array([r[9] for r in held], np.int64)
            # offsets run upwards within a context, so starts run downwards
            hit = rep & (one[idx] == 1)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            brk = np.flatnonzero(np.diff(idx)) + 1
            cuts = np.unique(np.concatenate([edge, brk]))
            for a, z in zip(cuts, cuts[1:]):
                if hit[a] and a < z:
                    i = int(idx[a])
                    base = int(start[i] + q[i])
                    put(i, 0, base - int(off[z - 1]), base - int(off[a]), None, None, None)
            wide = np.array([r[1] >= 0 for r in held])
            for j in np.flatnonzero(lead & wide[idx]):
                i, o = int(idx[j]), int(off[j])
                p = int(q[i]) - o
                d = hashlib.blake2b(raws[i][p:p + length], digest_size=16, salt=o.to_bytes(8, "little")).digest()
                s = int(start[i]) + p
                put(i, 1, s, s, int.from_bytes(d[:8], "little", signed=True),
                    int.from_bytes(d[8:], "little", signed=True), int(rep[j]))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["kind", "part", "row", "first", "last", "w1", "w2", "hit", "c"])

        last = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                # rows: h, salt, part, row, bytes, q, big, small, start, c
                if (r[0], r[1]) != last and items >= batch_items:
                    yield work()
                    items = 0
                last = (r[0], r[1])
                held.append(r)
                items += r[6] - r[7] + 1
        if held:
            yield work()

    return (ctxs.repartition(n, "h", "salt").sortWithinPartitions("h", "salt")
            .select("h", "salt", "part", "row", "bytes", "q", "big", "small", "start", "c")
            .mapInArrow(run, "kind int, part int, row bigint, first bigint, last bigint, "
                             "w1 bigint, w2 bigint, hit int, c bigint"))


def repeats(docs: DataFrame, folder: str, length: int = 200, k: int = 32, unit: int = 8192,
            batch_items: int = 150_000):
    """(rows (part, row, first, last): starts of repeated strings; text files)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    one = stage(text_and_anchors(docs, folder, length, k), folder, "anchors")
    files = one.where("uri IS NOT NULL").select("part", "uri")
    occ = (one.where("uri IS NULL").select("part", "row", F.explode(F.arrays_zip("h", "ctx", "at")).alias("a"))
           .select("part", "row", "a.h", "a.ctx", "a.at"))
    counts = stage(occ.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), folder, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # an anchor with over a thousandth of the rows is hot: at most 1000 of them
    hot = F.broadcast(counts.where(F.col("n") * 1000 > total).select("h"))
    # their rows leave before the shuffle of the others
    warm = occ.join(hot, "h", "left_anti").join(counts.where(F.col("n") * 1000 <= total).select("h"), "h")
    from pyspark.sql import Window
    same = Window.partitionBy("h", "ctx")
    by_h = Window.partitionBy("h")
    cols = ["part", "row", "h", "ctx", "at", "c", "lead", "n_ctx"]
    cool = (warm.withColumn("c", F.count("*").over(same))
            .withColumn("lead", (F.row_number().over(same.orderBy("part", "row", "at")) == 1).cast("int"))
            .withColumn("n_ctx", F.sum("lead").over(by_h)).select(*cols))
    # hot anchors: partial aggregates only, joined back
    heavy = occ.join(hot, "h")
    agg = stage(heavy.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("part", "row", "at")).alias("m")),
                folder, "hot")     # read as a table, so that Spark can split a hot context in the join below
    n_ctx = agg.groupBy("h").agg(F.count("*").alias("n_ctx"))
    warm2 = (heavy.join(agg.join(F.broadcast(n_ctx), "h"), ["h", "ctx"])
             .withColumn("lead", (F.struct("part", "row", "at") == F.col("m")).cast("int")).select(*cols))
    # two tables: in a plan with one join of its own, Spark splits a hot context
    use = "c > 1 OR (lead = 1 AND n_ctx > 1)"
    marked = stage(cool.where(use), folder, "marked").unionByName(stage(warm2.where(use), folder, "marked-hot"))
    pos, big, small = "shiftright(at, 16)", "shiftright(at, 8) & 255", "at & 255"
    whole = marked.where("c > 1").select("part", "row", F.expr(f"{pos} - ({big})").alias("first"),
                                         F.expr(f"{pos} - ({small})").alias("last"))
    reps = marked.where("lead = 1 AND n_ctx > 1").select("part", "row", "h", "ctx", "at", "c", "n_ctx")

    def extract(rows, doc_id, raw):
        for h, ctx, part, row, at, c, n in rows:
            q, b, s = at >> 16, at >> 8 & 255, at & 255
            salt = ctx % -(-n // unit) if n > unit else -1
            yield h, salt, part, row, raw[q - b:q - s + length], b, b, s, q - b, c

    named = reps.withColumn("p", F.col("part")).withColumn("r", F.col("row"))
    ctxs = _with_texts(named, files, ["h", "ctx", "p", "r", "at", "c", "n_ctx"], extract,
                       "h bigint, salt bigint, part int, row bigint, bytes binary, q bigint, big bigint, "
                       "small bigint, start bigint, c bigint")
    done = stage(_sort_units(ctxs, length, batch_items), folder, "sorted")
    wide = done.where("kind = 1")
    across = (wide.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1")
              .join(wide.where("hit = 0 AND c = 1"), ["w1", "w2"]))
    out = (whole.unionByName(done.where("kind = 0").select("part", "row", "first", "last"))
           .unionByName(across.select("part", "row", "first", "last")))
    return out, files


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 32, unit: int = 8192) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) per row: ``spans``
    are the maximal removed runs, ``kept`` the bytes that stay."""
    folder = workspace(docs.sparkSession, "repeats")
    rows, files = repeats(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                          folder, length, k, unit)

    def cut(held, doc_id, raw):
        n = len(raw)
        runs = []
        for first, last in sorted(held):
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], last + length)
            else:
                runs.append([first, last + length])
        gone = sum(z - a for a, z in runs)
        ends = [0] + [x for r in runs for x in r] + [n]
        kept = b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2]))
        yield doc_id, n, gone, len(runs), [list(r) for r in runs], kept

    return _with_texts(rows, files, ["first", "last"], cut,
                       "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                       "spans array<array<bigint>>, kept binary")


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans",
                         F.sha2("kept", 256).alias("kept_sha256"))
