"""Vector codes: product codebooks by dual-tree Lloyd rounds.

A component x becomes the integer floor(256 * x).  A vector is cut into
``parts`` equal consecutive parts; every part position has a codebook of up to
``entries`` integer entries.  A Lloyd round assigns each part to its nearest
entry (squared Euclidean distance, ties to the lower index) and moves each
entry to floor(sum / count) of its parts.

Assignment is a dual-tree search.  A task builds, for each part position, a
balanced tree over the parts of a block of rows (boxes, counts, integer sums
per node) and one over the entries.  Both are descended together; a pair of
nodes whose smallest distance exceeds the largest distance to another entry
node is pruned.  A node of parts with one entry left is assigned as a whole
by its cached sums; leaves that stay uncertain compare integers.  Bounds are
doubles with a margin, so they never decide what only integers may decide.

Only per-task sums leave the tasks (parts x entries x width numbers), and the
codebooks are the only broadcast.

Defined results.  Rows with a null vector, a null or a non-finite component
are dropped.  The width is that of the smallest kept id whose vector can be cut
into ``parts``; rows of another width are dropped too.  Ids may repeat (their
vectors break ties) or be null (last).  With fewer kept rows than ``entries``,
the codebooks have that many entries; an empty table gives no rows.  Extra
columns are ignored.  Components of any finite size are exact (Python integers
where 64 bits are short); an error beyond 64 bits is null, and so are the sums
that hold it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.llm.common import bound_arrow, join_counted, stage, workspace

#: Rows of one block of trees; parts in a leaf.
BLOCK, LEAF = 8192, 16
#: Sums travel as limbs of so many bits, each summed as a long.
LIMB = 40
MARGIN = 1e-9


# -- integers and trees, inside tasks ------------------------------------------

def integers(x: np.ndarray, width: int) -> np.ndarray:
    """floor(256 * x) as int64, or as Python integers where squared distances
    over ``width`` components could pass 63 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(x * 256.0)
    if not y.size or np.abs(y).max() < 2.0 ** ((60 - width.bit_length()) // 2):
        return y.astype(np.int64)
    big = [int(v) if math.isfinite(v) else int(u) * 256 for u, v in zip(x.flat, y.flat)]
    return np.array(big, object).reshape(x.shape)


def as_doubles(p: np.ndarray) -> np.ndarray:
    if p.dtype != object:
        return p.astype(np.float64)

    def one(v):
        try:
            return float(v)
        except OverflowError:
            return math.inf if v > 0 else -math.inf

    return np.array([one(v) for v in p.flat]).reshape(p.shape)


def grow(points: np.ndarray, leaf: int):
    """(order of the points, edges of the nodes of each level, root first).
    Node i of a level has the children 2i and 2i + 1."""
    order = np.arange(len(points))
    levels = [np.array([0, len(points)])]
    while np.diff(levels[-1]).max() > leaf:
        edges = levels[-1]
        at = points[order]
        spread = np.maximum.reduceat(at, edges[:-1]) - np.minimum.reduceat(at, edges[:-1])
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = order[np.lexsort((at[np.arange(len(at)), spread.argmax(1)[node]], node))]
        mid = (edges[:-1] + edges[1:] + 1) // 2
        levels.append(np.sort(np.concatenate([edges, mid])))
    return order, levels


def boxes(points: np.ndarray, levels):
    return [(np.minimum.reduceat(points, e[:-1]), np.maximum.reduceat(points, e[:-1])) for e in levels]


class PartTree:
    """Tree over the parts of one position: boxes, counts and sums per node."""

    def __init__(self, parts: np.ndarray, leaf: int = LEAF):
        self.parts = parts
        real = as_doubles(parts)
        self.order, self.levels = grow(real, max(leaf, 2))
        self.boxes = boxes(real[self.order], self.levels)
        sums = [np.add.reduceat(parts[self.order], self.levels[-1][:-1])]
        for _ in self.levels[1:]:
            sums.append(sums[-1][0::2] + sums[-1][1::2])
        self.sums = sums[::-1]


class EntryTree:
    """Tree over the entries of one codebook; a leaf is one entry.  The number
    of leaves is a power of two (the last entry fills up)."""

    def __init__(self, entries: np.ndarray):
        n = len(entries)
        index = np.minimum(np.arange(1 << (n - 1).bit_length()), n - 1)
        self.entries = entries
        real = as_doubles(entries)[index]
        order, levels = grow(real, 1)
        self.index = index[order]
        self.boxes = boxes(real[order], levels)


def bounds(a, b, i, j):
    """Smallest and largest squared distance of the boxes a[i] and b[j]."""
    lo, hi, lo2, hi2 = a[0][i], a[1][i], b[0][j], b[1][j]
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0.0)
        far = np.maximum(hi - lo2, hi2 - lo)
        return (near * near).sum(1), (far * far).sum(1)


@dataclass
class Assigned:
    """What a search found: sums and counts of each entry and, if asked for, the
    entry of each part; how many parts were compared as integers."""
    sums: np.ndarray
    counts: np.ndarray
    codes: np.ndarray | None
    compared: int


def search(tree: PartTree, book: EntryTree, want_codes: bool) -> Assigned:
    """Nearest entry of every part of ``tree``, both trees descended together."""
    parts, entries = tree.parts, book.entries
    kind = object if object in (parts.dtype, entries.dtype) else np.int64
    sums = np.zeros(entries.shape, kind)
    counts = np.zeros(len(entries), np.int64)
    codes = np.zeros(len(parts), np.int64) if want_codes else None
    p = e = np.zeros(1, np.int64)          # pairs of nodes, sorted by the first
    depth, last = len(tree.levels), len(book.boxes) - 1
    compared, step = 0, 0
    while len(p):
        lp, le = min(step, depth - 1), min(step, last)
        near, far = bounds(tree.boxes[lp], book.boxes[le], p, e)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        size = np.diff(np.append(first, len(p)))
        best = np.repeat(np.minimum.reduceat(far, first), size)
        keep = ~(near * (1 - MARGIN) > best * (1 + MARGIN))
        p, e = p[keep], e[keep]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        size = np.diff(np.append(first, len(p)))
        edges = tree.levels[lp]
        if le == last:                     # whole nodes with one entry left
            sure = first[size == 1]
            node, entry = p[sure], book.index[e[sure]]
            np.add.at(sums, entry, tree.sums[lp][node])
            np.add.at(counts, entry, edges[node + 1] - edges[node])
            if want_codes:
                n = edges[node + 1] - edges[node]
                at = np.repeat(edges[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                codes[tree.order[at]] = np.repeat(entry, n)
            keep = np.repeat(size > 1, size)
            p, e, size = p[keep], e[keep], size[size > 1]
        if lp == depth - 1 and le == last:  # uncertain leaves: integers
            if len(p):
                compared = leaves(tree, book, p, e, size, sums, counts, codes)
            break
        if le < last:
            p, e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], 1).reshape(-1)
        if lp < depth - 1:
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            by = np.argsort(p, kind="stable")
            p, e = p[by], e[by]
        step += 1
    return Assigned(sums, counts, codes, compared)


def leaves(tree, book, p, e, size, sums, counts, codes) -> int:
    """Exact comparison of the parts of uncertain leaves with the entries that
    are left to them, a bounded number of pairs at a time."""
    edges = tree.levels[-1]
    cand = book.index[e]
    by = np.lexsort((cand, p))
    p, cand = p[by], cand[by]
    start = np.cumsum(size) - size
    node = p[start]
    n = edges[node + 1] - edges[node]
    pairs = np.cumsum(n * size)
    cut = np.searchsorted(pairs, np.arange(1 << 18, int(pairs[-1]) + (1 << 18), 1 << 18))
    done = 0
    for a, z in zip(np.append(0, cut), np.append(cut, len(node))):
        if z <= a:
            continue
        k = n[a:z]
        row = tree.order[np.repeat(edges[node[a:z]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        many = np.repeat(size[a:z], k)
        begin = np.cumsum(many) - many
        at = np.repeat(np.repeat(start[a:z], k) - begin, many) + np.arange(many.sum())
        diff = tree.parts[np.repeat(row, many)] - book.entries[cand[at]]
        dist = (diff * diff).sum(1)
        least = np.repeat(np.minimum.reduceat(dist, begin), many)
        hit = np.flatnonzero(dist == least)     # candidates of a part rise: the first is the lowest
        owner = np.repeat(np.arange(len(row)), many)[hit]
        code = cand[at[hit[np.flatnonzero(np.diff(owner, prepend=-1))]]]
        np.add.at(sums, code, tree.parts[row])
        np.add.at(counts, code, 1)
        if codes is not None:
            codes[row] = code
        done += len(row)
    return done


# -- codebooks and the Spark jobs ------------------------------------------------

@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` is a tuple of integers."""
    entries: tuple
    width: int

    @property
    def parts(self) -> int:
        return len(self.entries)

    def arrays(self) -> list[np.ndarray]:
        step = self.width // self.parts
        out = []
        for book in self.entries:
            top = max((abs(v) for e in book for v in e), default=0)
            small = top < 2 ** ((60 - step.bit_length()) // 2)
            out.append(np.array(book, np.int64 if small else object).reshape(-1, step))
        return out

    def sha256(self) -> str:
        text = ",".join(str(v) for book in self.entries for e in book for v in e)
        return hashlib.sha256(text.encode()).hexdigest()


def _blocks(batches, width: int):
    """(columns but the vector, integers) of up to ``BLOCK`` rows."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vec = t.column(t.num_columns - 1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        return t, integers(vec.reshape(-1, width), width)

    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            if held and n + part.num_rows > BLOCK:
                yield out()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield out()


def _trees(x: np.ndarray, parts: int):
    step = x.shape[1] // parts
    for k in range(parts):
        yield k, PartTree(np.ascontiguousarray(x[:, k * step:(k + 1) * step]))


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return df.where(v.isNotNull()).where(fine)


def kept_rows(df: DataFrame, folder: str, id_col: str, label_col: str, vec_col: str, parts: int):
    """(id, label, vec) of the usable rows of the common width, stored; the width
    (0 without rows)."""
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")), "vec")
    rows = stage(rows.where((F.size("vec") > 0) & (F.size("vec") % parts == 0)), folder, "kept")
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("w")).first()
    width = head["w"] if head else 0
    return rows.where(F.size("vec") == width), width


def start_books(rows: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids (``entries`` of them)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    x = integers(np.array([r["vec"] for r in first], np.float64).reshape(-1, width), width)
    step = width // parts
    return Codebooks(tuple(tuple(tuple(int(v) for v in row[k * step:(k + 1) * step]) for row in x)
                           for k in range(parts)), width)


def lloyd_round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One assignment and update.  A task emits its sums once."""
    width, parts, arrays = books.width, books.parts, books.arrays()
    step = width // parts

    def add(batches):
        trees = [EntryTree(a) for a in arrays]
        sums = [np.zeros(a.shape, object) for a in arrays]
        counts = [np.zeros(len(a), np.int64) for a in arrays]
        for _, x in _blocks(batches, width):
            for k, tree in _trees(x, parts):
                got = search(tree, trees[k], False)
                sums[k] += got.sums
                counts[k] += got.counts
        out = []
        for k in range(parts):
            for i in np.flatnonzero(counts[k]).tolist():
                out.append((k, i, -1, 0, int(counts[k][i])))
                for pos, v in enumerate(map(int, sums[k][i])):
                    limb = 0
                    while v not in (0, -1):
                        out.append((k, i, pos, limb, v & ((1 << LIMB) - 1)))
                        v >>= LIMB
                        limb += 1
                    if v:
                        out.append((k, i, pos, limb, v))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, [pa.int32()] * 4 + [pa.int64()])],
            names=["part", "entry", "pos", "limb", "value"])

    got = (rows.select("vec").mapInArrow(add, "part int, entry int, pos int, limb int, value bigint")
           .groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value")).collect())
    total: dict[tuple[int, int, int], int] = {}
    for r in got:
        at = (r["part"], r["entry"], r["pos"])
        total[at] = total.get(at, 0) + (r["value"] << (LIMB * r["limb"]))
    moved = tuple(
        tuple(tuple(total.get((k, i, pos), 0) // total[k, i, -1] for pos in range(step)) if (k, i, -1) in total else e
              for i, e in enumerate(book))
        for k, book in enumerate(books.entries))
    return Codebooks(moved, width)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): one byte a part, and the squared distance."""
    width, parts, arrays = books.width, books.parts, books.arrays()
    step = width // parts

    def assign(batches):
        trees = [EntryTree(a) for a in arrays]
        for t, x in _blocks(batches, width):
            code = np.zeros((len(x), parts), np.uint8)
            error = np.zeros(len(x), object)
            for k, tree in _trees(x, parts):
                found = search(tree, trees[k], True).codes
                code[:, k] = found
                diff = tree.parts - arrays[k][found]
                error += (diff * diff).sum(1)
            yield pa.RecordBatch.from_arrays(
                [t.column(0), t.column(1), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array([int(v) if v < 1 << 63 else None for v in error], pa.int64())],
                names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", "label", "vec").mapInArrow(
        assign, f"id {kinds['id']}, label {kinds['label']}, code binary, error bigint")


def decode(code: bytes, books: Codebooks) -> list[float]:
    """The vector that a code stands for (the lower corner of its cell)."""
    return [v / 256 for k, i in enumerate(code) for v in books.entries[k][i]]


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
             label_col: str = "label", vec_col: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """(rows (id, label, code, error), codebooks); see the module's text."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = df.sparkSession
    bound_arrow(spark)
    folder = workspace(spark, "vector-codes")
    rows, width = kept_rows(df, folder, id_col, label_col, vec_col, parts)
    if not width:
        return rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0), None
    books = start_books(rows, width, parts, entries)
    for _ in range(rounds):
        books = lloyd_round(rows, books)
    return stage(encode(rows, books), folder, "codes"), books


def digests(coded: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    key = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = coded.withColumn("key", key)
    side = rows.groupBy("key").agg(
        F.count("*").alias("n"),
        F.when(F.count("error") == F.count("*"),
               F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint").alias("label_error"))
    side = stage(side, workspace(coded.sparkSession, "labels"), "labels")
    total = side.agg(F.sum("n")).first()[0] or 0
    return join_counted(rows, side, "key", total).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
