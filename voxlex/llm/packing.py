"""Best-fit packing by minimum bin slack over the histogram of lengths.

Documents become ids (plus an end id) and are cut into pieces of at most
``capacity`` ids.  Which pieces share a sequence depends only on how many
pieces there are of each length, a table of at most ``capacity`` rows.  On it
the plan repeats: take the longest length left, let a bitset subset-sum
over the lengths that are left (as often as each is left) find the fullest
feasible combination for the rest of the bin, and remove that combination, as
many times as the counts allow.  Pieces then get a rank within their length
by two-step counting (per partition, then offsets), and the plan maps each
(length, rank) to a sequence and offset.

Null texts are empty and give one piece holding the end id.  Rows are not
deduplicated: a repeated doc_id is packed once per row.  An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.llm.common import bound_arrow, stage, workspace
from voxlex.llm.tokenizing import word_encoder


def fullest(room: int, left: dict[int, int]) -> dict[int, int]:
    """The multiset of available lengths whose sum is the largest <= room.

    ``left``: length -> count.  Bit s of ``reach`` says that sum s can be
    made.  Counts are split into powers of two, longest lengths first, so
    that ties prefer long pieces.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in left if s <= room), reverse=True):
        many, k = min(left[size], room // size), 1
        while many:
            take = min(k, many)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            many -= take
            k *= 2
        if reach >> room & 1:
            break
    s, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> s & 1:
            used[size] = used.get(size, 0) + take
            s -= size * take
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many bins, [(length, pieces of it per bin), ...]), ...]."""
    left = {s: c for s, c in counts.items() if c > 0}
    plan = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        used = fullest(capacity - seed, rest) if rest and seed < capacity else {}
        used[seed] = used.get(seed, 0) + 1
        times = min(left[s] // k for s, k in used.items())
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def _lookup(plan) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first sequence, pieces a bin, offset of the
    first), sorted by (length, first rank)."""
    rows, ranks, seq = [], {}, 0
    for times, combo in plan:
        off = 0
        for size, k in combo:
            rows.append((size, ranks.get(size, 0), seq, k, off))
            ranks[size] = ranks.get(size, 0) + k * times
            off += size * k
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "seq", "per", "off"), a.T.copy()))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every text."""
    bound_arrow(docs.sparkSession)

    def cut(batches):
        enc = word_encoder(tokenizer, 200_000)
        for b in batches:
            ids, off = enc.encode(b.column(1), end_id)
            raw = ids.astype("<u4").tobytes()
            row, piece, start, size, crc = [], [], [], [], []
            for i in range(len(off) - 1):
                a, z = int(off[i]), int(off[i + 1])
                for k, s in enumerate(range(a, z, capacity)):
                    e = min(z, s + capacity)
                    row.append(i)
                    piece.append(k)
                    start.append(s - a)
                    size.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s:4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def assign(pieces: DataFrame, capacity: int, id_col: str = "doc_id", slices: int = 16) -> DataFrame:
    """Sequence and offset of every piece.  ``pieces`` must be a stored table
    (it is read twice and must not change in between).

    A piece's slice comes from a hash of its key, so a hot length is dealt
    out over ``slices`` groups; ranks are local to (length, slice) plus the
    slice's offset.
    """
    spark = pieces.sparkSession
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    # at most capacity x slices rows, whatever the input
    per = counts.collect()
    total: dict[int, int] = {}
    for r in per:
        total[r["length"]] = total.get(r["length"], 0) + r["n"]
    look = _lookup(plan_bins(total, capacity))
    base, seen = [], {}
    for r in sorted(per, key=lambda r: (r["length"], r["slice"])):
        base.append((r["length"], r["slice"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    offsets = spark.createDataFrame(base, "length bigint, slice int, base bigint")
    w = Window.partitionBy("length", "slice").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    ranked = (sliced.withColumn("local", F.row_number().over(w) - 1)
              .join(F.broadcast(offsets), ["length", "slice"])
              .withColumn("rank", F.col("base") + F.col("local")))
    key = look["size"] * (1 << 40) + look["rank"] if len(look["size"]) else look["size"]

    def place(batches):
        for b in batches:
            size = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, size * (1 << 40) + rank, side="right") - 1
            d = rank - look["rank"][at]
            seq = look["seq"][at] + d // look["per"][at]
            off = look["off"][at] + (d % look["per"][at]) * size
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in (id_col, "piece", "start", "length", "ids_crc32")]
                + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema[id_col].dataType.simpleString()
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
               "sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    folder = workspace(docs.sparkSession, "packing")
    pieces = stage(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), folder, "pieces")
    return assign(pieces, capacity, id_col)
