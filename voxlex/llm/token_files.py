"""Token ids in canonical length-limited Huffman files.

Writing: texts are encoded once into a staged table, ids are counted over all
documents, package-merge gives code lengths of at most ``max_bits``, and
canonical codes follow from the lengths alone.  The staged ids are then put in
ascending document order by a range partitioning; each task writes files of
about ``file_tokens`` ids.

One file, little-endian:
  magic ``HUFTOK01``; uint32 symbols, max_bits, block size, documents;
  uint64 ids; uint8 code length per symbol;
  per document: int64 key, uint8 1 if the key is null, uint32 ids;
  per block of ``block`` ids: uint64 bit offset of its first code (the
  checkpoints); then the code bits, most significant first, zero padded.
Blocks can be decoded independently.  The reader decodes all blocks of a file
side by side, one table look-up per id.

Null texts are empty (the end id alone).  Rows with equal doc_id stay separate
and are ordered by their ids' checksum; null doc_ids come first.  An empty
table writes no file and reads back as an empty table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.llm.common import bound_arrow, open_fs, stage, workspace, write_file
from voxlex.llm.tokenizing import word_encoder

MAGIC = b"HUFTOK01"
HEAD = "<8sIIIIQ"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths under a limit, by package-merge; 0 for ids that
    do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n = len(leaf)
    levels, w = [], leaf
    for _ in range(max_bits - 1):
        half = len(w) // 2
        packs = w[:2 * half].reshape(half, 2).sum(1)
        both = np.concatenate([leaf, packs])
        pick = np.argsort(both, kind="stable")
        levels.append(pick)
        w = both[pick]
    take = 2 * n - 2          # cheapest items of the last level
    length = np.zeros(n, np.int64)
    for pick in reversed(levels):
        sel = pick[:take]
        length[sel[sel < n]] += 1
        take = 2 * int((sel >= n).sum())
    length[:take] += 1        # the first level holds leaves only
    out[order] = length
    return out


def canonical_codes(length: np.ndarray) -> np.ndarray:
    """Codes ordered by (length, id)."""
    code = np.zeros(len(length), np.uint64)
    ids = np.flatnonzero(length)
    ids = ids[np.lexsort((ids, length[ids]))]
    nxt, prev = 0, 0
    for i in ids:
        n = int(length[i])
        nxt <<= n - prev
        code[i] = nxt
        nxt += 1
        prev = n
    return code


def encode_bits(ids: np.ndarray, length: np.ndarray, code: np.ndarray, block: int):
    """(packed bytes, bit offset of every block)."""
    n = length[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    word, shift = at >> 5, 64 - (at & 31) - n
    v = code[ids] << shift.astype(np.uint64)
    words = (int(end[-1]) + 31 >> 5) + 2 if len(end) else 1
    # the bits of different codes are disjoint, so sums (exact below 2^53) are unions
    hi = np.bincount(word, weights=(v >> np.uint64(32)).astype(np.float64), minlength=words)
    lo = np.bincount(word + 1, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    return (hi + lo).astype(np.uint64).astype(">u4").tobytes(), at[::block].astype("<u8")


def decode_table(length: np.ndarray, max_bits: int):
    """For every prefix of ``max_bits`` bits: the id it starts with."""
    ids = np.flatnonzero(length)
    ids = ids[np.lexsort((ids, length[ids]))]
    reps = np.int64(1) << (max_bits - length[ids].astype(np.int64))
    sym = np.repeat(ids.astype(np.uint32), reps)
    if len(sym) < 1 << max_bits:
        sym = np.concatenate([sym, np.zeros((1 << max_bits) - len(sym), np.uint32)])
    return sym


def decode_bits(bits: bytes, at: np.ndarray, total: int, block: int,
                length: np.ndarray, max_bits: int) -> np.ndarray:
    """Ids of all blocks, decoded side by side from their checkpoints."""
    sym = decode_table(length, max_bits)
    w = np.frombuffer(bits, ">u4").astype(np.uint64)
    w = np.concatenate([w, np.zeros(2, np.uint64)])
    pos = at.astype(np.int64)
    out = np.zeros((len(pos), block), np.uint32)
    last = total - (len(pos) - 1) * block if len(pos) else 0
    for t in range(block if len(pos) > 1 else last):
        if t == last:
            pos = pos[:-1]           # the last block ends early
        i = pos >> 5
        two = (w[i] << np.uint64(32)) | w[i + 1]
        peek = (two << (pos & 31).astype(np.uint64)) >> np.uint64(64 - max_bits)
        s = sym[peek.astype(np.int64)]
        out[:len(pos), t] = s
        pos = pos + length[s]
    return out.reshape(-1)[:total]


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(key, ids, wide, tally): ids as little-endian uint16 where they fit, else
    uint32.  A task's last row is no document: it has ``tally``, how often
    each id occurred in the task."""
    bound_arrow(docs.sparkSession)

    def encode(batches):
        enc = word_encoder(tokenizer)
        wide = enc.tok.get_vocab_size() > 1 << 16 or (end_id or 0) >= 1 << 16
        kind, k = ("<u4", 4) if wide else ("<u2", 2)
        total = np.zeros(1 << 16, np.int64)
        names, counts = ["key", "ids", "wide", "tally"], pa.list_(pa.int64())
        for b in batches:
            ids, off = enc.encode(b.column(1), end_id)
            c = np.bincount(ids)
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[:len(c)] += c
            raw, off = ids.astype(kind).tobytes(), off.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([raw[k * a:k * z] for a, z in zip(off, off[1:])], pa.binary()),
                 pa.array([wide] * b.num_rows, pa.bool_()), pa.nulls(b.num_rows, counts)], names=names)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()),
                 pa.array([total], counts)], names=names)

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(
        encode, "key bigint, ids binary, wide boolean, tally array<bigint>")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


def count_ids(encoded: DataFrame) -> np.ndarray:
    """Occurrences of every id over the whole table, summed by Spark over the
    tasks' tallies; at most vocabulary-many rows reach the driver."""
    rows = (encoded.where("tally IS NOT NULL").select(F.posexplode("tally").alias("id", "n")).where("n > 0")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_token_files(encoded: DataFrame, length: np.ndarray, folder: str, max_bits: int,
                      block: int = 1024, file_tokens: int = 4_000_000) -> DataFrame:
    """Write the files in ascending key order; returns the manifest
    (part, seq, uri, documents, tokens), one row per file."""
    table = length.astype(np.uint8).tobytes()
    spark = encoded.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        size = np.frombuffer(table, np.uint8)
        code = canonical_codes(size)
        keys, chunks, held, seq = [], [], 0, 0

        def flush():
            ids = np.concatenate(chunks)
            bits, at = encode_bits(ids, size, code, block)
            head = struct.pack(HEAD, MAGIC, len(size), max_bits, block, len(keys), len(ids))
            docs = np.zeros(len(keys), [("key", "<i8"), ("null", "u1"), ("n", "<u4")])
            docs["key"] = [k or 0 for k in keys]
            docs["null"] = [k is None for k in keys]
            docs["n"] = [len(c) for c in chunks]
            uri = write_file(folder, f"ids-{part:06d}-{seq:05d}.huf",
                             [head, table, docs.tobytes(), at.tobytes(), bits])
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (uri, pa.string()),
                                               (len(keys), pa.int64()), (len(ids), pa.int64()))],
                names=["part", "seq", "uri", "documents", "tokens"])

        for b in batches:
            for k, raw, wide in zip(*(c.to_pylist() for c in b.columns[:3])):
                keys.append(k)
                chunks.append(_ids(raw, wide))
                held += len(chunks[-1])
                if held >= file_tokens:
                    yield flush()
                    keys, chunks, held, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    order = [F.col("key").asc_nulls_first(), F.crc32("ids").asc()]
    return (encoded.where("tally IS NULL").repartitionByRange(tasks, F.col("key").asc_nulls_first())
            .sortWithinPartitions(*order).select("key", "ids", "wide")
            .mapInArrow(write, "part int, seq int, uri string, documents bigint, tokens bigint"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(key, start, ids) of every document in the files of ``manifest``;
    ``start`` counts the ids of all documents before it."""
    spark = manifest.sparkSession
    # one row per file, some 16 MB of ids each: the listing, not the data
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["seq"]))
    rows, before = [], 0
    for r in files:
        rows.append((r["uri"], before))
        before += r["tokens"]
    todo = spark.createDataFrame(rows, "uri string, before bigint").repartition(max(1, len(rows)))

    def read(batches):
        for b in batches:
            for uri, before in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    raw = f.read()
                magic, n, max_bits, block, docs, total = struct.unpack_from(HEAD, raw)
                if magic != MAGIC:
                    raise ValueError(f"{uri}: not a token file")
                p = struct.calcsize(HEAD)
                length = np.frombuffer(raw, np.uint8, n, p)
                p += n
                d = np.frombuffer(raw, [("key", "<i8"), ("null", "u1"), ("n", "<u4")], docs, p)
                p += d.nbytes
                blocks = -(-total // block)
                at = np.frombuffer(raw, "<u8", blocks, p)
                p += at.nbytes
                ids = decode_bits(raw[p:], at, total, block, length, max_bits)
                end = np.cumsum(d["n"].astype(np.int64))
                data = ids.astype("<u4").tobytes()
                for s in range(0, docs, 512):
                    e = min(docs, s + 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(d["key"][s:e]), pa.int64(), mask=d["null"][s:e] == 1),
                         pa.array(before + end[s:e] - d["n"][s:e], pa.int64()),
                         pa.array([data[4 * (z - k):4 * z] for z, k in
                                   zip(end[s:e].tolist(), d["n"][s:e].tolist())], pa.binary())],
                        names=["key", "start", "ids"])

    return todo.mapInArrow(read, "key bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, max_bits: int = 20,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents, read them back: (id, start, ids)."""
    folder = workspace(docs.sparkSession, "token-files")
    encoded = stage(encode_texts(docs, tokenizer, end_id, id_col, text_col), folder, "encoded")
    length = code_lengths(count_ids(encoded), max_bits)
    manifest = stage(write_token_files(encoded, length, folder, max_bits), folder, "manifest")
    return read_token_files(manifest).withColumnRenamed("key", id_col)


def digests(back: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of documents that were read back."""
    return back.select(id_col, "start", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def crc_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
