"""Rows of sequences folded into blocks of positions (text side of E1-E4).

Words arrive as one row each, in runs of consecutive positions.  A task folds
every run into one row of arrays before anything is shuffled, so the shuffle
carries the words themselves and little else; a block gets the last ``back``
rows before it as a halo.  After the shuffle a task takes one block at a time.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text and rows that a task gathers before it hands a batch on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def partitions(df: DataFrame) -> int:
    """Work outweighs the bytes of words: partitions by cores, not coalesced by size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def fold(df: DataFrame, seq: str, pos: str, cols, block: int, back: int = 0, runs: bool = True) -> DataFrame:
    """(seq, _blk, _p, _t, one array per column): runs of rows of one block as they lie in
    their partition, ``_p`` the first position.  A row also goes to every later block that its next
    ``back`` positions reach.  ``runs=False`` folds rows whose positions do not follow each other;
    rows without a position are left out.  Words of the first column travel as one text
    (``_t``) with line ends between, unless a word is null or has one itself."""
    cols = list(cols)
    plain = isinstance(df.schema[cols[0]].dataType, T.StringType)
    spec = T.StructType([T.StructField(seq, df.schema[seq].dataType), T.StructField("_blk", T.LongType()),
                         T.StructField("_p", T.LongType()), T.StructField("_t", T.StringType())]
                        + [T.StructField(f"_c{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(cols)])
    names = spec.fieldNames()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        def out(ids, blk, p, offsets, cols, joined):
            offsets = pa.array(offsets.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, c) for c in cols]
            text = pa.nulls(len(p), pa.string())
            if joined:
                text, lists[0] = pc.binary_join(lists[0], "\n"), pa.nulls(len(p), lists[0].type)
            return pa.RecordBatch.from_arrays([ids, pa.array(blk), pa.array(p), text, *lists], names=names)

        for b in batches:
            if b.column(1).null_count:
                b = b.filter(pc.is_valid(b.column(1)))
            n = b.num_rows
            if not n:
                continue
            p = b.column(1).to_numpy().astype(np.int64)
            s = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            blk = p // block
            cut = (s[1:] != s[:-1]) | (blk[1:] != blk[:-1])
            if runs:
                cut |= p[1:] != p[:-1] + 1
            first = np.concatenate([[0], np.flatnonzero(cut) + 1])
            end = np.append(first[1:], n)
            columns = b.columns[2:]
            joined = plain and not columns[0].null_count and not pc.any(pc.match_substring(columns[0], "\n")).as_py()
            yield out(b.column(0).take(pa.array(first)), blk[first], p[first], np.append(first, n), columns, joined)
            for d in range(1, -(-back // block) + 1 if back else 1):
                to = blk[first] + d
                f = np.maximum(first, first + to * block - back - p[first])
                keep = f < end
                if not keep.any():
                    break
                f, size, to = f[keep], (end - f)[keep], to[keep]
                offsets = np.concatenate([[0], np.cumsum(size)])
                rows = pa.array(np.arange(offsets[-1]) + np.repeat(f - offsets[:-1], size))
                yield out(b.column(0).take(pa.array(f)), to, p[f], offsets, [c.take(rows) for c in columns], joined)

    picked = [F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)]
    return df.select(F.col(seq), F.col(pos).cast("bigint").alias("_p"), *picked).mapInArrow(run, spec)


def grouped(folded: DataFrame, seq: str) -> DataFrame:
    """The pieces of a block beside each other, in order of position."""
    return folded.repartition(partitions(folded), seq, "_blk").sortWithinPartitions(seq, "_blk", "_p")


def groups(batches) -> Iterator[tuple]:
    """(sequence, block, [(first position, [array per column])]) from sorted pieces."""
    import pyarrow.compute as pc
    key, parts = None, []
    for b in batches:
        text, cols = b.column(3), b.columns[4:]
        words = pc.split_pattern(text, "\n")
        for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if k != key:
                if parts:
                    yield *key, parts
                key, parts = k, []
            lists = [c[i].values for c in cols]
            if text[i].is_valid:
                lists[0] = words[i].values
            parts.append((b.column(2)[i].as_py(), lists))
    if parts:
        yield *key, parts


def rows_of(parts) -> tuple:
    """(positions, columns, dense) of the pieces of a block, by position and then by
    the first column; ``dense`` if every position is there once."""
    import pyarrow as pa
    p = np.concatenate([np.arange(a, a + len(c[0])) for a, c in parts])
    cols = [pa.concat_arrays([c[i] for _, c in parts]) for i in range(len(parts[0][1]))]
    dense = bool((p[1:] == p[:-1] + 1).all())
    if not dense:
        w = cols[0].to_pylist()
        order = sorted(range(len(p)), key=lambda i: (p[i], w[i] is not None, w[i].encode() if isinstance(w[i], str) else w[i]))
        p, cols = p[order], [c.take(pa.array(order)) for c in cols]
    return p, cols, dense


class Joined:
    """Any stretch of a list of words as one text, single spaces between; words that are null are passed over."""

    def __init__(self, words: list):
        self.words = words
        self.text = None
        if None not in words:
            self.text = " ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            self.end = np.cumsum(size + 1) - 1
            self.start = self.end - size

    def __call__(self, a: int, b: int) -> str:
        """Words a to b - 1."""
        if a >= b:
            return ""
        if self.text is None:
            return " ".join([w for w in self.words[a:b] if w is not None])
        return self.text[self.start[a]:self.end[b - 1]]

    def many(self, a, b) -> list:
        """The same for arrays of stretches, none of them empty."""
        if self.text is None:
            return [self(x, y) for x, y in zip(a.tolist(), b.tolist())]
        t = self.text
        return [t[x:y] for x, y in zip(self.start[a].tolist(), self.end[b - 1].tolist())]
