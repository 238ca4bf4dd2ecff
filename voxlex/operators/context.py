"""Trailing text contexts and periodic refresh (survey E1-E4, H2/H3 text side).

A context of size ``ws`` is the current word plus the ``ws`` words before it
in the same sequence (``ws + 1`` words, fewer at the start).

Skew: a window partitioned by sequence would put a whole document in one
task.  Rows are instead cut into position blocks; the last ``ws`` rows of a
block are copied into the next blocks as a halo, texts are cut per
(sequence, block) and only each block's own rows are kept (``blocks``).  The result is
exact and no task holds more than one block plus its halo.  Positions must
be dense (see ``frames.renumber``).
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.operators import blocks as bl

# The wording of prompts and enriched texts.
HEADER_SUMMARY = "This is a summary of the text so far: "
SUMMARY_PROMPT_JOIN = " The continuation is: "
SUMMARY_JOIN = " : "
CONTINUATION_JOIN = ". This is the continuation of: "


def _block_size(ws: int, block: int | None) -> int:
    return block or max(1 << 14, 8 * (ws + 1))


def _with_halo(tok: DataFrame, ws: int, pos: str, block: int) -> DataFrame:
    blk = F.floor(F.col(pos) / F.lit(block)).cast("long")
    # a row is needed by every block that its next ``ws`` positions reach
    ids = F.sequence(blk, F.floor((F.col(pos) + F.lit(ws)) / F.lit(block)).cast("long"))
    return tok.withColumn("_blk", F.explode(ids)).withColumn("_own", F.col("_blk") == blk)


def context_windows(tok: DataFrame, sizes: dict, seq: str = "seq", pos: str = "pos",
                    word: str = "word", block: int | None = None, each=None) -> DataFrame:
    """Add one trailing-context column per ``{name: ws}`` in a single shuffle.

    ``each`` = (fields, function of a list of texts to one Arrow array per field, made once per task):
    the fields, named ``{name}_{field}``, take the place of the contexts.
    """
    if not sizes:
        return tok
    big = max(sizes.values())
    if big == 0 and not each:
        out = tok
        for name in sizes:
            out = out.withColumn(name, F.col(word))
        return out
    b = _block_size(big, block)
    others = [c for c in tok.columns if c not in (seq, pos, word)]
    flat = [seq, pos, word, *others]
    made = each[0] if each else [T.StructField("text", T.StringType())]
    spec = T.StructType([T.StructField(seq, tok.schema[seq].dataType), T.StructField("_p", T.LongType()),
                         *[T.StructField(f"_f{i}", tok.schema[c].dataType) for i, c in enumerate([word, *others])],
                         *[T.StructField(f"_x{i}_{f.name}", f.dataType) for i in range(len(sizes)) for f in made]])

    def run(batches):
        import pyarrow as pa
        kind, held, n, size = None, [], 0, 0
        to_fields = each[1]() if each else None

        def typed(batches):
            nonlocal kind
            for x in batches:
                kind = x.schema.field(0).type
                yield x

        def batch(held):
            own = pa.array([h[0] for h in held]).cast(kind).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held])))
            return pa.RecordBatch.from_arrays([own, *[pa.concat_arrays([h[k] for h in held]) for k in range(1, len(held[0]))]],
                                              names=spec.fieldNames())

        for s, blk, parts in bl.groups(typed(batches)):
            p, cols, _ = bl.rows_of(parts)
            text = bl.Joined(cols[0].to_pylist())
            own = int(np.searchsorted(p, blk * b))
            for i in range(own, len(p), 4096):
                at = np.arange(i, min(i + 4096, len(p)))
                rows = [c.slice(i, len(at)) for c in cols]
                texts = []
                for ws in sizes.values():
                    if to_fields:
                        texts += to_fields(text.many(np.maximum(at - ws, 0), at + 1))
                    else:
                        texts.append(rows[0] if ws == 0 else pa.array(text.many(np.maximum(at - ws, 0), at + 1), pa.string()))
                held.append((s, pa.array(p[at]), *rows, *texts))
                n, size = n + len(at), size + sum(t.nbytes for t in texts)
                if size > bl.BATCH_BYTES or n >= bl.BATCH_ROWS:
                    yield batch(held)
                    held, n, size = [], 0, 0
        if held:
            yield batch(held)

    t = bl.grouped(bl.fold(tok, seq, pos, [word, *others], b, big), seq).mapInArrow(run, spec)
    named = {seq: F.col(seq), pos: F.col("_p").cast(tok.schema[pos].dataType).alias(pos),
             **{c: F.col(f"_f{i}").alias(c) for i, c in enumerate(flat[2:])}}
    return t.select(*[named[c] for c in tok.columns], *[F.col(f"_x{i}_{f.name}").alias(f"{n}_{f.name}" if each else n)
                                                            for i, n in enumerate(sizes) for f in made])


def context_window(tok: DataFrame, ws: int, seq: str = "seq", pos: str = "pos",
                   word: str = "word", out: str = "context", block: int | None = None) -> DataFrame:
    """Trailing context text of ``ws`` preceding words plus the current one."""
    return context_windows(tok, {out: ws}, seq, pos, word, block)


def _trailing(p, text: bl.Joined, dense: bool, a: int, times: int, ws: int, chunk: int):
    """Words of the last ``ws + 1`` positions up to ``a``; None if there are none.

    Where positions repeat or are missing, words are counted from the first
    of the ``chunk`` positions that the range begins in; an anchor given
    ``times`` times sees every chunk as often.
    """
    lo = max(a - ws, 0)
    if dense and times == 1 and p[0] <= lo and a <= p[-1]:
        return text(lo - int(p[0]), a - int(p[0]) + 1)
    words, found = [], False
    for c in range(lo // chunk, a // chunk + 1):
        i, j = np.searchsorted(p, [c * chunk, (c + 1) * chunk])
        found |= i < j
        words += [w for w in text.words[i:j]] * times
    first = lo % chunk
    return " ".join([w for w in words[first:first + a - lo + 1] if w is not None]) if found else None


def trailing_text_at(tok: DataFrame, anchors: DataFrame, ws: int, seq: str = "seq", pos: str = "pos",
                     word: str = "word", out: str = "text", chunk: int = 64) -> DataFrame:
    """Trailing context of size ``ws`` computed only at anchor rows.

    For sparse anchors (a refresh every k words) this avoids building a
    ``ws``-word array for every row: words and anchors are folded into
    (sequence, block) rows before the one shuffle that brings them together
    (``blocks.fold``), and an anchor's text is cut from its block's words, so
    no word is shuffled once per anchor.  Anchors of no sequence are left out.
    """
    back = ws + chunk - 1
    block = chunk * -(-max(1 << 12, 8 * back) // chunk)
    words = bl.fold(tok, seq, pos, [word], block, back).withColumn("_as", F.lit(None).cast("array<bigint>"))
    asked = anchors.where(F.col(seq).isNotNull()).select(seq, F.col(pos).cast("bigint").alias("_a"))
    asked = bl.fold(asked, seq, "_a", ["_a"], block, runs=False).select(
        seq, "_blk", "_p", F.lit(None).cast("string").alias("_t"), F.array().cast(words.schema["_c0"].dataType).alias("_c0"), F.col("_c0").alias("_as"))
    spec = T.StructType([anchors.schema[seq], T.StructField("_a", T.LongType()), T.StructField("_t", T.StringType())])

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]).cast(kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                              names=spec.fieldNames())

        def typed(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        kind, rows, size = None, [], 0
        for s, _, parts in bl.groups(typed(batches)):
            at = Counter(a for _, c in parts if c[1] is not None for a in c[1].to_pylist())
            have = [(a, c[:1]) for a, c in parts if len(c[0])]
            if not at or not have or s is None:
                continue
            p, cols, dense = bl.rows_of(have)
            text = bl.Joined(cols[0].to_pylist())
            for a, times in at.items():
                t = _trailing(p, text, dense, a, times, ws, chunk)
                if t is None:
                    continue
                rows.append((s, a, t))
                size += len(t)
                if size > bl.BATCH_BYTES or len(rows) >= bl.BATCH_ROWS:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    t = bl.grouped(words.unionByName(asked), seq).mapInArrow(run, spec)
    return t.select(seq, F.col("_a").cast(anchors.schema[pos].dataType).alias(pos), F.col("_t").alias(out))


def refresh(tok: DataFrame, every: int, start: int = 0, pos: str = "pos") -> DataFrame:
    """Mark refresh rows and the anchor each row carries forward.

    Refresh rows: ``pos >= start`` and (``pos % every == 0`` or ``pos == start``).
    ``anchor``: the latest refresh row at or before ``pos`` (NULL before ``start``).
    """
    p = F.col(pos)
    is_ref = (p >= F.lit(start)) & (((p % F.lit(every)) == 0) | (p == F.lit(start)))
    anchor = F.when(p >= F.lit(start),
                    F.greatest(F.floor(p / F.lit(every)) * F.lit(every), F.lit(start)).cast("int"))
    return tok.withColumn("is_refresh", is_ref).withColumn("anchor", anchor)


def apply_text_fn(df: DataFrame, col: str, fn, out: str) -> DataFrame:
    """Run a text -> text function (generator, summariser) over a column.

    ``fn`` maps a pandas Series of strings to a Series of strings; it runs as
    an iterator pandas UDF over Arrow batches, so a model can be loaded once
    per task (``fn.load()`` if present) and called on whole batches.  A
    ``ColumnTextFn`` is evaluated as a JVM expression instead.
    """
    if isinstance(fn, ColumnTextFn):
        return df.withColumn(out, fn.column(F.col(col)))
    @F.pandas_udf("string")
    def _run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = fn.load() if hasattr(fn, "load") else fn
        for s in batches:
            yield pd.Series(f(s.fillna("")), index=s.index).astype(object)

    return df.withColumn(out, _run(F.col(col)))


class ColumnTextFn:
    """A text function expressed as a Spark column transform (JVM-side)."""

    def __init__(self, column):
        self.column = column


def identity_generator(s):
    """Test generator: returns its prompt (a generator echoes the prompt first)."""
    return s


def digest_text(s):
    """Test summariser: the md5 of the whole input, so that every word counts."""
    import hashlib
    return s.map(lambda t: hashlib.md5(t.encode()).hexdigest())


def _segments(tok: DataFrame, cut, fn, block: int, back: int, seq: str, pos: str, word: str, given: DataFrame | None = None,
              prefixes=None, frames=None) -> DataFrame:
    """One row per stretch of rows that share a generated text: (seq, _a, _gen, _o).

    ``cut(blk, p, text, dense, given)`` splits a block's rows into (anchor, prompt
    or None, given text or None, first row, end row, context starts, context ends);
    the generator runs on the prompts, batch by batch.  ``_o`` holds the rows
    with their contexts (``_ctx``).  ``given`` (seq, _blk, _a, _s): texts that are
    ready, brought to their blocks.

    ``frames`` = (frame column, model, pool, pool of the contexts or None, ws): the texts are embedded
    by the task that makes them and their means per frame are returned, also those of the contexts
    alone (``embed.prefixed_means``); no text leaves the task.  ``prefixes(sequence, anchors, generated texts, rows
    of each, positions)`` then gives the texts that stand before contexts (None: no text) and each row's place in them.
    """
    others = [c for c in tok.columns if c not in (seq, pos, word)]
    t = bl.fold(tok, seq, pos, [word, *others], block, back)
    if given is not None:
        t = t.withColumn("_a", F.lit(None).cast("bigint")).withColumn("_s", F.lit(None).cast("string"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema.fields[4:-2]]
        t = t.unionByName(given.select(seq, "_blk", F.lit(-1).cast("bigint").alias("_p"), F.lit(None).cast("string").alias("_t"),
                                         *none, "_a", "_s"))
    in_jvm = isinstance(fn, ColumnTextFn)
    row = T.StructType([T.StructField("_p", T.LongType()), T.StructField("_w", tok.schema[word].dataType),
                        *[T.StructField(c, tok.schema[c].dataType) for c in others], T.StructField("_ctx", T.StringType())])
    spec = T.StructType([T.StructField(seq, tok.schema[seq].dataType), T.StructField("_a", T.LongType()),
                         T.StructField("_src", T.StringType()), T.StructField("_gen", T.StringType()),
                         T.StructField("_o", T.ArrayType(row))])
    n_given = 2 if given is not None else 0

    def stretches(batches):
        for s, blk, parts in bl.groups(batches):
            ready = {c[-2][0].as_py(): c[-1][0].as_py() for a, c in parts if a < 0} if n_given else {}
            have = [(a, c[:len(c) - n_given]) for a, c in parts if a >= 0]
            if have:
                p, cols, dense = bl.rows_of(have)
                text = bl.Joined(cols[0].to_pylist())
                yield s, int(np.searchsorted(p, blk * block)), p, cols, text, cut(blk, p, text, dense, ready)

    if frames:
        from voxlex.operators.embed import prefixed_means
        return prefixed_means(bl.grouped(t, seq), stretches, fn, prefixes, tok.schema[frames[0]].dataType,
                              1 + others.index(frames[0]), *frames)

    def run(batches):
        import pyarrow as pa
        f = None if in_jvm or fn is None else fn.load() if hasattr(fn, "load") else fn
        kind, held, size = None, [], 0

        def typed(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b if not n_given else pa.RecordBatch.from_arrays(
                    b.columns[:-2] + [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), c) for c in b.columns[-2:]],
                    names=b.schema.names)

        def batch(held):
            src = [h[2] for h in held]
            gen = [h[3] for h in held]
            ask = [i for i, x in enumerate(src) if x is not None]
            if f is not None and ask:
                for i, g in zip(ask, pd.Series(f(pd.Series([src[i] for i in ask]))).astype(object)):
                    gen[i] = None if g is None or g != g else g
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h[4]) for h in held])]).astype(np.int32))
            cols = [pa.concat_arrays([h[4 + k] for h in held]) for k in range(len(held[0]) - 4)]
            rows = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, names=row.fieldNames()))
            texts = pa.array(src if in_jvm else [None] * len(held), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]).cast(kind), pa.array([h[1] for h in held], pa.int64()), texts,
                                               pa.array(gen, pa.string()), rows], names=spec.fieldNames())

        for s, _, p, cols, text, pieces in stretches(typed(batches)):
            for a, src, done, i, j, lo, hi in pieces:
                ctx = text.many(lo, hi)
                held.append((s, a, src, done, pa.array(p[i:j]), *[c.slice(i, j - i) for c in cols], pa.array(ctx, pa.string())))
                size += sum(map(len, ctx)) + len(src or "")
                if size > bl.BATCH_BYTES or len(held) >= bl.BATCH_ROWS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    t = bl.grouped(t, seq).mapInArrow(run, spec)
    if in_jvm:
        t = t.withColumn("_gen", fn.column(F.col("_src")))
    return t.select(seq, "_a", "_gen", F.explode_outer("_o").alias("_o")).select(
        F.col(seq), "_a", "_gen", F.col("_o._p").cast(tok.schema[pos].dataType).alias(pos), F.col("_o._w").alias(word),
        *[F.col("_o")[c].alias(c) for c in others], F.col("_o._ctx").alias("_ctx"))


def with_continuation(tok: DataFrame, ws: int, generator, every: int = 10, prompt_ws: int = 29,
                      seq: str = "seq", pos: str = "pos", word: str = "word", out: str = "text",
                      anchors_per_block: int = 64, frames=None) -> DataFrame:
    """Context text prefixed by a generated continuation refreshed every ``every`` words.

    One shuffle brings the folded words into (sequence, block) rows of a bounded
    length with a halo; an anchor and the rows it serves lie in the same
    block, so contexts and prompts are cut from that block and nothing is
    joined.  The generator runs on one text per anchor.
    Text: ``generated + ". This is the continuation of: " + context``.
    ``frames``: not the texts but their stimulus (``_segments``).
    """
    back, block = max(ws, prompt_ws), every * anchors_per_block

    def cut(blk, p, text, dense, given):
        first, last, n = int(p[0]), int(p[-1]), len(p)
        if dense and first <= blk * block:
            begin, end = np.maximum(np.arange(n) - ws, 0), np.arange(n) + 1
            for u in range(blk * block - first, n, every):
                v = min(u + every, n)
                yield u + first, text(max(u - prompt_ws, 0), u + 1), None, u, v, begin[u:v], end[u:v]
            return
        for a in range(blk * block, last + 1, every):
            # positions are taken as dense from the first row of the stretch
            lo = max(a - back, first)
            i, end = lo - first, min(lo - first + min(a + every - 1, last) - lo + 1, n)
            if i >= n:
                continue
            q = int(p[i])
            u, v = min(i + a - q, end), min(i + a - q + every, end)
            x = p[u:v]
            begin = np.maximum(x - ws, q)
            low = max(a - prompt_ws, q)
            yield (a, text(min(i + low - q, end), min(i + a - q + 1, end)), None, u, v,
                   np.minimum(i + begin - q, end - 1), np.minimum(i + x - q + 1, end))

    def prefixes(s, anchors, made, sizes, p):
        return [None if g is None else g + CONTINUATION_JOIN for g in made], np.repeat(np.arange(len(made)), sizes)

    t = _segments(tok, cut, generator, block, back, seq, pos, word, prefixes=prefixes, frames=frames)
    if frames:
        return t
    others = [c for c in tok.columns if c not in (seq, pos, word)]
    return t.select(seq, pos, word, *others, F.concat("_gen", F.lit(CONTINUATION_JOIN), "_ctx").alias(out))


def _summary_block(start: int, every: int, back: int) -> int:
    """Positions of a block: whole stretches of ``every``, the first anchor in the first block."""
    return every * -(-max(1 << 12, 8 * (back + 1), start + 1) // every)


def _summary_cut(ws: int, start: int, every: int, block: int, prompt):
    """Stretches of rows that carry one anchor's summary (``refresh``), rows before the first anchor alone."""
    def cut(blk, p, text, dense, given):
        own = int(np.searchsorted(p, blk * block))
        lo = np.maximum(np.arange(len(p)) - ws, 0)
        anchor = np.where(p >= start, np.maximum(p // every * every, start), -1)[own:]
        edges = own + np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if i < j:
                a = int(anchor[i - own])
                times = int(np.searchsorted(p, a, "right") - np.searchsorted(p, a)) if a >= 0 else 0
                yield (a, prompt(p, text, dense, a, times) if prompt and times else None, given.get(a), i, j,
                       lo[i:j], np.arange(i, j) + 1)
    return cut


def with_summary(tok: DataFrame, ws: int, summarizer, start: int = 20, every: int = 30,
                 hold: bool = False, summary_ws: int = 499, seq: str = "seq", pos: str = "pos",
                 word: str = "word", out: str = "text", frames=None) -> DataFrame:
    """Context text prefixed by a running summary of the last ``summary_ws + 1`` words.

    Rows before ``start`` keep the plain context.  Refresh rows summarise
    ``header + " The continuation is: " + last words``.  ``hold=False``
    reproduces the original loop, where the summary variable is reset every
    word so only refresh rows see a summary and the others get the bare
    header; ``hold=True`` carries the latest summary forward (the stated
    intent).  Text: ``summary + " : " + context``.  One shuffle of folded
    words: an anchor, its words and the rows it serves lie in the same block.
    ``frames``: not the texts but their stimulus (``_segments``).
    """
    chunk = 64
    back = max(ws, summary_ws + chunk - 1)
    block = every * chunk // math.gcd(every, chunk)
    block *= -(-_summary_block(start, every, back) // block)

    def prompt(p, text, dense, a, times):
        t = _trailing(p, text, dense, a, times, summary_ws, chunk)
        return None if t is None else HEADER_SUMMARY + SUMMARY_PROMPT_JOIN + t

    def prefixes(s, anchors, made, sizes, p):
        texts = ["", HEADER_SUMMARY + SUMMARY_JOIN]
        own = np.zeros(len(made), np.int64)
        for k, (a, g) in enumerate(zip(anchors, made)):
            if a >= 0 and (s is None or g is None):
                own[k] = 1
            elif a >= 0:
                own[k] = len(texts)
                texts.append(HEADER_SUMMARY + g + SUMMARY_JOIN)
        at = np.repeat(own, sizes)
        return texts, at if hold else np.where((at > 0) & (p != np.repeat(anchors, sizes)), 1, at)

    t = _segments(tok, _summary_cut(ws, start, every, block, prompt), summarizer, block, back, seq, pos, word,
                  prefixes=prefixes, frames=frames)
    if frames:
        return t
    seen = F.col(seq).isNotNull()
    if not hold:
        seen &= F.col(pos) == F.col("_a")
    return _summary_rows(tok, t, F.when(seen, F.concat(F.lit(HEADER_SUMMARY), F.col("_gen"))), start, seq, pos, word, out)


def _summary_rows(tok: DataFrame, t: DataFrame, summary, start: int, seq: str, pos: str, word: str, out: str) -> DataFrame:
    prefix = F.coalesce(summary, F.lit(HEADER_SUMMARY))
    text = F.when(F.col(pos) < F.lit(start), F.col("_ctx")).otherwise(F.concat(prefix, F.lit(SUMMARY_JOIN), F.col("_ctx")))
    others = [c for c in tok.columns if c not in (seq, pos, word)]
    return t.select(seq, pos, word, *others, text.alias(out))


def _pieces(blk: int, parts, block: int, start: int, every: int) -> list:
    """(anchor, words) of a block of rows: the words after the previous refresh row up to each refresh row
    (the first takes all before it).  Words after the last refresh row belong to none."""
    p, cols, _ = bl.rows_of(parts)
    text = bl.Joined(cols[0].to_pylist())
    low, out = blk * block, []
    for a in sorted({start, *range(max(low, start // every * every + every), int(p[-1]) + 1, every)}):
        after = -1 if a == start else max(a - every, start)
        i, j = np.searchsorted(p, [after, a], "right")
        if low <= a < low + block and i < j and p[j - 1] == a:
            out.append((a, text(i, j)))
    return out


def cumulative_summaries(tok: DataFrame, summarizer, start: int = 20, every: int = 30, seq: str = "seq",
                         pos: str = "pos", word: str = "word", segment: int = 1024, together: int = 64) -> DataFrame:
    """(seq, anchor, summary): each summary is made from the one before it and the
    words since, ``header + summary + " The continuation is: " + words``.

    A fold in anchor order per sequence.  Sequences advance side by side: a
    task holds ``together`` of them and calls the summariser once per step
    for all.  A sequence advances by ``segment`` anchors a round; the summaries of a round are
    written (compressed), so a lost executor costs one segment, and a task never holds more than
    ``together * segment`` pieces.  The first segment is folded by the task that has its words;
    only the words of later ones are written for their rounds.  Rounds end with the longest sequence.
    """
    from voxlex.session import stage_folder
    spark = tok.sparkSession
    block = every * max(segment, -(-(start + 1) // every))
    kind = tok.schema[seq].dataType
    spec = T.StructType([T.StructField(seq, kind), T.StructField("anchor", T.IntegerType()), T.StructField("words", T.StringType()),
                         T.StructField("summary", T.StringType()), T.StructField("_part", T.IntegerType())])

    def batch(rows, key):
        import pyarrow as pa
        types = (key, pa.int32(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) if t != key else pa.array(c).cast(t)
                                           for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=spec.fieldNames())

    def fold(group, f, part):
        """``group``: [sequence, state, [(anchor, words)]]; all advance step by step."""
        out = []
        for i in range(max((len(g[2]) for g in group), default=0)):
            live = [g for g in group if i < len(g[2])]
            texts = [HEADER_SUMMARY + g[1] + SUMMARY_PROMPT_JOIN + g[2][i][1] for g in live]
            for g, new in zip(live, f(pd.Series(texts))):
                g[1] = new
                out.append((g[0], g[2][i][0], None, new, part))
        return out

    def first(batches):
        f = summarizer.load() if hasattr(summarizer, "load") else summarizer
        key, group = None, []

        def typed(batches):
            nonlocal key
            for b in batches:
                key = b.schema.field(0).type
                yield b

        for s, blk, parts in bl.groups(typed(batches)):
            pieces = _pieces(blk, parts, block, start, every)
            if blk:
                for i in range(0, len(pieces), segment):
                    yield batch([(s, a, words, None, blk) for a, words in pieces[i:i + segment]], key)
            elif pieces:
                group.append([s, "", pieces])
                if len(group) >= together:
                    yield batch(fold(group, f, 0), key)
                    group = []
        if group:
            yield batch(fold(group, f, 0), key)

    def later(r):
        def run(batches):
            f = summarizer.load() if hasattr(summarizer, "load") else summarizer
            group, key = [], None
            for b in batches:
                key = b.schema.field(0).type
                for s, a, words, state in zip(*(b.column(k).to_pylist() for k in range(4))):
                    if not group or group[-1][0] != s:
                        if len(group) >= together:
                            yield batch(fold(group, f, r), key)
                            group = []
                        group.append([s, "", []])
                    if a < 0:
                        group[-1][1] = state
                    else:
                        group[-1][2].append((a, words))
            if group:
                yield batch(fold(group, f, r), key)
        return run

    def staged(df):
        path = stage_folder(spark, "stage-summaries") + "/table"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(spec).parquet(path)

    rows = staged(bl.grouped(bl.fold(tok, seq, pos, [word], block, max(every, start)), seq).mapInArrow(first, spec))
    pieces, done = rows.where(F.col("words").isNotNull()), rows.where(F.col("words").isNull())
    last = pieces.agg(F.max("_part")).first()[0]
    out = done
    for r in range(1, (last if last is not None else 0) + 1):
        rows = pieces.where(F.col("_part") == r).drop("_part")
        state = (done.join(rows.select(seq).distinct(), seq, "left_semi").groupBy(seq).agg(F.max_by("summary", "anchor").alias("summary"))
                 .select(seq, F.lit(-1).alias("anchor"), F.lit("").alias("words"), "summary"))
        done = staged(rows.unionByName(state).repartition(seq).sortWithinPartitions(seq, "anchor").mapInArrow(later(r), spec))
        out = out.unionByName(done)
    return out.select(seq, "anchor", "summary")


def with_cumulative_summary(tok: DataFrame, ws: int, summarizer, start: int = 20, every: int = 30, seq: str = "seq",
                            pos: str = "pos", word: str = "word", out: str = "text", segment: int = 1024) -> DataFrame:
    """``with_summary`` whose summaries accumulate: rows from ``start`` on carry the
    latest of ``cumulative_summaries`` in front of their context."""
    block = _summary_block(start, every, ws)
    summ = cumulative_summaries(tok.select(seq, pos, word), summarizer, start, every, seq, pos, word, segment)
    summ = summ.where(F.col(seq).isNotNull()).select(
        seq, F.floor(F.col("anchor") / block).cast("bigint").alias("_blk"), F.col("anchor").cast("bigint").alias("_a"), F.col("summary").alias("_s"))
    t = _segments(tok, _summary_cut(ws, start, every, block, None), None, block, ws, seq, pos, word, summ)
    return _summary_rows(tok, t, F.concat(F.lit(HEADER_SUMMARY), F.col("_gen")), start, seq, pos, word, out)
