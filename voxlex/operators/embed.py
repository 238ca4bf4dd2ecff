"""Batch embedding and vector pooling (survey H1, D2, D14).

``embed`` is the distributed batch call: a model turns each text into token
vectors and the tokens are pooled (mean, or last token).  Two model kinds:

* ``HashEmbedder`` - a deterministic bag-of-tokens stand-in whose token
  vectors are JVM expressions (md5 based, identical in DuckDB), used for
  tests and benchmarks;
* any object with ``encode(texts) -> list[ndarray(tokens, dim)]`` - run as an
  iterator pandas UDF over Arrow batches, model loaded once per worker;
  ``TextHashEmbedder`` is a stand-in of this kind.

For additive token models the trailing-window embedding can be computed
without materialising the context text (``embed_context_windows``).
"""

from __future__ import annotations

import re
import uuid
from itertools import chain
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlex.functions.cache import worker_cache
from voxlex.functions.scalar import hash_unit, tokens

try:
    from _md5 import md5        # the same digests, less work per short text
except ImportError:
    from hashlib import md5

_JAVA_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_NOT_SINGLE_SPACED = re.compile(r"[\t\n\x0b\f\r]|  ")


def _tokens(text: str) -> list:
    """Whitespace tokens exactly as the JVM's ``split(trim(t), '\\s+')``."""
    return _JAVA_SPACE.split(text.strip(" "))


def _token_lists(texts) -> list:
    """``_tokens`` of every text; a batch whose only white space is single
    spaces (every generated context) takes ``str.split``."""
    if _NOT_SINGLE_SPACED.search("\x01".join(texts)):
        return [_tokens(t) for t in texts]
    return [t.strip(" ").split(" ") for t in texts]


def _last_tokens(texts) -> list:
    """The last of ``_tokens`` of every text, the others not made."""
    if _NOT_SINGLE_SPACED.search("\x01".join(texts)):
        return [_tokens(t)[-1] for t in texts]
    return [t.strip(" ").rpartition(" ")[2] for t in texts]


def _token_stretches(texts, ids) -> tuple:
    """(row of every token met, first and end in them of the ``_tokens`` of every text); ``ids`` maps a token to its row.

    A text that is the one before it, with or without its first token, and
    more words (as the contexts of a sliding window are) has only these words
    split; texts with other white space than single spaces are split one by one.
    """
    words, starts, ends = [], [], []
    tail, start = "", 0
    for t in texts:
        cut = tail.find(" ") + 1
        if cut and t.startswith(rest := f"{tail[cut:]} "):
            start += 1
            words += t[len(rest):].split(" ")
        elif tail and t.startswith(rest := f"{tail} "):
            words += t[len(rest):].split(" ")
        else:
            start = len(words)
            words += t.split(" ")
        starts.append(start)
        ends.append(len(words))
        tail = t
    if "" in words or _JAVA_SPACE.search("\x01".join(words)):
        lists = _token_lists(texts)
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return ids.ids(list(chain.from_iterable(lists))), np.concatenate([[0], ends[:-1]])[:len(ends)], ends
    return ids.ids(words), np.array(starts, np.int64), np.array(ends, np.int64)


def _token_ids(texts, ids) -> tuple:
    """(row of every token of all ``_tokens``, tokens of every text)."""
    rows, starts, ends = _token_stretches(texts, ids)
    counts = ends - starts
    return rows.take(np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)), counts


class _TokenRows(dict):
    """Token -> row of its md5 vector; a token met for the first time gets the next row."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim, self.rows = dim, np.zeros((1024, dim))
        self.marks = [f"#{j}".encode() for j in range(dim)]

    def ids(self, tokens: list) -> np.ndarray:
        """Rows of the tokens; those met for the first time are hashed together."""
        found = list(map(self.get, tokens))
        if None in found:
            new = dict.fromkeys(t for t, i in zip(tokens, found) if i is None)
            n = len(self)
            while n + len(new) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            h = [md5(word + mark).digest() for word in map(str.encode, new) for mark in self.marks]
            h = np.frombuffer(b"".join(h), ">u4")[::4].astype(np.int64).reshape(len(new), self.dim)
            self.rows[n:n + len(new)] = (h % 2001 - 1000) / 1000.0
            self.update(zip(new, range(n, n + len(new))))
            found = list(map(self.__getitem__, tokens))
        return np.array(found, np.int64)


class HashEmbedder:
    """md5 token vectors: ``v[j] = (int(md5(tok#j)[:8], 16) % 2001 - 1000) / 1000``.

    Two equivalent implementations: JVM expressions (``pooled_column``,
    identical in DuckDB) and a vectorised batch path that hashes each
    distinct token once per Python worker (``encode_pooled``).  The batch
    path is the faster one - it skips repeated md5 calls for repeated
    tokens - and is what ``embed`` uses unless ``jvm=True``.
    """

    def __init__(self, dim: int, max_vocab: int = 100_000, fused: bool = True):
        """``max_vocab`` bounds a worker's table of token vectors (a fuller one
        is started anew, results stay); ``fused=False`` makes analyses embed
        the context texts instead of summing word vectors."""
        self.dim = int(dim)
        self.max_vocab = int(max_vocab)
        self.fused = bool(fused)

    # JVM path -------------------------------------------------------------
    def pooled_column(self, text, pool: str = "mean"):
        toks = tokens(text)
        if pool == "last":
            last = F.element_at(toks, -1)
            return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda j: hash_unit(last, j))
        return F.transform(
            F.sequence(F.lit(0), F.lit(self.dim - 1)),
            lambda j: F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + hash_unit(t, j)) / F.size(toks))

    # Batch path -------------------------------------------------------------
    def _vocab(self):
        c = worker_cache(f"hash-vocab-{self.dim}")
        if "ids" not in c or len(c["ids"]) >= self.max_vocab:
            c["ids"] = _TokenRows(self.dim)
        return c["ids"]

    @staticmethod
    def _ids(toks_iter, c) -> np.ndarray:
        return c.ids(list(toks_iter))

    def vectors(self, words) -> np.ndarray:
        """(n, dim) token vectors of single words."""
        c = self._vocab()
        ids = self._ids(words, c)
        return c.rows[ids]

    def encode_pooled(self, texts, pool: str = "mean") -> np.ndarray:
        """(n, dim) pooled vectors of whitespace-tokenised texts."""
        c = self._vocab()
        if pool == "last":
            ids = self._ids(_last_tokens(texts), c)
            return c.rows[ids]
        ids, counts = _token_ids(texts, c)
        rows = c.rows.take(ids, axis=0)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums = np.add.reduceat(rows, starts, axis=0) if len(rows) else np.zeros((0, self.dim))
        return sums / counts[:, None]

    def token_rows(self, texts) -> tuple:
        """(vectors of all tokens, end of every text in them)."""
        c = self._vocab()
        ids, counts = _token_ids(texts, c)
        return c.rows.take(ids, axis=0), np.cumsum(counts)

    def encode(self, texts):
        """Token matrices per text (the generic model protocol)."""
        rows, ends = self.token_rows(texts)
        ends = ends.tolist()
        return [rows[a:b] for a, b in zip([0, *ends], ends)]


class TextHashEmbedder:
    """A stand-in for a contextual model, by the generic ``encode`` protocol.

    Tokens have the vectors of ``HashEmbedder``, except the last one, whose
    vector is hashed from the whole text; so both poolings depend on every
    word.
    """

    def __init__(self, dim: int):
        self.dim = int(dim)

    def encode(self, texts):
        rows, ends = HashEmbedder(self.dim).token_rows(texts)
        rows[ends - 1] = self._last(texts)
        ends = ends.tolist()
        return [rows[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pooled(self, texts, pool: str = "mean") -> np.ndarray:
        """(n, dim) pooled vectors; a text's sum is the difference of two running totals of the tokens met."""
        last = self._last(texts)
        if pool == "last" or not len(texts):
            return last
        c = HashEmbedder(self.dim)._vocab()
        ids, starts, ends = _token_stretches(texts, c)
        total = np.vstack([np.zeros(self.dim), np.cumsum(c.rows.take(ids, axis=0), axis=0)])
        return (total[ends - 1] - total[starts] + last) / (ends - starts)[:, None]

    def _last(self, texts) -> np.ndarray:
        """Vectors of the last tokens."""
        *marks, last = [f"#{j}".encode() for j in range(self.dim)]
        digests = []
        for t in texts:
            whole = md5(t.encode())                # read once, not once per element
            for mark in marks:
                h = whole.copy()
                h.update(mark)
                digests.append(h.digest())
            whole.update(last)
            digests.append(whole.digest())
        last = np.frombuffer(b"".join(digests), ">u4")[::4].astype(np.int64).reshape(len(texts), self.dim)
        return (last % 2001 - 1000) / 1000.0


def load_once(model, token: str):
    """The loaded model of this worker process (``model.load()`` if it has
    one); earlier jobs' models are let go."""
    cache = worker_cache("models")
    if token not in cache:
        cache.clear()
        cache[token] = model.load() if hasattr(model, "load") else model
    return cache[token]


def pooled_batch(model, texts: list, pool: str) -> np.ndarray:
    """(texts, dim) pooled vectors by either protocol."""
    if hasattr(model, "encode_pooled"):
        return np.asarray(model.encode_pooled(texts, pool), dtype=float)
    mats = list(model.encode(texts))
    if pool == "last":
        return np.array([a[-1] for a in mats], dtype=float)
    if not mats:
        return np.zeros((0, 0))
    size = np.fromiter(map(len, mats), np.int64, len(mats))
    return np.add.reduceat(np.concatenate(mats, dtype=float, casting="unsafe"), np.cumsum(size) - size, axis=0) / size[:, None]


def embed(df: DataFrame, text_col: str, model, pool: str = "mean", out: str = "x",
          jvm: bool = False) -> DataFrame:
    """One pooled vector per row of ``text_col``.

    Runs as an Arrow-batched iterator pandas UDF; the model is loaded once
    per worker process (``model.load()`` when present).  Models with
    ``encode_pooled(texts, pool)`` return pooled vectors directly; others
    return token matrices via ``encode(texts)`` and are pooled here.
    ``jvm=True`` evaluates a ``HashEmbedder`` as JVM expressions instead.
    """
    if pool not in ("mean", "last"):
        raise ValueError("pool must be 'mean' or 'last'")
    if jvm:
        if not isinstance(model, HashEmbedder):
            raise ValueError("only HashEmbedder has a JVM form")
        return df.withColumn(out, model.pooled_column(F.col(text_col), pool))

    dim = getattr(model, "dim", None)
    token = model.__dict__.setdefault("_token", uuid.uuid4().hex) if hasattr(model, "__dict__") else str(id(model))
    if dim is not None and hasattr(model, "encode_pooled"):
        # Known width: return columns (a struct), which Arrow converts
        # column-wise, and assemble the array in the JVM.
        fields = [f"v{j}" for j in range(dim)]

        @F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in fields]))
        def _cols(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = load_once(model, token)
            for s in batches:
                mat = m.encode_pooled(list(s.fillna("")), pool)
                yield pd.DataFrame(mat, columns=fields, index=s.index)

        t = df.withColumn("_emb", _cols(F.col(text_col)))
        return t.withColumn(out, F.array(*[F.col("_emb")[f] for f in fields])).drop("_emb")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = load_once(model, token)
        for s in batches:
            yield pd.Series(list(pooled_batch(m, list(s.fillna("")), pool)), index=s.index)

    return df.withColumn(out, _run(F.col(text_col)))


def embed_contexts(tok: DataFrame, ws: int, model, pool: str = "mean", seq: str = "seq", pos: str = "pos",
                   word: str = "word", out: str = "x", block: int | None = None) -> DataFrame:
    """``embed(context_window(tok, ws), model, pool)`` in one pass over folded words.

    Every context is made and given to the model as text, in the task that has
    its words, so none is sent between the JVM and Python.  Keeps the columns of ``tok``.
    """
    from voxlex.operators.context import context_windows
    if pool not in ("mean", "last"):
        raise ValueError("pool must be 'mean' or 'last'")
    token = model.__dict__.setdefault("_token", uuid.uuid4().hex) if hasattr(model, "__dict__") else str(id(model))
    fields = [T.StructField(f"v{j}", T.DoubleType()) for j in range(model.dim)]

    def loaded():
        import pyarrow as pa
        m = load_once(model, token)
        return lambda texts: [pa.array(v) for v in np.ascontiguousarray(pooled_batch(m, texts, pool).T)]

    t = context_windows(tok, {"_e": ws}, seq, pos, word, block, each=(fields, loaded))
    return t.select(*tok.columns, F.array(*[F.col(f"_e_{f.name}") for f in fields]).alias(out))


def token_vectors(df: DataFrame, model: HashEmbedder, word: str = "word", prefix: str = "_v") -> DataFrame:
    """Add ``{prefix}{j}`` columns: the model's vector of each single word.

    Arrow-batched; each distinct word is hashed once per Python worker.
    """
    fields = [f"v{j}" for j in range(model.dim)]

    @F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in fields]))
    def _vec(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(model.vectors(list(s.fillna(""))), columns=fields, index=s.index)

    t = df.withColumn("_tv", _vec(F.col(word)))
    return t.select(*df.columns, *[F.col("_tv")[f].alias(f"{prefix}{j}") for j, f in enumerate(fields)])


def _window_means(tok: DataFrame, sizes, model: HashEmbedder, seq: str, pos: str, word: str,
                  block: int | None, keep=()) -> DataFrame:
    """Per-row mean token vector of each trailing window, as scalar columns ``_m{ws}_{j}``.

    Each word's vector is computed once (``token_vectors``).  A window sum is
    a running total minus the running total ``ws + 1`` rows earlier (one
    cumulative frame and one ``lag``: constant work per row whatever the
    window size), evaluated per (sequence, block) with a halo of the
    largest window so no task holds a whole document.  Positions are dense,
    so a window holds ``least(ws + 1, pos + 1)`` words.
    """
    from voxlex.operators.context import _block_size, _with_halo
    sizes = [int(s) for s in sizes]
    dims = range(model.dim)
    big = max(sizes)
    cols = [seq, pos, word, *keep]
    if big == 0:
        t = token_vectors(tok.select(*cols), model, word)
        return t.select(seq, pos, *keep, *[F.col(f"_v{j}").alias(f"_m0_{j}") for j in dims])
    b = _block_size(big, block)
    t = token_vectors(_with_halo(tok.select(*cols), big, pos, b), model, word)
    w = Window.partitionBy(seq, "_blk").orderBy(pos)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(f"_v{j}").over(run).alias(f"_c{j}") for j in dims])
    out = []
    for ws in sizes:
        n = F.least(F.lit(ws + 1), F.col(pos) + 1).cast("double")
        for j in dims:
            if ws == 0:
                out.append(F.col(f"_v{j}").alias(f"_m{ws}_{j}"))
            else:
                back = F.coalesce(F.lag(f"_c{j}", ws + 1).over(w), F.lit(0.0))
                out.append(((F.col(f"_c{j}") - back) / n).alias(f"_m{ws}_{j}"))
    return t.select(seq, pos, *keep, "_own", *out).where(F.col("_own")).drop("_own")


def embed_context_windows(tok: DataFrame, ws: int, model: HashEmbedder, pool: str = "mean",
                          seq: str = "seq", pos: str = "pos", word: str = "word", out: str = "x",
                          block: int | None = None) -> DataFrame:
    """``embed(context_window(tok, ws), model, pool)`` for an additive token model.

    A bag-of-tokens mean over the context is the windowed mean of per-word
    vectors (see ``_window_means``).  Last pooling is the current word's
    vector.  Keeps the other columns of ``tok``.
    """
    ws = 0 if pool == "last" else int(ws)
    keep = [c for c in tok.columns if c not in (seq, pos, word)]
    m = _window_means(tok, [ws], model, seq, pos, word, block, keep)
    arr = F.array(*[F.col(f"_m{ws}_{j}") for j in range(model.dim)]).alias(out)
    return m.select(seq, pos, *keep, arr)


class _FrameSums:
    """Sums of vectors per frame, kept by the task that makes the vectors."""

    def __init__(self, kind, names):
        self.kind, self.names = kind, names
        self.clear()

    def clear(self):
        self.at, self.n, self.sums = {}, np.zeros(0, np.int64), None

    def add(self, frames, mat: np.ndarray):
        """One vector per entry of the Arrow array ``frames``; True if it is time to flush."""
        coded = frames.dictionary_encode(null_encoding="encode")
        for f in (own := coded.dictionary.to_pylist()):
            self.at.setdefault(f, len(self.at))
        if self.sums is None or len(self.at) > len(self.sums):
            more = max(256, 2 * len(self.at))
            old, self.sums = self.sums, np.zeros((more, mat.shape[1]))
            self.n = np.concatenate([self.n, np.zeros(more - len(self.n), np.int64)])
            if old is not None:
                self.sums[:len(old)] = old
        to, idx = np.array([self.at[f] for f in own], np.int64), coded.indices.to_numpy()
        self.sums[to] += np.stack([np.bincount(idx, v, len(own)) for v in mat.T], axis=1)
        self.n[to] += np.bincount(idx, minlength=len(own))
        return 8 * len(self.at) * mat.shape[1] > 64 << 20

    def flush(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        part = self.sums[:len(self.at)]
        offsets = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(self.at), to_arrow_type(self.kind)), pa.array(self.n[:len(self.at)]),
             pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=self.names)
        self.clear()
        return out


def _frame_means(rows: DataFrame, frame_col: str, kind, sizes, vectors, tags: int = 0) -> DataFrame:
    """(frame, x_{ws} ...): mean of the vectors of each frame.  ``vectors(batches)`` gives
    pairs of frames and vectors, of all sizes beside each other; one sum per frame leaves a task.
    With ``tags`` a number below it stands before each pair, and means are by ``_of``, that number, too."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spec = T.StructType([T.StructField(frame_col, kind), T.StructField("n", T.LongType()),
                         T.StructField("v", T.ArrayType(T.DoubleType()))] + [T.StructField("_of", T.IntegerType())] * bool(tags))
    keys = ["_of"] * bool(tags) + [frame_col]

    def tagged(batches):
        import pyarrow as pa
        sums = [_FrameSums(kind, spec.fieldNames()[:3]) for _ in range(tags)]
        out = lambda k: pa.RecordBatch.from_arrays(
            [*(b := sums[k].flush()).columns, pa.array([k] * b.num_rows, pa.int32())], names=spec.fieldNames())
        for k, frames, mat in vectors(batches):
            if len(mat) and sums[k].add(frames, mat):
                yield out(k)
        for k in range(tags):
            if sums[k].at:
                yield out(k)

    def run(batches):
        sums = _FrameSums(kind, spec.fieldNames())
        for frames, mat in vectors(batches):
            if sums.add(frames, mat):
                yield sums.flush()
        if sums.at:
            yield sums.flush()

    g = (rows.mapInArrow(tagged if tags else run, spec).select(*keys, "n", array_to_vector("v").alias("v")).groupBy(*keys)
         .agg(F.sum("n").alias("n"), Summarizer.sum(F.col("v")).alias("v"))
         .select(*keys, "n", vector_to_array("v").alias("v")))
    width = (F.size("v") / len(sizes)).cast("int")
    mean = F.transform("v", lambda v: v / F.col("n"))
    return g.select(*keys, *[F.slice(mean, width * i + 1, width).alias(f"x_{ws}") for i, ws in enumerate(sizes)])


def frame_means(tok: DataFrame, sizes, model: HashEmbedder, pool: str = "mean", frame_col: str = "tr",
                seq: str = "seq", pos: str = "pos", word: str = "word", block: int | None = None) -> DataFrame:
    """Per-frame stimulus for several window sizes: (tr, x_{ws} ...), one pass.

    Words are folded before the one shuffle (``blocks``); a task looks their
    vectors up once and takes every window's sum as the difference of two
    running totals (see ``_window_means``), so what leaves it is one sum per
    frame.  Windows of the current word alone need no shuffle.
    """
    from voxlex.operators import blocks as bl
    from voxlex.operators.context import _block_size
    sizes = [int(s) for s in sizes]
    eff = [0 if pool == "last" else ws for ws in sizes]
    big = max(eff)
    kind = tok.schema[frame_col].dataType
    named = lambda words: [w if w is not None else "" for w in words]
    if big == 0:
        def alone(batches):
            for b in batches:
                if b.num_rows:
                    yield b.column(1), np.hstack([model.vectors(named(b.column(0).to_pylist()))] * len(sizes))
        return _frame_means(tok.select(word, frame_col), frame_col, kind, sizes, alone)
    size = _block_size(big, block)

    def vectors(batches):
        for _, blk, parts in bl.groups(batches):
            p, cols, _ = bl.rows_of(parts)
            v = model.vectors(named(cols[0].to_pylist()))
            total = np.vstack([np.zeros(v.shape[1]), np.cumsum(v, axis=0)])
            own = int(np.searchsorted(p, blk * size))
            end = np.arange(own, len(p)) + 1
            mat = [v[own:] if ws == 0 else
                   (total[end] - total[np.maximum(end - ws - 1, 0)]) / np.minimum(ws + 1, p[own:] + 1)[:, None] for ws in eff]
            if len(end):
                yield cols[1].slice(own), np.hstack(mat)

    return _frame_means(bl.grouped(bl.fold(tok, seq, pos, [word, frame_col], size, big), seq), frame_col, kind, sizes, vectors)


def frame_contexts(tok: DataFrame, sizes, model, pool: str = "mean", frame_col: str = "tr", seq: str = "seq",
                   pos: str = "pos", word: str = "word", block: int | None = None, batch: int = 1024) -> DataFrame:
    """Per-frame stimulus of any model for several window sizes: (tr, x_{ws} ...).

    Words are folded once into (sequence, block) arrays with a halo of the
    largest window.  A task slides over an array, joins ``batch`` contexts at
    a time, calls the model and adds the pooled vectors to its frames' sums,
    so a context exists only inside one call: none is stored, shuffled or
    sent between the JVM and Python.  What leaves a task is one sum per
    frame.  Same values as ``context_windows``, ``embed`` and
    ``frame_embeddings``: rows without a word add nothing to a context, and
    a frame's mean counts every row.
    """
    from voxlex.operators import blocks as bl
    if pool not in ("mean", "last"):
        raise ValueError("pool must be 'mean' or 'last'")
    sizes = [int(s) for s in sizes]
    rising = sorted(set(sizes))
    big = max(sizes)
    size = block or max(1 << 12, 16 * (big + 1))
    t = bl.grouped(bl.fold(tok, seq, pos, [word, frame_col], size, big), seq)
    token = model.__dict__.setdefault("_token", uuid.uuid4().hex) if hasattr(model, "__dict__") else str(id(model))

    def vectors(batches):
        m = load_once(model, token)
        for _, blk, parts in bl.groups(batches):
            p, cols, _ = bl.rows_of(parts)
            text = bl.Joined(cols[0].to_pylist())
            for a in range(int(np.searchsorted(p, blk * size)), len(p), batch):
                span = range(a, min(a + batch, len(p)))
                i = np.arange(span.start, span.stop)
                vec, before = {}, None
                for ws in rising:
                    # near the start of a sequence a larger window has the same text: embedded once
                    start = np.maximum(i - ws, 0)
                    new = np.ones(len(i), bool) if before is None else start != before[0]
                    got = pooled_batch(m, text.many(start[new], i[new] + 1), pool) if new.any() else None
                    if new.all():
                        vec[ws] = got
                    else:
                        vec[ws] = before[1].copy()
                        if got is not None:
                            vec[ws][new] = got
                    before = start, vec[ws]
                yield cols[1].slice(span.start, len(span)), np.hstack([vec[ws] for ws in sizes])

    return _frame_means(t, frame_col, tok.schema[frame_col].dataType, sizes, vectors)


def prefixed_means(folded: DataFrame, stretches, fn, prefixes, kind, at: int, frame_col: str, model, pool: str = "mean",
                   base_pool: str | None = None, ws: int = 0, batch: int = 1024) -> DataFrame:
    """(_of, frame, x_0): means per frame of the vectors of texts that are a generated prefix and a
    context (``_of`` 0) and, with ``base_pool``, of every row's context of ``ws`` words alone (``_of`` 1), in one pass.

    ``stretches`` gives (sequence, first own row, positions, columns, words, stretches) of folded rows, ``at`` the
    frame's column (``context._segments``).  ``fn`` runs on the prompts of about 4 ``batch`` rows, the model on ``batch``
    texts.  A model that declares itself additive (``fused``) embeds a prefix once and adds the
    contexts' sums as differences of running totals, if no word has white space.
    """
    if pool not in ("mean", "last"):
        raise ValueError("pool must be 'mean' or 'last'")
    token = model.__dict__.setdefault("_token", uuid.uuid4().hex) if hasattr(model, "__dict__") else str(id(model))
    fused = getattr(model, "fused", False)

    def texts_of(m, texts, how):
        return np.vstack([pooled_batch(m, texts[i:i + batch], how) for i in range(0, len(texts), batch)])

    def vectors(batches):
        import pyarrow as pa
        m, f = load_once(model, token), fn.load() if hasattr(fn, "load") else fn

        def made(held):
            ask = [x for h in held for x in h[2] if x is not None]
            got = iter(pd.Series(f(pd.Series(ask))).astype(object) if ask else ())
            all_texts, places = [""], []
            for s, anchors, src, sizes, p, *_ in held:
                gen = [None if x is None else next(got) for x in src]
                texts, place = prefixes(s, anchors, [None if g is None or g != g else g for g in gen], sizes, p)
                places.append(place + len(all_texts))
                all_texts += texts
            mat = []
            if any(h[7] is not None for h in held):
                some = [k for k, t in enumerate(all_texts) if t]
                add, many = np.zeros((len(all_texts), m.dim)), np.zeros(len(all_texts))
                if some and pool == "mean":
                    rows, ends = m.token_rows([all_texts[k] for k in some])
                    begin = np.concatenate([[0], ends[:-1]])
                    add[some], many[some] = np.add.reduceat(rows, begin, axis=0), ends - begin
            for place, (_, _, _, _, _, _, ctx, sums, size) in zip(places, held):
                if sums is None:
                    given = [all_texts[k] for k in place.tolist()]
                    mat.append(texts_of(m, ["" if t is None else t + c for t, c in zip(given, ctx)], pool))
                    continue
                mat.append((sums + add[place]) / (many[place] + size)[:, None] if pool == "mean" else sums)
                if None in all_texts and (empty := np.array([all_texts[k] is None for k in place.tolist()])).any():
                    mat[-1][empty] = pooled_batch(m, [""], pool)
            return pa.concat_arrays([h[5] for h in held]), np.vstack(mat)

        held, rows = [], 0
        for s, own, p, cols, text, pieces in stretches(batches):
            words, sums = text.words, None
            if fused:
                sums = v = m.vectors(words if text.text is not None else [w if w is not None else "" for w in words])
                total = np.vstack([np.zeros(v.shape[1]), np.cumsum(v, axis=0)])
            if base_pool:
                i = np.arange(own, len(p))
                lo = np.maximum(i - ws, 0)
                if not len(i):
                    base = np.zeros((0, m.dim))
                elif not fused:
                    base = texts_of(m, text.many(lo, i + 1), base_pool)
                elif base_pool == "last":
                    base = v[own:]
                else:
                    base = (total[i + 1] - total[lo]) / np.minimum(ws + 1, p[own:] + 1)[:, None]
                yield 1, cols[at].slice(own), base
            pieces = list(pieces)
            if not pieces:
                continue
            anchors, src, _, first, end, lo, hi = zip(*pieces)
            lo, hi, sizes = np.concatenate(lo), np.concatenate(hi), np.subtract(end, first)
            if first[1:] == end[:-1]:
                own_p, frames = p[first[0]:end[-1]], cols[at].slice(first[0], end[-1] - first[0])
            else:
                i = np.concatenate([np.arange(a, b) for a, b in zip(first, end)])
                own_p, frames = p[i], cols[at].take(pa.array(i))
            if fused and text.text is not None and "" not in words and not _JAVA_SPACE.search("\x01".join(words)):
                given = None, total[hi] - total[lo] if pool == "mean" else v[hi - 1], hi - lo
            else:
                given = text.many(lo, hi), None, None
            held.append((s, anchors, src, sizes, own_p, frames, *given))
            rows += len(own_p)
            if rows >= 4 * batch:
                yield 0, *made(held)
                held, rows = [], 0
        if held:
            yield 0, *made(held)

    return _frame_means(folded, frame_col, kind, [0], vectors, tags=2)


def mean_vector(df: DataFrame, key, vec: str = "x", out: str | None = None) -> DataFrame:
    """Element-wise mean of ``vec`` per key (map-side combined vector aggregate)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    keys = [key] if isinstance(key, str) else list(key)
    out = out or vec
    g = (df.select(*keys, array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("_v"))
           .groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")))
    return g.select(*keys, vector_to_array("_m").alias(out))


def pool_tokens(df: DataFrame, key, order: str, vec: str = "x", how: str = "mean",
                out: str | None = None, dim: int | None = None) -> DataFrame:
    """Pool token vectors per key: element-wise mean, or the last token's vector.

    With a known width every element has its own aggregate of fixed size,
    which is code-generated and hashed; vectors as a whole are sorted by key instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = out or vec
    if how not in ("mean", "last"):
        raise ValueError("how must be 'mean' or 'last'")
    if dim:
        one = (lambda v: F.avg(v)) if how == "mean" else (lambda v: F.max_by(v, order))
        g = df.groupBy(*keys).agg(*[one(F.col(vec)[j]).alias(f"_a{j}") for j in range(dim)])
        return g.select(*keys, F.array(*[F.col(f"_a{j}") for j in range(dim)]).alias(out))
    if how == "mean":
        return mean_vector(df, keys, vec, out)
    return df.groupBy(*keys).agg(F.max_by(vec, order).alias(out))


def frame_embedding(emb: DataFrame, frame_col: str = "tr", vec: str = "x", dim: int | None = None) -> DataFrame:
    """Stimulus matrix rows: mean vector of all words in each frame.

    With a known width the mean is one code-generated ``avg`` per element;
    otherwise a vector aggregate (``Summarizer``).
    """
    if dim:
        g = emb.groupBy(frame_col).agg(*[F.avg(F.col(vec)[j]).alias(f"_a{j}") for j in range(dim)])
        return g.select(frame_col, F.array(*[F.col(f"_a{j}") for j in range(dim)]).alias(vec))
    return mean_vector(emb, frame_col, vec)


def frame_embeddings(emb: DataFrame, frame_col: str, vecs: list) -> DataFrame:
    """``frame_embedding`` of several vector columns in one aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    t = emb.select(frame_col, *[array_to_vector(v).alias(v) for v in vecs])
    g = t.groupBy(frame_col).agg(*[Summarizer.mean(F.col(v)).alias(v) for v in vecs])
    return g.select(frame_col, *[vector_to_array(v).alias(v) for v in vecs])
