"""SentencePiece encoding and decoding by a merge-type prefix table.

Merging is deterministic, so every prefix of a text has one encoding and hence
one last token.  The table stores that token for each prefix: an automaton
lists the pieces that end at a position, and of these exactly one is a token
of its own and compatible with the last token of the prefix before it (two
tokens are compatible if merging their joint text gives just the two).  The
ids are then read backwards from the end.  The cost is linear in the text.

A sequence whose neighbours are all compatible is the encoding, so a text may
be cut wherever no merge can cross: between two characters that stand next to
each other in no piece.  Cuts are taken only where the vocabulary proves them
(before white space, around characters that no longer piece holds, between
Latin letters and anything else); each distinct stretch between cuts goes
through the table once per worker.

Supported: merge models with byte fallback whose pieces are all normal ones
(no user-defined symbols).  Normalisation is the library's; decoding is the
library's ``decode``, fed in slices of whole stretches.

Defined results: a null text is empty; an empty text has no ids and decodes
to the empty text.  Rows are independent: repeated, null or ambiguous ids
give one row each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voxlex.functions.cache import worker_cache
from voxlex.llm.common import bound_arrow
from voxlex.llm.tokenizing import tokenizer_file

SPACE = "▁"
#: Stretches of a text handled (and ids decoded) at a time.
SLICE = 100_000
#: Entries after which a worker's tables are dropped and filled anew.
MAX_STRETCHES, MAX_WORDS, MAX_PAIRS = 500_000, 600_000, 1_000_000
#: Bytes above which a text is encoded slice by slice.
LONG = 1 << 20


class _Learned(dict):
    """Stretch -> ids; one met for the first time is encoded, and kept unless long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        ids = self.encode(stretch)
        if len(stretch) <= 64:
            self[stretch] = ids
        return ids


class _Words(dict):
    """Word between single spaces -> (ids, their decimal text)."""

    def __init__(self, codec: "PieceCodec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        known = self.codec.memo
        ids = tuple(chain.from_iterable([known[x] for x in self.codec.stretches.findall(SPACE + word)]))
        new = self[word] = ids, ",".join(map(str, ids))
        return new


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))
        sp, n = self.sp, self.sp.vocab_size()
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.piece = {i: sp.id_to_piece(i) for i in range(n) if not special(i)}
        #: Merges of a lower rank come first; equal ranks from the left.
        self.rank = {p: -sp.get_score(i) for i, p in self.piece.items()}
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            if len(self.merged(p)) == 1:       # else it is never a token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.cut_at_space = not any(b == SPACE != a for p in self.piece.values() for a, b in zip(p, p[1:]))
        self.stretches = self._cuts()
        self.memo = _Learned(self.encode_stretch)
        self.words = _Words(self)
        #: By right token: left token -> whether the two fit.
        self.pairs: list[dict[int, bool]] = [{} for _ in range(n)]
        self.known_pairs = 0
        #: An id that decodes to one character and stands before a slice.
        self.guard = next(i for i, p in self.piece.items() if len(p) == 1 and p.isascii() and p.isalpha())

    def _cuts(self) -> re.Pattern:
        """The pattern of a stretch: only cuts that no piece crosses."""
        joins = {(a, b) for p in self.piece.values() for a, b in zip(p, p[1:])}
        if not self.cut_at_space:
            return re.compile(r"[\s\S]+")
        merged = {c for ab in joins for c in ab}
        alone = [chr(i) for i in range(128) if chr(i) not in merged and chr(i) != " "]
        latin = [chr(i) for i in range(0x250) if chr(i).isalpha() and chr(i) not in alone]
        if any((a in latin) != (b in latin) for a, b in joins if SPACE not in (a, b)):
            latin = []
        s, w = "".join(map(re.escape, alone)), "".join(map(re.escape, latin))
        parts = ([f"[{w}]+"] if w else []) + [f"[^{SPACE}{s}{w}]+"]
        return re.compile(f"{SPACE}*(?:{'|'.join(parts)})" + (f"|[{s}]" if s else "") + f"|{SPACE}+")

    # -- merging of short texts, only to test tokens and pairs of tokens

    def merged(self, text: str) -> list[str]:
        """Best-ranked pair first, the leftmost of equals, until none is left."""
        rank, part, never = self.rank.get, list(text), float("inf")
        ranks = [rank(a + b, never) for a, b in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            part[k:k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(part[k - 1] + part[k], never)
            if k < len(ranks):
                ranks[k] = rank(part[k] + part[k + 1], never)
        return part

    def fits(self, left: int, right: int) -> bool:
        """Merging the joint text of two tokens gives the two."""
        if self.known_pairs >= MAX_PAIRS:
            for row in self.pairs:
                row.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        a, b = self.piece[left], self.piece[right]
        known = self.pairs[right][left] = self.merged(a + b) == [a, b]
        return known

    # -- the prefix table

    def last_tokens(self, text: str) -> list[int | None]:
        """The last token of each prefix; None where it ends in a character
        that the vocabulary lacks (such a character never merges)."""
        last: list[int | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(text):
            i = end + 1
            if last[i] is None:
                before = last[i - size] if i > size else None
                if before is None:
                    last[i] = token
                else:
                    ok = pairs[token].get(before)
                    if ok if ok is not None else self.fits(before, token):
                        last[i] = token
        return last

    def encode_stretch(self, text: str) -> tuple[int, ...]:
        last, i, out = self.last_tokens(text), len(text), []
        while i:
            token = last[i]
            if token is None:
                out.extend(self.bytes[b] for b in reversed(text[i - 1].encode()))
                i -= 1
            else:
                out.append(token)
                i -= len(self.piece[token])
        return tuple(reversed(out))

    # -- whole texts

    def slices(self, text: str):
        """The ids of a text, in lists of whole stretches."""
        for part in self._parts(self.sp.normalize(text)):
            if len(self.memo) > MAX_STRETCHES:
                self.memo.clear()
            yield list(chain.from_iterable(map(self.memo.__getitem__, part)))

    def _parts(self, text: str):
        if len(text) <= SLICE:
            if text:
                yield self.stretches.findall(text)
            return
        found = (m.group() for m in self.stretches.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def batch(self, texts: pa.Array):
        """(places of the texts whose words stand between single spaces, their ids
        concatenated, offsets, the decimal ids of each joined by commas).  Arrow
        splits such texts and makes their words distinct, so that Python sees
        each word of a batch once; no merge crosses a space before a word."""
        if not self.cut_at_space:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), pa.array([], pa.string())
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self.memo) > MAX_STRETCHES:
            self.memo.clear()
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |^$|  |{SPACE}"), pc.greater(pc.binary_length(texts), LONG))
        at = [i for i in np.flatnonzero(~odd.to_numpy(zero_copy_only=False)).tolist()
              if self.plain(texts[i].as_py())]
        at = np.array(at, np.int64)
        split = pc.split_pattern(texts.take(pa.array(at)), " ")
        words = split.flatten().dictionary_encode()
        ids, text = zip(*map(self.words.__getitem__, words.dictionary.to_pylist())) if len(at) else ((), ())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, size.sum())
        entry = words.indices.to_numpy()
        n = size[entry]
        end = np.concatenate([[0], np.cumsum(n)])
        got = flat[np.repeat((np.cumsum(size) - size)[entry] - end[:-1], n) + np.arange(end[-1])]
        edges = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        parts = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(text, pa.string()).take(words.indices))
        return at, got, end[edges], pc.binary_join(parts, ",")

    def plain(self, text: str) -> bool:
        """Normalisation does no more than mark the spaces."""
        return self.sp.normalize(text) == SPACE + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.slices(text)))

    def decoded(self, slices):
        """The library's text of the ids, slice by slice."""
        for k, ids in enumerate(slices):
            yield self.sp.decode([self.guard] + ids)[1:] if k else self.sp.decode(ids)


def piece_codec(model: str) -> PieceCodec:
    """One per worker process."""
    cache = worker_cache("piece-codecs")
    if model not in cache:
        cache[model] = PieceCodec(model)
    return cache[model]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column(1).cast(pa.string()), "")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every text."""
    bound_arrow(docs.sparkSession)

    def run(batches):
        codec = piece_codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([codec.encode(t.as_py()) for t in _texts(b)], pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids (null: empty)."""
    bound_arrow(encoded.sparkSession)

    def run(batches):
        codec = piece_codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([codec.sp.decode(x.as_py() or []) for x in b.column(1)], pa.string())],
                names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string")
            .withColumnRenamed("id", id_col))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256).  A long text is encoded, hashed
    and decoded slice by slice, so no list of all its ids is held."""
    bound_arrow(docs.sparkSession)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def one(codec: PieceCodec, text: str):
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

        def counted():
            nonlocal n
            for ids in codec.slices(text):
                ids_hash.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
                yield ids

        for part in codec.decoded(counted()):
            text_hash.update(part.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches):
        codec = piece_codec(model)
        for b in batches:
            texts = _texts(b)
            out: list = [None] * len(texts)
            at, ids, off, joined = codec.batch(texts)
            for k, i in enumerate(at.tolist()):
                part = ids[off[k]:off[k + 1]].tolist()
                out[i] = (len(part), sha(joined[k].as_buffer()), sha(codec.sp.decode(part).encode()))
            for i, done in enumerate(out):
                if done is None:
                    out[i] = one(codec, texts[i].as_py())
            n, ids, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(id_col, text_col)
            .mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
