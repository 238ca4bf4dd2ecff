"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk_chars`` characters is encoded in chunks that
overlap; both encodings of an overlap carry offsets, and the two are spliced at
a *stable common boundary*: a position where a pre-token starts in both.

A shorter text is encoded in one call, or, for byte-level tokenizers, counted
from its pieces: a blank after a character that is no white space always
starts a pre-token there, so the text is cut before such blanks and the library
encodes each distinct piece once per worker.  Texts in which white space comes
before a blank, and tokenizers of another kind, take the one call.

Why such a boundary is safe: the pre-tokenizer scans left to right and never
looks back, so from a true pre-token start onwards its output depends only on
the text that follows.  The left encoding starts at a true boundary (the start
of the text, or an earlier splice), hence all its pre-tokens are true as long
as they do not touch the cut at its end; ``guard`` characters before the cut
are never used (look-ahead, and special strings that the cut may split).  If
no common boundary lies in the overlap, for instance inside one very long
word, the overlap is doubled until one does or the text ends.

Nulls count as empty texts.  Documents are independent rows: repeated rows
give repeated results, extra columns are ignored, an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voxlex.functions.cache import worker_cache
from voxlex.llm.common import bound_arrow
from voxlex.llm.tokenizing import load_tokenizer, raw_strings


def pretoken_starts(enc, base: int) -> dict[int, int]:
    """Text position -> index of the first token, for every pre-token."""
    out, last = {}, None
    for i, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
        if word != last:
            out[base + a] = i
            last = word
    return out


def encode_long(tok, text: str, chunk_chars: int, overlap_chars: int, guard: int = 64) -> list[int]:
    """Ids of a text of any length, by spliced chunks."""
    n = len(text)
    ids: list[int] = []
    start = 0                        # a true boundary: everything before is in ids
    stop = min(n, chunk_chars + overlap_chars)
    left = tok.encode(text[:stop], add_special_tokens=False)
    first = 0                        # first token of `left` that is not in ids
    base = 0                         # text position of left's first character
    while stop < n:
        over = overlap_chars
        while True:
            at = max(start + 1, stop - over)
            end = min(n, at + chunk_chars + over)
            right = tok.encode(text[at:end], add_special_tokens=False)
            mine = pretoken_starts(left, base)
            theirs = pretoken_starts(right, at)
            both = [p for p in theirs if p in mine and p > start and at < p <= stop - guard]
            if both or stop == n:
                break
            over *= 2                # no common boundary: widen, re-encode the left part
            stop = min(n, stop + over)
            left = tok.encode(text[start:stop], add_special_tokens=False)
            first, base = 0, start
        if not both:
            break                    # the widened left part reaches the end of the text
        p = max(both)
        ids.extend(left.ids[first:mine[p]])
        left, first, base = right, theirs[p], at
        start, stop = p, end
    ids.extend(left.ids[first:])
    return ids


class PieceCounter:
    """Token counts of texts of a byte-level tokenizer, from their pieces.

    ``max_pieces`` bounds the memory of what is known; a fuller table is
    started anew, which changes no result.
    """

    #: White space that Arrow's regular expressions see, before a blank.
    BROKEN = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}] "

    def __init__(self, tok, max_pieces: int = 700_000):
        import json
        self.tok, self.max_pieces = tok, max_pieces
        conf = json.loads(tok.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.fits = (conf.get("normalizer") is None and pre.get("type") == "ByteLevel"
                     and pre.get("use_regex") and not pre.get("add_prefix_space"))
        vocab = tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True   # the blank's symbol
        self.known: tuple[dict, dict] = {}, {}                  # text starts, pieces after a blank

    def _one_by_one(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, new: list[bytes], blank: bool) -> None:
        words = [w.decode() for w in new]
        if not blank:
            self.known[0].update(zip(new, self._one_by_one(words)))
            return
        # pieces that end in white space would run into the next one
        loose = [i for i, w in enumerate(words) if not w or w[-1].isspace()]
        if loose:
            self.known[1].update(zip([new[i] for i in loose], self._one_by_one([" " + words[i] for i in loose])))
            drop = set(loose)
            new, words = ([x for i, x in enumerate(v) if i not in drop] for v in (new, words))
        for i in range(0, len(words), 20_000):
            part = words[i:i + 20_000]
            texts = ["".join(" " + w for w in part[j:j + 200]) for j in range(0, len(part), 200)]
            ids = np.concatenate([np.asarray(e.ids, np.int64)
                                  for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            cut = np.flatnonzero(self.starts[ids])
            n = np.diff(cut, append=len(ids)).tolist() if len(cut) == len(part) and cut[0] == 0 else \
                self._one_by_one([" " + w for w in part])
            self.known[1].update(zip(new[i:i + 20_000], n))

    def _counts(self, words: pa.Array, blank: bool) -> np.ndarray:
        """Tokens of every piece; Python sees each distinct one once."""
        words = words.dictionary_encode()
        seen = raw_strings(words.dictionary)
        known = self.known[blank]
        new = [w for w in seen if w not in known]
        if new:
            self._learn(new, blank)
        n = np.fromiter(map(known.__getitem__, seen), np.int64, len(seen))
        return n[words.indices.to_numpy()]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of a string array without nulls."""
        out = np.zeros(len(texts), np.int64)
        bad = pc.match_substring_regex(texts, self.BROKEN).to_numpy(zero_copy_only=False) if self.fits else \
            np.ones(len(texts), bool)
        out[bad] = self._one_by_one(texts.filter(pa.array(bad)).to_pylist())
        good = np.flatnonzero(~bad)
        if len(good):
            if sum(map(len, self.known)) > self.max_pieces:
                self.known = {}, {}
            split = pc.split_pattern(texts.take(pa.array(good)), " ")
            per = pc.list_value_length(split).to_numpy()
            words, ends = split.flatten(), np.cumsum(per)
            first = np.zeros(len(words), bool)
            first[ends - per] = True
            n = np.zeros(len(words), np.int64)
            for blank, mask in ((0, first), (1, ~first)):
                if mask.any():
                    n[mask] = self._counts(words.filter(pa.array(mask)), bool(blank))
            out[good] = np.add.reduceat(n, ends - per)
        return out


def piece_counter(name: str) -> PieceCounter:
    """One counter per worker process."""
    cache = worker_cache("piece-counters")
    if name not in cache:
        cache[name] = PieceCounter(load_tokenizer(name))
    return cache[name]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", chunk_chars: int = 16_384,
                 overlap_chars: int = 512, limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; no shuffle."""
    bound_arrow(docs.sparkSession)

    def count(batches):
        tok, pieces = load_tokenizer(tokenizer), piece_counter(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.string()), "")
            long = pc.greater(pc.utf8_length(texts), chunk_chars).to_numpy(zero_copy_only=False)
            out = np.zeros(len(texts), np.int64)
            out[~long] = pieces.count(texts.filter(pa.array(~long)))
            for i in np.flatnonzero(long):
                out[i] = len(encode_long(tok, texts[int(i)].as_py(), chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64()),
                 pa.array(out, pa.int64()), pa.array(out > limit, pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
