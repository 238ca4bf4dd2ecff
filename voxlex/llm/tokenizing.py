"""Token ids by the ``tokenizers`` library, inside tasks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxlex.functions.cache import worker_cache

def tokenizer_file(name: str) -> str:
    """A path is used as given; a bare file name is looked up among the
    installed public tokenizers of the machine that runs the task."""
    if os.sep in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def load_tokenizer(name: str):
    """One instance per worker process, single threaded (the task is the
    unit of parallelism)."""
    cache = worker_cache("tokenizers")
    if name not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        cache[name] = Tokenizer.from_file(tokenizer_file(name))
    return cache[name]


def raw_strings(a: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string array without nulls."""
    if not len(a):
        return []
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int32, len(a) + 1, 4 * a.offset).tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[i:j] for i, j in zip(at, at[1:])]


class _Memo(dict):
    """Word (UTF-8) -> entry.  A word met for the first time gets the next entry and
    is noted: as one to encode, or as a known word plus a full stop or comma.

    Both short cuts hold for any tokenizer of the kind below: it lowers case
    (ASCII words only, and none that may hold a special string), and between
    a letter and a final stop or comma it always starts a new pre-token.
    """

    def __init__(self, lowers: bool):
        super().__init__()
        self.lowers, self.n = lowers, 0
        self.new: list[tuple[int, str]] = []
        self.pairs: list[tuple[int, int, int]] = []

    def __missing__(self, w: bytes) -> int:
        if self.lowers and w.isascii() and b"<" not in w:
            low = w.lower()
            if low != w:
                k = self[w] = self[low]
                return k
        if w[-2:-1].isalpha() and w[-1] in b",.":
            core, end = self[w[:-1]], self[w[-1:]]
            k = self[w] = self.n
            self.pairs.append((k, core, end))
        else:
            k = self[w] = self.n
            self.new.append((k, w.decode()))
        self.n += 1
        return k


class WordEncoder:
    """Ids of whole texts for a tokenizer whose pre-tokenizer drops white
    space (no token crosses it).

    The library encodes each distinct word once per worker; a text's ids
    are those of its words in order.  ``max_words`` bounds the memory: a
    fuller table is dropped and filled anew, which changes no result.
    """

    #: A character that the library turns into one id of its own, put between
    #: new words so that they can be encoded in few calls.
    MARK = "\x01"

    def __init__(self, name: str, max_words: int = 700_000):
        self.tok = load_tokenizer(name)
        self.max_words = max_words
        mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        ids = lambda w: self.tok.encode(w, add_special_tokens=False).ids
        self.lowers = ids("AbcXYZ") == ids("abcxyz")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.at = _Memo(self.lowers)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)

    def _add(self, entry: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Store the ids of entries; arrays grow by doubling."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.at.n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.len = np.concatenate([self.len, np.zeros_like(self.len)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[entry] = self.used + np.cumsum(n) - n
        self.len[entry] = n
        self.used += len(ids)

    def _gather(self, entry: np.ndarray):
        """(ids of the entries, concatenated; running ends of each)."""
        cum = np.concatenate([[0], np.cumsum(self.len[entry])])
        out = np.empty(cum[-1], np.uint32)
        for a in range(0, len(entry), 1 << 17):        # short scratch arrays
            e = entry[a:a + (1 << 17)]
            lo, hi = cum[a], cum[min(a + (1 << 17), len(entry))]
            shift = np.repeat(self.start[e] - cum[a:a + len(e)], self.len[e])
            shift += np.arange(lo, hi)
            out[lo:hi] = self.flat[shift]
        return out, cum

    def _encode_words(self, words: list[str]):
        """(ids of all words, concatenated; ids of each word)."""
        if self.mark is None or any(self.MARK in w for w in words):
            ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            return (np.concatenate([np.asarray(x, np.uint32) for x in ids]),
                    np.fromiter(map(len, ids), np.int64, len(ids)))
        sep = f" {self.MARK} "
        texts = [sep.join(words[i:i + 200]) + sep for i in range(0, len(words), 200)]
        flat = np.concatenate([np.asarray(e.ids, np.uint32)
                               for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        cut = np.flatnonzero(flat == self.mark)
        if len(cut) != len(words):
            raise ValueError("a word holds the separator's id")
        return np.delete(flat, cut), np.diff(cut, prepend=-1) - 1

    def _encode_letters(self, words: list[str]):
        """The same for words of letters only.  Such a word is one pre-token,
        and where the model marks a pre-token's last id, no separator is
        needed.  A word that the library splits after all shows in the count."""
        if self.ends is None:
            return self._encode_words(words)
        texts = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
        flat = np.concatenate([np.asarray(e.ids, np.uint32)
                               for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        cut = np.flatnonzero(self.ends[flat])
        if len(cut) != len(words):
            return self._encode_words(words)
        return flat, np.diff(cut, prepend=-1)

    def _learn(self) -> None:
        """Encode the words noted since the last call."""
        letters = [(k, w) for k, w in self.at.new if w.isalpha()]
        others = [(k, w) for k, w in self.at.new if not w.isalpha()]
        self.at.new = []
        for part, how in ((letters, self._encode_letters), (others, self._encode_words)):
            if part:
                entry, words = zip(*part)
                self._add(np.array(entry), *how(list(words)))
        if self.at.pairs:
            # cores of pairs may be pairs themselves ("a.,"): by rising entry, level by level
            todo = np.array(self.at.pairs)
            self.at.pairs = []
            open_ = np.zeros(self.at.n, bool)
            open_[todo[:, 0]] = True
            while len(todo):
                ready = ~open_[todo[:, 1]]
                k, parts = todo[ready, 0], todo[ready, 1:]
                ids, cum = self._gather(parts.reshape(-1))
                self._add(k, ids, np.diff(cum).reshape(-1, 2).sum(1))
                open_[k] = False
                todo = todo[~ready]

    def encode(self, texts: pa.Array, end_id: int | None = None):
        """(ids of all texts of a string array, concatenated; offsets of length
        len(texts) + 1).  Words are split and made distinct by Arrow, so Python
        sees each word of the batch once."""
        if self.at.n > self.max_words:
            self._reset()
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        per = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        words = split.flatten().dictionary_encode()
        known = np.fromiter(map(self.at.__getitem__, raw_strings(words.dictionary)), np.int64, len(words.dictionary))
        entry = known[words.indices.to_numpy()]
        self._learn()
        ids, cum = self._gather(entry)
        off = cum[np.concatenate([[0], np.cumsum(per)])]
        if end_id is not None:
            ids = np.insert(ids, off[1:], np.uint32(end_id))
            off = off + np.arange(len(off))
        return ids, off


def word_encoder(name: str, max_words: int = 700_000) -> WordEncoder:
    """One encoder per worker process: what it learned serves later tasks."""
    cache = worker_cache("word-encoders")
    if (name, max_words) not in cache:
        cache[name, max_words] = WordEncoder(name, max_words)
    return cache[name, max_words]
