"""Vector codes, piece encoding and conversation repair against brute force, with edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_SMALL
from tests.llm import brute
from voxlex.llm import piece_codec, registry, turn_repair, vector_codes

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows(name):
    return pq.read_table(f"{SF_SMALL}/{name}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- vector codes --------------------------------------------------------------------

def code_rows(df):
    return {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in df.collect()}


def test_op11(spark):
    want, books = brute.vector_codes([(r["vec_id"], r["label"], r["embedding"]) for r in rows("embeddings")])
    got = registry.QUERIES["op11_vector_codes"](spark, SF_SMALL)
    assert code_rows(got) == want
    assert {r["codebooks_sha256"] for r in got.collect()} == {sha(",".join(str(v) for b in books for e in b for v in e))}


@pytest.mark.parametrize("seed", range(12))
def test_dual_tree_search_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    n, k, d = int(rng.integers(1, 900)), int(rng.integers(1, 70)), int(rng.integers(1, 6))
    spread = int(rng.choice([2, 30, 2000]))
    p = rng.integers(-20 * spread, 20 * spread, (8, d))[rng.integers(0, 8, n)] + rng.integers(-spread, spread + 1, (n, d))
    e = p[rng.integers(0, n, k)] if seed % 2 else rng.integers(-spread, spread, (k, d))
    if seed % 4 == 3:
        p[:] = p[0]
    if seed % 6 == 5:                                     # beyond 64 bits
        p, e = p.astype(object) * 10**30, e.astype(object) * 10**30
    want = [min((sum((x - y) ** 2 for x, y in zip(a.tolist(), b.tolist())), i) for i, b in enumerate(e))[1] for a in p]
    for codes in (True, False):
        got = vector_codes.search(vector_codes.PartTree(p, 4), vector_codes.EntryTree(e), codes)
        assert not codes or got.codes.tolist() == want
        assert got.counts.tolist() == np.bincount(want, minlength=k).tolist()
        sums = np.zeros(e.shape, p.dtype)
        np.add.at(sums, want, p)
        assert (got.sums == sums).all()


def test_dual_tree_prunes_clustered_parts():
    rng = np.random.default_rng(0)
    centres = rng.integers(-10**6, 10**6, (64, 4))
    p = centres[rng.integers(0, 64, 8192)] + rng.integers(-5, 6, (8192, 4))
    got = vector_codes.search(vector_codes.PartTree(p), vector_codes.EntryTree(centres), False)
    assert got.compared < 3000 and got.counts.sum() == 8192    # whole nodes by their cached sums


def test_vector_codes_edges(spark):
    schema = "vec_id bigint, embedding array<double>, label string, code string, extra int"
    make = lambda data: spark.createDataFrame(data, schema)
    run = lambda data, **kw: vector_codes.digests(*vector_codes.compress(make(data), 2, **kw))
    assert run([]).collect() == []
    assert run([(1, None, "a", "x", 1), (2, [1.0, None, 1.0, 1.0], "a", "x", 1),
                (3, [1.0, float("nan"), 0.0, 0.0], "a", "x", 1), (4, [1.0, float("inf"), 0.0, 0.0], None, "x", 1),
                (5, [], None, "x", 1), (6, [1.0], None, "x", 1)]).collect() == []
    # nulls, a repeated row, ties, equal labels and null labels, another width
    data = [(i, [float(i % 5), -0.3, i / 7, 2.0], ["a", None, "null"][i % 3], "x", i) for i in range(40)]
    want, _ = brute.vector_codes([(r[0], r[2], r[1]) for r in data], 2, 4)
    assert code_rows(run(data + [(90, [1.0, 2.0], "a", "x", 1), (91, None, "a", "x", 1)], entries=4)) == want
    twice = run([data[0], data[0], (None, data[1][1], "a", "x", 0)], entries=4).collect()
    assert sorted(-1 if r["vec_id"] is None else r["vec_id"] for r in twice) == [-1, 0, 0] and {r["error"] for r in twice} == {0}
    # components of any finite size: errors that fit no long are null
    huge = run([(1, [1e300, 0.0, 0.0, 0.0], "a", "x", 1), (2, [3e300, 0.0, 0.0, 0.0], "b", "x", 1)], entries=1).collect()
    assert {r["error"] for r in huge} == {None} == {r["label_error"] for r in huge}
    coded, books = vector_codes.compress(make(data), 2, 40, 0)
    back = {r["id"]: vector_codes.decode(r["code"], books) for r in coded.collect()}
    assert all(np.allclose(back[r[0]], np.floor(np.array(r[1]) * 256) / 256) for r in data)


# -- piece encoding -----------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(registry.PIECES)


def fuzzed(codec, seed, n=1500):
    rnd = random.Random(seed)
    pieces = list(codec.piece.values())
    odd = ["  ", "   ", "\n", "the", "ing", "----", "=", "“", "”", "é", "1", "22", "<s>", "<0x0A>", "<unk>", "\x00", "的", "▁", "​"]
    for k in range(n):
        kind = k % 4
        if kind == 0:
            yield "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))).replace("▁", rnd.choice(" ▁"))
        elif kind == 1:
            yield "".join(chr(rnd.choice([rnd.randint(1, 127), rnd.randint(128, 0xd7ff), rnd.randint(0xe000, 0x10ffff)]))
                          for _ in range(rnd.randint(0, 20)))
        elif kind == 2:
            yield "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30)))
        else:
            yield " ".join(rnd.choice(pieces).replace("▁", "") + rnd.choice(["", ".", "\n", ","]) for _ in range(rnd.randint(0, 12)))


@pytest.mark.parametrize("piece", [3, 100_000])
def test_prefix_table_equals_the_library(codec, monkeypatch, piece):
    monkeypatch.setattr(piece_codec, "SLICE", piece)
    for text in fuzzed(codec, piece):
        want = codec.sp.encode(text)
        parts = list(codec.slices(text))
        assert [i for p in parts for i in p] == want, text
        assert "".join(codec.decoded(parts)) == codec.sp.decode(want), text


def test_word_path_equals_the_library(codec):
    texts = list(fuzzed(codec, 9))
    at, ids, off, joined = codec.batch(pa.array(texts))
    assert len(at) > 300
    for k, i in enumerate(at.tolist()):
        want = codec.sp.encode(texts[i])
        assert ids[off[k]:off[k + 1]].tolist() == want and joined[k].as_py() == ",".join(map(str, want))


def test_one_token_ends_each_prefix(codec):
    """The table holds what the library gives for every prefix."""
    for text in ["▁internationalization", "▁▁▁▁▁▁def▁f(x):", "▁的的ing-----=====", "aaaaaaaaa"]:
        last = codec.last_tokens(text)
        for i in range(1, len(text) + 1):
            ids = codec.encode_stretch(text[:i])
            assert last[i] == (ids[-1] if ids[-1] in codec.piece else None)


def test_op12(spark, codec):
    docs = {r["doc_id"]: r["text"] or "" for r in rows("documents")}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in registry.QUERIES["op12_piece_codec"](spark, SF_SMALL).collect()}
    want = {}
    for k, t in docs.items():
        ids = codec.sp.encode(t)
        want[k] = (len(ids), sha(",".join(map(str, ids))), sha(codec.sp.decode(ids)))
    assert got == want


def test_piece_codec_edges(spark, codec, monkeypatch):
    schema = "doc_id bigint, text string, ids string, n_tokens int"
    texts = [(1, None), (2, ""), (3, " "), (1, "again"), (None, "no id"), (4, "ab" * 700_000), (5, "w " * 40_000)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in texts], schema)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_codec.digests(docs, registry.PIECES).collect())
    want = [(lambda ids: (len(ids), sha(",".join(map(str, ids))), sha(codec.sp.decode(ids))))(codec.sp.encode(t or "")) for _, t in texts]
    assert got == sorted(want)
    assert piece_codec.digests(docs.limit(0), registry.PIECES).collect() == []
    short = docs.where("length(coalesce(text, '')) < 10")
    back = piece_codec.decode(piece_codec.encode(short, registry.PIECES), registry.PIECES)
    assert sorted(r["text"] for r in back.collect()) == sorted(codec.sp.decode(codec.sp.encode(t or ""))
                                                               for _, t in texts if len(t or "") < 10)


# -- conversation repair ------------------------------------------------------------

@pytest.mark.parametrize("size", [64, 1, 2, 5])
def test_alignment_equals_plain_recursion(size):
    rnd = random.Random(size)
    for _ in range(250):
        must, short = rnd.random() * 0.5, rnd.random() * 0.6
        turns = [(rnd.choice("sua-uaua"), rnd.random() < must, rnd.random() < short) for _ in range(rnd.randint(0, 11))]
        turns = [(a, b, c and not b) for a, b, c in turns]
        paths = {"start": (0, "")}
        for k in range(0, len(turns), size):
            paths = turn_repair.join_piece(paths, turn_repair.pieces(turns[k:k + size], k > 0))
        assert turn_repair.finish(paths) == brute.cheapest_edits(tuple(turns)), turns


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(turn_repair.damage(df)).collect()}


def test_op13(spark):
    data = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows("conversations")]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS)
           for r in registry.QUERIES["op13_turn_repair"](spark, SF_SMALL).collect()}
    assert got == brute.repaired_conversations(data)


def test_turn_repair_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, copies string, verdict int"
    make = lambda data: spark.createDataFrame([(*r, "x", 1) for r in data], schema)
    assert repaired(make([])) == {}
    dropped = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:2]
    data = [(k, 0, "user", "Gone.") for k in dropped]
    data += [(None, 0, "user", "No conversation."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    data += [(500, None, "user", "First?"), (500, 2, "assistant", "A."), (500, 2, "assistant", "A."), (500, 7, "", "?")]
    data += [(501, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(-3, 3)]
    data += [(502, 1, "system", "Rules."), (502, 2, "tool", "é的 " * 40_000 + "."), (502, 3, "user", "\t\n ")]
    data += [(503, 5, "user", "Same.")] * 3 + [(504, 1, "user", "Ends, ")]
    got = repaired(make(data))
    assert got == brute.repaired_conversations(data)
    assert all(got[k] == (0, 0, 0, 0, 0, 0, "", sha("")) for k in dropped)


def test_long_conversations_are_joined_from_stretches(spark, monkeypatch):
    """One conversation of most rows, dealt out over many tasks."""
    rnd = random.Random(3)
    data = [(1, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["So.", "Yes", "No?", " ", f"n{t}."]))
            for t in range(130)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yo.")]
    monkeypatch.setattr(turn_repair, "STRETCH", 9)
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repaired(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == brute.repaired_conversations(data)
    turns = turn_repair.repaired(turn_repair.damage(df)).collect()
    for k in (1, 2):
        text = "\n".join(f"{r['role']}:{r['text']}" for r in sorted((r for r in turns if r["conv_id"] == k), key=lambda r: r["place"]))
        assert sha(text) == got[k][-1]
