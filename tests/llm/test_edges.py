"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra
columns, and the paths that only large groups take (forced by small limits)."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from voxlex.llm import (common, decontam, language_id, minhash, packing, pii, suffix_dedup, token_counts,
                        token_files, tokenizing, warc, winnowing)

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(1 + r.randrange(6))) for _ in range(n))


def edge_rows():
    long = words(9000, 1)
    return [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "a", 3),
            (5, long, "en", "a", len(long)), (6, long, None, "b", len(long)), (7, long + " tail", "en", "b", 0),
            (8, "x" * 30_000, "de", "a", 30_000), (9, "naïve café — 😀 " * 40, "fr", "a", 0),
            (10, words(60, 2), "en", "a", 0), (10, words(60, 2), "en", "a", 0), (12, "<|endoftext|> a\x01b", "en", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("extra"))
    return df


def tok(name):
    return tokenizing.load_tokenizer(name)


# -- token counts -------------------------------------------------------------

@pytest.mark.parametrize("chunk,overlap", [(50, 8), (200, 70), (1000, 100)])
def test_long_texts_resynchronise(chunk, overlap):
    t = tok(BYTES)
    for text in [words(800, 3), "x" * 3000, " " * 500 + "a  b\n\n\n c" * 90, "it's 12,345! " * 150,
                 "<|endoftext|>ab" * 80, "😀é́ " * 200, "a" * 700 + " " + "b" * 700]:
        assert token_counts.encode_long(t, text, chunk, overlap) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_counts_from_pieces_equal_the_library(name):
    t = tok(name)
    r, parts = random.Random(6), ["a", " ", "b ", "\n", "  ", "'s", " 's", "é", "😀", "12", ".", "\u00a0", "\u3000", "\t",
                                  "<|endoftext|>", "don't", " \n", "\x85", "\x1c", "Word", "中文", "\r\n", " x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(4000)]
    texts += [words(200, 5), "", " ", "a", " a", "a ", words(60, 6).replace(" ", "\n")]
    c = token_counts.PieceCounter(t, max_pieces=60)
    for i in range(0, len(texts), 500):
        part = texts[i:i + 500]
        assert c.count(pa.array(part)).tolist() == [
            len(e) for e in t.encode_batch_fast(part, add_special_tokens=False)]


def test_token_counts_edges(docs, empty):
    t = tok(BYTES)
    got = token_counts.count_tokens(clash(docs, "n_bytes", "over_limit"), BYTES, chunk_chars=500, overlap_chars=90)
    want = Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids))
                   for r in edge_rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(empty, BYTES).collect() == []


# -- packing and token files ----------------------------------------------------

def test_word_encoder_equals_library():
    enc, t = tokenizing.WordEncoder(WORDS, max_words=50), tok(WORDS)
    for i in range(4):
        texts = [words(80, i), "", "A\x01B it's Ünï  x y\n\nz", "<|startoftext|>hi<|endoftext|> J̌",
                 "a., A., <|ENDOFTEXT|>. It's. ., x,. ΑΣ. ÀÉ, z.", words(30, i).title().replace(" ", ", "),
                 "İstanbul straße ﬁne ŉ Ⅷ Ǆ hello Wörld", "中文字 かな देवनागरी à"]
        ids, off = enc.encode(pa.array(texts), 7)
        for k, s in enumerate(texts):
            assert ids[off[k]:off[k + 1]].tolist() == t.encode(s, add_special_tokens=False).ids + [7]


def test_fullest_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        left = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 7))}
        room = r.randrange(1, 60)
        sums = {0}
        for size, n in left.items():
            sums = {s + size * k for s in sums for k in range(n + 1)}
        used = packing.fullest(room, left)
        assert all(left[s] >= k for s, k in used.items())
        assert sum(s * k for s, k in used.items()) == max(s for s in sums if s <= room)


def test_packing_edges(spark, docs, empty):
    from tests.llm.test_registry import check_packing
    one = docs.dropDuplicates(["doc_id"])
    t = tok(WORDS)
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in edge_rows()}
    got = packing.pack(clash(one, "length", "offset"), WORDS, capacity=64).collect()
    check_packing([r.asDict() for r in got], want, 64)
    assert packing.pack(docs, WORDS).count() == packing.pack(one, WORDS).count() + 1
    assert packing.pack(empty, WORDS).collect() == []


def test_huffman_lengths_and_codes():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 40, 700) ** 3
    counts[::7] = 0
    free = token_files.code_lengths(counts, 24)
    tight = token_files.code_lengths(counts, 10)
    for n, bits in ((free, 24), (tight, 10)):
        assert n.max() <= bits and ((n > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in n if x) == 1.0
    import heapq
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert cost == int((free.astype(int) * counts).sum()) <= int((tight.astype(int) * counts).sum())
    ids = rng.choice(np.flatnonzero(counts), 5000).astype(np.uint32)
    for total in (1, 63, 64, 65, 5000):
        bits, at = token_files.encode_bits(ids[:total], tight, token_files.canonical_codes(tight), 64)
        assert (token_files.decode_bits(bits, at, total, 64, tight, 10) == ids[:total]).all()


def test_token_files_edges(spark, docs, empty):
    rows = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = token_files.digests(token_files.round_trip(clash(rows, "key", "ids"), WORDS)).collect()
    t, start, want = tok(WORDS), 0, []
    for k, s in sorted([(r[0], r[1]) for r in edge_rows()] + [(-1, None)]):
        ids = t.encode(s or "", add_special_tokens=False).ids + [2]
        want.append((None if k < 0 else k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)
    assert token_files.round_trip(empty, WORDS).collect() == []


# -- WARC -------------------------------------------------------------------------

def test_warc_edges(spark):
    big = "<p>" + words(4000, 4) + "</p>"
    rows = [(1, "u1", None, 1), (2, "u2", "", 1), (3, None, "<a>é</a>", 1), (4, "u4", "<a>é</a>", 1), (5, "u5", big, 1),
            (6, "u6", big, 1), (7, "u7", "a\r\n\r\nWARC/1.1\r\n", 1), (8, "u8", "<a>é</a>", 1), (9, "u9", "z", 1)]
    rows += [(100 + i, f"h{i}", "hot", 1) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")
    for least in (0, 4):
        got = {r.page_id: r for r in warc.round_trip(pages, least).collect()}
        assert len(got) == len(rows)
        top = {}
        for p, _, h, _ in rows:
            top[h or ""] = max(top.get(h or "", 0), p)
        for p, u, h, _ in rows:
            raw = (h or "").encode()
            r = got[p]
            to = top[h or ""] if len(raw) >= least else p
            assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), warc.digest32(raw), u or "")
            assert (r.record_type, r.refers_to) == (("response", None) if to == p else ("revisit", to))
            assert r.payload == (raw if to == p else None)
    assert warc.round_trip(pages.limit(0)).collect() == []


# -- near-duplicates and components -----------------------------------------------

def test_components(spark, tmp_path):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = common.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), str(tmp_path), "cc")
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {x.node: x.root for x in got.collect()} == {k: v for k, v in root.items() if k not in loops}
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert common.connected_components(none, str(tmp_path), "none").collect() == []


@pytest.mark.parametrize("unit", [2_000_000, 150])
def test_near_duplicates_edges(spark, docs, empty, unit):
    r, base = random.Random(9), words(120, 11).split()
    rows = []
    for i in range(60):                      # a chain of edits: far ends are not linked directly
        if i % 3 == 0:
            base[r.randrange(len(base))] = f"new{i}"
        rows.append((1000 + i, " ".join(base), "en", "a", 0))
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    want = brute.near_components({x[0]: x[1] for x in edge_rows() + rows})
    got = minhash.near_duplicates(clash(df, "component_id", "bands"), unit_shingles=unit).collect()
    assert len(got) == len(edge_rows()) + len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert minhash.near_duplicates(empty).collect() == []


# -- repeated strings ----------------------------------------------------------------

@pytest.mark.parametrize("unit", [8192, 2])
def test_repeats_edges(spark, docs, empty, unit):
    r = random.Random(4)
    passage = words(60, 20)
    rows = [(100 + i, words(r.randrange(3, 40), 50 + i) + " " + passage + " " + words(r.randrange(3, 40), 90 + i),
             None, None, 0) for i in range(12)]
    rows += [(200, "ab" * 300, None, None, 0), (201, "q" * 199, None, None, 0), (202, "q" * 201, None, None, 0),
             (203, "é" * 150, None, None, 0), (204, words(30, 70) + passage[40:260] + "Z", None, None, 0)]
    df = docs.where("doc_id <> 10").unionByName(spark.createDataFrame(rows, SCHEMA))
    want = brute.repeated_bytes({x[0]: (x[1] or "").encode() for x in edge_rows() + rows if x[0] != 10}, 200)
    res = suffix_dedup.remove_repeats(clash(df, "first", "part"), unit=unit)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(res).collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_order_and_collisions():
    r = random.Random(1)
    text = np.frombuffer("".join(r.choice("ab") for _ in range(900)).encode(), np.uint8)
    at = np.array(r.sample(range(600), 300))
    group = np.array([r.randrange(4) for _ in at])
    sums, inv = suffix_dedup.prefix_hashes(text)
    order = suffix_dedup.suffix_sort(group, at, text, sums, inv, 200)
    raw = text.tobytes()
    keys = [(group[i], raw[at[i]:at[i] + 200]) for i in order]
    assert keys == sorted(keys)


# -- language, fingerprints -------------------------------------------------------------

def test_language_edges(spark, docs, empty):
    rows = [(i, (words(40, i) if i % 2 else words(40, i).replace("a", "ü").replace("b", "z")), "en" if i % 2 else "de",
             "a", 0) for i in range(100, 160)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(train)
    got = {}
    for x in language_id.predict(clash(docs, "score", "rejected"), model).collect():
        got[x.doc_id] = x
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[10].lang_pred == "en" and not got[10].rejected
    far = spark.createDataFrame([(1, "Широка страна моя родная много в ней лесов полей и рек " * 9, "en", "", 0)], SCHEMA)
    assert language_id.predict(far, model).first().rejected
    nothing = language_id.fit(empty)
    assert {x.lang_pred for x in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).collect() == []


def test_winnowing_guarantee_and_edges(spark, docs, empty):
    run = words(11, 77)
    a, b = words(50, 5) + " " + run + " " + words(50, 6), words(30, 7) + " " + run
    cut = lambda s: re.findall(r"\S{1,8}", s)
    assert len(cut(run)) >= 11
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")
    fp = {x.doc_id: set(x.fp) for x in df.select("doc_id", winnowing.fingerprint("text").alias("fp")).collect()}
    hashes = lambda s: {x >> 24 for x in s}
    assert hashes(fp[1]) & hashes(fp[2]) and fp[1] == fp[3]
    got = winnowing.fingerprints(clash(docs, "fp", "block")).collect()
    assert len(got) == len(edge_rows())
    by = {x.doc_id: x for x in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == ""
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0
    assert winnowing.fingerprints(empty).collect() == []


def test_winnowing_picks_rightmost_minima(spark):
    """Against a direct version of the method."""
    text = "a b c d a b c d a b c d a b c d e f g h " + words(60, 8)
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(winnowing.fingerprint("text").alias("fp")).first().fp
    h = [x[0] for x in df.select(F.explode(F.expr("regexp_extract_all(text, r'[^ ]{1,8}', 0)")).alias("t"))
         .select(F.xxhash64("t")).collect()]
    m = (1 << 64) - 1
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & m
    u = [x & m for x in h]
    grams = [rot(rot(u[i], 7) ^ u[i + 1], 14) ^ rot(u[i + 2], 7) ^ u[i + 3] for i in range(len(u) - 3)]
    signed = [g - (1 << 64) if g >> 63 else g for g in grams]
    vals = [x[0] for x in spark.createDataFrame([(g,) for g in signed], "g bigint").select(F.xxhash64("g")).collect()]
    want = []
    for i in range(len(vals) - 7):
        low = min(v >> 24 for v in vals[i:i + 8])
        at = max(j for j in range(i, i + 8) if vals[j] >> 24 == low)
        if (low, at) not in want:
            want.append((low, at))
    assert [(x >> 24, winnowing.LAST - (x & winnowing.LAST)) for x in got] == want


# -- personal data, decontamination -----------------------------------------------------

def test_pii_base_edges(spark, empty):
    texts = [None, "", "a@b.c@d.e", "a@b.c_y@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 010.000.0.1", "4111 1111-1111 1111",
             "+1 (555) 123-4567 and +12 ((((", "😀 me@x.org 10.0.0.255", "1" * 5000, "a" * 20_000, "1 - 2 3  4",
             "+" + "1" * 15 + " " + "9" * 40, "a@b..c a@b-.-c %@%.% q@1.2.3.4", "1.1.1.1" * 50, "mail x@y.zz, " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.base] for x in pii.find(clash(df, "spans", "one", "_t", "votes")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.base_spans(t or ""), t and t[:40]
    assert pii.find(empty).collect() == []


def test_pii_method_adds_and_redacts(spark):
    rows = [(i, f"Please call phone +1 (555) 123-{4000 + i} or mail me{i}@example.org now.") for i in range(40)]
    rows += [(100 + i, f"Please call phone (555) 123-{4000 + i} today.") for i in range(20)]
    rows += [(200 + i, f"See order 555 123 {4000 + i} or version 2.0.1 of the page.") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(df)
    got = {x.doc_id: x for x in found.collect()}
    assert all(set(map(tuple, x.base)) <= set(map(tuple, x.spans)) for x in got.values())
    assert any(len(got[100 + i].spans) > len(got[100 + i].base) for i in range(20))
    assert not any(got[200 + i].spans for i in range(20))
    red = {x.doc_id: x.text for x in pii.redact(found).collect()}
    assert red[0] == "Please call phone [PHONE] or mail [EMAIL] now."
    assert red[200] == rows[60][1]


def test_pii_estimates_equal_numpy(spark):
    """Posteriors of the vote patterns and odds of the features, from plain counts."""
    import math
    rnd = random.Random(4)
    texts = [f"Call {rnd.choice(['', 'phone ', 'order '])}{rnd.choice(['+1 ', '(', ''])}{rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}, "
             f"card {rnd.randint(10**15, 10**16)} or 10.{rnd.randint(0, 300)}.3.4 {rnd.choice(['api_key=', ''])}a{rnd.randint(10**20, 10**21)}b"
             for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    t = pii.with_candidates(pii.with_base(df.withColumn("_text", F.col("text")), "_text"))
    cands = [x for r in t.select("_cand").collect() for x in r["_cand"]]
    model = pii.train(t).first()
    for kind in {x.kind for x in cands}:
        own = [x for x in cands if x.kind == kind]
        want = brute.em(Counter(tuple(x.v) for x in own))
        for v, q in want.items():
            assert abs(model["votes"][f"{kind}:{','.join(map(str, v))}"] - q) < 1e-9
        a, b = sum(want[tuple(x.v)] for x in own), sum(1 - want[tuple(x.v)] for x in own)
        assert abs(model["odds"][kind] - math.log((a + 0.5) / (b + 0.5))) < 1e-6
        for j in range(len(pii.FEATURES)):
            for value in {x.f[j] for x in own}:
                y = sum(want[tuple(x.v)] for x in own if x.f[j] == value)
                z = sum(1 - want[tuple(x.v)] for x in own if x.f[j] == value)
                odds = math.log((y + 0.5) / (a + 1) / ((z + 0.5) / (b + 1)))
                assert abs(model["odds"][f"{kind}:{j}:{value}"] - odds) < 1e-6


def test_pii_takes_many_matches_in_one_text(spark):
    import time
    n = 25_000
    df = spark.createDataFrame([(1, "10.1.2.3 a@b.co " * n), (2, "write to me at home dot com, phone (555) 123-4567 " * 2000)],
                               "doc_id bigint, text string")
    t = time.time()
    found = pii.find(df)
    got = {x.doc_id: x for x in found.collect()}
    assert len(got[1].base) == 2 * n and [x.start for x in got[1].base[:2]] == [9, 25] and got[1].base[-1].start == 16 * (n - 1)
    red = {x.doc_id: x.text for x in pii.redact(found).collect()}
    assert red[1] == "[IP] [EMAIL] " * n
    spans = sorted((x.start, x.end) for x in got[2].spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert time.time() - t < 120


def test_decontamination_edges(spark):
    q = "A farmer sells 12 kg of apples to Maria and 30 kg to Peter, then Maria gives 12 kg to a friend every week."
    same = q.replace("12", "45").replace("30", "7").replace("Maria", "Wanda").replace("Peter", "Otto")
    wrong = q.replace("12 kg of", "45 kg of").replace("30", "7").replace("12 kg to a", "99 kg to a")
    plain = "which of these seven rivers flows north through nine different countries before it meets the sea"
    bench = spark.createDataFrame([(1, q), (2, plain), (3, None), (4, "too short"), (2, plain)],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "Intro text here. " + same + " And more."), (2, wrong), (3, plain.upper().replace(" ", "!! ")),
         (4, None), (5, ""), (6, words(200, 3)), (7, "too short"), (8, " ".join(plain.split()[:9])), (None, plain)],
        "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit(2))
    for limit in (1_000_000, 0):
        got = {(x.doc_id, x.item_id): x.coverage for x in
               decontam.matches(docs, bench, coverage=0.5, broadcast_windows=limit).collect()}
        assert set(got) == {(1, 1), (3, 2)} and max(got.values()) <= 1.0
    left = {x.doc_id for x in decontam.decontaminate(docs, bench, coverage=0.5).collect()}
    assert left == {2, 4, 5, 6, 7, 8, None}
    assert decontam.matches(docs.limit(0), bench).collect() == []
    assert decontam.matches(docs, bench.limit(0)).collect() == []


def test_decontamination_repeated_values(spark):
    """Independent slots that share a value by chance, in the item or in the copy."""
    train = ("A train travels {} km in {} hours and a second train travels {} km in {} hours. "
             "How far apart are they after {} hours?")
    shop = ("A girl buys {} pens at {} dollars each and {} books at {} dollars each. "
            "How much does she pay in total at the shop?")
    ship = ("The ship carries {} boxes from the port of the island to the northern harbour and leaves {} boxes "
            "there before it turns back to the island with {} boxes for the old market")
    bench = spark.createDataFrame([(1, train.format(60, 2, 90, 2, 5)), (2, shop.format(2, 3, 2, 8)),
                                   (3, ship.format(12, 12, 31))], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, train.format(50, 3, 80, 4, 6)), (2, shop.format(4, 5, 3, 9)), (3, train.format(70, 4, 70, 4, 4)),
         (4, ship.format(45, 99, 45)), (5, words(100, 8))], "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 3)}
    assert got[1, 1].windows == got[3, 1].windows == 19 and got[1, 1].coverage == 1.0
    assert 0.3 <= got[4, 3].coverage < 1.0      # the windows of 12 are dropped, the others stay


def test_decontamination_short_and_dense_items(spark):
    bench = spark.createDataFrame(
        [(1, "What is 12 percent of 250?"), (2, "Compute the sum of 12, 15, 18, 21, 24 and 27"),
         (3, "Add 12, 15, 18, 21, 24 and 27 now"), (4, "Who wrote Hamlet?"), (5, "11 22 33 44 55 66 77 88 99"),
         (6, "two tokens")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "What is 12 percent of 250?"), (2, "Easy. What is 15 percent of 80? It is 12."),
         (3, "Now compute the sum of 2, 5, 8, 11, 14 and 17"), (4, "Please add 1, 2, 3, 4, 5 and 6 now"),
         (5, words(30, 1) + " who wrote hamlet " + words(30, 2)), (6, "What is 12 percent? Who wrote it?"),
         (7, "11 22 33 44 55 66 77 88 99"), (8, "12 13 14 15 16 17 18 19 20 21"), (9, "two tokens"), (10, "Hamlet"), (11, "Who wrote Macbeth?")],
        "doc_id bigint, text string")
    for limit in (1_000_000, 0):
        got = {(x.doc_id, x.item_id): x.coverage
               for x in decontam.matches(docs, bench, broadcast_windows=limit).collect()}
        assert got == {(k, i): 1.0 for k, i in [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5), (11, 4)]}


def test_near_duplicates_keep_every_text_of_an_id(spark):
    """Links do not depend on which row of a repeated id comes first."""
    a, b = words(60, 41).split(), words(60, 42).split()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b[:-1] + ["end"])), (3, " ".join(a[:-1] + ["end"]))]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        df = spark.createDataFrame(order, "doc_id bigint, text string").coalesce(1)
        for small in ({}, {"unit_documents": 2}):
            got = Counter((x.doc_id, x.component_id) for x in minhash.near_duplicates(df, **small).collect())
            assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1)])


def test_confirmation_is_not_quadratic():
    """Many short texts of one unit, linked and not: buckets, not all pairs."""
    import time
    minima = minhash.Minima(288, 7)
    rnd = random.Random(5)
    near = [minhash.shingles(" ".join(f"w{i}" for i in range(40)) + f" t{k}") for k in range(1500)]
    far = [minhash.shingles(" ".join(f"{rnd.random()}" for _ in range(14))) for _ in range(2500)]
    sets = near + far
    t = time.time()
    edges = minhash.confirm(list(range(len(sets))), sets, None, minima, 0.64, 85, 48)
    assert sorted(edges) == [(k, 0) for k in range(1, 1500)]
    assert time.time() - t < 30


def test_short_templates_leave_clean_sentences(spark):
    """A short template inside a longer sentence is no copy of the question."""
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "What is 12 percent of 250?"), (3, "Where is Paris")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "I read that critics who wrote Reviews and letters."), (2, "People who wrote Letters, and where is Rome now?"),
         (3, "They asked what is 7 percent of 90 people."), (4, "He said so. Who wrote Macbeth? Nobody knew."),
         (5, "A list\nwhere is Rome\nand more"), (6, "critics who wrote Hamlet and more")], "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.matches(docs, bench).collect()}
    assert got == {(4, 1), (5, 3), (6, 1)}
    assert got == set(brute.template_matches({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}))


def test_template_windows_equal_brute_force(spark):
    rnd = random.Random(11)
    names, units = ["Maria", "Otto", "Wanda", "Boston", "Peter"], ["km", "hours", "dollars", "kg"]

    def sentence(n):
        return " ".join(rnd.choice([rnd.choice(names), f"{rnd.randint(1, 40)} {rnd.choice(units)}", str(rnd.choice([2, 7, 15, 1200]))])
                        if rnd.random() < 0.3 else rnd.choice("buy sell has gives takes runs with from how many the".split())
                        for _ in range(n)).capitalize()

    def altered(text):
        out = " ".join(str(rnd.randint(1, 60)) if w.isdigit() and rnd.random() < 0.8 else rnd.choice(names)
                       if w in names and rnd.random() < 0.5 else w for w in text.split())
        return out if rnd.random() < 0.8 else " ".join(out.split()[:-2])

    items = {i: sentence(rnd.choice([2, 3, 4, 5, 6, 9, 14, 20])) for i in range(30)}
    docs = {k: rnd.choice(["", "Intro. ", "intro "]) + altered(rnd.choice(list(items.values()))) + rnd.choice(["", ". End.", " end", "?"])
            + (" " + altered(rnd.choice(list(items.values()))) if k % 3 == 0 else "") for k in range(150)}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    want = brute.template_matches(docs, items)
    assert len(want) > 60
    for limit in (1_000_000, 0):
        got = {(x.doc_id, x.item_id): x.windows for x in decontam.matches(table, bench, broadcast_windows=limit).collect()}
        assert got == want


def test_bitmap_grows_with_the_benchmark(spark):
    hashes = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    sql, words = decontam.bitmap(hashes)
    assert words == 32_768                     # under a twentieth of the bits are set
    seen, other = hashes, spark.range(100_000, 140_000).select(F.xxhash64("id").alias("h"))
    rate = lambda d: d.select(F.expr(f"(shiftright(({sql})[pmod(shiftright(h, 6), {words})], cast(h & 63 AS int)) & 1)").alias("b")
                              ).agg(F.avg("b")).first()[0]
    assert rate(seen) == 1.0 and rate(other) < 0.07
    assert decontam.bitmap(hashes, most=4096)[1] == 4096


def test_pipeline_stages_take_any_rows(spark, empty):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing extra columns, empty tables."""
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    rows = edge_rows() + edge_rows()[:3] + [(None, None, None, None, None), (77, "w " * 60_000 + "end", "en", "a", None),
                                            (78, "q" * 100_000, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = clash(docs, "row", "group", "key", "spans", "base", "rejected", "score", "length", "bands", "item", "_text")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, SF_SMALL)
        assert out.columns == corpus_pipeline.COLUMNS
        assert out.count() <= docs.count()
        assert step(spark, empty, SF_SMALL).collect() == []
    _, last = corpus_pipeline.STAGES[-1]
    t = tok(WORDS)
    want = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r["length"] for r in last(spark, odd, SF_SMALL).collect()) == want
    assert last(spark, empty, SF_SMALL).collect() == []


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    from voxlex.llm.common import table
    item = table(spark, SF_SMALL, "benchmark").where("text IS NOT NULL").first().text
    a, b, c, d = (words(80, 300 + i) for i in range(4))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, c), (None, b), (None, d), (None, d), (4, None), (4, ""), (5, item),
            (5, c + " tail"), (None, item)]
    docs = spark.createDataFrame([(k, t, "en", "a", i) for i, (k, t) in enumerate(rows)], SCHEMA)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL)
    assert near.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in near.collect()) == Counter(
        [(1, a), (2, b), (3, c), (None, d), (4, None), (4, ""), (5, item)])
    left = corpus_pipeline.drop_contaminated(spark, docs, SF_SMALL)
    assert left.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in left.collect()) == Counter(r for r in rows if r[1] != item)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF_SMALL).collect() == []
