"""Registered queries against brute force on the smallest tables."""

import base64
import glob
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_SMALL
from voxlex.llm import registry

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows(name):
    return pq.read_table(f"{SF_SMALL}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict(recursive=True) for r in registry.QUERIES[name](spark, SF_SMALL).collect()]


def tok(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(str(public_tokenizers.path(name)))


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))


def test_op1(spark):
    from tests.llm.brute import base_spans, secret_spans
    got = {r["doc_id"]: r for r in run(spark, "op1_pii")}
    docs = rows("documents")
    assert len(got) == len(docs)
    for d in docs:
        spans = [f"{k}:{a}:{z}" for k, a, z in base_spans(d["text"] or "")]
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        # what the method adds on these tables: keys by their form, context and digits
        added = [f"{k}:{a}:{z}" for k, a, z in secret_spans(d["text"] or "")]
        assert r["spans"] == ",".join(spans + added)
        for k in ("email", "ip", "card", "phone"):
            assert r[f"n_{k}"] == sum(s.startswith(k) for s in spans)


def test_op2(spark):
    from tests.llm.brute import near_components
    docs = {d["doc_id"]: d["text"] for d in rows("documents")}
    want = near_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op2_minhash")}
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_op3(spark):
    docs = {d["doc_id"]: d["text"] or "" for d in rows("documents")}
    got = {r["doc_id"]: r for r in run(spark, "op3_winnowing")}
    ids = sorted(docs, reverse=True)

    def like(a, b):
        a, b = ({x.split(":")[0] for x in s.split()} for s in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, k in enumerate(ids):
        nxt, t, r = ids[(i + 1) % len(ids)], docs[k], got[k]
        edited = t[:len(t) - len(t) // 2] + docs[nxt][:len(t) // 2]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(like(r["fingerprint"], got[nxt]["fingerprint"]))


def test_op4(spark):
    docs = {d["doc_id"]: d for d in rows("documents")}
    got = run(spark, "op4_language_id")
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def plain_grams(text, dims):
    """Counts of hashed letter n-grams by loops over the text."""
    m, out = 0xFFFFFFFF, Counter()
    c, was = [0], True                       # 0 stands for anything but a letter, once between words
    for x in (text or "").lower():
        if x.isalpha() or not was:
            c.append(ord(x) if x.isalpha() else 0)
        was = not x.isalpha()
    if c[-1] != 0:
        c.append(0)
    two = [(a * 0x85EBCA6B + b * 0xC2B2AE35) & m for a, b in zip(c, c[1:])]
    three = [(t * 0x27D4EB2F + b * 0x165667B1 + 77) & m for t, b in zip(two, c[2:])]
    for x in [a * 0x9E3779B1 & m for a in c if a] + two + three:
        x = (x ^ x >> 15) * 0x2C1B3C6D & m
        out[(x ^ x >> 13) & dims - 1] += 1
    return out if any(c) else None


def test_op4_is_the_nearest_centroid(spark):
    """Document frequencies, vectors and nearest centroids in plain Python."""
    import math
    from pyspark.sql import functions as F
    from voxlex.llm import language_id
    from voxlex.llm.common import table
    docs = {d["doc_id"]: d for d in rows("documents")}
    grams = {k: plain_grams(d["text"], 8192) for k, d in docs.items()}
    train = [k for k, d in docs.items() if d["lang"] is not None and grams[k] and zlib.crc32(str(k).encode()) % 4 != 2]
    df = Counter(x for k in train for x in grams[k])
    idf = {x: math.log((1 + len(train)) / (1 + df[x])) + 1 for x in range(8192)}
    held = F.coalesce(language_id.fold() == 2, F.lit(False))
    model = language_id.fit(table(spark, SF_SMALL, "documents").where(~held))
    assert np.allclose(model["idf"], [idf[x] for x in range(8192)], rtol=1e-5)
    assert np.allclose(np.linalg.norm(model["centroids"], axis=1), 1.0, atol=1e-4)
    for r in run(spark, "op4_language_id"):
        g = grams[r["doc_id"]]
        if g is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = {x: (1 + math.log(n)) * idf[x] for x, n in g.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        cos = [sum(w * float(c[x]) for x, w in v.items()) / norm for c in model["centroids"]]
        assert abs(r["score"] - max(cos)) < 1e-4
        assert cos[model["langs"].index(r["lang_pred"])] > -1 and max(
            q for q, lang in zip(cos, model["langs"]) if lang == r["lang_pred"]) > max(cos) - 1e-4


def test_op5(spark):
    t = tok(registry.BYTES)
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(t.encode(d["text"] or "", add_special_tokens=False).ids))
            for d in rows("documents")}
    got = run(spark, "op5_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_op6(spark):
    largest = {}
    pages = rows("pages")
    for p in pages:
        largest[p["html"] or ""] = max(largest.get(p["html"] or "", -1), p["page_id"])
    want = {}
    for p in pages:
        raw, to = (p["html"] or "").encode(), largest[p["html"] or ""]
        want[p["page_id"]] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                              *(("response", None) if to == p["page_id"] else ("revisit", to)))
    got = run(spark, "op6_warc")
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
            for r in got} == want


def test_op7(spark):
    from tests.llm.brute import repeated_bytes
    docs = rows("documents")
    want = repeated_bytes({d["doc_id"]: (d["text"] or "").encode() for d in docs}, 200)
    got = run(spark, "op7_suffix_dedup")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_op8(spark):
    t, start, want = tok(registry.WORDS), 0, {}
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        ids = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[d["doc_id"]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op8_token_files")} == want


def test_op9(spark):
    """Every document that holds a run of eight words of an item, and no other
    (in these tables, passages are whole items)."""
    words = lambda s: re.findall(r"[^\W\d_]+|\d+", (s or "").lower())
    grams = defaultdict(set)
    for b in rows("benchmark"):
        w = words(b["text"])
        for i in range(len(w) - 7):
            grams[tuple(w[i:i + 8])].add(b["item_id"])
    want = set()
    for d in rows("documents"):
        w, hits = words(d["text"]), Counter()
        for g in {tuple(w[i:i + 8]) for i in range(len(w) - 7)}:
            hits.update(grams.get(g, ()))
        want |= {(d["doc_id"], k) for k, n in hits.items() if n > 3}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op9_decontamination")} == want


def check_packing(got, want_ids, capacity=2048):
    """Pieces are the documents cut in order; sequences are gapless; the
    number of sequences is at most one over the lower bound."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(want_ids)
    for k, ids in want_ids.items():
        p = sorted(pieces[k], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in p] == [
            (i, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes()))
            for i, s in enumerate(range(0, len(ids), capacity))]
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(map(len, want_ids.values()))
    assert len(seqs) <= -(-total // capacity) + 1


def test_op10(spark):
    t = tok(registry.WORDS)
    check_packing(run(spark, "op10_packing"),
                  {d["doc_id"]: t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
                   for d in rows("documents")})


def test_pipeline(spark):
    """The stages against brute force: kept documents, redacted texts, packing."""
    import corpus_pipeline
    from tests.llm.brute import base_spans, near_components, secret_spans
    docs = {d["doc_id"]: d["text"] for d in rows("documents")}
    docs = {k: t for k, t in docs.items() if t and any(c.isalpha() for c in t)}
    docs = {k: docs[k] for k, (_, c) in near_components(docs).items() if c == k}
    words = lambda s: re.findall(r"[^\W\d_]+|\d+", (s or "").lower())
    grams = {tuple(w[i:i + 8]) for w in (words(b["text"]) for b in rows("benchmark")) for i in range(len(w) - 7)}
    kept = {}
    for k, t in docs.items():
        w = words(t)
        if sum(tuple(w[i:i + 8]) in grams for i in range(len(w) - 7)) > 3:
            continue
        out, at = [], 0
        for kind, a, z in sorted(base_spans(t) + secret_spans(t), key=lambda s: (s[1], -s[2])):
            if z > at:
                out.append(t[at:a] + f"[{kind.upper()}]" if a >= at else "")
                at = z
        kept[k] = "".join(out) + t[at:]
    enc = tok(registry.WORDS)
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    check_packing(got, {k: enc.encode(t, add_special_tokens=False).ids + [0] for k, t in kept.items()})
    assert len(glob.glob(f"{SF_SMALL}/*.parquet")) > 0
