"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its runs of non-blank characters, cut after eight
characters (so that texts without blanks have tokens too).  Every k = 4 tokens
get a cyclic-polynomial hash; of every window of w = 8 consecutive hashes the
smallest is kept, the rightmost of equals, with its position.  Hence any shared
run of k + w - 1 = 11 tokens contributes a common hash, wherever it lies.

Hashes are combined by doubling (pairs, then pairs of pairs; likewise the
minima of windows), so a text takes time linear in its length.  A hash and its
position share one number: 40 bits of hash above, 24 bits of distance from the
largest position below, which makes "smallest, rightmost" a plain minimum.

A text with fewer tokens than k is one k-gram of all of them, with fewer
windows one window; a null or blank text has an empty fingerprint.  Likeness is
the Jaccard index of two fingerprints' hashes, 1 for two empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = (1 << 24) - 1


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` evaluated once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def rotl(x: str, n: int) -> str:
    return f"(shiftleft({x}, {n}) | shiftrightunsigned({x}, {64 - n}))"


def fingerprint(text: str) -> Column:
    """array<bigint>: the kept (hash, position) numbers in text order."""
    pairs = f"transform(slice(h, 1, size(h) - 1), (x, i) -> {rotl('x', 7)} ^ h[i + 1])"
    fours = f"transform(slice(a, 1, size(a) - 2), (x, i) -> {rotl('x', 14)} ^ a[i + 2])"
    # a last multiplication-free mix: the library hash of the combined value
    whole = "array(aggregate(h, 0L, (s, x) -> (shiftleft(s, 7) | shiftrightunsigned(s, 57)) ^ x))"
    grams = f"IF(size(h) < 4, {whole}, {let('a', pairs, fours)})"
    packed = f"transform(g, (x, i) -> (xxhash64(x) & {~LAST}L) | ({LAST}L - i))"
    low = lambda v, d: f"transform(slice({v}, 1, size({v}) - {d}), (x, i) -> least(x, {v}[i + {d}]))"
    minima = let("b", low("p", 1), let("c", low("b", 2), low("c", 4)))
    kept = let("m", minima, "filter(m, (x, i) -> i = 0 OR x <> m[greatest(i, 1) - 1])")
    body = let("g", grams, let("p", packed, f"IF(size(p) < 8, array(array_min(p)), {kept})"))
    tokens = f"regexp_extract_all({text}, r'[^ \\t\\n\\x0B\\f\\r]{{1,8}}', 0)"
    return F.expr(let("h", f"transform({tokens}, x -> xxhash64(x))",
                      f"IF(size(h) = 0, cast(array() AS array<bigint>), {body})"))


def as_text(fp: str) -> Column:
    """'hash:position' of every kept number, blank-joined."""
    return F.expr(f"array_join(transform({fp}, x -> concat(lower(hex(shiftrightunsigned(x, 24))), ':', "
                  f"{LAST}L - (x & {LAST}L))), ' ')")


def likeness(a: str, b: str) -> Column:
    hashes = "array_distinct(transform({0}, x -> shiftrightunsigned(x, 24)))"
    return F.expr(let("u", hashes.format(a), let("v", hashes.format(b), let(
        "n", "size(array_intersect(u, v))",
        "IF(size(u) + size(v) = 0, 1.0D, cast(n AS double) / (size(u) + size(v) - n))"))))


def with_next(docs: DataFrame, blocks: int = 100_000, block_rows: int = 256) -> DataFrame:
    """(doc_id, t, fp, next_t, next_fp): every row with the next one in
    descending doc_id order (equal ids by text hash, null ids last; the last
    row's next is the first).

    Rows are dealt out by ranges of doc_id, at most ``blocks`` of them, and
    read their successor inside the range; each range also gets a copy of the
    first row of the range below it.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    lo, hi, n = d.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    parts = max(1, min(blocks, n // block_rows))
    width = -(-(hi - lo + 1) // parts)
    d = d.withColumn("h", F.xxhash64("t")).withColumn(
        "block", F.coalesce(F.expr(f"(doc_id - {lo}L) div {width}L"), F.lit(-1).cast("bigint")))
    # one row per block: at most ``blocks`` + 1 rows
    heads = d.groupBy("block").agg(F.max(F.struct("doc_id", "h")).alias("m"))
    order = Window.orderBy(F.col("block").desc())
    halo = heads.select("m", F.lag("block").over(order).alias("to"),
                        F.min("block").over(Window.partitionBy()).alias("end"))
    halo = halo.select(F.col("m.doc_id").alias("i"), F.col("m.h").alias("j"), F.coalesce("to", "end").alias("to"))
    copies = (d.join(F.broadcast(halo), d["doc_id"].eqNullSafe(F.col("i")) & (d["h"] == F.col("j")))
              .select("doc_id", "t", "h", F.col("to").alias("block"), F.lit(1).alias("copy")))
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (d.withColumn("copy", F.lit(0)).select("doc_id", "t", "h", "block", "copy").unionByName(copies)
            .repartition(tasks, "block").withColumn("fp", fingerprint("t")))
    w = Window.partitionBy("block").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return (rows.withColumn("next_t", F.lead("t").over(w)).withColumn("next_fp", F.lead("fp").over(w))
            .where("copy = 0").select("doc_id", "t", "fp", "next_t", "next_fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half
    replaced by the beginning of the next document)."""
    x = with_next(docs).withColumn("n_chars", F.char_length("t").cast("bigint"))
    x = x.withColumn("edited", F.expr("concat(substring(t, 1, cast(n_chars - n_chars div 2 AS int)), "
                                      "substring(next_t, 1, cast(n_chars div 2 AS int)))"))
    x = x.withColumn("edited_fp", fingerprint("edited"))
    return x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
                    likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
