"""Personal data by weak supervision, in DataFrame functions only.

Base spans follow fixed patterns: e-mail addresses, IPv4 addresses, card
numbers (13 to 19 digits passing the Luhn check) and international phone
numbers (9 to 15 digits), leftmost and non-overlapping per kind.  They always
stay.

Further spans come from broader candidate patterns (written-out addresses,
digit groups, and secrets: long runs of letters and digits).  Four labelers vote
+1, 0 or -1 on every candidate and every base match: its form, a gazetteer
(known endings, issuer and country prefixes, private networks, key prefixes),
the words before it, and a checksum or range test.
Expectation-maximisation estimates how often each labeler votes what for true
and false candidates of a kind; it runs on the counts of vote patterns (at most
81 a kind).  The posteriors of the patterns then train the final span
classifier, a naive Bayes model over features of a candidate that no labeler
sees (``FEATURES``), again from counts: a prior per kind and, for every value of
every feature, how often it occurs in true and in false candidates.  A
candidate is added when the classifier and the posterior of its votes are both
at least ``accept``, its form or the words before it speak for it, and no
labeler against it; candidates that overlap a base span of the row, or an
earlier addition, are dropped.

The patterns are possessive and anchored at the start of a run, so that texts
without any match take linear time; so do texts with many matches, but for
sorting them.  Positions are code points, ends are
exclusive.  Null texts are empty.  Rows are independent given the model; an
empty table trains nothing and returns an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlex.llm.common import stage, workspace
from voxlex.llm.winnowing import let

#: Kinds in their order (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: With the kinds that have wider candidates only.
ALL_KINDS = KINDS + ("secret",)
#: The base patterns, in forms that match the same spans in linear time:
#: a match starts where its run of characters starts or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Broader patterns of the candidates; (kind, what a text must hold, pattern).
WIDER = (
    ("email", r"(?i)[\[({<] ?at ?[\])}>]| at [a-z0-9-]+ dot ",
     r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:[\[({<] ?at ?[\])}>]| at ) ?[a-z0-9-]{1,63}+"
     r"(?: ?(?:[\[({<] ?dot ?[\])}>]| dot |\.) ?[a-z0-9-]{1,63}+){1,4}"),
    ("phone", r"[0-9][0-9 ().-]{5,}[0-9]",
     r"(?<![0-9A-Za-z+.-])[0-9(][0-9 ().-]{5,20}[0-9](?![0-9A-Za-z])"),
    ("secret", r"[A-Za-z0-9+/_-]{20}",
     r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])"),
)
#: Words before a span that speak for a kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|correo|courriel|contact|write to)\b[^A-Za-z0-9]{0,4}(?:[a-z]{1,4} ){0,2}$",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse)\b[^A-Za-z0-9]{0,4}(?:[a-z]{1,4} ){0,2}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\b[^A-Za-z0-9]{0,4}(?:[a-z]{1,7} ){0,2}$",
    "phone": r"(?i)\b(?:tel|telefon|phone|call|mobile|cell|fax|sms|whatsapp|telefono|portable|handy)\b"
             r"[^A-Za-z0-9]{0,4}(?:[a-z]{1,7} ){0,2}$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|api.?key|access.?key|auth|bearer|credential)s?[^A-Za-z0-9]{1,5}$",
}
#: Words before a span that speak against personal data.
COUNTER = r"(?i)\b(?:version|isbn|issn|order|invoice|page|section|chapter|serial|license|licence|doi|no|commit|sha[0-9]*|md5|checksum|digest|etag|revision)\b[^A-Za-z0-9]{0,3}$"
#: Gazetteers: endings of addresses, issuer and country prefixes, networks.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35|3[068])",
    "phone": r"^(?:1|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"^(?:gh[pousr]_|sk-|AKIA|xox[abp]-|glpat-|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$)",
}
#: A match: place, text and up to ``BEFORE`` characters in front of it.
BEFORE = 30
SPAN = "array<struct<kind:string,start:int,end:int,hit:string,pre:string>>"
PLAIN = "array<struct<kind:string,start:int,end:int,hit:string>>"


def running(values: str, op: str) -> str:
    """SQL: running ``op`` (sum, greatest or least) over an int array, by
    doubling the reach: n log n steps, where appending to an array would copy it
    n times."""
    far = "a[greatest(0, i - shiftleft(1, k))]"
    both = f"x + {far}" if op == "sum" else f"{op}(x, {far})"
    step = f"transform(a, (x, i) -> IF(i >= shiftleft(1, k), {both}, x))"
    return let("q", values, f"aggregate(sequence(0, cast(ceil(log2(greatest(1, size(q)))) AS int)), q, (a, k) -> {step})")


def spans_of(text: str, kind: str, pattern: str, need: str) -> str:
    """SQL: spans of all matches, from the pieces between them; linear in the
    text, n log n in its matches."""
    p = "r'" + pattern + "'"
    hits, parts = f"regexp_extract_all({text}, {p}, 0)", f"split({text}, {p}, -1)"
    front = f"right(concat(IF(i > 0, concat(m.p[greatest(0, i - 1)], m.h[greatest(0, i - 1)]), ''), m.p[i]), {BEFORE})"
    made = let("m", f"struct({hits} AS h, {parts} AS p)", let(
        "n", "transform(m.h, (x, i) -> char_length(m.p[i]) + char_length(x))", let(
            "e", running("n", "sum"), f"""transform(m.h, (x, i) -> struct('{kind}' AS kind, e[i] - char_length(x) AS start,
              e[i] AS end, x AS hit, {front} AS pre))""")))
    return f"IF({text} RLIKE r'{need}', {made}, cast(array() AS {SPAN}))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL: whether the digit string passes the Luhn check."""
    return f"""aggregate(sequence(1, greatest(1, length({d}))), 0, (s, i) -> s + transform(
      array(cast(substring({d}, length({d}) - i + 1, 1) AS int)),
      v -> IF(i % 2 = 1, v, IF(v > 4, 2 * v - 9, 2 * v)))[0]) % 10 = 0"""


def octets(x: str) -> str:
    return f"""forall(split({x}, '[.]'), o -> length(ltrim('0', o)) <= 3
      AND cast(concat('0', substring(ltrim('0', o), 1, 3)) AS int) <= 255)"""


VALID = {
    "email": "true",
    "ip": octets("x.hit"),
    "card": f"length({digits('x.hit')}) BETWEEN 13 AND 19 AND {luhn(digits('x.hit'))}",
    "phone": f"length({digits('x.hit')}) BETWEEN 9 AND 15",
    "secret": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 3 AND length(x.hit) - 3",
}
#: Features of the classifier, by name: SQL over ``x.hit``.
FEATURES = {
    "digits": f"cast(least(8, length({digits('x.hit')}) div 3) AS string)",
    "length": "cast(least(12, length(x.hit) div 4) AS string)",
    "breaks": "cast(least(3, length(regexp_replace(x.hit, '[^ -]', ''))) AS string)",
    "brackets": "IF(x.hit RLIKE '[()]', 'y', 'n')",
    "dots": "cast(least(4, length(regexp_replace(x.hit, '[^.]', ''))) AS string)",
    "ends": "concat(IF(x.hit RLIKE '^[0-9]', '9', IF(x.hit RLIKE '^[A-Za-z]', 'a', '.')), "
            "IF(x.hit RLIKE '[0-9]$', '9', IF(x.hit RLIKE '[A-Za-z]$', 'a', '.')))",
}
#: Cheap tests that every text with a match passes.
NEED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_t`` (the text), ``_all`` (all base matches) and ``_base``
    (the valid ones), by kind, then start."""
    t = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    for k in KINDS:
        t = t.withColumn(f"_{k}", F.expr(spans_of("_t", k, BASE[k], NEED[k])))
    t = t.withColumn("_all", F.concat(*[F.col(f"_{k}") for k in KINDS]))
    plain = "struct(x.kind AS kind, x.start AS start, x.end AS end, x.hit AS hit)"
    valid = F.concat(*[F.expr(f"transform(filter(_{k}, x -> {VALID[k]}), x -> {plain})") for k in KINDS])
    return t.withColumn("_base", valid).drop(*[f"_{k}" for k in KINDS])


def with_candidates(t: DataFrame) -> DataFrame:
    """Adds ``_cand``: base matches and wider matches with their votes and
    features, each as struct(kind, start, end, hit, v, f, is_base)."""
    wide = F.concat(*[F.expr(spans_of("_t", k, p, need)) for k, need, p in WIDER])
    t = t.withColumn("_wide", wide)
    pick = lambda table: "CASE x.kind " + " ".join(
        f"WHEN '{k}' THEN r'{table[k]}'" for k in ALL_KINDS) + " END"
    check = " ".join(f"WHEN '{k}' THEN IF({VALID[k]}, 1, -1)" for k in ALL_KINDS if k != "email")
    before = "x.pre"
    d = digits("x.hit")
    votes = rf"""array(
      IF(is_base OR x.kind = 'secret' AND x.pre RLIKE '["\'=:]$' OR x.kind = 'email' AND x.hit RLIKE r'[\[({{<] ?(?i:at|dot) ?[\])}}>]', 1,
         IF(x.kind = 'phone' AND NOT x.hit RLIKE '[ ().-]', -1, 0)),
      IF(IF(x.kind IN ('card', 'phone'), {d}, x.hit) RLIKE {pick(GAZETTEER)}, 1, 0),
      IF({before} RLIKE {pick(CUES)}, 1, IF({before} RLIKE r'{COUNTER}', -1, 0)),
      CASE x.kind {check} ELSE 0 END)"""
    f = f"array({', '.join(FEATURES.values())})"
    def made(arr, flag):
        v = votes.replace("is_base", flag)
        return F.expr(f"""transform({arr}, x -> struct(x.kind AS kind, x.start AS start, x.end AS end,
                          x.hit AS hit, {v} AS v, {f} AS f, {flag} AS is_base))""")
    return t.withColumn("_cand", F.concat(made("_all", "true"), made("_wide", "false"))).drop("_wide")


def em_sql(rounds: int, smooth: float) -> str:
    """SQL over ``p``, an array of struct(v array<int>, n double): the
    reliabilities of the four labelers, struct(prior, pos, neg), where
    pos[3 l + v + 1] is the chance of vote v of labeler l on a true span."""
    like = lambda t: f"aggregate(sequence(0, 3), 1.0D, (a, l) -> a * s.{t}[3 * l + e.v[l] + 1])"
    post = f"transform(p, e -> struct(e.v AS v, e.n AS n, s.prior * {like('pos')} AS a, (1 - s.prior) * {like('neg')} AS b))"
    soft = f"transform({post}, e -> struct(e.v AS v, e.n AS n, e.a / (e.a + e.b) AS q))"

    def rate(weight):
        num = f"aggregate(q, {smooth}D, (a, e) -> a + IF(e.v[j div 3] = j % 3 - 1, e.n * {weight}, 0D))"
        den = f"aggregate(q, {3 * smooth}D, (a, e) -> a + e.n * {weight})"
        return f"transform(sequence(0, 11), j -> {num} / {den})"

    half = "array({0})"
    pos = half.format(", ".join(["0.1D, 0.3D, 0.6D"] * 4))
    neg = half.format(", ".join(["0.6D, 0.3D, 0.1D"] * 4))
    return f"""aggregate(sequence(1, {rounds}), struct(0.5D AS prior, {pos} AS pos, {neg} AS neg),
      (s, i) -> transform(array({soft}), q -> struct(
        aggregate(q, 1.0D, (a, e) -> a + e.n * e.q) / aggregate(q, 2.0D, (a, e) -> a + e.n) AS prior,
        {rate('e.q')} AS pos, {rate('(1 - e.q)')} AS neg))[0])"""


def train(cands: DataFrame, rounds: int = 25, smooth: float = 0.5) -> DataFrame:
    """One row: ``votes`` map 'kind:votes' -> posterior, ``odds`` map -> log odds
    ('kind' of a true span, 'kind:feature:value' what the value adds).  Both
    are bounded by the number of vote patterns and feature values, not by the
    input; the counts are written, so the texts are read once."""
    # outer: else Spark tests the array's size first and computes it twice
    c = cands.select(F.explode_outer("_cand").alias("x")).where("x IS NOT NULL").select("x.kind", "x.v", "x.f")
    cells = c.groupBy("kind", "v", "f").agg(F.count("*").cast("double").alias("n"))
    cells = stage(cells, workspace(cands.sparkSession, "votes"), "cells")
    pattern = cells.groupBy("kind", "v").agg(F.sum("n").alias("n"))
    fitted = pattern.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p")).withColumn(
        "s", F.expr(em_sql(rounds, smooth)))
    like = lambda t: f"aggregate(sequence(0, 3), 1.0D, (a, l) -> a * s.{t}[3 * l + e.v[l] + 1])"
    post = fitted.select("kind", F.expr(f"""explode(transform(p, e -> struct(e.v AS v,
        s.prior * {like('pos')} / (s.prior * {like('pos')} + (1 - s.prior) * {like('neg')}) AS q)))""").alias("e")) \
        .select("kind", "e.v", "e.q")
    both = cells.join(post, ["kind", "v"]).select("kind", "f", (F.col("n") * F.col("q")).alias("a"),
                                                  (F.col("n") * (1 - F.col("q"))).alias("b"))
    whole = both.groupBy("kind").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    prior = whole.select(F.col("kind").alias("k"), F.log((F.col("all_a") + smooth) / (F.col("all_b") + smooth)).alias("w"))
    value = (both.select("kind", F.posexplode("f").alias("j", "x"), "a", "b").groupBy("kind", "j", "x")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(whole, "kind"))
    rate = lambda n, total: (F.col(n) + smooth) / (F.col(total) + 2 * smooth)
    value = value.select(F.concat_ws(":", "kind", "j", "x").alias("k"), F.log(rate("a", "all_a") / rate("b", "all_b")).alias("w"))
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    key = F.concat_ws(":", "kind", F.concat_ws(",", F.expr("transform(v, e -> cast(e AS string))")))
    return (post.agg(entry(key, F.col("q")).alias("votes"), F.lit(1).alias("one"))
            .join(prior.unionByName(value).agg(entry(F.col("k"), F.col("w")).alias("odds"), F.lit(1).alias("one")), "one"))


def find(docs: DataFrame, text_col: str = "text", accept: float = 0.9) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of struct(kind, start, end, hit) by
    kind, then start, to the columns of ``docs`` (columns of these names are
    replaced).  Two passes over the texts: votes for training, then spans."""
    docs = docs.drop("base", "spans")
    # the caller's columns travel as one, so that no name of theirs meets a helper's
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      F.col(f"`{text_col}`").alias("_text"))
    t = with_candidates(with_base(row, "_text"))
    model = train(t)
    key = "concat_ws(':', x.kind, array_join(transform(x.v, e -> cast(e AS string)), ','))"
    score = ("aggregate(transform(x.f, (y, j) -> coalesce(odds[concat_ws(':', x.kind, j, y)], 0.0D)), "
             "coalesce(odds[x.kind], 0.0D), (a, w) -> a + w)")
    good = f"""filter(_cand, x -> NOT x.is_base AND (x.v[0] = 1 OR x.v[2] = 1) AND NOT exists(x.v, e -> e < 0)
      AND coalesce(votes[{key}], 0) >= {accept} AND {score} >= {math.log(accept / (1 - accept))}D)"""
    # candidates and base spans in order: one that an earlier or the next base span reaches into goes
    line = "array_sort(concat({0}, {1}))".format(
        "transform(_base, x -> struct(x.start AS start, 0 AS t, x.end AS end, x.kind AS kind, x.hit AS hit))",
        "transform(_good, x -> struct(x.start AS start, 1 AS t, x.end AS end, x.kind AS kind, x.hit AS hit))")
    after = "reverse({0})".format(running("reverse(transform(u, x -> IF(x.t = 0, x.start, 2147483647)))", "least"))
    clear = let("u", line, let("m", running("transform(u, x -> IF(x.t = 0, x.end, 0))", "greatest"), let(
        "z", after, "filter(u, (x, i) -> x.t = 1 AND m[i] <= x.start AND z[i] >= x.end)")))
    # of candidates that overlap, the first (the longest of equal starts) stays: taken in
    # chunks, so that appending copies little
    pick = "array<struct<start:int,t:int,end:int,kind:string,hit:string>>"
    inner = (f"aggregate(slice(k, 256 * c + 1, 256), struct(s.at AS at, cast(array() AS {pick}) AS o), "
             "(p, x) -> IF(x.start < p.at, p, struct(x.end AS at, concat(p.o, array(x)) AS o)))")
    free = let("k", "array_sort(_clear, (a, b) -> IF(a.start <> b.start, a.start - b.start, b.end - a.end))", f"""flatten(
      aggregate(sequence(0, size(k) div 256), struct(0 AS at, cast(array() AS array<{pick}>) AS o), (s, c) ->
        {let('r', inner, 'struct(r.at AS at, concat(s.o, array(r.o)) AS o)')}, s -> s.o))""")
    put = "transform(_free, x -> struct(x.kind AS kind, x.start AS start, x.end AS end, x.hit AS hit))"
    order = "CASE {0}.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ALL_KINDS)) + " END"
    merged = f"""IF(size(_free) = 0, _base, array_sort(concat(_base, {put}), (a, b) ->
      IF({order.format('a')} <> {order.format('b')}, {order.format('a')} - {order.format('b')}, a.start - b.start)))"""
    none = f"cast(array() AS {pick})"
    return (t.withColumn("one", F.lit(1)).join(F.broadcast(model), "one", "left")
            .withColumn("_good", F.expr(good))
            .withColumn("_clear", F.expr(f"IF(size(_good) = 0, {none}, {clear})"))
            .withColumn("_free", F.expr(f"IF(size(_clear) = 0, {none}, {free})"))
            .withColumn("spans", F.expr(merged))
            .select("_row.*", F.col("_base").alias("base"), "spans"))


def span_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *n, F.sha2(span_text("base"), 256).alias("base_sha256"),
                        span_text("spans").alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; of spans that overlap
    (kinds are searched independently) the union is replaced once, by the
    kind of the first.  Texts without spans, nulls included, stay."""
    t = f"`{text_col}`"
    # runs of overlapping spans: they begin where no earlier span reaches
    runs = let("u", "array_sort(spans, (a, b) -> IF(a.start <> b.start, a.start - b.start, b.end - a.end))", let(
        "m", running("transform(u, x -> x.end)", "greatest"), let(
            "g", "filter(transform(u, (x, i) -> i), i -> i = 0 OR u[i].start >= m[greatest(0, i - 1)])",
            "transform(g, (i, j) -> struct(u[i].start AS start, m[IF(j + 1 < size(g), g[least(j + 1, size(g) - 1)] - 1, size(u) - 1)] AS end, "
            "u[i].kind AS kind))")))
    # many runs: the text is taken apart once
    part = lambda a, z: f"IF(size(c) = 0, substring({t}, {a} + 1, {z} - {a}), array_join(slice(c, {a} + 1, {z} - {a}), ''))"
    text = let("r", runs, let("c", f"IF(size(r) > 64, regexp_extract_all({t}, '(?s).', 0), cast(array() AS array<string>))", f"""concat(
      array_join(transform(r, (x, j) -> concat({part('IF(j = 0, 0, r[greatest(0, j - 1)].end)', 'x.start')}, '[', upper(x.kind), ']')), ''),
      {part('r[size(r) - 1].end', f'char_length({t})')})"""))
    return found.withColumn(text_col, F.expr(f"IF(size(spans) > 0, {text}, {t})")).drop("base", "spans")
