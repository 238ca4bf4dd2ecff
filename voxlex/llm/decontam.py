"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become tokens (letter runs and numbers, case folded) and, from them,
templates: numbers, names (capitalised words inside a sentence) and units
(after a number) are replaced by typed placeholders.  Every run of eight tokens
is hashed twice, literally and as a template.  Template windows of an item have
as many literal tokens as slots; an item with no such window uses its windows
with two literal tokens.  Windows of documents meet those of benchmark items by
a join on the hash; a bitmap of the items' hashes, sixteen bits a hash up to a
megabyte, leaves out most document windows before they become rows.

An item of three to seven tokens has one window, the whole of it; documents
then have windows of that length too.  Its template alone says little ("who
wrote <name>" stands in many clean texts), so a document matches it only by a
sentence of its own: the window begins and ends where a sentence (or line, or
the text) does.

A re-parameterised question matches as a template; its slots must also be
filled consistently, equal item values standing for equal document values.
Different item values may share a document value: slots that are independent in
the question do so by chance.  A window that is inconsistent in itself does not
count.  Along one alignment of document and item, a name or a number of more
than one significant digit stands for one document value; where it stands for
several, the windows that hold it do not count and all others do.  Units and
numbers of one significant digit (2, 20, 500) recur in independent slots, so
that windows are not held against each other for them.

A document is contaminated by an item if at least ``coverage`` of the item's
windows match, or of those windows that a re-parameterised copy can match (the
templates in use and the windows without slots).  An item of one or two tokens
is too short to tell; it matches nothing.

Null texts have no windows; items without tokens match nothing.  Rows that
repeat an id count as one document or item.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.llm.winnowing import let, rotl

K = 8
SHORTEST = 3        # tokens of an item
SOLID = 2           # literal tokens of a template
ENDERS = r"[.!?\n]+"
NAME = "\ue000"     # private-use mark put before names
#: Units that follow a number (fixed values).
UNITS = ("kg g mg lb lbs oz t km m cm mm mi mile miles ft feet inch inches yard yards l ml litre litres liter "
         "liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month "
         "months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent mph kmh "
         "hz khz mhz w kw v volt volts a j n c f k degrees").split()


#: SQL: a slot value ``x.a`` that independent slots of a question often share.
CHANCE = ("(startswith(x.a, 'U') OR startswith(x.a, 'N') "
          "AND length(trim(BOTH '0' FROM regexp_replace(substring(x.a, 2), '[.,]', ''))) <= 1)")


def _tokens(text: str, more: str = "") -> str:
    """Case-folded tokens; names keep their mark in front.  Names are marked
    before folding: the cheap test, for a capital, comes first.  ``more``:
    another pattern whose matches are listed too."""
    marked = rf"regexp_replace({text}, r'[A-Z\p{{Lu}}](?<=[a-z\p{{Ll}},;:] [A-Z\p{{Lu}}])(?=[a-z\p{{Ll}}])', '{NAME}$0')"
    return rf"regexp_extract_all(lower({marked}), r'[0-9](?:[0-9.,]*[0-9])?|{NAME}?[a-z\p{{L}}\p{{M}}]+{more}', 0)"


def _sentences(text: str) -> str:
    """Tokens as struct(x, f); bit 1 of ``f``: a sentence begins, bit 2: one ends."""
    end = lambda x: f"coalesce({x}, '.') RLIKE r'^{ENDERS}$'"
    flags = f"IF({end('get(u, i - 1)')}, 1, 0) + IF({end('get(u, i + 1)')}, 2, 0)"
    return let("u", _tokens(text, "|" + ENDERS), f"filter(transform(u, (x, i) -> struct(x AS x, {flags} AS f)), y -> NOT {end('y.x')})")


def _windows(n: int, whole: bool) -> str:
    """Hashes of all runs of ``n`` of the values ``v``, of eight by doubling;
    ``whole``: of fewer than eight only if there are no more values."""
    if n < K:
        terms = [rotl("x", 7 * (n - 1))] + [rotl(f"v[i + {j}]", 7 * (n - 1 - j)) for j in range(1, n - 1)]
        runs = f"transform(slice(v, 1, size(v) - {n - 1}), (x, i) -> {' ^ '.join(terms)} ^ v[i + {n - 1}])"
        return f"IF(size(v) {'<>' if whole else '<'} {n}, cast(array() AS array<bigint>), {runs})"
    two = f"transform(slice(v, 1, size(v) - 1), (x, i) -> {rotl('x', 7)} ^ v[i + 1])"
    four = f"transform(slice(a, 1, size(a) - 2), (x, i) -> {rotl('x', 14)} ^ a[i + 2])"
    eight = f"transform(slice(b, 1, size(b) - 4), (x, i) -> {rotl('x', 28)} ^ b[i + 4])"
    return f"IF(size(v) < {K}, cast(array() AS array<bigint>), {let('a', two, let('b', four, eight))})"


def bitmap(hashes: DataFrame, most: int = 1 << 17) -> tuple[str, int]:
    """(SQL of an array of 64-bit words with one bit set per hash ``h``, how many
    words): sixteen bits a hash, 4096 words at least, ``most`` (a megabyte) at most."""
    words, n = 4096, hashes.count()
    while words < most and 4 * words < n:
        words *= 2
    slot, bit = f"pmod(shiftright(h, 6), {words})", "shiftleft(1L, cast(h & 63 AS int))"
    got = dict(hashes.groupBy(F.expr(slot).alias("w")).agg(F.expr(f"bit_or({bit})").alias("b")).collect())
    # one string, which Spark turns into the array once
    return f"cast(split('{','.join(str(got.get(w, 0)) for w in range(words))}', ',') AS array<bigint>)", words


def windows(df: DataFrame, id_col: str, text_col: str, only: tuple[str, int] | None = None,
            lengths: tuple[int, ...] = (K,), item: bool = False) -> DataFrame:
    """(id, i, n, h, s, slots): every window's place, length, hash and slots.

    ``s`` is null for a literal window; for a template window it lists the
    tokens' slot values (empty where the token is literal).  ``only`` is a
    ``bitmap``: windows whose hash has no bit there are left out before they
    become rows.  ``item``: the windows of a benchmark item, with those without
    slots among the templates (a re-parameterised copy holds them literally).
    """
    words, short = (only[1] if only else 1), not item and min(lengths) < K
    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = (f"CASE WHEN x >= '0' AND x < ':' THEN 'N' WHEN startswith(x, '{NAME}') THEN 'P' "
            f"WHEN i > 0 AND t[greatest(i, 1) - 1] >= '0' AND t[greatest(i, 1) - 1] < ':' "
            f"AND x IN ({units}) THEN 'U' ELSE '' END")
    bare = f"IF(startswith(x, '{NAME}'), substring(x, 2), x)"
    test = f"(shiftright(m[pmod(shiftright(x, 6), {words})], cast(x & 63 AS int)) & 1) = 1" if only else "true"
    none = "cast(array() AS array<struct<i:int,n:int,h:bigint,s:string,slots:int>>)"
    # places of the windows that pass, then rows of those only
    passing = f"filter(transform(w, (x, i) -> IF({test}, i, -1)), i -> i >= 0)"
    every = lambda body: f"concat({', '.join(let('w', _windows(n, item), body(n)) for n in lengths)})"
    literal = let("v", f"transform(t, x -> xxhash64({bare}))", every(lambda n: f"""transform(
        {passing}, i -> struct(i AS i, {n} AS n, w[i] AS h, cast(null AS string) AS s, 0 AS slots))"""))
    # a template is needed only where the text has a slot at all
    shape = "transform(t, (x, i) -> IF(k[i] = '', xxhash64(x), xxhash64(concat('\u0001', k[i]))))"
    fill = f"transform(t, (x, i) -> IF(k[i] = '', '', concat(k[i], {bare})))"
    slots = lambda n: f"size(filter(slice(f, i + 1, {n}), y -> y <> ''))"
    alone = lambda n: f"AND e[i] & 1 = 1 AND e[i + {n - 1}] & 2 = 2" if short and n < K else ""
    typed = let("k", f"transform(t, (x, i) -> {kind})", let("v", shape, let("f", fill, every(lambda n: f"""transform(
        filter({passing}, i -> {slots(n)} BETWEEN {0 if item else 1} AND {n - SOLID} {alone(n)}),
        i -> struct(i AS i, {n} AS n, w[i] AS h, array_join(slice(f, i + 1, {n}), '\u0002') AS s, {slots(n)} AS slots))"""))))
    if item:
        typed = let("y", typed, "IF(exists(y, x -> x.slots > 0 AND 2 * x.slots <= x.n), "
                                "filter(y, x -> 2 * x.slots <= x.n), y)")
    else:
        typed = rf"IF(_t RLIKE r'[0-9]|[a-z\p{{Ll}},;:] [A-Z\p{{Lu}}]', {typed}, {none})"
    both = f"concat({literal}, {typed})"
    if short:
        both = let("y", _sentences("_t"), let("t", "transform(y, z -> z.x)", let("e", "transform(y, z -> z.f)", both)))
    else:
        both = let("t", _tokens("_t"), both)
    if only:
        both = let("m", only[0], both)
    return (df.select(F.col(id_col).alias("id"), F.expr(f"coalesce(`{text_col}`, '')").alias("_t"))
            .select("id", F.expr(both).alias("w"))
            # outer: else Spark tests the array's size first and computes it twice
            .select("id", F.explode_outer("w").alias("w")).where("w IS NOT NULL").select("id", "w.*"))


def matches(docs: DataFrame, bench: DataFrame, coverage: float = 0.3, broadcast_windows: int = 1_000_000,
            doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, coverage) of every contaminated pair."""
    b = windows(bench, item_id, text_col, lengths=tuple(range(SHORTEST, K + 1)), item=True).distinct()
    b = b.select(F.col("id").alias("item"), F.col("i").alias("item_i"), "n", "h", F.col("s").alias("item_s"),
                 F.col("s").isNull().alias("literal"), "slots")
    # fit: a re-parameterised copy can match the window
    b = b.withColumn("fit", F.max(~F.col("literal")).over(Window.partitionBy("item", "item_i")))
    size = b.groupBy("item").agg(F.countDistinct("item_i").alias("n"),
                                 F.countDistinct(F.when(F.col("fit"), F.col("item_i"))).alias("n_fit"))
    b = b.where("literal OR slots > 0")
    lengths = tuple(sorted({K} | {x.n for x in b.select("n").distinct().collect()}))     # six at most
    only = bitmap(b.select("h").distinct())
    b = b.drop("n", "slots")
    if b.count() <= broadcast_windows:       # beyond that, Spark joins by shuffle
        b, size = F.broadcast(b), F.broadcast(size)
    d = windows(docs, doc_id, text_col, only, lengths=lengths).drop("n", "slots").withColumn("literal", F.col("s").isNull())
    hit = d.join(b, ["h", "literal"]).where("id IS NOT NULL AND item IS NOT NULL")
    hit = hit.withColumn("at", F.col("i") - F.col("item_i"))
    hit = hit.withColumn("pairs", F.expr(
        "filter(transform(split(item_s, '\\u0002'), (x, j) -> struct(x AS a, split(s, '\\u0002')[j] AS b)), p -> p.a <> '')"))
    hit = hit.where("literal OR size(array_distinct(pairs)) = size(array_distinct(transform(pairs, p -> p.a)))")
    hit = hit.withColumn("bound", F.expr(f"filter(pairs, x -> NOT {CHANCE})"))
    # one row per alignment: at most as many values as the item has windows and slots
    run = hit.groupBy("id", "item", "at").agg(
        F.collect_set(F.when(F.col("literal"), F.struct(F.col("item_i").alias("i"), "fit"))).alias("plain"),
        F.collect_set(F.when(~F.col("literal"), F.struct(F.col("item_i").alias("i"), "fit", "bound"))).alias("typed"))
    run = run.withColumn("filled", F.expr("array_sort(array_distinct(flatten(transform(typed, t -> t.bound))))"))
    run = run.withColumn("torn", F.expr(
        "transform(filter(filled, (x, i) -> i > 0 AND filled[greatest(i, 1) - 1].a = x.a), x -> x.a)"))
    run = run.withColumn("found", F.expr("""array_union(plain, transform(
        filter(typed, t -> NOT arrays_overlap(transform(t.bound, x -> x.a), torn)), t -> struct(t.i AS i, t.fit AS fit)))"""))
    # distinct windows as rows: a document may repeat an item any number of times
    per = run.select("id", "item", F.explode("found").alias("w")).distinct().groupBy("id", "item").agg(
        F.count("*").cast("int").alias("windows"), F.count_if("w.fit").alias("fits"))
    return (per.join(size, "item")
            .withColumn("coverage", F.expr("greatest(windows / n, fits / nullif(n_fit, 0))"))
            .where(F.col("coverage") >= coverage)
            .select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "windows", "coverage"))


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates; rows without an id stay."""
    bad = matches(docs, bench, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
