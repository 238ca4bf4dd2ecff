"""Aggregations over score and response tables (survey D3-D13, F3).

All are ordinary grouped aggregates (partial + final), so a key holding a
large share of the rows is combined map-side before any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlex.functions.scalar import signed_root


def _keys(by):
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _join_stats(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Join per-group statistics back; a global (keyless) one-row table joins on a constant."""
    if keys:
        return df.join(stats, keys)
    return df.withColumn("_g", F.lit(0)).join(F.broadcast(stats.withColumn("_g", F.lit(0))), "_g").drop("_g")


# -- exact order statistics without a sort ----------------------------------

#: Bits of the rank search a pass settles; four passes settle a double.
DIGIT = 16
#: Groups times ranks up to which a pass's choices go through the driver.
MAX_CHOICES = 20_000
#: Rows of a digit that are gathered and ordered at once, instead of further passes.
FEW = 4096


def ordered_bits(v):
    """A bigint that orders as the double ``v`` does (-0.0 equals 0.0; NaN is not
    expected): its bits, by exact arithmetic on powers of two."""
    size = F.abs(v)
    least, most = F.lit(2.0 ** -1022), F.lit(math.inf)
    a = F.when((size >= least) & (size < most), size).otherwise(1.0)
    # log2 may miss by one next to a power of two
    e0 = F.floor(F.log2(a)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    e = e0 + F.when(two(e0) > a, -1).when(two(e0 + 1) <= a, 1).otherwise(0)
    e = F.least(e, F.lit(1023))
    mantissa = ((a / two(e) - 1.0) * F.lit(2.0 ** 52)).cast("bigint")
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + mantissa
    low = F.when(size < least, size).otherwise(0.0)
    tiny = (low * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")
    bits = F.when(size < least, tiny).when(size == most, F.lit(0x7FF << 52)).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits)


def double_of(bits):
    """The double whose ``ordered_bits`` these are."""
    a = F.abs(bits)
    e = F.shiftright(a, 52).cast("int")
    m = a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    size = (F.when(e == 0x7FF, F.lit(math.inf))
            .when(e == 0, m * F.lit(2.0 ** -537) * F.lit(2.0 ** -537))
            .otherwise((F.lit(1.0) + m / F.lit(2.0 ** 52)) * F.pow(F.lit(2.0), e - 1023)))
    return F.when(bits < 0, -size).otherwise(size)


def order_statistics(df: DataFrame, by, value: str, ranks: dict) -> DataFrame:
    """The values at some ranks of every group: keys, ``n`` and one column per
    entry of ``ranks``, name -> function of the count column ``n`` (0-based).

    Radix selection on ordered bits.  A pass counts the rows that share what
    is settled so far by their next ``DIGIT`` bits (partial aggregates, so
    one value held by many rows is one count), and every rank moves into the
    digit it falls in.  Ranks whose digit holds a single value are settled
    early, and digits of at most ``FEW`` rows are gathered, so two passes
    suffice as a rule, four always.  Rows are never sorted; they are written
    once and scanned by each pass.  NULL and NaN are left out.
    """
    from voxlex.session import cut_lineage
    keys = [f"_k{i}" for i, _ in enumerate(_keys(by))]
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(k).alias(n) for k, n in zip(_keys(by), keys)],
                                                        ordered_bits(v).alias("_b"))
    rows = cut_lineage(rows)
    names = list(ranks)
    spark = df.sparkSession

    def paired(left: DataFrame, right: DataFrame, on, how: str, small: bool) -> DataFrame:
        """Joined on the group (nulls are one) and ``on``."""
        right = right.withColumnsRenamed({c: f"{c}r" for c in right.columns if c in left.columns})
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}r"))
        return left.join(F.broadcast(right) if small else right, on, how)

    want = done = None
    small = True
    for step in range(64 // DIGIT):
        shift = 64 - DIGIT * (step + 1)
        digit = F.shiftright("_b", shift).alias("_d")
        if want is None:
            counts = rows.groupBy(*keys, digit)
        else:
            prefix = want.select(*keys, F.col("_d").alias("_p")).distinct()
            counts = paired(rows, prefix, F.shiftright("_b", shift + DIGIT) == F.col("_p"), "left_semi", small).groupBy(*keys, digit)
        counts = counts.agg(F.count("*").alias("_c"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
        counts = counts.withColumn("_p", F.lit(0).cast("bigint") if want is None else F.shiftright("_d", DIGIT))
        # digits of one group and prefix: 65,536 at most
        before = Window.partitionBy(*keys, "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_end", F.sum("_c").over(before))
        if want is None:
            whole = Window.partitionBy(*keys)
            counts = counts.withColumn("_n", F.sum("_c").over(whole))
            every = F.array(*[F.struct(F.lit(m).alias("name"), ranks[m](F.col("_n")).cast("bigint").alias("r")) for m in names])
            at = counts.withColumn("_e", F.explode(every)).select("*", F.col("_e.name").alias("_name"), F.col("_e.r").alias("_r"))
        else:
            asked = want.select(*keys, F.col("_d").alias("_q"), "_n", "_name", "_r")
            at = paired(counts, asked, F.col("_p") == F.col("_q"), "inner", small)
        at = at.where("_r < _end AND _r >= _end - _c")
        at = at.select(*keys, "_d", "_n", "_name", (F.col("_r") - (F.col("_end") - F.col("_c"))).alias("_r"), "_c", "_lo", "_hi")
        got = at.limit(MAX_CHOICES + 1).collect()
        small = len(got) <= MAX_CHOICES
        at = spark.createDataFrame(got, at.schema) if small else cut_lineage(at)
        settled = at.where("_lo = _hi").select(*keys, "_n", "_name", double_of(F.col("_lo")).alias("_v"))
        done = settled if done is None else done.unionByName(settled)
        want = at.where("_lo < _hi").drop("_lo", "_hi")
        many = max((r["_c"] for r in got if r["_lo"] < r["_hi"]), default=0) if small else want.agg(F.max("_c")).first()[0] or 0
        if not many:
            break
        if many <= FEW:
            prefix = want.select(*keys, F.col("_d").alias("_p")).distinct()
            left = paired(rows, prefix, F.shiftright("_b", shift) == F.col("_p"), "left_semi", small)
            left = left.groupBy(*keys, F.shiftright("_b", shift).alias("_p")).agg(F.array_sort(F.collect_list("_b")).alias("_all"))
            asked = want.select(*keys, F.col("_d").alias("_q"), "_n", "_name", "_r")
            last = paired(left, asked, F.col("_p") == F.col("_q"), "inner", small)
            done = done.unionByName(last.select(*keys, "_n", "_name", double_of(F.expr("_all[cast(_r AS int)]")).alias("_v")))
            break
    out = done.groupBy(*keys, "_n").agg(*[F.max(F.when(F.col("_name") == m, F.col("_v"))).alias(m) for m in names])
    return out.select(*[F.col(n).alias(k) for k, n in zip(_keys(by), keys)], F.col("_n").alias("n"), *names)


def exact_quantiles(df: DataFrame, by, value: str, qs) -> DataFrame:
    """Exact quantiles with linear interpolation (as pandas), one column per q,
    from the two order statistics around ``(n - 1) * q``
    (``order_statistics``).  Columns are named ``q{i}``."""
    at = lambda q: lambda n: (n - 1).cast("double") * F.lit(float(q))
    ranks = {f"_{side}{i}": (lambda n, q=q, f=f: f(at(q)(n)))
             for i, q in enumerate(qs) for side, f in (("a", F.floor), ("b", F.ceil))}
    ends = order_statistics(df, by, value, ranks)
    out = []
    for i, q in enumerate(qs):
        h = at(q)(F.col("n"))
        out.append((F.col(f"_a{i}") + (h - F.floor(h)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}"))
    return ends.select(*_keys(by), *out)


def describe_scores(df: DataFrame, by=None, value: str = "corr") -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max.

    Moments come from one map-side-combined aggregate; quartiles from
    ``exact_quantiles`` (counts of leading bits), so a group of any size, or
    of equal values, is never buffered in one task.
    """
    keys = _keys(by)
    v = F.col(value)
    mom = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                F.min(v).alias("min"), F.max(v).alias("max"))
    qs = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75))
    j = mom.join(qs.hint("shuffle_hash"), keys, "left") if keys else mom.withColumn("_g", F.lit(0)).join(
        qs.withColumn("_g", F.lit(0)), "_g", "left").drop("_g")
    return j.select(*keys, "count", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
                    F.col("q2").alias("q75"), "max")


def above_threshold(df: DataFrame, by=None, value: str = "corr", t: float = 0.3) -> DataFrame:
    """Number and percent (2 decimals) of scores strictly above ``t``."""
    v = F.col(value)
    g = df.groupBy(*_keys(by)).agg(F.count_if(v > F.lit(t)).alias("n_above"), F.count(v).alias("n"))
    return g.withColumn("pct_above", F.round(F.lit(100.0) * F.col("n_above") / F.col("n"), 2))


def subject_summary(scores: DataFrame, by: str = "subject", value: str = "corr",
                    t: float = 0.3) -> DataFrame:
    """Per subject: max score and count above ``t``, sorted by count desc."""
    v = F.col(value)
    g = scores.groupBy(by).agg(F.max(v).alias("max_corr"), F.count_if(v > F.lit(t)).alias("n_above"))
    return g.orderBy(F.desc("n_above"), F.col(by))


def over_under(df: DataFrame, by=None, value: str = "corr", m: float = 0.2) -> DataFrame:
    """``#(v > m) - #(-v > m)``: a quick skewness signal of a score table."""
    v = F.col(value)
    return df.groupBy(*_keys(by)).agg(
        (F.count_if(v > F.lit(m)) - F.count_if(-v > F.lit(m))).alias("over_under"))


def alpha_profile(boot_scores: DataFrame, value: str = "corr", m: float = 0.2) -> DataFrame:
    """Mean / max score and over-under count per (bootstrap, alpha)."""
    v = F.col(value)
    return boot_scores.groupBy("boot", "alpha_idx").agg(
        F.avg(v).alias("mean_corr"), F.max(v).alias("max_corr"),
        (F.count_if(v > F.lit(m)) - F.count_if(-v > F.lit(m))).alias("over_under"))


def series_corr(df: DataFrame, by, a: str, b: str, out: str = "corr") -> DataFrame:
    """Pearson correlation per group; NULL for a constant group.

    The built-in ``corr`` raises on a constant group under ANSI mode, so the
    ratio is formed with ``try_divide``.
    """
    return df.groupBy(*_keys(by)).agg(
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(out))


def signed_r2(df: DataFrame, by, actual: str, pred: str, blended: bool = True,
              out: str = "corr") -> DataFrame:
    """Signed root of R^2 = 1 - var(actual - pred) / V.

    ``blended=True`` uses ``V = (1 + var(actual)) / 2`` (the cross-validation
    and weight-free scoring rule); ``False`` uses ``V = var(actual)``.
    """
    va = F.var_pop(actual)
    vres = F.var_pop(F.col(actual) - F.col(pred))
    denom = (F.lit(1.0) + va) / F.lit(2.0) if blended else va
    r2 = F.lit(1.0) - F.try_divide(vres, denom)
    return df.groupBy(*_keys(by)).agg(signed_root(r2).alias(out))


def mean_boot(scores: DataFrame, level: str = "series", key: str = "voxel",
              group_col: str = "grp", value: str = "corr") -> DataFrame:
    """Mean held-out score per alpha over bootstraps.

    level ``series``: per (series, alpha); ``group``: per (group, alpha),
    averaging members and bootstraps; ``all``: per alpha over everything.
    """
    keys = {"series": [key], "group": [group_col], "all": []}[level]
    return scores.groupBy(*keys, "alpha_idx").agg(F.avg(value).alias("mean_corr"))


def best_alpha(scores: DataFrame, by=None, value: str = "mean_corr", digits: int | None = 9,
               out: str = "best_alpha_idx") -> DataFrame:
    """Argmax over ``alpha_idx`` with first-index tie-break.

    Scores are rounded to ``digits`` first so that ties do not depend on the
    summation order of the engine (block size, partial aggregation).
    """
    s = F.col(value) if digits is None else F.round(value, digits)
    key = F.struct(s.alias("s"), (-F.col("alpha_idx")).alias("i"))
    return scores.groupBy(*_keys(by)).agg(F.max_by("alpha_idx", key).alias(out))


# -- is a difference of scores significant? -----------------------------------

def score_parts(df: DataFrame, by, chunk: str, actual: str, pred: str, out: str = "part") -> DataFrame:
    """(by, chunk, part): what every chunk of frames adds to the Pearson correlation
    of its group, so that the parts of a group sum to the correlation.  A
    constant group has no parts."""
    keys = _keys(by)
    stats = df.groupBy(*keys).agg(F.avg(actual).alias("_ma"), F.avg(pred).alias("_mp"), F.count(F.col(actual) * F.col(pred)).alias("_n"),
                                  (F.stddev_pop(actual) * F.stddev_pop(pred)).alias("_s"))
    j = _join_stats(df, stats, keys)
    z = F.try_divide((F.col(actual) - F.col("_ma")) * (F.col(pred) - F.col("_mp")), F.col("_s") * F.col("_n"))
    return j.groupBy(*keys, chunk).agg(F.sum(z).alias(out)).where(F.col(out).isNotNull())


def flips(seed: int, perm: int, chunk) -> int:
    """The sign of a chunk in a permutation, the same in every engine."""
    import hashlib
    return 1 - 2 * (int(hashlib.md5(f"{seed}|{perm}|{chunk}".encode()).hexdigest()[:8], 16) % 2)


def sign_flip_test(a: DataFrame, b: DataFrame, by, chunk: str, part: str = "part", nperm: int = 999, seed: int = 42) -> DataFrame:
    """(by, diff, hits, p) of two models' ``score_parts``: is the difference of
    their scores more than chance?

    Under the null a chunk's difference is as likely negative; every
    permutation flips the same chunks of all groups, so their dependence
    stays.  ``hits`` counts the permutations whose difference is at least as
    large in size (to 1e-9), ``p = (hits + 1) / (nperm + 1)``.  A group's
    row holds one number per chunk (bounded by the frames); one matrix
    product per block of groups tests all permutations.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    keys = _keys(by)
    both = (a.select(*keys, chunk, F.col(part).alias("_d"))
            .unionByName(b.select(*keys, chunk, (-F.col(part)).alias("_d"))).groupBy(*keys, chunk).agg(F.sum("_d").alias("_d")))
    packed = both.groupBy(*keys).agg(F.collect_list(F.struct(F.col(chunk).cast("bigint").alias("c"), F.col("_d").alias("d"))).alias("_v"))
    spec = T.StructType([packed.schema[k] for k in keys] + [T.StructField("diff", T.DoubleType()), T.StructField("hits", T.LongType())])

    def run(batches):
        known: dict = {}                       # chunk -> its signs, one per permutation
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                rows = batch.slice(s, 1024)
                v = rows.column("_v")
                e = v.flatten()
                c, d = e.field("c").to_numpy(), e.field("d").to_numpy()
                chunks, at = np.unique(c, return_inverse=True)
                for x in chunks.tolist():
                    if x not in known:
                        known[x] = np.array([flips(seed, p, x) for p in range(nperm)], np.int8)
                dense = np.zeros((rows.num_rows, len(chunks)))
                np.add.at(dense, (np.repeat(np.arange(rows.num_rows), np.diff(v.offsets.to_numpy())), at), d)
                signs = np.array([known[x] for x in chunks.tolist()], float).reshape(len(chunks), nperm)
                diff = dense.sum(1)
                hits = (np.abs(dense @ signs) >= np.abs(diff)[:, None] - 1e-9).sum(1)
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in keys] + [pa.array(diff), pa.array(hits, pa.int64())],
                                                 names=keys + ["diff", "hits"])

    out = packed.mapInArrow(run, spec)
    return out.withColumn("p", (F.col("hits") + 1) / F.lit(float(nperm + 1)))


def false_discovery(tests: DataFrame, family=None, hits: str = "hits", p: str = "p", out: str = "q") -> DataFrame:
    """Adds Benjamini and Hochberg's q per ``family``: the least
    ``p_j m / rank_j`` over all tests with ``p_j >= p``.

    Permutation p-values take at most nperm + 1 values, so ranks come from a
    table of counts per value, which is joined back; no test is sorted.
    """
    keys = _keys(family)
    counts = tests.groupBy(*keys, hits).agg(F.count("*").alias("_c"), F.max(p).alias("_p"))
    base = Window.partitionBy(*keys).orderBy(hits)
    counts = counts.withColumn("_rank", F.sum("_c").over(base.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("_m", F.sum("_c").over(Window.partitionBy(*keys)))
    least = F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(base.rowsBetween(0, Window.unboundedFollowing))
    counts = counts.withColumn(out, F.least(least, F.lit(1.0))).select(*keys, hits, out)
    return tests.join(counts, [*keys, hits])


def alpha_usage(df: DataFrame, col: str = "alpha") -> DataFrame:
    """Distinct penalties in use and how many series use each."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_series"))


def histogram(df: DataFrame, by=None, value: str = "corr", bins: int = 20,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Histogram as within-group probability (each group sums to 1).

    Equal-width bins from the smallest to the largest value of the table, or
    between the limits given; the top edge belongs to the last bin.  Limits
    that leave values outside are refused; NULL and NaN have no bin.
    """
    keys = _keys(by)
    v = F.col(value)
    inside = df.where(v.isNotNull() & ~F.isnan(v))
    least, most = inside.agg(F.min(value), F.max(value)).first()
    if least is None:
        lo, hi = 0.0, 1.0
    lo, hi = least if lo is None else lo, most if hi is None else hi
    if least is not None and (least < lo or most > hi):
        raise ValueError(f"values reach from {least} to {most}, outside [{lo}, {hi}]")
    hi = hi if hi > lo else lo + 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("_tot", F.sum("n").over(Window.partitionBy(*keys)))
    width = (hi - lo) / bins
    return out.select(*keys, "bin",
                      (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      "n", (F.col("n") / F.col("_tot")).alias("prob"))


def histogram_bins(df: DataFrame, value: str = "corr") -> tuple[float, float, int]:
    """(lowest, highest, bins) that follow the data: the narrower of the widths of
    Freedman and Diaconis, ``2 IQR n^(-1/3)``, and of Sturges,
    ``range / (log2(n) + 1)``; the latter alone where the quartiles coincide."""
    r = order_statistics(df, None, value, {
        "lo": lambda n: F.lit(0), "hi": lambda n: n - 1,
        "a1": lambda n: F.floor((n - 1) * F.lit(0.25)), "b1": lambda n: F.ceil((n - 1) * F.lit(0.25)),
        "a3": lambda n: F.floor((n - 1) * F.lit(0.75)), "b3": lambda n: F.ceil((n - 1) * F.lit(0.75))}).first()
    if r is None:
        return 0.0, 1.0, 1
    n, span = r["n"], r["hi"] - r["lo"]
    if span == 0:
        return r["lo"], r["hi"], 1
    part = lambda q, a, b: a + ((n - 1) * q - math.floor((n - 1) * q)) * (b - a)
    width = span / (math.log2(n) + 1)
    iqr = part(0.75, r["a3"], r["b3"]) - part(0.25, r["a1"], r["b1"])
    if iqr > 0:
        width = min(width, 2 * iqr / n ** (1 / 3))
    return r["lo"], r["hi"], math.ceil(span / width)


def histogram_auto(df: DataFrame, by=None, value: str = "corr") -> DataFrame:
    """``histogram`` with bins that follow the data (``histogram_bins`` over the
    whole table, so that groups share their edges)."""
    from voxlex.session import cut_lineage
    df = cut_lineage(df.select(*_keys(by), value))
    lo, hi, bins = histogram_bins(df, value)
    return histogram(df, by, value, bins, lo, hi)


#: Taylor terms and bins per bandwidth of the binned density.
KDE_TERMS, KDE_FINE = 8, 16


def kde_error(terms: int = KDE_TERMS, fine: int = KDE_FINE) -> float:
    """Bound of the binned density's error, times the bandwidth.

    A row lies at most half a bin from its bin's centre, so the series of the
    kernel around the centre errs by at most ``(1 / 2 fine)^terms / terms!``
    times the largest derivative of that order, and Hermite functions obey
    ``|He_k(u)| phi(u) <= sqrt(k! / 2 pi)`` (Cramer).
    """
    return (0.5 / fine) ** terms * math.sqrt(math.factorial(terms) / (2 * math.pi)) / math.factorial(terms) * 1.09


def kde(df: DataFrame, by=None, value: str = "corr", grid: int = 200, cut: float = 3.0, exact: bool = False) -> DataFrame:
    """Gaussian kernel density per group on an evenly spaced grid.

    Bandwidth is Scott's rule ``h = std * n^(-1/5)`` (sample std); the grid
    spans ``[min - cut*h, max + cut*h]`` with ``grid`` points.

    Rows are binned first, ``KDE_FINE`` bins per bandwidth; a bin keeps the
    sums of the powers of its rows' offsets, from which the series of the
    kernel around the bin's centre gives the density of all its rows at
    once.  The cost is rows * terms + bins * grid * terms, and a group has
    range / h * ``KDE_FINE`` bins at most.  The error is at most
    ``kde_error() / h`` (about 2e-15 / h, less than rounding).  ``exact``
    evaluates every row at every grid point instead.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = _keys(by)
    v = F.col(value)
    stats = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.stddev_samp(v).alias("_sd"),
                                  F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    stats = (stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
                  .withColumn("_lo", F.col("_mn") - F.lit(cut) * F.col("_h"))
                  .withColumn("_step", (F.col("_mx") - F.col("_mn") + F.lit(2 * cut) * F.col("_h"))
                              / F.lit(grid - 1)))
    j = _join_stats(df, stats, keys)
    j = j.where(v.isNotNull() & (F.col("_h") > 0))
    points = F.sequence(F.lit(0), F.lit(grid - 1))
    place = lambda k: F.col("_lo") + k * F.col("_step")
    if exact:
        kern = F.transform(points, lambda k: F.exp(F.lit(-0.5) * F.pow((place(k) - v) / F.col("_h"), 2)))
    else:
        # offsets are counted in bandwidths
        scaled = (v - F.col("_mn")) / F.col("_h") * F.lit(float(KDE_FINE))
        d = (scaled - F.floor(scaled) - 0.5) / F.lit(float(KDE_FINE))
        power = [F.lit(1.0)]
        for _ in range(KDE_TERMS - 1):
            power.append(power[-1] * F.col("_off"))
        j = j.select(*keys, "_h", "_mn", "_lo", "_step", F.floor(scaled).alias("_bin"), d.alias("_off"))
        j = j.groupBy(*keys, "_bin", "_h", "_mn", "_lo", "_step").agg(*[F.sum(p).alias(f"_m{i}") for i, p in enumerate(power)])
        centre = F.col("_mn") + (F.col("_bin") + 0.5) * F.col("_h") / F.lit(float(KDE_FINE))

        def series(k):
            # sum over i of m_i / i! He_i(u) phi(u), by Horner on He_(i+1) = u He_i - i He_(i-1) (Clenshaw)
            u = (place(k) - centre) / F.col("_h")
            start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
            terms = F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.lit(1.0 / math.factorial(i)).alias("c"), F.lit(float(i)).alias("i"))
                              for i in reversed(range(KDE_TERMS))])
            # b_i = c_i m_i + u b_(i+1) - (i + 1) b_(i+2)
            end = F.aggregate(terms, start, lambda s, t: F.struct(
                (t["m"] * t["c"] + u * s["a"] - (t["i"] + 1.0) * s["b"]).alias("a"), s["a"].alias("b")), lambda s: s["a"])
            return F.when(F.abs(u) < 39.0, end * F.exp(F.lit(-0.5) * u * u)).otherwise(0.0)

        kern = F.transform(points, series)
    summed = (j.select(*keys, array_to_vector(kern).alias("_k"))
               .groupBy(*keys).agg(Summarizer.sum(F.col("_k")).alias("_s")))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    out = _join_stats(summed, stats, keys)
    out = out.select(*keys, "_lo", "_step", norm.alias("_norm"),
                     F.posexplode(vector_to_array("_s")).alias("k", "_sum"))
    return out.select(*keys, "k", (F.col("_lo") + F.col("k") * F.col("_step")).alias("x"),
                      (F.col("_sum") / F.col("_norm")).alias("density"))
