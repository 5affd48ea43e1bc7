"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

Base spans come from three patterns, leftmost and not overlapping within a kind. The battery looks
at further runs of at least ``MIN_RUN`` encoding characters that hold a digit and a letter. The
smallest alphabet that a run fits (decimal-free hex, base 32, base 36, base 62, base 64) is its
inferred encoding; against the hypothesis of uniform independent symbols of that alphabet stand a
chi-squared test of symbol counts (by its exact distribution in runs shorter than half the alphabet),
a runs test about the middle of the alphabet and a lag-one serial correlation test. The three give
one p-value (Bonferroni). Within a length class, the Benjamini-Hochberg procedure over the whole table
rejects the hypothesis for runs of natural text with a bounded share of random ones among them; runs
that are not rejected are reported as spans of kind ``random``. P-values are counted on a fixed
logarithmic grid, so ranks need no global sort and memory is bounded.

Defined cases: null text is empty; empty text has no spans; each row of the input, repeated or not,
gives one row; long texts are scanned whole.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import stage

#: The base patterns. Keywords are in either case, the rest as it stands.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
#: '=' is padding only at a run's end; before a value it ends the name, and a value may follow it.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:={0,2}(?![A-Za-z0-9+/_=-])|(?==))"
#: Inferred encodings: name, what a run of it looks like, its symbols in order.
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", LOWER.upper() + "234567"),
    ("base36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("BASE36", "^[A-Z0-9]+$", DIGITS + LOWER.upper()),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + LOWER.upper() + LOWER),
    ("base64url", "^[A-Za-z0-9_-]+=*$", LOWER.upper() + LOWER + DIGITS + "-_"),
    ("base64", "^[A-Za-z0-9+/]+=*$", LOWER.upper() + LOWER + DIGITS + "+/"),
)
ALPHA = 0.05
GRID = 20


def _spans(text: str, kind: int, found: str, quick: str, pattern: str, least: int, group: int) -> Column:
    """Array of (start, kind, end) of the matches of pattern whose group has ``least`` characters.

    Places are sums of what stands between matches and the matches themselves."""
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))
    steps = F.arrays_zip(gaps.alias("g"), F.transform(whole, lambda m: F.length(m)).alias("m"), F.transform(part, lambda m: F.length(m)).alias("p"))
    kept = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), kept.alias("out"))

    def step(a: Column, s: Column) -> Column:
        at = a["at"] + s["g"]
        end = at + F.coalesce(s["m"], F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["p"] >= least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.when(F.col(text).rlike(quick), F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(kept).alias(found)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _normal_tail(z: Column) -> Column:
    """log10 of the upper tail of the standard normal distribution (bounded between -40 and 0).

    erfc by the public rational approximation of Abramowitz and Stegun 7.1.26 for small z, and by
    the first terms of the asymptotic series beyond."""
    x = F.greatest(z, F.lit(-8.0)) / 2**0.5
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    near = F.when(x >= 0, poly * F.exp(-a * a) / 2).otherwise(1 - poly * F.exp(-a * a) / 2)
    far = -(a * a) / 2.302585092994046 - F.log10(2 * a * 1.7724538509055159)
    return F.greatest(F.when(x > 4, far).otherwise(F.log10(F.greatest(near, F.lit(1e-12)))), F.lit(-40.0))


@cache
def chi2_tails(k: int, most: int) -> np.ndarray:
    """[n, i]: log10 P(Q >= n + 2 i), for Q the sum of squared counts of n <= most uniform symbols of an alphabet of k; exact, -40 at least."""
    ways = np.zeros((most + 1, most * most + 1))
    ways[0, 0] = 1
    for _ in range(k):
        more = np.zeros_like(ways)
        for c in range(most + 1):
            more[c:, c * c :] += ways[: most + 1 - c, : most * most + 1 - c * c] / math.factorial(c)
        ways = more
    out = np.full((most + 1, (most * most - most) // 2 + 1), -40.0)
    for n in range(1, most + 1):
        tail = np.cumsum(ways[n, n : n * n + 1 : 2][::-1])[::-1] * (math.factorial(n) / float(k) ** n)
        out[n, : len(tail)] = np.log10(np.clip(tail, 1e-40, 1))
    return out


def _chi2_tail(z: Column) -> Column:
    """log10 p of the chi-squared test: normal from half the alphabet on, exact for shorter runs."""
    out = _normal_tail(z)
    for k in sorted({len(s) for _, _, s in ENCODINGS if len(s) > 2 * MIN_RUN}):
        table = chi2_tails(k, (k - 1) // 2)
        cells = F.split(F.lit(",".join(f"{x:.4f}" for x in table.ravel())), ",").cast("array<double>")
        at = (F.col("n") * table.shape[1] + (F.col("_q") - F.col("n")) / 2).cast("int")
        out = F.when((F.col("k") == k) & (F.col("n") < k / 2), F.get(cells, at)).otherwise(out)
    return out


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, alphabet size k, n, z-scores of the three tests and log10 p to rows with a column run."""
    encoding = F.coalesce(*[F.when(F.col("run").rlike(p), F.lit(name)) for name, p, _ in ENCODINGS], F.lit("base64"))
    symbols = F.create_map(*[F.lit(x) for name, _, s in ENCODINGS for x in (name, s)])
    bare = F.regexp_replace("run", "=+$", "")
    a = runs.withColumn("encoding", encoding).withColumn("_s", F.element_at(symbols, F.col("encoding")))
    a = a.withColumn("_c", F.split(bare, "")).withColumn("k", F.length("_s")).withColumn("n", F.length(bare).cast("double"))
    a = a.withColumn("_i", F.expr("transform(_c, c -> cast(locate(c, _s) - 1 as double))"))
    squares = F.expr("aggregate(array_distinct(_i), 0D, (a, d) -> a + power(size(filter(_i, x -> x = d)), 2))")
    high = F.expr("transform(_i, x -> cast(x > (k - 1) / 2 as int))")
    a = a.withColumn("_h", high).withColumn("_q", squares)
    n1 = F.expr("aggregate(_h, 0, (a, x) -> a + x)").cast("double")
    turns = F.expr("aggregate(zip_with(slice(_h, 2, size(_h) - 1), slice(_h, 1, size(_h) - 1), (x, y) -> abs(x - y)), 0, (a, x) -> a + x)") + 1
    lag = F.expr("aggregate(zip_with(slice(_i, 2, size(_i) - 1), slice(_i, 1, size(_i) - 1), (x, y) -> (x - (k - 1) / 2) * (y - (k - 1) / 2)), 0D, (a, x) -> a + x)")
    a = a.withColumn("_n1", n1).withColumn("_turns", turns).withColumn("_lag", lag)
    n, k = F.col("n"), F.col("k")
    chi2 = k / n * F.col("_q") - n
    z_chi2 = (chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    n1, n2 = F.col("_n1"), n - F.col("_n1")
    mean = 2 * n1 * n2 / n + 1
    var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.25))
    z_runs = F.abs(F.col("_turns") - mean) / F.sqrt(var)
    z_serial = F.abs(F.col("_lag")) / (F.sqrt(n - 1) * (k * k - 1) / 12)
    a = a.select("*", z_chi2.alias("z_chi2"), z_runs.alias("z_runs"), z_serial.alias("z_serial"))
    least = F.least(_chi2_tail(F.col("z_chi2")), _normal_tail(F.col("z_runs")) + 0.30103, _normal_tail(F.col("z_serial")) + 0.30103)
    return a.withColumn("log_p", F.least(least + 0.4771212547, F.lit(0.0))).drop("_s", "_c", "_i", "_h", "_q", "_n1", "_turns", "_lag")


def _not_rejected(runs: DataFrame) -> DataFrame:
    """Runs whose p-value the Benjamini-Hochberg procedure does not reject within their length class."""
    binned = runs.withColumn("_c", F.floor(2 * F.log2("n")).cast("int")).withColumn("_b", F.floor(GRID * F.col("log_p")).cast("int"))
    counts = binned.groupBy("_c", "_b").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("_c", "_b", F.sum("m").over(upto).alias("r"), F.sum("m").over(Window.partitionBy("_c")).alias("all"))
    # a cell is judged by its upper edge, so no p-value counts as smaller than it is
    passed = F.col("_b") + 1 <= GRID * F.log10(F.lit(ALPHA) * F.col("r") / F.col("all"))
    bound = ranked.groupBy("_c").agg(F.max(F.when(passed, F.col("_b"))).alias("_top"))
    return binned.join(F.broadcast(bound), "_c").where(F.col("_top").isNull() | (F.col("_b") > F.col("_top")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of (start, kind number, end), for each row of docs."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    based = text.select(
        "doc_id", "_t",
        _spans("_t", 0, "_a", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, ASSIGN_LEAST, 1),
        _spans("_t", 1, "_k", r"AKIA[A-Z0-9]{14}", ACCESS, ACCESS_LEAST, 0),
        _spans("_t", 2, "_x", r"[0-9a-f]{16}", r"[0-9a-f]{16,}", HEX_LEAST, 0),
        _spans("_t", 3, "_r", RUN, RUN, MIN_RUN, 0),
    )
    base = F.concat("_a", "_k", "_x")
    clear = F.filter("_r", lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    runs = F.transform(clear, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), F.substring(F.col("_t"), r["start"] + 1, r["end"] - r["start"]).alias("run")))
    return based.select("doc_id", base.alias("base"), runs.alias("runs"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of docs."""
    found = stage(scan(docs).withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    runs = found.where(F.size("runs") > 0).select("_row", F.explode("runs").alias("r")).select("_row", "r.start", "r.kind", "r.end", "r.run")
    random = _not_rejected(battery(runs)).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_random"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = found.join(random, "_row", "left").withColumn("_random", F.coalesce("_random", none))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "_random")).alias("spans"), F.size("_random").cast("long").alias("n_random"),
    )
