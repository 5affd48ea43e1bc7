"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Each document gets counts over its whole text. Six smoothed, log-transformed statistics of it are
compared with a minimum-covariance-determinant (MCD) estimate of its language and source. From three
starts (distances by quartiles, the largest of them, and the distance by all rows) concentration steps
refit mean and covariance to the three quarters of the rows that lie closest. After two steps the start
of the least determinant goes on until no step lessens it, and the least one found counts.

A source's covariance is drawn towards that of its language, which has an MCD estimate of its own, with
the weight of ``drawn`` rows (a regularised MCD, Boudt et al. 2020): a large source is judged by itself, a
small one mostly by the spread of its language, around its own mean, and there is no size at which the
rule changes. Rows are rejected whose squared Mahalanobis distance has a probability under ``tail`` by
Hotelling's T-squared with the degrees of freedom that the estimate has, so little evidence rejects little.

Statistics are whole thousandths, so sums are exact and the result does not depend on partitioning, and
quantiles are exact over a bounded number of distinct values. Fits are one row a source: they are
broadcast up to ``MOST_CELLS``, and beyond it joined with rows that are spread over salts.

Defined cases: null or blank text has no words and fails the base rule; null language or source is
a value of its own; a source of one row is its own mean and rejects nothing. Each row is a document of
its own, whatever its doc_id. Columns of the input other than those named are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import stage, with_rows

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Other ASCII punctuation than the symbols.
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Standard deviations, in thousandths, below which differences are no evidence.
FLOORS = (100.0, 150.0, 150.0, 150.0, 350.0, 450.0)
P = len(FLOORS)
#: Fits of up to this many sources (some 0.5 kB each) are broadcast.
MOST_CELLS = 50_000
SALTS = 64
STARTS = 3
#: Rows of the language that a source's covariance is drawn to count for, and the probability below which a row is rejected.
DRAWN, TAIL = 100.0, 1e-6


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-squared > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p_tail: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > p_tail else (low, mid)
    return high


def _count(text: Column, chars: str) -> Column:
    """How many characters of text are among chars: what is left when runs of all others are cut out."""
    return F.length(F.regexp_replace(text, "[^" + re.sub(r"([\[\]\\^&-])", r"\\\1", chars) + "]+", "")).cast("long")


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks (long)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = base.select(*keep, "_t", F.array_remove(F.split("_t", SPACE + "+", -1), "").alias("_w"), lines.alias("_l"))
    hashed = split.select(*keep, "_t", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # hashes of one, two, four and eight words
    step = 1
    while step < WINDOW:
        n = F.greatest(F.size("_h") - step, F.lit(0))
        hashed = hashed.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    # windows found again: sort them with their places, keep those that equal a neighbour, and add up what they cover
    placed = F.array_sort(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))
    placed_col = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)
    shifted = hashed.withColumn("_p", placed_col).drop("_h")
    n = F.size("_p")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.transform("_p", lambda x: x["h"]), F.lit(1), n - 1))
    after = F.concat(F.slice(F.transform("_p", lambda x: x["h"]), F.lit(2), n - 1), F.array(F.lit(None).cast("bigint")))
    around = shifted.withColumn("_q", F.when(F.col("_p").isNotNull(), F.arrays_zip(F.col("_p").alias("p"), before.alias("b"), after.alias("a")))).drop("_p")
    again = F.filter("_q", lambda x: x["p"]["h"].eqNullSafe(x["b"]) | x["p"]["h"].eqNullSafe(x["a"]))
    starts = F.sort_array(F.transform(again, lambda x: x["p"]["i"]))
    marked = around.withColumn("_s", starts).drop("_q")
    covered = F.aggregate("_s", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return marked.select(
        *keep,
        "n_words",
        "word_chars",
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
        _count(F.col("_t"), UPPER).alias("n_upper"),
        _count(F.col("_t"), MARKS).alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _joined(rows: DataFrame, one: DataFrame, key: str, n_keys: int) -> DataFrame:
    """rows with what ``one`` has for their key: broadcast if it is small, else by the key and a salt, so that no key is one task's."""
    if n_keys <= MOST_CELLS:
        return rows.join(F.broadcast(one), key)
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"]).drop("_salt")


def _vector(stats: DataFrame) -> tuple[DataFrame, int]:
    """Adds lang_key, cell and x0..x5, whole thousandths; and the number of cells."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    keyed = stats.select("*", lang.alias("lang_key"), F.concat_ws("\x1f", lang, source).alias("cell"))
    rate = stage(keyed.groupBy("cell").agg((F.sum("word_chars") / F.greatest(F.sum("n_words"), F.lit(1))).alias("_r")), "quality-rates")
    n_cells = rate.count()
    v = _joined(keyed, rate, "cell", n_cells)
    chars = F.col("word_chars") + 100

    def share(part: Column, whole: Column) -> Column:
        return F.log1p(part / whole / 0.05)

    xs = [
        F.log((F.col("word_chars") + 50 * F.col("_r") + 0.01) / (F.col("n_words") + 50)),
        share(F.col("n_symbols"), chars),
        share(F.col("n_upper"), chars),
        share(F.col("n_marks"), chars),
        share(F.col("n_repeat_words"), F.col("n_words") + 50),
        share(F.col("n_dup_lines"), F.col("n_lines") + 5),
    ]
    return v.select("*", *[F.round(1000 * x).cast("long").alias(f"x{i}") for i, x in enumerate(xs)]).drop("_r"), n_cells


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _fitted(sums: DataFrame, drawn: float) -> DataFrame:
    """From key, start, n, s{i}, q{i}_{j} of the closest rows, and t{i}_{j} and t_n of the language if there is one:
    adds the mean m{i}, the covariance c{i}_{j}, the inverse Cholesky factor k{i}_{j} of what it is drawn to, log_det and dof."""
    scale = 0.75 / (1 - chi2_tail(chi2_quantile(0.25, P), P + 2))
    n, toward = F.col("n"), "t_n" in sums.columns
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(P)})
    out = out.withColumns({f"c{i}_{j}": scale * (F.col(f"q{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) for i, j in _pairs()})
    own = n / (n + drawn) if toward else F.lit(1.0)
    dof = own * own / F.greatest(n - 1, F.lit(1.0))
    if toward:
        dof = dof + (1 - own) * (1 - own) / F.greatest(F.col("t_n") - 1, F.lit(1.0))
    out = out.withColumns({f"l{i}_{j}": own * F.col(f"c{i}_{j}") + ((1 - own) * F.col(f"t{i}_{j}") if toward else 0.0) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _pairs()} | {"dof": 1 / dof})
    for j in range(P):
        # rounding can leave the pivot a little under the ridge, never under a part of it
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"l{j}_{j}"), F.lit(FLOORS[j] ** 2 / 100))))
        if j + 1 < P:
            out = out.withColumns({f"l{i}_{j}": F.col(f"l{i}_{j}") / F.col(f"l{j}_{j}") for i in range(j + 1, P)})
            out = out.withColumns({f"l{i}_{k}": F.col(f"l{i}_{k}") - F.col(f"l{i}_{j}") * F.col(f"l{k}_{j}") for i in range(j + 1, P) for k in range(j + 1, i + 1)})
    out = out.withColumns({f"k{i}_{i}": 1 / F.col(f"l{i}_{i}") for i in range(P)} | {"log_det": sum((2 * F.log(f"l{i}_{i}") for i in range(P)), F.lit(0.0))})
    for d in range(1, P):
        out = out.withColumns({f"k{i}_{i - d}": -sum((F.col(f"l{i}_{t}") * F.col(f"k{t}_{i - d}") for t in range(i - d, i)), F.lit(0.0)) / F.col(f"l{i}_{i}") for i in range(d, P)})
    return out.select("key", "start", "n", "log_det", "dof", *[f"m{i}" for i in range(P)], *[f"c{i}_{j}" for i, j in _pairs()], *[f"k{i}_{j}" for i, j in _pairs()])


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    rows = [sum((F.col(f"k{i}_{j}") * d[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _bin(d2: Column) -> Column:
    """Squared distances on a fixed logarithmic grid, so that exact quantiles need bounded memory."""
    return F.round(50 * F.log(d2 + 0.01)).cast("long")


def _step(near: DataFrame, target: DataFrame | None, n_keys: int, drawn: float) -> DataFrame:
    """One concentration step: near has row, key, start, x.. and d2; the fit to the closest three quarters of each key and start."""
    binned = near.select("row", F.concat_ws("\x1e", "start", "key").alias("ks"), "key", "start", _bin(F.col("d2")).alias("b"), *[f"x{i}" for i in range(P)])
    bound = binned.groupBy("ks").agg(F.percentile("b", F.lit(0.75)).alias("t"))
    close = _joined(binned, bound, "ks", STARTS * n_keys).where(F.col("b") <= F.col("t"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _pairs()]
    summed = close.groupBy("key", "start").agg(F.count("*").alias("n"), *sums, *products)
    return _fitted(summed.join(target, "key") if target is not None else summed, drawn)


def mcd(points: DataFrame, n_keys: int, target: DataFrame | None = None, drawn: float = DRAWN) -> DataFrame:
    """key and the columns of ``_fitted`` for each key of points (row, key, x0..): the MCD estimate, drawn to target (key, t_n, t{i}_{j})."""
    xs = [f"x{i}" for i in range(P)]
    mid = points.groupBy("key").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, x in enumerate(xs)])
    placed = _joined(points, mid, "key", n_keys)
    z = [F.abs(F.col(f"x{i}") - F.col(f"p{i}")[1]) / ((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 + FLOORS[i]) for i in range(P)]
    whole = stage(_step(points.select("row", "key", F.lit(2).alias("start"), *xs, F.lit(0.0).alias("d2")), target, n_keys, drawn), "quality-fit")
    first = placed.select("row", "key", F.posexplode(F.array(sum((x * x for x in z), F.lit(0.0)), F.greatest(*z))).alias("start", "d2"), *xs)
    far = _joined(points, whole, "key", n_keys).select("row", "key", "start", _distance().alias("d2"), *xs)
    fit = stage(_step(first.unionByName(far), target, n_keys, drawn), "quality-fit")

    def again(fit: DataFrame) -> DataFrame:
        return _step(_joined(points, fit, "key", STARTS * n_keys).select("row", "key", "start", *xs, _distance().alias("d2")), target, n_keys, drawn)

    fit = stage(again(fit), "quality-fit")
    least = fit.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("least"))
    fit = fit.join(least, "key").where(F.col("start") == F.col("least.start")).drop("least").withColumn("better", F.lit(True))
    while True:
        # the determinant of each key lessens by a part in a million at least, so this ends
        new = again(fit)
        both = fit.drop("better").alias("o").join(new.alias("w"), "key")
        better = F.col("w.log_det") < F.col("o.log_det") - 1e-6
        names = [c for c in new.columns if c != "key"]
        fit = stage(both.select("key", *[F.when(better, F.col(f"w.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names], better.alias("better")), "quality-fit")
        if not fit.where("better").limit(1).count():
            return fit.drop("better", "start")


def _log_tail(d2: Column, n: Column, dof: Column) -> Column:
    """log10 of the probability of a greater distance of a new row: T-squared with the mean of n rows and a covariance of dof degrees.

    The upper tail of F with an even first number of degrees (P is six) is a polynomial of three terms."""
    rest = dof - P + 1
    f = d2 * n / (n + 1) * rest / (dof * P)
    x, a = rest / (rest + P * f), rest / 2
    y = 1 - x
    terms, out = F.lit(1.0), F.lit(1.0)
    for j in range(1, P // 2):
        terms = terms * (a + (j - 1)) * y / j
        out = out + terms
    return F.when(rest <= 0, 0.0).otherwise(a * F.log10(x) + F.log10(out))


def _judged(rows: DataFrame, drawn: float, tail: float) -> DataFrame:
    """row, doc_id, lang, source, the counts, d2, log_p, base_failed, kept of rows (row, own)."""
    docs = rows.select("row", *[F.col("own").getField(c).alias(c) for c in ("doc_id", "lang", "source", "text")])
    stats = stage(text_stats(docs, "row", "doc_id", "lang", "source"), "quality-stats")
    vectors, n_cells = _vector(stats)
    xs = stage(vectors, "quality-vectors")
    names = [f"x{i}" for i in range(P)]
    langs = mcd(xs.select("row", F.col("lang_key").alias("key"), *names), n_cells)
    of = xs.select("cell", F.col("lang_key").alias("key")).distinct().join(langs, "key")
    target = stage(of.select(F.col("cell").alias("key"), F.col("n").alias("t_n"), *[F.col(f"c{i}_{j}").alias(f"t{i}_{j}") for i, j in _pairs()]), "quality-target")
    fit = mcd(xs.select("row", F.col("cell").alias("key"), *names), n_cells, target, drawn)
    judged = _joined(xs.withColumnRenamed("cell", "key"), fit, "key", n_cells).withColumn("d2", _distance())
    judged = judged.withColumn("log_p", _log_tail(F.col("d2"), F.col("n"), F.col("dof")))
    kept = ~base_failed() & (F.col("log_p") >= math.log10(tail))
    return judged.select("row", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "d2", "log_p", base_failed().alias("base_failed"), kept.alias("kept"))


def quality_outliers(docs: DataFrame, drawn: float = DRAWN, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, source, the counts, d2, log_p (double), base_failed, kept (boolean): one row for each row of docs."""
    return _judged(with_rows(docs), drawn, tail).drop("row")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    rows = with_rows(docs)
    return rows.join(_judged(rows, DRAWN, TAIL).where("kept").select("row"), "row", "left_semi").select("own.*")
