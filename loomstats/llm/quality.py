"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Each text gives a vector of logarithmic statistics. Per (lang, source) the minimum covariance determinant is estimated: from
medians and median deviations the three quarters of documents nearest the centre are taken, their mean and covariance give
new distances, and so on for a fixed number of concentration steps, then one reweighting. A document is rejected if its
squared Mahalanobis distance is above CUT.

A group's sums get PRIOR documents of its language added, so small groups lean on their language without a size at which
the rule changes, and RIDGE is added to each variance, as most texts have the same value (none) in some statistics. Where
others have none, a text is rejected for its repeated lines alone from about four fifths on; not for its repeated words alone,
which the base rule bounds.
Statistics are whole numbers of 1/1024, so sums are exact and do not depend on how rows were partitioned. Estimates are
combinable sums, counts per distance bin, and medians over bounded numbers of distinct values: a source may hold any share
of the rows.

Defined cases: null text has no words, so it fails the base rule; null lang or source is a value of its own; equal rows each
count; an empty table gives an empty result; columns of `docs` keep their names and values, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstats.llm.common import SPACES, WORD, let, stored

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, RUN = 20, 30, 8

FEATURES = ("words", "length", "symbols", "lines", "repeats", "capitals")
RIDGE = {"words": 0.1, "length": 0.05, "symbols": 0.5, "lines": 0.6, "repeats": 1.2, "capitals": 0.3}  # natural logarithms
SCALE = 1024
HALF = 0.75  # share of a group that a concentration step keeps
STEPS = 2
PRIOR = 20
CUT = 50.0  # far beyond the 1 - 1e-6 quantile (38) of a chi square with six degrees: texts are not quite normal


def _chi2_cdf(x: float, degrees: int) -> float:
    """Of an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, degrees) < p else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What the covariance of the inner `share` is to be multiplied with, for a normal distribution."""
    d = len(FEATURES)
    return share / _chi2_cdf(_chi2_quantile(share, d), d + 2)


def _repeated(words: Column) -> Column:
    """Words inside windows of RUN words that occur twice or more; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        def spans(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda x, i: (x["h"] == F.get(pairs, i + 1)["h"]) | (x["h"] == F.get(pairs, i - 1)["h"]),
            )
            return let(
                F.sort_array(F.transform(twice, lambda x: x["p"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get(at, i + 1) - p, F.lit(RUN)))),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            )

        ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(ordered, spans))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.xxhash64(F.slice(words, i, RUN)))
    return F.when(F.size(words) < RUN, F.lit(0).cast("long")).otherwise(let(windows, covered))


def statistics(text: Column) -> Column:
    """Struct of the statistics of a whole text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    words = F.array_remove(F.split(text, rf"[{SPACES}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        count(rf"[{SPACES}]+").alias("word_chars"),
        count(rf"[^{SYMBOLS}]+").alias("n_symbols"),
        count(r"[^\p{Lu}]+").alias("n_capitals"),
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` as struct `_doc`, and the statistics; written once."""
    doc = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(doc.alias("_doc"), F.col("lang").alias("lang"), F.col("source").alias("source"), statistics(F.col("text")).alias("s"))
    rows = rows.select(
        "_doc", "lang", "source", F.col("s.w.n").alias("n_words"), "s.word_chars", "s.n_symbols",
        F.col("s.l.d").cast("long").alias("n_dup_lines"), F.col("s.w.r").alias("n_repeat_words"),
        F.col("s.l.n").cast("long").alias("n_lines"), "s.n_capitals",
    )
    return stored(rows, "quality")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics in units of 1/SCALE; texts that fail the base rule have no part in the estimates."""
    share = lambda part, whole, times: F.log1p(F.try_divide(times * F.col(part), F.col(whole)))
    values = {
        "words": F.log1p(F.col("n_words")),
        "length": F.log(F.try_divide("word_chars", "n_words")),
        "symbols": share("n_symbols", "word_chars", 1000),
        "lines": share("n_dup_lines", "n_lines", 100),
        "repeats": share("n_repeat_words", "n_words", 100),
        "capitals": share("n_capitals", "word_chars", 1000),
    }
    return {name: F.round(SCALE * value).cast("long") for name, value in values.items()}


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.lang").eqNullSafe(F.col(f"{right}.lang")) & F.col(f"{left}.source").eqNullSafe(
        F.col(f"{right}.source")
    )


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    others = [c for c in model.columns if c not in ("lang", "source")]
    return rows.alias("r").join(model.alias("m"), _same("r", "m")).select("r.*", *[f"m.{c}" for c in others])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations per group, as a diagonal model."""
    centre = stored(rows.groupBy("lang", "source").agg(*[F.median(f).alias(f"m_{f}") for f in FEATURES]), "medians")
    near = _with_model(rows, centre)
    spread = near.groupBy("lang", "source").agg(
        *[F.first(f"m_{f}").alias(f"m_{f}") for f in FEATURES],
        *[F.median(F.abs(F.col(f) - F.col(f"m_{f}"))).alias(f"s_{f}") for f in FEATURES],
    )
    entries = {}
    for i, a in enumerate(FEATURES):
        for j in range(i):
            entries[f"k_{i}_{j}"] = F.lit(0.0)
        entries[f"k_{i}_{i}"] = 1 / F.greatest(1.4826 * F.col(f"s_{a}"), F.lit(RIDGE[a] * SCALE))
    return stored(spread.withColumns(entries).drop(*[f"s_{f}" for f in FEATURES]), "model")


def distance() -> Column:
    """Squared Mahalanobis distance: of K (x - m), K being the inverse Cholesky factor of the covariance."""
    diffs = [F.col(f) - F.col(f"m_{f}") for f in FEATURES]
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"k_{i}_{j}") * diffs[j]
        total = total + part * part
    return total


def _estimate(inner: DataFrame, factor: float) -> DataFrame:
    """Mean and inverse Cholesky factor per group of the rows given, with PRIOR rows of the language mixed in."""
    d = len(FEATURES)
    sums = {"n": F.count("*")} | {f"a_{i}": F.sum(f) for i, f in enumerate(FEATURES)}
    sums |= {f"b_{i}_{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(d) for j in range(i + 1)}
    groups = inner.groupBy("lang", "source").agg(*[c.alias(name) for name, c in sums.items()])
    of_lang = W.partitionBy("lang")
    total = F.sum("n").over(of_lang)
    mixed = {
        name: (F.col(name) + PRIOR * F.sum(name).over(of_lang) / total) / (F.col("n") + PRIOR) for name in sums if name != "n"
    }
    rows = groups.select("lang", "source", *[c.alias(name) for name, c in mixed.items()])
    cov = {}
    for i in range(d):
        for j in range(i + 1):
            value = factor * (F.col(f"b_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}"))
            cov[f"c_{i}_{j}"] = value + (RIDGE[FEATURES[i]] * SCALE) ** 2 if i == j else value
    rows = rows.select("lang", "source", *[F.col(f"a_{i}").alias(f"m_{f}") for i, f in enumerate(FEATURES)], *[c.alias(n) for n, c in cov.items()])
    for i in range(d):  # the factor, then its inverse, row by row
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            rows = rows.withColumn(f"l_{i}_{j}", F.sqrt(value) if i == j else value / F.col(f"l_{j}_{j}"))
    for i in range(d):
        rows = rows.withColumn(f"k_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        for j in range(i):
            value = F.lit(0.0)
            for k in range(j, i):
                value = value + F.col(f"l_{i}_{k}") * F.col(f"k_{k}_{j}")
            rows = rows.withColumn(f"k_{i}_{j}", -value / F.col(f"l_{i}_{i}"))
    return stored(rows.select("lang", "source", *[c for c in rows.columns if c[:2] in ("m_", "k_")]), "model")


def _nearest(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The share HALF of each group with the least distances, in whole bins of a logarithmic scale of distance."""
    placed = _with_model(rows, model).select(
        "lang", "source", *FEATURES, F.floor(16 * F.log2(1 + distance())).cast("long").alias("bin")
    )
    of_group = W.partitionBy("lang", "source")
    counts = placed.groupBy("lang", "source", "bin").count()
    reached = F.sum("count").over(of_group.orderBy("bin")) >= HALF * F.sum("count").over(of_group)
    limits = counts.withColumn("reached", reached).groupBy("lang", "source").agg(
        F.min(F.when(F.col("reached"), F.col("bin"))).alias("limit")
    )
    return _with_model(placed, limits).where("bin <= limit")


def fit(measured: DataFrame) -> DataFrame:
    """The model of each (lang, source) among the measured texts."""
    rows = measured.where(~base_failed()).select("lang", "source", *[c.alias(n) for n, c in vector().items()])
    model = _start(rows)
    for _ in range(STEPS):
        model = _estimate(_nearest(rows, model), _consistency(HALF))
    near = _with_model(rows, model).where(distance() <= _chi2_quantile(0.975, len(FEATURES)))
    return _estimate(near, _consistency(0.975))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` in struct `_doc`, statistics, base_failed, distance and kept."""
    measured = with_statistics(docs, keep)
    rows = measured.withColumn("base_failed", base_failed()).withColumns(vector())
    model = fit(measured)
    others = [c for c in model.columns if c not in ("lang", "source")]
    judged = rows.alias("r").join(model.alias("m"), _same("r", "m"), "left").select("r.*", *[f"m.{c}" for c in others])
    far = F.when(~F.col("base_failed"), distance())
    judged = judged.withColumn("distance", far)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).select(
        *rows.columns, "distance", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    return judge(docs, docs.columns).where("kept").select("_doc.*")
