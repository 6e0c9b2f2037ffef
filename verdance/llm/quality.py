"""Robust multivariate outliers among text statistics: minimum covariance determinant.

Per language and source the location and scatter of transformed statistics are
estimated from the share of documents whose scatter has the least determinant, and
documents far from it by Mahalanobis distance are rejected.  Concentration steps
begin at three estimates: medians with the spread of the middle half, moments of all
rows, and moments of the rows that lie in the middle of every statistic.  After a few
steps of each, the one with the least determinant goes on.  Everything is DataFrame
operations: a step needs the distances of all rows, and per group and bin of the
distance's logarithm the count and the sums of first and second moments.  From
those bins alone follow which rows are the closest ones and their mean and
covariance, so each step is one pre-aggregated shuffle of a bounded number of
bins for each group, whatever a hot source holds.

A ridge keeps covariances regular where a statistic is constant, as counts of
symbols often are.  Squared distances are divided by the factor that makes the
scatter of the closest share of normal data consistent, and the cutoff is a quantile
of the chi-squared law; both follow from the share and the number of statistics.
Groups of fewer than ``least`` documents are pooled by language, and what is still
small is judged by the estimate of all documents of its language, or, if these are
few, of all documents; a table of fewer than ``least`` gets no verdict.

Cases: a null text has no words and fails the base rules; null languages and
sources form groups of their own; repeated rows each count; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

SYMBOLS = "#*$%&|<>"
_BLANKS = "\t\n\x0b\f\r"


DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats", "length")


def chi_squared(x: float, k: int) -> float:
    """The chi-squared law's probability up to x with k degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi_squared_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_squared(hi, k) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared(mid, k) < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Settings:
    """Parameters of the estimate and of the verdict."""

    share: float = 0.75  #: of a group's rows, those that the scatter is taken from
    trial: int = 2  #: concentration steps from each start
    steps: int = 5  #: concentration steps in all
    least: int = 50  #: rows that a group needs
    bins: int = 8  #: to a unit of the distance's natural logarithm
    clean: float = 0.99  #: of normal documents, the share that is kept
    ridge: tuple[float, ...] = (0.08, 0.5, 0.8, 0.5, 0.8)  #: standard deviations added to each dimension's

    @property
    def consistency(self) -> float:
        """The factor by which the scatter of the closest share of normal data is too small."""
        k = len(DIMENSIONS)
        return self.share / chi_squared(chi_squared_quantile(self.share, k), k + 2)

    @property
    def cutoff(self) -> float:
        """Of the scaled squared distance."""
        return chi_squared_quantile(self.clean, len(DIMENSIONS))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, source and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", base.text_key().alias("text_key"), "lang", "source", text.alias("t"))
    found = found.withColumns({
        "w": F.array_remove(F.split(F.translate("t", _BLANKS, " " * len(_BLANKS)), " ", -1), ""),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " " + _BLANKS, "")) > 0),
        "word_chars": F.length(F.translate("t", " " + _BLANKS, "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
    })
    found = found.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # (hash of three words, place), by hash: equal windows are neighbours
        "h": F.when(F.size("w") >= 3, F.array_sort(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))),
    })
    other = lambda j: F.get("h", j)["h"]  # noqa: E731  null beyond the ends
    twice = F.filter("h", lambda x, j: F.coalesce(x["h"] == other(j - 1), F.lit(False)) | F.coalesce(x["h"] == other(j + 1), F.lit(False)))
    found = found.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("at", lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("at", j - 1))))
    found = found.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    kept = ["doc_id", "text_key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(*kept, failed.alias("base_failed"))


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def transformed() -> dict[str, Column]:
    """The vector of a document, roughly symmetric in each dimension."""
    return {
        "word_length": F.log(1 + _ratio("word_chars", "n_words")),
        "symbols": F.log1p(100 * _ratio("n_symbols", "word_chars")),
        "dup_lines": F.log1p(20 * _ratio("n_dup_lines", "n_lines")),
        "repeats": F.log1p(20 * _ratio("n_repeat_words", "n_words")),
        "length": F.log1p(F.col("n_words").cast("double")),
    }


KEY = ["g1", "g2"]


def _grouped(stats: DataFrame, s: Settings) -> DataFrame:
    """Adds g1, g2, the group that a row is judged by, and learns, whether its estimate is made from the row.

    Names are marked, so that no language or source can be called like a pool.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    out = stats.withColumns({"g1": named("lang"), "g2": named("source")})
    by_both = out.where(~F.col("base_failed")).groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"))
    by_both = base.stored(by_both, "sizes")  # of groups only
    by_lang = by_both.groupBy("g1").agg(F.sum("n").alias("of_lang"), F.coalesce(F.sum(F.when(F.col("n") < s.least, F.col("n"))), F.lit(0)).alias("pool"))
    level = F.when(F.col("n") >= s.least, 0).when(F.col("pool") >= s.least, 1).when(F.col("of_lang") >= s.least, 2).otherwise(3)
    level = base.stored(by_both.join(by_lang, "g1").select("g1", "g2", level.alias("level")), "levels")  # a plain side of a join that can be split or broadcast by size
    out = out.join(level, KEY, "left").withColumn("level", F.coalesce("level", F.lit(3)))
    # pool: the language's small groups; lang: all its documents; all: all documents
    return out.select("*", F.col("g1").alias("lang_key")).withColumns({"g1": F.when(F.col("level") < 3, F.col("g1")).otherwise("all"), "g2": F.element_at(F.array(F.col("g2"), F.lit("pool"), F.lit("lang"), F.lit("all")), F.col("level") + 1)})


def _learning(rows: DataFrame) -> DataFrame:
    """The rows that estimates are made from; those of languages and of all documents are made only where some row needs them."""
    good = rows.where(~F.col("base_failed"))
    wide = base.stored(rows.where("level >= 2").select("level", "g1").distinct(), "wide")  # at most a row for each language
    lang = good.join(wide.where("level = 2").select(F.col("g1").alias("lang_key")), "lang_key", "left_semi").withColumns({"g1": F.col("lang_key"), "g2": F.lit("lang")})
    all_ = good.join(wide.where("level = 3").select("level").distinct().withColumnRenamed("level", "there"), F.lit(3) == F.col("there"), "left_semi").withColumns({"g1": F.lit("all"), "g2": F.lit("all")})
    keep = [*KEY, *DIMENSIONS]
    return good.where("level < 2").select(*keep).unionByName(lang.select(*keep)).unionByName(all_.select(*keep))


_CELLS = [f"l{i}{j}" for i in range(5) for j in range(i + 1)]
_SUMS = [f"x{i}" for i in range(5)] + [f"x{i}{j}" for i in range(5) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(d) for d in DIMENSIONS]
    return [F.sum(x[i]).alias(f"x{i}") for i in range(5)] + [F.sum(x[i] * x[j]).alias(f"x{i}{j}") for i in range(5) for j in range(i + 1)]


def _estimate(sums: DataFrame, s: Settings) -> DataFrame:
    """Mean m and Cholesky factor l from counts h and sums of moments; log_det of the scatter."""
    out = sums.withColumns({f"m{i}": F.col(f"x{i}") / F.col("h") for i in range(5)})
    for i in range(5):
        for j in range(i + 1):
            cell = F.col(f"x{i}{j}") / F.col("h") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                cell = F.greatest(cell, F.lit(0.0)) + F.lit(s.ridge[i] ** 2)
            for k in range(j):
                cell = cell - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cell, F.lit(1e-12))) if i == j else cell / F.col(f"l{j}{j}"))
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(5)), F.lit(0.0))
    return out.withColumn("log_det", 2 * log_det).select(*KEY, "start", "n", *[f"m{i}" for i in range(5)], *_CELLS, "log_det")


#: Shares between which a statistic is in the middle, for the third start.
MIDDLE = (0.1, 0.9)


def _starts(rows: DataFrame, s: Settings) -> DataFrame:
    """Parameters of the first distances, by group and start; bins of each statistic give the order statistics."""
    long = rows.select(*KEY, F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.round(F.col(d) * 50).alias("bin")) for i, d in enumerate(DIMENSIONS)])))
    # stored, so that partial counts meet by bin and not by group, which a hot one would send to one task
    bins = base.stored(long.groupBy(*KEY, "k", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    w = Window.partitionBy(*KEY, "k")
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin") / 50))
    each = bins.groupBy(*KEY, "k").agg(F.max("all").alias("n"), at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("iqr"), at(MIDDLE[0]).alias("a"), at(MIDDLE[1]).alias("b"))
    of = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    order = base.stored(each.groupBy(*KEY).agg(F.max("n").alias("n"), *[of(i, c).alias(f"{c}{i}") for i in range(5) for c in ("m", "iqr", "a", "b")]), "order")
    cells = {f"l{i}{j}": F.sqrt((F.col(f"iqr{i}") / 1.349) ** 2 + s.ridge[i] ** 2) if i == j else F.lit(0.0) for i in range(5) for j in range(i + 1)}
    medians = order.select(*KEY, F.lit(0).alias("start"), "n", *[f"m{i}" for i in range(5)], *[c.alias(k) for k, c in cells.items()], F.lit(0.0).alias("log_det"))
    near = rows.join(order, KEY)
    middle = F.lit(True)
    for i, d in enumerate(DIMENSIONS):
        middle = middle & F.round(F.col(d) * 50).between(F.round(F.col(f"a{i}") * 50), F.round(F.col(f"b{i}") * 50))
    # by a struct with the start: keys that the join has not dealt rows by
    pick = F.explode(F.when(middle, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("start")
    sums = near.select(F.struct(*KEY).alias("g"), pick, "n", *DIMENSIONS).groupBy("g", "start").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("h"), *_moments())
    return medians.unionByName(_estimate(sums.select("g.*", "start", "n", "h", *_SUMS), s))


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds d2, the squared distance by the group's mean and Cholesky factor, for each of its starts."""
    out = rows.join(params, KEY, "left")
    for i, d in enumerate(DIMENSIONS):
        rest = F.col(d) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(5):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return out.withColumn("d2", total)


def _bin(s: Settings) -> Column:
    return F.floor(s.bins * F.log(F.greatest(F.col("d2"), F.lit(1e-4)))).cast("int")


def _step(rows: DataFrame, params: DataFrame, s: Settings) -> DataFrame:
    """Mean and Cholesky factor of the closest rows of each group, by start."""
    near = _distance(rows, params).withColumn("bin", _bin(s))
    # by a struct: keys that the join above has not dealt rows by, else a hot group's rows would stay in one task
    bins = base.stored(near.groupBy(F.struct(*KEY, "start").alias("g"), "bin").agg(F.count(F.lit(1)).alias("n"), *_moments()), "bins").select("g.*", "bin", "n", *_SUMS)
    w = Window.partitionBy(*KEY, "start")
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    close = bins.where(F.col("upto") - F.col("n") < F.col("all") * s.share)
    return _estimate(close.groupBy(*KEY, "start").agg(F.max("all").alias("n"), F.sum("n").alias("h"), *[F.sum(c).alias(c) for c in _SUMS]), s)


def judged(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Statistics, base_failed, distance (scaled, squared; null: no verdict) and kept."""
    s = settings or Settings()
    stats = base.stored(statistics(docs), "statistics")
    rows = base.stored(_grouped(stats, s).withColumns(transformed()), "vectors")
    learnt = _learning(rows)
    params = base.stored(_starts(learnt, s), "starts")
    for step in range(s.steps):
        if step == s.trial:  # of the starts, the one with the least determinant goes on
            best = F.row_number().over(Window.partitionBy(*KEY).orderBy("log_det", "start"))
            params = params.withColumn("nth", best).where("nth = 1").drop("nth")
        params = base.stored(_step(learnt, params, s), "step")
    out = _distance(rows, params.where(F.col("n") >= s.least)).withColumn("distance", F.col("d2") / s.consistency)
    verdict = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= s.cutoff)
    return out.withColumn("kept", verdict).select("doc_id", "text_key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
