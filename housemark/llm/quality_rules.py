"""Quality rules: robust multivariate outliers, in DataFrame operations alone.

A document is described by four ratios to its words, on a logarithmic scale in whole
thousandths: letters in a word, symbols, repeated lines, words in repeated windows. For each
language and source the minimum covariance determinant is sought by concentration steps:
keep the ``KEPT_PART`` of rows nearest by Mahalanobis distance, take their mean and covariance,
and repeat, once from medians and fixed spreads and once from the mean and covariance of all
rows. Of the estimates of all steps from both starts that of the least determinant is taken. A
document is rejected if its squared
distance, after the usual correction for the part kept, is above ``MOST_DISTANCE``. Equal texts
of a group count once in the estimates, so that copies cannot fill the part kept.

Whole numbers make sums and medians exact whatever the order of rows. Medians and quantiles
count values of a small range, so they combine before the shuffle and need bounded memory,
also where one source has a third of all rows; a step sends one row of moments for each
language, source, bin of distance and task. Copies are folded in their task before they are
dealt out by their hash. The estimates have one row for each language and
source; they are broadcast only if they were counted to be few.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from housemark.llm.tables import WHITE, broadcast_if_few, set_aside, words_column
from housemark.sources.scratch import stage

WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"

STEPS = 3
KEPT_PART = 0.75
MOST_DISTANCE = 60.0
#: Spreads taken for granted, in thousandths, and the number of rows that they weigh.
SPREADS = (40.0, 40.0, 120.0, 160.0)
SPREAD_ROWS = 20.0
#: Part of the squared spreads that no variance falls below, however many rows a group has.
LEAST_PART = 0.15
#: 0.75 / P(chi-square with 6 degrees <= 75 % quantile of chi-square with 4 degrees).
CORRECTION = 1.49

_N = len(SPREADS)
_X = [f"x{i}" for i in range(_N)]
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the counts of the whole text and ``base_failed``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` are 0
    for a null text. Windows are compared by 64-bit hashes. ``_text_hash`` tells equal texts
    for ``with_verdict``, which drops it. Columns of these names are replaced, repeated rows
    have equal counts, an empty table gives an empty one. A text of any length is read whole; its
    task holds its words and a hash for each.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = ["_text_hash", *counts, "base_failed"]
    docs = docs.drop(*(c for c in made if c != text))
    own = F.col(f"own{docs.columns.index(text)}")
    docs, names = set_aside(docs)
    whole = F.coalesce(own, F.lit(""))
    split = docs.select(
        *docs.columns,
        F.xxhash64(whole).alias("_text_hash"),
        words_column(own).alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_lines"),
    )
    counted = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": _windows("_words"),
        }
    ).drop("_words", "_lines")
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    marked = counted.withColumn(
        "_sorted",
        F.when(
            repeated,
            F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    ).drop("_windows")
    places = F.filter(
        F.transform("_sorted", lambda x, k: F.when(_beside("_sorted", x, k), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(places, lambda i: F.array(*(i + k for k in range(WINDOW)))))
    )
    few = F.col("n_words") < LEAST_WORDS
    many = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return (
        marked.withColumn(
            "n_repeat_words",
            F.when(F.col("_sorted").isNotNull(), F.size(covered)).otherwise(0).cast("long"),
        )
        .withColumn("base_failed", few | many)
        .select(*names, *made)
    )


def _windows(words: str) -> Column:
    """A hash of each window of ``WINDOW`` words, in their order."""
    last = F.size(words) - WINDOW
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WINDOW))),
    )
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _beside(column: str, item: Column, place: Column) -> Column:
    """Whether the next or the previous item of a sorted array has the same ``x``."""
    before = F.get(F.col(column), place - 1)["x"]
    after = F.get(F.col(column), place + 1)["x"]
    return F.coalesce(before == item["x"], F.lit(False)) | F.coalesce(
        after == item["x"], F.lit(False)
    )


def with_verdict(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    steps: int = STEPS,
    most_distance: float = MOST_DISTANCE,
) -> DataFrame:
    """``docs``, as ``with_statistics`` gives them, plus ``distance`` and ``kept``.

    Documents that failed the base rules are not kept, have no distance, and take no part
    in the estimates, where equal texts of a group count once. A null language or source is a
    value of its own. Small groups lean on the fixed spreads, and no group's variance falls
    below ``LEAST_PART`` of them. ``docs`` is written once, since a
    filter on its counts would otherwise be pushed into their computation, and read several
    times; so are the vectors of its distinct texts. Repeated rows get equal verdicts, an empty
    table gives an empty one.
    """
    docs = stage(docs.drop("distance", "kept"), "counted")
    group = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")).alias("_group")
    passed = docs.where(~F.col("base_failed")).select(group, "_text_hash", *_vector())
    rows = stage(passed.distinct().drop("_text_hash"), "vectors")
    medians = rows.groupBy("_group").agg(
        F.lit(0).alias("start"),
        F.lit(0.0).alias("n"),
        *(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(_X)),
        *(F.lit(0.0).alias(f"s{i}{j}") for i, j in _PAIRS),
    )
    everything = _moments(rows.withColumns({"start": F.lit(1), "bin": F.lit(0)}))
    estimate = broadcast_if_few(stage(_factors(medians.unionByName(everything)), "estimate"))
    reached = []
    for step in range(steps):
        binned = rows.join(estimate, "_group").select(
            "_group", "start", *_X, F.floor(64 * F.log1p(_distance())).alias("bin")
        )
        estimate = broadcast_if_few(stage(_factors(_moments(binned)), "estimate"))
        reached.append(estimate.withColumn("step", F.lit(step)))
    estimate = broadcast_if_few(stage(_least(reached), "estimate"))
    kept = docs.drop("_text_hash")
    # The caller's columns ride along in a struct, out of the way of those of the estimates.
    measured = docs.select(
        F.struct(*kept.columns).alias("_row"), (~F.col("base_failed")).alias("_passed"), group, *_vector()
    )
    distance = F.when(F.col("_passed"), _distance() / CORRECTION).alias("distance")
    found = measured.join(estimate, "_group", "left").select("_row", "_passed", distance)
    return found.select(
        *(F.col("_row")[c].alias(c) for c in kept.columns),
        "distance",
        (F.col("_passed") & (F.col("distance") <= most_distance)).alias("kept"),
    )


def _least(estimates: list[DataFrame]) -> DataFrame:
    """Each group's estimate of least determinant; of equal ones the earliest."""
    every = reduce(DataFrame.unionByName, estimates)
    names = [c for c in every.columns if c not in ("_group", "start", "step", "log_root")]
    order = F.struct(F.round("log_root", 9), "step", "start")
    return (
        every.groupBy("_group").agg(F.min_by(F.struct(*names), order).alias("e")).select("_group", "e.*")
    )


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    counts = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [
        F.round(1000 * F.log1p(F.col(c) / words)).cast("long").alias(x) for c, x in zip(counts, _X)
    ]


def _moments(binned: DataFrame) -> DataFrame:
    """Count, means and summed products of deviations of the nearest rows by group and start.

    Sums are taken for each bin of distance first, and then of the bins up to the one that
    holds the row at ``KEPT_PART`` of the group: no row meets the others of its group.
    """
    keys = ["_group", "start"]
    bins = binned.groupBy(*keys, "bin").agg(
        F.count("*").cast("double").alias("n"),
        *(F.sum(F.col(x).cast("double")).alias(f"t{i}") for i, x in enumerate(_X)),
        *(
            F.sum(F.col(_X[i]).cast("double") * F.col(_X[j])).alias(f"p{i}{j}")
            for i, j in _PAIRS
        ),
    )
    group = Window.partitionBy(*keys)
    nearer = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = F.floor((F.sum("n").over(group) - 1) * KEPT_PART)
    near = bins.withColumn(
        "_near", F.coalesce(F.sum("n").over(nearer), F.lit(0.0)) <= last
    ).where("_near")
    sums = near.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in bins.columns if c not in (*keys, "bin"))
    )
    n = F.col("n")
    return sums.select(
        *keys,
        "n",
        *((F.col(f"t{i}") / n).alias(f"m{i}") for i in range(_N)),
        *(
            (F.col(f"p{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}") / n).alias(f"s{i}{j}")
            for i, j in _PAIRS
        ),
    )


def _factors(moments: DataFrame) -> DataFrame:
    """Means and the Cholesky factor of each group's covariance, and half its log determinant.

    Variances have a floor that does not shrink with the number of rows; to raise them keeps
    the matrix positive definite.
    """
    weight = F.col("n") + SPREAD_ROWS
    covariance = {
        (i, j): (F.col(f"s{i}{j}") + (SPREAD_ROWS * SPREADS[i] ** 2 if i == j else 0.0)) / weight
        for i, j in _PAIRS
    }
    for i in range(_N):
        covariance[i, i] = F.greatest(covariance[i, i], F.lit(LEAST_PART * SPREADS[i] ** 2))
    found = moments
    for i, j in sorted(_PAIRS, key=lambda x: (x[1], x[0])):
        rest = covariance[i, j]
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        found = found.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    means = [f"m{i}" for i in range(_N)]
    half = sum((F.log(f"l{i}{i}") for i in range(1, _N)), F.log("l00"))
    return found.select(
        "_group", "start", *means, *(f"l{i}{j}" for i, j in _PAIRS), half.alias("log_root")
    )


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(_X):
        rest = F.col(x) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{j}") * y
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])
