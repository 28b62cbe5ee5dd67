"""Quality rules: robust multivariate outliers, in DataFrame operations alone.

Each text gets statistics of its words, symbols, repeated lines and repeated word windows. Transformed, they
are a vector; per language and source the minimum-covariance-determinant estimate of its centre and spread is
found from three starts (medians and deviations from them; mean and covariance of all rows; those of the half nearest
to the medians) by concentration steps: keep the ``CORE`` share of rows nearest to the estimate, estimate anew, until no
determinant falls any more. The start with the least determinant counts; one reweighting step follows. A text is
rejected if its squared Mahalanobis distance is beyond the ``quantile`` of the chi-square distribution.

Estimates are sums over all rows of a group, merged before the shuffle; quantiles are mergeable sketches. Estimates go
to the rows (broadcast up to ``SHARED_GROUPS`` of them, counted first), rows move nowhere. No row is sampled, and a source that holds a third of all rows is only more partial sums. Groups of fewer than
``least`` fitting rows take the estimate of their language, and languages with fewer that of all rows. ``floors``
are added to the spread of each statistic (in the sense of a standard deviation), so that statistics that are
zero for most texts don't make every other value an outlier.

Defined results: null text has no words and fails the base rules; null language or source is a group of its
own; equal rows get equal verdicts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stored, table, whole_text, words_of

SYMBOLS = "#*$%&|<>"
STATISTICS = ("x1", "x2", "x3", "x4")
#: Of x1 to x4: log mean word length, symbols a word, repeated lines (root of the share), words in repeated windows (root of the share).
#: The last two let each statistic reject by itself: from a centre of 0 and no spread, over 30 % repeated lines or 18 % words in repeated windows.
FLOORS = (0.08, 0.05, 0.11, 0.085)
#: Makes the spread of the core 75 % of normal rows in 4 dimensions that of all of them: 0.75 / P(chi2_6 <= q), q the 75 % point of chi2_4.
CORE, CONSISTENCY = 0.75, 1.495
#: Points of chi2_4 for the reweighting step and the verdict.
REWEIGHT, QUANTILE = 0.975, 0.99995
#: A determinant that falls by less than this share has stopped.
STILL = 1e-3
#: Estimates (about 200 bytes each) that are sent to all tasks; more are joined by shuffle.
SHARED_GROUPS = 50_000


def chi_square_point(quantile: float) -> float:
    """Where the chi-square distribution of 4 degrees, 1 - (1 + x / 2) exp(-x / 2), reaches ``quantile``."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if (1 + x / 2) * math.exp(-x / 2) > 1 - quantile else (low, x)
    return low


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col("text")
    blank = f"[^{' '}\\t-\\r]"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), whole_text().alias("text"))
    lines = let(F.filter(F.split(text, "\n", -1), lambda s: s.rlike(blank)), lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    rows = rows.select(
        "doc_id", "lang", "source", let(words_of(text), repeats).alias("r"), lines.alias("l"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), F.length(F.translate(text, SPACES, "")).alias("word_chars")
    )
    return rows.select("doc_id", "lang", "source", *(F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in ("r.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "r.n_repeat_words")))


def repeats(w: Column) -> Column:
    """n_words and n_repeat_words of an array of words.

    Its 3-word windows become numbers of hash (leading bits) and place (the others), which are sorted, so that
    equal windows are neighbours; those whose words are really equal give the places that repeat.
    """
    zero = F.lit(0).cast("long")
    bits = F.ceil(F.log2(F.size(w) + 2)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    place = lambda v: v.bitwiseAND(mask)
    head = lambda v: F.call_function("shiftright", v, bits)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed = F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))

    def same(x: Column, y: Column) -> Column:
        a, b = place(x).cast("int"), place(y).cast("int")
        return F.coalesce((head(x) == head(y)) & (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2)), F.lit(False))

    at = let(packed, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1))), place)))
    held = F.aggregate(at, F.struct(zero.alias("n"), zero.alias("end")), lambda a, i: F.struct((a["n"] + 3 - F.greatest(zero, a["end"] - i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    return F.struct(F.size(w).alias("n_words"), held.alias("n_repeat_words"))


def on_grid(x: Column) -> Column:
    """Rounds to multiples of 2^-10, so that sums don't depend on the order of rows."""
    return F.round(x * 1024) / 1024


def transformed(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns({
        "x1": on_grid(F.log((F.col("word_chars") + 300) / (n + 60))),
        "x2": on_grid(F.log1p(F.col("n_symbols") / n)),
        "x3": on_grid(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        "x4": on_grid(F.sqrt(F.col("n_repeat_words") / n)),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


LEVELS = (("lang", "source"), ("lang",), ())


def group_key(level: int) -> Column:
    """The key of a row's group at a level: language and source, language, or all."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *(F.col(c) for c in LEVELS[level])))


def every_level(rows: DataFrame) -> DataFrame:
    """Each row once for each level, so that all estimates come from the same steps."""
    return rows.withColumn("grp", F.explode(F.array(*map(group_key, range(len(LEVELS))))))


def start(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations from them, as centre and (diagonal) spread of each group."""
    medians = stored(rows.groupBy("grp").agg(F.count("*").alias("size"), *(F.percentile_approx(x, 0.5, 10_000).alias(f"m{k}") for k, x in enumerate(STATISTICS))), "estimates")
    off = rows.join(shared(medians), "grp").groupBy("grp").agg(*((F.percentile_approx(F.abs(F.col(x) - F.col(f"m{k}")), 0.5, 10_000) * 1.4826).alias(f"d{k}") for k, x in enumerate(STATISTICS)))
    spread = [F.when(F.lit(i == j), F.col(f"d{i}") ** 2).otherwise(0.0).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)]
    return medians.join(off, "grp").select("grp", F.lit(0).alias("start"), "size", *(f"m{k}" for k in range(4)), *spread)


def moments(rows: DataFrame, scale: float, *more: str) -> DataFrame:
    """Centre and spread of the rows of each group (and ``more`` columns)."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    x = [F.col(s) for s in STATISTICS]
    sums = rows.groupBy("grp", *more).agg(F.count("*").alias("k"), *(F.sum(x[i]).alias(f"s{i}") for i in range(4)), *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in pairs))
    return sums.select("grp", *more, *((F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in range(4)), *((scale * (F.col(f"q{i}{j}") / F.col("k") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("k") ** 2)).alias(f"c{i}{j}") for i, j in pairs))


def shared(estimates: DataFrame) -> DataFrame:
    """Marks written estimates for broadcast if they are counted to be few."""
    return F.broadcast(estimates) if estimates.count() <= SHARED_GROUPS else estimates


def nearest(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """grp, start and statistics of the rows nearest to each estimate."""
    far = rows.join(shared(estimates), "grp").select("grp", "start", *STATISTICS, distance().alias("d"))
    edge = stored(far.groupBy("grp", "start").agg(F.percentile_approx("d", share, 10_000).alias("edge")), "edges")
    return far.join(shared(edge), ["grp", "start"]).where("d <= edge")


def factored(estimates: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Adds the Cholesky factor l.. of the spread plus the squared floors, and its determinant."""
    out = estimates
    for j in range(4):
        left = F.col(f"c{j}{j}") + floors[j] ** 2
        for k in range(j):
            left = left - F.col(f"l{j}{k}") ** 2
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.lit(floors[j] ** 2 / 4))))
        for i in range(j + 1, 4):
            cross = F.col(f"c{i}{j}")
            for k in range(j):
                cross = cross - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", cross / F.col(f"l{j}{j}"))
    return out.withColumn("det", (F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33")) ** 2)


def distance() -> Column:
    """Squared Mahalanobis distance of x from m by the factor l."""
    y: list[Column] = []
    for i in range(4):
        left = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * y[k]
        y.append(left / F.col(f"l{i}{i}"))
    return y[0] ** 2 + y[1] ** 2 + y[2] ** 2 + y[3] ** 2


def covariance_estimates(rows: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """grp, size, start, steps, centre, factor and determinant of each group of every level, from the rows that pass the base rules."""
    rows = stored(every_level(rows.where(~F.col("base_failed"))).select("grp", *STATISTICS), "vectors")
    first = stored(factored(start(rows), floors), "estimates")
    sizes = first.select("grp", "size")
    plain = moments(rows, 1.0).withColumn("start", F.lit(1))
    half = moments(nearest(rows, first, 0.5), 1.0).withColumn("start", F.lit(2))
    now = stored(first.drop("size").unionByName(factored(plain.unionByName(half), floors)).withColumns({"steps": F.lit(0), "fell": F.lit(True)}), "estimates")
    own = [c for c in now.columns if c not in ("grp", "start")]
    while True:
        falling = now.where("fell")
        if falling.isEmpty():
            break
        new = factored(moments(nearest(rows, falling, CORE), CONSISTENCY, "start"), floors)
        both = now.join(new.select("grp", "start", F.struct(*(c for c in new.columns if c not in ("grp", "start"))).alias("new")), ["grp", "start"], "left")
        # starts are no core estimates yet: their first step always counts
        fell = F.coalesce((F.col("steps") == 0) | (F.col("new.det") < F.col("det") * (1 - STILL)), F.lit(False)) & F.col("new").isNotNull()
        taken = [F.when(fell, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in own if c not in ("steps", "fell")]
        now = stored(both.select("grp", "start", *taken, (F.col("steps") + fell.cast("int")).alias("steps"), fell.alias("fell")), "estimates")
    least = now.groupBy("grp").agg(F.min(F.struct("det", "start", *(c for c in own if c not in ("det", "fell")))).alias("e")).select("grp", "e.*")
    least = stored(least, "estimates")
    near = rows.join(shared(least), "grp").select("grp", *STATISTICS, distance().alias("d")).where(F.col("d") <= chi_square_point(REWEIGHT))
    return stored(factored(moments(near, 1.0).join(sizes, "grp").join(least.select("grp", "start", "steps"), "grp"), floors), "estimates")


def reject_outliers(docs: DataFrame, quantile: float = QUANTILE, least: int = 60, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    rows = stored(transformed(text_statistics(docs)), "statistics")
    found = covariance_estimates(rows, floors)
    names = [f"m{k}" for k in range(4)] + [f"l{i}{j}" for i in range(4) for j in range(i + 1)]
    # each group takes the finest estimate that enough rows stand behind
    groups = rows.select("lang", "source").distinct().select("lang", "source", F.posexplode(F.array(*map(group_key, range(len(LEVELS))))).alias("level", "grp"))
    able = groups.join(found, "grp").where((F.col("size") >= least) | (F.col("level") == len(LEVELS) - 1))
    chosen = stored(able.groupBy("lang", "source").agg(F.min(F.struct("level", *names)).alias("e")).select("lang", "source", *(F.col(f"e.{n}").alias(n) for n in names)), "estimates")
    judged = rows.join(shared(chosen), ["lang", "source"], "left").withColumn("distance", distance())
    near = F.coalesce(F.col("distance") <= chi_square_point(quantile), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance")


def op3_robust_outliers(spark, sf_dir):
    return reject_outliers(table(spark, sf_dir, "documents"))
