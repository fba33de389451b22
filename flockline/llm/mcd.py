"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.common import words, written

#: Symbols that the symbol count looks for.
SYMBOLS = "#*$%&|<>"
#: Standard deviations added to a feature's own: below these, differences mean nothing for quality.
FLOORS = (0.10, 0.05, 0.15, 0.12)
#: Features are held in whole units of 1 / UNIT, so sums are exact and runs agree.
UNIT = 4096
P = len(FLOORS)
POSITION = (1 << 28) - 1


def chi2_cdf(x: float, df: int) -> float:
    """For even degrees of freedom."""
    return 1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(df // 2))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < q else (low, middle)
    return high


def high(x: Column) -> Column:
    return x.bitwiseAND(~POSITION)


def twins(array: str, part: Callable[[Column], Column]) -> Column:
    """Of a sorted array: the elements that agree in ``part`` with a neighbour."""
    held = F.col(array)

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(part(x) == part(F.get(held, k)), F.lit(False))

    return F.filter(held, lambda x, k: same(x, k - 1) | same(x, k + 1))


def with_repeats(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds ``name``: words of an array that lie in a window of three found twice or more; inside one row, without a shuffle.

    Hashes of the windows, with the place in the low bits, sort as primitive longs;
    neighbours that agree are then compared by their words. Arrays that lambdas
    look into are columns of their own, so that each is computed once a row.
    """
    w = F.col(words)
    n = F.size(w)
    hashed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: high(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("long"))))
    df = df.withColumn("__keys", F.sort_array(F.coalesce(hashed, F.array().cast("array<long>"))))

    def placed(x: Column) -> Column:
        at = x.bitwiseAND(POSITION).cast("int")
        return F.struct(F.struct(F.get(w, at), F.get(w, at + 1), F.get(w, at + 2)).alias("gram"), at.alias("place"))

    df = df.withColumn("__seen", F.sort_array(F.transform(twins("__keys", high), placed)))
    real = twins("__seen", lambda x: x["gram"])
    return df.withColumn(name, F.size(F.array_distinct(F.flatten(F.transform(real, lambda x: F.array(x["place"], x["place"] + 1, x["place"] + 2))))))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Adds the base statistics of whole texts to ``keep``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.select(*keep, body.alias("__text")).withColumn("__w", words(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.translate("__text", " \t\n\x0b\x0c\r", ""))
    symbols = F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))
    out = with_repeats(with_words.withColumn("__lines", lines), "__w", "__repeats").select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__repeats").cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features() -> list[Column]:
    """Log of the mean word length, and square roots of the shares of symbols, repeated lines and repeated words, in whole units."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(v * UNIT).cast("long").alias(f"__x{i}") for i, v in enumerate(values)]


X = [f"__x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def moments(scale: float) -> list[Column]:
    """From sums over a subset to its mean, and to the inverse Cholesky factor of its scaled and floored covariance."""
    n = F.col("__n")
    return [*[(F.col(f"__s{i}") / n / UNIT).alias(f"__m{i}") for i in range(P)], *[((F.col(f"__s{i}{j}") / n - F.col(f"__s{i}") / n * (F.col(f"__s{j}") / n)) / UNIT**2 * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"__c{i}{j}") for i, j in PAIRS]]


def factored(df: DataFrame) -> DataFrame:
    """Adds __i<ij>, the inverse of the Cholesky factor of __c<ij>, and __logdet."""
    for i, j in PAIRS:
        rest = F.col(f"__c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
        df = df.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"__l{j}{j}"))
    for i, j in PAIRS:
        if i == j:
            df = df.withColumn(f"__i{i}{j}", 1 / F.col(f"__l{i}{i}"))
    for i in range(P):
        for j in range(i - 1, -1, -1):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total + F.col(f"__l{i}{k}") * F.col(f"__i{k}{j}")
            df = df.withColumn(f"__i{i}{j}", -total / F.col(f"__l{i}{i}"))
    logdet = F.lit(0.0)
    for i in range(P):
        logdet = logdet + 2 * F.log(f"__l{i}{i}")
    return df.withColumn("__logdet", logdet)


MODEL = [*[f"__m{i}" for i in range(P)], *[f"__i{i}{j}" for i, j in PAIRS]]


def distance() -> Column:
    """The squared Mahalanobis distance of a row's features under the model columns beside them."""
    away = [F.col(f"__x{i}") / UNIT - F.col(f"__m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"__i{i}{j}") * away[j]
        total = total + part * part
    return total


def estimates(rows: DataFrame, group: str, share: float, steps: int) -> DataFrame:
    """MCD estimates of each group: a row a group with its centre and inverse factor.

    Two deterministic starts, the coordinates' medians with the floors as scales
    and the classical estimate, go through ``steps`` concentration steps; the one
    of smaller determinant wins. A step reads the feature rows once: counts and
    exact sums for bins of the distance (rows a group and start: at most as many
    as bins), then the bins up to that of the h-th distance, all of whose rows are
    taken, give the next estimate.
    """
    scale = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    sums = [F.count(F.lit(1)).alias("__n"), *[F.sum(x).alias(f"__s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"__s{i}{j}") for i, j in PAIRS]]
    again = [F.sum(c).alias(c) for c in ("__n", *[f"__s{i}" for i in range(P)], *[f"__s{i}{j}" for i, j in PAIRS])]
    whole = rows.groupBy(group).agg(*sums)
    size = whole.select(F.col(group).alias("__g"), F.ceil(F.col("__n") * share).alias("__h"))
    classic = factored(whole.select(group, F.lit(0).alias("__start"), *moments(1.0)))
    held = rows.select(group, F.posexplode(F.array(*X)).alias("__j", "__v")).groupBy(group, "__j", "__v").agg(F.count(F.lit(1)).alias("__n"))
    one = Window.partitionBy(group, "__j")
    middle = held.withColumn("__upto", F.sum("__n").over(one.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__of", F.sum("__n").over(one))
    medians = middle.filter(2 * F.col("__upto") >= F.col("__of")).groupBy(group, "__j").agg(F.min("__v").alias("__v")).groupBy(group).agg(*[(F.max(F.when(F.col("__j") == i, F.col("__v"))) / UNIT).alias(f"__m{i}") for i in range(P)])
    robust = factored(medians.select(group, F.lit(1).alias("__start"), *[f"__m{i}" for i in range(P)], *[F.lit(FLOORS[i] ** 2 if i == j else 0.0).alias(f"__c{i}{j}") for i, j in PAIRS]))
    model = written(classic.select(group, "__start", "__logdet", *MODEL).unionByName(robust.select(group, "__start", "__logdet", *MODEL)).join(size, F.col(group) == F.col("__g")).drop("__g"), "mcd")
    for _ in range(steps):
        seen = rows.join(model.withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"))
        binned = seen.withColumn("__bin", F.floor(64 * F.log(1 + 16 * distance()))).groupBy(group, "__start", "__h", "__bin").agg(*sums)
        upto = F.sum("__n").over(Window.partitionBy(group, "__start").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
        nearest = binned.withColumn("__before", F.coalesce(upto, F.lit(0))).filter(F.col("__before") < F.col("__h"))
        subset = nearest.groupBy(group, "__start", "__h").agg(*again)
        model = written(factored(subset.select(group, "__start", "__h", *moments(scale))).select(group, "__start", "__logdet", *MODEL, "__h"), "mcd")
    best = model.groupBy(group).agg(F.min(F.struct("__logdet", "__start")).alias("__best"))
    return model.join(best.withColumnRenamed(group, "__g"), (F.col(group) == F.col("__g")) & (F.col("__start") == F.col("__best.__start"))).select(group, *MODEL)


def judged(docs: DataFrame, least: int = 200, share: float = 0.75, steps: int = 4, quantile: float = 0.999999, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a document: ``keep``, the base statistics, base_failed, distance and kept.

    Documents that pass the base rules give estimates per language and source.
    Pairs with fewer than ``least`` such documents use their language's estimate,
    languages with fewer the collection's; with fewer still the base rules alone
    judge, and distance is null. kept is false where the base rules fail or the
    squared distance is above the chi-square ``quantile``. Null text has no words
    and fails; null language or source is a value of its own; equal rows get equal
    verdicts; an empty table gives none. The text is read once, each document's
    statistics are found inside its row, and every later step reads the small table
    of statistics.
    """
    own = [F.col(c).alias(c) for c in keep]
    base = statistics(docs.select(*own, F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col(text).alias("__body")), [*keep, "__lang", "__source"], "__body")
    base = written(base.select("*", *features()), "quality-statistics")
    sound = base.filter(~F.col("base_failed"))

    def named(level: int) -> Column:
        parts = [F.lit(level).alias("level"), F.col("__lang").alias("lang"), F.col("__source").alias("source")]
        return F.to_json(F.struct(*parts[: level + 1]))

    levels = sound.select(F.explode(F.array(*[named(k) for k in range(3)])).alias("__group")).groupBy("__group").agg(F.count(F.lit(1)).alias("__docs")).filter(F.col("__docs") >= least)
    levels = written(levels, "quality-levels")
    rows = sound.select(F.explode(F.array(*[named(k) for k in range(3)])).alias("__group"), *X).join(levels.select(F.col("__group").alias("__g")), F.col("__group") == F.col("__g"), "left_semi")
    model = written(estimates(rows, "__group", share, steps), "quality-model")
    pairs = base.select("__lang", "__source").distinct().select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), named(k).alias("group")) for k in range(3)])).alias("__at"))
    finest = pairs.join(levels, F.col("__at.group") == F.col("__group")).groupBy("__lang", "__source").agg(F.max("__at").alias("__at"))
    use = finest.join(model, F.col("__at.group") == F.col("__group")).select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), *MODEL)
    found = base.join(use, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(quantile, P), F.lit(True))
    return found.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
