"""Percentile ranks, field scores, compliance and selection over entries of a field."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-6


@dataclass(frozen=True)
class Contract:
    """One version of the rules: the window, the kernel's defaults and the weights of the field score."""

    lookback: int
    step: int
    half_life: float
    penalty: float
    downside_mix: float
    weights: dict[str, float]


#: The versions of the rules.
CONTRACTS = {
    1: Contract(252, 20, 63, 0.25, 0.0, {"sharpe": 0.1, "max_dd": 0.1, "annual": 0.1, "fail": 0.7}),
    2: Contract(252, 20, 63, 4.0, 0.0, {"annual": 0.15, "max_dd": 0.15, "fail": 0.7}),
    3: Contract(126, 20, 30, 16.0, 0.0, {"annual": 0.2, "vol": 0.1, "fail": 0.7}),
    5: Contract(252, 20, 63, 0.5, 0.5, {"vol": 0.1, "max_dd": 0.1, "cvar": 0.1, "fail": 0.7}),
    6: Contract(100, 20, 25, 4.0, 0.5, {"sharpe": 0.2, "max_dd": 0.1, "fail": 0.7}),
    7: Contract(60, 40, 15, 0.25, 0.0, {"median_sharpe": 0.1, "median_cvar": 0.2, "fail": 0.7}),
    8: Contract(40, 40, 10, 1.0, 0.0, {"median_annual": 0.1, "median_sharpe": 0.1, "median_cvar": 0.1, "fail": 0.7}),
}
#: Metrics of which less is better.
LESS = {"max_dd", "vol", "cvar", "median_cvar", "fail"}


def average_rank(order: Column, by: list[Column]) -> Column:
    """Rank from 1 in ascending order, ties sharing the mean of their ranks."""
    up = Window.partitionBy(*by).orderBy(order)
    same = Window.partitionBy(*by, order)
    return F.rank().over(up) + (F.count(F.lit(1)).over(same) - 1) / 2


def rank_pct(rows: DataFrame, value: str, by: list[str], higher: bool, out: str = "pct", midpoint: bool = False) -> DataFrame:
    """Percentile rank within by, 1 is best, missing values 0; values within TIE of the largest magnitude (1 at least) tie.

    midpoint: 1 - (rank - 1/2)/n instead, rank 1 being best.
    """
    v = F.col(value) if higher else -F.col(value)
    ok = F.col(value).isNotNull()
    keys = [F.col(b) for b in by]
    scale = F.greatest(F.lit(1.0), F.max(F.abs(F.col(value))).over(Window.partitionBy(*keys)))
    noted = rows.withColumn("_key", F.when(ok, F.rint(v / (scale * TIE)))).withColumn("_n", F.count("_key").over(Window.partitionBy(*keys)))
    rank = average_rank(F.col("_key"), [*keys, F.col("_key").isNull()])
    if midpoint:
        best = F.col("_n") + 1 - rank
        pct = 1 - (best - 0.5) / F.col("_n")
        return noted.withColumn(out, F.when(ok & (F.col("_n") > 0), pct).otherwise(0.0)).drop("_key", "_n")
    pct = (rank - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return noted.withColumn(out, F.when(ok & (F.col("_n") > 1), pct).otherwise(0.0)).drop("_key", "_n")


def field_score(entries: DataFrame, by: list[str], weights: dict[str, float], all_or_nothing: bool = False) -> DataFrame:
    """Weighted sum of percentile ranks; all_or_nothing: a failed fold takes an entry's other metrics away first."""
    out = entries
    if all_or_nothing:
        for m in weights:
            if m != "fail":
                out = out.withColumn(m, F.when(F.col("fail") == 0, F.col(m)))
    total = F.lit(0.0)
    for m, w in weights.items():
        out = rank_pct(out, m, by, m not in LESS, f"_pct_{m}")
        total = total + w * F.col(f"_pct_{m}")
    return out.withColumn("score", total).drop(*(f"_pct_{m}" for m in weights))


def pool_scores(candidates: DataFrame, references: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Each candidate's score in a pool of its own with all references (a handful)."""
    names = candidates.select(F.col("label").alias("pool"))
    pool = candidates.withColumn("pool", F.col("label")).unionByName(references.crossJoin(F.broadcast(names)))
    return field_score(pool, ["pool"], weights).filter("label = pool").select("label", "score")


def ordinal(rows: DataFrame, value: str, by: list[str], higher: bool, out: str = "place") -> DataFrame:
    """Places 1, 2, .. from the best; ties by label."""
    order = F.desc_nulls_last(value) if higher else F.asc_nulls_last(value)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order, "label")))


def compliance(distances: DataFrame, by: list[str], floor: float = 0.1) -> DataFrame:
    """Least and median distance, margin over the floor, and whether it holds; undefined distances don't count but are counted."""
    sums = distances.groupBy(*by).agg(F.min("l1").alias("least"), F.median("l1").alias("middle"), F.count_if(F.col("l1").isNull()).alias("undefined"), F.count_if(F.col("l1") < floor).alias("near"))
    return sums.withColumn("margin", F.col("least") - floor).withColumn("admissible", F.coalesce(F.col("least") >= floor, F.lit(False)))


def unanimous(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Groups whose every difference is positive."""
    return deltas.groupBy(*by).agg(F.min(value).alias("least"), F.avg(value).alias("mean")).filter("least > 0")


def resampled(entries: DataFrame, draws: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores in drawn sub-fields (trial, label): how often each label wins, with its median and outer percentiles."""
    scored = field_score(entries.join(draws, "label"), ["trial"], weights)
    top = F.max("score").over(Window.partitionBy("trial"))
    won = scored.withColumn("won", (F.col("score") >= top - 1e-12).cast("int"))
    return won.groupBy("label").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("trials"), F.median("score").alias("middle"), F.percentile("score", 0.05).alias("p05"), F.percentile("score", 0.95).alias("p95"))


#: Differences up to which the signed-rank test counts all signs.
EXACT = 15


def signed_rank_table(differences: DataFrame, value: str = "delta") -> DataFrame:
    """One row (n, plus, p): the two-sided signed-rank test of a column; exact to EXACT differences without ties, else normal."""
    ranked = differences.filter(F.col(value) != 0).select(F.abs(value).alias("size"), (F.col(value) > 0).alias("up"))
    ranked = ranked.withColumn("rank", average_rank(F.col("size"), [F.lit(1)])).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("size")))
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("up"), F.col("rank"))), F.lit(0.0)).alias("plus"), F.sum(F.pow("same", 2) - 1).alias("ties"))
    n, plus = F.col("n"), F.col("plus")
    low = F.least(plus, n * (n + 1) / 2 - plus)
    signs = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.least(n, F.lit(EXACT))).cast("int") - 1)
    rank_sum = lambda bits: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0), lambda a, i: a + F.when(F.getbit(bits.cast("long"), F.least(i - 1, F.lit(EXACT - 1)).cast("int")) == 1, i).otherwise(0))
    reach = F.size(F.filter(signs, lambda bits: rank_sum(bits) <= low))
    exact = F.least(F.lit(1.0), 2 * reach / F.pow(F.lit(2.0), n))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.abs(low - n * (n + 1) / 4) / sd
    # the normal tail by the complementary error function's fraction of Abramowitz and Stegun (7.1.26), error under 2e-7
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return sums.select("n", "plus", F.when(n < 5, None).when((n <= EXACT) & (F.col("ties") == 0), exact).otherwise(poly * F.exp(-z * z / 2)).alias("p"))


def signed_rank(differences: list[float]) -> float | None:
    """Two-sided p-value of the signed-rank test: exact to 15 differences without ties, else normal; None under five."""
    import math

    d = [x for x in differences if x != 0]
    n = len(d)
    if n < 5:
        return None
    size = sorted((abs(x), x > 0) for x in d)
    ranks, i = [0.0] * n, 0
    ties = 0
    while i < n:
        j = i
        while j + 1 < n and size[j + 1][0] == size[i][0]:
            j += 1
        for k in range(i, j + 1):
            ranks[k] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = sum(r for r, (_, up) in zip(ranks, size, strict=True) if up)
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 15 and not ties:
        reach = sum(sum(r * s for r, s in zip(range(1, n + 1), signs, strict=True)) <= low for signs in product((0, 1), repeat=n))
        return min(1.0, 2 * reach / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(low - n * (n + 1) / 4) / sd / math.sqrt(2))
