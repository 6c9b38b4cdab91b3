"""Experiment runs: summaries per variant and intent, decisions, spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

EXACT = "decimal(38,12)"


def _mean(name: str):
    """A mean that doesn't depend on the order of summing."""
    return F.sum(F.col(name).cast(EXACT)).cast("double") / F.count(name)


#: A composite and its square, exactly: sums of them merge in any order.
ONE, SQUARE = "decimal(18,12)", "decimal(38,24)"


def moments(runs: DataFrame) -> DataFrame:
    """Per variant and intent, nulls of either too, what summaries and decisions need and what merges by adding up.

    Of a batch or a stream: n, total and squares of the composite, n_latency and latency, cost; exact decimals.
    """
    one = F.col("composite").cast(ONE)
    return runs.groupBy("variant", "intent").agg(
        F.count("composite").alias("n"), F.sum(one.cast(EXACT)).alias("total"), F.sum((one * one).cast(SQUARE)).alias("squares"),
        F.count("latency").alias("n_latency"), F.sum(F.col("latency").cast(EXACT)).alias("latency"), F.sum(F.col("cost").cast(EXACT)).alias("cost"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The ``moments`` of all runs from those of parts of them."""
    return parts.groupBy("variant", "intent").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "n_latency", "latency", "cost")])


def summary_of(told: DataFrame) -> DataFrame:
    """``summary`` from ``moments``."""
    n = F.col("n")
    apart = F.greatest((F.col("squares").cast("double") - F.col("total").cast("double") * (F.col("total").cast("double") / n)) / (n - 1), F.lit(0.0))
    return told.where("variant IS NOT NULL AND intent IS NOT NULL").select(
        "variant", "intent",
        T.rounded(F.try_divide(F.col("total").cast("double"), n), 3).alias("composite_mean"),
        T.rounded(F.when(n > 1, F.sqrt(apart)), 3).alias("composite_std"),
        "n",
        T.rounded(F.try_divide(F.col("latency").cast("double"), F.col("n_latency")), 3).alias("latency_mean"),
        T.rounded(F.col("cost").cast("double"), 3).alias("cost_sum"),
    )


def decision_of(told: DataFrame, each: int = 50, apart: float = 0.05, total: int = 200, by: tuple[str, ...] = ("intent",)) -> DataFrame:
    """``decision`` from ``moments``, one for each of ``by``."""

    def of(v: str):
        own = F.col("variant") == v
        count = F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0))
        return F.try_divide(F.sum(F.when(own, F.col("total"))).cast("double"), count), count

    (mean_a, n_a), (mean_b, n_b) = of("A"), of("B")
    return _decided(told.groupBy(*by).agg(mean_a.alias("mean_a"), mean_b.alias("mean_b"), n_a.alias("n_a"), n_b.alias("n_b")), each, apart, total, by)


def summary(runs: DataFrame) -> DataFrame:
    """Per variant and intent (rows that lack either are left out): composite mean, deviation and count, latency, cost."""
    own = runs.where("variant IS NOT NULL AND intent IS NOT NULL")
    return own.groupBy("variant", "intent").agg(
        T.rounded(_mean("composite"), 3).alias("composite_mean"),
        T.rounded(F.stddev_samp("composite"), 3).alias("composite_std"),
        F.count("composite").alias("n"),
        T.rounded(_mean("latency"), 3).alias("latency_mean"),
        T.rounded(F.sum(F.col("cost").cast(EXACT)).cast("double"), 3).alias("cost_sum"),
    )


def variant_means(runs: DataFrame) -> DataFrame:
    return runs.where("variant IS NOT NULL").groupBy("variant").agg(T.rounded(_mean("composite"), 6).alias("mean"), F.count("composite").alias("n"))


def decision(runs: DataFrame, each: int = 50, apart: float = 0.05, total: int = 200) -> DataFrame:
    """Per intent: concluded for the better variant, equivalent (A wins) or to continue; aggregates only."""

    def of(v: str):
        own = F.when(F.col("variant") == v, F.col("composite"))
        return F.sum(own.cast(EXACT)).cast("double") / F.count(own), F.count(own)

    (mean_a, n_a), (mean_b, n_b) = of("A"), of("B")
    return _decided(runs.groupBy("intent").agg(mean_a.alias("mean_a"), mean_b.alias("mean_b"), n_a.alias("n_a"), n_b.alias("n_b")), each, apart, total, ("intent",))


def _decided(out: DataFrame, each: int, apart: float, total: int, by: tuple[str, ...]) -> DataFrame:
    gap = F.col("mean_a") - F.col("mean_b")
    done = (F.col("n_a") >= each) & (F.col("n_b") >= each) & (F.abs(gap) >= apart)
    state = F.when(done, "conclude").when(F.col("n_a") + F.col("n_b") >= total, "equivalent").otherwise("continue")
    winner = F.when(done & (gap < 0), "B").when(F.col("n_a") + F.col("n_b") >= total, "A").when(done, "A")
    return out.select(*by, "n_a", "n_b", state.alias("decision"), winner.alias("winner"))


def spend(runs: DataFrame) -> DataFrame:
    return runs.agg(T.rounded(F.sum(F.col("cost").cast(EXACT)).cast("double"), 4).alias("spend"), F.count(F.lit(1)).alias("n_runs"))
