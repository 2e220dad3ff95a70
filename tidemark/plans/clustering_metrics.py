"""B-cubed, mutual information and adjusted mutual information from contingency counts.

``rows`` have a true and a predicted label, and optionally keys, for one score per key.  A noise label is a cluster like
any other.  All metrics come from cell counts and their marginals, so items never meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, p, n, a, b, total): cell counts with both marginals."""
    cells = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    over = lambda c: Window.partitionBy(*keys, c)  # noqa: E731  cells, not items
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = cells.join(totals, list(keys)) if keys else cells.crossJoin(F.broadcast(totals))  # one row without keys
    return joined.withColumns({"a": F.sum("n").over(over("t")), "b": F.sum("n").over(over("p"))}).select(*keys, "t", "p", "n", "a", "b", "total")


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series for n + 9 and the product of the factors between."""
    z = n + 9.0
    below = n + 1.0
    for i in range(2, 9):
        below = below * (n + float(i))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0))) - F.ln(below)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def b_cubed(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p, r = F.sum(F.col("n") * F.col("n") / F.col("b")) / F.first("total"), F.sum(F.col("n") * F.col("n") / F.col("a")) / F.first("total")
    out = cells.groupBy(*keys).agg(p.alias("precision"), r.alias("recall"), F.first("total").alias("n_items"), F.countDistinct("t").alias("n_true"), F.countDistinct("p").alias("n_predicted"))
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def _entropy(cells: DataFrame, label: str, size: str, keys: Sequence[str], name: str) -> DataFrame:
    share = F.col(size) / F.col("total")
    return cells.select(*keys, label, size, "total").distinct().groupBy(*keys).agg((-F.sum(share * F.ln(share))).alias(name), F.count("*").alias(f"n_{name}"))


def mutual_information(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mi, h_true, h_pred, nmi) with the arithmetic mean of entropies; one cluster on both sides is 1, no information 0."""
    n = F.col("n")
    mi = cells.groupBy(*keys).agg(F.sum(n / F.col("total") * F.ln(n * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    u, v = _entropy(cells, "t", "a", keys, "h_true"), _entropy(cells, "p", "b", keys, "h_pred")
    joined = mi.join(u, list(keys)).join(v, list(keys)) if keys else mi.crossJoin(u).crossJoin(v)  # one row each without keys
    single = (F.col("n_h_true") == 1) & (F.col("n_h_pred") == 1)
    nmi = F.when(single, 1.0).when(F.abs("mi") < 1e-15, 0.0).otherwise(2 * F.col("mi") / (F.col("h_true") + F.col("h_pred")))
    return joined.withColumn("nmi", nmi)


def expected_information(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, emi): the mean information of random partitions with these marginals, by the hypergeometric sum.

    Pairs of equal marginal sizes are computed once."""
    sizes = lambda label, size: cells.select(*keys, label, size, "total").distinct().groupBy(*keys, size, "total").agg(F.count("*").alias(f"m_{size}"))
    a, b = sizes("t", "a"), sizes("p", "b")
    pairs = a.join(b.drop("total"), list(keys)) if keys else a.crossJoin(b.drop("total"))  # distinct sizes, at most sqrt(2 * total) each
    pairs = pairs if keys else pairs.repartition(cells.sparkSession.sparkContext.defaultParallelism)
    # Hoeffding's bound for draws without replacement: farther from the mean than this, all terms together have less than 1e-18.
    mean, reach = F.col("a") * F.col("b") / F.col("total"), F.sqrt(F.least("a", "b") * (math.log(2e18) / 2))
    low = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("total"), F.floor(mean - reach).cast("long"))
    high = F.least("a", "b", F.ceil(mean + reach).cast("long"))
    terms = pairs.withColumn("k", F.explode(F.sequence(low, high)))
    a, b, k, n = (F.col(c).cast("double") for c in ("a", "b", "k", "total"))
    above = (log_factorial(x) for x in (a, b, n - a, n - b))
    under = (log_factorial(x) for x in (n, k, a - k, b - k, n - a - b + k))
    log_p = sum(above, F.lit(0.0)) - sum(under, F.lit(0.0))
    return terms.groupBy(*keys).agg(F.sum(F.col("m_a") * F.col("m_b") * k / n * F.ln(n * k / (a * b)) * F.exp(log_p)).alias("emi"))


def adjusted(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mutual_information with emi and ami."""
    info, emi = mutual_information(cells, keys), expected_information(cells, keys)
    joined = info.join(emi, list(keys)) if keys else info.crossJoin(emi)  # one row each without keys
    single = (F.col("n_h_true") == 1) & (F.col("n_h_pred") == 1)
    ami = (F.col("mi") - F.col("emi")) / ((F.col("h_true") + F.col("h_pred")) / 2 - F.col("emi"))
    return joined.withColumn("ami", F.when(single, 1.0).otherwise(ami))


def adjusted_rand(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """An extension: the adjusted Rand index from the same cells."""
    two = lambda c: c * (c - 1) / 2
    cell = cells.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("both"), F.first(two(F.col("total"))).alias("all"))
    side = lambda label, size, name: cells.select(*keys, label, size).distinct().groupBy(*keys).agg(F.sum(two(F.col(size))).alias(name))
    t, p = side("t", "a", "in_true"), side("p", "b", "in_pred")
    joined = cell.join(t, list(keys)).join(p, list(keys)) if keys else cell.crossJoin(t).crossJoin(p)  # one row each without keys
    chance = F.col("in_true") * F.col("in_pred") / F.col("all")
    best = (F.col("in_true") + F.col("in_pred")) / 2
    return joined.select(*keys, F.when(best == chance, 1.0).otherwise((F.col("both") - chance) / (best - chance)).alias("ari"))


def scored_or_error(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """B-cubed with ``error``: one row, also where there is nothing to score or a label is missing on one side."""
    counts = rows.agg(F.count(truth).alias("n_truth"), F.count(predicted).alias("n_labels"))
    error = F.when((F.col("n_truth") == 0) | (F.col("n_labels") == 0), "empty input").when(F.col("n_truth") != F.col("n_labels"), "unequal lengths")
    scored = b_cubed(contingency(rows, truth, predicted))
    joined = counts.withColumn("error", error).join(F.broadcast(scored), F.col("error").isNull(), "left")  # one row on either side
    return joined.select("precision", "recall", "f1", "n_items", "n_true", "n_predicted", "error")


def macro(per_key: DataFrame, *metrics: str) -> DataFrame:
    return per_key.agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_windows"))
