"""Drift of features, segments and states against a reference month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memberlens.functions.ranking import quantiles_from_ranks, ranked_values, unpivot
from memberlens.functions.scalars import beside
from memberlens.operators.validate import psi_from_bins
from memberlens.session import cut_lineage, small_side

PSI_WARN, PSI_ALERT = 0.10, 0.25
CH_DROP_ALERT = 0.20
MIX_ALERT = 0.10


def paired_values(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, is_reference) of both months in long form."""
    ref = unpivot(reference, columns).withColumn("is_reference", F.lit(1).cast("long"))
    cur = unpivot(current, columns).withColumn("is_reference", F.lit(0).cast("long"))
    return ref.unionByName(cur)


def ranked_pair(pairs: DataFrame) -> DataFrame:
    """Per distinct value of a feature: counts and counts below, for either month."""
    return ranked_values(pairs, "value", ["feature"], {
        "r": F.sum("is_reference"), "c": F.sum(1 - F.col("is_reference"))})


def ks_statistic(ranked: DataFrame) -> DataFrame:
    """Largest distance between the two cumulative distributions, on all rows."""
    gap = F.abs((F.col("r_below") + F.col("r")) / F.col("r_total") - (F.col("c_below") + F.col("c")) / F.col("c_total"))
    return ranked.groupBy("feature").agg(F.max(gap).alias("ks_stat"), F.max("r_total").alias("n_reference"), F.max("c_total").alias("n_current"))


def ks_p_value(stat: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value (Kolmogorov series)."""
    lam = F.sqrt(n * m / (n + m)) * stat
    sign = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + sign(j) * F.exp(-2.0 * j * j * lam * lam))
    # for tiny arguments the alternating series does not converge; the probability is 1
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def quantile_psi(ranked: DataFrame, bins: int = 10) -> DataFrame:
    """PSI per feature over quantile bins of the reference month.

    Outer edges are open, equal edges merge, and a feature with fewer than three
    distinct edges has PSI 0.
    """
    as_reference = ranked.where(F.col("r") > 0).select(
        "feature", "value", F.col("r").alias("n"), F.col("r_below").alias("n_below"), F.col("r_total").alias("n_total"))
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = quantiles_from_ranks(as_reference, "value", probs, ["feature"]).select(
        "feature", F.array_sort(F.array_distinct(F.array(*list(probs)))).alias("_edges"))
    # one row of at most bins + 1 edges per feature
    placed = ranked.join(small_side(edges), "feature", "left")
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    enough = F.size("_edges") >= 3
    place = F.when(enough, F.size(F.filter(inner, lambda e: e <= F.col("value")))).otherwise(F.lit(0))
    counts = placed.groupBy("feature", place.alias("bin")).agg(F.sum("r").alias("n_expected"), F.sum("c").alias("n_actual"))
    return psi_from_bins(counts, ["feature"])


def feature_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI, KS and means per feature with a status, most drifted first."""
    # stored: edges, placement, distances and means all read it
    ranked = cut_lineage(ranked_pair(paired_values(reference, current, columns)))
    means = ranked.groupBy("feature").agg(
        (F.sum(F.col("value") * F.col("r")) / F.sum("r")).alias("ref_mean"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("cur_mean"))
    psi = F.col("psi")
    status = F.when(psi > PSI_ALERT, "ALERT").when(psi > PSI_WARN, "WARN").otherwise("ok")
    return (quantile_psi(ranked).join(ks_statistic(ranked), "feature").join(means, "feature")
            .withColumn("ks_pvalue", ks_p_value(F.col("ks_stat"), F.col("n_reference"), F.col("n_current")))
            .withColumn("status", status).orderBy(F.desc("psi"), "feature"))


def mix_shift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Share of every value in both months."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    both = reference.select(F.col(column), one.alias("_r"), zero.alias("_c")).unionByName(
        current.select(F.col(column), zero.alias("_r"), one.alias("_c")))
    counts = both.groupBy(column).agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))  # one row per category
    whole = Window.partitionBy(F.lit(1))
    return counts.select(column, (F.col("_r") / F.sum("_r").over(whole)).alias("ref_share"), (F.col("_c") / F.sum("_c").over(whole)).alias("cur_share"))


def total_variation(shares: DataFrame) -> DataFrame:
    return shares.agg((F.sum(F.abs(F.col("ref_share") - F.col("cur_share"))) / 2.0).alias("tvd"))


def quality_drop(spark: SparkSession, ch_reference: float, ch_current: float, limit: float = CH_DROP_ALERT) -> DataFrame:
    """Calinski-Harabasz of both months under the frozen centroids, its relative fall, and whether that exceeds the limit."""
    fall = (ch_reference - ch_current) / ch_reference if ch_reference else 0.0
    return spark.createDataFrame([(float(ch_reference), float(ch_current), float(fall), fall > limit)],
                                 "ch_reference double, ch_current double, fractional_drop double, is_alert boolean")


def drift_verdict(features: DataFrame, segment_tvd: DataFrame, state_tvd: DataFrame, ch_reference: float, ch_current: float) -> DataFrame:
    """One row: alerts, warnings and HEALTHY / MONITOR / RETRAIN_RECOMMENDED."""
    drop = (ch_reference - ch_current) / ch_reference if ch_reference else 0.0
    one = features.agg(
        F.count(F.when(F.col("status") == "ALERT", 1)).alias("n_alert"), F.count(F.when(F.col("status") == "WARN", 1)).alias("n_warn"),
        F.max(F.struct("psi", "feature")).alias("_top"))
    row = beside(beside(one, segment_tvd.select(F.col("tvd").alias("segment_mix_tvd"))),
                 state_tvd.select(F.col("tvd").alias("state_mix_tvd")))
    alert = (F.col("n_alert") > 0) | F.lit(drop > CH_DROP_ALERT) | (F.col("segment_mix_tvd") > MIX_ALERT)
    warn = (F.col("n_warn") > 0) | (F.col("state_mix_tvd") > MIX_ALERT)
    return row.select(
        F.col("_top.feature").alias("max_psi_feature"), F.col("_top.psi").alias("max_psi"), "n_alert", "n_warn", F.lit(float(drop)).alias("ch_drop"),
        "segment_mix_tvd", "state_mix_tvd",
        F.when(alert, "RETRAIN_RECOMMENDED").when(warn, "MONITOR").otherwise("HEALTHY").alias("verdict"))


def require_healthy(verdict: DataFrame) -> None:
    """Fail the job when retraining is recommended."""
    row = verdict.first()
    if row.verdict == "RETRAIN_RECOMMENDED":
        raise RuntimeError(f"drift alert: {row.asDict()}")
