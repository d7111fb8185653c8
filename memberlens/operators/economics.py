"""Campaign economics on scored rows.

A scored row has `proba` (array<double>, one entry per segment), `seg_curr` and,
where the outcome is known, `seg_next`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.exprs import count_where, ratio
from memberlens.functions.ranking import ranked_values
from memberlens.functions.vectors import array_lit, element

# Grids of the operating-point search.
PROBABILITY_GRID = tuple(i / 100 for i in range(1, 100))
K_GRID = tuple(i / 10 for i in range(1, 51)) + tuple(5.5 + i * (40.0 - 5.5) / 39 for i in range(40))
RECOVERY_RATES = (0.02, 0.05, 0.10, 0.20, 0.30)
CONTACT_COST = 5.0
RECOVERY_RATE = 0.10


def segment_values(df: DataFrame, n_classes: int, segment: str = "seg_curr", spend: str = "spend_total_180d") -> DataFrame:
    """Mean spend per segment; segments that do not occur are worth 0."""
    classes = df.sparkSession.range(n_classes).withColumnRenamed("id", segment)
    means = df.groupBy(F.col(segment).cast("long").alias(segment)).agg(F.avg(spend).alias("segment_value"))
    return classes.join(means, segment, "left").na.fill(0.0, ["segment_value"])


def collect_values(values: DataFrame, segment: str = "seg_curr") -> list[float]:
    """The value table (one row per class) as a list, to be used as a literal array."""
    return [r.segment_value for r in values.orderBy(segment).collect()]


def _current(values: Sequence[float]) -> Column:
    return element(array_lit(values), F.col("seg_curr"))


def value_at_risk(values: Sequence[float]) -> Column:
    """Expected loss over moves to lower-valued segments; one term per class, in generated code."""
    now = _current(values)
    return sum([F.element_at("proba", i + 1) * F.greatest(F.lit(0.0), now - F.lit(float(v))) for i, v in enumerate(values)], F.lit(0.0))


def adverse_probability(values: Sequence[float]) -> Column:
    now = _current(values)
    return sum([F.when(now > F.lit(float(v)), F.element_at("proba", i + 1)).otherwise(F.lit(0.0)) for i, v in enumerate(values)], F.lit(0.0))


def realised_loss(values: Sequence[float]) -> Column:
    return F.greatest(F.lit(0.0), _current(values) - element(array_lit(values), F.col("seg_next")))


def with_risk(scored: DataFrame, values: Sequence[float]) -> DataFrame:
    """Adds value_at_risk, adverse_probability and, with a known outcome, realised_loss and actually_adverse."""
    out = scored.withColumns({"value_at_risk": value_at_risk(values), "adverse_probability": adverse_probability(values)})
    if "seg_next" in scored.columns:
        out = out.withColumn("realised_loss", realised_loss(values)).withColumn(
            "actually_adverse", element(array_lit(values), F.col("seg_next")) < _current(values))
    return out


def contact_by_probability(threshold: float) -> Column:
    return F.col("adverse_probability") >= F.lit(float(threshold))


def contact_by_value(recovery_rate: float = RECOVERY_RATE, cost: float = CONTACT_COST, k: float = 1.0) -> Column:
    return F.col("value_at_risk") * F.lit(float(recovery_rate)) >= F.lit(float(cost)) * F.lit(float(k))


def _outcome(contacted: Column, hits: Column, loss: Column, rows: Column, adverse: Column, cost: float, rate: Column) -> dict[str, Column]:
    spent = contacted * F.lit(float(cost))
    recovered = loss * rate
    return {
        "contacted": contacted.cast("long"),
        "contact_rate": ratio(contacted, rows),
        "cost": spent,
        "recovered": recovered,
        "profit": recovered - spent,
        "roi": ratio(recovered - spent, spent),
        "precision": ratio(hits, contacted),
        "recall": ratio(hits, adverse),
    }


def evaluate_campaign(df: DataFrame, contact: Column, cost: float = CONTACT_COST, rate: float = RECOVERY_RATE) -> DataFrame:
    """Score a contact rule against what happened; only truly adverse cases recover value."""
    hit = contact & F.col("actually_adverse")
    one = df.agg(
        count_where(contact).alias("_c"), count_where(hit).alias("_h"),
        F.coalesce(F.sum(F.when(hit, F.col("realised_loss"))), F.lit(0.0)).alias("_l"),
        F.count(F.lit(1)).alias("_n"), count_where(F.col("actually_adverse")).alias("_a"))
    measures = _outcome(F.col("_c"), F.col("_h"), F.col("_l"), F.col("_n"), F.col("_a"), cost, F.lit(float(rate)))
    return one.select(*[c.alias(n) for n, c in measures.items()])


def sweep(df: DataFrame, score: Column, grid: Sequence[float], cost: float = CONTACT_COST, rate: float = RECOVERY_RATE,
          labels: Sequence[float] | None = None) -> DataFrame:
    """Campaign outcome for every threshold t of the ascending grid, contacting rows with score >= t.

    A row is counted once, at the highest grid point it reaches; outcomes at
    lower points follow by summing from the top over the grid. Nothing is
    repeated per grid point.
    """
    points = [float(g) for g in grid]
    marks = array_lit(labels if labels is not None else points)

    def reached(low: int, high: int) -> Column:
        """Number of grid points at or below the score, by bisection."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(score >= F.lit(points[middle]), reached(middle + 1, high)).otherwise(reached(low, middle))

    adverse = F.col("actually_adverse")
    level = df.groupBy(reached(0, len(points)).alias("_level")).agg(
        F.count(F.lit(1)).alias("_c"), count_where(adverse).alias("_h"),
        F.coalesce(F.sum(F.when(adverse, F.col("realised_loss"))), F.lit(0.0)).alias("_l"))
    # every grid point occurs, also when no row stops there
    steps = df.sparkSession.range(0, len(points) + 1).select(F.col("id").cast("int").alias("_level"))
    full = steps.join(level, "_level", "left").na.fill(0, ["_c", "_h"]).na.fill(0.0, ["_l"])
    # at most one row per grid point
    down = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = full.select("_level", *[F.sum(c).over(down).alias(c) for c in ("_c", "_h", "_l")],
                         F.sum("_c").over(everything).alias("_n"), F.sum("_h").over(everything).alias("_a"))
    measures = _outcome(F.col("_c"), F.col("_h"), F.col("_l"), F.col("_n"), F.col("_a"), cost, F.lit(float(rate)))
    f1 = ratio(2 * F.col("_h"), F.col("_c") + F.col("_a"))
    return (summed.where(F.col("_level") > 0)
            .select(F.element_at(marks, F.col("_level")).alias("threshold"), *[c.alias(n) for n, c in measures.items()],
                    f1.alias("f1")))


def probability_sweep(df: DataFrame, grid: Sequence[float] = PROBABILITY_GRID, **costs) -> DataFrame:
    return sweep(df, F.col("adverse_probability"), grid, **costs)


def value_sweep(df: DataFrame, grid: Sequence[float] = K_GRID, cost: float = CONTACT_COST, rate: float = RECOVERY_RATE) -> DataFrame:
    """Sweep over k of the expected-value rule: value at risk x rate against cost x k."""
    return sweep(df, F.col("value_at_risk") * F.lit(float(rate)), [cost * k for k in grid], cost, rate, labels=grid)


def best_point(swept: DataFrame, by: str = "profit") -> DataFrame:
    """The grid point with the highest profit (or F1), the lowest threshold on ties."""
    return swept.orderBy(F.desc(by), "threshold").limit(1)


def choose_and_apply(validation: DataFrame, test: DataFrame, cost: float = CONTACT_COST, rate: float = RECOVERY_RATE) -> DataFrame:
    """Pick each policy's operating point on validation and report it on test."""
    def at(df: DataFrame, policy: str, point: float, contact: Column) -> DataFrame:
        return evaluate_campaign(df, contact, cost, rate).select(F.lit(policy).alias("policy"), F.lit(float(point)).alias("threshold"), "*")

    by_probability = probability_sweep(validation, cost=cost, rate=rate)
    p = best_point(by_probability).first().threshold
    f = best_point(by_probability, "f1").first().threshold
    k = best_point(value_sweep(validation, cost=cost, rate=rate)).first().threshold
    return (at(test, "contact_everyone", 0.0, F.lit(True))
            .union(at(test, "f1_optimal", f, contact_by_probability(f)))
            .union(at(test, "best_probability", p, contact_by_probability(p)))
            .union(at(test, "ev_optimal", k, contact_by_value(rate, cost, k))))


def recovery_sensitivity(validation: DataFrame, test: DataFrame, rates: Sequence[float] = RECOVERY_RATES,
                         cost: float = CONTACT_COST) -> DataFrame:
    """For each assumed recovery rate, the value rule chosen on validation and its result on test."""
    out = None
    for rate in rates:
        k = best_point(value_sweep(validation, cost=cost, rate=rate)).first().threshold
        row = evaluate_campaign(test, contact_by_value(rate, cost, k), cost, rate).select(
            F.lit(float(rate)).alias("recovery_rate"), F.lit(float(k)).alias("threshold"), "*")
        out = row if out is None else out.union(row)
    return out


def break_even_rates(df: DataFrame, cost: float = CONTACT_COST, k: float = 1.0) -> DataFrame:
    """All recovery rates on (0, 1] at which profit turns from loss to gain or back: recovery_rate, contacted, profit, change.

    At rate r the rule contacts value_at_risk >= cost k / r, i.e. rows whose level k cost / value_at_risk is at most r. Between two
    levels profit is a line in r, so it changes its sign at the line's root or by the jump at a level; both are exact. Levels are
    summed by ranked slices, never in one task.
    """
    needed = F.try_divide(F.lit(float(cost) * float(k)), F.col("value_at_risk"))
    adverse, one = F.col("actually_adverse"), F.lit(1).cast("long")
    levels = df.where(F.col("value_at_risk") > 0).where(needed <= 1.0).select(needed.alias("level"), one.alias("n"), F.coalesce(F.when(adverse, F.col("realised_loss")), F.lit(0.0)).alias("loss"))
    # rate 1 ends the last line also where no row has that level
    end = df.sparkSession.range(1).select(F.lit(1.0).alias("level"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("loss"))
    ranked = ranked_values(levels.unionByName(end), "level", weights={"n": F.sum("n"), "loss": F.sum("loss")}, previous="earlier")
    level, price = F.col("level"), F.lit(float(cost))
    profit = lambda loss, n, rate: loss * rate - n * price
    before, after = profit(F.col("loss_below"), F.col("n_below"), level), profit(F.col("loss_below") + F.col("loss"), F.col("n_below") + F.col("n"), level)
    root = F.when((F.col("loss_below") > 0) & (before > 0) & (profit(F.col("loss_below"), F.col("n_below"), F.col("earlier")) <= 0), price * F.col("n_below") / F.col("loss_below"))
    change = lambda gains: F.when(gains, "becomes_profitable").otherwise("becomes_unprofitable")
    on_line = F.struct(root.alias("recovery_rate"), F.col("n_below").alias("contacted"), F.lit(0.0).alias("profit"), change(F.lit(True)).alias("change"))
    at_level = F.struct(F.when((before > 0) != (after > 0), level).alias("recovery_rate"), (F.col("n_below") + F.col("n")).alias("contacted"), after.alias("profit"), change(after > 0).alias("change"))
    return ranked.select(F.explode(F.array(on_line, at_level)).alias("r")).select("r.*").where(F.col("recovery_rate").isNotNull())
