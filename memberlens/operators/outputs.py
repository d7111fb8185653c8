"""Scoring outputs, their contracts, and the queries asked of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from memberlens.functions.exprs import count_where, half_even, lookup
from memberlens.functions.ranking import exact_quantiles, unpivot
from memberlens.functions.vectors import array_sum, element
from memberlens.operators.states import STATES, state_confidence, state_column, supporting_evidence
from memberlens.session import small_side
from memberlens.sources.tables import replace_folder, write_csv

# Activation text per state.
ACTIVATIONS = {
    "Lapse Risk": "Channel: email+SMS | Message: personalised win-back with bonus points | Offer: double points on next purchase | Timing: within 7 days",
    "Momentum Builder": "Channel: app push | Message: tier upgrade progress | Offer: tier accelerator bonus | Timing: immediate",
    "Silent Accumulator": "Channel: app push | Message: unspent points reminder | Offer: limited-time redemption bonus | Timing: weekly",
    "Program Skeptic": "Channel: email | Message: re-permission with value proof | Offer: one-time surprise reward | Timing: monthly",
    "Win-Back Target": "Channel: email+SMS | Message: we miss you | Offer: reactivation bonus points | Timing: immediate",
    "Brand Advocate": "Channel: app | Message: early access to new reward | Offer: referral bonus | Timing: immediate",
    "Value Maximizer": "Channel: email | Message: cross-category points multiplier | Offer: category diversity bonus | Timing: mid-month",
    "Redemption Hunter": "Channel: email+push | Message: targeted flash promotion | Offer: limited-time category reward | Timing: around promotional periods",
    "Plateau Cruiser": "Channel: email | Message: personalised recommendation | Offer: curated reward unlock | Timing: monthly",
    "New & Uncertain": "Channel: app onboarding | Message: welcome journey | Offer: first-purchase bonus | Timing: within 7 days of enrollment",
}

# Tone per segment.
SEGMENT_TONES = {
    "High-Tier Accelerator": "VIP/exclusive framing — no discounts",
    "Growth Builder": "progression/momentum framing",
    "Program Skeptic": "low-commitment offer — value proof first",
    "Silent Accumulator": "simple, transactional framing",
    "Plateau Cruiser": "personalised curation framing",
}


def segment_code(segment_id: Column) -> Column:
    """0 -> S01, 1 -> S02, …"""
    return F.concat(F.lit("S"), F.lpad((segment_id + 1).cast("string"), 2, "0"))


def segment_assignments(assigned: DataFrame) -> DataFrame:
    return assigned.select("member_id", "observation_date", segment_code(F.col("segment_id")).alias("segment_id"), "segment_name", "segment_confidence")


def state_assignments(features: DataFrame) -> DataFrame:
    named = features.withColumn("state_name", state_column())
    state = F.col("state_name")
    return named.select("member_id", "observation_date", "state_name", state_confidence(state).alias("state_confidence"),
                        supporting_evidence(state).alias("supporting_evidence"))


def transition_predictions(scored: DataFrame, n_classes: int) -> DataFrame:
    """Current and predicted segment, confidence of the prediction and one probability column per segment."""
    return scored.select(
        "member_id", segment_code(F.col("seg_curr")).alias("current_segment_id"), segment_code(F.col("seg_pred")).alias("predicted_segment_id"),
        half_even(element(F.col("proba"), F.col("seg_pred")), 4).alias("prediction_confidence"),
        *[half_even(F.element_at("proba", c + 1), 4).alias(f"prob_S{c + 1:02d}") for c in range(n_classes)])


# --- contracts ----------------------------------------------------------------------------

def contract_check(output: DataFrame, spine: DataFrame, rules: dict) -> DataFrame:
    """Rows against the spine and the number of rows that break each rule, in one aggregation."""
    expected = spine.agg(F.count(F.lit(1)).alias("n_expected"))
    checked = output.agg(F.count(F.lit(1)).alias("n_rows"), *[count_where(~F.coalesce(r, F.lit(False))).alias(f"bad_{n}") for n, r in rules.items()])
    bad = [F.col(f"bad_{n}") for n in rules]
    ok = F.col("n_rows") == F.col("n_expected")
    for b in bad:
        ok = ok & (b == 0)
    return checked.withColumn("n_expected", expected.scalar()).withColumn("passed", ok)


def write_checked(output: DataFrame, path: str, n_expected: int, rules: dict, write: Callable[[DataFrame, str], None] = write_csv) -> dict[str, int]:
    """Write an output and check its contract in the same pass: rows and broken rules are observed while they are written.

    The output goes to a folder beside `path` and takes its place only if the contract holds; else the check fails and what `path` held before stays.
    """
    seen = Observation()
    metrics = [count_where(~F.coalesce(r, F.lit(False))).alias(f"bad_{n}") for n, r in rules.items()]
    beside = f"{path.rstrip('/')}.unchecked"
    write(output.observe(seen, F.count(F.lit(1)).alias("n_rows"), *metrics), beside)
    found = {"n_rows": 0, **{f"bad_{n}": 0 for n in rules}, **seen.get}
    if found["n_rows"] != n_expected or any(found[f"bad_{n}"] for n in rules):
        raise AssertionError(f"output contract broken: {found}, {n_expected} rows expected")
    replace_folder(output.sparkSession, beside, path)
    return found


def segment_rules(valid: Sequence[str]) -> dict:
    return {"confidence": F.col("segment_confidence").between(0, 1), "segment_id": F.col("segment_id").isin(list(valid))}


def state_rules() -> dict:
    return {"confidence": F.col("state_confidence").between(0, 1), "state": F.col("state_name").isin(list(STATES)),
            "evidence": F.col("supporting_evidence").contains(":")}


def prediction_rules(valid: Sequence[str]) -> dict:
    total = array_sum(F.array(*[F.col(f"prob_{s}") for s in valid]))
    return {"probability_sum": F.abs(total - 1.0) <= 1e-3, "current": F.col("current_segment_id").isin(list(valid)),
            "predicted": F.col("predicted_segment_id").isin(list(valid))}


def require_contract(check: DataFrame) -> None:
    row = check.first()
    if not row.passed:
        raise AssertionError(f"output contract broken: {row.asDict()}")


# --- profiles -------------------------------------------------------------------------------

def key_characteristics(combined: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The features that separate a segment most from the population (|z| of its mean), with mean and median.

    Null values are ignored; a constant feature counts with deviation 1. Ties go by feature name.
    """
    long = unpivot(combined, columns, ["segment_id"])
    moments = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")]
    overall = long.groupBy("feature").agg(*moments).select(
        "feature", F.col("mean").alias("_mean"), F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0)).otherwise(F.col("std")).alias("_std"))
    inside = long.groupBy("segment_id", "feature").agg(F.avg("value").alias("mean"))
    # segments x features rows from here on; medians, which need ranks, are taken of the winners only
    z = inside.join(small_side(overall), "feature").withColumn("z", F.abs((F.col("mean") - F.col("_mean")) / F.col("_std")))
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("z"), "feature"))
    best = small_side(z.withColumn("rank", rank).where(F.col("rank") <= top))
    winners = long.join(best.select("segment_id", "feature"), ["segment_id", "feature"], "left_semi")
    medians = exact_quantiles(winners, "value", {"median": .5}, ["segment_id", "feature"])
    return best.join(medians, ["segment_id", "feature"]).select(
        "segment_id", "rank", "feature", half_even(F.col("mean"), 4).alias("mean"), half_even(F.col("median"), 4).alias("median"))


def segment_sizes(combined: DataFrame) -> DataFrame:
    """Members, share and card-holder mix per segment."""
    counts = combined.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_members"), F.avg("is_cardholder").alias("_card"))
    whole = F.sum("n_members").over(Window.partitionBy(F.lit(1)))  # one row per segment
    return counts.select("segment_id", "n_members", half_even(F.col("n_members") / whole * 100.0, 2).alias("pct"),
                         half_even(F.col("_card") * 100.0, 2).alias("cardholder_pct"), half_even(100.0 - F.col("_card") * 100.0, 2).alias("non_cardholder_pct"))


def common_states(combined: DataFrame, top: int = 3) -> DataFrame:
    counts = combined.groupBy("segment_id", "state_name").agg(F.count(F.lit(1)).alias("n_members"))
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("n_members"), "state_name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def activation_texts(combined: DataFrame, names: Sequence[str]) -> DataFrame:
    """Activation text for every segment and state; combinations without members say so."""
    spark = combined.sparkSession
    catalogue = spark.createDataFrame([(n, s) for n in dict.fromkeys(names) for s in STATES], "segment_name string, state_name string")
    counts = combined.groupBy("segment_name", "state_name").agg(F.count(F.lit(1)).alias("n_members"))
    tone = lookup(F.col("segment_name"), SEGMENT_TONES)
    base = lookup(F.col("state_name"), ACTIVATIONS, "Channel: email | Timing: monthly")
    spoken = F.when(tone.isNull(), base).otherwise(F.concat(base, F.lit(" | Tone: "), tone))
    nobody = F.concat(F.lit("No members in "), F.col("segment_name"), F.lit(" x "), F.col("state_name"), F.lit(" combination"))
    joined = catalogue.join(counts, ["segment_name", "state_name"], "left").na.fill(0, ["n_members"])
    return joined.withColumn("activation", F.when(F.col("n_members") == 0, nobody).otherwise(spoken))


def segment_profiles(combined: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One document per segment: size, characteristics, card mix, activations, common states."""
    sizes = segment_sizes(combined)
    traits = key_characteristics(combined, columns).groupBy("segment_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "feature", "mean", "median"))).alias("key_characteristics"))
    states = common_states(combined).groupBy("segment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "state_name"))), lambda s: s["state_name"]).alias("common_states"))
    labels = combined.sparkSession.createDataFrame(list(enumerate(names)), "segment_id int, segment_name string")
    texts = activation_texts(combined, names).groupBy("segment_name").agg(
        F.map_from_entries(F.collect_list(F.struct("state_name", "activation"))).alias("recommended_activation"))
    # an empty segment keeps a document with zero members
    return (labels.join(sizes, "segment_id", "left").join(traits, "segment_id", "left").join(states, "segment_id", "left")
            .join(texts, "segment_name", "left").na.fill(0, ["n_members", "pct", "cardholder_pct", "non_cardholder_pct"]))


# --- queries ----------------------------------------------------------------------------------

def with_cohort_score(scored: DataFrame) -> DataFrame:
    """Rank value: value at risk where known, else the probability of moving."""
    moving = 1.0 - element(F.col("proba"), F.col("seg_curr"))
    score = F.col("value_at_risk") if "value_at_risk" in scored.columns else moving
    return scored.withColumns({"probability_of_moving": moving, "rank_score": score})


def cohort(scored: DataFrame, segment_name: str | None = None, state_name: str | None = None, predicted_segment_name: str | None = None) -> DataFrame:
    out = scored
    for column, wanted in (("segment_name", segment_name), ("state_name", state_name), ("predicted_segment_name", predicted_segment_name)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return with_cohort_score(out)


def cohort_members(selected: DataFrame, top: int = 50) -> DataFrame:
    """The top of the targeting list, ties by member id (a top-k report)."""
    columns = [c for c in ("segment_name", "state_name", "predicted_segment_name", "adverse_probability", "value_at_risk") if c in selected.columns]
    return selected.select("member_id", *columns, "probability_of_moving", "rank_score").orderBy(F.desc("rank_score"), "member_id").limit(top)


def cohort_totals(selected: DataFrame) -> DataFrame:
    value = F.sum("value_at_risk") if "value_at_risk" in selected.columns else F.lit(None).cast("double")
    return selected.agg(F.count(F.lit(1)).alias("matched"), value.alias("cohort_value_at_risk"))


def catalogue_distribution(df: DataFrame, column: str, catalogue: Sequence[str]) -> DataFrame:
    """Members and share for every catalogue entry, also those without members."""
    names = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(catalogue, start=1)], f"position int, {column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("members"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, column, "left").na.fill(0, ["members"]).withColumn("share", F.col("members") / total.scalar())


def member_view(outputs: DataFrame, member_id: str) -> DataFrame:
    return outputs.where(F.col("member_id") == member_id)


def review_sample(scored: DataFrame, members: int = 400, seed: int = 42) -> DataFrame:
    """For every segment and state: the members with most value at risk, and others picked by a seeded hash.

    Spark pushes the rank limit below the exchange (window group limit), so each
    task passes on at most the wanted number of rows per group.
    """
    groups = scored.select("segment_name", "state_name").distinct().count()
    per_group = max(2, members // max(groups, 1))
    head = max(1, per_group // 2)
    place = F.xxhash64(F.lit(seed), F.col("member_id"))
    w = Window.partitionBy("segment_name", "state_name")
    ranked = scored.withColumn("_value_rank", F.row_number().over(w.orderBy(F.desc("value_at_risk"), "member_id")))
    top = ranked.where(F.col("_value_rank") <= head).drop("_value_rank").withColumn("picked_by", F.lit("value"))
    known = small_side(top.select("member_id"))
    rest = scored.join(known, "member_id", "left_anti").withColumn("_hash_rank", F.row_number().over(w.orderBy(place, "member_id")))
    others = rest.where(F.col("_hash_rank") <= per_group - head).drop("_hash_rank").withColumn("picked_by", F.lit("hash"))
    return top.unionByName(others)


def targeting_totals(eligibility: DataFrame) -> DataFrame:
    """Members per suppression reason; the empty reason reads 'targetable'."""
    reason = F.when(F.col("suppression_reason") == "", "targetable").otherwise(F.col("suppression_reason"))
    return eligibility.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("members"))


def targeting_value(eligibility: DataFrame, risk: DataFrame) -> DataFrame:
    """Members and their value at risk per suppression reason, with the share of all value; `risk` has member_id and value_at_risk.

    Members without a risk row count with 0.
    """
    reason = F.when(F.col("suppression_reason") == "", "targetable").otherwise(F.col("suppression_reason"))
    valued = eligibility.select("member_id", reason.alias("reason")).join(risk.select("member_id", "value_at_risk"), "member_id", "left")
    totals = valued.groupBy("reason").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("value_at_risk"), F.lit(0.0)).alias("value_at_risk"))
    whole = F.sum("value_at_risk").over(Window.partitionBy(F.lit(1)))  # one row per reason
    return totals.withColumn("value_share", F.coalesce(F.try_divide(F.col("value_at_risk"), whole), F.lit(0.0)))


def recovery_percentiles(eligibility: DataFrame) -> DataFrame:
    return exact_quantiles(eligibility.select(F.col("effective_recovery_rate").alias("value")), "value", {"p10": .1, "median": .5, "p90": .9})
