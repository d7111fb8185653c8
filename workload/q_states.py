"""Lifecycle states and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.operators import features, segments, states
from memberlens.session import cut_lineage
from workload import stages
from workload.adapter import MONTHS, table
from workload.oracle import STATES, half_even
from workload.oracle import at_observed as sql_at
from workload.oracle import query as sql
from workload.registry import big, query, r6, rounded, when

_OBS = when("observation_date", "observation_date")


@query("state_cascade", sql(f"SELECT member_id, {_OBS}, state_name FROM states"))
def _(spark, sf):
    panel = stages.panel(spark, sf).drop("state_name", "state_id")
    return rounded(states.classify_states(panel).select("member_id", "observation_date", "state_name"))


@query("state_ids", sql(f"SELECT state_name, {big('state_id', 'state_id')}, count(*) AS n_rows FROM states GROUP BY 1, 2"))
def _(spark, sf):
    panel = stages.panel(spark, sf).select("state_name")
    return panel.withColumn("state_id", states.state_id(F.col("state_name"))).groupBy("state_name", "state_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _text(x: str, digits: int) -> str:
    return f"CAST({half_even(x, digits)} AS VARCHAR)"


def _int(x: str) -> str:
    return f"CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR)"


_SENTENCES = {
    "New & Uncertain": ["'Member enrolled '", _int("tenure_days"), "' days ago — too early to establish a reliable behavioural pattern. Onboarding journey applies.'"],
    "Win-Back Target": ["'Member has been inactive for '", _text("coalesce(recency_days, 0)", 1),
                        "' days (60+ day lapse) but showed a digital re-engagement signal this month — email open, app visit, or push click detected.'"],
    "Lapse Risk": ["'Member has not purchased in '", _text("coalesce(recency_days, 0)", 1), "' days and spend trend is declining (slope: '", _text("spend_slope_30d", 2),
                   "'). Without intervention within 30 days, full lapse is likely.'"],
    "Momentum Builder": ["'Member is on an upward trajectory — spend rising at +'", _text("spend_slope_30d", 1), "' per week, with '", _int("purchase_count_30d"),
                         "' purchases in the last 30 days across diverse categories. Most likely to reach the next tier within 60 days.'"],
    "Brand Advocate": ["'Member is deeply engaged across multiple programme touchpoints — holds tier level '", _int("tier_ordinal"), "' (Gold or Platinum) and shops across '",
                       _text("category_diversity_90d", 2), "' normalised category breadth. High email and app activity confirm programme affinity.'"],
    "Redemption Hunter": ["'Member redeems '", _text("redemption_rate", 1), "'% of earned points and made only '", _int("purchase_count_30d"),
                          "' purchase(s) this month — behaviour is driven by redemption events rather than regular spending.'"],
    "Value Maximizer": ["'Member shops strategically across categories (diversity: '", _text("category_diversity_90d", 2), "') and redeems '", _text("redemption_rate", 1),
                        "'% of earned points — optimising both earn rate and reward value.'"],
    "Silent Accumulator": ["'Member made '", _int("purchase_count_30d"), "' purchase(s) this month but opened zero emails, zero app sessions, and zero push notifications. "
                           "They earn points consistently but ignore all programme communications.'"],
    "Plateau Cruiser": ["'Member is in a stable routine — '", _int("purchase_count_30d"), "' purchase(s) this month with a flat spend trend (slope: '", _text("spend_slope_30d", 1),
                        "'). No growth or decline detected; behaviour has been consistent for multiple months.'"],
    "Program Skeptic": ["'No strong behavioural signal detected this month; the member is enrolled but not actively engaging with the programme.'"],
}


@query("rule_sentences", sql_at("SELECT member_id, CASE state_name " + " ".join(f"WHEN '{s}' THEN concat({', '.join(p)})" for s, p in _SENTENCES.items()) + " END AS rule_fired FROM (SELECT * REPLACE (round(spend_slope_30d, 6) AS spend_slope_30d) FROM states)"))
def _(spark, sf):
    return rounded(stages.observed_panel(spark, sf)).select("member_id", states.rule_sentence(F.col("state_name")).alias("rule_fired"))


_CONFIDENCE = half_even("""CASE state_name WHEN 'Lapse Risk' THEN greatest(0.55e0, least(0.95e0, 0.6e0 + greatest(0, least(0.35e0, (coalesce(recency_days, 999) - 30) / 30e0))))
 WHEN 'Momentum Builder' THEN greatest(0.55e0, least(0.95e0, 0.62e0 + greatest(0, least(0.33e0, (spend_slope_30d - 5) / 5e0))))
 WHEN 'New & Uncertain' THEN 0.55e0 WHEN 'Win-Back Target' THEN 0.62e0 ELSE 0.68e0 END""", 4)


@query("state_confidence", sql(f"SELECT member_id, {_OBS}, {r6(_CONFIDENCE, 'state_confidence')} FROM states"))
def _(spark, sf):
    panel = stages.panel(spark, sf)
    return rounded(panel.select("member_id", "observation_date", states.state_confidence(F.col("state_name")).alias("state_confidence")))


_DECLINE = "CAST(CAST(round_even((purchase_count_30d - purchase_count_90d / 3e0) / (purchase_count_90d / 3e0 + 1) * 100, 0) AS BIGINT) AS VARCHAR)"
_APP = ["'app_opens_30d:'", _int("app_open_30d"), "',email_opens_30d:'", _int("email_open_30d")]
_BUYS = ["',purchases_30d:'", _int("purchase_count_30d")]
_RECENCY = ["',recency_days:'", _int("coalesce(recency_days, 0)")]
_EVIDENCE = {
    "Lapse Risk": ["'txn_decline:'", _DECLINE, "'%'", *_RECENCY, *_BUYS],
    "Momentum Builder": ["'spend_slope:'", _text("spend_slope_30d", 1), *_BUYS, "',tier:'", _int("tier_ordinal")],
    "Silent Accumulator": [*_APP, *_BUYS],
    "Brand Advocate": [*_APP, "',tier:'", _int("tier_ordinal"), "',category_diversity:'", _text("category_diversity_90d", 2)],
    "Program Skeptic": [*_APP, *_BUYS],
    "Win-Back Target": ["'purchases_7d:'", _int("purchase_count_7d"), "',prior_83d_activity:'", _int("greatest(purchase_count_90d - purchase_count_7d, 0)"), *_RECENCY],
    "Value Maximizer": ["'redemption_rate:'", _text("redemption_rate", 2), "',category_diversity:'", _text("category_diversity_90d", 2), *_BUYS],
    "Redemption Hunter": ["'redemption_rate:'", _text("redemption_rate", 2), *_BUYS],
    "Plateau Cruiser": ["'spend_slope:'", _text("spend_slope_30d", 1), *_BUYS, *_RECENCY],
    "New & Uncertain": ["'purchase_count_180d:'", _int("purchase_count_180d"), "',account_age_days:unknown'"],
}


@query("supporting_evidence", sql_at("SELECT member_id, CASE state_name " + " ".join(f"WHEN '{s}' THEN concat({', '.join(p)})" for s, p in _EVIDENCE.items()) + " END AS supporting_evidence FROM (SELECT * REPLACE (round(spend_slope_30d, 6) AS spend_slope_30d) FROM states)"))
def _(spark, sf):
    return rounded(stages.observed_panel(spark, sf)).select("member_id", states.supporting_evidence(F.col("state_name")).alias("supporting_evidence"))


@query("states_with_segments", sql(
    f"SELECT member_id, {_OBS}, strftime(observation_date, '%Y_%m') AS observation_month, state_name, {big('coalesce(segment_id, -1)', 'segment_id')}, coalesce(segment_name, 'Unknown') AS segment_name "
    "FROM (SELECT member_id, observation_date, state_name, CASE WHEN segment_id <> 4 THEN segment_id END AS segment_id, CASE WHEN segment_id <> 4 THEN segment_name END AS segment_name FROM named)"))
def _(spark, sf):
    """Members of the last segment have no stored assignment here."""
    panel = stages.panel(spark, sf)
    assigned = panel.where(F.col("segment_id") != 4).select("member_id", "observation_date", "segment_id", "segment_name")
    out = states.attach_segments(panel.select("member_id", "observation_date", "state_name"), assigned)
    return rounded(out.select("member_id", "observation_date", "observation_month", "state_name", "segment_id", "segment_name"))


@query("segment_state_cross_table", sql(
    "SELECT coalesce(segment_name, 'TOTAL') AS segment_name, coalesce(state_name, 'TOTAL') AS state_name, count(*) AS n_members FROM named "
    f"WHERE observation_date = TIMESTAMP '{MONTHS[-1]} 00:00:00' GROUP BY CUBE (segment_name, state_name)"))
def _(spark, sf):
    return states.cross_table(stages.month(stages.panel(spark, sf), MONTHS[-1]))


@query("wide_cross_table", sql(
    "SELECT coalesce(segment_name, 'TOTAL') AS segment_name, " + ", ".join(f"count(*) FILTER (WHERE state_name = '{s}') AS \"{s}\"" for s in STATES)
    + f", count(*) AS \"TOTAL\" FROM named WHERE observation_date = TIMESTAMP '{MONTHS[-1]} 00:00:00' GROUP BY ROLLUP (segment_name)"))
def _(spark, sf):
    return states.wide_cross_table(stages.month(stages.panel(spark, sf), MONTHS[-1]))


_MATRIX = ("SELECT state_name, state_next, count(*) AS n_moves, " + half_even("count(*) / CAST(sum(count(*)) OVER (PARTITION BY state_name) AS DOUBLE)", 4)
           + " AS probability FROM (SELECT state_name, lead(state_name) OVER w AS state_next, date_diff('day', observation_date, lead(observation_date) OVER w) AS gap FROM states "
             "WINDOW w AS (PARTITION BY member_id ORDER BY observation_date)) WHERE state_next IS NOT NULL AND gap BETWEEN 28 AND 35 GROUP BY 1, 2")


@query("state_transition_matrix", sql(f"SELECT state_name, state_next, n_moves, {r6('probability', 'probability')} FROM moves", moves=_MATRIX))
def _(spark, sf):
    return rounded(states.transition_matrix(stages.panel(spark, sf)))


@query("state_retention", sql(f"SELECT state_name, {r6('coalesce(max(probability) FILTER (WHERE state_name = state_next), 0)', 'retention')} FROM moves GROUP BY 1", moves=_MATRIX))
def _(spark, sf):
    return rounded(states.retention_rates(states.transition_matrix(stages.panel(spark, sf))))


@query("top_state_moves", sql(f"SELECT state_name, state_next, n_moves, {r6('probability', 'probability')} FROM moves WHERE state_name <> state_next ORDER BY probability DESC, state_name, state_next LIMIT 5", moves=_MATRIX))
def _(spark, sf):
    return rounded(states.top_moves(states.transition_matrix(stages.panel(spark, sf))))


@query("state_examples", sql_at("SELECT state_name, member_id, segment_name FROM (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY member_id) AS rn FROM named) WHERE rn = 1"))
def _(spark, sf):
    return states.state_examples(stages.observed_panel(spark, sf).select("state_name", "member_id", "segment_name"))


@query("state_distribution", sql(f"SELECT {_OBS}, state_name, count(*) AS n_members, {r6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY observation_date) AS DOUBLE)', 'share')} FROM states GROUP BY observation_date, state_name"))
def _(spark, sf):
    return rounded(states.state_distribution(stages.panel(spark, sf)))


# --- segmentation -----------------------------------------------------------------------------

def fit_columns(df) -> list[str]:
    return features.behavioural_features(df.columns)


def segment_model(spark, sf):
    """One model per data directory, fitted on the first stored month that has a following one."""
    key = (spark.sparkContext.applicationId, str(sf))
    if key not in _models:
        panel = stages.panel(spark, sf)
        _models[key] = segments.fit_segments(stages.month(panel, MONTHS[3]), fit_columns(panel), fit_date=MONTHS[3])
    return _models[key]


_models: dict = {}


@query("fit_population", sql("SELECT member_id, " + _OBS + ", " + r6("coalesce(months_since_last_tier_change, 0)", "months_since_last_tier_change")
                             + " FROM features WHERE feature_complete = 1 AND purchase_count_180d > 0"))
def _(spark, sf):
    population = segments.fit_population(stages.panel(spark, sf)).na.fill(0, ["months_since_last_tier_change"])
    return rounded(population.select("member_id", "observation_date", "months_since_last_tier_change"))


_SCALED = ("spend_total_30d", "recency_days", "redemption_rate", "app_open_90d")


@query("standardised_features", sql_at(
    "SELECT member_id, " + ", ".join(r6(f"coalesce((coalesce(CAST({c} AS DOUBLE), 0) - avg(coalesce({c}, 0)) OVER ()) / nullif(stddev_samp(coalesce({c}, 0)) OVER (), 0), 0)", f"z_{c}") for c in _SCALED)
    + " FROM features WHERE feature_complete = 1 AND purchase_count_180d > 0"))
def _(spark, sf):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    population = segments.fit_population(stages.observed_panel(spark, sf))
    raw = features.model_matrix(population, _SCALED, keep=["member_id"])
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(raw).transform(raw)
    z = vector_to_array("z")
    return rounded(scaled.select("member_id", *[z[i].alias(f"z_{c}") for i, c in enumerate(_SCALED)]))


@query("pca_variance")
def _(spark, sf):
    """Explained variance of the kept components of the fitted projection."""
    model = segment_model(spark, sf)
    return rounded(spark.createDataFrame([(i + 1, v) for i, v in enumerate(model.explained)], "component int, explained double"))


@query("pca_plane")
def _(spark, sf):
    return rounded(segment_model(spark, sf).assign(stages.panel(spark, sf).drop("segment_id", "segment_name")).select("member_id", "observation_date", "pca_x", "pca_y"))


@query("kmeans_segments")
def _(spark, sf):
    assigned = segment_model(spark, sf).assign(stages.month(stages.panel(spark, sf), MONTHS[3]).drop("segment_id", "segment_name"))
    return rounded(assigned.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_members"), F.avg("segment_confidence").alias("mean_confidence")))


def _points(spark, sf):
    model = segment_model(spark, sf)
    population = segments.fit_population(stages.month(stages.panel(spark, sf), MONTHS[3]))
    return cut_lineage(model.project(population).select("member_id", "point"))


@query("k_sweep")
def _(spark, sf):
    return rounded(segments.sweep_k(_points(spark, sf)))


# Quality measures are compared on the labelled vectors of the embeddings table.
_VECTORS = ("dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), "
            "centre AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY 1, 2), sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), "
            "near AS (SELECT d.vec_id, d.label, sum((x - m) * (x - m)) AS sq FROM dims d JOIN centre c ON c.label = d.label AND c.i = d.i GROUP BY 1, 2), "
            "spread AS (SELECT label, avg(sqrt(sq)) AS s, sum(sq) AS w FROM near GROUP BY 1), "
            "apart AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM centre a JOIN centre b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("point"))


@query("davies_bouldin", f"WITH {_VECTORS} SELECT {r6('avg(worst)', 'davies_bouldin')} FROM (SELECT a.label, max((p.s + q.s) / a.d) AS worst FROM apart a "
       "JOIN spread p ON p.label = a.label JOIN spread q ON q.label = a.other GROUP BY 1)")
def _(spark, sf):
    q = segments.quality(_vectors(spark, sf))
    return rounded(spark.createDataFrame([(q["davies_bouldin"],)], "davies_bouldin double"))


@query("calinski_harabasz", f"WITH {_VECTORS}, grand AS (SELECT i, avg(x) AS g FROM dims GROUP BY 1), "
       "b AS (SELECT sum(s.n * (c.m - g.g) * (c.m - g.g)) AS v FROM centre c JOIN grand g USING (i) JOIN sizes s ON s.label = c.label), "
       f"w AS (SELECT sum(w) AS v, count(*) AS k FROM spread) SELECT {r6('(b.v / (w.k - 1)) / (w.v / ((SELECT count(*) FROM embeddings) - w.k))', 'calinski_harabasz')} FROM b, w")
def _(spark, sf):
    q = segments.quality(_vectors(spark, sf))
    return rounded(spark.createDataFrame([(q["calinski_harabasz"],)], "calinski_harabasz double"))


@query("silhouette", f"WITH {_VECTORS}, norms AS (SELECT vec_id, label, sum(x * x) AS sq FROM dims GROUP BY 1, 2), mean_norm AS (SELECT label, avg(sq) AS q, count(*) AS n FROM norms GROUP BY 1), "
       "dots AS (SELECT d.vec_id, d.label, c.label AS other, sum(d.x * c.m) AS dot FROM dims d JOIN centre c ON c.i = d.i GROUP BY 1, 2, 3), "
       "away AS (SELECT d.vec_id, d.label, d.other, greatest(0, r.sq - 2 * d.dot + q.q) AS d, q.n FROM dots d JOIN norms r USING (vec_id) JOIN mean_norm q ON q.label = d.other), "
       "ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN d * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN d END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM away GROUP BY 1, 2) "
       f"SELECT label AS cluster, count(*) AS n, {r6('avg(CASE WHEN n <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM ab GROUP BY ROLLUP (label)")
def _(spark, sf):
    """Per label and over all rows."""
    return rounded(segments.silhouettes(_vectors(spark, sf)))


@query("frozen_centroid_assignment", f"WITH {_VECTORS}, far AS (SELECT d.vec_id, c.label AS segment_id, sqrt(sum((x - m) * (x - m))) AS d FROM dims d JOIN centre c ON c.i = d.i GROUP BY 1, 2), "
       "two AS (SELECT vec_id, arg_min(segment_id, d) AS segment_id, list_sort(list(d)) AS ds FROM far GROUP BY 1) "
       f"SELECT vec_id, CAST(segment_id AS INTEGER) AS segment_id, {r6('(ds[2] - ds[1]) / (ds[2] + ds[1] + 1e-9)', 'segment_confidence', 4)}, {r6('1 - ds[1] / (ds[2] + 1e-9)', 'assignment_confidence', 4)} FROM two")
def _(spark, sf):
    """Nearest of the frozen label centres with both confidence formulas."""
    vectors = _vectors(spark, sf)
    centres = [list(r.mean_point) for r in segments.cluster_moments(vectors).orderBy("cluster").collect()]
    return rounded(segments.nearest_centroid(vectors, centres).select("vec_id", "segment_id", "segment_confidence", "assignment_confidence"), 4)


_PROFILED = segments.PROFILE_COLUMNS


@query("cluster_profiles", sql_at("SELECT CAST(segment_id AS INTEGER) AS segment_id, count(*) AS size, " + ", ".join(r6(f"avg({c})", c) for c in _PROFILED)
                                  + ", " + r6("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100", "pct_of_total") + " FROM states GROUP BY 1"))
def _(spark, sf):
    return rounded(segments.profile_clusters(stages.observed_panel(spark, sf)))


_NAME = """CASE WHEN recency_days > 60 AND spend_slope_30d < 0 THEN 'Lapse Risk' WHEN recency_days > 30 AND purchase_count_30d < 1 AND spend_slope_30d <= 0 THEN 'Lapse Risk'
 WHEN recency_days > 90 AND purchase_count_30d > 0.5 THEN 'Win-Back Target' WHEN purchase_count_180d < 2 THEN 'New & Uncertain'
 WHEN spend_slope_30d > 10 AND purchase_count_30d >= 5 AND tier_ordinal >= 2 AND spend_total_30d > 400 THEN 'High-Tier Accelerator'
 WHEN spend_slope_30d > 5 AND purchase_count_30d >= 2 AND recency_days < 30 THEN 'Growth Builder' WHEN redemption_rate > 0.3 THEN 'Redemption Hunter'
 WHEN (email_open_30d >= 2 OR app_open_30d >= 3) AND tier_ordinal >= 2 AND category_diversity_90d > 0.4 THEN 'Brand Advocate'
 WHEN category_diversity_90d > 0.5 AND redemption_rate > 0.1 THEN 'Value Maximizer' WHEN purchase_count_30d >= 1 AND app_open_30d < 1 AND email_open_30d < 1 THEN 'Silent Accumulator'
 WHEN hoarding_ratio > 0.4 AND purchase_count_30d < 1 THEN 'Silent Accumulator' WHEN spend_slope_30d > -2 AND spend_slope_30d < 2 AND purchase_count_30d >= 1 THEN 'Plateau Cruiser'
 ELSE 'Program Skeptic' END"""
_ACTION = "CASE segment_name " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, a in segments.SEGMENT_ACTIONS.items()) + " ELSE 'send_generic_nurture' END"


@query("segment_names_and_actions", sql(
    "SELECT segment_id, observation_date, segment_name, action, count(*) OVER (PARTITION BY action) > 1 AS is_duplicate_action FROM "
    f"(SELECT *, {_ACTION} AS action FROM (SELECT segment_id, observation_date, {_NAME} AS segment_name FROM (SELECT CAST(segment_id AS INTEGER) AS segment_id, "
    f"strftime(observation_date, '%Y-%m-%d') AS observation_date, " + ", ".join(f"coalesce(avg({c}), {999 if c == 'recency_days' else 0}) AS {c}" for c in _PROFILED) + " FROM states GROUP BY 1, 2)))"))
def _(spark, sf):
    """Every month's segments, named from their own means."""
    panel = stages.panel(spark, sf).withColumn("_month", F.date_format("observation_date", "yyyy-MM-dd"))
    joint = panel.withColumn("segment_id", F.struct(F.col("segment_id").alias("s"), F.col("_month").alias("m")))
    named = segments.name_segments(segments.profile_clusters(joint))
    return named.select(F.col("segment_id.s").alias("segment_id"), F.col("segment_id.m").alias("observation_date"), "segment_name", "action", "is_duplicate_action")


def _pct(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0) / count({c}) OVER () END"


@query("business_table", sql_at(
    "SELECT CAST(segment_id AS INTEGER) AS segment_id, count(*) AS size, "
    + ", ".join([r6(half_even("avg(spend_total_30d)", 2), "avg_spend_30d"), r6(half_even("avg(purchase_count_30d)", 2), "avg_purchases_30d"), r6(half_even("avg(recency_days)", 2), "avg_recency_days"),
                 r6(half_even("avg(redemption_rate)", 4), "avg_redemption_rate"), r6(half_even("median(app_open_30d)", 3), "avg_app_opens_30d"),
                 r6(half_even("avg(CAST(tier_ordinal >= 2 AS INTEGER)) * 100", 2), "pct_gold_platinum"), r6(half_even("avg(spend_slope_30d)", 3), "avg_spend_slope"),
                 r6(half_even("avg(r) * 0.4e0 + (1 - avg(f)) * 0.4e0 + (1 - avg(a)) * 0.2e0", 3), "churn_risk_0_to_1")])
    + f" FROM (SELECT *, {_pct('recency_days')} AS r, {_pct('purchase_count_30d')} AS f, {_pct('app_open_30d')} AS a FROM states) GROUP BY 1"))
def _(spark, sf):
    """A segment in which nobody ever bought has no recency rank and so a null risk."""
    return rounded(segments.business_table(stages.observed_panel(spark, sf)))


@query("dominant_features")
def _(spark, sf):
    found = segment_model(spark, sf).dominant_features()
    return spark.createDataFrame([(i, p + 1, f) for i, names in enumerate(found) for p, f in enumerate(names)], "segment_id int, rank int, feature string")


@query("monthly_segment_scoring")
def _(spark, sf):
    """All months under the frozen model; `is_frozen` says that the model that scored is the one that was fitted, by its identity."""
    model = segment_model(spark, sf)
    out = segments.score_months(stages.panel(spark, sf).drop("segment_id", "segment_name"), model)
    return rounded(out.withColumn("is_frozen", F.col("model_id") == model.identity()).drop("model_id"))


_HEAVY = ("spend_total_30d", "spend_total_90d", "purchase_count_30d", "recency_days", "app_open_30d", "total_session_sec_30d", "spend_slope_30d")


@query("heavy_tailed_log_scaling", sql_at(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg(CASE WHEN heavy THEN ln(1 + v) ELSE v END)', 'mean_scaled')}, bool_or(heavy) AS is_heavy FROM (SELECT coalesce(CAST({c} AS DOUBLE), 0) AS v, "
    f"min(coalesce({c}, 0)) OVER () >= 0 AND avg(coalesce({c}, 0)) OVER () > 1.5 * median(coalesce({c}, 0)) OVER () AND avg(coalesce({c}, 0)) OVER () > 0 AS heavy FROM features)" for c in _HEAVY)))
def _(spark, sf):
    panel = stages.observed_panel(spark, sf)
    heavy = segments.heavy_tailed(panel, _HEAVY)
    scaled = segments.log_scaled(panel.na.fill(0, list(_HEAVY)), heavy)
    means = scaled.agg(*[F.avg(F.col(c)).alias(c) for c in _HEAVY])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_scaled"), F.lit(c in heavy).alias("is_heavy")) for c in _HEAVY])
    return rounded(means.select(F.explode(rows).alias("r")).select("r.*"))


@query("robust_scaling", sql_at(
    "SELECT member_id, " + ", ".join(
        r6(f"(coalesce(CAST({c} AS DOUBLE), 0) - (SELECT median(coalesce({c}, 0)) FROM features)) / (SELECT coalesce(nullif(quantile_cont(coalesce({c}, 0), 0.75) - quantile_cont(coalesce({c}, 0), 0.25), 0), 1) FROM features)", c)
        for c in _SCALED) + " FROM features"))
def _(spark, sf):
    return rounded(segments.robust_scaled(stages.observed_panel(spark, sf), _SCALED).select("member_id", *_SCALED))


@query("config_sweep")
def _(spark, sf):
    population = segments.fit_population(stages.month(stages.panel(spark, sf), MONTHS[3]))
    return rounded(segments.config_sweep(population, fit_columns(population)))


_PAIR = "SELECT a.segment_id AS x, b.segment_id AS y FROM states a JOIN states b ON a.member_id = b.member_id AND b.observation_date = a.observation_date + INTERVAL 1 MONTH"


@query("adjusted_rand_index", sql(
    f"SELECT {r6('(s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))', 'ari')}, {big('n', 'n_shared')} FROM "
    "(SELECT sum(n * (n - 1) / 2e0) AS s, CAST(sum(n) AS DOUBLE) AS n, (SELECT sum(n * (n - 1) / 2e0) FROM (SELECT count(*) AS n FROM two GROUP BY x)) AS sa, "
    "(SELECT sum(n * (n - 1) / 2e0) FROM (SELECT count(*) AS n FROM two GROUP BY y)) AS sb FROM (SELECT x, y, count(*) AS n FROM two GROUP BY 1, 2))", two=_PAIR))
def _(spark, sf):
    """Agreement of each month's segments with the following month's."""
    panel = stages.panel(spark, sf)
    two = panel.withColumn("next", features.next_value(F.col("segment_id"))).where(F.col("next").isNotNull())
    return rounded(segments.adjusted_rand_index(two, "segment_id", "next"))


@query("segment_stability")
def _(spark, sf):
    panel = stages.panel(spark, sf)
    runs = segments.stability(panel, fit_columns(panel), MONTHS[3])
    return rounded(segments.stability_summary(runs))
