"""Member, transaction, event and score views on the given tables.

The tables hold none of the dirt the operators deal with, so the views add it
from key arithmetic: mixed date layouts, case and space variants, duplicates,
unknown ids, activity before enrolment, missing consent, unreadable JSON. Every
view reads its whole table. Each column is one expression that both engines
understand; the few functions with different names come from `Dialect`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from memberlens.session import configure
from memberlens.sources.tables import scan_parquet

OBSERVED = "2024-01-31"
MONTHS = ("2023-08-01", "2023-09-01", "2023-10-01", "2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01")
N_CLASSES = 5

# order dates end here; they are moved to OBSERVED and condensed 8 : 1
_LAST_ORDER_MS = 996624000000  # 2001-08-01
_OBSERVED_MS = 1706659200000  # 2024-01-31
_FIRST_OPEN_MS = 1498867200000  # 2017-07-01


@dataclass(frozen=True)
class Dialect:
    name: str

    def from_ms(self, x: str) -> str:
        return f"timestamp_millis({x})" if self.name == "spark" else f"epoch_ms({x})"

    def to_ms(self, x: str) -> str:
        return f"unix_millis({x})" if self.name == "spark" else f"(epoch_us({x}) // 1000)"

    def text(self, x: str, day_first: bool = False, time: bool = True) -> str:
        if self.name == "spark":
            pattern = ("dd/MM/yyyy" if day_first else "yyyy-MM-dd") + (" HH:mm:ss" if time else "")
            return f"date_format({x}, '{pattern}')"
        pattern = ("%d/%m/%Y" if day_first else "%Y-%m-%d") + (" %H:%M:%S" if time else "")
        return f"strftime({x}, '{pattern}')"

    def mixed(self, x: str, key: str) -> str:
        return (f"CASE {key} % 13 WHEN 1 THEN {self.text(x, True)} WHEN 2 THEN {self.text(x, False, False)} "
                f"WHEN 3 THEN {self.text(x, True, False)} ELSE {self.text(x)} END")

    def list_of(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def json_field(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')" if self.name == "spark" else f"json_extract_string({x}, '$.{field}')"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _id(key: str) -> str:
    return f"concat('MBR_', lpad(cast({key} AS string), 7, '0'))"


def members(d: Dialect) -> dict[str, str]:
    k = "c_custkey"
    opened = d.from_ms(f"{_FIRST_OPEN_MS} + (({k} * 37) % 2400) * 86400000 + ({k} % 24) * 3600000")
    entry = "concat('{\"tier\": \"', {tier}, '\", \"date\": \"', {date}, '\"}')".replace("{\"tier", "{{\"tier").replace("\"}')", "\"}}')")

    def item(tier: str, date: str) -> str:
        return entry.format(tier=tier, date=date)

    first = item("'base'", "'2019-01-15'")
    second = item(f"CASE {k} % 3 WHEN 0 THEN 'Silver' WHEN 1 THEN 'gold' ELSE 'PLATINUM' END", f"concat('2021-06-', lpad(cast({k} % 28 + 1 AS string), 2, '0'))")
    third = item(f"CASE {k} % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'platinum' END",
                 f"concat('2023-', lpad(cast({k} % 12 + 1 AS string), 2, '0'), '-10')")
    fourth = item("'platinum'", f"concat('2024-01-', lpad(cast({k} % 31 + 1 AS string), 2, '0'))")
    history = (f"CASE {k} % 10 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '[{{\"tier\": \"gold\"' "
               f"WHEN 3 THEN concat('[', {first}, ']') WHEN 4 THEN concat('[', {first}, ', ', {second}, ']') "
               f"WHEN 5 THEN concat('[', {first}, ', ', {second}, ', ', {third}, ']') "
               f"WHEN 6 THEN concat('[', {third}, ', ', {first}, ']') "
               f"WHEN 7 THEN concat('[', {fourth}, ']') "
               f"ELSE concat('[', {first}, ', ', {second}, ', ', {third}, ', ', {fourth}, ']') END")
    return {
        "member_id": f"CASE WHEN {k} % 500 = 499 THEN concat('MBR_GHOST_', cast({k} AS string)) ELSE {_id(k)} END",
        "account_open_date": opened,
        "account_status": f"CASE WHEN {k} % 50 = 0 THEN ' Closed' WHEN {k} % 40 = 1 THEN 'DORMANT' ELSE 'active' END",
        "fraud_flag": f"CASE WHEN {k} % 7 = 0 THEN NULL ELSE {k} % 200 = 3 END",
        "opt_in_email": f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {k} % 4 <> 0 END",
        "opt_in_push": f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {k} % 3 <> 0 END",
        "opt_in_sms": f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {k} % 5 = 0 END",
        "credit_line": "CASE WHEN c_acctbal > 5000 THEN c_acctbal ELSE NULL END",
        "tier_history": history,
    }


def transactions(d: Dialect) -> dict[str, str]:
    k = "o_orderkey"
    ago = f"cast(floor(({_LAST_ORDER_MS} - {d.to_ms('o_orderdate')}) / 8e3) AS bigint) * 1000"
    moment = d.from_ms(f"{_OBSERVED_MS} - {ago} + ({k} * 7919 % 43200) * 1000")
    is_return = f"(o_orderstatus = 'P' AND {k} % 5 = 0)"
    kind = f"CASE WHEN {is_return} THEN 'return' WHEN {k} % 50 = 7 THEN 'exchange' ELSE 'purchase' END"
    owner = (f"CASE WHEN {k} % 194 = 0 THEN concat('MBR_GHOST_', cast(o_custkey AS string)) "
             f"WHEN {k} % 97 = 0 OR o_custkey % 100 = 77 THEN {_id('(o_custkey + 1000000)')} ELSE {_id('o_custkey')} END")
    return {
        "transaction_id": f"concat('T', cast({k} AS string))",
        "member_id": owner,
        "transaction_date": d.mixed(moment, k),
        "transaction_amount": f"CASE WHEN {is_return} THEN -floor(o_totalprice / 10) / 100 ELSE floor(o_totalprice / 10) / 100 END",
        "transaction_type": f"CASE {k} % 4 WHEN 0 THEN upper({kind}) WHEN 1 THEN concat(' ', {kind}) ELSE {kind} END",
        "channel": "o_orderpriority",
        "merchant_category": f"CASE WHEN {k} % 2 = 0 THEN concat('C', cast({k} % 7 AS string), ' ') ELSE concat('c', cast({k} % 7 AS string)) END",
        "merchant_subcategory": f"concat('S', cast({k} % 23 AS string))",
        "merchant_brand": f"concat('Brand ', cast({k} % 41 AS string))",
        "points_earned": "cast(floor(o_totalprice / 10000) AS bigint)",
        "points_clawed_back": f"CASE WHEN {k} % 3 = 0 THEN cast(floor(o_totalprice / 20000) AS bigint) ELSE cast(0 AS bigint) END",
    }


_KINDS = {
    "view": ("app_open", "reward_browse", "point_balance_check"),
    "click": ("email_open", "email_click", "push_open"),
    "signup": ("profile_update", "survey_completed", "tier_status_check"),
    "purchase": ("reward_redemption", "social_share", "referral_sent"),
    "error": ("support_contact", "push_dismiss", "support_contact"),
}


def engagement(d: Dialect, copy: bool = False) -> dict[str, str]:
    """Events stretched over seven months. Every 50th event occurs a second time with another duration."""
    k = "event_id"
    moment = d.from_ms(f"{d.to_ms('ts')} - ({k} % 7) * 2592000000")
    kind = "CASE " + " ".join(
        f"WHEN event_type = '{source}' AND {k} % 3 = {i} THEN '{target}'" for source, targets in _KINDS.items() for i, target in enumerate(targets)
    ) + " END"
    field = f"cast({d.json_field('props', 'k')} AS bigint)"
    return {
        "member_id": f"CASE WHEN {k} % 89 = 0 OR user_id % 100 = 77 THEN {_id('(user_id + 1000000)')} ELSE {_id('user_id')} END",
        "event_date": d.mixed(moment, k),
        "event_type": f"CASE {k} % 17 WHEN 0 THEN upper({kind}) WHEN 1 THEN concat({kind}, ' ') ELSE {kind} END",
        "event_channel": f"CASE {k} % 3 WHEN 0 THEN 'App' WHEN 1 THEN 'web ' ELSE NULL END",
        "session_duration_sec": f"CASE WHEN {k} % 10 = 4 THEN NULL ELSE value * 600 {'+ 30' if copy else ''} END",
        "campaign_id": f"CASE WHEN {field} % 3 = 0 THEN NULL ELSE concat('K', cast({field} AS string)) END",
        "campaign_response": f"CASE {field} % 4 WHEN 0 THEN 'Opened' WHEN 1 THEN 'clicked ' WHEN 2 THEN 'sent' ELSE 'none' END",
        "event_no": f"{k} + 100000000" if copy else k,
    }


_KEY = "(l_orderkey * 8 + l_linenumber)"


def _weight(j: int) -> str:
    return f"(1e0 + ({_KEY} * {7 * j + 3}) % 97 + CASE WHEN {_KEY} % 5 = {j} THEN 100 ELSE 0 END)"


def scores(d: Dialect) -> dict[str, str]:
    """Scored rows: five class probabilities, current and next segment, spend."""
    total = "(" + " + ".join(_weight(j) for j in range(N_CLASSES)) + ")"
    return {
        "member_id": f"concat('L', cast({_KEY} AS string))",
        "seg_curr": f"cast({_KEY} % 5 AS int)",
        "seg_next": f"cast(CASE WHEN {_KEY} % 10 < 6 THEN {_KEY} % 5 ELSE cast(floor({_KEY} / 1e1) AS bigint) % 5 END AS int)",
        "proba": d.list_of(*[f"{_weight(j)} / {total}" for j in range(N_CLASSES)]),
        "spend_total_180d": f"l_extendedprice / 100 * ({_KEY} % 5 + 1)",
        "state_no": f"cast({_KEY} % 11 AS int)",
        "split": "CASE WHEN l_orderkey % 2 = 0 THEN 'validation' ELSE 'test' END",
    }


# Segment of a member-month by fixed spend limits: a stand-in for a fitted model
# wherever a query is compared with SQL.
SEGMENT_RULE = ("CASE WHEN spend_total_90d > 900 THEN 0 WHEN spend_total_90d > 500 THEN 1 WHEN spend_total_90d > 0 THEN 2 "
                "WHEN recency_days IS NOT NULL THEN 3 ELSE 4 END")
SEGMENT_NAMES = ("High-Tier Accelerator", "Growth Builder", "Silent Accumulator", "Plateau Cruiser", "Program Skeptic")


# --- Spark side -----------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "customer"), members(SPARK))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), transactions(SPARK))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _select(events, engagement(SPARK)).union(_select(events.where("event_id % 50 = 0"), engagement(SPARK, copy=True)))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), scores(SPARK))


# --- DuckDB side ------------------------------------------------------------------------------

def _sql(source: str, columns: dict[str, str], where: str = "") -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")


RAW_CTES = {
    "raw_members": _sql("customer", members(DUCK)),
    "raw_transactions": _sql("orders", transactions(DUCK)),
    "raw_events": _sql("events", engagement(DUCK)) + " UNION ALL " + _sql("events", engagement(DUCK, copy=True), "event_id % 50 = 0"),
    "scored": _sql("lineitem", scores(DUCK)),
}
