"""Rules: what they look like, where they come from, how to pick among them."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)

ERROR_TYPES = ("out_of_range", "format_inconsistency", "temporal_violation", "cross_column_inconsistency")
SEVERITIES = ("critical", "warning", "info")

RULE_SCHEMA = ("rule_id string, error_type string, description string, target_columns array<string>, "
               "validation_tool string, params string, severity string, enabled boolean")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    error_type: str
    target_columns: tuple[str, ...]
    validation_tool: str
    params: dict = field(default_factory=dict)
    severity: str = "warning"
    enabled: bool = True
    description: str = ""

    @staticmethod
    def of(raw: dict) -> "Rule":
        known = {k: raw[k] for k in Rule.__dataclass_fields__ if k in raw}
        if known.get("error_type") not in ERROR_TYPES:
            raise ValueError(f"rule {raw.get('rule_id')!r}: unknown error_type {known.get('error_type')!r}")
        known["target_columns"] = tuple(known.get("target_columns") or ())
        params = known.get("params") or {}
        known["params"] = json.loads(params) if isinstance(params, str) else dict(params)
        return Rule(**known)


# The nine rules used when no rule file is given (ids, bounds, patterns, value
# lists, severities and the reasons shown to reviewers).
DEFAULT_RULES = (
    Rule("R001-road_addr_yn_enum", "out_of_range", ("road_addr_yn",), "range_check",
         {"allowed_values": [0, 1]}, "critical"),
    Rule("R001-status_code_enum", "out_of_range", ("status_code",), "range_check",
         {"allowed_values": ["PICKUP", "IN_TRANSIT", "OUT_FOR_DELIVERY", "DELIVERED", "RETURNED"]}, "critical"),
    Rule("R001-weight_kg_range", "out_of_range", ("weight_kg",), "range_check",
         {"min_value": 0.01, "max_value": 30.0}, "critical"),
    Rule("R002-time_format_hhmmss", "format_inconsistency", ("dispatch_time", "arrival_time"), "regex_validate",
         {"pattern": r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$"}, "warning"),
    Rule("R002-tracking_id_format", "format_inconsistency", ("tracking_id",), "regex_validate",
         {"pattern": r"^\d{10,15}$"}, "critical"),
    Rule("R002-phone_format", "format_inconsistency", ("sender_phone", "receiver_phone"), "regex_validate",
         {"pattern": r"^0\d{1,2}-\d{3,4}-\d{4}$"}, "warning"),
    Rule("R003-dispatch_before_arrival", "temporal_violation", ("dispatch_time", "arrival_time"),
         "timestamp_compare", {"earlier_column": "dispatch_time", "later_column": "arrival_time"}, "critical"),
    Rule("R004-address_road_yn_match", "cross_column_inconsistency", ("address", "road_addr_yn"),
         "address_classify", {}, "warning"),
    Rule("R004-cod_payment_consistency", "cross_column_inconsistency", ("payment_method", "cod_amount"),
         "value_condition",
         {"conditions": [
             {"when_column": "payment_method", "when_values": ["착불"],
              "check_column": "cod_amount", "check_op": "gt", "check_value": 0,
              "reason": "착불 결제인데 착불 금액(cod_amount)이 0원"},
             {"when_column": "payment_method", "when_values": ["선불", "신용카드", "계좌이체"],
              "check_column": "cod_amount", "check_op": "eq", "check_value": 0,
              "reason": "선불/카드/이체 결제인데 착불 금액(cod_amount)이 존재"}]}, "critical"),
)

# What the extended delivery rule set adds to, or changes in, the default one.
DELIVERY_RULES = (
    *DEFAULT_RULES[:2],
    Rule("R001-weight_range", "out_of_range", ("weight_kg",), "range_check",
         {"min_value": 0.01, "max_value": 30.0}, "warning"),
    Rule("R001-fee_amount_range", "out_of_range", ("fee_amount",), "range_check",
         {"min_value": 0, "max_value": 100000}, "warning"),
    *DEFAULT_RULES[3:6],
    Rule("R002-date_format_yyyymmdd", "format_inconsistency", ("dispatch_date", "arrival_date"), "regex_validate",
         {"pattern": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"}, "warning"),
    Rule("R002-zipcode_format", "format_inconsistency", ("sender_zipcode", "receiver_zipcode"), "regex_validate",
         {"pattern": r"^\d{5}$"}, "warning"),
    DEFAULT_RULES[6],
    Rule("R003-dispatch_date_before_arrival_date", "temporal_violation", ("dispatch_date", "arrival_date"),
         "timestamp_compare", {"earlier_column": "dispatch_date", "later_column": "arrival_date"}, "critical"),
    Rule("R003-order_before_dispatch", "temporal_violation", ("order_datetime", "dispatch_time"),
         "timestamp_compare", {"earlier_column": "order_datetime", "later_column": "dispatch_time"}, "warning"),
    *DEFAULT_RULES[7:],
)


def parse_rules(text: str) -> list[Rule]:
    """Rules from YAML or JSON text with a top-level ``rules`` list."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml  # only YAML files need it

        data = yaml.safe_load(text)
    if not isinstance(data, dict) or "rules" not in data:
        raise ValueError("rule file has no top-level 'rules' list")
    return [Rule.of(raw) for raw in data["rules"]]


def load_rules(spark: SparkSession, path: str | None = None, default_if_missing: bool = False) -> list[Rule]:
    """Rules from a file on any filesystem Spark can read; the default set without a path.

    A file that cannot be read or parsed is an error. Only a missing one gives the default set, and only if asked.
    """
    if path is None:
        return list(DEFAULT_RULES)
    try:
        text = spark.read.text(path, wholetext=True).head()
    except AnalysisException as e:
        if default_if_missing and e.getCondition() == "PATH_NOT_FOUND":
            log.warning("no rule file %s, using the default set", path)
            return list(DEFAULT_RULES)
        raise
    return parse_rules(text[0] if text else "")


def number_generated(raw_rules: list[dict]) -> list[Rule]:
    """Proposed rules made usable: always enabled, with ids AUTO-... that no two rules share.

    A given id of that form is kept by its first holder; all others get the first free number from their position on.
    """
    given = [raw.get("rule_id") or "" for raw in raw_rules]
    taken, out = {g for g in given if g.startswith("AUTO-")}, []
    first_holder = {g: given.index(g) for g in taken}
    for place, raw in enumerate(raw_rules):
        rule_id, number = given[place], place + 1
        if first_holder.get(rule_id) != place:
            while f"AUTO-{number:03d}" in taken:
                number += 1
            rule_id = f"AUTO-{number:03d}"
            taken.add(rule_id)
        out.append(Rule.of({**raw, "rule_id": rule_id, "enabled": True, "severity": raw.get("severity") or "warning"}))
    return out


def rules_df(spark: SparkSession, rules) -> DataFrame:
    rows = [{**asdict(r), "target_columns": list(r.target_columns),
             "params": json.dumps(r.params, ensure_ascii=False)} for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_df(df: DataFrame, generated: bool = False) -> list[Rule]:
    """Rules held in a table, however many: each becomes expressions of one plan."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return number_generated(rows) if generated else [Rule.of(r) for r in rows]


# --- picking ---------------------------------------------------------------

def enabled(rules) -> list[Rule]:
    return [r for r in rules if r.enabled]


def by_error_type(rules, error_type: str) -> list[Rule]:
    return [r for r in enabled(rules) if r.error_type == error_type]


def by_column(rules, column: str) -> list[Rule]:
    return [r for r in enabled(rules) if column in r.target_columns]


def by_tool(rules, tool: str) -> list[Rule]:
    return [r for r in enabled(rules) if r.validation_tool == tool]


def with_severity(rules, severity: str) -> list[Rule]:
    return [replace(r, severity=severity) for r in rules]


def relations(rules) -> list[dict]:
    """Column pairs that the rules relate: time order, and meaning across columns."""
    out = []
    for r in rules:
        if len(r.target_columns) < 2:
            continue
        first, second = r.target_columns[:2]
        if r.validation_tool == "timestamp_compare":
            out.append({"kind": "temporal", "source_column": first, "target_column": second,
                        "relation_type": "earlier_than", "rule_id": r.rule_id, "description": r.description})
        if r.error_type == "cross_column_inconsistency":
            out.append({"kind": "cross_column", "source_column": first, "target_column": second,
                        "relation_type": r.params.get("relation_type", "semantic"),
                        "rule_id": r.rule_id, "description": r.description})
    return out


def merge_rules(existing: DataFrame, new: DataFrame, generated_at) -> DataFrame:
    """Add the rules whose id is not registered yet, stamped with the time they came in.

    Repeats inside ``new`` collapse to one row (min_by: combined map-side, no hot task).
    """
    cols = [c for c in existing.columns if c != "_generated_at"]
    payload = F.struct(*[F.col(c) for c in cols])
    first = (new.select(*cols).groupBy(F.col("rule_id").alias("_id"))
             .agg(F.min(F.struct(F.to_json(payload).alias("_order"), payload.alias("rule"))).alias("m"))
             .select("m.rule.*"))
    fresh = first.join(existing.select("rule_id"), "rule_id", "left_anti").withColumn(
        "_generated_at", F.lit(generated_at).cast("timestamp"))
    if "_generated_at" not in existing.columns:
        existing = existing.withColumn("_generated_at", F.lit(None).cast("timestamp"))
    return existing.unionByName(fresh)
