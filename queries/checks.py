"""Rule checks and the suspects they find."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from tamis.functions import address_kind, mask_prefix, pattern_key, record_key_json
from tamis.operators import suspects as sus
from tamis.operators.profile import condition_counts
from tamis.plans import DEFAULT_RULES, Rule, load_rules, relations, rules_df, rules_from_df
from tamis.plans.rules import by_column, by_tool, enabled
from tamis.session import fresh_path

from .base import FORMATS, TIME_OK, flat, parcel, query, sql, suspects, table

SUSPECT = "record_id, rule_id, error_type, target_columns, current_values, reason, severity"


def only(prefix):
    return [r for r in DEFAULT_RULES if r.rule_id.startswith(prefix)]


@query("suspects_all", sql(f"SELECT {SUSPECT} FROM every", "every"))
def suspects_all(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), DEFAULT_RULES))


@query("suspects_dedup", sql(f"SELECT {SUSPECT} FROM s", "s"))
def suspects_dedup(spark, sf):
    return flat(suspects(spark, sf))


LINE_RULES = [
    Rule("L-quantity", "out_of_range", ("l_quantity",), "range_check", {"min_value": 2, "max_value": 48}),
    Rule("L-money", "out_of_range", ("l_discount", "l_tax"), "range_check", {"max_value": 0.07}, "critical"),
    Rule("L-flag", "out_of_range", ("l_returnflag",), "range_check", {"allowed_values": ["A", "N"]}, "info"),
    Rule("L-when", "cross_column_inconsistency", ("l_linestatus", "l_tax"), "value_condition",
         {"conditions": [{"when_column": "l_linestatus", "when_values": ["F"], "check_column": "l_tax",
                          "check_op": "gt", "check_value": 0, "reason": "closed line without tax"}]}),
]
_LINES = """
SELECT cast(l_orderkey AS varchar) AS record_id, 'L-quantity' AS rule_id, 'l_quantity' AS target_columns,
  'l_quantity=' || cast(l_quantity AS varchar) AS current_values FROM lineitem WHERE l_quantity < 2 OR l_quantity > 48
UNION ALL SELECT cast(l_orderkey AS varchar), 'L-money', 'l_discount', 'l_discount=' || cast(l_discount AS varchar)
  FROM lineitem WHERE l_discount > 0.07
UNION ALL SELECT cast(l_orderkey AS varchar), 'L-money', 'l_tax', 'l_tax=' || cast(l_tax AS varchar)
  FROM lineitem WHERE l_tax > 0.07 AND NOT (l_discount > 0.07)
UNION ALL SELECT cast(l_orderkey AS varchar), 'L-flag', 'l_returnflag', 'l_returnflag=' || l_returnflag
  FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT cast(l_orderkey AS varchar), 'L-when', 'l_linestatus,l_tax',
  'l_linestatus=' || l_linestatus || '|l_tax=' || cast(l_tax AS varchar)
  FROM lineitem WHERE l_linestatus = 'F' AND NOT l_tax > 0
"""


@query("suspects_dedup_repeated", f"""
WITH e AS ({_LINES}) SELECT record_id, rule_id, min(target_columns) AS target_columns FROM e GROUP BY record_id, rule_id""")
def suspects_dedup_repeated(spark, sf):
    """Order keys repeat over the lines of an order: one suspect per (order, rule)."""
    found = sus.find_first_suspects(table(spark, sf, "lineitem"), LINE_RULES, "l_orderkey", unique_key=False)
    return flat(found).select("record_id", "rule_id", "target_columns")


@query("suspects_lineitem", f"""
WITH e AS ({_LINES}) SELECT rule_id, target_columns, count(*) AS n, count(DISTINCT record_id) AS records
FROM e GROUP BY rule_id, target_columns""")
def suspects_lineitem(spark, sf):
    found = flat(sus.find_first_suspects(table(spark, sf, "lineitem"), LINE_RULES, "l_orderkey"))
    return found.groupBy("rule_id", "target_columns").agg(
        F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


# --- one family at a time ------------------------------------------------------

@query("check_regex", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id = 'R002-tracking_id_format'", "every"))
def check_regex(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R002-tracking")))


@query("check_enum", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id IN "
                         "('R001-road_addr_yn_enum', 'R001-status_code_enum')", "every"))
def check_enum(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R001-road") + only("R001-status")))


@query("check_range", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id = 'R001-weight_kg_range'", "every"))
def check_range(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R001-weight")))


@query("check_not_null", sql("""
SELECT record_id, 'N-tracking' AS rule_id, 'tracking_id=null' AS current_values FROM p WHERE tracking_id IS NULL
UNION ALL SELECT record_id, 'N-weight', 'weight_kg=null' FROM p WHERE weight_kg IS NULL""", "p"))
def check_not_null(spark, sf):
    rules = [Rule("N-tracking", "format_inconsistency", ("tracking_id",), "regex_validate",
                  {"pattern": ".*", "nullable": False}),
             Rule("N-weight", "out_of_range", ("weight_kg",), "range_check", {"min_value": 0, "nullable": False})]
    return flat(sus.find_suspects(parcel(spark, sf), rules)).select("record_id", "rule_id", "current_values")


@query("check_temporal", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id = 'R003-dispatch_before_arrival'", "every"))
def check_temporal(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R003")))


@query("check_temporal_dates", """
SELECT cast(l_orderkey AS varchar) AS record_id, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= l_shipdate""")
def check_temporal_dates(spark, sf):
    """Typed time columns: an order must come before its shipping."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    rule = Rule("T-ship", "temporal_violation", ("o_orderdate", "l_shipdate"), "timestamp_compare")
    return sus.find_suspects(rows, [rule], "l_orderkey", carry=["l_linenumber", "l_partkey"]).select(
        "record_id", "l_linenumber", "l_partkey")


@query("parse_failures", sql(f"""
SELECT record_id, 'R003-dispatch_before_arrival' AS rule_id,
  CASE WHEN d IS NULL THEN 'dispatch_time' ELSE 'arrival_time' END AS column_name,
  CASE WHEN d IS NULL THEN dispatch_time ELSE arrival_time END AS "value", 'Failed to parse timestamp' AS error
FROM (SELECT *, try_strptime(dispatch_time, {FORMATS}) AS d, try_strptime(arrival_time, {FORMATS}) AS a FROM p)
WHERE dispatch_time IS NOT NULL AND arrival_time IS NOT NULL AND (d IS NULL OR a IS NULL)""", "p"))
def parse_failures(spark, sf):
    return sus.parse_failures(parcel(spark, sf), DEFAULT_RULES)


@query("classify_address", sql("SELECT record_id, kind FROM p", "p"))
def classify_address(spark, sf):
    return parcel(spark, sf).select("record_id", address_kind(F.coalesce("address", F.lit("None"))).alias("kind"))


@query("check_address_flag", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id = 'R004-address_road_yn_match'", "every"))
def check_address_flag(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R004-address")))


@query("check_conditional", sql(f"SELECT {SUSPECT} FROM every WHERE rule_id = 'R004-cod_payment_consistency'", "every"))
def check_conditional(spark, sf):
    return flat(sus.find_suspects(parcel(spark, sf), only("R004-cod")))


@query("check_columns_differ", sql("""
SELECT record_id, 'AUTO-001' AS rule_id, 'receiver_name=' || receiver_name || '|sender_name=' || sender_name
AS current_values FROM p WHERE sender_name = receiver_name""", "p"))
def check_columns_differ(spark, sf):
    rule = Rule("AUTO-001", "cross_column_inconsistency", ("sender_name", "receiver_name"), "custom_check",
                {"check_type": "equality", "should_differ": True})
    return flat(sus.find_suspects(parcel(spark, sf), [rule])).select("record_id", "rule_id", "current_values")


@query("check_custom", sql("""
SELECT record_id, 'X-heavy' AS rule_id, 'status_code=' || status_code || '|weight_kg=' || cast(weight_kg AS varchar) AS current_values,
  'weight_kg > 20 AND status_code == ''LOST''' AS reason FROM p WHERE weight_kg > 20 AND status_code = 'LOST'
UNION ALL SELECT record_id, 'X-same', 'sender_phone=' || sender_phone || '|tracking_id=' || tracking_id, 'ends alike' FROM p
  WHERE right(sender_phone, 2) = right(tracking_id, 2)
UNION ALL SELECT record_id, 'X-place', 'address=' || address || '|status_code=' || status_code, 'delivered outside Seoul' FROM p
  WHERE status_code = 'DELIVERED' AND NOT contains(address, '서울')
UNION ALL SELECT record_id, 'X-number', 'table_name=' || table_name || '|tracking_id=' || tracking_id, 'number without record' FROM p
  WHERE table_name = 'parcels' AND NOT contains(tracking_id, record_id)""", "p"))
def check_custom(spark, sf):
    """Conditions as text, a function of columns, and values that must lie within others."""
    def alike(t):
        return F.right(t.text("sender_phone"), F.lit(2)) == F.right(t.text("tracking_id"), F.lit(2))

    def within(rule_id, when, value, column, op, wanted, reason):
        return Rule(rule_id, "cross_column_inconsistency", (when, column), "value_condition", {"conditions": [
            {"when_column": when, "when_values": [value], "check_column": column, "check_op": op, "check_value": wanted, "reason": reason}]})

    cross = "cross_column_inconsistency"
    rules = [Rule("X-heavy", cross, ("weight_kg", "status_code"), "custom_check", {"condition": "weight_kg > 20 AND status_code == 'LOST'"}),
             Rule("X-same", cross, ("sender_phone", "tracking_id"), "custom_check", {"predicate": alike, "reason": "ends alike"}),
             within("X-place", "status_code", "DELIVERED", "address", "contains", "서울", "delivered outside Seoul"),
             within("X-number", "table_name", "parcels", "tracking_id", "contains_column", "record_id", "number without record")]
    return flat(sus.find_suspects(parcel(spark, sf), rules)).select("record_id", "rule_id", "current_values", "reason")


@query("rules_from_file", sql("SELECT rule_id, severity, count(*) AS n FROM s GROUP BY rule_id, severity", "s"))
def rules_from_file(spark, sf):
    """The rules written to a file in the shared folder, loaded from there and run."""
    path = fresh_path(spark, "rules")
    text = json.dumps({"rules": [{**asdict(r), "target_columns": list(r.target_columns)} for r in DEFAULT_RULES]}, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    found = sus.find_first_suspects(parcel(spark, sf), load_rules(spark, path))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


TARGETS = [
    {"condition": "payment_method == '착불' AND cod_amount == 0", "columns": ["payment_method", "cod_amount"],
     "description": "collect on delivery, nothing to collect"},
    {"condition": "sender_name == receiver_name", "columns": ["sender_name", "receiver_name"]},
    {"condition": "weight_kg > 20 AND status_code == 'LOST'", "columns": ["weight_kg", "status_code"]},
    {"condition": "tracking_id == None OR weight_kg == None", "columns": ["tracking_id", "weight_kg"]},
    {"condition": "status_code in ['LOST', 'RETURNED'] and not road_addr_yn == 1",
     "columns": ["status_code", "road_addr_yn"]},
    {"condition": "status_code > 3", "columns": ["status_code"]},
]


@query("condition_counts", sql("""
SELECT condition, match_count FROM (SELECT
  count(*) FILTER (payment_method = '착불' AND cod_amount = 0) AS c0,
  count(*) FILTER (sender_name IS NOT DISTINCT FROM receiver_name) AS c1,
  count(*) FILTER (weight_kg > 20 AND status_code = 'LOST') AS c2,
  count(*) FILTER (tracking_id IS NULL OR weight_kg IS NULL) AS c3,
  count(*) FILTER (status_code IN ('LOST', 'RETURNED') AND road_addr_yn <> 1) AS c4 FROM p),
LATERAL (VALUES ('payment_method == ''착불'' AND cod_amount == 0', c0), ('sender_name == receiver_name', c1),
  ('weight_kg > 20 AND status_code == ''LOST''', c2), ('tracking_id == None OR weight_kg == None', c3),
  ('status_code in [''LOST'', ''RETURNED''] and not road_addr_yn == 1', c4), ('status_code > 3', 0)
) AS t(condition, match_count)""", "p"))
def conditions(spark, sf):
    return condition_counts(parcel(spark, sf), TARGETS).select("condition", "match_count")


@query("generated_rules", sql("""
SELECT rule_id, count(*) AS n FROM (
SELECT 'AUTO-' || lpad(cast(no AS varchar), 3, '0') AS rule_id
FROM p JOIN (SELECT status_code, cast(floor(avg(weight_kg)) AS bigint) AS top,
  row_number() OVER (ORDER BY status_code) AS no FROM p GROUP BY status_code) g USING (status_code)
WHERE NOT coalesce(weight_kg <= top, false)) GROUP BY rule_id""", "p"))
def generated_rules(spark, sf):
    """Rules proposed from the data (one per status), then run like any other."""
    data = parcel(spark, sf)
    condition = F.struct(F.lit("status_code").alias("when_column"), F.array("status_code").alias("when_values"),
                         F.lit("weight_kg").alias("check_column"), F.lit("lte").alias("check_op"),
                         F.floor("top").alias("check_value"), F.lit("heavier than usual").alias("reason"))
    proposed = data.groupBy("status_code").agg(F.avg("weight_kg").alias("top")).orderBy("status_code").select(
        F.lit("").alias("rule_id"), F.lit("cross_column_inconsistency").alias("error_type"),
        F.array(F.lit("status_code"), F.lit("weight_kg")).alias("target_columns"),
        F.lit("value_condition").alias("validation_tool"),
        F.to_json(F.struct(F.array(condition).alias("conditions"))).alias("params"))
    return sus.counts_by(sus.find_suspects(data, rules_from_df(proposed, generated=True)), "rule_id")


_RATES = [
    ("R001-road_addr_yn_enum", "road_addr_yn", "road_addr_yn NOT IN (0, 1)", "road_addr_yn IS NOT NULL"),
    ("R001-status_code_enum", "status_code", "status_code = 'LOST'", "status_code IS NOT NULL"),
    ("R001-weight_kg_range", "weight_kg", "weight_kg < 0.01 OR weight_kg > 30", "weight_kg IS NOT NULL"),
    ("R002-time_format_hhmmss", "dispatch_time", f"NOT regexp_full_match(dispatch_time, '{TIME_OK}')", "dispatch_time IS NOT NULL"),
    ("R002-time_format_hhmmss", "arrival_time", f"NOT regexp_full_match(arrival_time, '{TIME_OK}')", "arrival_time IS NOT NULL"),
    ("R002-tracking_id_format", "tracking_id", "NOT regexp_full_match(tracking_id, '[0-9]{10,15}')",
     "tracking_id IS NOT NULL"),
    ("R002-phone_format", "sender_phone", "NOT regexp_full_match(sender_phone, '0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}')", "sender_phone IS NOT NULL"),
    ("R002-phone_format", "receiver_phone", "false", "false"),  # the table has no such column
    ("R003-dispatch_before_arrival", "dispatch_time,arrival_time",
     f"try_strptime(dispatch_time, {FORMATS}) >= try_strptime(arrival_time, {FORMATS})",
     f"try_strptime(dispatch_time, {FORMATS}) IS NOT NULL AND try_strptime(arrival_time, {FORMATS}) IS NOT NULL"),
    ("R004-address_road_yn_match", "address,road_addr_yn",
     "kind = 'ambiguous' OR (kind = 'road' AND road_addr_yn <> 1) OR (kind = 'jibun' AND road_addr_yn <> 0)", "true"),
    ("R004-cod_payment_consistency", "payment_method,cod_amount", "payment_method = '착불' AND NOT coalesce(cod_amount > 0, false)",
     "payment_method = '착불'"),
    ("R004-cod_payment_consistency", "payment_method,cod_amount",
     "payment_method IN ('선불', '신용카드', '계좌이체') AND cod_amount IS DISTINCT FROM 0", "payment_method IN ('선불', '신용카드', '계좌이체')"),
]


@query("rule_rates", sql("SELECT *, round(violation_count / greatest(total_checked, 1), 6) AS violation_rate, "
                         "violation_count / greatest(total_checked, 1) > 0.3 AS alert FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, '{c}' AS columns, count(*) FILTER ({v}) AS violation_count, "
    f"count(*) FILTER ({t}) AS total_checked FROM p" for r, c, v, t in _RATES) + ")", "p"))
def rule_rates(spark, sf):
    return sus.rule_rates(parcel(spark, sf), DEFAULT_RULES, alert_above=0.3).drop("check_no")


def many_rules():
    """6000 rules over lineitem: bounds of prices, taxes and part numbers, lists of line numbers, conditions."""
    def rule(name, i, column, params):
        return Rule(f"{name}-{i}", "out_of_range", (column,), "range_check", params)

    out = [rule("price", i, "l_extendedprice", {"max_value": 104800 + i / 8}) for i in range(2000)]
    out += [rule("part", i, "l_partkey", {"min_value": 4 * i // 2000}) for i in range(1500)]
    out += [rule("line", i, "l_linenumber", {"allowed_values": [1, 2, 3, 4, 5, 6, 7] if i % 150 else [1, 2, 3, 4, 5, 6]}) for i in range(1500)]
    return out + [Rule(f"tax-{i}", "cross_column_inconsistency", ("l_returnflag", "l_tax"), "value_condition", {"conditions": [
        {"when_column": "l_returnflag", "when_values": ["R"], "check_column": "l_tax", "check_op": "lte", "check_value": i / 4, "reason": f"tax {i}"}]})
        for i in range(1000)]


_MANY = """SELECT l_orderkey, 'price-' || i AS rule_id, 'max:' || cast(104800 + cast(i AS double) / 8 AS varchar) AS reason, 'out_of_range' AS error_type
  FROM lineitem, range(2000) t(i) WHERE l_extendedprice > 104800 + cast(i AS double) / 8
UNION ALL SELECT l_orderkey, 'part-' || i, 'min:' || (4 * i // 2000), 'out_of_range' FROM lineitem, range(1500) t(i) WHERE l_partkey < 4 * i // 2000
UNION ALL SELECT l_orderkey, 'line-' || i, 'allowed:[1, 2, 3, 4, 5, 6]', 'out_of_range' FROM lineitem, range(1500) t(i) WHERE i % 150 = 0 AND l_linenumber = 7
UNION ALL SELECT l_orderkey, 'tax-' || i, 'tax ' || i, 'cross_column_inconsistency' FROM lineitem, range(1000) t(i) WHERE l_returnflag = 'R' AND l_tax > i / 4.0"""


@query("rules_many", f"SELECT cast(l_orderkey AS varchar) AS record_id, rule_id, reason, error_type FROM ({_MANY})")
def rules_many(spark, sf):
    """6000 rules as data: sorted bounds and value lists searched once per row."""
    return sus.find_suspects(table(spark, sf, "lineitem"), many_rules(), "l_orderkey").select("record_id", "rule_id", "reason", "error_type")


@query("rule_rates_many", f"""WITH r AS (SELECT 'price-' || i AS rule_id, 'l_extendedprice' AS columns FROM range(2000) t(i) UNION ALL SELECT 'part-' || i, 'l_partkey' FROM range(1500) t(i)
  UNION ALL SELECT 'line-' || i, 'l_linenumber' FROM range(1500) t(i) UNION ALL SELECT 'tax-' || i, 'l_returnflag,l_tax' FROM range(1000) t(i)),
v AS (SELECT rule_id, count(*) AS n FROM ({_MANY}) GROUP BY rule_id), t AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_r FROM lineitem),
c AS (SELECT rule_id, columns, coalesce(v.n, 0) AS violation_count, CASE WHEN columns LIKE '%tax' THEN n_r ELSE t.n END AS total_checked
      FROM r LEFT JOIN v USING (rule_id) CROSS JOIN t)
SELECT *, round(violation_count / greatest(total_checked, 1), 6) AS violation_rate, violation_count / greatest(total_checked, 1) > 0.01 AS alert FROM c""")
def rule_rates_many(spark, sf):
    return sus.rule_rates(table(spark, sf, "lineitem"), many_rules(), alert_above=0.01).drop("check_no")


# --- over the suspects -----------------------------------------------------------

@query("stats_by_type", sql("SELECT error_type, count(*) AS n FROM s GROUP BY error_type", "s"))
def stats_by_type(spark, sf):
    return sus.counts_by(suspects(spark, sf), "error_type")


@query("stats_by_severity", sql("SELECT severity, count(*) AS n FROM s GROUP BY severity", "s"))
def stats_by_severity(spark, sf):
    return sus.counts_by(suspects(spark, sf), "severity")


@query("stats_by_type_and_severity", sql("SELECT error_type, severity, count(*) AS n FROM s "
                                         "GROUP BY GROUPING SETS ((error_type), (severity))", "s"))
def stats_both(spark, sf):
    return sus.counts_by_type_and_severity(suspects(spark, sf))


@query("type_share", sql("SELECT error_type, n, round(n * 100.0 / sum(n) OVER (), 4) AS percent FROM "
                         "(SELECT error_type, count(*) AS n FROM s GROUP BY error_type)", "s"))
def type_share(spark, sf):
    return sus.type_share(suspects(spark, sf))


@query("delegated_union", sql("SELECT record_id, rule_id, severity FROM s UNION ALL "
                              "SELECT record_id, 'delegated', 'info' FROM s WHERE severity = 'info'", "s"))
def delegated_union(spark, sf):
    found = suspects(spark, sf)
    handed = found.filter("severity = 'info'").select("record_id", F.lit("delegated").alias("rule_id"), "severity")
    return sus.add_delegated(found, handed).select("record_id", "rule_id", "severity")


@query("rules_by_column", sql("""
SELECT c AS column_name, count(DISTINCT rule_id) AS rules_violated, count(*) AS n
FROM (SELECT rule_id, unnest(string_split(target_columns, ',')) AS c FROM every)
WHERE c IN ('weight_kg', 'road_addr_yn', 'arrival_time') GROUP BY c""", "every"))
def rules_by_column(spark, sf):
    """Rules that name a column, run alone, counted per column."""
    names = ["weight_kg", "road_addr_yn", "arrival_time"]
    picked = {r.rule_id: r for c in names for r in by_column(DEFAULT_RULES, c)}
    found = sus.find_suspects(parcel(spark, sf), list(picked.values()))
    catalog = rules_df(spark, picked.values()).select("rule_id", "enabled")
    return (found.join(F.broadcast(catalog), "rule_id")  # one row per rule
            .select("rule_id", F.explode("target_columns").alias("column_name"))
            .filter(F.col("column_name").isin(names)).groupBy("column_name")
            .agg(F.count_distinct("rule_id").alias("rules_violated"), F.count("*").alias("n")))


@query("rule_relations", sql("""
SELECT 'temporal' AS kind, 'dispatch_time' AS source_column, 'arrival_time' AS target_column,
  'earlier_than' AS relation_type, count(*) FILTER (dispatch_time IS NOT NULL AND arrival_time IS NOT NULL) AS rows_with_both FROM p
UNION ALL SELECT 'cross_column', 'address', 'road_addr_yn', 'semantic', count(*) FILTER (address IS NOT NULL AND road_addr_yn IS NOT NULL) FROM p
UNION ALL SELECT 'cross_column', 'payment_method', 'cod_amount', 'semantic', count(*) FILTER (payment_method IS NOT NULL AND cod_amount IS NOT NULL) FROM p""", "p"))
def rule_relations(spark, sf):
    """Column pairs the rules relate, with the rows on which the relation can be tested."""
    pairs = relations(enabled(DEFAULT_RULES))
    data = parcel(spark, sf)
    both = data.agg(*[F.count_if(F.col(r["source_column"]).isNotNull() & F.col(r["target_column"]).isNotNull())
                      .alias(f"n{i}") for i, r in enumerate(pairs)])
    return both.select(F.inline(F.array(*[F.struct(
        *[F.lit(r[k]).alias(k) for k in ("kind", "source_column", "target_column", "relation_type")],
        F.col(f"n{i}").alias("rows_with_both")) for i, r in enumerate(pairs)])))


@query("rules_by_tool", sql("SELECT 'regex_validate' AS tool, count(*) AS n FROM s WHERE rule_id LIKE 'R002%' "
                            "UNION ALL SELECT 'range_check', count(*) FROM s WHERE rule_id LIKE 'R001%'", "s"))
def rules_by_tool(spark, sf):
    """The rules of two tools, run in one scan, counted per tool."""
    tools = ("regex_validate", "range_check")
    rules = {r.rule_id: tool for tool in tools for r in by_tool(DEFAULT_RULES, tool)}
    found = sus.find_first_suspects(parcel(spark, sf), [r for r in DEFAULT_RULES if r.rule_id in rules])
    return (found.groupBy("rule_id").agg(F.count("*").alias("n"))
            .select(F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule_id")).alias("tool"), "n")
            .groupBy("tool").agg(F.sum("n").alias("n")))


@query("pattern_key", sql("SELECT error_type || ':' || rule_id || ':' || target_columns AS pattern_key, count(*) AS n "
                          "FROM s GROUP BY 1", "s"))
def pattern_keys(spark, sf):
    return suspects(spark, sf).groupBy(pattern_key().alias("pattern_key")).agg(F.count("*").alias("n"))


@query("record_key_json", """SELECT '{"l_linenumber":' || cast(l_linenumber AS varchar) || ',"l_orderkey":' ||
cast(l_orderkey AS varchar) || '}' AS record_key, count(*) AS n FROM lineitem GROUP BY 1""")
def record_keys(spark, sf):
    return (table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
            .select(record_key_json("l_orderkey", "l_linenumber").alias("record_key"), "n"))


@query("mask_prefix", """SELECT c_custkey, left(c_name, 5) || '****' AS name,
CASE WHEN length(c_mktsegment) <= 9 THEN '****' ELSE left(c_mktsegment, 9) || '****' END AS segment FROM customer""")
def masks(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", mask_prefix(F.col("c_name")).alias("name"),
                                               mask_prefix(F.col("c_mktsegment"), 9).alias("segment"))
