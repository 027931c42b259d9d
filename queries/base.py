"""Registration of queries, the tables they read, and the SQL pieces shared by the checks.

``PARCEL`` turns each order into a parcel record with seeded defects; its text runs unchanged
on Spark and on the checking engine. Everything after that is written twice: with the package
for Spark, in SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.operators.suspects import find_first_suspects
from tamis.plans import DEFAULT_RULES
from tamis.session import materialise, tune

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"  # queries never ask for the current time


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


PARCEL = """
SELECT cast(o_orderkey AS string) AS record_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL
       WHEN o_orderkey % 97 = 0 THEN concat('ABCD', cast(o_orderkey AS string))
       ELSE lpad(cast(o_orderkey AS string), 12, '0') END AS tracking_id,
  concat('name', cast(o_orderkey % 20 AS string)) AS sender_name,
  concat('name', cast(o_custkey % 20 AS string)) AS receiver_name,
  CASE WHEN o_orderkey % 89 = 0 THEN '010-1234'
       ELSE concat('010-', lpad(cast(o_orderkey % 10000 AS string), 4, '0'), '-',
                   lpad(cast(o_custkey % 10000 AS string), 4, '0')) END AS sender_phone,
  CASE o_orderkey % 5 WHEN 0 THEN concat('서울특별시 강남구 테헤란로 ', cast(o_orderkey AS string))
       WHEN 1 THEN concat('서울특별시 마포구 서교동 ', cast(o_orderkey AS string))
       WHEN 2 THEN concat('대구광역시 중구 동성로2가 ', cast(o_orderkey AS string))
       WHEN 3 THEN concat('부산광역시 사하구 감천동 10-', cast(o_orderkey AS string))
       ELSE NULL END AS address,
  CASE WHEN o_orderkey % 83 = 0 THEN 5 ELSE o_custkey % 2 END AS road_addr_yn,
  CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_totalprice / cast(15000 AS double) END AS weight_kg,
  CASE WHEN o_orderkey % 73 = 0 THEN '14:30'
       ELSE concat(lpad(cast(o_orderkey % 24 AS string), 2, '0'), ':',
                   lpad(cast(o_orderkey % 60 AS string), 2, '0'), ':00') END AS dispatch_time,
  concat(lpad(cast((o_orderkey + o_custkey) % 24 AS string), 2, '0'), ':',
         lpad(cast(o_custkey % 60 AS string), 2, '0'), ':00') AS arrival_time,
  CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'IN_TRANSIT' ELSE 'LOST' END AS status_code,
  CASE o_orderkey % 3 WHEN 0 THEN '착불' WHEN 1 THEN '선불' ELSE '신용카드' END AS payment_method,
  CASE WHEN o_custkey % 2 = 0 THEN cast(0 AS double) ELSE cast((o_custkey % 100) * 100 AS double) END AS cod_amount,
  CASE o_orderkey % 3 WHEN 0 THEN 'parcels' WHEN 1 THEN 'returns' ELSE 'walk_in' END AS table_name,
  o_orderdate AS order_date
FROM {orders}
"""


#: What ``parcel`` deals its rows over where a caller says nothing: as the reader's splits are. bench.py sets it from $BENCH_PARTITIONS.
PARTITIONS: int | None = None


def parcel(spark: SparkSession, sf: str, partitions: int | None = None) -> DataFrame:
    """Orders as parcels. A file of one row group is one task; ``partitions`` deals the rows over more."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    partitions = partitions or PARTITIONS
    return spark.sql(PARCEL, orders=orders.repartition(partitions) if partitions else orders)


def suspects(spark: SparkSession, sf: str, carry=()) -> DataFrame:
    return find_first_suspects(parcel(spark, sf), DEFAULT_RULES, carry=carry)


def flat(df: DataFrame) -> DataFrame:
    """Suspects with arrays and maps as text, so that every engine hashes them alike."""
    pairs = F.transform(F.sort_array(F.map_entries("current_values")),
                        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>"))))
    return (df.withColumn("target_columns", F.concat_ws(",", "target_columns"))
            .withColumn("current_values", F.concat_ws("|", pairs)))


# --- the same in SQL -----------------------------------------------------------

TIME_OK = "([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])"
TIME_RE = r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$"
FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y%m%d%H%M%S', '%H:%M:%S']"
ROAD, JIBUN = r"(로|길)\s*\d+", r"(동|리|가)\s*\d+|\d+-\d+"


def _branch(no, rule, kind, columns, values, reason, severity, where):
    return (f"SELECT record_id, '{rule}' AS rule_id, '{kind}' AS error_type, '{columns}' AS target_columns, "
            f"{values} AS current_values, {reason} AS reason, {severity} AS severity, {no} AS check_no, "
            f"table_name FROM p WHERE {where}")


def _show(*columns):
    return " || '|' || ".join(f"'{c}=' || coalesce({c}, '<null>')" if c not in ("road_addr_yn", "weight_kg", "cod_amount")
                              else f"'{c}=' || coalesce(cast({c} AS varchar), '<null>')" for c in sorted(columns))


SUSPECT_BRANCHES = [
    _branch(1, "R001-road_addr_yn_enum", "out_of_range", "road_addr_yn", _show("road_addr_yn"),
            "'allowed:[0, 1]'", "'critical'", "road_addr_yn NOT IN (0, 1)"),
    _branch(2, "R001-status_code_enum", "out_of_range", "status_code", _show("status_code"),
            "'allowed:[''PICKUP'', ''IN_TRANSIT'', ''OUT_FOR_DELIVERY'', ''DELIVERED'', ''RETURNED'']'", "'critical'",
            "status_code NOT IN ('PICKUP', 'IN_TRANSIT', 'OUT_FOR_DELIVERY', 'DELIVERED', 'RETURNED')"),
    _branch(3, "R001-weight_kg_range", "out_of_range", "weight_kg", _show("weight_kg"),
            "'min:0.01, max:30.0'", "'critical'", "weight_kg < 0.01 OR weight_kg > 30.0"),
    _branch(4, "R002-time_format_hhmmss", "format_inconsistency", "dispatch_time", _show("dispatch_time"),
            f"'pattern:{TIME_RE}'", "'warning'", f"NOT regexp_full_match(dispatch_time, '{TIME_OK}')"),
    _branch(5, "R002-time_format_hhmmss", "format_inconsistency", "arrival_time", _show("arrival_time"),
            f"'pattern:{TIME_RE}'", "'warning'", f"NOT regexp_full_match(arrival_time, '{TIME_OK}')"),
    _branch(6, "R002-tracking_id_format", "format_inconsistency", "tracking_id", _show("tracking_id"),
            r"'pattern:^\d{10,15}$'", "'critical'", "NOT regexp_full_match(tracking_id, '[0-9]{10,15}')"),
    _branch(7, "R002-phone_format", "format_inconsistency", "sender_phone", _show("sender_phone"),
            r"'pattern:^0\d{1,2}-\d{3,4}-\d{4}$'", "'warning'",
            "NOT regexp_full_match(sender_phone, '0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}')"),
    _branch(8, "R003-dispatch_before_arrival", "temporal_violation", "dispatch_time,arrival_time",
            _show("dispatch_time", "arrival_time"), "'dispatch_time < arrival_time'", "'critical'",
            f"try_strptime(dispatch_time, {FORMATS}) >= try_strptime(arrival_time, {FORMATS})"),
    _branch(9, "R004-address_road_yn_match", "cross_column_inconsistency", "address,road_addr_yn",
            "'address=' || coalesce(address, 'None') || '|' || " + _show("road_addr_yn"),
            "CASE kind WHEN 'ambiguous' THEN 'Address type ambiguous — deferred to LLM Analyzer' "
            "ELSE 'Address is ' || kind || ' type but road_addr_yn=' || cast(road_addr_yn AS varchar) END",
            "CASE kind WHEN 'ambiguous' THEN 'info' ELSE 'warning' END",
            "kind = 'ambiguous' OR (kind = 'road' AND road_addr_yn <> 1) OR (kind = 'jibun' AND road_addr_yn <> 0)"),
    _branch(10, "R004-cod_payment_consistency", "cross_column_inconsistency", "payment_method,cod_amount",
            _show("payment_method", "cod_amount"), "'착불 결제인데 착불 금액(cod_amount)이 0원'", "'critical'",
            "payment_method = '착불' AND NOT coalesce(cod_amount > 0, false)"),
    _branch(11, "R004-cod_payment_consistency", "cross_column_inconsistency", "payment_method,cod_amount",
            _show("payment_method", "cod_amount"), "'선불/카드/이체 결제인데 착불 금액(cod_amount)이 존재'", "'critical'",
            "payment_method IN ('선불', '신용카드', '계좌이체') AND cod_amount IS DISTINCT FROM 0"),
]

# Verdicts of the stand-in judge and reviewer, as expressions both engines read.
K = "cast(record_id AS bigint)"
IS_ERROR = f"({K} % 7 <> 0)"
CONFIDENCE = f"CASE WHEN {K} % 5 = 0 THEN 'LOW' WHEN severity = 'critical' THEN 'HIGH' ELSE 'MEDIUM' END"
REFLECTED = f"CASE WHEN {K} % 13 = 0 THEN NOT {IS_ERROR} ELSE {IS_ERROR} END"
FIX_COLUMN = (f"CASE WHEN {K} % 3 = 0 THEN NULL WHEN rule_id = 'R001-weight_kg_range' THEN 'weight_kg' "
              "WHEN rule_id = 'R001-status_code_enum' THEN 'status_code' "
              "WHEN rule_id = 'R001-road_addr_yn_enum' THEN 'road_addr_yn' "
              "WHEN rule_id = 'R004-cod_payment_consistency' THEN 'cod_amount' END")
FIX_VALUE = ("CASE WHEN rule_id = 'R001-weight_kg_range' THEN '15.0' WHEN rule_id = 'R001-status_code_enum' "
             "THEN 'DELIVERED' WHEN rule_id = 'R001-road_addr_yn_enum' THEN '1' ELSE '0' END")
ACTION = f"CASE {K} % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'approved' END"

CTES = {
    "p": f"SELECT *, CASE WHEN road AND NOT jibun THEN 'road' WHEN jibun AND NOT road THEN 'jibun' ELSE 'ambiguous' END "
         f"AS kind FROM (SELECT *, regexp_matches(coalesce(address, 'None'), '{ROAD}') AS road, "
         f"regexp_matches(coalesce(address, 'None'), '{JIBUN}') AS jibun FROM ({PARCEL.format(orders='orders')}))",
    "every": " UNION ALL ".join(SUSPECT_BRANCHES),
    "s": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id, rule_id ORDER BY check_no) "
         "AS rn FROM every) WHERE rn = 1",
    "j": f"SELECT record_id, rule_id, error_type, {IS_ERROR} AS is_error, {CONFIDENCE} AS confidence, "
         f"'seen ' || rule_id AS reasoning, {FIX_COLUMN} AS fix_column, {FIX_VALUE} AS fix_value, severity FROM s",
    # reconciled with the second opinion; every 17th record got none
    "r": f"SELECT record_id, rule_id, error_type, is_error, fix_column, fix_value, reasoning, severity, "
         f"NOT differs AS reflection_match, CASE WHEN differs THEN 'LOW' ELSE confidence END AS confidence, "
         f"CASE WHEN differs THEN 'Primary/Reflection mismatch' ELSE '' END AS reflection_note FROM "
         f"(SELECT *, {K} % 17 <> 0 AND ({REFLECTED}) <> is_error AS differs FROM j)",
    "q": "SELECT * FROM r WHERE is_error AND confidence = 'HIGH'",
    "a": f"SELECT * FROM q WHERE ({ACTION}) = 'approved'",
}


def sql(body: str, upto: str = "a", extra: dict | None = None) -> str:
    """``body`` with the shared CTEs up to the named one in front."""
    names = list(CTES)[:list(CTES).index(upto) + 1]
    ctes = {n: CTES[n] for n in names} | (extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + "\n" + body


# --- judgments on the Spark side -----------------------------------------------

JUDGED = ["record_id", "rule_id", "error_type", "severity"]  # what the stand-in opinions read of a suspect


def judged(found: DataFrame) -> DataFrame:
    """First opinions of the stand-in judge."""
    fix = F.expr(FIX_COLUMN)
    return found.select(
        "record_id", "rule_id", "error_type", F.expr(IS_ERROR).alias("is_error"), F.expr(CONFIDENCE).alias("confidence"),
        F.concat(F.lit("seen "), "rule_id").alias("reasoning"),
        F.when(fix.isNotNull(), F.create_map(fix, F.expr(FIX_VALUE))).alias("suggested_correction"))


def second_opinions(found: DataFrame) -> DataFrame:
    return (found.filter(f"{K} % 17 <> 0")
            .select("record_id", "rule_id", F.expr(REFLECTED).alias("is_error")))


def found_once(spark: SparkSession, sf: str) -> DataFrame:
    """Suspects written and read back, for queries that need them more than once."""
    return materialise(suspects(spark, sf), "suspects")


def reconciled(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    from tamis.operators.reconcile import reconcile

    found = materialise(suspects(spark, sf).select(*JUDGED), "suspects") if found is None else found
    return reconcile(judged(found), second_opinions(found))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewer decisions: one per record, some records have none."""
    return (parcel(spark, sf).select("record_id", F.expr(ACTION).alias("action"), F.lit("kim").alias("reviewer"),
                                     F.lit("not an error").alias("reason"),
                                     F.lit(AS_OF).cast("timestamp").alias("decided_at"))
            .filter("action IS NOT NULL"))


def approved_items(spark: SparkSession, sf: str) -> DataFrame:
    from tamis.operators.correct import approved
    from tamis.operators.health import approval_queue

    return materialise(approved(approval_queue(reconciled(spark, sf)), decisions(spark, sf)), "approved")
