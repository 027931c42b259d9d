"""Handing suspects to an outside judge in batches, and reading its answers.

The judge is a Python function given by the user; it gets a list of at most ``batch_size``
items and returns text (or ``(text, input_tokens, output_tokens)``). It must be importable on the
executors, or be defined inside another function, when it is shipped by value. This is the one
place where rows leave the JVM. Batches are cut inside each partition, so nothing is ordered or
gathered for it.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import exists, list_folder, materialise, scratch

RESPONSE_SCHEMA = ("batch_id string, analysis_type string, items array<struct<record_id:string,rule_id:string>>, "
                   "response string, input_tokens long, output_tokens long, error string")


def judge_item(df: DataFrame) -> Column:
    """What the judge sees of a row: all its columns as JSON."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def batch_payloads(numbered: DataFrame, batch_size: int = 50) -> DataFrame:
    """Consecutive slices as JSON arrays, for a judge that reads files rather than being called.

    ``numbered`` carries row_no 1..n (see ``order.number_rows``); a group has at most
    ``batch_size`` rows.
    """
    item = F.struct("row_no", judge_item(numbered.drop("row_no")).alias("item"))
    return (numbered.select(F.floor((F.col("row_no") - 1) / batch_size).cast("long").alias("batch_no"), item.alias("i"))
            .groupBy("batch_no").agg(F.count("*").alias("item_count"), F.sort_array(F.collect_list("i")).alias("items"))
            .select("batch_no", "item_count",
                    F.concat(F.lit("["), F.array_join(F.col("items.item"), ","), F.lit("]")).alias("payload")))


def _batched(judge: Callable, analysis_type: str, batch_size: int, retries: int, backoff: float, fatal: tuple, prefix: str = ""):
    """For ``mapInPandas``: rows of (record_id, rule_id, item[, digest]) to a row per call."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        waiting: list = []

        def call(batch):
            nonlocal number
            row = {"batch_id": f"{prefix}{part:08d}-{number:08d}", "analysis_type": analysis_type,
                   "items": [dict(zip(("record_id", "rule_id", "digest"), (r, q, *more))) for r, q, _, *more in batch],
                   "response": None, "input_tokens": 0, "output_tokens": 0, "error": None}
            number += 1
            for attempt in range(retries + 1):
                if attempt:
                    time.sleep(backoff * 2 ** (attempt - 1))
                try:
                    answer = judge([json.loads(i[2]) for i in batch])
                    text, tokens_in, tokens_out = answer if isinstance(answer, tuple) else (answer, 0, 0)
                    row.update(response=text, input_tokens=tokens_in, output_tokens=tokens_out, error=None)
                    break
                except fatal:
                    raise
                except Exception as e:
                    row["error"] = str(e) or type(e).__name__
            return row

        for frame in frames:
            waiting += list(frame.itertuples(index=False, name=None))
            done = []
            while len(waiting) >= batch_size:
                done.append(call(waiting[:batch_size]))
                waiting = waiting[batch_size:]
            if done:
                yield pd.DataFrame(done)
        if waiting:
            yield pd.DataFrame([call(waiting)])

    return run


def dealt(items: DataFrame, parallel_calls: int | None = None) -> DataFrame:
    """Dealt by their keys over ``parallel_calls`` tasks. Items that are joined by their keys before they are asked for are dealt before the join: it
    needs no other shuffle then, and the number of tasks stays."""
    return items.repartition(parallel_calls or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record_id", "rule_id")


def call_judge(items: DataFrame, judge: Callable, analysis_type: str = "PRIMARY", batch_size: int = 50,
               retries: int = 2, keep: bool = True, parallel_calls: int | None = None, backoff: float = 0.0, fatal: tuple = ()) -> DataFrame:
    """One row per call: the items, the response text, tokens used, or the error.

    Items are dealt by their keys over ``parallel_calls`` tasks (the session's shuffle partitions if not given), however
    few files they came from. A call that raises is repeated at most ``retries`` times, after ``backoff`` seconds, then twice as
    many, and so on; then its items are failures. Exceptions of the types in ``fatal`` end the job. The result is written and read back
    (``keep``), because each run of the plan would call the judge again; ``judge_in_rounds`` also keeps what was answered before a
    job ended.
    """
    packed = dealt(items.select("record_id", "rule_id", judge_item(items).alias("item")), parallel_calls)
    responses = packed.mapInPandas(_batched(judge, analysis_type, batch_size, retries, backoff, fatal), RESPONSE_SCHEMA)
    return materialise(responses, f"responses-{analysis_type.lower()}") if keep else responses


# --- a ledger of committed rounds ---------------------------------------------------

UNASKED = "Not asked"
FAILURES = "array<struct<record_id:string,rule_id:string,error:string>>"
LEDGER_SCHEMA = RESPONSE_SCHEMA.replace("rule_id:string>", "rule_id:string,digest:string>")
MANY_ROUNDS = 32
COMMITTED = "_SUCCESS"  # fixed value: Spark's mark of a completely written folder


def _digested(items: DataFrame, *more: Column) -> DataFrame:
    """Items with the digest of all the judge sees, dealt by it. A digest does not shrink, so it is computed again after the shuffle."""
    digest = F.unhex(F.sha2("item", 256))
    return items.select("record_id", "rule_id", judge_item(items).alias("item"), *more).repartition(digest).withColumn("digest", digest)


def _commits(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the ledger's completely written rounds, oldest first."""
    return [n for n in list_folder(spark, ledger) if n.startswith("round-") and exists(spark, f"{ledger}/{n}/{COMMITTED}")]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All calls of committed rounds; what a job that ended early left behind does not show."""
    paths = [f"{ledger}/{n}" for n in _commits(spark, ledger)]
    return spark.read.schema(LEDGER_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LEDGER_SCHEMA)


def _answers(calls: DataFrame) -> DataFrame:
    """(digest, ok, batch_id): for each item its last answered call, else its last one."""
    tried = calls.select("batch_id", F.col("error").isNull().alias("ok"), F.explode("items.digest").alias("hex")).withColumn("digest", F.unhex("hex"))
    return tried.groupBy("digest").agg(F.max(F.struct("ok", "batch_id")).alias("a")).select("digest", "a.ok", "a.batch_id")


def judge_in_rounds(items: DataFrame, judge: Callable, ledger: str, analysis_type: str = "PRIMARY", batch_size: int = 50, retries: int = 2,
                    backoff: float = 1.0, fatal: tuple = (PermissionError,), parallel_calls: int | None = None, round_items: int = 100_000,
                    rounds: int | None = None, deal: Column | None = None) -> DataFrame:
    """Ask for every item the ledger has no answer to, round by round; returns the calls of the whole ledger.

    ``ledger`` is a folder that all executors reach. Items are dealt into rounds of about ``round_items`` (or so many ``rounds``) by ``deal``, a
    whole number per item (a hash if not given), and the calls of a round are written before those of the next begin. So a job that
    ends early, or a task that is lost, repeats at most the calls of one round; run again with the same ledger, nothing that was committed is
    asked anew. An item is known by all that the judge sees of it: one that has changed is asked again, equal ones are asked once. Items
    whose calls failed are asked again by the next run. One job at a time writes to a ledger.
    """
    spark, ledger = items.sparkSession, ledger.rstrip("/")
    tasks = parallel_calls or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = _answers(read_ledger(spark, ledger)).filter("ok")
    with scratch(spark, "open-items") as staged:
        todo = _digested(items, *([] if deal is None else [deal.cast("long").alias("deal")]))
        todo = todo.withColumn("deal", F.xxhash64(F.lower(F.hex("digest"))) if deal is None else F.col("deal")).dropDuplicates(["digest"])
        todo = todo.join(known, "digest", "left_anti").drop("digest")
        if rounds is None:
            todo = materialise(todo, "to-judge", path=f"{staged}/all")
            rounds = max(1, -(-todo.count() // round_items))
        turn = F.coalesce(F.pmod("deal", F.lit(rounds)), F.lit(0)).cast("int")
        todo = todo.withColumn("turn", turn).drop("deal")
        # a round is a folder; many of them are written by one task each, a few by every task
        todo = todo.repartition(tasks, "turn") if rounds > MANY_ROUNDS else todo
        todo.write.option("compression", "zstd").partitionBy("turn").parquet(f"{staged}/turns")
        first = len(list_folder(spark, ledger))
        for n, name in enumerate(sorted(x for x in list_folder(spark, f"{staged}/turns") if x.startswith("turn="))):
            mine = spark.read.schema("record_id string, rule_id string, item string").parquet(f"{staged}/turns/{name}")
            number, digest = f"{first + n:08d}", F.sha2("item", 256)
            calls = mine.repartition(tasks, digest).withColumn("digest", digest).mapInPandas(
                _batched(judge, analysis_type, batch_size, retries, backoff, fatal, f"{number}-"), LEDGER_SCHEMA)
            calls.write.option("compression", "zstd").parquet(f"{ledger}/round-{number}-{uuid.uuid4().hex}")
    return read_ledger(spark, ledger)


def settled(calls: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgments, failures) of the items at hand from a ledger's calls: of each item its last answered call counts, or its last one."""
    last = _answers(calls)
    mine = materialise(_digested(items).join(last, "digest").select("batch_id", "record_id", "rule_id"), "answered")
    judgments, failures = parse_responses(calls.join(mine.select("batch_id").distinct(), "batch_id", "left_semi"))
    keys = ["batch_id", "record_id", "rule_id"]
    return judgments.join(mine, keys, "left_semi"), failures.join(mine, keys, "left_semi").unionByName(failures.filter(F.col("error") == UNASKED))


def _array_text(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; text without brackets is taken as it is."""
    first = F.instr(text, "[")
    last = F.length(text) - F.instr(F.reverse(text), "]") + 1
    found = (first > 0) & (F.instr(text, "]") > 0)
    cut = F.when(found, F.substr(text, first, last - first + 1)).otherwise(F.btrim(text))
    return F.when(found | cut.startswith("["), cut).otherwise(F.concat(F.lit("["), cut, F.lit("]")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there, and also where functions of array elements mention it."""
    return F.get(F.transform(F.array(value), use), 0)


def _get(v, path, kind="string"):
    return F.try_variant_get(v, f"$.{path}", kind)


def _said() -> Column:
    """Of a response the answers with the item that each is for (its place, or NULL); NULL if the text is no JSON."""
    def answer(v, k):
        return F.struct(k.alias("pos"), v.alias("v"), F.coalesce(_get(v, "record_id"), F.lit("")).alias("record_id"), _get(v, "rule_id").alias("named"),
                        (_get(v, "evidence", "variant").isNotNull() | _get(v, "reasoning", "variant").isNotNull()).alias("grounded"))

    def key(x, rule):  # NULL if a part is
        return F.concat(F.length(x["record_id"]).cast("string"), F.lit(":"), x["record_id"], x[rule])

    def with_items(e):
        def count(texts, text):
            return F.size(texts) - F.size(F.array_remove(texts, text))

        def item_of(x):
            nth = F.greatest(F.least(count(F.slice(e["unnamed"], 1, x["pos"] + 1), x["record_id"]), count(e["records"], x["record_id"])), F.lit(1))
            one = F.array_position(e["records"], x["record_id"])
            mine = F.filter(F.transform(e["records"], lambda r, k: F.when(r == x["record_id"], k)), lambda k: k.isNotNull())
            place = F.when(x["named"].isNotNull(), F.array_position(e["keys"], key(x, "named")) - 1).when(nth == 1, one - 1).otherwise(F.get(mine, nth - 1))
            return F.when(place >= 0, place.cast("int"))

        return F.transform(e["said"], lambda x: F.struct(x["pos"].alias("pos"), x["v"].alias("v"), x["record_id"].alias("record_id"),
                                                         x["grounded"].alias("grounded"), item_of(x).alias("item")))

    asked = F.coalesce("items", F.array().cast("array<struct<record_id:string,rule_id:string>>"))
    read = F.try_variant_get(F.try_parse_json(_array_text(F.col("response"))), "$", "array<variant>")
    return _once(F.transform(read, answer), lambda said: F.when(said.isNotNull(), _once(F.struct(
        said.alias("said"), F.transform(asked, lambda i: key(i, "rule_id")).alias("keys"), F.transform(asked, lambda i: i["record_id"]).alias("records"),
        F.transform(said, lambda y: F.when(y["named"].isNull(), y["record_id"])).alias("unnamed")), with_items)))


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgments, failures) from response texts, in JVM JSON functions within each batch's row: no shuffle.

    Every item of a batch ends up in one of the two. An answer must give evidence (or reasoning). It belongs to the item of
    its record and rule; without a rule, to the item that comes as far down among its record's items as the answer
    does among the record's answers without a rule. Items without a usable answer are failures, and so is
    an answer to something that was not asked. A batch that failed, or whose text is no JSON, fails each of its items.
    """
    responses = responses.withColumn("items", F.transform("items", lambda i: F.struct(i["record_id"].alias("record_id"), i["rule_id"].alias("rule_id"))))
    v = F.col("v")
    # explode_outer: before explode Spark would ask how many answers there are, and read each text twice
    judgments = (responses.select("batch_id", "items", F.explode_outer(F.filter(_said(), lambda x: x["grounded"] & x["item"].isNotNull())).alias("x"))
                 .filter("x IS NOT NULL").select("batch_id", "items", "x.*").select(
        "batch_id", "pos", "record_id",
        F.get("items", F.col("item"))["rule_id"].alias("rule_id"),
        F.coalesce(_get(v, "is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.coalesce(_get(v, "error_type"), F.lit("")).alias("error_type"),
        F.coalesce(_get(v, "confidence"), F.lit("LOW")).alias("confidence"),
        F.when(_get(v, "evidence", "variant").isNotNull(), _get(v, "evidence")).otherwise(_get(v, "reasoning")).alias("reasoning"),
        F.try_variant_get("v", "$.suggested_correction", "map<string,string>").alias("suggested_correction")))

    def failure(record_id, rule_id, error):
        return F.struct(record_id.alias("record_id"), rule_id.alias("rule_id"), error.alias("error"))

    def left_over(said):
        def of(e):
            # The reasons "JSON parse error" and "Missing evidence field".
            unanswered = F.transform(F.filter(F.transform("items", lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda i: ~F.array_contains(e["judged"], i["k"])),
                                     lambda i: failure(i["i"]["record_id"], i["i"]["rule_id"], F.when(
                                         F.array_contains(e["touched"], i["k"]), F.lit("Missing evidence field")).otherwise(F.lit("No answer"))))
            unasked = F.transform(F.filter(e["said"], lambda x: x["item"].isNull()), lambda x: failure(x["record_id"], _get(x["v"], "rule_id"), F.lit(UNASKED)))
            return F.concat(F.coalesce(unanswered, F.array().cast(FAILURES)), unasked)

        def items(found):
            return F.array_compact(F.transform(found, lambda x: x["item"]))

        lost = F.transform("items", lambda i: failure(i["record_id"], i["rule_id"], F.coalesce("error", F.lit("JSON parse error"))))
        return F.when(said.isNull(), lost).otherwise(_once(F.struct(
            said.alias("said"), items(said).alias("touched"), items(F.filter(said, lambda x: x["grounded"])).alias("judged")), of))

    failures = (responses.select("batch_id", "analysis_type", F.explode_outer(_once(_said(), left_over)).alias("x"))
                .filter("x IS NOT NULL").select("batch_id", "analysis_type", "x.*"))
    return judgments, failures


def failure_reasons(failures: DataFrame) -> DataFrame:
    return failures.filter(F.col("error").isNotNull() & (F.col("error") != "")).select("error").distinct()


def token_cost(responses: DataFrame) -> DataFrame:
    """Tokens and price over all calls."""
    from ..functions.cells import cost_usd

    return (responses.agg(F.count("*").alias("calls"),
                          F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
                          F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
            .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
            .withColumn("cost_usd", F.round(cost_usd(F.col("input_tokens"), F.col("output_tokens")), 6)))
