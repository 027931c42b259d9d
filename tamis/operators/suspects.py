"""Rule evaluation: every rule over every row in one scan, suspects out.

Nothing here shuffles the scanned rows. The suspects that come out are few; what is grouped
later is grouped with map-side combination, so a record or a rule holding a third of all
suspects never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.checks import Table, compile_rules, parse_failure_column
from ..plans.rule_index import build_index, split_rules
from ..plans.rules import by_error_type

SUSPECT_TYPES = (("rule_id", "string"), ("error_type", "string"), ("target_columns", "array<string>"),
                 ("current_values", "map<string,string>"), ("reason", "string"), ("severity", "string"))


WORD = 60  # checks per bit mask


def _with_derived(df: DataFrame, table: Table) -> DataFrame:
    return df.withColumns(table.derived) if table.derived else df


def _joined(columns: list[Column]) -> Column:
    """Balanced bitwise OR, so that hundreds of checks do not make a deep expression."""
    while len(columns) > 1:
        columns = [columns[i].bitwiseOR(columns[i + 1]) if i + 1 < len(columns) else columns[i]
                   for i in range(0, len(columns), 2)]
    return columns[0]


def _one_of(columns: list[Column]) -> Column:
    out = columns[0]
    for col in columns[1:]:
        out = out | col
    return out


def _masks(groups, first_only: bool):
    """(first check, last check, mask Column) per word of at most WORD checks.

    Bit i of a word stands for its i-th check. With ``first_only`` a rule sets one bit, that of
    its first violated check; a rule is kept within a word unless it alone is larger.
    """
    words, start, number = [], 0, 0
    bits: list[Column] = []

    def close():
        nonlocal start, bits
        if bits:
            words.append((start, number - 1, _joined(bits)))
        start, bits = number, []

    for group in groups:
        if number - start + len(group) > WORD:
            close()
        earlier: list[Column] = []
        for at in range(0, len(group), WORD):
            if number - start >= WORD:
                close()
            piece, case = group[at:at + WORD], None
            for c in piece:
                bit = F.lit(1 << (number - start)).cast("long")
                if case is None or not first_only:
                    if case is not None:
                        bits.append(case.otherwise(F.lit(0).cast("long")))
                    case = F.when(c.violated, bit)
                else:
                    case = case.when(c.violated, bit)
                number += 1
            case = case.otherwise(F.lit(0).cast("long"))
            if earlier and first_only:
                case = F.when(_one_of(earlier), F.lit(0).cast("long")).otherwise(case)
            bits.append(case)
            earlier += [c.violated for c in piece]
    close()
    return words


def _mark(df: DataFrame, groups, first_only: bool, index=None) -> DataFrame:
    """Rows with ``_check``, the number of a violated check; one row per violation.

    A row's violations are first gathered in bit masks, plain numbers inside generated code.
    Most rows are clean: their masks are 0 and nothing else is made for them. An index of rules adds the checks it finds.
    """
    words = _masks(groups, first_only)
    names = [f"_mask{w}" for w in range(len(words))]

    def numbers(name, first, last):
        """The checks whose bits are set."""
        mask = F.col(name)
        return F.when(mask == 0, F.array().cast("array<int>")).otherwise(
            F.filter(F.sequence(F.lit(first), F.lit(last)), lambda i: F.getbit(mask, i - first) == 1))

    found = [numbers(name, first, last) for name, (first, last, _) in zip(names, words)]
    if index is not None:
        df = index.mark(df, first_only, "_indexed")
        found.append(F.col("_indexed"))
    # explode_outer, as below a plain explode the optimizer would put a second copy of all checks
    # (a filter on the array's size); clean rows give one NULL, dropped by the filter.
    return (df.withColumns({n: mask for n, (_, _, mask) in zip(names, words)})
            .withColumn("_found", found[0] if len(found) == 1 else F.concat(*found))
            .withColumn("_check", F.explode_outer("_found"))
            .filter(F.col("_check").isNotNull()).drop("_found", "_indexed", *names))


def _describe(rows: DataFrame, checks, key: str, carry) -> DataFrame:
    """The suspect schema, from rows and their check numbers."""
    hit = F.col("_check")

    def label(values):
        """Constant text by check number: a lookup in a literal list."""
        return F.element_at(F.split(F.lit("\u0001".join(values)), "\u0001"), hit + 1)

    def by_check(groups):
        out = None
        for numbers, col in groups:
            test = hit == numbers[0] if len(numbers) == 1 else hit.isin(numbers)
            out = F.when(test, col) if out is None else out.when(test, col)
        return out

    def text_of(field):
        fixed = label([getattr(c, field) if isinstance(getattr(c, field), str) else "" for c in checks])
        own = [([i], getattr(c, field)) for i, c in enumerate(checks) if not isinstance(getattr(c, field), str)]
        return by_check(own).otherwise(fixed) if own else fixed

    # Checks that show the same values share one expression, however many rules there are.
    shown: dict = {}
    for i, c in enumerate(checks):
        shown.setdefault(tuple((name, id(text)) for name, text in c.current), []).append(i)
    values = [(numbers, checks[numbers[0]].current_values()) for numbers in shown.values()]

    return rows.select(
        F.col(f"`{key}`").cast("string").alias("record_id"),
        label([c.rule.rule_id for c in checks]).alias("rule_id"),
        label([c.rule.error_type for c in checks]).alias("error_type"),
        F.split(label(["\u0002".join(c.columns) for c in checks]), "\u0002").alias("target_columns"),
        by_check(values).alias("current_values"),
        text_of("reason").alias("reason"), text_of("severity").alias("severity"), *carry)


def _evaluate(df: DataFrame, rules, key: str, carry, first_only: bool) -> DataFrame:
    table = Table(df.schema)
    rest, many = split_rules(rules, table)
    groups = compile_rules(rest, table)
    checks = [c for g in groups for c in g]
    index = build_index(many, table, len(checks)) if many else None
    checks += index.checks if index else []
    if not checks:
        return df.limit(0).select(F.col(f"`{key}`").cast("string").alias("record_id"),
                                  *[F.lit(None).cast(k).alias(n) for n, k in SUSPECT_TYPES], *carry)
    return _describe(_mark(_with_derived(df, table), groups, first_only, index), checks, key, carry)


def find_suspects(df: DataFrame, rules, key: str = "record_id", carry=()) -> DataFrame:
    """One row per violated check (a rule over two columns can give two).

    ``carry`` names columns of the table to keep next to the suspect.
    """
    return _evaluate(df, rules, key, carry, first_only=False)


def find_first_suspects(df: DataFrame, rules, key: str = "record_id", unique_key: bool = True,
                        carry=()) -> DataFrame:
    """At most one suspect per (record, rule): the rule's first violated check.

    With unique keys the choice is made inside the row and nothing is shuffled. Otherwise the
    rows of a key are reduced with ``min_by``, combined map-side.
    """
    out = _evaluate(df, rules, key, carry, first_only=True)
    return out if unique_key else dedup_suspects(out)


def dedup_suspects(suspects: DataFrame) -> DataFrame:
    """One suspect per (record, rule) when record ids repeat across rows.

    The rows of a table have no first one, so the choice is by text: columns, then values.
    """
    payload = [c for c in suspects.columns if c not in ("record_id", "rule_id")]
    order = F.struct(F.concat_ws(",", "target_columns").alias("c"), F.to_json("current_values").alias("v"),
                     F.col("reason").alias("r"))
    best = F.min_by(F.struct(*payload), order).alias("p")
    return (suspects.groupBy("record_id", "rule_id").agg(best)
            .select("record_id", "rule_id", "p.*").select(*suspects.columns))


def parse_failures(df: DataFrame, rules, key: str = "record_id") -> DataFrame:
    """Times that no format could read: record, rule, column, value."""
    table, fails = Table(df.schema), []
    for r in by_error_type(rules, "temporal_violation"):
        if len(r.target_columns) >= 2:
            f = parse_failure_column(r, table)
            fails.append(F.when(f.isNotNull(), F.struct(
                F.lit(r.rule_id).alias("rule_id"), f["column_name"].alias("column_name"), f["value"].alias("value"),
                F.lit("Failed to parse timestamp").alias("error"))))
    return (_with_derived(df, table).withColumn("_fails", F.array(*fails))
            .select(F.col(f"`{key}`").cast("string").alias("record_id"), F.explode_outer("_fails").alias("f"))
            .filter("f is not null").select("record_id", "f.*"))


def rule_rates(df: DataFrame, rules, alert_above: float = 0.9) -> DataFrame:
    """Per rule and column set: violations, rows checked, rate, alert. One aggregate over one scan; rules of an index take another scan each
    for violations and for rows checked, with a row per check at most."""
    table = Table(df.schema)
    rest, many = split_rules(rules, table)
    checks = [c for g in compile_rules(rest, table) for c in g]
    sums, rows = [], []
    for i, c in enumerate(checks):
        sums += [F.count_if(c.violated).alias(f"v{i}"), F.count_if(c.checked).alias(f"c{i}")]
        rows.append(F.struct(F.lit(c.rule.rule_id).alias("rule_id"),
                             F.lit(",".join(c.columns)).alias("columns"), F.lit(i).alias("check_no"),
                             F.col(f"v{i}").alias("violation_count"), F.col(f"c{i}").alias("total_checked")))
    parts = [_with_derived(df, table).agg(*sums).select(F.inline(F.array(*rows)))] if checks else []
    if many:
        parts.append(_indexed_rates(df, build_index(many, table, len(checks))))
    if not parts:
        parts = [df.sparkSession.createDataFrame([], "rule_id string, columns string, check_no int, violation_count long, total_checked long")]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rate = F.col("violation_count") / F.greatest(F.col("total_checked"), F.lit(1))
    return out.withColumn("violation_rate", F.round(rate, 6)).withColumn("alert", rate > alert_above)


def _indexed_rates(df: DataFrame, index) -> DataFrame:
    kinds = list({id(c.checked): c.checked for c in index.checks}.values())
    place = {id(k): i for i, k in enumerate(kinds)}
    totals = df.agg(*[F.count_if(k).alias(f"c{i}") for i, k in enumerate(kinds)]).select(
        F.posexplode(F.array(*[f"c{i}" for i in range(len(kinds))])).alias("kind", "total_checked"))
    counts = (index.mark(df, False, "_indexed").select(F.explode_outer("_indexed").alias("check_no")).filter("check_no IS NOT NULL")
              .groupBy("check_no").agg(F.count("*").alias("violation_count")))
    labels = df.sparkSession.createDataFrame(
        [(c.rule.rule_id, ",".join(c.columns), index.first + i, place[id(c.checked)]) for i, c in enumerate(index.checks)],
        "rule_id string, columns string, check_no int, kind int")
    return (labels.join(F.broadcast(totals), "kind").join(F.broadcast(counts), "check_no", "left")  # a row per check at most
            .select("rule_id", "columns", "check_no", F.coalesce("violation_count", F.lit(0)).alias("violation_count"), "total_checked"))


def counts_by(suspects: DataFrame, column: str) -> DataFrame:
    return suspects.groupBy(column).agg(F.count("*").alias("n"))


def counts_by_type_and_severity(suspects: DataFrame) -> DataFrame:
    """Both counts in one pass over the suspects."""
    return (suspects.groupBy("error_type", "severity").agg(F.count("*").alias("n"))
            .groupingSets([["error_type"], ["severity"]], "error_type", "severity")
            .agg(F.sum("n").alias("n")))


def type_share(suspects: DataFrame) -> DataFrame:
    """Share of each error type in percent. The window runs over at most four counted rows."""
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts_by(suspects, "error_type").withColumn("percent", F.round(F.col("n") / total * 100, 4))


def suspect_ratio(total_rows: Column, suspects: Column) -> Column:
    return F.when(total_rows > 0, F.round(suspects / total_rows, 6)).otherwise(F.lit(0.0))


def add_delegated(suspects: DataFrame, delegated: DataFrame) -> DataFrame:
    """Suspects handed over by another stage, appended as they are."""
    return suspects.unionByName(delegated, allowMissingColumns=True)


def top_by_impact(scored: DataFrame, n: int) -> DataFrame:
    """The n suspects of highest impact (a limit that is the feature, kept per task and merged)."""
    return scored.orderBy(F.desc("impact_score"), "record_id", "rule_id").limit(n)


def rows_matching(df: DataFrame, needle: str, columns=None) -> DataFrame:
    """Free-text search, case-insensitive, over any cell."""
    from ..functions.cells import contains_text

    table = Table(df.schema)
    return df.filter(contains_text([table.text(c) for c in columns or df.columns], needle))
