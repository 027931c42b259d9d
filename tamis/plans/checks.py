"""Rules compiled to Column expressions.

A rule becomes one or more checks, a check being a boolean "violated" Column plus what to say
about the row. Types are settled here, on the driver, against the schema of the table: text is
never compared with a number at run time (which ANSI mode would refuse), and a column that the
table lacks reads as missing.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..functions import cells
from .rules import Rule, enabled

log = logging.getLogger(__name__)

ADDRESS_TOOLS = ("address_normalize", "address_classify")
DEFERRED = "Address type ambiguous — deferred to LLM Analyzer"  # fixed value: reason text


@dataclass
class Check:
    rule: Rule
    columns: list[str]
    violated: Column            # never NULL
    checked: Column             # the check applied to this row; never NULL
    current: list               # [(column name, text Column)]
    reason: str | Column        # a Column only where the row decides
    severity: str | Column

    def current_values(self) -> Column:
        pairs = []
        for name, text in self.current:
            pairs += [F.lit(name), text]
        return F.create_map(*pairs).cast("map<string,string>")


class Table:
    """Typed access to the columns of the table under check; absent columns read as NULL.

    ``derive`` names values that several checks need (parsed times, address kinds): they become
    columns of a projection below the checks, so each is computed once per row.
    """

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.derived: dict[str, Column] = {}
        self._columns: dict = {}  # building a Column is a round trip to the JVM; keep them

    def derive(self, what: str, build) -> Column:
        if what not in self.derived:
            self.derived[what] = build()
        return F.col(f"`{what}`")

    def __contains__(self, name):
        return name in self.types

    def dtype(self, name) -> T.DataType:
        return self.types.get(name, T.StringType())

    def col(self, name) -> Column:
        if name not in self._columns:
            self._columns[name] = F.col(f"`{name}`") if name in self.types else F.lit(None).cast("string")
        return self._columns[name]

    def text(self, name) -> Column:
        if ("text", name) not in self._columns:
            self._columns["text", name] = cells.cell_text(self.col(name), self.dtype(name))
        return self._columns["text", name]

    def member(self, name, values) -> Column:
        """Type-strict membership: '1' is not 1, but 1.0 and True are."""
        col, dtype = self.col(name), self.dtype(name)
        if cells.is_numeric(dtype):
            numbers = [v for v in values if isinstance(v, (int, float))]
            if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
                keep, col = [float(v) for v in numbers], col.cast("double")
            else:
                keep, col = [int(v) for v in numbers if float(v).is_integer()], col.cast("long")
        elif isinstance(dtype, T.BooleanType):
            keep = [bool(v) for v in values if isinstance(v, (int, float)) and v in (0, 1)]
        else:
            keep = [v for v in values if isinstance(v, str)]
            col = cells.cell_text(col, dtype)
        hit = F.coalesce(col.isin(keep), F.lit(False)) if keep else F.lit(False)
        return hit | col.isNull() if None in values else hit

    def compare(self, name, op, value) -> Column:
        """``column <op> literal`` as a boolean that is false on missing or unlike types."""
        col, dtype = self.col(name), self.dtype(name)
        if op in ("eq", "neq"):
            same = self.member(name, [value])
            return same if op == "eq" else ~same
        number_side = cells.is_numeric(dtype) or isinstance(dtype, T.BooleanType)
        if isinstance(value, (int, float)) != number_side or value is None:
            return F.lit(False)
        if number_side:
            col = cells.to_number(col, dtype)
            value = float(value)
        else:
            col = cells.cell_text(col, dtype)
        test = {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[op]
        if number_side:
            test = test & ~F.isnan(col)
        return F.coalesce(test, F.lit(False))


def _constraint_text(allowed, low, high) -> str:
    parts = [f"allowed:{allowed}"] if allowed is not None else []
    parts += [f"{name}:{v}" for name, v in (("min", low), ("max", high)) if v is not None]
    return ", ".join(parts) or "no_constraint"


def _value_check(rule, table, name, reason, violated, nullable) -> Check:
    present = table.col(name).isNotNull()
    violated = present & violated
    text = table.text(name)
    if not nullable:
        violated = ~present | violated
        text = F.coalesce(text, F.lit("null"))
    return Check(rule, [name], violated, present, [(name, text)], reason, rule.severity)


def _once(shown):
    """A pair per column name: a rule may name a column twice."""
    return list(dict(reversed(shown)).items())[::-1]


def range_checks(rule: Rule, table: Table) -> list[Check]:
    p = rule.params
    allowed, low, high = p.get("allowed_values"), p.get("min_value"), p.get("max_value")
    out = []
    for name in rule.target_columns:
        bad = F.lit(False)
        if allowed:  # an empty list is no constraint
            bad = bad | ~table.member(name, allowed)
        if low is not None or high is not None:
            number = cells.to_number(table.col(name), table.dtype(name))
            outside = F.lit(False)
            if low is not None:
                outside = outside | (number < float(low))
            if high is not None:
                outside = outside | (number > float(high))
            # Unreadable numbers violate; NaN is neither below nor above (Spark orders it last).
            bad = bad | number.isNull() | F.coalesce(~F.isnan(number) & outside, F.lit(False))
        out.append(_value_check(rule, table, name, _constraint_text(allowed, low, high), bad,
                                p.get("nullable", True)))
    return out


def format_checks(rule: Rule, table: Table) -> list[Check]:
    pattern = rule.params.get("pattern")
    if not pattern:
        return []
    out = []
    for name in rule.target_columns:
        bad = F.coalesce(~cells.full_match(table.text(name), pattern), F.lit(False))
        out.append(_value_check(rule, table, name, f"pattern:{pattern}", bad, rule.params.get("nullable", True)))
    return out


def _times(rule: Rule, table: Table):
    first, second = rule.target_columns[:2]
    earlier = rule.params.get("earlier_column", first)
    later = rule.params.get("later_column", second)
    formats = rule.params.get("time_formats")

    def parsed(name):
        if isinstance(table.dtype(name), (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return table.col(name).cast("timestamp_ntz").cast("timestamp")
        return table.derive(f"_time:{name}:{formats}", lambda: cells.parse_time(table.text(name), formats))

    return earlier, later, parsed(earlier), parsed(later)


def temporal_checks(rule: Rule, table: Table) -> list[Check]:
    if len(rule.target_columns) < 2:
        return []
    earlier, later, start, end = _times(rule, table)
    # Equal times violate unless the rule says otherwise.
    wrong = start >= end if rule.params.get("strict", True) else start > end
    first, second = rule.target_columns[:2]
    return [Check(rule, [first, second], F.coalesce(wrong, F.lit(False)),
                  start.isNotNull() & end.isNotNull(),
                  [(first, table.text(earlier)), (second, table.text(later))],
                  f"{earlier} < {later}", rule.severity)]


def parse_failure_column(rule: Rule, table: Table) -> Column:
    """Struct(column, value) of the first time that would not parse, else NULL."""
    earlier, later, start, end = _times(rule, table)
    both = table.col(earlier).isNotNull() & table.col(later).isNotNull()

    def failure(name):
        return F.struct(F.lit(name).alias("column_name"), table.text(name).alias("value"))

    return F.when(both & start.isNull(), failure(earlier)).when(both & end.isNull(), failure(later))


def address_checks(rule: Rule, table: Table) -> list[Check]:
    address, flag = rule.target_columns[:2]
    if address not in table:
        return []
    # A missing value reads as the text "None": ambiguous address, wrong flag.
    text = F.coalesce(table.text(address), F.lit("None"))
    flag_text = F.coalesce(table.text(flag), F.lit("None"))
    kind = table.derive(f"_address:{address}", lambda: cells.address_kind(text))
    mismatch = ((kind == "road") & (flag_text != "1")) | ((kind == "jibun") & (flag_text != "0"))
    return [Check(
        rule, [address, flag], (text != "") & ((kind == "ambiguous") | mismatch), text != "",
        _once([(address, text), (flag, table.text(flag))]),
        F.when(kind == "ambiguous", F.lit(DEFERRED)).otherwise(
            F.concat(F.lit("Address is "), kind, F.lit(f" type but {flag}="), flag_text)),
        F.when(kind == "ambiguous", F.lit("info")).otherwise(F.lit(rule.severity)))]


def conditional_checks(rule: Rule, table: Table) -> list[Check]:
    out = []
    for cond in rule.params.get("conditions", []):
        when_name, check_name = cond.get("when_column", ""), cond.get("check_column", "")
        op, value = cond.get("check_op", ""), cond.get("check_value")
        applies = table.member(when_name, cond.get("when_values", []))
        if op in ("eq", "neq", "gt", "gte", "lt", "lte"):
            bad = ~table.compare(check_name, op, value)
        elif op in ("contains", "contains_column"):
            wanted = F.lit(str(value)) if op == "contains" else table.text(str(value))
            bad = F.coalesce(~F.contains(table.text(check_name), wanted), F.lit(False))  # nothing to look in, or for: no violation
        elif op == "neq_column":
            bad = F.coalesce(table.text(check_name) == table.text(str(value)), F.lit(False))
        else:
            bad = F.lit(False)  # an unknown operator never violates
        out.append(Check(
            rule, list(rule.target_columns[:2]), applies & bad, applies,
            _once([(when_name, table.text(when_name)), (check_name, table.text(check_name))]),
            cond.get("reason", "Cross-column condition violation"), rule.severity))
    return out


def differ_checks(rule: Rule, table: Table) -> list[Check]:
    """Two columns that should differ (or agree) with each other."""
    a, b = rule.target_columns[:2]
    both = table.col(a).isNotNull() & table.col(b).isNotNull()
    same = F.coalesce(table.text(a) == table.text(b), F.lit(False))
    differ = rule.params.get("should_differ", True)
    return [Check(rule, [a, b], both & (same if differ else ~same), both,
                  _once([(a, table.text(a)), (b, table.text(b))]),
                  f"{a} {'!=' if differ else '=='} {b}", rule.severity)]


def predicate_checks(rule: Rule, table: Table) -> list[Check]:
    """A test of the user's own: ``condition`` is text, ``predicate`` a function of the typed table that gives a boolean Column.

    Rows for which it holds violate; NULL does not.
    """
    if callable(rule.params.get("predicate")):
        bad, text = rule.params["predicate"](table), rule.description or "custom predicate"
    elif rule.params.get("condition"):
        from .conditions import condition_column

        text = rule.params["condition"]
        bad = condition_column(text, T.StructType([T.StructField(k, v) for k, v in table.types.items()]), rule.target_columns)
    else:
        return []
    names = list(dict.fromkeys(rule.target_columns))
    return [Check(rule, names, F.coalesce(bad, F.lit(False)), F.lit(True), [(n, table.text(n)) for n in names],
                  rule.params.get("reason", text), rule.severity)]


def compile_rule(rule: Rule, table: Table) -> list[Check]:
    """The error type picks the family; only the cross-column family looks at the tool name."""
    if rule.error_type == "out_of_range":
        return range_checks(rule, table)
    if rule.error_type == "format_inconsistency":
        return format_checks(rule, table)
    if rule.error_type == "temporal_violation":
        return temporal_checks(rule, table)
    if rule.validation_tool == "custom_check" and rule.params.get("check_type") != "equality":
        return predicate_checks(rule, table)
    if len(rule.target_columns) < 2:
        return []
    if rule.validation_tool in ADDRESS_TOOLS:
        return address_checks(rule, table)
    if rule.validation_tool == "value_condition":
        return conditional_checks(rule, table)
    if rule.validation_tool == "custom_check":
        return differ_checks(rule, table)
    return []


_FAMILY_ORDER = {"out_of_range": 0, "format_inconsistency": 1, "temporal_violation": 2,
                 "cross_column_inconsistency": 3}


def compile_rules(rules, schema: T.StructType | Table) -> list[list[Check]]:
    """Checks grouped by rule, families in reporting order."""
    groups, errors = _compiled(rules, schema)
    for rule_id, error in errors:
        log.warning("rule %s does not run: %s", rule_id, error)
    return groups


def rule_errors(rules, schema: T.StructType | Table) -> list[tuple[str, str]]:
    """(rule id, what is wrong) of enabled rules that cannot run at all; they stop no other rule."""
    return _compiled(rules, schema)[1]


def _compiled(rules, schema):
    table = schema if isinstance(schema, Table) else Table(schema)
    groups, errors = [], []
    for rule in sorted(enabled(rules), key=lambda r: _FAMILY_ORDER[r.error_type]):
        try:
            checks = compile_rule(rule, table)
        except (re.error, ValueError, KeyError, TypeError) as e:
            errors.append((rule.rule_id, f"{type(e).__name__}: {e}"))
            continue
        if checks:
            groups.append(checks)
        elif all(c in table.types for c in rule.target_columns):
            errors.append((rule.rule_id, "no check follows from its tool, columns and parameters"))
    return groups, errors
