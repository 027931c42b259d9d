"""Many rules as data: sorted bounds and value lists per column instead of an expression per rule.

Range rules and comparisons with a number are kept, per column, as one ascending list of bounds beside the numbers of their checks. For a
row one binary search finds its place in the list, and the checks it violates are all on one side of that place: a slice. Lists of allowed
values become one ascending list of all values a column's checks allow, with the checks that allow each; the checks that refuse a
value are the others. Patterns of a column are first tried together, in one expression that looks ahead for each; only what fails
it is tried against each pattern by itself. So a row costs a few steps per list, however many rules there are, and then as much as it has
violations. Lists are constants of the plan; searches are unrolled into projections of plain expressions, one per halving, so they stay
in generated code. The outcome is that of the expressions in ``checks``.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import cells
from .checks import Check, Table, _constraint_text, _once
from .rules import Rule, enabled

#: Checks of one kind on a column from which a search is cheaper than as many expressions.
FEW = 8
#: Patterns tried together.
TOGETHER = 32
_ORDERED = ("gt", "gte", "lt", "lte")


def _constant(values: list, kind: str) -> Column:
    """A literal array; folded once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{kind}>")


@dataclass
class _Search:
    """A sorted list and how far a row's value reaches into it: past the smaller ones, and past equal ones if ``equal``."""
    values: list
    kind: str
    value: Column
    equal: bool
    name: str = ""
    at: str = ""

    def passed(self, k: int) -> Column:
        """Whether the value goes past the element ``k`` steps on."""
        element, value = F.get(_constant(self.values, self.kind), F.col(self.at) + (k - 1)), F.col(self.name)
        return F.coalesce(element <= value if self.equal else element < value, F.lit(False))


@dataclass
class RuleIndex:
    """``checks``: what to say about each check, numbered from ``first``."""
    table: Table
    first: int
    checks: list[Check] = field(default_factory=list)  # ``violated`` says nothing there; equal ``checked`` are one object
    _searches: list[_Search] = field(default_factory=list)
    _found: list = field(default_factory=list)  # functions giving (whether any, numbers) once places are known
    _rule: dict = field(default_factory=dict)
    _several: bool = False  # whether a rule has several checks
    _overlap: bool = False  # whether a check is in several lists

    def mark(self, df: DataFrame, first_only: bool, name: str) -> DataFrame:
        """``df`` with a column ``name``: the numbers of the checks a row violates; with ``first_only`` the least of each rule."""
        searches = [s for s in self._searches if s.values]
        df = df.withColumns({s.name: s.value for s in searches})
        df = df.withColumns({s.at: F.lit(0) for s in searches})
        step = 1 << max((len(s.values).bit_length() for s in searches), default=0)
        while step:
            moves = {s.at: F.col(s.at) + F.when(s.passed(step), F.lit(step)).otherwise(F.lit(0)) for s in searches if len(s.values) >= step}
            if moves:
                df = df.withColumns(moves)
            step >>= 1
        found = [f() for f in self._found]
        parts = {f"{name}{i}": F.when(hit, numbers) for i, (hit, numbers) in enumerate(found)}
        df = df.withColumns(parts)
        none, every, whole = F.array().cast("array<int>"), f"{name}_every", F.lit(False)
        for p in parts:
            whole = whole | F.col(p).isNotNull()
        joined = F.concat(*[F.coalesce(F.col(p), none) for p in parts])
        if self._overlap:
            joined = F.array_distinct(joined)
        if first_only and self._several:
            # a rule's checks have consecutive numbers
            rule_of = _constant([self._rule[c.rule.rule_id] for c in self.checks], "int")
            df = df.withColumn(every, F.when(whole, F.array_sort(joined)))

            def rule(n):
                return F.get(rule_of, n - self.first)

            joined = F.filter(every, lambda n, i: (i == 0) | (rule(n) != rule(F.get(F.col(every), i - 1))))
        return (df.withColumn(name, F.when(whole, joined).otherwise(none))
                .drop(every, *parts, *[c for s in searches for c in (s.name, s.at)]))

    # --- building ------------------------------------------------------------------

    def _add(self, check: Check) -> int:
        self.checks.append(check)
        self._rule.setdefault(check.rule.rule_id, len(self._rule))
        return self.first + len(self.checks) - 1

    def _search(self, values, kind, value, equal) -> _Search:
        i = len(self._searches)
        self._searches.append(_Search(values, kind, value, equal, f"_value{self.first}_{i}", f"_place{self.first}_{i}"))
        return self._searches[-1]

    def _bounds(self, number: Column, applies: Column, pairs, equal: bool, above: bool, unread: bool):
        """Checks violated by a number on the wrong side of their bound: by those ``above`` what the search passes, or by those it passes.

        ``unread``: missing numbers and NaN violate all; otherwise only missing ones do.
        """
        pairs = sorted(pairs)
        search = self._search([b for b, _ in pairs], "double", number, equal)
        numbers, n = [c for _, c in pairs], len(pairs)

        def found():
            at, value, ids = F.col(search.at), F.col(search.name), _constant(numbers, "int")
            odd = F.coalesce(F.isnan(value), F.lit(False))
            lost = value.isNull() | odd if unread else value.isNull()
            some = (at < n) if above else (at > 0)
            part = F.slice(ids, at + 1, n - at) if above else F.slice(ids, F.lit(1), at)
            return applies & (lost | ~odd & some), F.when(lost, ids).otherwise(part)

        self._found.append(found)

    def _allowed(self, name: str, lists):
        """Checks whose list of allowed values lacks the value; lists: (values, number)."""
        dtype = self.table.dtype(name)
        value, kind, _ = _typed(self.table, name, dtype)
        allow = defaultdict(list)
        for values, number in lists:
            for v in set(values):
                allow[v].append(number)
        order = sorted(allow, key=(lambda v: v.encode()) if kind == "string" else None)
        search = self._search(order, kind, value, False)
        every = sorted(n for _, n in lists)
        owners = [sorted(allow[v]) for v in order]

        def found():
            place = F.col(search.at) if order else F.lit(0)
            mine = F.get(_constant(owners, "array<int>"), place)
            same = F.coalesce(F.get(_constant(order, kind), place) == F.col(search.name), F.lit(False)) if order else F.lit(False)
            ids = _constant(every, "int")
            refused = F.when(same, F.array_except(ids, mine)).otherwise(ids)
            hit = ~same | (F.size(F.coalesce(mine, F.array().cast("array<int>"))) < len(every))
            return self.table.col(name).isNotNull() & hit, refused

        self._found.append(found)

    def _formats(self, name: str, pairs):
        """Checks whose pattern the text does not match; pairs: (pattern, number), at most TOGETHER."""
        text = self.table.text(name)
        ahead = "".join(rf"(?=(?:{cells.java_pattern(p)})\z)" for p in dict.fromkeys(p for p, _ in pairs))

        def found():
            failed = [F.when(~cells.full_match(text, p), F.lit(n)) for p, n in pairs]
            return F.coalesce(~text.rlike(rf"(?U)\A{ahead}"), F.lit(False)), F.array_compact(F.array(*failed))

        self._found.append(found)

    def _missing(self, name: str, numbers):
        """Checks that a missing value violates."""
        self._found.append(lambda: (self.table.col(name).isNull(), _constant(numbers, "int")))


def _typed(table: Table, name: str, dtype: T.DataType):
    """(the column as compared with allowed values, its kind, which values can be meant), as ``Table.member`` has it."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return table.col(name).cast("double"), "double", lambda vs: [float(v) for v in vs if isinstance(v, (int, float))]
    if cells.is_numeric(dtype):
        return table.col(name).cast("long"), "long", lambda vs: [int(v) for v in vs if isinstance(v, (int, float)) and float(v).is_integer()]
    return table.text(name), "string", lambda vs: [v for v in vs if isinstance(v, str)]


def _plain(x) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x) and abs(x) < 1 << 53


def _range_entry(rule: Rule, table: Table) -> bool:
    p = rule.params
    if rule.error_type != "out_of_range" or not rule.target_columns or len(set(rule.target_columns)) < len(rule.target_columns):
        return False
    if any(isinstance(table.dtype(c), T.BooleanType) or c not in table for c in rule.target_columns):
        return False
    allowed = p.get("allowed_values")
    if allowed is not None and not (isinstance(allowed, (list, tuple)) and all(v is None or isinstance(v, str) or _plain(v) for v in allowed)):
        return False
    return all(p.get(b) is None or _plain(p[b]) for b in ("min_value", "max_value"))


def _format_entry(rule: Rule, table: Table) -> bool:
    """Patterns that mean the same within a longer one: no numbered or named groups are referred to."""
    pattern = rule.params.get("pattern")
    if rule.error_type != "format_inconsistency" or not isinstance(pattern, str) or not pattern or any(c not in table for c in rule.target_columns):
        return False
    if re.search(r"\\[0-9kgQE]|\(\?[P<(]", pattern):
        return False
    try:
        cells.java_pattern(pattern)
    except (re.error, ValueError):
        return False
    return len(set(rule.target_columns)) == len(rule.target_columns) > 0


def _condition_entry(rule: Rule, table: Table) -> bool:
    conditions = rule.params.get("conditions", [])
    return (rule.error_type == "cross_column_inconsistency" and rule.validation_tool == "value_condition" and len(rule.target_columns) > 1
            and bool(conditions) and all(
                c.get("check_op") in _ORDERED and _plain(c.get("check_value")) and c.get("check_column") in table
                and cells.is_numeric(table.dtype(c["check_column"])) and c.get("when_column") in table for c in conditions))


def split_rules(rules, table: Table) -> tuple[list[Rule], list[Rule]]:
    """(rules that stay expressions, rules for an index): those whose columns have at least FEW checks of their kind."""
    rules = enabled(rules)
    groups: dict = defaultdict(int)

    def spots(rule):
        if _range_entry(rule, table):
            return [("range", c) for c in rule.target_columns]
        if _condition_entry(rule, table):
            return [("when", c["check_column"]) for c in rule.params["conditions"]]
        if _format_entry(rule, table):
            return [("format", c) for c in rule.target_columns]
        return []

    of = [(r, spots(r)) for r in rules]
    for _, places in of:
        for p in places:
            groups[p] += 1
    chosen = [r for r, places in of if places and all(groups[p] >= FEW for p in places)]
    ids = {id(r) for r in chosen}
    return [r for r in rules if id(r) not in ids], chosen


def build_index(rules, table: Table, first: int = 0) -> RuleIndex:
    """The index of rules that ``split_rules`` chose; its checks are numbered from ``first``."""
    index = RuleIndex(table, first)
    low, high, allowed, missing = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    whens, formats = defaultdict(list), defaultdict(list)
    texts, nothing, present, applies = {}, F.lit(False), {}, {}

    def shown(names):
        for n in names:
            texts.setdefault(n, (n, table.text(n)))
        return _once([texts[n] for n in names])

    def add_value(rule, name, reason):
        checked = present.setdefault(name, table.col(name).isNotNull())
        if rule.params.get("nullable", True):
            return index._add(Check(rule, [name], nothing, checked, shown([name]), reason, rule.severity))
        texts.setdefault(("null", name), (name, F.coalesce(table.text(name), F.lit("null"))))
        n = index._add(Check(rule, [name], nothing, checked, [texts["null", name]], reason, rule.severity))
        missing[name].append(n)
        return n

    for rule in rules:
        p = rule.params
        if rule.error_type == "out_of_range":
            index._several |= len(rule.target_columns) > 1
            reason = _constraint_text(p.get("allowed_values"), p.get("min_value"), p.get("max_value"))
            for name in rule.target_columns:
                n = add_value(rule, name, reason)
                if p.get("allowed_values"):
                    allowed[name].append((_typed(table, name, table.dtype(name))[2](p["allowed_values"]), n))
                index._overlap |= bool(p.get("allowed_values")) + (p.get("min_value") is not None) + (p.get("max_value") is not None) > 1
                for bound, lists in (("min_value", low), ("max_value", high)):
                    if p.get(bound) is not None:
                        lists[name].append((float(p[bound]), n))
        elif rule.error_type == "format_inconsistency":
            index._several |= len(rule.target_columns) > 1
            for name in rule.target_columns:
                n = add_value(rule, name, f"pattern:{p['pattern']}")
                formats[name].append((p["pattern"], n))
        else:
            index._several |= len(p["conditions"]) > 1
            for c in p["conditions"]:
                when = (c["when_column"], json.dumps(c.get("when_values", [])))
                if when not in applies:
                    applies[when] = table.member(c["when_column"], c.get("when_values", []))
                n = index._add(Check(rule, list(rule.target_columns[:2]), nothing, applies[when], shown([c["when_column"], c["check_column"]]),
                                     c.get("reason", "Cross-column condition violation"), rule.severity))
                whens[when, c["check_column"], c["check_op"]].append((float(c["check_value"]), n))
    for lists, above, equal in ((low, True, True), (high, False, False)):
        for name, pairs in lists.items():
            number = cells.to_number(table.col(name), table.dtype(name)).cast("double")
            index._bounds(number, table.col(name).isNotNull(), pairs, equal, above, unread=False)
    for name, lists in allowed.items():
        index._allowed(name, lists)
    for name, pairs in formats.items():
        for i in range(0, len(pairs), TOGETHER):
            index._formats(name, pairs[i:i + TOGETHER])
    for name, numbers in missing.items():
        index._missing(name, numbers)
    for (when, name, op), pairs in whens.items():
        number = cells.to_number(table.col(name), table.dtype(name)).cast("double")
        # gt: bounds from the value on are violated; gte: those above it; lt: those up to it; lte: those below it
        index._bounds(number, applies[when], pairs, op in ("gte", "lt"), op in ("gt", "gte"), unread=True)
    return index
