"""Cross-column conditions written as text, turned into Columns.

A condition such as ``weight_kg > 20 AND item_category == '서류'`` may come from an outside
party, so it is never evaluated as code: only comparisons, and/or/not, ``in`` lists, literals,
column names and plain arithmetic are understood, anything else is refused. A condition that
would fail on a row (comparing text with a number, or with a missing value) is false there.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, functions as F, types as T

from ..functions.cells import is_numeric

# A value is (kind, Column); kind is num, calc (a computed number), text, bool, none or bad.
# A NULL test or a NULL computed number means "failed".


def _literal(value):
    if value is None:
        return "none", F.lit(None)
    if isinstance(value, bool):
        return "bool", F.lit(value)
    if isinstance(value, (int, float)):
        return "num", F.lit(value)
    if isinstance(value, str):
        return "text", F.lit(value)
    raise ValueError(f"unsupported literal {value!r}")


def _kind(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "num"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "text"


def _number(value):
    kind, col = value
    return col.cast("int") if kind == "bool" else col


def _same(a, b) -> Column:
    """``==``: never fails; missing equals missing; text never equals a number."""
    if "bad" in (a[0], b[0]):
        return F.lit(None).cast("boolean")
    for one, other in ((a, b), (b, a)):
        if one[0] == "calc":
            return F.when(one[1].isNotNull(), _same(("num", one[1]), other))
    if a[0] == "none":
        return b[1].isNull()
    if b[0] == "none":
        return a[1].isNull()
    if (a[0] == "text") != (b[0] == "text"):
        return a[1].isNull() & b[1].isNull()
    if a[0] == "text":
        return a[1].eqNullSafe(b[1])
    return _number(a).eqNullSafe(_number(b))


def _order(a, b, op) -> Column:
    """``<`` and friends: fail (NULL) on a missing value or on text against a number."""
    if {"none", "bad"} & {a[0], b[0]} or (a[0] == "text") != (b[0] == "text"):
        return F.lit(None).cast("boolean")
    x, y = (a[1], b[1]) if a[0] == "text" else (_number(a).cast("double"), _number(b).cast("double"))
    if a[0] == "text":
        return op(x, y)
    # NaN orders below nothing and above nothing.
    return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(~F.isnan(x) & ~F.isnan(y) & op(x, y))


def _truth(value) -> Column:
    kind, col = value
    if kind == "none":
        return F.lit(False)
    if kind == "bad":
        return F.lit(None).cast("boolean")
    if kind == "calc":
        return col != 0
    if kind == "bool":
        return F.coalesce(col, F.lit(False))
    present = (col != "") if kind == "text" else (col != 0)
    return F.coalesce(present, F.lit(False))


_COMPARE = {
    ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y,
    ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y,
}
_MATH = {
    ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y,
    ast.Div: lambda x, y: F.when(y != 0, x / y),
    ast.Mod: lambda x, y: F.when(y != 0, F.pmod(x, y)),
}


class _Reader:
    def __init__(self, schema: T.StructType, columns):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.columns = set(columns) if columns is not None else set(self.types)

    def value(self, node):
        if isinstance(node, ast.Constant):
            return _literal(node.value)
        if isinstance(node, ast.Name):
            if node.id not in self.columns:
                return "bad", F.lit(None)
            if node.id not in self.types:
                return "none", F.lit(None)
            col, kind = F.col(f"`{node.id}`"), _kind(self.types[node.id])
            return kind, col.cast("string") if kind == "text" else col
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            kind, col = self.value(node.operand)
            if kind not in ("num", "calc", "bool"):
                return "bad", F.lit(None)
            col = _number((kind, col))
            return "calc", -col if isinstance(node.op, ast.USub) else col
        if isinstance(node, ast.BinOp) and type(node.op) in _MATH:
            a, b = self.value(node.left), self.value(node.right)
            if not {a[0], b[0]} <= {"num", "calc", "bool"}:
                return "bad", F.lit(None)
            x, y = _number(a).cast("double"), _number(b).cast("double")
            return "calc", _MATH[type(node.op)](x, y)
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.UnaryOp)):
            return "bool", self.test(node)
        raise ValueError(f"not allowed in a condition: {ast.unparse(node)}")

    def test(self, node) -> Column:
        if isinstance(node, ast.BoolOp):
            # Left to right with early exit, so a failing right side does not matter once the
            # left side has decided; a failing left side fails the whole condition.
            tests = [self.test(v) for v in node.values]
            out = tests[-1]
            for left in reversed(tests[:-1]):
                out = (F.when(left.isNull(), F.lit(None).cast("boolean"))
                       .when(left, out if isinstance(node.op, ast.And) else F.lit(True))
                       .otherwise(F.lit(False) if isinstance(node.op, ast.And) else out))
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.test(node.operand)
        if isinstance(node, ast.Compare):
            out, left = None, self.value(node.left)
            for op, right_node in zip(node.ops, node.comparators):
                one = self.compare(op, left, right_node)
                out = one if out is None else F.when(out.isNull(), out).when(out, one).otherwise(F.lit(False))
                if not isinstance(op, (ast.In, ast.NotIn)):
                    left = self.value(right_node)
            return out
        return _truth(self.value(node))

    def compare(self, op, left, right_node) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right_node, (ast.List, ast.Tuple, ast.Set)):
                raise ValueError("'in' needs a literal list")
            hit = F.lit(False)
            for item in right_node.elts:
                hit = hit | _same(left, self.value(item))
            return ~hit if isinstance(op, ast.NotIn) else hit
        right = self.value(right_node)
        if isinstance(op, (ast.Eq, ast.Is)):
            return _same(left, right)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~_same(left, right)
        return _order(left, right, _COMPARE[type(op)])


def condition_column(condition: str, schema: T.StructType, columns=None) -> Column:
    """Boolean Column (never NULL) of a textual condition over the given columns."""
    text = condition.replace(" AND ", " and ").replace(" OR ", " or ")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return F.lit(False)
    return F.coalesce(_Reader(schema, columns).test(tree), F.lit(False))
