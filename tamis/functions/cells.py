"""Column functions that give untyped-cell semantics to typed Spark columns.

Rules are written against loosely typed records (JSON lines, CSV), so numbers,
texts and times are compared the way a Python reader of those records would.
Everything here is a built-in Spark expression; nothing leaves the JVM.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, functions as F, types as T

# The time formats tried, in this order, when a rule names none.
DEFAULT_TIME_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y%m%d%H%M%S", "%H:%M:%S")

# Korean address markers (road: "-ro"/"-gil" + number; lot: "-dong"/"-ri"/"-ga"
# + number, or a hyphenated lot number).
ROAD_PATTERN = r"(로|길)\s*\d+"
JIBUN_PATTERN = r"(동|리|가)\s*\d+|\d+-\d+"

# What Python's float() accepts, leading and trailing blanks aside.
_DIGITS = r"\d(?:_?\d)*"
_FLOAT_TEXT = (
    rf"(?i)\A[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)\z"
)
_INT_TEXT = rf"\A[+-]?{_DIGITS}\z"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


# --- regular expressions ---------------------------------------------------

def java_pattern(pattern: str) -> str:
    """Check a Python pattern on the driver and respell it for the JVM.

    Spark reports a bad pattern only once tasks run, so both engines compile it here first. In a class of the JVM a
    bracket opens another class and && intersects; in Python both are plain characters.
    """
    re.compile(pattern)
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    pattern = _plain_classes(pattern.replace(r"\Z", r"\z"))
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(f"(?U){pattern}")
        except Py4JJavaError as e:
            raise ValueError(f"the JVM cannot read the pattern: {e.java_exception.getMessage()}") from None
    return pattern


def _plain_classes(pattern: str) -> str:
    out, at, opened = [], 0, None  # opened: where the class's members begin
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        if opened is None:
            if char == "[":
                opened = at + (2 if pattern[at + 1:at + 2] == "^" else 1)
                out.append(pattern[at:opened])
                at = opened
                continue
        elif char == "]" and at > opened:
            opened = None
        elif char in "[]&":
            char = "\\" + char
        out.append(char)
        at += 1
    return "".join(out)


def full_match(col: Column, pattern: str) -> Column:
    """True when the whole text matches; ``rlike`` alone is a search and lets a newline pass."""
    return col.rlike(rf"(?U)\A(?:{java_pattern(pattern)})\z")


def search(col: Column, pattern: str) -> Column:
    return col.rlike(f"(?U){java_pattern(pattern)}")


# --- numbers ---------------------------------------------------------------

def to_number(col: Column, dtype: T.DataType) -> Column:
    """Lenient double of a cell; NULL where the cell does not read as a number."""
    if is_numeric(dtype):
        return col.cast("double")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        text = F.btrim(col, F.lit(" \t\n\r\f\v"))
        plain = F.regexp_replace(text, "_", "")
        return F.when(text.rlike(_FLOAT_TEXT), plain.try_cast("double"))
    return F.lit(None).cast("double")


def float_text(col: Column) -> Column:
    """Text of a double as Python prints it (``12345678.9``, ``1e+16``, ``1e-05``).

    Spark switches to an exponent at 1e7 and below 1e-3, Python at 1e16 and below 1e-4. Older
    JVMs print some doubles with digits too many: 16 are taken if they read back the same, else 17
    (for one large double in a thousand the last digit then differs; it always reads back the same).
    38 decimal digits with 22 behind the point hold every double printed without exponent.
    """
    raw, size = col.cast("string"), F.abs(col)
    short = F.format_string("%.15e", col)
    text = (F.when(F.length(raw) < 18, F.replace(raw, F.lit("E"), F.lit("e")))
            .when(short.try_cast("double") == col, short).otherwise(F.format_string("%.16e", col)))
    plain = F.regexp_replace(text.cast("decimal(38,22)").cast("string"), r"(?<!\.)0+\z", "")
    power = F.regexp_replace(F.regexp_replace(text, r"\.?0+(?=e)", ""), r"e(?=\d)", "e+")
    power = F.regexp_replace(power, r"e([+-])(\d)\z", "e$10$2")
    return (F.when(col.isNull(), None).when(~text.contains("e"), F.replace(F.replace(text, F.lit("Infinity"), F.lit("inf")),
                                                  F.lit("NaN"), F.lit("nan")))
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(power))


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell as ``str(value)`` would give it; NULL stays NULL."""
    if isinstance(dtype, T.DoubleType):
        return float_text(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return col.cast("string")


# --- times -----------------------------------------------------------------

# directive -> (shape, Spark letters alone, Spark letters next to another number)
_DIRECTIVES = {
    "Y": (r"(?!0000)\d{4}", "yyyy", "yyyy"),  # there is no year 0
    "m": (r"\d{1,2}", "M", "MM"),
    "d": (r"\d{1,2}", "d", "dd"),
    "H": (r"\d{1,2}", "H", "HH"),
    "M": (r"\d{1,2}", "m", "mm"),
    "S": (r"\d{1,2}", "s", "ss"),
    "f": (r"\d{1,6}", "SSSSSS", "SSSSSS"),
}


def _time_format(fmt: str) -> tuple[str, str, str]:
    """(guard regex, Spark pattern, prefix) of one strptime-style format."""
    pieces = re.findall(r"%(.)|([^%]+)", fmt)
    shape, letters, seen = [], [], []
    for i, (directive, text) in enumerate(pieces):
        if text:
            shape.append(r"\s+" if text.isspace() else re.escape(text))
            letters.append("".join(f"'{c}'" if c.isalpha() else c for c in text))
            continue
        if directive not in _DIRECTIVES:
            raise ValueError(f"unsupported directive %{directive} in time format {fmt!r}")
        near = (i > 0 and pieces[i - 1][0]) or (i + 1 < len(pieces) and pieces[i + 1][0])
        guard, alone, packed = _DIRECTIVES[directive]
        shape.append(re.sub(r"\{1,", "{", guard) if near and directive != "f" else guard)
        letters.append(packed if near else alone)
        seen.append(directive)
    # A format without a year means 1900, the same default strptime has.
    prefix = "" if "Y" in seen else "1900 " if {"m", "d"} & set(seen) else "1900-1-1 "
    lead = "" if "Y" in seen else "yyyy " if {"m", "d"} & set(seen) else "yyyy-M-d "
    return rf"\A{''.join(shape)}\z", lead + "".join(letters), prefix


def parse_time(text: Column, formats=None) -> Column:
    """First format that parses wins; NULL when none does.

    Each format is tried only on text of its shape: a failed parse costs a JVM exception, which
    at billions of rows is far dearer than the regex. The trailing zone makes the result
    independent of the session time zone.
    """
    tries = []
    for fmt in formats or DEFAULT_TIME_FORMATS:
        shape, letters, prefix = _time_format(fmt)
        value = F.regexp_replace(text, r"\s+", " ") if " " in fmt else text
        value = F.concat(F.lit(prefix), value, F.lit(" Z"))
        tries.append(F.when(text.rlike(shape), F.try_to_timestamp(value, F.lit(letters + " X"))))
    return F.coalesce(*tries)


# --- addresses, keys, masks --------------------------------------------------

def address_kind(text: Column) -> Column:
    """road / jibun when exactly one marker is present, else ambiguous."""
    road, jibun = search(text, ROAD_PATTERN), search(text, JIBUN_PATTERN)
    return (F.when(road & ~jibun, "road").when(jibun & ~road, "jibun").otherwise("ambiguous"))


def mask_prefix(col: Column, visible: int = 5) -> Column:
    return F.when(F.length(col) <= visible, "****").otherwise(
        F.concat(F.left(col, F.lit(visible)), F.lit("****")))


def record_key_json(*names: str) -> Column:
    """Stable JSON of key columns: names sorted, NULLs kept."""
    return F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in sorted(names)]),
                     {"ignoreNullFields": "false"})


def clean_record_id(col: Column) -> Column:
    """Undo ids exported as a printed dict, ``{'record_id': '98'}`` -> ``98``."""
    inner = F.regexp_extract(col, r"""['"]record_id['"]\s*:\s*['"]([^'"]+)['"]""", 1)
    return F.when(inner != "", inner).otherwise(col)


def pattern_key(error_type="error_type", rule_id="rule_id", target_columns="target_columns") -> Column:
    """Key under which verdicts are cached: ``error_type:rule_id:col1,col2``."""
    return F.concat_ws(":", F.coalesce(F.col(error_type), F.lit("")), F.coalesce(F.col(rule_id), F.lit("")),
                       F.concat_ws(",", F.col(target_columns)))


def csv_cell_type(col: Column, null="null", integer="integer", real="float", string="string") -> Column:
    """What a CSV cell reads as: null, integer, float or string, or what is given for each."""
    text = F.btrim(col, F.lit(" \t\n\r\f\v"))
    return (F.when(col.isNull() | (col == ""), null)
            .when(text.rlike(_INT_TEXT), integer)
            .when(text.rlike(_FLOAT_TEXT), real)
            .otherwise(string))


def contains_text(columns: list[Column], needle: str) -> Column:
    """Case-insensitive: does any of the text columns contain the needle?"""
    hit = F.lit(False)
    for col in columns:
        hit = hit | F.coalesce(F.lower(col).contains(needle.lower()), F.lit(False))
    return hit


def cost_usd(input_tokens: Column, output_tokens: Column) -> Column:
    # 3 USD per million tokens in, 15 USD per million out.
    return input_tokens / 1_000_000 * 3 + output_tokens / 1_000_000 * 15
