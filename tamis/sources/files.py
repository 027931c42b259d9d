"""Files to DataFrames: JSON lines, JSON documents, CSV, typed-JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.cells import csv_cell_type

CORRUPT = "_corrupt_record"

WIDE = "decimal(38,0)"  # whole numbers beyond bigint


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, keep_bad_lines: bool = False) -> DataFrame:
    """One object per line. A bad line fails the read, or is kept in ``_corrupt_record``."""
    if not keep_bad_lines:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole files holding an array of objects or a single object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_csv_text(spark: SparkSession, path: str, line_breaks_in_cells: bool = False, keep_bad_records: bool = False) -> DataFrame:
    """CSV with a header, every cell as text, empty cells NULL (a leading BOM is dropped by Spark).

    A record with more or fewer cells than the header fails the read, or is kept in ``_corrupt_record`` with all
    cells NULL. So does a quoted line break, unless ``line_breaks_in_cells``: then whole files are tasks; without it
    files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks_in_cells).option("escape", '"')
    names = reader.csv(path).columns
    # With pruning Spark parses the wanted cells only, and a wrong number of them goes unseen.
    reader = reader.option("columnPruning", False)
    cells = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not keep_bad_records:
        return reader.schema(cells).option("mode", "FAILFAST").csv(path)
    read = (reader.schema(T.StructType([*cells.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return read.select(*[F.when(F.col(CORRUPT).isNull(), F.col(f"`{n}`")).alias(n) for n in names], CORRUPT)


def coerce_csv(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text cells to numbers where a whole column reads as such.

    ``types`` maps columns to integer / wide / float / string, as ``infer_schema(untyped=True)`` gives
    them; without it one aggregate over the table finds out.
    """
    if types is None:
        types = csv_types(df)
    plain = {"integer": "bigint", "wide": WIDE, "float": "double"}

    def cell(name):
        col, kind = F.col(f"`{name}`"), plain.get(types.get(name))
        col = F.when(col != "", col)
        if kind is None:
            return col.alias(name)
        return _bare(col).try_cast(kind).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def _bare(text: Column) -> Column:
    return F.translate(F.btrim(text, F.lit(" \t\n\r\f\v")), "_", "")


TYPE_BITS = {k: 1 << n for n, k in enumerate(("integer", "wide", "huge", "float", "string"))}


def _type_bits(df: DataFrame) -> DataFrame:
    """One row: per column the bits of all that its cells read as. A cell is read once, into its bit."""
    def bit(text):
        bare = _bare(text)
        whole = (F.when(bare.try_cast("bigint").isNotNull(), TYPE_BITS["integer"]).when(bare.try_cast(WIDE).isNotNull(), TYPE_BITS["wide"])
                 .otherwise(TYPE_BITS["huge"]))
        return csv_cell_type(text, 0, whole, TYPE_BITS["float"], TYPE_BITS["string"])

    read = df.select(*[bit(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    return read.agg(*[F.bit_or(f"_{i}").alias(f"_{i}") for i in range(len(df.columns))])


def csv_types(df: DataFrame) -> dict[str, str]:
    """Widest reading of each text column: one row comes back to the driver.

    Whole numbers that no bigint holds make a column ``wide`` (38 digits), longer ones leave it text.
    """
    seen = _type_bits(df).head()

    def kind_of(i):
        has = {k for k, b in TYPE_BITS.items() if (seen[f"_{i}"] or 0) & b}
        if "string" in has or not has:
            return "string"
        if "float" in has:
            return "float"
        return "string" if "huge" in has else "wide" if "wide" in has else "integer"

    return {c: kind_of(i) for i, c in enumerate(df.columns)}


# --- typed JSON ({"col": {"S": "x"}}) ----------------------------------------

def _typed_value(v: Column, dtype: T.DataType) -> Column:
    """The value under a type tag, read as the declared Spark type."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[_typed_value(F.try_variant_get(v, f"$.M.{f.name}", "variant"), f.dataType).alias(f.name)
                          for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(v, "$.L", "array<variant>")
        return F.transform(items, lambda x: _typed_value(x, dtype.elementType))
    kind = dtype.simpleString()
    if isinstance(dtype, T.BooleanType):
        return F.try_variant_get(v, "$.BOOL", "boolean")
    number = F.try_variant_get(v, "$.N", "string")
    if not isinstance(dtype, T.StringType):
        return F.coalesce(number, F.try_variant_get(v, "$.S", "string")).try_cast(kind)
    null = F.try_variant_get(v, "$.NULL", "boolean")
    return F.when(null, None).otherwise(F.coalesce(
        F.try_variant_get(v, "$.S", "string"), number,
        F.when(F.try_variant_get(v, "$.BOOL", "boolean"), "True").when(~F.try_variant_get(v, "$.BOOL", "boolean"), "False"),
        F.to_json(v)))  # lists, maps and other tags as JSON text


def read_typed_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    pattern: str = "*.json*", partitions: int | None = None, max_columns: int = 10_000) -> DataFrame:
    """Export files of a key-value store, gzip or not: one ``{"Item": {...}}`` or bare item per line.

    gzip files cannot be split, so each is one task; ``partitions`` spreads the rows afterwards.
    Without a schema the columns and their types are found by one pass (``typed_json_schema``); more than ``max_columns`` names, as of
    items with keys of their own, are an error.
    """
    raw = spark.read.option("pathGlobFilter", pattern).option("singleVariantColumn", "v").json(path)
    if partitions:
        raw = raw.repartition(partitions)
    item = F.coalesce(F.try_variant_get("v", "$.Item", "variant"), F.col("v"))
    raw = raw.select(item.alias("v"))
    if schema is None:
        schema = typed_json_schema(raw, max_columns)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return raw.select(*[_typed_value(F.try_variant_get("v", f"$['{f.name}']", "variant"), f.dataType).alias(f.name)
                        for f in schema.fields])


def typed_json_schema(items: DataFrame, max_columns: int = 10_000) -> T.StructType:
    """Columns and types present in the items: a small row per column comes to the driver, at most ``max_columns``."""
    tags = (items.select(F.explode(F.try_variant_get("v", "$", "map<string,map<string,variant>>"))
                         .alias("name", "cell"))
            .select("name", F.explode("cell").alias("tag", "x"))
            .groupBy("name").agg(F.collect_set("tag").alias("tags"),
                                 F.max(F.when(F.col("tag") == "N", F.to_json("x").contains("."))).alias("point"),
                                 *[F.max(F.when(F.col("tag") == "N", F.try_variant_get("x", "$", "string").try_cast(t).isNull())).alias(n)
                                   for n, t in (("wide", "bigint"), ("huge", WIDE))])
            .limit(max_columns + 1).collect())
    if len(tags) > max_columns:
        raise ValueError(f"the items have more than {max_columns} attribute names: give a schema, with a map for those")
    fields = []
    for r in sorted(tags, key=lambda r: r["name"]):
        kinds = set(r["tags"]) - {"NULL"}
        dtype = (T.BooleanType() if kinds == {"BOOL"} else
                 T.StringType() if kinds != {"N"} or r["huge"] and not r["point"] else
                 T.DoubleType() if r["point"] else T.DecimalType(38, 0) if r["wide"] else T.LongType())
        fields.append(T.StructField(r["name"], dtype))
    return T.StructType(fields)
