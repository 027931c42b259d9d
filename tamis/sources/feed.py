"""Change feeds: envelopes of inserts, updates and deletes, as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def envelope_schema(image: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("sequence_number", T.StringType()), T.StructField("event_name", T.StringType()),
                         T.StructField("new_image", image)])


def changed_rows(envelopes: DataFrame) -> DataFrame:
    """New images of inserts and updates; deletes are dropped. Works on streams and batches."""
    return (envelopes.filter(F.col("event_name").isin("INSERT", "MODIFY"))
            .select("new_image.*", "event_name", "sequence_number"))


def read_feed(spark: SparkSession, path: str, image: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of changed rows from envelope files. The Spark checkpoint is the resume point.

    An envelope that does not parse fails the batch: a change must not vanish. ``bad_envelopes`` shows such lines.
    """
    reader = spark.readStream.schema(envelope_schema(image)).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return changed_rows(reader.json(path))


def read_feed_after(spark: SparkSession, path: str, image: T.StructType, sequence_number: str | None = None) -> DataFrame:
    """Batch of changed rows, all of them or those after a sequence number. Fails on an envelope that does not parse, and, where
    the number decides, on one that has none: ``bad_envelopes`` shows both."""
    envelopes = spark.read.schema(envelope_schema(image)).option("mode", "FAILFAST").json(path)
    if sequence_number is not None:
        later = sequence_order(F.col("sequence_number")) > sequence_order(F.lit(sequence_number))
        envelopes = envelopes.filter(F.when(has_number(F.col("sequence_number")), later).otherwise(
            F.raise_error(F.lit("an envelope has no sequence number")).cast("boolean")))
    return changed_rows(envelopes)


def sequence_order(number: Column) -> Column:
    """Sequence numbers in numeric order, whatever their length: digits without leading zeros, shorter ones first."""
    digits = F.ltrim(number, F.lit("0"))
    return F.struct(F.length(digits), digits)


def has_number(number: Column) -> Column:
    """Whether a sequence number is one."""
    return F.coalesce(number.rlike(r"\A[0-9]+\z"), F.lit(False))


def bad_envelopes(spark: SparkSession, path: str, image: T.StructType) -> DataFrame:
    """The lines of envelope files that do not parse or have no sequence number, as text."""
    schema = T.StructType([*envelope_schema(image), T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return (lines.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
            .filter(F.col("e._corrupt_record").isNotNull() | ~has_number(F.col("e.sequence_number"))).select("value"))


def read_kafka_feed(spark: SparkSession, servers: str, topic: str, image: T.StructType, start: str = "latest") -> DataFrame:
    """The same from Kafka; start is latest, earliest, or a JSON of offsets. Needs the Kafka package."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", start).load())
    return changed_rows(raw.select(F.from_json(F.col("value").cast("string"), envelope_schema(image), {"mode": "FAILFAST"}).alias("e"))
                        .select("e.*"))
