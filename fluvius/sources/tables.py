"""Table access: Parquet tables by folder, and the other formats that pipelines read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A file by its suffix: .parquet, .ndjson / .jsonl, .json (an array), .csv, .geojson."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "geojson":
        return read_geojson(spark, path)
    reader = spark.read.option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema)
    if suffix in ("ndjson", "jsonl"):
        return reader.json(path)
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix == "csv":
        return (reader if schema is not None else reader.option("inferSchema", True)).option("header", True).option("nullValue", "").csv(path)
    raise ValueError(f"no reader for {path}")


def read_classes(spark: SparkSession, paths: dict[str, str], schema: str | None = None) -> DataFrame:
    """Several files of one shape as one table, tagged with their class."""
    out = None
    for cls, path in sorted(paths.items()):
        part = read_any(spark, path, schema).withColumn("class", F.lit(cls))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection: properties as a JSON map, geometry type, coordinates as JSON."""
    raw = spark.read.schema("features array<struct<properties:string,geometry:string>>").option("multiLine", True).json(path)
    one = raw.select(F.explode("features").alias("f"))
    return one.select(
        F.from_json("f.properties", "map<string,string>").alias("properties"),
        F.get_json_object("f.geometry", "$.type").alias("geometry_type"),
        F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"),
    )


def write_geojson_lines(df: DataFrame, path: str, geometry_type: str, coordinates: str, digits: int = 6) -> None:
    """One feature a line; ``coordinates`` is an array of (x, y) structs, rounded to ``digits``."""
    points = F.transform(coordinates, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    props = F.struct(*[F.col(c) for c in df.columns if c != coordinates])
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(geometry_type).alias("type"), points.alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_ordered_ndjson(df: DataFrame, path: str, key: str) -> None:
    """NDJSON ordered by a unique key, over range partitions: files in order make up the sorted whole."""
    df.orderBy(key).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def strict_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an NDJSON file with what is wrong with each: value, ok, reason.

    A line fails if it is not an object, has a field that the schema lacks, lacks one that
    the schema does not allow to be null, or has a value that the type refuses.
    """
    lines = spark.read.text(path)
    return check_json(lines, "value", schema)


def check_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(column, kinds, {"columnNameOfCorruptRecord": "_corrupt_record"})
    known = F.array(*[F.lit(f.name) for f in schema])
    needed = F.array(*[F.lit(f.name) for f in schema if not f.nullable]).cast("array<string>")
    keys = F.json_object_keys(column)
    out = df.withColumn("parsed", parsed).withColumn("keys", keys)
    reason = (
        F.when(F.col("keys").isNull() | F.col("parsed._corrupt_record").isNotNull(), "not valid")
        .when(F.size(F.array_except("keys", known)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_except("keys", known)), ",")))
        .when(F.size(F.array_except(needed, "keys")) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(F.array_except(needed, "keys")), ",")))
    )
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("keys")
