"""Readers: files to DataFrames with the engine's column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.functions.messages import is_number, is_object
from examlens.sources import schemas


def validate_item_columns(columns: list[str]) -> None:
    missing = [name for name in schemas.REQUIRED_ITEM_COLUMNS if name not in columns]
    if missing:
        raise ValueError(f"item dataset misses the columns {missing}")


def read_items(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Item dataset; ids as text. Ask for ``columns`` so that image bytes stay unread."""
    frame = spark.read.parquet(path)
    validate_item_columns(frame.columns)
    frame = frame.withColumn("id", F.col("id").cast("string"))
    return frame.select(*columns) if columns else frame


def answer_key(items: DataFrame) -> DataFrame:
    """The columns that scoring needs, under the engine's names."""
    return items.select(
        F.col("id").alias("item_id"),
        F.col("year").cast("int").alias("year"),
        F.col("group").cast("string").alias("exam"),
        F.col("points").cast("double").alias("points"),
        "answer",
        "multimodal",
    )


def read_runs(spark: SparkSession, root: str, catalogue: DataFrame) -> DataFrame:
    """The catalogue's runs in one scan, tagged by their folder name.

    ``catalogue`` holds ``run_id, model, arm, wave`` for the wanted runs, a row each; only their
    folders are read, and a folder that does not exist is an error.
    """
    paths = [f"{root}/{r.run_id}/results.parquet" for r in catalogue.select("run_id").distinct().collect()]
    # the known columns are read; files without the optional ones give null for them
    runs = (
        spark.read.schema(schemas.COMPACT_RUN).parquet(*paths)
        if paths
        else spark.createDataFrame([], schemas.COMPACT_RUN).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    )
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/results\.parquet", 1)
    return (
        runs.withColumn("run_id", folder)
        .join(catalogue, "run_id")
        .withColumnRenamed("source_id", "item_id")
        .select(
            "run_id",
            "model",
            "arm",
            "wave",
            "item_id",
            "predicted",
            "fallback_parse",
            "stated_answer",
            "output_capped",
        )
    )


def run_catalogue(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "run_id string, model string, arm string, wave string")


def read_form_adjustments(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.schema(schemas.FORM_ADJUSTMENTS).csv(path, header=True, quote='"', escape='"')
    return frame.withColumnRenamed("group", "exam")


def read_option_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Option mapping; an empty reason stays an empty string."""
    frame = spark.read.schema(schemas.OPTION_MAPPING).csv(path, header=True)
    blanks = {
        name: F.coalesce(F.col(name), F.lit(""))
        for name in frame.columns
        if name != "id"
    }
    return frame.withColumns(blanks).withColumnRenamed("id", "item_id")


def read_cohorts(spark: SparkSession, pattern: str) -> DataFrame:
    """Cohort summaries, one JSON document per file. A pattern without files is an error."""
    return spark.read.schema(schemas.COHORT).json(pattern, multiLine=True)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model registry with its rate limits as seconds per request."""
    frame = spark.read.schema(schemas.REGISTRY).json(path, multiLine=True)
    return registry_rows(frame)


def registry_rows(frame: DataFrame) -> DataFrame:
    rows = frame.select(F.explode("models").alias("m")).select("m.*")
    return rows.select(
        "id",
        "label",
        F.coalesce("supports_vision", F.lit(False)).alias("supports_vision"),
        F.coalesce("supports_json_response_format", F.lit(False)).alias(
            "supports_json_response_format"
        ),
        seconds_per_request(F.col("rate_limit")).alias("min_request_interval"),
    )


def seconds_per_request(rate_limit: Column) -> Column:
    """Seconds between requests from an object of limits or a plain requests-per-second."""
    document = F.try_parse_json(rate_limit)

    def field(name: str) -> Column:
        found = F.try_variant_get(document, f"$.{name}", "variant")
        return F.when(is_number(found), F.try_variant_get(document, f"$.{name}", "double"))

    def inverse(value: Column, unit: float) -> Column:
        return F.when(value > 0, F.lit(unit) / value)

    interval = field("min_interval_seconds")
    of_object = F.coalesce(
        F.when(interval >= 0, interval),
        inverse(field("requests_per_second"), 1.0),
        inverse(field("requests_per_minute"), 60.0),
    )
    plain = F.when(is_number(document), F.try_variant_get(document, "$", "double"))
    return F.when(is_object(document), of_object).otherwise(inverse(plain, 1.0))


def read_run_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run configurations as catalogue rows."""
    frame = spark.read.schema(schemas.RUN_CONFIG).json(pattern, multiLine=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return frame.select(
        folder.alias("run_id"),
        F.col("model.id").alias("model_id"),
        "timestamp_utc",
        F.col("args.no_images").alias("no_images"),
        F.col("args.worker_count").alias("worker_count"),
        F.col("multimodal_policy.rows_after_filter").alias("rows_after_filter"),
        F.col("resumed").isNotNull().alias("was_resumed"),
        F.col("resumed.first_part.items").alias("first_part_items"),
        F.col("resumed.second_part.items").alias("second_part_items"),
    )


def read_response_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSE_LOG).json(path)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USAGE_EVENT).json(path)
