"""Sinks. All of them write distributed; only single-row metric trees become one file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from examlens.sources import schemas


def conform(frame: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns and types; columns the frame lacks become null."""
    return frame.select(
        *[
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_results(frame: DataFrame, path: str) -> None:
    """Run results; an empty run still writes a file with the full schema."""
    conform(frame, schemas.RUN_RECORD).write.parquet(path)


def write_like(frame: DataFrame, source: DataFrame, path: str) -> None:
    """Parquet with the schema of another table (used for reordered datasets)."""
    conform(frame, source.schema).write.parquet(path)


def write_run_logs(results: DataFrame, responses: DataFrame, folder: str, compression: str = "gzip") -> None:
    """JSON lines: results, raw responses and failures; failures come from the written results.

    Every line names all fields, so the files are packed; Spark reads them by their ending.
    """
    results.write.json(f"{folder}/results.jsonl", compression=compression, ignoreNullFields=False)
    responses.write.json(f"{folder}/raw_responses.jsonl", compression=compression, ignoreNullFields=False)
    written = results.sparkSession.read.schema(results.schema).json(f"{folder}/results.jsonl")
    failures = written.filter(F.col("error").isNotNull()).select("id", "error", "warnings")
    failures.write.json(f"{folder}/failures.jsonl", compression=compression, ignoreNullFields=False)


def write_tables(
    tables: dict[str, DataFrame], folder: str, order: dict[str, list[Column | str]] | None = None
) -> None:
    """CSV with a header per table, as many files as the table has partitions.

    ``order`` names the sort columns of a table; its files are then sorted as a whole, each
    holding a range.
    """
    for name, frame in tables.items():
        columns = (order or {}).get(name)
        (frame.orderBy(*columns) if columns else frame).write.csv(f"{folder}/{name}", header=True)


def metrics_tree(sections: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row with a JSON column ``metrics``: sections and fields in sorted order.

    A section with a key column becomes an object of objects, one per key; a section without
    one becomes the object of its row or, with several rows, the sorted list of them. The
    sections are result tables.
    """
    parts = []
    for name, (frame, key) in sections.items():
        fields = F.struct(*[F.col(f"`{c}`") for c in sorted(frame.columns) if c != key])
        if key:
            entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), fields)))
            value: Column = F.map_from_entries(entries)
        else:
            rows_of = F.sort_array(F.collect_list(fields))
            value = F.when(F.size(rows_of) == 1, F.to_json(rows_of[0])).otherwise(F.to_json(rows_of))
        text = F.to_json(value) if key else value
        parts.append(frame.agg(text.alias("value")).withColumn("section", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts)
    body = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("section", "value"))),
            lambda s: F.concat(F.lit('"'), s["section"], F.lit('":'), s["value"]),
        ),
        ",",
    )
    return rows.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("metrics"))


def write_metrics(tree: DataFrame, path: str) -> None:
    tree.coalesce(1).write.text(path)
