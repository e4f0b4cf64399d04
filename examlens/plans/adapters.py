"""The engine's input tables, derived from the star-schema test tables.

Every function reads whole tables and derives its columns by rules that any SQL engine can
repeat (see ``oracle_tables``), so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.functions.common import hash32
from examlens.operators import describe, later_runs, options
from examlens.operators import panel as panels
from examlens.operators.scoring import exam_scores, score_attempts

# (model, hits per 1000 text-only items, declines per 1000 items)
MODELS = [("m1", 880, 30), ("m2", 860, 0), ("m3", 780, 118), ("m4", 770, 7)]
REFERENCE_MODEL = "m1"
ADJUSTED_FORMS = [(3, "1-URGENT"), (11, "3-MEDIUM")]


# plans (not data) of the tables read so far; the test tables never change
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as its files are dealt."""
    known = (spark.sparkContext.applicationId, sf_dir, name)
    if known not in _TABLES:
        _TABLES[known] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[known]


def letter_at(index: Column) -> Column:
    return F.substring(F.lit("ABCDE"), 1, 5).substr(index.cast("int") + 1, F.lit(1))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per order; 27 quarters play the years, 5 priorities the exams."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    period = ((F.year(date) - 1995) * 4 + F.quarter(date) - 1).cast("int")
    stem = F.pmod(hash32(F.lit("stem"), key), F.lit(1000)) < 200 + 10 * F.col("year")
    option = F.pmod(hash32(F.lit("opt"), key), F.lit(1000)) < 100
    return (
        table(spark, sf_dir, "orders")
        .select(
            key.alias("item_id"),
            period.alias("year"),
            F.col("o_orderpriority").alias("exam"),
            (3 + F.pmod(key, F.lit(3))).cast("double").alias("points"),
            letter_at(F.pmod(key, F.lit(5))).alias("answer"),
            key,
        )
        .withColumns({"has_associated_image": stem, "has_option_image": option})
        .withColumn("multimodal", F.col("has_associated_image") | F.col("has_option_image"))
        .drop("o_orderkey")
    )


def _responses_of(item_rows: DataFrame, salt: str, handicap: int = 0) -> DataFrame:
    """One simulated attempt per item and model; ``salt`` names the run."""
    model = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("model"),
                    F.lit(hit).alias("hit"),
                    F.lit(decline).alias("decl"),
                )
                for name, hit, decline in MODELS
            ]
        )
    ).alias("m")
    prefix = [F.lit(salt)] if salt else []
    item = F.col("item_id")
    drawn = (
        item_rows.select("item_id", "answer", "multimodal", model)
        .select("item_id", "answer", "multimodal", "m.model", "m.hit", "m.decl")
        .withColumns(
            {
                "hit": F.col("hit") - F.when(F.col("multimodal"), 250 + handicap).otherwise(0),
                "u": F.pmod(hash32(*prefix, F.col("model"), item), F.lit(1000)),
                "w": F.pmod(hash32(*prefix, F.lit("w"), F.col("model"), item), F.lit(4)),
            }
        )
    )
    wrong = letter_at(F.pmod(F.pmod(item, F.lit(5)) + 1 + F.col("w"), F.lit(5)))
    u = F.col("u")
    predicted = (
        F.when(u < F.col("hit"), F.col("answer"))
        .when(u < F.col("hit") + F.col("decl"), F.lit("DECLINED"))
        .when(u >= 998, F.lit(None).cast("string"))
        .when(u >= 996, F.lit("x"))
        .otherwise(wrong)
    )
    return drawn.select("model", "item_id", predicted.alias("predicted"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses_of(items(spark, sf_dir), "")


def repeat_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of every model on the same items."""
    return _responses_of(items(spark, sf_dir), "r")


def blind_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without images on the multimodal items."""
    return _responses_of(items(spark, sf_dir).filter("multimodal"), "b", handicap=300)


def _adjusted(year: Column, exam: Column) -> Column:
    matches = F.lit(False)
    for form_year, form_exam in ADJUSTED_FORMS:
        matches = matches | ((year == form_year) & (exam == form_exam))
    return matches


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official facts per form: two forms carry fixed credit, every ninth misses a maximum."""
    counted = items(spark, sf_dir).groupBy("year", "exam").agg(
        F.count(F.lit(1)).alias("evaluated_items"), F.sum("points").alias("_points")
    )
    credit = _adjusted(F.col("year"), F.col("exam"))
    missing = F.when(F.pmod(F.col("year"), F.lit(9)) == 4, 5.0).otherwise(0.0)
    return counted.select(
        "year",
        "exam",
        F.col("evaluated_items").cast("bigint").alias("evaluated_items"),
        (F.col("evaluated_items") + credit.cast("bigint")).alias("official_items"),
        F.when(credit, 1.0).otherwise(0.0).alias("additional_start_points"),
        F.when(credit, 5.0).otherwise(0.0).alias("automatic_credit"),
        F.when(credit, 6.0).otherwise(0.0).alias("fixed_bonus"),
        (
            F.col("evaluated_items")
            + F.col("_points")
            + F.when(credit, 6.0).otherwise(0.0)
            + missing
        ).alias("official_max"),
    )


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort mean per form from order totals; two of three years count as reported."""
    date = F.col("o_orderdate")
    period = ((F.year(date) - 1995) * 4 + F.quarter(date) - 1).cast("int")
    # midpoints of 50 000-wide bins give the frequency-table twin of the mean
    midpoint = F.floor(F.col("o_totalprice") / 50000) * 50000 + 25000
    return (
        table(spark, sf_dir, "orders")
        .groupBy(period.alias("year"), F.col("o_orderpriority").alias("exam"))
        .agg(
            (100 * F.avg("o_totalprice") / 500000).alias("human_pct"),
            F.count(F.lit(1)).cast("bigint").alias("students"),
            (100 * F.avg(midpoint) / 500000).alias("histogram_pct"),
        )
        .withColumns(
            {
                "human_mean_source": F.when(
                    F.pmod(F.col("year"), F.lit(3)) == 0, "histogram"
                ).otherwise("reported"),
                "human_max": 5.0
                * (
                    F.col("students")
                    + _adjusted(F.col("year"), F.col("exam")).cast("bigint")
                    + F.when(F.pmod(F.col("year"), F.lit(9)) == 4, 1).otherwise(0)
                ),
            }
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_attempts(attempts(spark, sf_dir), items(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam scores with the official facts of every form."""
    return exam_scores(scored(spark, sf_dir), adjustments(spark, sf_dir))


GRADES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.exam_composition(items(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long exam panel, written once so that the fact rows are scanned once."""
    built = panels.build_panel(
        scores(spark, sf_dir), human(spark, sf_dir), composition(spark, sf_dir)
    )
    return panels.materialize(built, "panel")


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.comparison_panel(
        scores(spark, sf_dir), human(spark, sf_dir), REFERENCE_MODEL
    )


# --- option order and later runs -------------------------------------------------------------

OPTION_ORDER_MODEL = "m4"
FALLBACK_MODEL = "m3"


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with statement and option texts, one per part; some refer to their letters."""
    key = F.col("p_partkey")
    kind = F.pmod(key, F.lit(9))
    statement = (
        F.when(kind == 1, F.concat("p_name", F.lit(": welche Aussage B gilt?")))
        .when(kind == 2, F.concat("p_name", F.lit(" wie in der obigen Figur")))
        .when(kind == 3, F.concat("p_name", F.lit(" und (C) daneben")))
        .otherwise(F.col("p_name"))
    )
    options_of = {
        "sol_A": F.when(kind == 4, F.lit("(A)")).otherwise(F.col("p_brand")),
        "sol_B": F.when(kind == 5, F.lit("A und C")).otherwise(F.col("p_type")),
        "sol_C": F.col("p_size").cast("string"),
        "sol_D": F.when(kind == 6, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("size "), F.col("p_size").cast("string"))
        ),
        "sol_E": F.when(kind == 7, F.lit(" e. ")).otherwise(F.lit("none of these")),
    }
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        letter_at(F.pmod(key, F.lit(5))).alias("answer"),
        statement.alias("problem_statement"),
        *[value.alias(name) for name, value in options_of.items()],
        (F.pmod(hash32(F.lit("img"), key), F.lit(10)) == 0).alias("has_option_image"),
    )


def order_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option-order mapping of the order-based items; option images keep their order."""
    reason = F.when(F.col("has_option_image"), "option images").otherwise("")
    item = items(spark, sf_dir).withColumn("kept_order_reason", reason)
    ordered = item.withColumn(
        "_order", options.permutation(F.col("item_id"), F.col("kept_order_reason"))
    )
    return ordered.select(
        "item_id",
        "kept_order_reason",
        F.col("answer").alias("old_answer"),
        options.letter_of(F.array_position("_order", F.col("answer"))).alias("new_answer"),
        *[F.get("_order", F.lit(i)).alias(f"new_{x}_source") for i, x in enumerate("ABCDE")],
    )


def order_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option-order arm of one model: choices are letters of the permuted options."""
    drawn = _responses_of(items(spark, sf_dir), "o").filter(F.col("model") == OPTION_ORDER_MODEL)
    mapping = order_mapping(spark, sf_dir)
    order = F.array(*[F.col(f"new_{x}_source") for x in "ABCDE"])
    place = F.array_position(order, F.col("predicted"))
    shown = F.when(place > 0, options.letter_of(place)).otherwise(F.col("predicted"))
    return drawn.join(mapping, "item_id").select("model", "item_id", shown.alias("predicted"))


def fallback_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run of one model whose parser fell back to the first letter on some rows."""
    drawn = _responses_of(items(spark, sf_dir), "f").filter(F.col("model") == FALLBACK_MODEL)
    item = F.col("item_id")
    flag = F.pmod(hash32(F.lit("fb"), item), F.lit(100))
    return drawn.withColumns(
        {
            "fallback_parse": flag < 8,
            "output_capped": (flag >= 4) & (flag < 12),
            "stated_answer": F.when(flag < 6, letter_at(F.pmod(item, F.lit(5)))),
        }
    )


def later_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later series: a repeat, the unmapped option-order arm, and three fallback variants."""
    return later_runs.later_items(
        repeat_attempts(spark, sf_dir),
        order_attempts(spark, sf_dir),
        order_mapping(spark, sf_dir),
        fallback_attempts(spark, sf_dir),
        OPTION_ORDER_MODEL,
        f"{FALLBACK_MODEL}__later",
    )


def later_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_attempts(later_attempts(spark, sf_dir), items(spark, sf_dir))


def later_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel of the later series and the base run they repeat, with two mean-of-runs series."""
    base = scored(spark, sf_dir).filter(F.col("model") == OPTION_ORDER_MODEL)
    both = later_scored(spark, sf_dir).unionByName(base, allowMissingColumns=True)
    by_exam = exam_scores(both, adjustments(spark, sf_dir))
    built = panels.build_panel(by_exam, human(spark, sf_dir), composition(spark, sf_dir)).filter(
        F.col("series") != panels.ENSEMBLE
    )
    written = panels.materialize(built, "later-panel")
    model = OPTION_ORDER_MODEL
    two = panels.add_mean_series(written, f"{model}__two_run_mean", [model, f"{model}__repeat"])
    mean = panels.add_mean_series(
        written,
        f"{model}__three_run_mean",
        [model, f"{model}__repeat", f"{model}__option_order"],
    ).filter(F.col("series") == f"{model}__three_run_mean")
    return two.unionByName(mean)
