"""Human cohort summaries: nested documents to one mean per exam form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grades covered by each exam group.
GRADE_MEMBERS = {
    "3-4": [3, 4],
    "5-6": [5, 6],
    "7-8": [7, 8],
    "9-10": [9, 10],
    "11-13": [11, 12, 13],
}
OVERALL = "overall"


def histogram_mean(counts: Column, bins: Column, grade: Column) -> Column:
    """Frequency-weighted mean of the bin midpoints of one grade."""

    def midpoint(b: Column) -> Column:
        own = b["ranges_by_grade"][grade]
        chosen = F.coalesce(own, b["range_default"])
        return (chosen["min"] + chosen["max"]) / 2

    midpoints = F.transform(bins, midpoint)
    weighted = F.zip_with(counts, midpoints, lambda c, m: c * m)
    total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
    return F.try_divide(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x), total)


def grade_records(cohorts: DataFrame, histogram_means: bool = False) -> DataFrame:
    """Per year: the array ``records`` of its grades in document order, without 'overall'."""

    def of_map(name: str, grade: Column) -> Column:
        return F.col(name)[grade["id"]]

    def record(grade: Column) -> Column:
        estimate = histogram_mean(of_map("counts_by_grade", grade), F.col("bins"), grade["id"])
        average = of_map("avg_score_by_grade", grade)
        reported = F.lit(False) if histogram_means else average.isNotNull()
        return F.struct(
            grade["id"].alias("grade_id"),
            grade["members"].alias("members"),
            F.when(reported, average).otherwise(estimate).alias("human_score"),
            grade["max_points"].cast("double").alias("human_max"),
            of_map("totals_by_grade", grade).alias("students"),
            reported.alias("reported"),
        )

    grades = F.filter("grades", lambda g: g["id"] != OVERALL)
    return cohorts.select("year", F.transform(grades, record).alias("records"))


def _cover(records: Column, exam: Column, members: Column) -> Column:
    """``struct(selected, remaining)``: records that cover an exam's grades.

    A record named like the exam is taken alone. Otherwise, in document order, records that
    lie inside the uncovered grades, and then records that overlap what is still uncovered.
    """
    exact = F.filter(records, lambda r: r["grade_id"] == exam)
    none = F.filter(records, lambda r: F.lit(False))
    start = F.struct(none.alias("selected"), members.alias("remaining"))

    def take(state: Column, record: Column, usable: Column) -> Column:
        return F.when(
            usable,
            F.struct(
                F.concat(state["selected"], F.array(record)).alias("selected"),
                F.array_except(state["remaining"], record["members"]).alias("remaining"),
            ),
        ).otherwise(state)

    def inside(state: Column, record: Column) -> Column:
        # an empty record covers nothing
        outside = F.size(F.array_except(record["members"], state["remaining"]))
        return take(state, record, (F.size(record["members"]) > 0) & (outside == 0))

    def overlapping(state: Column, record: Column) -> Column:
        fresh = ~F.exists(state["selected"], lambda s: s["grade_id"] == record["grade_id"])
        touches = F.arrays_overlap(state["remaining"], record["members"])
        return take(state, record, touches & fresh)

    greedy = F.aggregate(records, start, inside)
    filled = F.aggregate(records, greedy, overlapping)
    return F.when(
        F.size(exact) > 0,
        F.struct(exact.alias("selected"), F.array().cast("array<int>").alias("remaining")),
    ).otherwise(filled)


def human_scores(
    cohorts: DataFrame,
    histogram_means: bool = False,
    grade_members: dict[str, list[int]] | None = None,
) -> DataFrame:
    """Participant-weighted cohort mean per (year, exam).

    Grades of an exam that no record covers are an error, raised while the row is computed.
    """
    members = grade_members or GRADE_MEMBERS
    exams = F.array(
        *[
            F.struct(
                F.lit(exam).alias("exam"),
                F.array(*[F.lit(g) for g in grades]).cast("array<int>").alias("members"),
            )
            for exam, grades in members.items()
        ]
    )
    records = grade_records(cohorts, histogram_means)
    # the inner unfolding keeps the long cover expression from being copied
    rows = records.withColumn("e", F.explode(exams)).select(
        "year",
        F.col("e.exam").alias("exam"),
        F.inline(F.array(_cover(F.col("records"), F.col("e.exam"), F.col("e.members")))),
    )
    checked = rows.withColumn(
        "_ok",
        F.when(F.size("remaining") == 0, F.lit(True)).otherwise(
            F.raise_error(
                F.concat(
                    F.lit("human grades do not cover "),
                    F.col("year").cast("string"),
                    F.lit(" "),
                    F.col("exam"),
                )
            ).cast("boolean")
        ),
    ).filter("_ok")
    return _weighted(checked.select("year", "exam", "selected"))


def _weighted(rows: DataFrame) -> DataFrame:
    """Weighted mean over the selected records; they keep their document order."""

    def total(value) -> Column:
        return F.aggregate("selected", F.lit(0.0), lambda acc, r: acc + value(r))

    count = F.size("selected")
    students = total(lambda r: r["students"].cast("double"))
    score = F.try_divide(
        total(lambda r: r["students"] * r["human_score"]), students
    )
    maximum = total(lambda r: r["human_max"]) / count
    reported = F.forall("selected", lambda r: r["reported"])
    return rows.select(
        "year",
        "exam",
        score.alias("human_score"),
        maximum.alias("human_max"),
        (100 * score / maximum).alias("human_pct"),
        students.cast("bigint").alias("students"),
        F.array_join(F.transform("selected", lambda r: r["grade_id"]), ",").alias(
            "human_grades_used"
        ),
        F.when(reported, "reported").otherwise("histogram").alias("human_mean_source"),
    )
