"""Registered queries: scoring, exam scores, league table and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions.common import Counted
from examlens.operators import describe, scoring
from examlens.plans import adapters as a
from examlens.plans.oracle_tables import oracle, rounded
from examlens.plans.registry import register, round_doubles


def conditioned(spark, sf_dir):
    return describe.with_conditions(a.scored(spark, sf_dir))


@register(
    "b6_scored_attempts",
    oracle(
        """SELECT model, item_id, predicted_normalized, declined, attempted,
                  answered_correctly, valid_selection, awarded_points::DOUBLE AS awarded_points
           FROM scored""",
        "scored",
    ),
)
def b6(spark, sf_dir):
    return a.scored(spark, sf_dir).select(
        "model",
        "item_id",
        "predicted_normalized",
        "declined",
        "attempted",
        "answered_correctly",
        "valid_selection",
        "awarded_points",
    )


@register(
    "g40_run_outcomes",
    oracle(
        """SELECT item_id, answered_correctly AS correct, declined FROM scored WHERE model = 'm2'""",
        "scored",
    ),
)
def g40(spark, sf_dir):
    """Correct and declined flags of one run per item."""
    return scoring.run_outcomes(a.scored(spark, sf_dir), "m2")


_SCORE_COLUMNS = ["multimodal_share", "total_score", "possible_points", "model_pct"]


@register(
    "g1_exam_scores",
    oracle(
        f"""SELECT model, year, exam, questions, official_questions, fixed_bonus, correct,
                   attempted, declined, no_valid_selections, complete_exam,
                   {rounded(*_SCORE_COLUMNS)}
            FROM scores""",
        "scores",
    ),
)
def g1(spark, sf_dir):
    return round_doubles(a.scores(spark, sf_dir))


_WINNERS = """SELECT model, count(*) AS exams_won FROM (
    SELECT model, row_number() OVER (PARTITION BY year, exam
                                     ORDER BY round(model_pct, 9) DESC, model) AS rn
    FROM scores WHERE complete_exam) WHERE rn = 1 GROUP BY model"""


@register("g8_exam_winners", oracle(_WINNERS, "scores"))
def g8(spark, sf_dir):
    return scoring.exam_winners(a.scores(spark, sf_dir))


@register(
    "g9_contest_totals",
    oracle(
        f"""SELECT model, count(*) AS forms, {rounded('sum(possible_points)').split(' AS ')[0]}
                   AS possible_points, round(sum(total_score), 6) AS contest_points
            FROM scores WHERE complete_exam GROUP BY model""",
        "scores",
    ),
)
def g9(spark, sf_dir):
    return round_doubles(scoring.contest_totals(a.scores(spark, sf_dir)))


@register(
    "g7_league_table",
    oracle(
        """SELECT p.*, round(contest_points, 6) AS contest_points,
                  coalesce(exams_won, 0) AS exams_won
           FROM (SELECT model, count(*) AS items, count_if(answered_correctly) AS correct,
                        round(avg(answered_correctly::INT), 6) AS accuracy,
                        count_if(declined) AS abstentions,
                        round(avg(declined::INT), 6) AS decline_rate,
                        count_if(NOT valid_selection AND NOT declined) AS no_valid_selections
                 FROM scored GROUP BY model) p
           LEFT JOIN (SELECT model, sum(total_score) AS contest_points FROM scores
                      WHERE complete_exam GROUP BY model) t USING (model)
           LEFT JOIN winners USING (model)""",
        "scores",
        extra={"winners": _WINNERS},
    ),
)
def g7(spark, sf_dir):
    return round_doubles(scoring.league_table(a.scores(spark, sf_dir)))


@register(
    "g10_response_status",
    oracle(
        """SELECT model, visual_condition, count(*) AS items,
                  count_if(answered_correctly) AS correct,
                  round(avg(answered_correctly::INT), 6) AS accuracy,
                  count_if(valid_selection) AS valid_selections,
                  count_if(declined) AS abstentions,
                  round(avg(declined::INT), 6) AS abstention_rate,
                  count_if(NOT valid_selection AND NOT declined) AS no_valid_selections,
                  round(avg((NOT valid_selection AND NOT declined)::INT), 6)
                      AS no_valid_selection_rate
           FROM scored GROUP BY model, visual_condition""",
        "scored",
    ),
)
def g10(spark, sf_dir):
    return round_doubles(describe.response_status(conditioned(spark, sf_dir)))


def _accuracy_sql(keys: str, where: str = "") -> str:
    return oracle(
        f"""SELECT {keys}, count(*) AS items,
                   round(avg(answered_correctly::INT), 6) AS accuracy,
                   round(avg(declined::INT), 6) AS abstention_rate
            FROM scored {where} GROUP BY {keys}""",
        "scored",
    )


@register("g11_accuracy_by_point_tier", _accuracy_sql("model, question_points, visual_condition"))
def g11(spark, sf_dir):
    return round_doubles(
        describe.accuracy_table(
            conditioned(spark, sf_dir), ["model", "question_points", "visual_condition"]
        )
    )


@register("g12_accuracy_by_grade", _accuracy_sql("model, exam, visual_condition"))
def g12(spark, sf_dir):
    return round_doubles(
        describe.accuracy_table(conditioned(spark, sf_dir), ["model", "exam", "visual_condition"])
    )


@register(
    "g13_text_only_accuracy_by_year", _accuracy_sql("model, year", "WHERE NOT multimodal")
)
def g13(spark, sf_dir):
    text_only = conditioned(spark, sf_dir).filter(
        F.col("visual_condition") == describe.TEXT_ONLY
    )
    return round_doubles(describe.accuracy_table(text_only, ["model", "year"]))


@register(
    "g14_image_subtype_results",
    oracle(
        """SELECT model, image_subtype, n AS items, round(p, 6) AS accuracy,
                  round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6)
                      AS accuracy_ci_low,
                  round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6)
                      AS accuracy_ci_high,
                  round(d, 6) AS decline_rate, round(a, 6) AS attempted_accuracy
           FROM (SELECT model, image_subtype, count(*) AS n, 1.959963984540054::DOUBLE AS z,
                        avg(answered_correctly::INT) AS p, avg(declined::INT) AS d,
                        avg(answered_correctly::INT) FILTER (WHERE attempted) AS a
                 FROM scored GROUP BY model, image_subtype)""",
        "scored",
    ),
)
def g14(spark, sf_dir):
    return round_doubles(describe.subtype_results(conditioned(spark, sf_dir)))


@register(
    "g15_subtype_counts",
    oracle(
        """SELECT c.image_subtype, count(s.item_id) AS items
           FROM (VALUES ('Text-only'), ('Question diagram only'), ('Image answers only'),
                        ('Question diagram and image answers')) c(image_subtype)
           LEFT JOIN (SELECT DISTINCT item_id, image_subtype FROM scored) s
           USING (image_subtype) GROUP BY c.image_subtype""",
        "scored",
    ),
)
def g15(spark, sf_dir):
    evaluated = describe.evaluated_items(a.items(spark, sf_dir), a.attempts(spark, sf_dir))
    return describe.subtype_counts(evaluated)


@register(
    "g16_option_positions",
    oracle(
        """SELECT model, l.option, count_if(answer = l.option) AS gold_count,
                  round(count_if(answer = l.option) / count(*), 6) AS gold_share,
                  count_if(predicted_normalized = l.option) AS predicted_count,
                  round(count_if(predicted_normalized = l.option)
                        / count_if(valid_selection), 6) AS predicted_share_among_attempts,
                  round(avg(answered_correctly::INT) FILTER (WHERE answer = l.option), 6)
                      AS accuracy_when_gold,
                  round(avg(declined::INT) FILTER (WHERE answer = l.option), 6)
                      AS decline_rate_when_gold
           FROM scored, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(option)
           GROUP BY model, l.option""",
        "scored",
    ),
)
def g16(spark, sf_dir):
    return round_doubles(describe.option_positions(a.scored(spark, sf_dir)))


_COMPOSITION = [
    "multimodal_share",
    "associated_image_share",
    "option_image_share",
    "three_point_share",
    "five_point_share",
]


@register(
    "g5_exam_composition",
    oracle(
        f"""SELECT year, exam, item_count, {rounded(*_COMPOSITION)},
                   round((year - avg(year) OVER ()) / 10, 6) AS year_per_decade
            FROM composition""",
        "composition",
    ),
)
def g5(spark, sf_dir):
    evaluated = describe.evaluated_items(a.items(spark, sf_dir), a.attempts(spark, sf_dir))
    composition = describe.exam_composition(evaluated).drop("auxiliary_visual_share")
    return round_doubles(describe.with_decades(composition))


_SLICE_AGG = """SELECT '{name}' AS slice, year, exam, avg(acc) AS ensemble_accuracy,
        avg(dec) AS ensemble_decline_rate, min_by(n, model) AS items_per_model,
        count(DISTINCT model) AS model_count
    FROM (SELECT model, year, exam, count(*) AS n, avg(answered_correctly::INT) AS acc,
                 avg(declined::INT) AS dec
          FROM scored {where} GROUP BY model, year, exam) GROUP BY year, exam"""
SLICES_SQL = " UNION ALL ".join(
    _SLICE_AGG.format(name=name, where=where)
    for name, where in [
        ("All items", ""),
        ("Text-only", "WHERE NOT multimodal"),
        ("Auxiliary visual content", "WHERE multimodal"),
    ]
)


@register(
    "g6_slice_scores",
    oracle(
        f"""SELECT slice, year, exam, items_per_model, model_count,
                   {rounded('ensemble_accuracy', 'ensemble_decline_rate')}
            FROM ({SLICES_SQL})""",
        "scored",
    ),
)
def g6(spark, sf_dir):
    return round_doubles(describe.slice_scores(a.scored(spark, sf_dir)))


@register(
    "g17_yearly_composition",
    oracle(
        """SELECT year, count(*) AS items,
                  round(avg(multimodal::INT), 6) AS auxiliary_visual_share,
                  round(avg(has_associated_image::INT), 6) AS question_diagram_share,
                  round(avg(has_option_image::INT), 6) AS option_image_share
           FROM items GROUP BY year""",
        "items",
    ),
)
def g17(spark, sf_dir):
    evaluated = describe.evaluated_items(a.items(spark, sf_dir), a.attempts(spark, sf_dir))
    return round_doubles(describe.yearly_composition(describe.exam_composition(evaluated)))


@register(
    "g18_scores_by_model_pivot",
    oracle(
        "SELECT year, exam, "
        + ", ".join(
            f"round(avg(model_pct) FILTER (WHERE model = '{m}'), 6) AS {m}"
            for m, _, _ in a.MODELS
        )
        + " FROM scores GROUP BY year, exam",
        "scores",
    ),
)
def g18(spark, sf_dir):
    names = [name for name, _, _ in a.MODELS]
    wide = a.scores(spark, sf_dir).groupBy("year", "exam").pivot("model", names).agg(F.avg("model_pct"))
    return round_doubles(wide)


@register(
    "g36_distinct_counts",
    oracle(
        """SELECT count(DISTINCT item_id) AS items, count(DISTINCT year) AS years,
                  count(DISTINCT exam) AS exams, count(DISTINCT model) AS models
           FROM scored""",
        "scored",
    ),
)
def g36(spark, sf_dir):
    return a.scored(spark, sf_dir).agg(
        *[
            F.count_distinct(source).cast("bigint").alias(name)
            for source, name in [
                ("item_id", "items"),
                ("year", "years"),
                ("exam", "exams"),
                ("model", "models"),
            ]
        ]
    )


@register(
    "g37_dataset_profile",
    oracle(
        """SELECT year, count(*) AS rows, count_if(multimodal) AS multimodal_rows,
                  round(avg(points), 6) AS mean_points FROM items GROUP BY year""",
        "items",
    ),
)
def g37(spark, sf_dir):
    return round_doubles(describe.dataset_profile(a.items(spark, sf_dir)))


@register(
    "g42_form_coverage",
    oracle(
        """SELECT year, exam, questions, official_questions, possible_points, evaluated_items,
                  human_items, evaluated_items = questions AS adjustment_agrees,
                  official_questions = human_items AS human_agrees
           FROM (SELECT year, exam, min(questions) AS questions,
                        min(official_questions) AS official_questions,
                        min(possible_points)::DOUBLE AS possible_points
                 FROM scores GROUP BY year, exam)
           JOIN (SELECT year, exam, evaluated_items FROM adjustments) USING (year, exam)
           JOIN (SELECT year, exam, human_max / 5 AS human_items FROM human)
           USING (year, exam)""",
        "scores",
        "human",
    ),
)
def g42(spark, sf_dir):
    return scoring.form_coverage(
        a.scores(spark, sf_dir), a.adjustments(spark, sf_dir), a.human(spark, sf_dir)
    )


@register(
    "g7_league_table_from_cells",
    oracle(
        """SELECT model, count(*) AS items, count_if(answered_correctly) AS correct,
                  round(avg((answered_correctly AND multimodal)::INT), 6) AS visual_correct_share,
                  round(sum(awarded_points), 6) AS awarded_points
           FROM scored GROUP BY model""",
        "scored",
    ),
)
def g7_cells(spark, sf_dir):
    """Model totals from the cells that stand in for the item rows in whole reports."""
    items = Counted(scoring.item_cells(a.scored(spark, sf_dir)))
    both = F.col("answered_correctly") & F.col("multimodal")
    return round_doubles(
        items.frame.groupBy("model").agg(
            items.rows().alias("items"),
            items.count_if(F.col("answered_correctly")).alias("correct"),
            items.share(both).alias("visual_correct_share"),
            items.total("awarded_points").alias("awarded_points"),
        )
    )
