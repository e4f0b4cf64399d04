"""The adapters once more, as SQL for the comparison engine.

``oracle(body, *names)`` puts the needed common table expressions in front of a query.
"""

from __future__ import annotations

from examlens.plans.adapters import ADJUSTED_FORMS, MODELS


def h(*parts: str) -> str:
    """The shared hash: first 32 bits of an md5 over the parts joined by ':'."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


def letter(index: str) -> str:
    return f"substr('ABCDE', CAST({index} AS INTEGER) + 1, 1)"


PERIOD = "CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER)"
CREDIT = (
    "("
    + " OR ".join(f"(year = {y} AND exam = '{e}')" for y, e in ADJUSTED_FORMS)
    + ")"
)
_MODEL_ROWS = ", ".join(f"('{m}', {hit}, {decl})" for m, hit, decl in MODELS)


def _attempts(salt: str, source: str, handicap: int) -> str:
    lead = [f"'{salt}'"] if salt else []
    u = h(*lead, "model", "item_id")
    w = h(*lead, "'w'", "model", "item_id")
    return f"""
    SELECT model, item_id,
           CASE WHEN u < hit THEN answer
                WHEN u < hit + decl THEN 'DECLINED'
                WHEN u >= 998 THEN NULL
                WHEN u >= 996 THEN 'x'
                ELSE {letter('(item_id % 5 + 1 + w) % 5')} END AS predicted
    FROM (SELECT model, item_id, answer, decl,
                 hit - CASE WHEN multimodal THEN {250 + handicap} ELSE 0 END AS hit,
                 {u} % 1000 AS u, {w} % 4 AS w
          FROM {source}, (VALUES {_MODEL_ROWS}) AS m(model, hit, decl))"""


def _scored(source: str) -> str:
    return f"""
    SELECT *, CASE WHEN answered_correctly THEN question_points
                   WHEN declined THEN 0.0 ELSE -0.25 * question_points END AS awarded_points,
           NOT declined AS attempted,
           predicted_normalized IN ('A','B','C','D','E') AS valid_selection,
           CASE WHEN has_associated_image AND has_option_image
                     THEN 'Question diagram and image answers'
                WHEN has_associated_image THEN 'Question diagram only'
                WHEN has_option_image THEN 'Image answers only'
                ELSE 'Text-only' END AS image_subtype,
           CASE WHEN multimodal THEN 'Auxiliary visual content' ELSE 'Text-only' END
               AS visual_condition
    FROM (SELECT a.model, a.item_id, i.year, i.exam, i.answer, i.points AS question_points,
                 i.multimodal, i.has_associated_image, i.has_option_image,
                 upper(trim(coalesce(a.predicted, ''))) AS predicted_normalized,
                 upper(trim(coalesce(a.predicted, ''))) = 'DECLINED' AS declined,
                 upper(trim(coalesce(a.predicted, ''))) = i.answer AS answered_correctly
          FROM {source} a JOIN items i USING (item_id))"""


# name -> (names it reads, SQL)
TABLES: dict[str, tuple[list[str], str]] = {
    "items": (
        [],
        f"""
    SELECT *, has_associated_image OR has_option_image AS multimodal
    FROM (SELECT o_orderkey AS item_id, {PERIOD} AS year, o_orderpriority AS exam,
                 CAST(3 + o_orderkey % 3 AS DOUBLE) AS points,
                 {letter('o_orderkey % 5')} AS answer,
                 {h("'stem'", 'o_orderkey')} % 1000 < 200 + 10 * ({PERIOD})
                     AS has_associated_image,
                 {h("'opt'", 'o_orderkey')} % 1000 < 100 AS has_option_image
          FROM orders)""",
    ),
    "attempts": (["items"], _attempts("", "items", 0)),
    "repeat_attempts": (["items"], _attempts("r", "items", 0)),
    "blind_attempts": (["items"], _attempts("b", "(SELECT * FROM items WHERE multimodal)", 300)),
    "scored": (["items", "attempts"], _scored("attempts")),
    "scored_repeat": (["items", "repeat_attempts"], _scored("repeat_attempts")),
    "scored_blind": (["items", "blind_attempts"], _scored("blind_attempts")),
    "adjustments": (
        ["items"],
        f"""
    SELECT year, exam, n AS evaluated_items,
           n + CASE WHEN {CREDIT} THEN 1 ELSE 0 END AS official_items,
           CASE WHEN {CREDIT} THEN 1.0 ELSE 0.0 END AS additional_start_points,
           CASE WHEN {CREDIT} THEN 5.0 ELSE 0.0 END AS automatic_credit,
           CASE WHEN {CREDIT} THEN 6.0 ELSE 0.0 END AS fixed_bonus,
           n + p + CASE WHEN {CREDIT} THEN 6.0 ELSE 0.0 END
             + CASE WHEN year % 9 = 4 THEN 5.0 ELSE 0.0 END AS official_max
    FROM (SELECT year, exam, count(*) AS n, sum(points) AS p FROM items GROUP BY ALL)""",
    ),
    "human": (
        [],
        f"""
    SELECT *, CASE WHEN year % 3 = 0 THEN 'histogram' ELSE 'reported' END AS human_mean_source,
           5.0 * (students + CASE WHEN {CREDIT} THEN 1 ELSE 0 END
                  + CASE WHEN year % 9 = 4 THEN 1 ELSE 0 END)::DOUBLE AS human_max
    FROM (SELECT {PERIOD} AS year, o_orderpriority AS exam,
                 100 * avg(o_totalprice) / 500000 AS human_pct, count(*) AS students,
                 100 * avg(floor(o_totalprice / 50000) * 50000 + 25000) / 500000
                     AS histogram_pct
          FROM orders GROUP BY ALL)""",
    ),
    "scores": (
        ["scored", "adjustments"],
        """
    SELECT *, 100 * total_score / possible_points AS model_pct,
           abs(possible_points - official_max) <= 1e-8 + 1e-5 * abs(official_max)
               AS complete_exam
    FROM (SELECT model, year, exam, count(*) AS questions,
                 any_value(official_items) AS official_questions,
                 any_value(fixed_bonus)::DOUBLE AS fixed_bonus,
                 any_value(official_max)::DOUBLE AS official_max,
                 count_if(answered_correctly) AS correct, count_if(attempted) AS attempted,
                 count_if(declined) AS declined,
                 count_if(NOT valid_selection AND NOT declined) AS no_valid_selections,
                 avg(multimodal::INT) AS multimodal_share,
                 count(*) + sum(awarded_points) + any_value(fixed_bonus) AS total_score,
                 count(*) + sum(question_points) + any_value(fixed_bonus) AS possible_points
          FROM scored JOIN adjustments USING (year, exam) GROUP BY model, year, exam)""",
    ),
    "composition": (
        ["items"],
        """
    SELECT year, exam, count(*) AS item_count, avg(multimodal::INT) AS multimodal_share,
           avg(has_associated_image::INT) AS associated_image_share,
           avg(has_option_image::INT) AS option_image_share,
           avg((points = 3)::INT) AS three_point_share,
           avg((points = 5)::INT) AS five_point_share
    FROM items GROUP BY year, exam""",
    ),
    # one row per (year, exam, series); the ensemble is the mean of the model series
    "panel": (
        ["scores", "human", "composition"],
        """
    SELECT s.year, s.exam, s.series, s.model_pct, h.human_pct, h.human_mean_source, h.students,
           h.histogram_pct, c.item_count, c.multimodal_share, c.associated_image_share,
           c.option_image_share
    FROM (SELECT year, exam, model AS series, model_pct FROM scores
          UNION ALL
          SELECT year, exam, 'ensemble', avg(model_pct) FROM scores GROUP BY year, exam) s
    JOIN human h USING (year, exam) JOIN composition c USING (year, exam)""",
    ),
}


def oracle(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named tables (and what they read), then ``extra``, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in TABLES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({TABLES[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def rounded(*names: str, digits: int = 6) -> str:
    """``round(x, digits) AS x`` for every name."""
    return ", ".join(f"round({name}, {digits}) AS {name}" for name in names)
