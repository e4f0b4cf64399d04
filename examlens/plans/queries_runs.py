"""Registered queries: paired runs, agreement, option order, later runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions.common import dealt
from examlens.operators import agreement as ag
from examlens.operators import bootstrap, later_runs, options, scoring
from examlens.plans import adapters as a
from examlens.plans import oracle_runs  # noqa: F401  (adds its tables)
from examlens.plans.oracle_runs import mapping_sql
from examlens.plans.oracle_stats import bounds, draws_sql, item_draws_sql, moments_sql, samples
from examlens.plans.oracle_tables import oracle, rounded
from examlens.plans.queries_forecast import _change_sql, _errors_sql, _shared_sql
from examlens.operators.forecast import FORECASTS
from examlens.plans.registry import register, round_doubles


def _scored(attempts, spark, sf_dir):
    return scoring.score_attempts(attempts(spark, sf_dir), a.items(spark, sf_dir))


def comparison_pairs(spark, sf_dir):
    """Base run against its repeat and against the run without images."""
    base = a.scored(spark, sf_dir)
    repeat = ag.paired(base, _scored(a.repeat_attempts, spark, sf_dir))
    blind = ag.paired(base, _scored(a.blind_attempts, spark, sf_dir))
    return repeat.withColumn("comparison", F.lit("Repeat minus base")).unionByName(
        blind.withColumn("comparison", F.lit("Images removed minus retained"))
    )


def _pairs_sql(second: str, label: str) -> str:
    columns = ["answered_correctly", "declined", "predicted_normalized", "awarded_points"]
    sides = ", ".join(
        f"f.{c} AS {c}_first, s.{c} AS {c}_second" for c in columns
    )
    return f"""SELECT '{label}' AS comparison, model, item_id, f.multimodal, {sides}
        FROM scored f JOIN {second} s USING (model, item_id)"""


_PAIRS = {
    "p": _pairs_sql("scored_repeat", "Repeat minus base")
    + " UNION ALL "
    + _pairs_sql("scored_blind", "Images removed minus retained")
}


@register(
    "g21_paired_comparison",
    oracle(
        """SELECT comparison, model, count(*) AS items,
                  round(avg(answered_correctly_first::INT), 6) AS accuracy_reference,
                  round(avg(answered_correctly_second::INT), 6) AS accuracy_treated,
                  round(100 * avg(answered_correctly_second::INT - answered_correctly_first::INT), 6)
                      AS difference_pp,
                  count_if(answered_correctly_first AND NOT answered_correctly_second) AS lost,
                  count_if(NOT answered_correctly_first AND answered_correctly_second) AS gained,
                  round(avg(declined_first::INT), 6) AS decline_rate_reference,
                  round(avg(declined_second::INT), 6) AS decline_rate_treated
           FROM p GROUP BY comparison, model""",
        "scored",
        "scored_repeat",
        "scored_blind",
        extra=_PAIRS,
    ),
)
def g21(spark, sf_dir):
    return round_doubles(
        ag.paired_comparison(comparison_pairs(spark, sf_dir), ["comparison", "model"])
    )


def _difference_sql(keys: str, seed: int) -> tuple[str, dict[str, str]]:
    """Item-bootstrap interval of the accuracy difference of the paired rows ``p``."""
    tables = {
        "cells_": f"""SELECT {keys}, answered_correctly_second::INT - answered_correctly_first::INT AS difference,
                count(*) AS _n FROM p GROUP BY ALL""",
        **item_draws_sql("cells_", keys, "difference", seed),
    }
    body = f"""SELECT {keys}, {bounds('m', 'difference_pp')}, {samples('m')} FROM (
            SELECT {keys}, rep, 100 * sum(weight * difference) / sum(weight) AS m
            FROM drawn JOIN placed USING ({keys}, idx) GROUP BY {keys}, rep) GROUP BY {keys}"""
    return body, tables


_DIFFERENCE_BODY, _DIFFERENCE_TABLES = _difference_sql("comparison, model", 5500)


@register(
    "e9_paired_difference_ci",
    oracle(_DIFFERENCE_BODY, "scored", "scored_repeat", "scored_blind", extra={**_PAIRS, **_DIFFERENCE_TABLES}),
)
def e9(spark, sf_dir):
    return round_doubles(
        ag.difference_interval(comparison_pairs(spark, sf_dir), ["comparison", "model"], 5500)
    )


def _agreement_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, items, {rounded('accuracy_first', 'accuracy_second', 'difference_pp',
            'same_outcome', 'same_letter')}, changed_points, changed_text_only,
            changed_multimodal, multimodal_items,
            round((same_outcome - c) / nullif(1 - c, 0), 6) AS kappa
        FROM (SELECT *, accuracy_first * accuracy_second
                     + (1 - accuracy_first) * (1 - accuracy_second) AS c
              FROM (SELECT {keys}, count(*) AS items,
                      avg(answered_correctly_first::INT) AS accuracy_first,
                      avg(answered_correctly_second::INT) AS accuracy_second,
                      100 * avg(answered_correctly_second::INT - answered_correctly_first::INT)
                          AS difference_pp,
                      avg((answered_correctly_first = answered_correctly_second)::INT) AS same_outcome,
                      avg((predicted_normalized_first = predicted_normalized_second)::INT) AS same_letter,
                      count_if(awarded_points_first <> awarded_points_second) AS changed_points,
                      count_if(answered_correctly_first <> answered_correctly_second
                               AND NOT multimodal) AS changed_text_only,
                      count_if(answered_correctly_first <> answered_correctly_second
                               AND multimodal) AS changed_multimodal,
                      count_if(multimodal) AS multimodal_items
                    FROM {source} GROUP BY {keys}))"""


@register(
    "g23_rerun_agreement",
    oracle(
        _agreement_sql("p", "model"),
        "scored",
        "scored_repeat",
        extra={"p": _pairs_sql("scored_repeat", "x")},
    ),
)
def g23(spark, sf_dir):
    pairs = ag.paired(a.scored(spark, sf_dir), _scored(a.repeat_attempts, spark, sf_dir))
    return round_doubles(ag.agreement(pairs, ["model"]))


RUNS = ["m4", "m4__repeat", "m4__option_order"]
RUN_PAIRS = [
    ("m4", "m4__repeat"),
    ("m4__repeat", "m4__option_order"),
    ("m4", "m4__option_order"),
]


def run_pairs(spark, sf_dir):
    """The base run and the later ones, scored together, side by side per item."""
    items = a.items(spark, sf_dir)
    base = a.attempts(spark, sf_dir).filter(F.col("model") == "m4")
    attempts = a.later_attempts(spark, sf_dir).drop("position").unionByName(base)
    runs = scoring.score_attempts(dealt(attempts, items.count(), "item_id"), items)
    return ag.run_pairs(runs, RUNS, RUN_PAIRS, ["multimodal"])


_RUN_PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{first}' AS first, '{second}' AS second, f.item_id, f.multimodal,
        {', '.join(f'f.{c} AS {c}_first, s.{c} AS {c}_second' for c in ag.OUTCOME)}
        FROM later_base f JOIN later_base s ON f.item_id = s.item_id
        WHERE f.model = '{first}' AND s.model = '{second}'"""
    for first, second in RUN_PAIRS
)
_SUBSETS_SQL = """SELECT * EXCLUDE (names), unnest(names) AS subset FROM (
    SELECT r.*, list_filter(['All items',
        CASE WHEN kept_order_reason = '' THEN 'Reordered' END,
        CASE WHEN kept_order_reason = '' AND old_answer <> new_answer THEN 'Reordered, key moved' END,
        CASE WHEN kept_order_reason = '' AND NOT multimodal THEN 'Reordered, text-only' END,
        CASE WHEN kept_order_reason = '' AND multimodal THEN 'Reordered, multimodal' END,
        CASE WHEN kept_order_reason <> '' THEN 'Order kept' END], lambda x: x IS NOT NULL) AS names
    FROM r JOIN order_mapping USING (item_id))"""


@register(
    "g24_subset_agreement",
    oracle(
        _agreement_sql("u", "subset, first, second"),
        "later_base",
        "order_mapping",
        extra={"r": _RUN_PAIRS_SQL, "u": _SUBSETS_SQL},
    ),
)
def g24(spark, sf_dir):
    return round_doubles(
        ag.subset_agreement(run_pairs(spark, sf_dir), a.order_mapping(spark, sf_dir))
    )


@register(
    "g24_exam_score_agreement",
    oracle(
        """SELECT first, second, round(corr(x, y), 6) AS exam_score_r,
                  round(corr(xw, yw), 6) AS exam_score_r_within_grade,
                  round(avg(abs(y - x)), 6) AS mean_abs_exam_score_change
           FROM (SELECT *, x - avg(x) OVER (PARTITION BY first, second, exam) AS xw,
                        y - avg(y) OVER (PARTITION BY first, second, exam) AS yw
                 FROM (SELECT f.series AS first, s.series AS second, exam, f.model_pct AS x,
                              s.model_pct AS y
                       FROM later_panel f JOIN later_panel s USING (year, exam)
                       WHERE (f.series, s.series) IN (VALUES """
        + ", ".join(f"('{x}', '{y}')" for x, y in RUN_PAIRS)
        + """))) GROUP BY first, second""",
        "later_panel",
    ),
)
def g24_exams(spark, sf_dir):
    return round_doubles(ag.exam_score_agreement(a.later_panel(spark, sf_dir), RUN_PAIRS))


@register(
    "g25_position_effects",
    oracle(
        """SELECT l.position, count_if(k = l.position) AS key_items,
                  round(avg(ok::INT) FILTER (WHERE k = l.position), 6) AS accuracy,
                  round(avg((k = l.position)::INT), 6) AS key_share,
                  round(avg((p = l.position)::INT), 6) AS chosen_share,
                  round(avg((p = l.position)::INT) FILTER (WHERE NOT ok AND p IN ('A','B','C','D','E')), 6)
                      AS wrong_answer_share,
                  count_if(printed = l.position) AS printed_order_key_items,
                  round(avg(pok::INT) FILTER (WHERE printed = l.position), 6) AS printed_order_accuracy
           FROM (SELECT m.new_answer AS k, u.position AS p, o.answered_correctly AS ok,
                        r.answer AS printed, r.answered_correctly AS pok
                 FROM order_mapping m JOIN unmapped u USING (item_id)
                 JOIN (SELECT * FROM later_scored WHERE model = 'm4__option_order') o USING (item_id)
                 JOIN (SELECT * FROM later_scored WHERE model = 'm4__repeat') r USING (item_id)
                 WHERE m.kept_order_reason = ''),
                (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(position)
           GROUP BY l.position""",
        "later_scored",
    ),
)
def g25(spark, sf_dir):
    later = a.later_scored(spark, sf_dir)
    return round_doubles(
        options.position_effects(
            later.filter(F.col("model") == "m4__option_order"),
            later.filter(F.col("model") == "m4__repeat"),
            a.order_mapping(spark, sf_dir),
        )
    )


@register(
    "c15_unmapped_positions",
    oracle("SELECT model, item_id, position, predicted FROM unmapped", "unmapped"),
)
def c15(spark, sf_dir):
    return options.unmap_positions(a.order_attempts(spark, sf_dir), a.order_mapping(spark, sf_dir))


@register(
    "g39_later_items",
    oracle(
        """SELECT model, item_id, predicted_normalized, answered_correctly, declined,
                  awarded_points::DOUBLE AS awarded_points FROM later_scored""",
        "later_scored",
    ),
)
def g39(spark, sf_dir):
    return a.later_scored(spark, sf_dir).select(
        "model", "item_id", "predicted_normalized", "answered_correctly", "declined", "awarded_points"
    )


@register(
    "c13_extended_panel",
    oracle(
        "SELECT year, exam, series, round(model_pct, 6) AS model_pct FROM later_panel",
        "later_panel",
    ),
)
def c13(spark, sf_dir):
    return round_doubles(
        a.later_panel(spark, sf_dir).select("year", "exam", "series", "model_pct")
    )


@register(
    "g27_fallback_metrics",
    oracle(
        """SELECT count_if(fallback_parse) AS fallback_rows, count_if(output_capped) AS capped_rows,
                  count_if(fallback_parse OR output_capped) AS fallback_or_capped_rows,
                  round(avg(ok) FILTER (WHERE fallback_parse), 6) AS first_letter_accuracy,
                  count_if(fallback_parse AND stated_answer IS NOT NULL) AS rows_with_stated_answer,
                  round(avg((stated_answer = answer)::INT)
                        FILTER (WHERE fallback_parse AND stated_answer IS NOT NULL), 6)
                      AS stated_answer_accuracy
           FROM (SELECT f.*, i.answer, coalesce(upper(trim(f.predicted)) = i.answer, false)::INT AS ok
                 FROM fallback_attempts f JOIN items i USING (item_id))""",
        "fallback_attempts",
    ),
)
def g27(spark, sf_dir):
    return round_doubles(
        later_runs.fallback_metrics(_scored(a.fallback_attempts, spark, sf_dir))
    )


_LP = {
    "errors": _errors_sql("later_panel", FORECASTS),
    "lp_changes": """SELECT series, exam, year, training_years,
        CASE WHEN training_years >= 3 THEN human_pct - rh END AS human_change,
        CASE WHEN training_years >= 3 THEN model_pct - rm END AS model_change
        FROM (SELECT *, row_number() OVER (PARTITION BY series, exam ORDER BY year) - 1 AS training_years,
                     avg(human_pct) OVER r AS rh, avg(model_pct) OVER r AS rm FROM later_panel
              WINDOW r AS (PARTITION BY series, exam ORDER BY year
                           ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""",
    "inc": """SELECT series, exam, year, human_change AS baseline_error,
                     human_change - slope * model_change AS error
              FROM lp_changes JOIN (
                SELECT o.series, o.year,
                       sum(c.human_change * c.model_change) / sum(c.model_change ** 2) AS slope
                FROM (SELECT DISTINCT series, year FROM lp_changes) o
                JOIN lp_changes c ON c.series = o.series AND c.year < o.year GROUP BY ALL)
              USING (series, year) WHERE training_years >= 8""",
    "stacked": f"""SELECT series, year, 'per_grade' AS comparison, error, baseline_error
                FROM errors WHERE specification = 'Model score'
            UNION ALL SELECT series, year, 'with_visual_vs_visual', error, visual_error
                FROM errors WHERE specification = 'Model score + visual share'
            UNION ALL SELECT s.series, s.year, 'shared_slope', s.error, e.baseline_error
                FROM ({_shared_sql('later_panel', ['model_pct'])}) s
                JOIN (SELECT * FROM errors WHERE specification = 'Grade mean') e
                USING (series, exam, year)
            UNION ALL SELECT series, year, 'recent_mean', error, baseline_error FROM inc""",
    "cdraws": draws_sql("stacked", "year", 7302, ["series", "comparison"]),
    "draws": draws_sql("later_panel", "year", 5101),
    "m": moments_sql("later_panel", ["human_pct", "model_pct"], ["series"], "exam"),
    "vdraws": draws_sql("later_panel", "year", 7200),
    "mv": moments_sql(
        "later_panel", ["model_pct", "multimodal_share"], ["series"], "exam", "vdraws"
    ),
}
_COMPARISONS = ["per_grade", "shared_slope", "with_visual_vs_visual", "recent_mean"]
_WIDE = ", ".join(
    f"max(mae_change{s}) FILTER (WHERE comparison = '{c}') AS mae_change_{c}{s}"
    for c in _COMPARISONS
    for s in ("", "_ci_low", "_ci_high")
)


@register(
    "g26_later_runs",
    oracle(
        f"""SELECT * FROM (
              SELECT series, {bounds('b', 'effect_per_10pp_model')},
                     round(max(mean_pct) FILTER (WHERE rep = 0), 6) AS mean_pct,
                     round(max(sd) FILTER (WHERE rep = 0), 6) AS sd_within_grade,
                     round(max(r) FILTER (WHERE rep = 0), 6) AS within_grade_r
              FROM (SELECT series, rep, 10 * w_human_pct__model_pct / w_model_pct__model_pct AS b,
                           s_model_pct / n AS mean_pct, sqrt(w_model_pct__model_pct / (n - 1)) AS sd,
                           w_human_pct__model_pct
                             / sqrt(w_human_pct__human_pct * w_model_pct__model_pct) AS r FROM m)
              GROUP BY series)
            JOIN (SELECT series, round(avg((round(model_pct, 9) >= 95)::INT), 6) AS share_at_least_95,
                         round(avg((abs(model_pct - 100) <= 1e-8 + 1e-3)::INT), 6) AS share_at_100
                  FROM later_panel GROUP BY series) USING (series)
            JOIN (SELECT series, {bounds('v', 'pct_per_10pp_visual_share')}
                  FROM (SELECT series, rep, w_model_pct__multimodal_share
                               / w_multimodal_share__multimodal_share / 10 AS v FROM mv)
                  GROUP BY series) USING (series)
            JOIN (SELECT series, {_WIDE}
                  FROM ({_change_sql('stacked', ['series', 'comparison'], 'cdraws', ('baseline',))})
                  GROUP BY series) USING (series)
            LEFT JOIN (SELECT model AS series, count(*) AS items,
                         round(avg(answered_correctly::INT), 6) AS item_accuracy,
                         round(avg(answered_correctly::INT) FILTER (WHERE NOT multimodal), 6)
                             AS text_only_accuracy,
                         round(avg(answered_correctly::INT) FILTER (WHERE multimodal), 6)
                             AS multimodal_accuracy,
                         round(avg(declined::INT), 6) AS declined_share
                       FROM later_scored GROUP BY model) USING (series)""",
        "later_panel",
        "later_scored",
        extra=_LP,
    ),
)
def g26(spark, sf_dir):
    return round_doubles(
        later_runs.later_runs(a.later_panel(spark, sf_dir), a.later_scored(spark, sf_dir))
    )


# --- option order ----------------------------------------------------------------------------

_REFERENCE_SQL = (
    r"\(\s*[A-E]\s*\)|\b[A-E]\)"
    r"|\b(?:Antwort|Antworten|Option|Aussage|Aussagen|Angabe|Angaben|Bild|Figur|Möglichkeit)\s+\(?[A-E]\b"
    r"|\b[A-E]\s*(?:,|und|oder|bis)\s+[A-E]\b"
    r"|\b(?:obige[nr]?|vorherige[nr]?|vorstehende[nr]?|vorangehende[nr]?|vorangegangene[nr]?)\b"
)
_SOLS = [f"coalesce(sol_{x}, '')" for x in "ABCDE"]
_REASON_SQL = f"""SELECT *, CASE WHEN has_option_image THEN 'option images'
    WHEN {' OR '.join(f"regexp_full_match(trim({s}), '[\\(\\[]?[A-Ea-e][\\)\\]]?\\.?')" for s in _SOLS)}
        THEN 'letter options'
    WHEN {' OR '.join(f"regexp_matches({s}, '{_REFERENCE_SQL}')" for s in [*_SOLS, 'problem_statement'])}
        THEN 'letter reference' ELSE '' END AS kept_order_reason FROM item_texts"""
_TEXT_EXTRA = {
    "reasons": _REASON_SQL,
    "text_mapping": mapping_sql("reasons"),
}


def shuffled_texts(spark, sf_dir):
    return options.shuffle_options(a.item_texts(spark, sf_dir))


@register(
    "i16_order_reason",
    oracle("SELECT item_id, kept_order_reason FROM reasons", "item_texts", extra=_TEXT_EXTRA),
)
def i16(spark, sf_dir):
    reason = options.order_reason(F.col("has_option_image"))
    return a.item_texts(spark, sf_dir).select("item_id", reason.alias("kept_order_reason"))


def _new_option(letter: str) -> str:
    cases = " ".join(f"WHEN '{x}' THEN sol_{x}" for x in "ABCDE")
    return f"CASE new_{letter}_source {cases} END AS sol_{letter}"


@register(
    "i17_shuffled_options",
    oracle(
        f"""SELECT m.*, m.new_answer AS answer, {', '.join(_new_option(x) for x in 'ABCDE')}
            FROM text_mapping m JOIN item_texts USING (item_id)""",
        "item_texts",
        extra=_TEXT_EXTRA,
    ),
)
def i17(spark, sf_dir):
    return shuffled_texts(spark, sf_dir).drop("problem_statement", "has_option_image")


@register(
    "i18_shuffle_audit",
    oracle(
        """SELECT measure, value, count(*) AS items FROM (
             SELECT 'order' AS measure, CASE WHEN kept_order_reason = '' THEN 'shuffled'
                    ELSE kept_order_reason END AS value FROM text_mapping
             UNION ALL SELECT 'key moved', 'yes' FROM text_mapping
                    WHERE kept_order_reason = '' AND old_answer <> new_answer
             UNION ALL SELECT 'key after', new_answer FROM text_mapping WHERE kept_order_reason = ''
             UNION ALL SELECT 'key before', old_answer FROM text_mapping WHERE kept_order_reason = '')
           GROUP BY measure, value""",
        "item_texts",
        extra=_TEXT_EXTRA,
    ),
)
def i18(spark, sf_dir):
    return options.shuffle_audit(options.option_mapping(shuffled_texts(spark, sf_dir)))


_SUBSET_BODY, _SUBSET_TABLES = _difference_sql("subset, first, second", 7300)


@register(
    "e9_subset_difference_ci",
    oracle(
        _SUBSET_BODY, "later_base", "order_mapping", extra={"r": _RUN_PAIRS_SQL, "p": _SUBSETS_SQL, **_SUBSET_TABLES}
    ),
)
def e9_subsets(spark, sf_dir):
    placed = run_pairs(spark, sf_dir).join(
        a.order_mapping(spark, sf_dir).select(
            "item_id", "kept_order_reason", "old_answer", "new_answer"
        ),
        "item_id",
    ).withColumn("subset", F.explode(ag.subset_memberships()))
    return round_doubles(
        ag.difference_interval(placed, ["subset", "first", "second"], 7300, bootstrap.REPETITIONS)
    )
