"""Registered queries: prospective forecasts and yearly changes.

The SQL twins join every target with all its earlier rows, a formulation independent of the
windows and running sums on the Spark side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.operators import forecast as fc
from examlens.operators import regressions as reg
from examlens.plans import adapters as a
from examlens.plans.oracle_stats import (
    bounds,
    draws_sql,
    eliminate,
    moments_sql,
    pair,
    pairs,
    samples,
)
from examlens.plans.oracle_tables import oracle, rounded
from examlens.plans.queries_panel import TERMS_SQL
from examlens.plans.registry import register, round_doubles

_FORMS = fc.FORECASTS


def _targets(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, exam ORDER BY year) - 1
        AS training_years FROM {source}) WHERE training_years >= 8"""


def _forward_sql(source: str, forms: dict[str, list[str]], y: str) -> str:
    """(series, exam, year, specification, observed, predicted) by joining earlier rows."""
    names = sorted({p for predictors in forms.values() for p in predictors})
    columns = [y, *names]
    sums = ", ".join(
        ["count(*) AS n"]
        + [f"avg(p.{c}) AS a_{c}" for c in columns]
        + [
            f"covar_pop(p.{x1}, p.{x2}) AS t_{pair(x1, x2)}"
            for x1, x2 in pairs(columns)
        ]
    )
    keys = ["series", "exam", "year"]
    base = f"""SELECT t.series, t.exam, t.year, {sums}
        FROM ({_targets(source)}) t JOIN {source} p
          ON p.series = t.series AND p.exam = t.exam AND p.year < t.year
        GROUP BY t.series, t.exam, t.year"""
    parts = []
    for label, predictors in forms.items():
        prediction, joins = f"b.a_{y}", ""
        for i, term in enumerate(predictors):
            others = [x for x in predictors if x != term]
            fit = eliminate("base", keys, "t", [y, *predictors], others)
            joins += f""" JOIN (SELECT series, exam, year, e_{pair(y, term)}
                / e_{pair(term, term)} AS c{i} FROM ({fit})) f{i} USING (series, exam, year)"""
            prediction += f" + c{i} * (t.{term} - b.a_{term})"
        parts.append(
            f"""SELECT series, exam, year, '{label}' AS specification, t.training_years,
                t.{y} AS observed, {prediction} AS predicted
                FROM ({_targets(source)}) t JOIN base b USING (series, exam, year){joins}"""
        )
    return f"WITH base AS ({base}) " + " UNION ALL ".join(parts)


def _errors_sql(source: str, forms: dict[str, list[str]], y: str = "human_pct") -> str:
    return f"""SELECT *, observed - predicted AS error,
        max(observed - predicted) FILTER (WHERE specification = 'Grade mean')
            OVER (PARTITION BY series, exam, year) AS baseline_error,
        max(observed - predicted) FILTER (WHERE specification = 'Visual share')
            OVER (PARTITION BY series, exam, year) AS visual_error
        FROM ({_forward_sql(source, forms, y)})"""


_METRICS = """count(*) AS predictions, round(avg(abs(error)), 6) AS mae,
    round(avg(abs(baseline_error)), 6) AS baseline_mae,
    round(1 - sum(error ** 2) / sum(baseline_error ** 2), 6) AS forward_r2,
    count_if(abs(error) < abs(baseline_error)) AS years_beating_baseline"""


def _change_sql(
    errors: str, keys: list[str], draws: str, values: tuple[str, ...] = ("baseline", "visual")
) -> str:
    """Interval of the mean absolute error change per key."""
    names = {"baseline": "mae_change", "visual": "mae_change_vs_visual"}
    head = ", ".join(keys)
    sums = ", ".join(f"sum(abs(error) - abs({v}_error)) AS {v}" for v in values)
    means = ", ".join(f"sum(weight * {v}) / sum(weight * n) AS {v}" for v in values)
    out = ", ".join(bounds(v, names[v]) for v in values)
    return f"""SELECT {head}, {out}, {samples(values[0])}
        FROM (SELECT {head}, rep, {means}
              FROM (SELECT {head}, year, count(*) AS n, {sums} FROM {errors} GROUP BY {head}, year)
              JOIN {draws} USING ({head}, year) GROUP BY {head}, rep) GROUP BY {head}"""


_E = {"errors": _errors_sql("panel", _FORMS)}


@register(
    "w3_forward_errors",
    oracle(
        f"""SELECT series, exam, year, specification, training_years,
                   {rounded('observed', 'predicted', 'error', 'baseline_error', 'visual_error')}
            FROM errors""",
        "panel",
        extra=_E,
    ),
)
def w3(spark, sf_dir):
    return round_doubles(fc.forward_errors(a.panel(spark, sf_dir)))


@register(
    "g34_forecast_by_grade",
    oracle(
        f"""SELECT series, exam, specification, {_METRICS},
                   round(avg(abs(error) - abs(baseline_error)), 6) AS mae_change
            FROM errors GROUP BY series, exam, specification""",
        "panel",
        extra=_E,
    ),
)
def g34(spark, sf_dir):
    errors = fc.forward_errors(a.panel(spark, sf_dir))
    return round_doubles(fc.per_grade_summary(errors))


_KEYS = ["series", "specification"]


def _pooled_sql(errors: str, draws: str) -> str:
    return f"""SELECT m.*, c.* EXCLUDE (series, specification), g.grades_beating_baseline_mae
        FROM (SELECT series, specification, {_METRICS} FROM {errors} GROUP BY ALL) m
        JOIN ({_change_sql(errors, _KEYS, draws)}) c USING (series, specification)
        JOIN (SELECT series, specification, count_if(x < b) AS grades_beating_baseline_mae
              FROM (SELECT series, specification, exam, avg(abs(error)) AS x,
                           avg(abs(baseline_error)) AS b FROM {errors} GROUP BY ALL)
              GROUP BY series, specification) g USING (series, specification)"""


@register(
    "g35_forecast_pooled",
    oracle(
        _pooled_sql("errors", "draws"),
        "panel",
        extra={**_E, "draws": draws_sql("errors", "year", 5200, _KEYS)},
    ),
)
def g35(spark, sf_dir):
    errors = fc.forward_errors(a.panel(spark, sf_dir))
    return _unsigned_zeros(round_doubles(fc.pooled_summary(errors)))


def _unsigned_zeros(frame):
    """Rounded differences of equal numbers may be -0.0 in one engine."""
    return frame.withColumns(
        {n: F.col(n) + F.lit(0.0) for n, kind in frame.dtypes if kind == "double"}
    )


_RECENT = """SELECT * FROM (SELECT series, exam, year, human_pct AS observed,
        row_number() OVER w - 1 AS training_years,
        avg(human_pct) OVER (PARTITION BY series, exam ORDER BY year
                             ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS predicted
    FROM panel WINDOW w AS (PARTITION BY series, exam ORDER BY year)) WHERE training_years >= 8"""


@register(
    "w4_recent_mean_errors",
    oracle(
        f"""SELECT series, exam, year, training_years, {rounded('observed', 'predicted')},
                   round(observed - predicted, 6) AS error FROM ({_RECENT})""",
        "panel",
    ),
)
def w4(spark, sf_dir):
    return round_doubles(fc.recent_mean_errors(a.panel(spark, sf_dir)))


def _shared_sql(source: str, predictors: list[str]) -> str:
    """Shared-slope forecasts from a join of every target with all earlier rows."""
    y = "human_pct"
    columns = [y, *predictors]
    keys = ["series", "year"]
    group_sums = ", ".join(
        ["count(*) AS n"] + [f"covar_pop({x1}, {x2}) * count(*) AS q_{pair(x1, x2)}" for x1, x2 in pairs(columns)]
    )
    pooled = f"""SELECT series, year, {', '.join(f'sum(q_{pair(x1, x2)}) AS t_{pair(x1, x2)}' for x1, x2 in pairs(columns))}
        FROM (SELECT p.series, t.year, p.exam, {group_sums}
              FROM (SELECT DISTINCT series, year FROM {source}) t JOIN {source} p
                ON p.series = t.series AND p.year < t.year GROUP BY p.series, t.year, p.exam)
        GROUP BY series, year"""
    prediction, joins = "m.a_human_pct", ""
    for i, term in enumerate(predictors):
        others = [x for x in predictors if x != term]
        fit = eliminate("pooled", keys, "t", columns, others)
        joins += f""" JOIN (SELECT series, year, e_{pair(y, term)} / e_{pair(term, term)} AS c{i}
            FROM ({fit})) f{i} USING (series, year)"""
        prediction += f" + c{i} * (t.{term} - m.a_{term})"
    means = ", ".join(f"avg(p.{c}) AS a_{c}" for c in columns)
    return f"""WITH pooled AS ({pooled})
        SELECT series, exam, year, t.training_years, t.human_pct AS observed,
               {prediction} AS predicted, t.human_pct - ({prediction}) AS error
        FROM ({_targets(source)}) t
        JOIN (SELECT t.series, t.exam, t.year, {means} FROM {source} t JOIN {source} p
              ON p.series = t.series AND p.exam = t.exam AND p.year < t.year GROUP BY ALL) m
        USING (series, exam, year){joins}"""


@register(
    "w7_shared_slope_errors",
    oracle(
        f"""SELECT series, exam, year, training_years, {rounded('observed', 'predicted', 'error')}
            FROM ({_shared_sql('panel', ['model_pct'])})""",
        "panel",
    ),
)
def w7(spark, sf_dir):
    return round_doubles(fc.shared_slope_errors(a.panel(spark, sf_dir), ["model_pct"]))


_W8_PREDICTORS = reg.NONLINEAR["Model score x visual share"]


@register(
    "w8_shared_interaction_errors",
    oracle(
        f"""SELECT series, exam, year, training_years, {rounded('observed', 'predicted', 'error')}
            FROM ({_shared_sql('terms', _W8_PREDICTORS)})""",
        "panel",
        extra={"terms": TERMS_SQL},
    ),
)
def w8(spark, sf_dir):
    terms = reg.nonlinear_terms(a.panel(spark, sf_dir))
    return round_doubles(fc.shared_slope_errors(terms, _W8_PREDICTORS))


_W9_ROWS = f"""SELECT s.*, r.baseline_error, r.visual_error FROM (
      SELECT 'none' AS series, 'Recent mean (last three years)' AS specification, exam, year,
             observed - predicted AS error FROM ({_RECENT}) WHERE series = 'ensemble'
      UNION ALL SELECT series, 'Model score, shared slope', exam, year, error
      FROM ({_shared_sql('panel', ['model_pct'])})) s
    JOIN (SELECT exam, year, baseline_error, visual_error FROM errors
          WHERE series = 'ensemble' AND specification = 'Grade mean') r USING (exam, year)"""


@register(
    "w9_forward_sensitivity",
    oracle(
        f"""SELECT m.*, c.* EXCLUDE (series, specification)
            FROM (SELECT series, specification, {_METRICS} FROM rows9 GROUP BY ALL) m
            JOIN ({_change_sql('rows9', _KEYS, 'draws')}) c USING (series, specification)""",
        "panel",
        extra={**_E, "rows9": _W9_ROWS, "draws": draws_sql("rows9", "year", 5500, _KEYS)},
    ),
)
def w9(spark, sf_dir):
    panel = a.panel(spark, sf_dir)
    return round_doubles(fc.forward_sensitivity(panel, fc.forward_errors(panel)))


_CHANGES = """SELECT series, exam, year, training_years,
        CASE WHEN training_years >= 3 THEN human_pct - rh END AS human_change,
        CASE WHEN training_years >= 3 THEN model_pct - rm END AS model_change
    FROM (SELECT *, row_number() OVER (PARTITION BY series, exam ORDER BY year) - 1 AS training_years,
                 avg(human_pct) OVER r AS rh, avg(model_pct) OVER r AS rm FROM panel
          WINDOW r AS (PARTITION BY series, exam ORDER BY year
                       ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
_INCREMENT = """SELECT series, exam, year, human_change AS baseline_error, slope,
        human_change - slope * model_change AS error
    FROM changes t JOIN (
        SELECT o.series, o.year, sum(c.human_change * c.model_change) / sum(c.model_change ** 2) AS slope
        FROM (SELECT DISTINCT series, year FROM changes) o
        JOIN changes c ON c.series = o.series AND c.year < o.year GROUP BY ALL) s
    USING (series, year) WHERE training_years >= 8"""


@register(
    "w5_recent_mean_increment",
    oracle(
        f"""SELECT m.*, c.* EXCLUDE (series) FROM (
              SELECT series, {_METRICS}, round(10 * max_by(slope, year), 6) AS final_slope_per_10pp_model
              FROM inc GROUP BY series) m
            JOIN ({_change_sql('inc', ['series'], 'draws', ('baseline',))}) c USING (series)""",
        "panel",
        extra={
            "changes": _CHANGES,
            "inc": _INCREMENT,
            "draws": draws_sql("inc", "year", 6000, ["series"]),
        },
    ),
)
def w5(spark, sf_dir):
    return round_doubles(fc.recent_mean_increment(a.panel(spark, sf_dir)))


def _r(x: str, y: str) -> str:
    return f"(t_{pair(x, y)} / sqrt(t_{pair(x, x)} * t_{pair(y, y)}))"


_PARTIAL = f"""({_r('human', 'model')} - {_r('human', 'visual')} * {_r('model', 'visual')})
    / sqrt((1 - {_r('human', 'visual')} ** 2) * (1 - {_r('model', 'visual')} ** 2))"""


@register(
    "w6_change_correlations",
    oracle(
        f"""SELECT series, max(n) FILTER (WHERE rep = 0)::BIGINT AS changes,
                   {bounds('r', 'correlation')}, {bounds('p', 'partial_correlation_given_visual')},
                   {samples('r')}
            FROM (SELECT series, rep, n, {_r('human', 'model')} AS r, {_PARTIAL} AS p FROM m)
            GROUP BY series""",
        "panel",
        extra={
            "d": """SELECT * FROM (SELECT series, exam, year, year - lag(year) OVER w AS gap,
                      human_pct - lag(human_pct) OVER w AS human,
                      model_pct - lag(model_pct) OVER w AS model,
                      multimodal_share - lag(multimodal_share) OVER w AS visual
                    FROM panel WINDOW w AS (PARTITION BY series, exam ORDER BY year)) WHERE gap = 1""",
            "draws": draws_sql("d", "year", 6200),
            "m": moments_sql("d", ["human", "model", "visual"], ["series"], None),
        },
    ),
)
def w6(spark, sf_dir):
    return round_doubles(fc.change_correlations(a.panel(spark, sf_dir)))


_HIST = {
    "e": "SELECT * FROM panel WHERE series = 'ensemble'",
    "herrors": _errors_sql("e", _FORMS, "histogram_pct"),
    "draws": draws_sql("herrors", "year", 5200, _KEYS),
}


def _of(label: str, value: str, name: str) -> str:
    return f"max({value}) FILTER (WHERE specification = '{label}') AS {name}"


@register(
    "g33_human_mean_sensitivity",
    oracle(
        f"""SELECT * FROM (
              SELECT count(gap) AS forms_reported,
                     count_if(human_mean_source = 'histogram') AS forms_estimated,
                     round(avg(gap), 6) AS midpoint_minus_reported_mean,
                     round(avg(abs(gap)), 6) AS midpoint_minus_reported_mae,
                     round(max(abs(gap)), 6) AS midpoint_minus_reported_max_abs
              FROM (SELECT *, CASE WHEN human_mean_source = 'reported'
                                   THEN histogram_pct - human_pct END AS gap FROM e)),
            (SELECT {_of('Grade mean', 'mae', 'forward_baseline_mae')},
                 {_of('Visual share', 'mae', 'forward_visual_mae')},
                 {_of('Model score', 'mae', 'forward_ensemble_mae')},
                 {_of('Model score', 'mae_change', 'forward_ensemble_mae_change')},
                 {_of('Model score', 'mae_change_ci_low', 'forward_ensemble_mae_change_ci_low')},
                 {_of('Model score', 'mae_change_ci_high', 'forward_ensemble_mae_change_ci_high')}
                 FROM ({_pooled_sql('herrors', 'draws')}))""",
        "panel",
        extra=_HIST,
    ),
)
def g33(spark, sf_dir):
    return round_doubles(fc.human_mean_sensitivity(a.panel(spark, sf_dir)))


_NONLINEAR_OWN = {"Grade mean": [], "Visual share": ["multimodal_share"]} | {
    k: v for k, v in reg.NONLINEAR.items() if k != "Model score + visual share"
}


def _nonlinear_rows() -> str:
    shared = " UNION ALL ".join(
        f"SELECT series, exam, year, '{label}' AS specification, error FROM ({_shared_sql('terms', predictors)})"
        for label, predictors in reg.NONLINEAR.items()
    )
    return f"""SELECT series, exam, year, specification, 'Per grade' AS form, error,
            baseline_error, visual_error FROM own
            WHERE specification NOT IN ('Grade mean', 'Visual share')
        UNION ALL
        SELECT s.series, s.exam, s.year, s.specification, 'Shared across grades', s.error,
               o.baseline_error, v.error
        FROM ({shared}) s
        JOIN ({_shared_sql('terms', ['multimodal_share'])}) v USING (series, exam, year)
        JOIN (SELECT * FROM own WHERE specification = 'Grade mean') o USING (series, exam, year)"""


_NL_KEYS = ["series", "specification", "form"]


@register(
    "w8_nonlinear_forward",
    oracle(
        f"""SELECT m.*, c.* EXCLUDE (series, specification, form)
            FROM (SELECT series, specification, form, {_METRICS},
                         round(avg(abs(visual_error)), 6) AS visual_mae
                  FROM nl GROUP BY ALL) m
            JOIN ({_change_sql('nl', _NL_KEYS, 'draws')}) c USING (series, specification, form)""",
        "panel",
        extra={
            "terms": TERMS_SQL,
            "own": _errors_sql("terms", _NONLINEAR_OWN),
            "nl": _nonlinear_rows(),
            "draws": draws_sql("nl", "year", 8300, _NL_KEYS),
        },
    ),
)
def w8_forward(spark, sf_dir):
    return round_doubles(fc.nonlinear_forward(reg.nonlinear_terms(a.panel(spark, sf_dir))))
