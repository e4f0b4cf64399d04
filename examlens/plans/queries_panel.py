"""Registered queries: panel, ensembles, checks, correlations, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions.linalg import SWEEPS
from examlens.operators import checks, describe, moments, panel as panels, ranks, regressions as reg
from examlens.operators.bootstrap import row_correlation_interval
from examlens.operators.scoring import score_attempts
from examlens.plans import adapters as a
from examlens.plans.oracle_stats import (
    bounds,
    draws_sql,
    item_draws_sql,
    eliminate,
    moments_sql,
    pair,
    pairs,
    poisson_sql,
    samples,
)
from examlens.plans.oracle_tables import oracle, rounded
from examlens.plans.queries_describe import SLICES_SQL
from examlens.plans.registry import register, round_doubles

MODEL_NAMES = [name for name, _, _ in a.MODELS]


def _z(value: str, keys: str) -> str:
    return (
        f"coalesce(({value} - avg({value}) OVER (PARTITION BY {keys}))"
        f" / nullif(stddev_pop({value}) OVER (PARTITION BY {keys}), 0), 0)"
    )


ENSEMBLES_SQL = """SELECT year, exam, avg(model_pct) AS ensemble_pct,
        max(model_pct) FILTER (WHERE model = 'm1') AS reference_pct,
        count(model_pct) AS model_count,
        100 * avg(total_score) / min(possible_points) AS pooled_ensemble_pct,
        min(possible_points) AS possible_points
    FROM scores GROUP BY year, exam"""
COMPARISON_SQL = f"""SELECT *, human_difficulty * ensemble_difficulty < 0 AS opposite_difficulty_sign
    FROM (SELECT *, -{_z('human_pct', 'exam')} AS human_difficulty,
                 -{_z('ensemble_pct', 'exam')} AS ensemble_difficulty,
                 -{_z('reference_pct', 'exam')} AS reference_difficulty
          FROM ({ENSEMBLES_SQL}) JOIN human USING (year, exam))"""
LOMO_SQL = f"""SELECT exam, model_omitted,
        avg(abs(lomo - ensemble_difficulty)) AS mean_abs_deviation_sd,
        max(abs(lomo - ensemble_difficulty)) AS max_abs_deviation_sd,
        corr(human_difficulty, lomo) AS correlation_with_human
    FROM (SELECT *, -{_z('lomo_pct', 'exam, model_omitted')} AS lomo
          FROM (SELECT s.year, s.exam, s.model AS model_omitted,
                       (SELECT avg(o.model_pct) FROM scores o WHERE o.year = s.year
                        AND o.exam = s.exam AND o.model <> s.model) AS lomo_pct
                FROM scores s))
    JOIN comparison USING (year, exam) GROUP BY exam, model_omitted"""


@register(
    "g2_ensemble_scores",
    oracle(
        f"""SELECT year, exam, model_count, {rounded('ensemble_pct', 'reference_pct',
            'pooled_ensemble_pct', 'possible_points')} FROM ({ENSEMBLES_SQL})""",
        "scores",
    ),
)
def g2(spark, sf_dir):
    return round_doubles(panels.ensemble_scores(a.scores(spark, sf_dir), a.REFERENCE_MODEL))


@register(
    "g3_difficulty_panel",
    oracle(
        f"""SELECT year, exam, opposite_difficulty_sign, {rounded('human_pct', 'ensemble_pct',
            'human_difficulty', 'ensemble_difficulty', 'reference_difficulty')}
            FROM ({COMPARISON_SQL})""",
        "scores",
        "human",
    ),
)
def g3(spark, sf_dir):
    return round_doubles(
        a.comparison(spark, sf_dir).select(
            "year",
            "exam",
            "opposite_difficulty_sign",
            "human_pct",
            "ensemble_pct",
            "human_difficulty",
            "ensemble_difficulty",
            "reference_difficulty",
        )
    )


@register(
    "g4_lomo_deviation",
    oracle(
        f"""SELECT exam, model_omitted, {rounded('mean_abs_deviation_sd',
            'max_abs_deviation_sd', 'correlation_with_human')} FROM ({LOMO_SQL})""",
        "scores",
        "human",
        extra={"comparison": COMPARISON_SQL},
    ),
)
def g4(spark, sf_dir):
    return round_doubles(
        panels.lomo_deviations(a.scores(spark, sf_dir), a.comparison(spark, sf_dir))
    )


_PANEL_DOUBLES = ["model_pct", "human_pct", "histogram_pct", *reg.COMPOSITION]


@register(
    "g38_panel",
    oracle(
        f"""SELECT year, exam, series, human_mean_source, students, item_count,
                   {rounded(*_PANEL_DOUBLES)} FROM panel""",
        "panel",
    ),
)
def g38(spark, sf_dir):
    return round_doubles(
        a.panel(spark, sf_dir).select(
            "year", "exam", "series", "human_mean_source", "students", "item_count", *_PANEL_DOUBLES
        )
    )


@register(
    "s1_human_reference_pivot",
    oracle(
        "SELECT year, "
        + ", ".join(
            f"round(max(human_pct) FILTER (WHERE exam = '{g}'), 6) AS \"{g}\"" for g in a.GRADES
        )
        + " FROM human GROUP BY year",
        "human",
    ),
)
def s1(spark, sf_dir):
    wide = a.human(spark, sf_dir).groupBy("year").pivot("exam", a.GRADES).agg(F.max("human_pct"))
    return round_doubles(wide).orderBy("year")


@register(
    "v_panel_checks",
    oracle(
        """SELECT 'every series present' AS check, count(*) AS rows,
                  count_if(n <> 5) AS violations FROM p
           UNION ALL SELECT 'ensemble is the mean', count(*), count_if(abs(m - e) > 1e-6) FROM p
           UNION ALL SELECT 'human mean present', count(*), count_if(x > 0) FROM p""",
        "panel",
        extra={
            "p": """SELECT year, exam, count(DISTINCT series) AS n,
                    avg(model_pct) FILTER (WHERE series <> 'ensemble') AS m,
                    max(model_pct) FILTER (WHERE series = 'ensemble') AS e,
                    count_if(human_pct IS NULL) AS x FROM panel GROUP BY year, exam"""
        },
    ),
)
def v_panel(spark, sf_dir):
    return panels.panel_checks(a.panel(spark, sf_dir), MODEL_NAMES)


@register(
    "v1_v4_data_checks",
    oracle(
        """SELECT 'fixed bonus matches its parts' AS check, count(*) AS rows,
                  count_if(abs(fixed_bonus - additional_start_points - automatic_credit) > 1e-6)
                      AS violations FROM adjustments
           UNION ALL SELECT 'image flags agree', count(*),
                  count_if(multimodal <> (has_associated_image OR has_option_image)) FROM items
           UNION ALL SELECT 'every order has lines', count(*), abs(count(*) - (SELECT count(*) FROM orders))
           FROM (SELECT DISTINCT l_orderkey FROM lineitem)
           UNION ALL SELECT 'order lines unique', sum(n)::BIGINT, count_if(n > 1)
                  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
           UNION ALL SELECT 'one row per item', sum(n)::BIGINT, count_if(n > 1)
                  FROM (SELECT count(*) AS n FROM items GROUP BY item_id)
           UNION ALL SELECT 'labels cover documents', count(*), count_if(l.doc_id IS NULL)
                  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
           UNION ALL SELECT 'attempts cover items', count(*), count_if(i.item_id IS NULL)
                  FROM attempts t LEFT JOIN items i USING (item_id)""",
        "adjustments",
        "attempts",
    ),
)
def v_checks(spark, sf_dir):
    items, lines = a.items(spark, sf_dir), a.table(spark, sf_dir, "lineitem")
    adjustments = a.adjustments(spark, sf_dir)
    bonus_gap = F.abs(
        F.col("fixed_bonus") - F.col("additional_start_points") - F.col("automatic_credit")
    )
    flags = F.col("multimodal") == (F.col("has_associated_image") | F.col("has_option_image"))
    frames = [
        checks.predicate_check(adjustments, "fixed bonus matches its parts", bonus_gap <= 1e-6),
        checks.predicate_check(items, "image flags agree", flags),
        checks.row_count_check(
            lines.select("l_orderkey").distinct(),
            "every order has lines",
            a.table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar(),
        ),
        checks.unique_key_check(lines, "order lines unique", ["l_orderkey", "l_linenumber"]),
        checks.unique_key_check(items, "one row per item", ["item_id"]),
        checks.coverage_check(
            a.table(spark, sf_dir, "documents"),
            a.table(spark, sf_dir, "labels"),
            "labels cover documents",
            ["doc_id"],
        ),
        checks.coverage_check(a.attempts(spark, sf_dir), items, "attempts cover items", ["item_id"]),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@register(
    "b18_without_adjusted_forms",
    oracle(
        """SELECT year, exam, series, round(model_pct, 6) AS model_pct FROM panel
           WHERE (year, exam) NOT IN (SELECT (year, exam) FROM adjustments WHERE fixed_bonus > 0)""",
        "panel",
        "adjustments",
    ),
)
def b18(spark, sf_dir):
    adjusted = a.adjustments(spark, sf_dir).filter("fixed_bonus > 0")
    kept = reg.without_forms(a.panel(spark, sf_dir), adjusted)
    return round_doubles(kept.select("year", "exam", "series", "model_pct"))


@register(
    "w2_within_grade_deviation",
    oracle(
        """SELECT year, exam, series,
                  round(model_pct - avg(model_pct) OVER (PARTITION BY exam, series), 6) AS model_within,
                  round(human_pct - avg(human_pct) OVER (PARTITION BY exam, series), 6) AS human_within
           FROM panel""",
        "panel",
    ),
)
def w2(spark, sf_dir):
    return round_doubles(
        a.panel(spark, sf_dir).select(
            "year",
            "exam",
            "series",
            panels.demeaned("model_pct", ["exam", "series"]).alias("model_within"),
            panels.demeaned("human_pct", ["exam", "series"]).alias("human_within"),
        )
    )


# --- correlations -------------------------------------------------------------------------

_RANKED = """SELECT *, rank() OVER (PARTITION BY series ORDER BY round(human_pct, 9))
            + (count(*) OVER (PARTITION BY series, round(human_pct, 9)) - 1) / 2.0 AS rh,
        rank() OVER (PARTITION BY series ORDER BY round(model_pct, 9))
            + (count(*) OVER (PARTITION BY series, round(model_pct, 9)) - 1) / 2.0 AS rm
    FROM panel"""


def _p_value(r: str) -> str:
    """Two-sided p from the finite t series, with gamma ratios for its coefficients."""
    odd = f"""1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * (SELECT
        sum(sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(1 - {r} * {r}, j))
        FROM range(0, ((n - 3) / 2)::BIGINT) t(j)))"""
    even = f"""1 - abs({r}) * (SELECT
        sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(1 - {r} * {r}, j))
        FROM range(0, ((n - 2) / 2)::BIGINT) t(j))"""
    return f"CASE WHEN (n - 2) % 2 = 1 THEN {odd} ELSE {even} END"


@register(
    "e1_e2_pooled_correlations",
    oracle(
        f"""SELECT series, n AS comparisons, {rounded('pearson_r', 'spearman_rho')},
                   round({_p_value('pearson_r')}, 6) AS pearson_p,
                   round({_p_value('spearman_rho')}, 6) AS spearman_p
            FROM (SELECT series, count(*) AS n, corr(human_pct, model_pct) AS pearson_r,
                         corr(rh, rm) AS spearman_rho FROM ranked GROUP BY series)""",
        "panel",
        extra={"ranked": _RANKED},
    ),
)
def e1(spark, sf_dir):
    return round_doubles(reg.pooled_correlations(a.panel(spark, sf_dir)))


_T_CORR = f"t_{pair('human_pct', 'model_pct')} / nullif(sqrt(t_{pair('human_pct', 'human_pct')} * t_{pair('model_pct', 'model_pct')}), 0)"


@register(
    "e18_model_correlations",
    oracle(
        f"""SELECT p.*, s.* EXCLUDE (series, bootstrap_samples)
            FROM (SELECT series, {bounds('r', 'pearson_r')}, {samples('r')}
                  FROM (SELECT series, rep, {_T_CORR} AS r FROM m) GROUP BY series) p
            JOIN (SELECT series, {bounds('rho', 'spearman_rho')}, {samples('rho')}
                  FROM (SELECT series, rep,
                               (sum(weight * rh * rm) - sum(weight * rh) * sum(weight * rm) / sum(weight))
                               / nullif(sqrt((sum(weight * rh * rh) - sum(weight * rh) ** 2 / sum(weight))
                                    * (sum(weight * rm * rm) - sum(weight * rm) ** 2 / sum(weight))), 0) AS rho
                        FROM ranked GROUP BY series, rep) GROUP BY series) s
            USING (series)""",
        "panel",
        extra={
            "draws": draws_sql("panel", "year", 4900, ["series"]),
            "m": moments_sql("panel", ["human_pct", "model_pct"], ["series"], None, draw_keys=["series"]),
            "draws2": draws_sql("panel", "year", 4901, ["series"]),
            "ranked": """SELECT series, rep, weight,
                sum(weight) OVER (PARTITION BY series, rep ORDER BY round(human_pct, 9))
                  - (sum(weight) OVER (PARTITION BY series, rep, round(human_pct, 9)) - 1) / 2 AS rh,
                sum(weight) OVER (PARTITION BY series, rep ORDER BY round(model_pct, 9))
                  - (sum(weight) OVER (PARTITION BY series, rep, round(model_pct, 9)) - 1) / 2 AS rm
                FROM panel JOIN draws2 USING (series, year)""",
        },
    ),
)
def e18(spark, sf_dir):
    panel = a.panel(spark, sf_dir)
    pearson = reg.pearson_intervals(panel, ["series"], "year", 4900)
    spearman = reg.spearman_intervals(panel, ["series"], "year", 4901).drop("bootstrap_samples")
    return round_doubles(pearson.join(spearman, "series"))


_DETREND = eliminate(
    "m0", ["exam"], "t", ["human_pct", "model_pct", "year"], ["year"]
)


@register(
    "e19_per_grade_correlations",
    oracle(
        f"""SELECT exam, comparisons, round(e_human_pct__model_pct
                   / sqrt(e_human_pct__human_pct * e_model_pct__model_pct), 6)
                   AS year_detrended_pearson_r, b.* EXCLUDE (exam)
            FROM ({_DETREND}) JOIN (SELECT exam, n::BIGINT AS comparisons FROM m0) USING (exam)
            JOIN (SELECT exam, {bounds('r', 'pearson_r')}, {samples('r')}
                  FROM (SELECT exam, rep, {_T_CORR} AS r FROM m) GROUP BY exam) b USING (exam)""",
        "panel",
        extra={
            "e": "SELECT * FROM panel WHERE series = 'ensemble'",
            "draws": draws_sql("e", "year", 4400, ["exam"]),
            "m": moments_sql("e", ["human_pct", "model_pct"], ["exam"], None, draw_keys=["exam"]),
            "m0": moments_sql("e", ["human_pct", "model_pct", "year"], ["exam"], None, None),
        },
    ),
)
def e19(spark, sf_dir):
    return round_doubles(reg.per_grade_correlations(a.panel(spark, sf_dir)))


_S_CORR = "t_ensemble_accuracy__human_pct / sqrt(t_human_pct__human_pct * t_ensemble_accuracy__ensemble_accuracy)"
_SLICE_JOIN = {
    "sl": f"SELECT * FROM ({SLICES_SQL}) JOIN (SELECT year, exam, human_pct FROM human) USING (year, exam)",
    "draws": draws_sql("sl", "year", 4500),
    "m": moments_sql("sl", ["human_pct", "ensemble_accuracy"], ["slice"], "exam"),
}


@register(
    "e19_slice_correlations",
    oracle(
        f"""SELECT slice, max(n)::BIGINT AS comparisons, {bounds('r', 'pearson_r')},
                   {bounds('b', 'grade_fe_accuracy_pp_per_10pp_human')}, {samples('r')}
            FROM (SELECT slice, rep, CASE WHEN rep = 0 THEN n END AS n, {_S_CORR} AS r,
                         1000 * w_ensemble_accuracy__human_pct / w_human_pct__human_pct AS b FROM m)
            GROUP BY slice""",
        "scored",
        "human",
        extra=_SLICE_JOIN,
    ),
)
def e19_slices(spark, sf_dir):
    slices = describe.slice_scores(a.scored(spark, sf_dir))
    return round_doubles(reg.slice_correlations(slices, a.panel(spark, sf_dir)))


@register(
    "e7_iid_correlation_ci",
    oracle(
        f"SELECT exam, series, {bounds('r', 'pearson_r')}, {samples('r')} FROM p GROUP BY exam, series",
        "scores",
        "human",
        extra={
            "comparison": COMPARISON_SQL,
            "d": """SELECT printf('%05d', year) || '|' || exam AS k, exam, 'reference' AS series,
                           human_difficulty, reference_difficulty AS model_difficulty FROM comparison
                    UNION ALL SELECT printf('%05d', year) || '|' || exam, exam, 'ensemble',
                           human_difficulty, ensemble_difficulty FROM comparison""",
            "p": poisson_sql("d", "exam, series", "k", "human_difficulty", "model_difficulty", 3000),
        },
    ),
)
def e7(spark, sf_dir):
    rows = panels.materialize(
        reg.difficulty_series(a.comparison(spark, sf_dir)), "difficulty"
    )
    return round_doubles(
        reg.iid_correlation_interval(
            rows, ["exam", "series"], ("human_difficulty", "model_difficulty"), 3000
        )
    )


_FACT_REPETITIONS = 40


@register(
    "e7_fact_row_bootstrap",
    f"""WITH p AS ({poisson_sql('lineitem', 'l_returnflag', "l_orderkey || '|' || l_linenumber", 'l_quantity', 'l_extendedprice', 3100, _FACT_REPETITIONS)})
        SELECT l_returnflag, {bounds('r', 'pearson_r')}, {samples('r')} FROM p GROUP BY l_returnflag""",
)
def e7_fact(spark, sf_dir):
    """Row bootstrap of price against quantity over all order lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return round_doubles(
        row_correlation_interval(
            lines, ["l_returnflag"], ("l_quantity", "l_extendedprice"), ["l_orderkey", "l_linenumber"], 3100, _FACT_REPETITIONS
        )
    )


@register(
    "e2_fact_spearman",
    f"""WITH l AS (SELECT 'all' AS lines, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem
              UNION ALL SELECT l_returnflag, l_extendedprice::DOUBLE, l_quantity::DOUBLE FROM lineitem),
        r AS (SELECT lines, rank() OVER (PARTITION BY lines ORDER BY x) + (count(*) OVER (PARTITION BY lines, x) - 1) / 2.0 AS rx,
                     rank() OVER (PARTITION BY lines ORDER BY y) + (count(*) OVER (PARTITION BY lines, y) - 1) / 2.0 AS ry FROM l)
        SELECT lines, count(*) AS rows, round(corr(rx, ry), 9) AS spearman_rho FROM r GROUP BY lines""",
)
def e2_fact(spark, sf_dir):
    """Rank correlation of price and quantity over all order lines, and by return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    every = ranks.spearman(lines, [], "l_extendedprice", "l_quantity").select(F.lit("all").alias("lines"), "rows", "spearman_rho")
    flagged = ranks.spearman(lines, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return round_doubles(every.unionByName(flagged.withColumnRenamed("l_returnflag", "lines")), 9)


# --- calibration, early/late, headline statistics --------------------------------------------

_LONG_DIFFICULTY = """SELECT year, exam, 'reference' AS series, human_difficulty AS h,
        reference_difficulty AS m FROM comparison
    UNION ALL SELECT year, exam, 'ensemble', human_difficulty, ensemble_difficulty FROM comparison"""
_CALIBRATION = """SELECT exam, series, corr(h, m) AS correlation,
        avg(((h > 0) = (m > 0))::INT) AS same_side_rate, regr_intercept(h, m) AS intercept,
        regr_slope(h, m) AS slope, regr_r2(h, m) AS r2 FROM d GROUP BY exam, series"""
_OUT_OF_SAMPLE = """SELECT exam, series, split_year,
        1 - sum((h - ea - eb * m) ** 2) FILTER (WHERE late)
            / (count(*) FILTER (WHERE late) * var_pop(h) FILTER (WHERE late)) AS early_to_late_r2,
        1 - sum((h - la - lb * m) ** 2) FILTER (WHERE NOT late)
            / (count(*) FILTER (WHERE NOT late) * var_pop(h) FILTER (WHERE NOT late)) AS late_to_early_r2
    FROM (SELECT *, year >= split_year AS late FROM d
          JOIN (SELECT exam, series, median(year)::BIGINT AS split_year,
                       FROM d GROUP BY exam, series) USING (exam, series)
          JOIN (SELECT exam, series, regr_slope(h, m) FILTER (WHERE year < sy) AS eb,
                       regr_intercept(h, m) FILTER (WHERE year < sy) AS ea,
                       regr_slope(h, m) FILTER (WHERE year >= sy) AS lb,
                       regr_intercept(h, m) FILTER (WHERE year >= sy) AS la
                FROM d JOIN (SELECT exam, series, median(year) AS sy FROM d GROUP BY exam, series)
                USING (exam, series) GROUP BY exam, series) USING (exam, series))
    GROUP BY exam, series, split_year"""
_DIFFICULTY_EXTRA = {"comparison": COMPARISON_SQL, "d": _LONG_DIFFICULTY}


@register(
    "e6_calibration",
    oracle(
        f"""SELECT exam, series, {rounded('correlation', 'same_side_rate', 'intercept', 'slope', 'r2')}
            FROM ({_CALIBRATION})""",
        "scores",
        "human",
        extra=_DIFFICULTY_EXTRA,
    ),
)
def e6(spark, sf_dir):
    return round_doubles(reg.calibration(a.comparison(spark, sf_dir)))


@register(
    "e5_out_of_sample_r2",
    oracle(
        f"""SELECT exam, series, split_year, {rounded('early_to_late_r2', 'late_to_early_r2')}
            FROM ({_OUT_OF_SAMPLE})""",
        "scores",
        "human",
        extra=_DIFFICULTY_EXTRA,
    ),
)
def e5(spark, sf_dir):
    return round_doubles(reg.out_of_sample(a.comparison(spark, sf_dir)))


@register(
    "e20_pooled_statistics",
    oracle(
        f"""SELECT comparisons, human_years, grade_buckets, opposite_sign_count,
                   round(opposite_sign_count / comparisons, 6) AS opposite_sign_rate,
                   round(r, 6) AS mean_per_grade_reference_correlation,
                   round(e, 6) AS mean_per_grade_ensemble_correlation,
                   round(dev, 6) AS max_lomo_deviation_sd, neg AS all_oos_r2_negative
            FROM (SELECT count(*) AS comparisons, count(DISTINCT year) AS human_years,
                         count(DISTINCT exam) AS grade_buckets,
                         count_if(opposite_difficulty_sign) AS opposite_sign_count FROM comparison),
                 (SELECT avg(correlation) FILTER (WHERE series = 'reference') AS r,
                         avg(correlation) FILTER (WHERE series = 'ensemble') AS e
                  FROM ({_CALIBRATION})),
                 (SELECT max(max_abs_deviation_sd) AS dev FROM ({LOMO_SQL})),
                 (SELECT bool_and(early_to_late_r2 < 0 AND late_to_early_r2 < 0) AS neg
                  FROM ({_OUT_OF_SAMPLE}))""",
        "scores",
        "human",
        extra=_DIFFICULTY_EXTRA,
    ),
)
def e20(spark, sf_dir):
    scores = panels.materialize(a.scores(spark, sf_dir), "scores")
    comparison = panels.comparison_panel(scores, a.human(spark, sf_dir), a.REFERENCE_MODEL)
    return round_doubles(
        reg.pooled_statistics(comparison, panels.lomo_deviations(scores, comparison))
    )


_ENSEMBLE = {"e": "SELECT * FROM panel WHERE series = 'ensemble'"}


@register(
    "e17_year_effect_slope",
    oracle(
        """SELECT round(regr_slope(m, h), 6) AS year_fe_human_pct_coefficient,
                  round(10 * regr_slope(m, h), 6) AS year_fe_effect_per_10pp
           FROM (SELECT model_pct - avg(model_pct) OVER (PARTITION BY year) AS m,
                        human_pct - avg(human_pct) OVER (PARTITION BY year) AS h FROM e)""",
        "panel",
        extra=_ENSEMBLE,
    ),
)
def e17(spark, sf_dir):
    return round_doubles(reg.year_effect_slope(a.panel(spark, sf_dir)))


@register(
    "e21_trend_lines",
    oracle(
        """SELECT 'raw' AS view, round(regr_slope(model_pct, human_pct), 6) AS slope,
                  round(regr_intercept(model_pct, human_pct), 6) AS intercept FROM e
           UNION ALL SELECT 'within exam', round(regr_slope(m, h), 6),
                  round(regr_intercept(m, h), 6) + 0.0
           FROM (SELECT model_pct - avg(model_pct) OVER (PARTITION BY exam) AS m,
                        human_pct - avg(human_pct) OVER (PARTITION BY exam) AS h FROM e)""",
        "panel",
        extra=_ENSEMBLE,
    ),
)
def e21(spark, sf_dir):
    lines = round_doubles(reg.trend_lines(a.panel(spark, sf_dir)))
    # a rounded intercept of the centred line is 0; adding 0.0 removes a negative sign
    return lines.withColumn("intercept", F.col("intercept") + F.lit(0.0))


@register(
    "e22_within_grade_metrics",
    oracle(
        """SELECT round(corr(v, t), 6) AS within_grade_visual_share_year_correlation,
                  round(sqrt(sum(h * h) / (count(*) - 1)), 6) AS human_sd_within_grade,
                  round(1 - sum(h * h) / (count(*) * var_pop(human_pct)), 6) AS human_r2_grade,
                  round(1 - sum(r * r) / (count(*) * var_pop(human_pct)), 6) AS human_r2_grade_year
           FROM (SELECT *, h - avg(h) OVER (PARTITION BY year) AS r
                 FROM (SELECT *, multimodal_share - avg(multimodal_share) OVER (PARTITION BY exam) AS v,
                              year - avg(year) OVER (PARTITION BY exam) AS t,
                              human_pct - avg(human_pct) OVER (PARTITION BY exam) AS h FROM e))""",
        "panel",
        extra=_ENSEMBLE,
    ),
)
def e22(spark, sf_dir):
    return round_doubles(reg.within_grade_metrics(a.panel(spark, sf_dir), a.GRADES))


# --- regressions with cluster intervals ---------------------------------------------------

_COLUMNS = ["human_pct", "model_pct", *reg.COMPOSITION]


def _fit_rows(keys: list[str], outcome: str, term: str, scale: float) -> str:
    """Coefficient of ``term``, r² with and without it, for every specification."""
    using = ", ".join(keys)
    parts = []
    for label, (covariates, absorbed) in reg.SPECIFICATIONS.items():
        prefix = "w" if absorbed else "t"
        columns = [outcome, term, *covariates]
        after = eliminate("m", keys, prefix, columns, covariates)
        yy = pair(outcome, outcome)
        parts.append(
            f"""SELECT {', '.join('f.' + k for k in keys)}, '{label}' AS specification,
                '{', '.join(covariates) or 'none'}' AS covariates,
                '{'exam' if absorbed else 'none'}' AS fixed_effects,
                {scale} * e_{pair(outcome, term)} / nullif(e_{pair(term, term)}, 0) AS beta,
                1 - (e_{yy} - e_{pair(outcome, term)} ** 2 / nullif(e_{pair(term, term)}, 0)) / t_{yy} AS r2_full,
                1 - e_{yy} / t_{yy} AS r2_baseline,
                e_{pair(outcome, term)} / nullif(sqrt(e_{yy} * e_{pair(term, term)}), 0) AS partial_r
                FROM ({after}) f JOIN m USING ({using})"""
        )
    return " UNION ALL ".join(parts)


def _at_zero(name: str) -> str:
    return f"round(max({name}) FILTER (WHERE rep = 0), 6) AS {name}"


@register(
    "e12_outcome_regressions",
    oracle(
        f"""SELECT series, specification, covariates, fixed_effects,
                   {bounds('beta', 'effect_per_10pp_model')}, {samples('beta')},
                   {_at_zero('r2_full')}, {_at_zero('r2_baseline')},
                   round(max(r2_full - r2_baseline) FILTER (WHERE rep = 0), 6) AS r2_increment
            FROM ({_fit_rows(['series', 'rep'], 'human_pct', 'model_pct', 10)})
            GROUP BY series, specification, covariates, fixed_effects""",
        "panel",
        extra={
            "draws": draws_sql("panel", "year", 5100),
            "m": moments_sql("panel", _COLUMNS, ["series"], "exam"),
        },
    ),
)
def e12(spark, sf_dir):
    out = round_doubles(reg.outcome_regressions(a.panel(spark, sf_dir)))
    # the baseline of the raw form explains nothing; drop the sign of a rounded zero
    return out.withColumn("r2_baseline", F.col("r2_baseline") + F.lit(0.0))


@register(
    "e12b_controlled_models",
    oracle(
        f"""SELECT specification, covariates, fixed_effects,
                   {bounds('beta', 'effect_per_10pp_human')}, {samples('beta')},
                   round(max(r2_full) FILTER (WHERE rep = 0), 6) AS r2,
                   round(max(partial_r) FILTER (WHERE rep = 0), 6) AS partial_correlation,
                   -- an intercept per exam or one, the human mean, and the listed covariates
                   (1 + CASE WHEN fixed_effects = 'none' THEN 1 ELSE (SELECT count(DISTINCT exam) FROM e) END
                    + CASE WHEN covariates = 'none' THEN 0 ELSE len(string_split(covariates, ', ')) END)::BIGINT AS parameters,
                   (1 + CASE WHEN fixed_effects = 'none' THEN 1 ELSE (SELECT count(DISTINCT exam) FROM e) END
                    {' '.join(f"+ (list_contains(string_split(covariates, ', '), '{c}') AND (SELECT max(v) FROM (SELECT var_pop({c}) AS v FROM e GROUP BY exam)) > 0)::INT" for c in _COLUMNS[2:])})::BIGINT AS rank
            FROM ({_fit_rows(['rep'], 'model_pct', 'human_pct', 10)})
            GROUP BY specification, covariates, fixed_effects""",
        "panel",
        extra={
            **_ENSEMBLE,
            "draws": draws_sql("e", "year", 4300),
            "m": moments_sql("e", _COLUMNS, [], "exam"),
        },
    ),
)
def e12b(spark, sf_dir):
    return round_doubles(
        reg.controlled_models(a.panel(spark, sf_dir)).drop("condition_number")
    )


def _design_sql() -> str:
    """Rows of every controlled design: the intercept, predictors, a dummy per exam but the first."""
    dummies = "list_transform((SELECT list_sort(list(DISTINCT exam)) FROM e)[2:], lambda level: (exam = level)::INT::DOUBLE)"
    return " UNION ALL ".join(
        f"""SELECT '{label}' AS specification, [1.0::DOUBLE, human_pct{''.join(f', {c}' for c in covariates)}]
            {'|| ' + dummies if absorbed else ''} AS x FROM e"""
        for label, (covariates, absorbed) in reg.SPECIFICATIONS.items()
    )


def _jacobi_sql(name: str) -> str:
    """One Jacobi rotation of the flattened matrix ``m`` (k rows) per step of the recursion."""

    def row(i: str, j: str) -> str:
        first, second = f"m[p * k + {j} + 1]", f"m[q * k + {j} + 1]"
        return f"(CASE WHEN {i} = p THEN c * {first} - s * {second} WHEN {i} = q THEN s * {first} + c * {second} ELSE m[{i} * k + {j} + 1] END)"

    i, j = "(z // k)", "(z % k)"
    entry = f"""CASE WHEN {j} = p THEN c * {row(i, 'p')} - s * {row(i, 'q')} WHEN {j} = q THEN s * {row(i, 'p')} + c * {row(i, 'q')}
        ELSE {row(i, j)} END"""
    return f"""SELECT specification, k, m, 0::BIGINT AS t FROM design
        UNION ALL SELECT specification, k, CASE WHEN off_ = 0 THEN m ELSE list_transform(range(k * k), lambda z: {entry}) END, t + 1 FROM (
          SELECT *, 1 / sqrt(tan_ * tan_ + 1) AS c, tan_ / sqrt(tan_ * tan_ + 1) AS s FROM (
            SELECT *, CASE WHEN theta < 0 THEN -1.0 ELSE 1.0 END::DOUBLE / (abs(theta) + sqrt(theta * theta + 1)) AS tan_ FROM (
              SELECT *, m[p * k + q + 1] AS off_, (m[q * k + q + 1] - m[p * k + p + 1]) / (2 * m[p * k + q + 1]) AS theta FROM (
                SELECT {name}.*, pairs.p, pairs.q FROM {name} JOIN pairs ON pairs.size = k AND pairs.place = t % (k * (k - 1) // 2)
                WHERE t < {SWEEPS} * (k * (k - 1) // 2)))))"""


@register(
    "t6_design_conditioning",
    oracle(
        """SELECT specification, count(*) FILTER (v > 1e-8 * top)::BIGINT AS rank, any_value(k) AS parameters,
                  round(CASE WHEN min(v) > 0 THEN max(v) / min(v) ELSE 'inf'::DOUBLE END, 6) AS condition_number
           FROM (SELECT *, max(v) OVER (PARTITION BY specification) AS top FROM (
               SELECT specification, k, sqrt(greatest(unnest(list_transform(range(k), lambda i: m[i * k + i + 1])), 0)) AS v
               FROM rotated QUALIFY t = max(t) OVER (PARTITION BY specification)))
           GROUP BY specification""",
        "panel",
        extra={
            **_ENSEMBLE,
            "rows_": _design_sql(),
            "cross_": """SELECT specification, len(x) AS k, i, j, sum(x[i] * x[j]) AS v
                FROM rows_, range(1, 40) a(i), range(1, 40) b(j) WHERE i <= len(x) AND j <= len(x) GROUP BY ALL""",
            "design": "SELECT specification, k, list(v ORDER BY i, j) AS m FROM cross_ GROUP BY specification, k",
            "pairs": """SELECT k AS size, p, q, row_number() OVER (PARTITION BY k ORDER BY p, q) - 1 AS place
                FROM (SELECT DISTINCT k FROM design), range(0, 40) a(p), range(0, 40) b(q) WHERE p < q AND q < k""",
            "rotated": _jacobi_sql("rotated"),
        },
    ),
)
def t6(spark, sf_dir):
    """Rank, parameters and condition number of the controlled designs."""
    return round_doubles(
        reg.controlled_models(a.panel(spark, sf_dir)).select(
            "specification", "rank", "parameters", "condition_number"
        )
    )


@register(
    "e11_coefficient",
    oracle(
        f"""SELECT series, {bounds('b', 'coefficient')}, {samples('b')},
                   round(max(1 - (e_model_pct__model_pct - e_model_pct__option_image_share ** 2
                         / e_option_image_share__option_image_share) / t) FILTER (WHERE rep = 0), 6) AS r2
            FROM (SELECT series, rep, e_model_pct__option_image_share
                         / e_option_image_share__option_image_share AS b, * EXCLUDE (series, rep)
                  FROM ({eliminate('m', ['series', 'rep'], 'w', ['model_pct', 'option_image_share', 'associated_image_share'], ['associated_image_share'])}))
            JOIN (SELECT series, rep, t_model_pct__model_pct AS t FROM m) USING (series, rep)
            GROUP BY series""",
        "panel",
        extra={
            "draws": draws_sql("panel", "year", 81, ["series"]),
            "m": moments_sql(
                "panel",
                ["model_pct", "option_image_share", "associated_image_share"],
                ["series"],
                "exam",
                draw_keys=["series"],
            ),
        },
    ),
)
def e11(spark, sf_dir):
    return round_doubles(
        reg.coefficient(
            a.panel(spark, sf_dir),
            "model_pct",
            ["option_image_share", "associated_image_share"],
            "exam",
            "option_image_share",
            ["series"],
            "year",
            81,
        )
    )


# year effects out first, then exam effects under the replicate's weights (balanced panel)
def _two_way_sql(source: str, by: list[str], x: str, y: str) -> dict[str, str]:
    keys = "".join(f"{k}, " for k in by)
    return {
        "yd": f"""SELECT {keys}year, exam,
                  {x} - avg({x}) OVER (PARTITION BY {keys}year) AS x,
                  {y} - avg({y}) OVER (PARTITION BY {keys}year) AS y FROM {source}""",
        "m2": moments_sql("yd", ["x", "y"], by, "exam"),
    }


_LOO = """SELECT series, 'Grade FE, leave one year out' AS check,
        max(k) AS comparisons, round(avg(b), 6) AS effect_per_10pp_model,
        round(min(b), 6) AS ci_low_per_10pp, round(max(b), 6) AS ci_high_per_10pp
    FROM (SELECT series, omitted, count(*) AS k, 10 * regr_slope(y, x) AS b
          FROM (SELECT p.series, o.year AS omitted,
                       model_pct - avg(model_pct) OVER (PARTITION BY p.series, o.year, exam) AS x,
                       human_pct - avg(human_pct) OVER (PARTITION BY p.series, o.year, exam) AS y
                FROM panel p JOIN (SELECT DISTINCT year FROM panel) o ON p.year <> o.year)
          GROUP BY series, omitted) GROUP BY series"""


def _three(value: str) -> str:
    return (
        f"round(max({value}) FILTER (WHERE rep = 0), 6) AS effect_per_10pp_model, "
        f"round(quantile_cont({value}, 0.025) FILTER (WHERE rep > 0), 6) AS ci_low_per_10pp, "
        f"round(quantile_cont({value}, 0.975) FILTER (WHERE rep > 0), 6) AS ci_high_per_10pp"
    )


@register(
    "e13_sensitivity_checks",
    oracle(
        f"""SELECT series, 'Grade FE, excluding fixed-credit forms' AS check,
                   max(n) FILTER (WHERE rep = 0)::BIGINT AS comparisons, {_three('b')}
            FROM (SELECT series, rep, n, 10 * w_human_pct__model_pct / w_model_pct__model_pct AS b FROM m)
            GROUP BY series
            UNION ALL
            SELECT series, 'Grade + year FE', max(n) FILTER (WHERE rep = 0)::BIGINT, {_three('b')}
            FROM (SELECT series, rep, n, 10 * w_x__y / w_x__x AS b FROM m2) GROUP BY series
            UNION ALL {_LOO}""",
        "panel",
        "adjustments",
        extra={
            "draws": draws_sql("panel", "year", 5400),
            "reduced": """SELECT * FROM panel WHERE (year, exam) NOT IN
                          (SELECT (year, exam) FROM adjustments WHERE fixed_bonus > 0)""",
            "m": moments_sql("reduced", ["human_pct", "model_pct"], ["series"], "exam"),
            **_two_way_sql("panel", ["series"], "model_pct", "human_pct"),
        },
    ),
)
def e13(spark, sf_dir):
    adjusted = a.adjustments(spark, sf_dir).filter("fixed_bonus > 0")
    return round_doubles(reg.sensitivity_checks(a.panel(spark, sf_dir), adjusted, a.GRADES))


_OUTCOMES = """SELECT year, exam, multimodal_share, associated_image_share, option_image_share,
        series AS outcome, model_pct AS value, year::DOUBLE AS trend FROM panel
    UNION ALL SELECT year, exam, multimodal_share, associated_image_share, option_image_share,
        'human_pct', human_pct, year::DOUBLE FROM panel WHERE series = 'ensemble'"""
_OUTCOME_COLUMNS = ["value", *reg.COMPOSITION, "trend"]


def _explained(covariates: list[str]) -> str:
    return eliminate("m", ["outcome", "rep"], "w", ["value", *covariates], covariates)


_TREND_FIT = eliminate(
    "m", ["outcome", "rep"], "w", ["value", "multimodal_share", "trend"], ["trend"]
)


@register(
    "e14_variance_decomposition",
    oracle(
        f"""SELECT outcome, {bounds('inc', 'visual_r2_increment')},
                   {bounds('b', 'effect_per_10pp_visual_share')},
                   {bounds('bt', 'effect_per_10pp_visual_share_trend')},
                   {bounds('by2', 'effect_per_10pp_visual_share_year_fe')},
                   {samples('inc')}, {_at_zero('sd_total')}, {_at_zero('sd_within_grade')},
                   {_at_zero('r2_grade')}, {_at_zero('r2_grade_visual')}, {_at_zero('r2_grade_location')}
            FROM (SELECT m.outcome, m.rep, sqrt(m.t_value__value / (m.n - 1)) AS sd_total,
                         sqrt(m.w_value__value / (m.n - 1)) AS sd_within_grade,
                         1 - m.w_value__value / m.t_value__value AS r2_grade,
                         1 - v.e_value__value / m.t_value__value AS r2_grade_visual,
                         1 - l.e_value__value / m.t_value__value AS r2_grade_location,
                         (m.w_value__value - v.e_value__value) / m.t_value__value AS inc,
                         0.1 * m.w_multimodal_share__value / m.w_multimodal_share__multimodal_share AS b,
                         0.1 * t.e_multimodal_share__value / t.e_multimodal_share__multimodal_share AS bt,
                         0.1 * m2.w_x__y / m2.w_x__x AS by2
                  FROM m JOIN ({_explained(['multimodal_share'])}) v USING (outcome, rep)
                  JOIN ({_explained(['associated_image_share', 'option_image_share'])}) l USING (outcome, rep)
                  JOIN ({_TREND_FIT}) t USING (outcome, rep) JOIN m2 USING (outcome, rep))
            GROUP BY outcome""",
        "panel",
        extra={
            "o": _OUTCOMES,
            "draws": draws_sql("o", "year", 5300),
            "m": moments_sql("o", _OUTCOME_COLUMNS, ["outcome"], "exam"),
            **_two_way_sql("o", ["outcome"], "multimodal_share", "value"),
        },
    ),
)
def e14(spark, sf_dir):
    return round_doubles(reg.variance_decomposition(a.panel(spark, sf_dir), a.GRADES))


TERMS_SQL = """SELECT *, model * visual AS model_x_visual, model * model AS model_squared
    FROM (SELECT *, model_pct - avg(model_pct) OVER (PARTITION BY series) AS model,
                 multimodal_share - avg(multimodal_share) OVER (PARTITION BY series) AS visual,
                 avg(multimodal_share) OVER (PARTITION BY series) AS mean_visual FROM panel)"""
_TERMS = ["human_pct", "model", "visual", "model_x_visual", "model_squared"]


def _coef(term: str, predictors: list[str]) -> str:
    """``(keys, c)`` with the coefficient of one predictor: eliminate the others first."""
    others = [p for p in predictors if p != term]
    fit = eliminate("m", ["series", "rep"], "w", ["human_pct", *predictors], others)
    return f"""SELECT series, rep, e_{pair('human_pct', term)} / e_{pair(term, term)} AS c,
        e_human_pct__human_pct - e_{pair('human_pct', term)} ** 2 / e_{pair(term, term)} AS rss
        FROM ({fit})"""


def _nonlinear_sql() -> str:
    parts = []
    for label, predictors in reg.NONLINEAR.items():
        added = next((t for t in ("model_x_visual", "model_squared") if t in predictors), None)
        base = _coef("model", predictors)
        extra = _coef(added or "model", predictors)
        slopes = ", ".join(
            (
                f"10 * (b.c + ({at} - mean_visual) * x.c)"
                if added == "model_x_visual"
                else "NULL::DOUBLE"
            )
            + f" AS slope_per_10pp_at_visual_{round(100 * at)}"
            for at in reg.CONDITIONAL_SHARES
        )
        k = len(predictors) + 5
        parts.append(
            f"""SELECT series, rep, '{label}' AS specification,
                1 - b.rss / t_human_pct__human_pct AS r2,
                1 - (b.rss / t_human_pct__human_pct) * (n - 1) / (n - {k}) AS adjusted_r2,
                (a.rss - b.rss) / t_human_pct__human_pct AS r2_increment_over_additive,
                {'x.c' if added else 'NULL::DOUBLE'} AS added_term, {slopes}
                FROM m JOIN ({base}) b USING (series, rep) JOIN ({extra}) x USING (series, rep)
                JOIN ({_coef('model', ['model', 'visual'])}) a USING (series, rep)
                JOIN (SELECT series, any_value(mean_visual) AS mean_visual FROM terms GROUP BY series)
                USING (series)"""
        )
    return " UNION ALL ".join(parts)


_RESAMPLED = ["added_term"] + [
    f"slope_per_10pp_at_visual_{round(100 * at)}" for at in reg.CONDITIONAL_SHARES
]


@register(
    "e15_nonlinear_fits",
    oracle(
        f"""SELECT series, specification, {', '.join(_at_zero(n) for n in ['r2', 'adjusted_r2'])},
                   round(max(r2_increment_over_additive) FILTER (WHERE rep = 0), 6) + 0.0
                       AS r2_increment_over_additive,
                   {', '.join(bounds(n) for n in _RESAMPLED)}
            FROM ({_nonlinear_sql()}) GROUP BY series, specification""",
        "panel",
        extra={
            "terms": TERMS_SQL,
            "draws": draws_sql("panel", "year", 6300),
            "m": moments_sql("terms", _TERMS, ["series"], "exam"),
        },
    ),
)
def e15(spark, sf_dir):
    out = round_doubles(reg.nonlinear_fits(a.panel(spark, sf_dir)))
    name = "r2_increment_over_additive"
    return out.withColumn(name, F.col(name) + F.lit(0.0))


_CEILING_SQL = """SELECT 'All items' AS slice, year, exam, series, model_pct, human_pct FROM panel
    UNION ALL
    SELECT slice, year, exam, series, model_pct, human_pct FROM (
      SELECT slice, year, exam, series, avg(pct) AS model_pct FROM (
        SELECT CASE WHEN multimodal THEN 'Multimodal items' ELSE 'Text-only items' END AS slice,
               year, exam, model, unnest([model, 'ensemble']) AS series,
               100 * (count(*) + sum(awarded_points)) / (count(*) + sum(question_points)) AS pct
        FROM scored GROUP BY multimodal, year, exam, model) GROUP BY ALL)
    JOIN (SELECT year, exam, human_pct FROM human) USING (year, exam)"""
_ACCURACY_SQL = """SELECT slice, model AS series, avg(answered_correctly::INT) AS item_accuracy
    FROM (SELECT model, answered_correctly, unnest(['All items',
            CASE WHEN multimodal THEN 'Multimodal items' ELSE 'Text-only items' END]) AS slice
          FROM scored) GROUP BY ALL"""


@register(
    "g20_ceiling_checks",
    oracle(
        f"""SELECT slice, series, {bounds('b', 'effect_per_10pp_model')},
                   {_at_zero('mean_pct')}, {_at_zero('sd_within_grade')}, {_at_zero('within_grade_r')},
                   round(any_value(share), 6) AS share_at_least_95,
                   round(any_value(item_accuracy), 6) AS item_accuracy
            FROM (SELECT slice, series, rep, s_model_pct / n AS mean_pct,
                         sqrt(w_model_pct__model_pct / (n - 1)) AS sd_within_grade,
                         w_human_pct__model_pct / sqrt(w_human_pct__human_pct * w_model_pct__model_pct) AS within_grade_r,
                         10 * w_human_pct__model_pct / w_model_pct__model_pct AS b FROM m)
            JOIN (SELECT slice, series, avg((round(model_pct, 9) >= 95)::INT) AS share FROM c GROUP BY ALL)
                 USING (slice, series)
            LEFT JOIN ({_ACCURACY_SQL}) USING (slice, series) GROUP BY slice, series""",
        "panel",
        extra={
            "c": _CEILING_SQL,
            "draws": draws_sql("c", "year", 5101),
            "m": moments_sql("c", ["human_pct", "model_pct"], ["slice", "series"], "exam"),
        },
    ),
)
def g20(spark, sf_dir):
    cells = panels.materialize(reg.modality_cells(a.scored(spark, sf_dir)), "cells")
    return round_doubles(reg.ceiling_checks(a.panel(spark, sf_dir), cells))


@register(
    "g19_slice_panel",
    oracle(
        """SELECT slice, year, exam, series, round(model_pct, 6) AS model_pct,
                  round(human_pct, 6) AS human_pct FROM c WHERE slice <> 'All items'""",
        "panel",
        extra={"c": _CEILING_SQL},
    ),
)
def g19(spark, sf_dir):
    return round_doubles(
        reg.slice_panel(reg.modality_cells(a.scored(spark, sf_dir)), a.human(spark, sf_dir))
    )


# --- exposure -----------------------------------------------------------------------------

_FACTORS = {
    "subtype": ["00", "01", "10", "11"],
    "exam": a.GRADES,
    "points_tier": ["3", "4", "5"],
}


def _dummy_sql(factors: dict[str, list[str]]) -> tuple[list[str], str]:
    names, parts = [], []
    for factor, levels in factors.items():
        for i, level in enumerate(sorted(levels)[1:]):
            names.append(f"d_{factor}_{i}")
            parts.append(f"({factor} = '{level}')::INT::DOUBLE AS d_{factor}_{i}")
    return names, ", ".join(parts)


_DUMMIES, _DUMMY_COLUMNS = _dummy_sql(_FACTORS)
_CONTROLS_SQL = """SELECT *, answered_correctly::INT::DOUBLE AS correct, year / 10.0::DOUBLE AS decade,
        (has_associated_image::INT)::VARCHAR || (has_option_image::INT)::VARCHAR AS subtype,
        question_points::INT::VARCHAR AS points_tier FROM scored"""


def _trend_sql(cells: str, by: str, dummies: list[str], y: str, extra: str) -> str:
    fit = eliminate(extra, [by, "rep"], "t", ["decade", *dummies, y], dummies)
    return f"""SELECT {by}, {bounds('c', 'estimate')}, {samples('c')}
        FROM (SELECT {by}, rep, 100 * e_{pair('decade', y)} / e_decade__decade AS c FROM ({fit}))
        GROUP BY {by}"""


def _cells(spark, sf_dir):
    """Control cells of correctness, written once for the draws and the moments."""
    rows = reg.item_controls(a.scored(spark, sf_dir))
    return panels.materialize(reg.control_cells(rows, "correct", ["model"]), "cells")


@register(
    "e16_decade_trend",
    oracle(
        f"""SELECT t.*, units FROM ({_trend_sql('cells', 'model', _DUMMIES, 'correct', 'm')}) t
            JOIN (SELECT model, count(*) AS units FROM scored GROUP BY model) USING (model)""",
        "scored",
        extra={
            "controls": _CONTROLS_SQL,
            "cells": f"""SELECT model, year, decade, {_DUMMY_COLUMNS}, count(*)::DOUBLE AS w,
                         avg(correct) AS correct FROM controls
                         GROUP BY model, year, decade, subtype, exam, points_tier""",
            "draws": draws_sql("cells", "year", 6400, ["model"]),
            "m": moments_sql(
                "cells", ["decade", *_DUMMIES, "correct"], ["model"], None,
                draw_keys=["model"], weight="w",
            ),
        },
    ),
)
def e16_trend(spark, sf_dir):
    return round_doubles(reg.decade_trend(_cells(spark, sf_dir), ["model"], _FACTORS))


_PERIOD_START = 14
_PERIOD_TABLES = {
    "e": f"""SELECT *, later * model_pct AS model_x_later FROM (SELECT *, (year >= {_PERIOD_START})::INT::DOUBLE AS later,
             CASE WHEN year < {_PERIOD_START} THEN 'before {_PERIOD_START}'
                  ELSE '{_PERIOD_START} onward' END AS period
             FROM panel WHERE series = 'ensemble')""",
    "pdraws": draws_sql("e", "year", 6430, ["period"]),
    "mp": moments_sql("e", ["human_pct", "model_pct"], ["period"], "exam", "pdraws", draw_keys=["period"]),
    "draws": draws_sql("e", "year", 6430),
    "mi": moments_sql("e", ["human_pct", "model_pct", "later", "model_x_later"], [], "exam"),
    **_two_way_sql("e", [], "model_pct", "human_pct"),
}


@register(
    "e16_period_associations",
    oracle(
        f"""SELECT "check", units, {bounds('b', 'estimate')}, {samples('b')} FROM (
              SELECT 'Grade-FE association, contests ' || period AS check, rep,
                     10 * w_human_pct__model_pct / w_model_pct__model_pct AS b FROM mp
              UNION ALL SELECT 'Grade + year FE association, all contests', rep, 10 * w_x__y / w_x__x FROM m2
              UNION ALL SELECT 'Change in grade-FE association from {_PERIOD_START} on (interaction)', rep,
                     10 * e_human_pct__model_x_later / e_model_x_later__model_x_later
              FROM ({eliminate('mi', ['rep'], 'w', ['human_pct', 'model_pct', 'later', 'model_x_later'], ['model_pct', 'later'])}))
            JOIN (SELECT unnest(['Grade-FE association, contests ' || period,
                    'Grade + year FE association, all contests',
                    'Change in grade-FE association from {_PERIOD_START} on (interaction)']) AS check,
                    count(*) AS units FROM e GROUP BY 1) USING ("check")
            GROUP BY "check", units""",
        "panel",
        extra={
            **_PERIOD_TABLES,
        },
    ),
)
def e16_periods(spark, sf_dir):
    return round_doubles(
        reg.period_associations(a.panel(spark, sf_dir), _PERIOD_START, a.GRADES)
    )


_RECENT_KEYS = "after_cutoff, subtype, exam, points_tier"
_GAP_NAMES = ["after_cutoff", *_DUMMIES, "outcome"]


def _gap_tables(model: str | None, seed: int) -> dict[str, str]:
    """The draws over the design cells of the recent items and their moments, as table ``gm``."""
    where = f"AND model = '{model}'" if model else ""
    return {
        "recent": f"""SELECT model, (year = 26)::INT::DOUBLE AS after_cutoff, subtype, exam, points_tier,
                correct AS outcome, count(*)::BIGINT AS _n FROM controls WHERE year >= {_PERIOD_START} {where} GROUP BY ALL""",
        **item_draws_sql("recent", "model", f"{_RECENT_KEYS}, outcome", seed),
        "sampled": f"""SELECT model, rep, after_cutoff, {_DUMMY_COLUMNS}, sum(weight) AS w,
                sum(weight * outcome) / sum(weight) AS outcome
                FROM drawn JOIN placed USING (model, idx) GROUP BY model, rep, {_RECENT_KEYS} HAVING sum(weight) > 0""",
        "gm": f"""SELECT model, rep, {', '.join(f'sq_{pair(x, y)} - s_{x} * s_{y} / n AS t_{pair(x, y)}' for x, y in pairs(_GAP_NAMES))}
                FROM (SELECT model, rep, sum(w) AS n, {', '.join(f'sum(w * {c}) AS s_{c}' for c in _GAP_NAMES)},
                      {', '.join(f'sum(w * {x} * {y}) AS sq_{pair(x, y)}' for x, y in pairs(_GAP_NAMES))}
                      FROM sampled GROUP BY model, rep)""",
    }


def _gap_sql() -> str:
    fit = eliminate("gm", ["model", "rep"], "t", _GAP_NAMES, _DUMMIES)
    return f"""SELECT model, {bounds('c', 'estimate')}, {samples('c')} FROM (SELECT model, rep,
        100 * e_{pair('after_cutoff', 'outcome')} / e_after_cutoff__after_cutoff AS c FROM ({fit})) GROUP BY model"""


_PERIOD_CHECKS = f"""SELECT 'Grade-FE association, contests ' || period AS check, rep,
                     10 * w_human_pct__model_pct / w_model_pct__model_pct AS b FROM mp
              UNION ALL SELECT 'Grade + year FE association, all contests', rep, 10 * w_x__y / w_x__x FROM m2
              UNION ALL SELECT 'Change in grade-FE association from {_PERIOD_START} on (interaction)', rep,
                     10 * e_human_pct__model_x_later / e_model_x_later__model_x_later
              FROM ({eliminate('mi', ['rep'], 'w', ['human_pct', 'model_pct', 'later', 'model_x_later'], ['model_pct', 'later'])})"""
_REMOVAL_DUMMIES, _REMOVAL_COLUMNS = _dummy_sql({name: _FACTORS[name] for name in ("exam", "points_tier")})


def _cells_sql(source: str, value: str, dummies: str) -> str:
    return f"""SELECT model, year, decade, {dummies}, count(*)::DOUBLE AS w, avg({value}) AS {value}
        FROM {source} GROUP BY model, year, decade, subtype, exam, points_tier"""


def _trend_tables(prefix: str, source: str, value: str, dummies: list[str], columns: str, seed: int) -> dict[str, str]:
    return {
        f"{prefix}cells": _cells_sql(source, value, columns),
        f"{prefix}draws": draws_sql(f"{prefix}cells", "year", seed, ["model"]),
        f"{prefix}m": moments_sql(
            f"{prefix}cells", ["decade", *dummies, value], ["model"], None, f"{prefix}draws", draw_keys=["model"], weight="w"
        ),
    }


def _check_sql(check: str, estimates: str, source: str) -> str:
    return f"""SELECT '{check}' AS check, model AS series, units, estimate, estimate_ci_low, estimate_ci_high, 'pp' AS unit
        FROM ({estimates}) JOIN (SELECT model, count(*) AS units FROM {source} GROUP BY model) USING (model)"""


_RECENT = f"(SELECT model FROM controls WHERE year >= {_PERIOD_START} AND model = '{a.REFERENCE_MODEL}')"


@register(
    "e16_exposure_checks",
    oracle(
        " UNION ALL ".join(
            [
                _check_sql("Accuracy per later decade, at equal composition", _trend_sql("", "model", _DUMMIES, "correct", "tm"), "controls"),
                _check_sql(
                    f"Accuracy on 26 minus {_PERIOD_START}-25 items, at equal composition (item bootstrap)", _gap_sql(), _RECENT
                ),
                _check_sql(
                    "Image-removal effect per later decade",
                    _trend_sql("", "model", _REMOVAL_DUMMIES, "removal_effect", "rm"),
                    "removal",
                ),
                f"""SELECT "check", 'ensemble' AS series, units, {bounds('b', 'estimate')}, 'per 10 pp model %max' AS unit
                    FROM ({_PERIOD_CHECKS}) JOIN (SELECT unnest(['Grade-FE association, contests ' || period,
                        'Grade + year FE association, all contests',
                        'Change in grade-FE association from {_PERIOD_START} on (interaction)']) AS check,
                        count(*) AS units FROM e GROUP BY 1) USING ("check") GROUP BY "check", units""",
            ]
        ),
        "scored",
        "scored_blind",
        "panel",
        extra={
            "controls": _CONTROLS_SQL,
            **_trend_tables("t", "controls", "correct", _DUMMIES, _DUMMY_COLUMNS, 6400),
            **_gap_tables(a.REFERENCE_MODEL, 6410),
            "removal": """SELECT b.*, b.answered_correctly::INT::DOUBLE - f.answered_correctly::INT::DOUBLE AS removal_effect,
                    b.year / 10.0::DOUBLE AS decade,
                    (b.has_associated_image::INT)::VARCHAR || (b.has_option_image::INT)::VARCHAR AS subtype,
                    b.question_points::INT::VARCHAR AS points_tier
                    FROM scored_blind b JOIN scored f USING (model, item_id)""",
            **_trend_tables("r", "removal", "removal_effect", _REMOVAL_DUMMIES, _REMOVAL_COLUMNS, 6420),
            **_PERIOD_TABLES,
        },
    ),
)
def e16(spark, sf_dir):
    """All exposure checks as one table, with the removal effect of the blind run."""
    blind = score_attempts(a.blind_attempts(spark, sf_dir), a.items(spark, sf_dir))
    removal = reg.removal_rows(a.scored(spark, sf_dir), blind)
    return round_doubles(
        reg.exposure_checks(
            _cells(spark, sf_dir),
            panels.materialize(reg.control_cells(removal, "removal_effect", ["model"]), "cells"),
            a.panel(spark, sf_dir),
            a.GRADES,
            ["3", "4", "5"],
            (a.REFERENCE_MODEL, 26),
            _PERIOD_START,
        )
    )


@register(
    "e10_cutoff_gap_item_bootstrap",
    oracle(
        f"""SELECT g.*, units FROM ({_gap_sql()}) g JOIN (SELECT model, sum(_n)::BIGINT AS units FROM recent GROUP BY model)
            USING (model)""",
        "scored",
        extra={"controls": _CONTROLS_SQL, **_gap_tables(None, 6410)},
    ),
)
def e10(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return round_doubles(reg.cutoff_gap(cells, ["model"], 26, _PERIOD_START, _FACTORS))


# --- the fact-scale regression ----------------------------------------------------------------

_LINE_COLUMNS = ["l_extendedprice", "l_quantity", "l_discount"]


@register(
    "e3_fact_regression",
    oracle(
        f"""SELECT {bounds('c', 'quantity_effect', 4)}, {samples('c')},
                   round(max(1 - rss / t) FILTER (WHERE rep = 0), 6) AS r2,
                   max(n)::BIGINT AS rows
            FROM (SELECT rep, e_l_extendedprice__l_quantity / e_l_quantity__l_quantity AS c,
                         e_l_extendedprice__l_extendedprice
                           - e_l_extendedprice__l_quantity ** 2 / e_l_quantity__l_quantity AS rss
                  FROM ({eliminate('m', ['rep'], 'w', _LINE_COLUMNS, ['l_discount'])}))
            JOIN (SELECT rep, t_l_extendedprice__l_extendedprice AS t,
                         CASE WHEN rep = 0 THEN n END AS n FROM m) USING (rep)""",
        extra={
            "l": """SELECT *, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INTEGER AS month_no
                    FROM lineitem""",
            "draws": draws_sql("l", "month_no", 77),
            "m": moments_sql("l", _LINE_COLUMNS, [], "l_returnflag", cluster="month_no"),
        },
    ),
)
def e3(spark, sf_dir):
    """Price on quantity and discount over every line item, clustered by month."""
    from examlens.operators.bootstrap import cluster_draws, interval

    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("month_no")
    lines = a.table(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS, "l_returnflag", month)
    cells = panels.materialize(
        moments.centred_cells(lines, _LINE_COLUMNS, ["l_returnflag", "month_no"], []), "cells"
    )
    draws = cluster_draws(cells, "month_no", 77)
    fitted = moments.weighted_moments(cells, _LINE_COLUMNS, [], "l_returnflag", draws, "month_no")
    fit = moments.Fit(moments.within_gram, ["l_quantity", "l_discount"], "l_extendedprice")
    replicates = fitted.select(
        "rep",
        F.col("n").cast("bigint").alias("rows"),
        fit.coefficients["l_quantity"].alias("quantity_effect"),
        fit.r2.alias("r2"),
    )
    fitted_row = interval(replicates, [], ["quantity_effect"], plain=["r2", "rows"])
    digits = {"r2": 6}
    return fitted_row.select(
        *[F.round(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in fitted_row.dtypes]
    )


@register(
    "e3_shifted_regression",
    """SELECT l_returnflag,
              round(1e9 * regr_slope(l_extendedprice, epoch(o_orderdate::TIMESTAMP)), 4) AS per_gigasecond,
              round(regr_r2(l_extendedprice, epoch(o_orderdate::TIMESTAMP)), 9) AS r2
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag""",
)
def e3_shifted(spark, sf_dir):
    """Price on the order date in epoch seconds: large values that differ little."""
    orders = a.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("seconds"),
        F.year("o_orderdate").alias("year"),
    )
    lines = a.table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    fitted = reg.coefficient(
        lines, "l_extendedprice", ["seconds"], None, "seconds", ["l_returnflag"], "year", 91
    )
    return fitted.select(
        "l_returnflag",
        F.round(1e9 * F.col("coefficient"), 4).alias("per_gigasecond"),
        F.round("r2", 9).alias("r2"),
    )


@register(
    "e3_residual_rows",
    oracle(
        """SELECT series, year, exam, round(human_pct - r, 6) AS fitted, round(r, 6) AS residual FROM (
             SELECT *, y - x * sum(x * y) OVER (PARTITION BY series) / sum(x * x) OVER (PARTITION BY series) AS r
             FROM (SELECT *, human_pct - avg(human_pct) OVER (PARTITION BY series, exam) AS y,
                          model_pct - avg(model_pct) OVER (PARTITION BY series, exam) AS x FROM panel))""",
        "panel",
    ),
)
def e3_residuals(spark, sf_dir):
    """Fitted values and residuals of the human mean on the model score, an intercept per exam."""
    rows = reg.residual_rows(a.panel(spark, sf_dir), "human_pct", ["model_pct"], "exam", ["series"])
    return round_doubles(rows.select("series", "year", "exam", "fitted", "residual"))
