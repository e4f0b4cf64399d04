"""Registered queries: file formats, written from derived tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions.common import lookup, ordinal
from examlens.operators import bootstrap, describe, forecast, options, scoring
from examlens.operators.scoring import score_attempts
from examlens.plans import adapters as a
from examlens.plans import adapters_runs as ar
from examlens.plans import reports
from examlens.plans import oracle_runs  # noqa: F401  (adds its tables)
from examlens.plans.oracle_stats import bounds, draws_sql, samples
from examlens.plans.oracle_tables import oracle
from examlens.plans.queries_forecast import _E, _RECENT, _shared_sql
from examlens.plans.queries_panel import _ENSEMBLE, MODEL_NAMES
from examlens.plans.queries_responses import records
from examlens.plans.queries_usage import cohort_documents, event_stream
from examlens.plans.registry import register, round_doubles
from examlens.session import shared_folder
from examlens.sources import readers, schemas, writers
from examlens.streaming import usage_stream as us


def run_folder(spark, sf_dir):
    """Compact runs in one folder per run, as an archive holds them."""
    folder = shared_folder(spark, "runs")
    runs = a.attempts(spark, sf_dir).select(
        F.col("item_id").cast("string").alias("id"),
        F.col("item_id").cast("string").alias("source_id"),
        "predicted",
        "model",
    )
    for model in MODEL_NAMES:
        one = runs.filter(F.col("model") == model).drop("model")
        one.write.parquet(f"{folder}/run_{model}/results.parquet")
    return folder


@register(
    "a1_a3_multi_run_scan",
    oracle(
        """SELECT model, 'full' AS arm, count(*) AS rows, count(predicted) AS answered,
                  count_if(answered_correctly) AS correct
           FROM attempts JOIN (SELECT model, item_id, answered_correctly FROM scored) USING (model, item_id)
           GROUP BY model""",
        "scored",
    ),
)
def a3(spark, sf_dir):
    """All runs of an archive in one scan, tagged by folder, scored against the key."""
    catalogue = readers.run_catalogue(
        spark, [(f"run_{m}", m, "full", "base") for m in MODEL_NAMES]
    )
    runs = readers.read_runs(spark, run_folder(spark, sf_dir), catalogue)
    key = a.items(spark, sf_dir).withColumn("item_id", F.col("item_id").cast("string"))
    scored = score_attempts(runs, key)
    return scored.groupBy("model", "arm").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count("predicted").cast("bigint").alias("answered"),
        F.count_if("answered_correctly").cast("bigint").alias("correct"),
    )


@register(
    "a5_form_adjustments_csv",
    oracle(
        """SELECT year, exam, evaluated_items::INTEGER AS evaluated_items,
                  official_items::INTEGER AS official_items, fixed_bonus::DOUBLE AS fixed_bonus,
                  official_max::DOUBLE AS official_max, 'sheet "' || exam || '", final' AS evidence
           FROM adjustments""",
        "adjustments",
    ),
)
def a5(spark, sf_dir):
    path = shared_folder(spark, "adjustments")
    rows = a.adjustments(spark, sf_dir).withColumnRenamed("exam", "group").withColumns(
        {
            "evidence": F.concat(F.lit('sheet "'), F.col("group"), F.lit('", final')),
            "source": F.lit("archive"),
        }
    )
    ordered = rows.select(*schemas.FORM_ADJUSTMENTS.names)
    ordered.write.csv(path, header=True, quote='"', escape='"')
    return readers.read_form_adjustments(spark, path).select(
        "year", "exam", "evaluated_items", "official_items", "fixed_bonus", "official_max", "evidence"
    )


@register(
    "a6_option_mapping_csv",
    oracle(
        """SELECT item_id::VARCHAR AS item_id, kept_order_reason, new_answer, new_A_source, new_B_source, new_C_source,
                  new_D_source, new_E_source FROM order_mapping""",
        "order_mapping",
    ),
)
def a6(spark, sf_dir):
    path = shared_folder(spark, "mapping")
    mapping = a.order_mapping(spark, sf_dir).withColumnRenamed("item_id", "id")
    mapping.write.csv(path, header=True)
    return readers.read_option_mapping(spark, path).select(
        "item_id", "kept_order_reason", "new_answer", *[f"new_{x}_source" for x in "ABCDE"]
    )


@register(
    "a7_model_registry",
    oracle(
        """SELECT 's' || s_suppkey AS id, s_name AS label, s_suppkey % 3 = 0 AS supports_vision,
                  false AS supports_json_response_format,
                  round(CASE s_suppkey % 6 WHEN 0 THEN 1.0 / (s_suppkey + 1) WHEN 1 THEN 0.5
                       WHEN 2 THEN 1.0 / 4 WHEN 3 THEN 60.0 / (s_suppkey + 2) END, 6) AS min_request_interval
           FROM supplier"""
    ),
)
def a7(spark, sf_dir):
    """Registry documents with limits as numbers and as objects, one model per supplier."""
    key = F.col("s_suppkey")
    kind = F.pmod(key, F.lit(6))
    text = key.cast("string")
    limit = (
        F.when(kind == 0, (key + 1).cast("string"))
        .when(kind == 1, F.lit('{"min_interval_seconds":0.5,"requests_per_second":9}'))
        .when(kind == 2, F.lit('{"min_interval_seconds":-1,"requests_per_second":4}'))
        .when(kind == 3, F.concat(F.lit('{"requests_per_minute":'), (key + 2).cast("string"), F.lit("}")))
        .when(kind == 4, F.lit("0"))
        .otherwise(F.lit("null"))
    )
    entry = F.concat(
        F.lit('{"models":[{"id":"s'),
        text,
        F.lit('","label":"'),
        F.col("s_name"),
        F.lit('","supports_vision":'),
        (F.pmod(key, F.lit(3)) == 0).cast("string"),
        F.lit(',"rate_limit":'),
        limit,
        F.lit("}]}"),
    )
    path = shared_folder(spark, "registry")
    a.table(spark, sf_dir, "supplier").select(entry.alias("value")).write.text(path)
    frame = spark.read.schema(schemas.REGISTRY).json(path)
    return round_doubles(readers.registry_rows(frame))


@register(
    "a8_run_configs",
    oracle(
        """SELECT model AS model_id, count(*) AS rows_after_filter, model = 'm2' AS was_resumed
           FROM attempts GROUP BY model""",
        "attempts",
    ),
)
def a8(spark, sf_dir):
    folder = shared_folder(spark, "configs")
    counted = a.attempts(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    resumed = F.when(F.col("model") == "m2", F.struct(F.lit("paused").alias("reason")))
    config = F.struct(
        F.struct(F.col("model").alias("id")).alias("model"),
        F.struct(F.col("n").alias("rows_after_filter")).alias("multimodal_policy"),
        resumed.alias("resumed"),
    )
    # one document per run folder, as the runner leaves them
    documents = counted.select("model", F.to_json(config).alias("value"))
    documents.write.partitionBy("model").text(folder)
    return readers.read_run_configs(spark, f"{folder}/model=*").select(
        "model_id", "rows_after_filter", "was_resumed"
    )


@register(
    "a12_a13_run_sinks",
    oracle(
        """SELECT 'parquet' AS sink, count(*) AS rows, count(error) AS failures,
                  count(read) AS predictions FROM results
           UNION ALL SELECT 'results', count(*), count(error), count(read) FROM results
           UNION ALL SELECT 'failures', count(error), count(error), 0 FROM results
           UNION ALL SELECT 'raw', count(*), 0, 0 FROM events""",
        "results",
    ),
)
def a12_a13(spark, sf_dir):
    folder = shared_folder(spark, "run-logs")
    rows = records(spark, sf_dir).withColumnsRenamed({"item_id": "id", "exam": "group"})
    writers.write_results(rows, f"{folder}/results.parquet")
    written = spark.read.schema(schemas.RUN_RECORD).parquet(f"{folder}/results.parquet")
    raw = ar.raw_responses(spark, sf_dir)
    writers.write_run_logs(written, raw, folder)
    lines = spark.read.schema(schemas.RUN_RECORD).json(f"{folder}/results.jsonl")
    failures = spark.read.schema(schemas.RUN_RECORD).json(f"{folder}/failures.jsonl")
    counted = [
        frame.agg(
            F.count(F.lit(1)).cast("bigint").alias("rows"),
            F.count("error").cast("bigint").alias("failures"),
            F.count("predicted").cast("bigint").alias("predictions"),
        ).withColumn("sink", F.lit(name))
        for name, frame in [("parquet", written), ("results", lines), ("failures", failures)]
    ]
    replies = spark.read.schema(raw.schema).json(f"{folder}/raw_responses.jsonl").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(0).cast("bigint").alias("failures"),
        F.lit(0).cast("bigint").alias("predictions"),
        F.lit("raw").alias("sink"),
    )
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(replies)


@register(
    "a14_g41_metrics_tree",
    oracle(
        """SELECT '{"contest_totals":{' || string_agg('"' || model || '":{"forms":' || n || ',"items":' || q || '}',
                  ',' ORDER BY model) || '},"panel":{"exams":' || any_value(e) || ',"rows":' || any_value(r) || '}}' AS metrics
           FROM (SELECT model, count(*) AS n, sum(questions)::BIGINT AS q FROM scores
                 WHERE complete_exam GROUP BY model),
                (SELECT count(DISTINCT (year, exam)) AS e, count(*) AS r FROM panel)""",
        "panel",
    ),
)
def a14(spark, sf_dir):
    complete = a.scores(spark, sf_dir).filter("complete_exam")
    totals = complete.groupBy("model").agg(
        F.sum("questions").cast("bigint").alias("items"),
        F.count(F.lit(1)).cast("bigint").alias("forms"),
    )
    panel = a.panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("year", "exam").alias("exams")
    )
    tree = writers.metrics_tree({"panel": (panel, None), "contest_totals": (totals, "model")})
    path = shared_folder(spark, "metrics")
    writers.write_metrics(tree, path)
    return spark.read.text(path).withColumnRenamed("value", "metrics")


@register(
    "a15_csv_tables",
    oracle(
        """SELECT model, forms, contest_points FROM (
             SELECT model, count(*) AS forms, sum(total_score)::DOUBLE AS contest_points FROM scores
             WHERE complete_exam GROUP BY model)""",
        "scores",
    ),
)
def a15(spark, sf_dir):
    folder = shared_folder(spark, "tables")
    totals = scoring.contest_totals(a.scores(spark, sf_dir)).select("model", "forms", "contest_points")
    order = {"contest_totals": [ordinal(F.col("model"), MODEL_NAMES), "model"]}
    writers.write_tables({"contest_totals": totals}, folder, order)
    return spark.read.schema(totals.schema).csv(f"{folder}/contest_totals", header=True)


@register(
    "a16_same_schema_sink",
    oracle(
        """SELECT count(*) AS rows, count(sol_D) AS with_d,
                  'item_id,answer,problem_statement,sol_A,sol_B,sol_C,sol_D,sol_E,has_option_image' AS columns
           FROM item_texts""",
        "item_texts",
    ),
)
def a16(spark, sf_dir):
    source = a.item_texts(spark, sf_dir)
    path = shared_folder(spark, "shuffled")
    writers.write_like(options.shuffle_options(source), source, path)
    back = spark.read.parquet(path)
    return back.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        # a permutation moves the missing option, it does not lose or add one
        sum_of_present(back).alias("with_d"),
        F.lit(",".join(back.columns)).alias("columns"),
    )


def sum_of_present(frame):
    """Rows minus missing options over all five letters."""
    missing = sum(F.count_if(F.col(f"sol_{x}").isNull()) for x in "ABCDE")
    return (F.count(F.lit(1)) - missing).cast("bigint")


@register(
    "a17_usage_log",
    oracle(
        """SELECT type, count(*) AS events, sum(prompt_tokens)::BIGINT AS prompt_tokens
           FROM usage GROUP BY type""",
        "usage",
    ),
)
def a17(spark, sf_dir):
    """Stream of events appended to a JSON log, then read back."""
    base = shared_folder(spark, "usage-log")
    log = event_stream(spark, sf_dir).select(
        "type",
        F.col("event_id").cast("string").alias("row_id"),
        "latency_ms",
        "prompt_tokens",
        "completion_tokens",
        "cost_usd_known",
    )
    us.append_usage_log(log, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return (
        readers.read_usage_log(spark, f"{base}/log")
        .groupBy("type")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("events"),
            F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        )
    )


@register(
    "a4_cohort_json_files",
    oracle(
        """SELECT year(o_orderdate) AS year, count(*) AS students FROM orders GROUP BY ALL"""
    ),
)
def a4(spark, sf_dir):
    """Cohort documents written as files and scanned with their nested schema."""
    path = shared_folder(spark, "cohorts")
    # one document per file, as cohort summaries are published
    documents = cohort_documents(spark, sf_dir).select(F.col("json").alias("value"), F.get_json_object("json", "$.year").alias("of"))
    documents.write.partitionBy("of").text(path)
    cohorts = readers.read_cohorts(spark, f"{path}/*/part-*")
    total = F.aggregate(
        F.map_values("totals_by_grade"), F.lit(0).cast("bigint"), lambda acc, n: acc + n
    )
    return cohorts.select(F.col("year").cast("bigint").alias("year"), total.alias("students"))


LABELS = {"m1": "Model one", "m2": "Model two", "m3": "Model three"}


@register(
    "b20_label_lookup",
    oracle(
        """SELECT model, CASE model WHEN 'm1' THEN 'Model one' WHEN 'm2' THEN 'Model two'
                  WHEN 'm3' THEN 'Model three' END AS label, count(*) AS n
           FROM attempts GROUP BY model""",
        "attempts",
    ),
)
def b20(spark, sf_dir):
    counted = a.attempts(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )
    return counted.withColumn("label", lookup(F.col("model"), LABELS))


@register(
    "x1_callable_bootstrap",
    oracle(
        f"""SELECT series, {bounds('m', 'statistic')}, {samples('m')}
            FROM (SELECT series, rep, median(model_pct) AS m FROM panel JOIN draws USING (series, year),
                         range(0, weight::BIGINT) GROUP BY series, rep)
            GROUP BY series""",
        "panel",
        extra={"draws": draws_sql("panel", "year", 11, ["series"])},
    ),
)
def x1(spark, sf_dir):
    """Interval of a statistic given as a plain function: the median score per series."""
    panel = a.panel(spark, sf_dir).select("series", "year", "exam", "model_pct")
    return round_doubles(
        bootstrap.callable_interval(
            panel, lambda rows: rows["model_pct"].median(), ["series"], "year", 11
        )
    )


@register(
    "x2_named_forecasters",
    oracle(
        f"""SELECT forecaster, series, count(*) AS n, round(avg(abs(error)), 6) AS mae FROM (
             SELECT 'per_grade' AS forecaster, series, error FROM errors WHERE specification = 'Model score'
             UNION ALL SELECT 'recent_mean', series, observed - predicted FROM ({_RECENT})
             UNION ALL SELECT 'shared_slope', series, error FROM ({_shared_sql('panel', ['model_pct'])}))
            GROUP BY forecaster, series""",
        "panel",
        extra={**_E, **_ENSEMBLE},
    ),
)
def x2(spark, sf_dir):
    """Every named forecaster that works on plain predictors, on one panel."""
    panel = a.panel(spark, sf_dir)
    errors = [
        forecast.forecast(panel, name, ["model_pct"]).withColumn("forecaster", F.lit(name))
        for name in ("per_grade", "recent_mean", "shared_slope")
    ]
    return round_doubles(
        errors[0].unionByName(errors[1]).unionByName(errors[2])
        .groupBy("forecaster", "series")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(F.abs("error")).alias("mae"))
    )


@register(
    "a1_a9_b12_item_scan",
    oracle(
        """SELECT exam, count(*) AS items, sum(points) AS points, count_if(has_associated_image) AS associated,
                  count_if(has_option_image) AS option_images, count(DISTINCT answer) AS answers
           FROM items GROUP BY exam""",
        "items",
    ),
)
def a1(spark, sf_dir):
    """An item dataset written with images, validated, scanned for some columns, and flagged."""
    path = shared_folder(spark, "items")
    rows = a.items(spark, sf_dir)
    image = F.lit(b"image")
    stored = rows.select(
        F.col("item_id").alias("id"),
        "year",
        F.col("exam").alias("group"),
        "points",
        "answer",
        "multimodal",
        F.when(F.col("has_associated_image"), F.array(image)).alias("associated_images_bin"),
        *[F.when(F.col("has_option_image") & F.lit(x == "C"), image).alias(f"sol_{x}_image_bin") for x in "ABCDE"],
    )
    writers.conform(stored, schemas.ITEMS).write.parquet(path)
    options_bin = [f"sol_{x}_image_bin" for x in "ABCDE"]
    columns = ["id", "year", "group", "points", "answer", "multimodal", "associated_images_bin", *options_bin]
    scanned = describe.image_flags(readers.read_items(spark, path, columns), options_bin)
    # both sides are item tables, and repeated images pack too well for a file's size to tell its rows
    flags = scanned.select(F.col("id").alias("item_id"), "has_associated_image", "has_option_image")
    key = readers.answer_key(scanned).join(flags.hint("merge"), "item_id")
    return key.groupBy("exam").agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        F.sum("points").alias("points"),
        F.count_if("has_associated_image").cast("bigint").alias("associated"),
        F.count_if("has_option_image").cast("bigint").alias("option_images"),
        F.count_distinct("answer").cast("bigint").alias("answers"),
    )


def _report_inputs(spark, sf_dir):
    return reports.Inputs(
        items=a.items(spark, sf_dir),
        attempts=a.attempts(spark, sf_dir),
        adjustments=a.adjustments(spark, sf_dir),
        human=a.human(spark, sf_dir),
        reference_model=a.REFERENCE_MODEL,
        grades=a.GRADES,
    )


def _tree_rows(spark, sections):
    """A metrics tree written, read back and unfolded to rows of section, entry, field, value."""
    path = shared_folder(spark, "metrics")
    writers.write_metrics(writers.metrics_tree(sections), path)
    tree = spark.read.text(path).select(
        F.from_json("value", "map<string,map<string,map<string,double>>>").alias("m")
    )
    return (
        tree.select(F.explode("m").alias("section", "entries"))
        .select("section", F.explode("entries").alias("entry", "fields"))
        .select("section", "entry", F.explode("fields").alias("field", "value"))
        .select("section", "entry", "field", F.round("value", 6).alias("value"))
    )


@register(
    "g41_diagnostics_metrics",
    oracle(
        """SELECT section, entry, field, round(value, 6) AS value FROM (
             SELECT 'contest_totals' AS section, model AS entry,
                    unnest(['forms', 'possible_points', 'contest_points']) AS field,
                    unnest([count(*)::DOUBLE, sum(possible_points)::DOUBLE, sum(total_score)::DOUBLE]) AS value
             FROM scores WHERE complete_exam GROUP BY model
             UNION ALL
             SELECT 'image_subtype', model || ' / ' || s, unnest(['items', 'accuracy', 'decline_rate']),
                    unnest([count(*)::DOUBLE, avg(answered_correctly::INT)::DOUBLE, avg(declined::INT)::DOUBLE])
             FROM (SELECT *, CASE WHEN has_associated_image AND has_option_image THEN 'Question diagram and image answers'
                          WHEN has_associated_image THEN 'Question diagram only'
                          WHEN has_option_image THEN 'Image answers only' ELSE 'Text-only' END AS s FROM scored)
             GROUP BY model, s)""",
        "scores",
    ),
)
def g41_diagnostics(spark, sf_dir):
    """Metrics of the first report: contest totals and image subtypes of every model."""
    inputs = _report_inputs(spark, sf_dir)
    return _tree_rows(spark, reports.metrics_sections(reports.diagnostics_metrics(inputs, reports.prepare(inputs))))


@register(
    "g41_surrogate_metrics",
    oracle(
        """SELECT section, entry, field, round(value, 6) AS value FROM (
             SELECT 'forecast_errors' AS section, series || ' / ' || specification AS entry,
                    unnest(['predictions', 'mae']) AS field,
                    unnest([count(*)::DOUBLE, avg(abs(error))::DOUBLE]) AS value
             FROM errors GROUP BY series, specification)""",
        "panel",
        extra={**_E, **_ENSEMBLE},
    ),
)
def g41_surrogate(spark, sf_dir):
    """Metrics of the second report: forecast errors of every series and specification."""
    return _tree_rows(spark, reports.metrics_sections(reports.surrogate_metrics(a.panel(spark, sf_dir))))


@register(
    "g41_robustness_metrics",
    oracle(
        """SELECT section, entry, field, round(value, 6) AS value FROM (
             SELECT 'rerun_agreement' AS section, model AS entry, unnest(['items', 'same_outcome']) AS field,
                    unnest([count(*)::DOUBLE, avg((a.answered_correctly = b.answered_correctly)::INT)::DOUBLE]) AS value
             FROM scored a JOIN scored_repeat b USING (model, item_id) GROUP BY model)""",
        "scored",
        "scored_repeat",
    ),
)
def g41_robustness(spark, sf_dir):
    """Metrics of the third report: agreement of every model with its repeat."""
    inputs = _report_inputs(spark, sf_dir)
    repeat = score_attempts(a.repeat_attempts(spark, sf_dir), inputs.items)
    return _tree_rows(spark, reports.metrics_sections(reports.robustness_metrics(a.scored(spark, sf_dir), repeat)))
