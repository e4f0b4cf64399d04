"""Registered queries: answer extraction, usage, run report, selection, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions import answers, messages, scoring
from examlens.operators import responses, run_report, selection
from examlens.operators.selection import Selection
from examlens.plans import adapters as a
from examlens.plans import adapters_runs as ar
from examlens.plans import oracle_runs  # noqa: F401  (adds its tables)
from examlens.plans.oracle_tables import oracle
from examlens.plans.registry import register, round_doubles

# --- answer extraction --------------------------------------------------------------------------

_WORD = r"[^\p{L}\p{N}_]"
_SEARCH = (
    rf"(?i)(?:^|{_WORD})(?:" + "|".join(answers.DECLINE_PATTERNS) + rf")(?:{_WORD}|$)"
)
_ALIASES = ", ".join(f"'{phrase}'" for phrase in answers.DECLINE_SET)


def _phrase(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9äöüß]+', ' ', 'g'))"


def _mentions(text: str) -> str:
    return f"({_phrase(text)} IN ({_ALIASES}) OR regexp_matches({text}, '{_SEARCH}'))"


def _letter(text: str) -> str:
    return f"upper(nullif(regexp_extract({text}, '(^|{_WORD})([A-Ea-e])({_WORD}|$)', 2), ''))"


def _token(raw: str) -> str:
    unquoted = f"""regexp_replace(trim({raw}, e' \\t\\n\\r'), '^[`"''“”‘’]+|[`"''“”‘’]+$', '', 'g')"""
    return f"trim(regexp_replace({unquoted}, '[\\s.!?؛。,…]+$', ''), e' \\t\\n\\r')"


def _read(raw: str) -> str:
    token = _token(raw)
    return f"""CASE WHEN upper({token}) IN ('A','B','C','D','E') THEN upper({token})
        WHEN {_phrase(token)} IN ({_ALIASES}) THEN 'DECLINED' END"""


def _json(text: str, name: str) -> str:
    return f"""CASE WHEN json_valid({text}) AND json_type({text}) = 'OBJECT'
        AND json_type({text}, '$.{name}') = 'VARCHAR'
        THEN json_extract_string({text}, '$.{name}') END"""


_FINAL = r"(?im)^\s*(?:final\s*answer|antwort)\s*[:：\-–—]?\s*([^\n]+?)\s*$"
_EXTRACTED = f"""SELECT *, CASE
        WHEN blank THEN NULL WHEN f IS NOT NULL THEN f WHEN j IS NOT NULL THEN j
        WHEN b IS NOT NULL THEN b WHEN mentioned THEN 'DECLINED' ELSE lone END AS predicted,
    CASE WHEN blank OR f IS NOT NULL THEN NULL WHEN j IS NOT NULL THEN jr
         WHEN b IS NOT NULL THEN br END AS rationale,
    CASE WHEN blank THEN 'empty_response'
         WHEN f IS NOT NULL THEN CASE WHEN f = 'DECLINED' THEN 'declined_explicit' END
         WHEN j IS NOT NULL THEN CASE WHEN j = 'DECLINED' THEN 'declined_explicit' END
         WHEN b IS NOT NULL THEN CASE WHEN b = 'DECLINED' THEN 'declined_explicit' ELSE 'json_extracted' END
         WHEN mentioned THEN 'declined_phrase' WHEN lone IS NOT NULL THEN 'regex_fallback'
         ELSE 'no_parse' END AS warning
    FROM (SELECT *, {_read('line')} AS f, {_read('ja')} AS j, {_read('ba')} AS b
          FROM (SELECT *, {_json('block', 'answer')} AS ba, {_json('block', 'reason')} AS br
                FROM (SELECT *, NOT regexp_matches(text, '\\S') AS blank,
                             regexp_extract_all(text, '{_FINAL}', 1)[-1] AS line,
                             {_json('text', 'answer')} AS ja, {_json('text', 'reason')} AS jr,
                             nullif(regexp_extract(text, '(?s)(\\{{.*?\\}})', 1), '') AS block,
                             {_mentions('text')} AS mentioned, {_letter('text')} AS lone
                      FROM texts)))"""


@register(
    "i1_answer_extraction",
    oracle(
        f"SELECT conv_id, turn, predicted, rationale, warning FROM ({_EXTRACTED})",
        "responses",
        # of repeated keys the last counts, and NaN does no harm: as if the object were this one
        extra={
            "texts": """SELECT r.conv_id, r.turn, CASE WHEN r.conv_id % 8 = 7
                               THEN to_json({'answer': 'E', 'reason': c.text})::VARCHAR ELSE r.text END AS text
                        FROM responses r JOIN conversations c USING (conv_id, turn)"""
        },
    ),
)
def i1(spark, sf_dir):
    return ar.response_texts(spark, sf_dir).select(
        "conv_id", "turn", answers.extract_answer("text").alias("_a")
    ).select("conv_id", "turn", "_a.*")


@register(
    "i1_answer_extraction_documents",
    oracle(
        f"SELECT doc_id, predicted, rationale, warning FROM ({_EXTRACTED})",
        extra={"texts": "SELECT doc_id, text FROM documents"},
    ),
)
def i1_documents(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select(
        "doc_id", answers.extract_answer("text").alias("_a")
    ).select("doc_id", "_a.*")


@register(
    "i2_i7_text_functions",
    oracle(
        f"""SELECT conv_id, turn, {_token('line')} AS token, {_phrase('line')} AS phrase,
                   {_mentions('text')} AS declines, {_letter('text')} AS lone_letter
            FROM (SELECT *, regexp_extract_all(text, '{_FINAL}', 1)[-1] AS line FROM responses)""",
        "responses",
    ),
)
def i2_i7(spark, sf_dir):
    line = answers.last_final_line("text")
    return ar.response_texts(spark, sf_dir).select(
        "conv_id",
        "turn",
        answers.clean_token(line).alias("token"),
        answers.normalize_phrase(line).alias("phrase"),
        answers.mentions_decline("text").alias("declines"),
        answers.first_lone_letter("text").alias("lone_letter"),
    )


# --- scalar scoring ------------------------------------------------------------------------------

_POINT_TEXT = """CASE p_partkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN ' 3.5 ' WHEN 2 THEN 'x'
    WHEN 3 THEN '-2' WHEN 4 THEN NULL ELSE p_size::VARCHAR END"""
_GROUP_TEXT = """CASE p_partkey % 5 WHEN 0 THEN 'Klasse 3 und 4' WHEN 1 THEN '11-13'
    WHEN 2 THEN 'all' WHEN 3 THEN 'grade ' || (p_size % 20) ELSE NULL END"""


@register(
    "b7_b11_scoring_functions",
    oracle(
        f"""SELECT p_partkey, points, numbers, start_points, declined,
                   CASE WHEN key IS NULL OR points <= 0 THEN 0.0
                        WHEN predicted IS NULL THEN -0.25 * points
                        WHEN declined THEN 0.0 WHEN upper(trim(predicted)) = key THEN points
                        ELSE -0.25 * points END::DOUBLE AS points_earned,
                   CASE WHEN key IS NULL OR points <= 0 THEN NULL
                        ELSE coalesce(NOT declined AND upper(trim(predicted)) = key, false) END AS is_correct
            FROM (SELECT p_partkey, numbers, predicted, key,
                         CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END::DOUBLE AS points,
                         CASE WHEN s BETWEEN 7 AND 13 THEN 30.0 WHEN s BETWEEN 3 AND 6 THEN 24.0
                              ELSE 0.0 END::DOUBLE AS start_points,
                         coalesce(upper(trim(predicted)) = 'DECLINED', false) AS declined
                  FROM (SELECT p_partkey, TRY_CAST(trim({_POINT_TEXT}) AS DOUBLE) AS v,
                               list_transform(coalesce(regexp_extract_all({_GROUP_TEXT}, '\\d+'), []),
                                              lambda x: x::INTEGER) AS nums,
                               array_to_string(list_transform(coalesce(regexp_extract_all({_GROUP_TEXT}, '\\d+'), []),
                                              lambda x: x::INTEGER), ',') AS numbers,
                               list_min(nums) AS s,
                               CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN ' declined '
                                    ELSE lower(substr(p_brand, 7, 1)) END AS predicted,
                               CASE WHEN upper(trim(substr('abcdeX ', (p_partkey % 7)::INT + 1, 1)))
                                         IN ('A','B','C','D','E')
                                    THEN upper(substr('abcdeX ', (p_partkey % 7)::INT + 1, 1)) END AS key
                        FROM part))"""
    ),
)
def b7_b11(spark, sf_dir):
    part, key = a.table(spark, sf_dir, "part"), F.col("p_partkey")
    sixth, fifth, size = F.pmod(key, F.lit(6)), F.pmod(key, F.lit(5)), F.col("p_size")
    none = F.lit(None).cast("string")
    raw = part.select(
        "p_partkey",
        F.when(sixth == 0, "nan")
        .when(sixth == 1, " 3.5 ")
        .when(sixth == 2, "x")
        .when(sixth == 3, "-2")
        .when(sixth == 4, none)
        .otherwise(size.cast("string"))
        .alias("points_text"),
        F.when(fifth == 0, "Klasse 3 und 4")
        .when(fifth == 1, "11-13")
        .when(fifth == 2, "all")
        .when(fifth == 3, F.concat(F.lit("grade "), (size % 20).cast("string")))
        .otherwise(none)
        .alias("group_text"),
        F.when(size % 4 == 0, none)
        .when(size % 4 == 1, " declined ")
        .otherwise(F.lower(F.substring("p_brand", 7, 1)))
        .alias("predicted"),
        F.lit("abcdeX ").substr((F.pmod(key, F.lit(7)) + 1).cast("int"), F.lit(1)).alias("key_text"),
    )
    scored = scoring.score_question("points_text", scoring.valid_key("key_text"), "predicted")
    numbers = scoring.grade_numbers("group_text")
    return raw.select(
        "p_partkey",
        scoring.coerce_points("points_text").alias("points"),
        F.array_join(numbers.cast("array<string>"), ",").alias("numbers"),
        scoring.legacy_start_points("group_text").alias("start_points"),
        scoring.is_declined("predicted").alias("declined"),
        scored["points_earned"].alias("points_earned"),
        scored["is_correct"].alias("is_correct"),
    )


# --- provider responses ----------------------------------------------------------------------------

_PARSED_SQL = """SELECT item_id, attempt, max_tokens,
    CASE kind WHEN 7 THEN NULL WHEN 6 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE kind WHEN 0 THEN 'Final answer: A' WHEN 1 THEN '{"answer":"d","reason":"sum"}'
         WHEN 2 THEN 'Antwort: e' || chr(10) || 'ok' WHEN 3 THEN '{"answer":"b"}'
         WHEN 4 THEN 'keine Ahnung' WHEN 5 THEN '?' WHEN 6 THEN ''
         ELSE 'plain text, Final answer: B' END AS content_text,
    CASE kind WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B'
         WHEN 4 THEN 'DECLINED' WHEN 7 THEN 'B' END AS predicted,
    CASE kind WHEN 1 THEN 'sum' END AS rationale,
    CASE kind WHEN 4 THEN 'declined_phrase' WHEN 5 THEN 'no_parse' WHEN 6 THEN 'empty_response'
         WHEN 7 THEN 'regex_fallback' END AS warning FROM raw_events"""


@register(
    "a18_i8_parsed_responses",
    oracle(
        f"""SELECT item_id, attempt, finish_reason, content_text, predicted, rationale, warning
            FROM ({_PARSED_SQL})""",
        "raw_events",
    ),
)
def a18(spark, sf_dir):
    return responses.parse_responses(ar.raw_responses(spark, sf_dir)).drop(
        "response", "usage_header", "max_tokens", "native_finish_reason"
    )


@register(
    "i12_requery_plan",
    oracle(
        f"""SELECT item_id, attempt,
                   CASE WHEN finish_reason = 'length' THEN grown ELSE max_tokens END::BIGINT
                       AS next_max_tokens,
                   CASE WHEN finish_reason = 'length' THEN 'max_tokens_retry_'
                        || coalesce(max_tokens::VARCHAR, 'auto') || '->' || grown::VARCHAR
                        ELSE 'retry_due_to_' || warning END AS reason
            FROM (SELECT *, CASE WHEN max_tokens IS NULL THEN 256
                                 ELSE least(2 * max_tokens, 4096) END AS grown
                  FROM ({_PARSED_SQL}) WHERE predicted IS NULL)""",
        "raw_events",
    ),
)
def i12(spark, sf_dir):
    return responses.requery_plan(responses.parse_responses(ar.raw_responses(spark, sf_dir)))


@register(
    "i9_i10_usage",
    oracle(
        """SELECT item_id, prompt_tokens, completion_tokens, total_tokens, cached_prompt_tokens,
                  audio_prompt_tokens, reasoning_tokens,
                  coalesce(explicit, completion_tokens)::BIGINT AS explicit_reasoning_tokens,
                  round(cost, 6) AS cost_usd
           FROM (SELECT item_id,
                        CASE WHEN kind IN (0, 1, 2, 3, 6) THEN sum(pt)
                             WHEN kind = 5 THEN max_by(pt, attempt) END::BIGINT AS prompt_tokens,
                        CASE WHEN kind IN (0, 1, 2, 6) THEN sum(ct)
                             WHEN kind = 5 THEN max_by(ct, attempt) END::BIGINT AS completion_tokens,
                        CASE WHEN kind IN (1, 3, 4) THEN sum(pt + ct) END::BIGINT AS total_tokens,
                        CASE WHEN kind IN (0, 2) THEN sum(rt) END::BIGINT AS cached_prompt_tokens,
                        CASE WHEN kind = 3 THEN 3 * count(*) END::BIGINT AS audio_prompt_tokens,
                        CASE WHEN kind IN (0, 3) THEN sum(rt) END::BIGINT AS reasoning_tokens,
                        CASE WHEN kind = 0 THEN sum(rt + 2) WHEN kind = 3 THEN sum(rt) END AS explicit,
                        CASE WHEN kind = 0 THEN sum(nullif(cost, 0)) WHEN kind = 1 THEN sum(cost)
                             WHEN kind = 2 THEN sum(nullif(cost, 0)) WHEN kind = 4 THEN sum(cost) END AS cost
                 FROM raw_events GROUP BY item_id, kind)""",
        "raw_events",
    ),
)
def i9(spark, sf_dir):
    return round_doubles(responses.normalize_usage(ar.raw_responses(spark, sf_dir)))


# --- run records and report ---------------------------------------------------------------------------


def records(spark, sf_dir):
    return responses.run_records(ar.results(spark, sf_dir))


@register(
    "i11_run_records",
    oracle(
        """SELECT model, item_id, answer, read AS predicted, is_correct,
                  points_earned::DOUBLE AS points_earned, error FROM results""",
        "results",
    ),
)
def i11(spark, sf_dir):
    return records(spark, sf_dir).select(
        "model", "item_id", "answer", "predicted", "is_correct", "points_earned", "error"
    )


_TOKEN_NAMES = [
    "total_tokens",
    "prompt_tokens",
    "completion_tokens",
    "reasoning_tokens",
    "explicit_reasoning_tokens",
]
_TOKEN_SQL = ", ".join(
    f"round(avg({n}) FILTER (WHERE answered), 6) AS mean_{n}, "
    f"sum({n}) FILTER (WHERE answered)::BIGINT AS sum_{n}, "
    f"count({n}) FILTER (WHERE answered) AS {n}_known"
    for n in _TOKEN_NAMES
)


@register(
    "g30_run_report",
    oracle(
        f"""SELECT model, count(*) AS rows, count_if(answered) AS answered_count,
                   count_if(error IS NULL AND upper(read) = 'DECLINED') AS declined_count,
                   count(error) AS failed_count,
                   round(count_if(is_correct AND answered) / count_if(answered), 6) AS accuracy,
                   round(sum(points_earned) + count_if(points > 0), 6) AS total_points_earned,
                   round((sum(points_earned) + count_if(points > 0))
                         / (sum(points) + count_if(points > 0)), 6) AS points_weighted_accuracy,
                   round(avg(latency_ms) FILTER (WHERE answered), 6) AS mean_latency_ms,
                   round(median(latency_ms) FILTER (WHERE answered), 6) AS median_latency_ms,
                   {_TOKEN_SQL},
                   round(sum(cost_usd) FILTER (WHERE answered), 6) AS total_cost_usd,
                   count_if(answered AND total_tokens IS NULL) AS unknown_usage_count
            FROM (SELECT *, read IS NOT NULL AND error IS NULL AS answered FROM results)
            GROUP BY model""",
        "results",
    ),
)
def g30(spark, sf_dir):
    return round_doubles(run_report.run_report(records(spark, sf_dir), ["model"]))


@register(
    "g31_breakdown",
    oracle(
        """SELECT model, exam, count(*) AS count, round(avg(is_correct::INT), 6) AS accuracy,
                  round(sum(points_earned) / sum(points), 6) AS points_weighted_accuracy
           FROM results WHERE read IS NOT NULL AND error IS NULL GROUP BY model, exam""",
        "results",
    ),
)
def g31(spark, sf_dir):
    return round_doubles(run_report.breakdown(records(spark, sf_dir), ["model", "exam"]))


@register(
    "g32_warning_counts",
    oracle(
        """SELECT model, warning, count(*) AS n
           FROM (SELECT model, unnest(warnings) AS warning FROM results) GROUP BY ALL""",
        "results",
    ),
)
def g32(spark, sf_dir):
    return run_report.warning_counts(records(spark, sf_dir), ["model"])


@register(
    "g32_rows_with_warnings",
    oracle(
        """SELECT model, count_if(len(warnings) > 0) AS rows_with_warnings
           FROM results GROUP BY model""",
        "results",
    ),
)
def g32_rows(spark, sf_dir):
    return run_report.rows_with_warnings(records(spark, sf_dir), ["model"])


@register(
    "s3_top_warnings",
    oracle(
        """SELECT warning, count(*) AS n FROM (SELECT unnest(warnings) AS warning FROM results)
           GROUP BY warning ORDER BY n DESC, warning LIMIT 2""",
        "results",
    ),
)
def s3(spark, sf_dir):
    return run_report.top_warnings(records(spark, sf_dir), 2)


@register(
    "u2_latest_answers",
    oracle(
        """SELECT model, item_id, predicted, error, finished_at FROM (
             SELECT *, row_number() OVER (PARTITION BY model, item_id
                                          ORDER BY (error IS NULL)::INT DESC, finished_at DESC) AS rn
             FROM run_parts) WHERE rn = 1""",
        "run_parts",
    ),
)
def u2(spark, sf_dir):
    return responses.latest_answers(ar.run_parts(spark, sf_dir))


@register(
    "c7_missing_items",
    oracle(
        """SELECT m.model, i.item_id FROM items i, (SELECT DISTINCT model FROM run_parts) m
           WHERE NOT EXISTS (SELECT 1 FROM run_parts p WHERE p.model = m.model AND p.item_id = i.item_id
                             AND p.finished_at = 1 AND p.error IS NULL AND p.predicted IS NOT NULL)""",
        "run_parts",
        "items",
    ),
)
def c7(spark, sf_dir):
    """What the first parts of all runs lack."""
    parts = ar.run_parts(spark, sf_dir)
    return responses.missing_items(a.items(spark, sf_dir), parts.filter("finished_at = 1"), parts.select("model"))


# --- selection and prompts ---------------------------------------------------------------------------


def _selectable(spark, sf_dir):
    language = F.when(F.pmod(F.col("item_id"), F.lit(4)) == 0, "en").otherwise("de")
    return a.items(spark, sf_dir).withColumn("language", language)


_CHOSEN = Selection(
    exams=["1-URGENT", "5-LOW"], languages=["de"], year_range="4-20", points_range="3-4"
)
_CHOSEN_SQL = """exam IN ('1-URGENT', '5-LOW') AND item_id % 4 <> 0
    AND year BETWEEN 4 AND 20 AND points BETWEEN 3 AND 4"""


@register(
    "b1_b3_selected_items",
    oracle(f"SELECT item_id FROM items WHERE {_CHOSEN_SQL} AND NOT multimodal", "items"),
)
def b1(spark, sf_dir):
    chosen = Selection(**{**vars(_CHOSEN), "model_sees_images": False})
    return selection.select_items(_selectable(spark, sf_dir), chosen).select("item_id")


@register(
    "b3_selection_counts",
    oracle(
        f"""SELECT count(*) AS total_rows_loaded, 0 AS cli_filtered_out_rows,
                   count_if(multimodal) AS model_filtered_out_rows,
                   count_if(NOT multimodal) AS rows_after_filter FROM items WHERE {_CHOSEN_SQL}""",
        "items",
    ),
)
def b3(spark, sf_dir):
    chosen = Selection(**{**vars(_CHOSEN), "model_sees_images": False})
    return selection.selection_counts(_selectable(spark, sf_dir), chosen)


@register(
    "b5_sampled_items",
    oracle(
        """SELECT item_id FROM items ORDER BY md5(concat_ws(':', '7', item_id)), item_id LIMIT 500""",
        "items",
    ),
)
def b5(spark, sf_dir):
    chosen = Selection(limit=500, seed=7, limit_first=True)
    return selection.select_items(_selectable(spark, sf_dir), chosen).select("item_id")


@register(
    "b4_image_gate",
    oracle(
        """SELECT item_id, CASE WHEN has_associated_image OR has_option_image THEN 'skipped'
                  ELSE 'evaluated' END AS status FROM items""",
        "items",
    ),
)
def b4(spark, sf_dir):
    gated = selection.image_gate(
        a.items(spark, sf_dir), False, ["has_associated_image", "has_option_image"]
    )
    return gated.select("item_id", "status")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _say_sql(pair: tuple[str, str]) -> str:
    return f"CASE WHEN de THEN {_sql_text(pair[0])} ELSE {_sql_text(pair[1])} END"


_PROMPT_SQL = " || chr(10) || ".join(
    [
        f"{_say_sql((messages.SYSTEM_DE, messages.SYSTEM_EN))}",
        f"{_say_sql(messages.QUESTION)} || ' ' || problem_statement",
        f"""CASE WHEN has_option_image THEN {_say_sql(messages.EXTRA_IMAGE)} || ' 1:' || chr(10)
            || 'data:image/png;base64,' || to_base64(encode(sol_A)) || chr(10) ELSE '' END
            || {_say_sql(messages.CHOICES)}""",
        *[f"'{x}) ' || coalesce(sol_{x}, '')" for x in "ABCDE"],
        _say_sql((messages.REMINDER_DE, messages.REMINDER_EN)),
    ]
)


@register(
    "i13_prompts",
    oracle(
        f"""SELECT item_id, {_PROMPT_SQL} AS prompt,
                   CASE WHEN has_option_image THEN 10 ELSE 8 END::BIGINT AS parts
            FROM (SELECT *, item_id % 4 <> 0 AS de FROM item_texts)""",
        "item_texts",
    ),
)
def i13(spark, sf_dir):
    language = F.when(F.pmod(F.col("item_id"), F.lit(4)) == 0, "en").otherwise("de")
    texts = a.item_texts(spark, sf_dir).withColumn("language", language)
    image = messages.image_url(F.encode("sol_A", "utf-8"))
    extras = F.when(F.col("has_option_image"), F.array(image))
    built = texts.withColumn(
        "_m", messages.chat_messages(F.lit(None).cast("string"), extras, {})
    )
    lines = F.transform(F.col("_m.content"), lambda part: F.coalesce(part["text"], part["url"]))
    return built.select(
        "item_id",
        F.array_join(F.concat(F.array("_m.system"), lines), "\n").alias("prompt"),
        F.size("_m.content").cast("bigint").alias("parts"),
    )


@register(
    "a11_coerced_bytes",
    oracle(
        """SELECT p_partkey, CASE WHEN length(raw) > 16 THEN decode(from_base64(raw)) END AS text,
                  CASE WHEN length(raw) > 16 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 END AS kept
           FROM (SELECT p_partkey, to_base64(encode(CASE WHEN p_partkey % 3 = 0
                        THEN substr(p_name, 1, 5) ELSE p_name || p_brand END)) AS raw FROM part)"""
    ),
)
def a11(spark, sf_dir):
    key = F.col("p_partkey")
    source = F.when(F.pmod(key, F.lit(3)) == 0, F.substring("p_name", 1, 5)).otherwise(
        F.concat("p_name", "p_brand")
    )
    raw = F.base64(F.encode(source, "utf-8"))
    other = F.when(F.pmod(key, F.lit(2)) == 0, F.lit("QUFBQUFBQUFBQUFBQUFBQQ==")).otherwise(raw)
    rows = a.table(spark, sf_dir, "part").select(
        "p_partkey", raw.alias("raw"), F.array(raw, other, F.lit(None).cast("string")).alias("list")
    )
    kept = messages.coerce_byte_list("list", "text")
    return rows.select(
        "p_partkey",
        F.decode(messages.coerce_bytes("raw", "text"), "utf-8").alias("text"),
        F.when(kept.isNotNull(), F.size(kept)).alias("kept"),
    )


@register("i8_nested_content", oracle("SELECT conv_id, turn, text FROM conversations"))
def i8_nested(spark, sf_dir):
    """Every turn's text put one to fifty content lists deep and read back."""
    turns = a.table(spark, sf_dir, "conversations")
    inner = F.to_json(F.struct(F.col("text").alias("text")))
    levels = F.pmod(F.col("conv_id"), F.lit(50)).cast("int")
    document = F.concat(
        F.repeat(F.lit('[{"content":'), levels), F.lit("["), inner, F.lit("]"), F.repeat(F.lit("}]"), levels)
    )
    return turns.select("conv_id", "turn", messages.flatten_content(F.parse_json(document)).alias("text"))
