"""Response texts, raw provider responses and run results, derived from the test tables.

The rules are written once as templates and literals from which both the Spark columns and
the SQL twins (``*_SQL``) are built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.functions.common import hash32
from examlens.plans.adapters import attempts, items, repeat_attempts, table
from examlens.plans.oracle_tables import TABLES, h

# --- assistant turns with an answer tail ------------------------------------------------------

TAILS = {
    0: "\nFinal answer: B",
    1: "\nAntwort – c.",
    2: "\nFinal answer: Declined",
    4: '\n{"answer":"e"}',
    5: "\nIch entscheide mich, nicht zu antworten.",
    6: "",
}
# kinds whose whole text is one JSON object around the turn's text: plain (3), and with a repeated
# key and a number that is none (7)
AROUND = {3: ('{"answer":"D",', "}"), 7: ('{"answer":"A",', ',"answer":"E","v":NaN}')}


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod(F.col("conv_id"), F.lit(8))
    text = F.lit(None).cast("string")
    for number, tail in TAILS.items():
        text = F.when(kind == number, F.concat("text", F.lit(tail))).otherwise(text)
    reason = F.to_json(F.struct(F.col("text").alias("reason")))
    inner = F.substr(reason, F.lit(2), F.length(reason) - 2)
    for number, (before, after) in AROUND.items():
        text = F.when(kind == number, F.concat(F.lit(before), inner, F.lit(after))).otherwise(text)
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "assistant")
        .select("conv_id", "turn", text.alias("text"))
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TABLES["responses"] = (
    [],
    "SELECT conv_id, turn, CASE conv_id % 8 "
    + " ".join(f"WHEN {k} THEN text || {_quoted(v)}" for k, v in TAILS.items())
    + " "
    + " ".join(
        f"WHEN {k} THEN {_quoted(x)} || substr(j, 2, length(j) - 2) || {_quoted(y)}" for k, (x, y) in AROUND.items()
    )
    + " END AS text FROM (SELECT *, to_json({'reason': text})::VARCHAR AS j FROM conversations WHERE role = 'assistant')",
)

# --- raw provider responses -------------------------------------------------------------------

# kind -> (response, usage header); <pt> prompt, <ct> completion, <tt> total, <rt> reasoning
# tokens and <c3> thousandths of a dollar are filled in per event
RESPONSES = {
    0: (
        '{"choices":[{"finish_reason":"stop","message":{"content":"Final answer: A"}}],'
        '"usage":{"input_tokens":<pt>,"output_tokens":<ct>,'
        '"input_tokens_details":{"cached_tokens":<rt>},'
        '"output_tokens_details":{"reasoning_tokens":<rt>,"explicit_reasoning_tokens":2},'
        '"cost":0.<c3>}}',
        None,
    ),
    1: (
        '{"choices":["x",{"finish_reason":"stop","message":{"content":'
        '{"text":"{\\"answer\\":\\"d\\",\\"reason\\":\\"sum\\"}"}}}],'
        '"usage":{"prompt_tokens":<pt>,"completion_tokens":<ct>,"total_tokens":<tt>,'
        '"cost":"0.<c3>"}}',
        None,
    ),
    2: (
        '{"choices":[{"finish_reason":"stop","message":{"content":'
        '["Antwort: e",{"type":"text","text":"ok"}]}}]}',
        "prompt_tokens=<pt>; completion_tokens=<ct>, "
        "prompt_tokens_details.cached_tokens=<rt>;cost=0.<c3>;bad",
    ),
    3: (
        '{"choices":[{"finish_reason":"stop","message":{"content":[{"json":{"answer":"b"}}]}}]}',
        '{"input_tokens":<pt>,"total_tokens":<tt>,'
        '"output_tokens_details":{"reasoning_tokens":<rt>},'
        '"prompt_tokens_details.audio_tokens":"3"}',
    ),
    4: (
        '{"choices":[{"finish_reason":"stop","message":{"content":"keine Ahnung"}}],'
        '"usage":{"total_tokens":<tt>,"cost":0,"total_cost":0.<c3>}}',
        None,
    ),
    5: (
        '{"choices":[{"finish_reason":"stop","message":{"content":"?"}}],'
        '"usage":{"prompt_tokens":"<pt>","output_tokens":"<ct>"}}',
        None,
    ),
    6: (
        '{"choices":[{"finish_reason":"length","message":{"content":""}}],'
        '"usage":{"prompt_tokens":<pt>,"completion_tokens":<ct>}}',
        None,
    ),
    7: ("plain text, Final answer: B", None),
}


def _filled(template: str | None, values: dict[str, Column]) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    parts = re.split(r"<(\w+)>", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts per item, one per event."""
    event = F.col("event_id")
    item = F.floor(event / 2).cast("bigint")
    pt, ct = F.pmod(event, F.lit(700)), F.floor("value").cast("bigint")
    values = {
        "pt": pt.cast("string"),
        "ct": ct.cast("string"),
        "tt": (pt + ct).cast("string"),
        "rt": F.pmod(event, F.lit(50)).cast("string"),
        "c3": F.lpad(F.pmod(event, F.lit(1000)).cast("string"), 3, "0"),
    }
    kind = F.pmod(item, F.lit(len(RESPONSES)))
    response, header = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (body, head) in RESPONSES.items():
        response = F.when(kind == number, _filled(body, values)).otherwise(response)
        header = F.when(kind == number, _filled(head, values)).otherwise(header)
    budget = F.when(F.pmod(item, F.lit(3)) > 0, F.pmod(item, F.lit(5)) * 700 + 100)
    return table(spark, sf_dir, "events").select(
        item.alias("item_id"),
        (F.pmod(event, F.lit(2)) + 1).cast("int").alias("attempt"),
        response.alias("response"),
        header.alias("usage_header"),
        budget.cast("bigint").alias("max_tokens"),
    )


TABLES["raw_events"] = (
    [],
    """SELECT event_id, event_id // 2 AS item_id, (event_id % 2 + 1)::INTEGER AS attempt,
              (event_id // 2) % 8 AS kind, event_id % 700 AS pt, floor(value)::BIGINT AS ct,
              event_id % 50 AS rt, (event_id % 1000) / 1000 AS cost,
              CASE WHEN (event_id // 2) % 3 > 0 THEN (event_id // 2) % 5 * 700 + 100 END AS max_tokens
       FROM events""",
)

# --- run results ---------------------------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows of every model with errors, latencies, tokens, cost and warnings."""
    model, item = F.col("model"), F.col("item_id")
    drawn = (
        attempts(spark, sf_dir)
        .join(items(spark, sf_dir), "item_id")
        .withColumns(
            {
                "_r": F.pmod(hash32(F.lit("err"), model, item), F.lit(1000)),
                "_l": hash32(F.lit("lat"), model, item),
            }
        )
    )
    r, n = F.col("_r"), F.col("_l")
    flags = [(11, "regex_fallback"), (13, "no_parse"), (17, "retry_due_to_no_parse")]
    warnings = F.filter(
        F.array(*[F.when(r % every == 0, F.lit(name)) for every, name in flags]),
        lambda w: w.isNotNull(),
    )
    tokens = F.pmod(n, F.lit(5000))
    return drawn.select(
        "model",
        "item_id",
        "year",
        "exam",
        "multimodal",
        "points",
        "answer",
        "predicted",
        F.when(r < 15, F.lit("HTTP 500")).alias("error"),
        F.when(r % 7 != 0, F.pmod(n, F.lit(90000)) / 10).alias("latency_ms"),
        F.when(r % 5 != 0, tokens).alias("prompt_tokens"),
        F.when(r % 5 != 1, F.floor(tokens / 3)).alias("completion_tokens"),
        F.when(r % 3 != 0, tokens + F.floor(tokens / 3)).alias("total_tokens"),
        F.when(r % 5 == 2, F.floor(tokens / 4)).alias("reasoning_tokens"),
        F.when(r % 5 != 1, F.floor(tokens / 3)).alias("explicit_reasoning_tokens"),
        F.when(r % 4 != 0, F.pmod(n, F.lit(1000)) / 100000).alias("cost_usd"),
        F.when(r % 2 == 0, warnings).alias("warnings"),
    )


TABLES["results"] = (
    ["attempts", "items"],
    f"""SELECT model, item_id, year, exam, multimodal, points, answer, predicted0 AS predicted,
        error, CASE WHEN r % 7 <> 0 THEN n % 90000 / 10 END AS latency_ms,
        CASE WHEN r % 5 <> 0 THEN t END AS prompt_tokens,
        CASE WHEN r % 5 <> 1 THEN t // 3 END AS completion_tokens,
        CASE WHEN r % 3 <> 0 THEN t + t // 3 END AS total_tokens,
        CASE WHEN r % 5 = 2 THEN t // 4 END AS reasoning_tokens,
        CASE WHEN r % 5 <> 1 THEN t // 3 END AS explicit_reasoning_tokens,
        CASE WHEN r % 4 <> 0 THEN n % 1000 / 100000 END AS cost_usd,
        CASE WHEN r % 2 = 0 THEN list_filter([CASE WHEN r % 11 = 0 THEN 'regex_fallback' END,
             CASE WHEN r % 13 = 0 THEN 'no_parse' END,
             CASE WHEN r % 17 = 0 THEN 'retry_due_to_no_parse' END], lambda w: w IS NOT NULL) END AS warnings,
        CASE WHEN error IS NULL THEN predicted0 END AS read,
        CASE WHEN error IS NOT NULL OR predicted0 IS NULL THEN -0.25 * points
             WHEN upper(trim(predicted0)) = 'DECLINED' THEN 0.0
             WHEN upper(trim(predicted0)) = answer THEN points ELSE -0.25 * points END AS points_earned,
        coalesce(error IS NULL AND upper(trim(predicted0)) = answer, false) AS is_correct
        FROM (SELECT model, item_id, year, exam, multimodal, points, answer,
                     predicted AS predicted0, r, n, n % 5000 AS t,
                     CASE WHEN r < 15 THEN 'HTTP 500' END AS error
              FROM (SELECT *, {h("'err'", 'model', 'item_id')} % 1000 AS r,
                           {h("'lat'", 'model', 'item_id')} AS n
                    FROM attempts JOIN items USING (item_id)))""",
)


def run_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paused run: a first part with failures and gaps, and a second part that asks again."""
    draw = F.pmod(hash32(F.lit("part"), F.col("model"), F.col("item_id")), F.lit(100))
    first = attempts(spark, sf_dir).withColumn("_d", draw).filter("_d < 95")
    second = repeat_attempts(spark, sf_dir).withColumn("_d", draw).filter("_d >= 80")
    return first.select(
        "model",
        "item_id",
        F.when(F.col("_d") < 80, F.col("predicted")).alias("predicted"),
        F.when(F.col("_d") >= 80, F.lit("connection lost")).alias("error"),
        F.lit(1).alias("finished_at"),
    ).unionByName(
        second.select(
            "model",
            "item_id",
            F.when(F.col("_d") != 90, F.col("predicted")).alias("predicted"),
            F.when(F.col("_d") == 90, F.lit("timeout")).alias("error"),
            F.lit(2).alias("finished_at"),
        )
    )


TABLES["run_parts"] = (
    ["attempts", "repeat_attempts"],
    f"""SELECT model, item_id, CASE WHEN d < 80 THEN predicted END AS predicted,
               CASE WHEN d >= 80 THEN 'connection lost' END AS error, 1 AS finished_at
        FROM (SELECT *, {h("'part'", 'model', 'item_id')} % 100 AS d FROM attempts) WHERE d < 95
        UNION ALL
        SELECT model, item_id, CASE WHEN d <> 90 THEN predicted END,
               CASE WHEN d = 90 THEN 'timeout' END, 2
        FROM (SELECT *, {h("'part'", 'model', 'item_id')} % 100 AS d FROM repeat_attempts)
        WHERE d >= 80""",
)
