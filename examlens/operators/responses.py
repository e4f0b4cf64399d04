"""From archived provider responses to parsed answers, usage totals and re-query plans.

A raw response row holds ``item_id, attempt, response`` (JSON text) and ``usage_header``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.answers import extract_answer
from examlens.functions.messages import flatten_content, is_number, is_object, is_string
from examlens.functions.scoring import score_question, valid_key

# Provider reasons for a cut reply, and the token budgets of a new try.
CUT_REASONS = ["length", "max_tokens", "max_tokens_exceeded"]
FIRST_RETRY_TOKENS = 256
LARGEST_RETRY_TOKENS = 4096

TOKEN_ALIASES = {
    "prompt_tokens": ["input_tokens", "prompt_tokens"],
    "completion_tokens": ["output_tokens", "completion_tokens"],
    "total_tokens": ["total_tokens"],
}
PROMPT_DETAILS = ["prompt_tokens_details", "input_tokens_details"]
COMPLETION_DETAILS = ["completion_tokens_details", "output_tokens_details"]


def parse_responses(raw: DataFrame) -> DataFrame:
    """First choice of each response with its text, finish reason and extracted answer."""
    document = F.try_parse_json("response")
    choices = F.try_variant_get(document, "$.choices", "array<variant>")
    objects = F.filter(choices, lambda choice: is_object(choice))
    opened = _evaluated(
        raw,
        F.struct(
            document.isNull().alias("_plain"), F.get(objects, F.lit(0)).alias("_choice")
        ),
    )
    content = F.try_variant_get("_choice", "$.message.content", "variant")
    read = _evaluated(
        opened,
        F.struct(
            F.try_variant_get("_choice", "$.finish_reason", "string").alias("finish_reason"),
            F.try_variant_get("_choice", "$.native_finish_reason", "string").alias(
                "native_finish_reason"
            ),
            # without a readable document the body itself is the text
            F.when(F.col("_plain"), F.col("response"))
            .otherwise(flatten_content(content))
            .alias("content_text"),
        ),
    ).drop("_plain", "_choice")
    return _evaluated(read, extract_answer("content_text"))


def _evaluated(frame: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct, computed exactly once per row.

    Unfolding a one-element array is a step the optimizer does not inline. Long text
    expressions would otherwise be copied into every later filter and column that uses them.
    """
    return frame.select("*", F.inline(F.array(fields)))


def requery_plan(parsed: DataFrame) -> DataFrame:
    """Rows to ask again: cut replies with a larger budget, unreadable ones as they are.

    Needs ``max_tokens`` (null for the provider default) beside the parsed columns.
    """
    cut = F.lit(False)
    for name in ("finish_reason", "native_finish_reason"):
        cut = cut | F.coalesce(F.lower(F.col(name)).isin(CUT_REASONS), F.lit(False))
    budget = F.col("max_tokens")
    grown = F.when(budget.isNull(), F.lit(FIRST_RETRY_TOKENS)).otherwise(
        F.least(2 * budget, F.lit(LARGEST_RETRY_TOKENS))
    )
    shown = F.coalesce(budget.cast("string"), F.lit("auto"))
    return parsed.filter(F.col("predicted").isNull()).select(
        "item_id",
        "attempt",
        F.when(cut, grown).otherwise(budget).cast("bigint").alias("next_max_tokens"),
        F.when(
            cut,
            F.concat(F.lit("max_tokens_retry_"), shown, F.lit("->"), grown.cast("string")),
        )
        .otherwise(F.concat(F.lit("retry_due_to_"), "warning"))
        .alias("reason"),
    )


def _number(document: Column, path: str) -> Column:
    """A JSON number as double; strings and other types give null."""
    found = F.try_variant_get(document, path, "variant")
    return F.when(is_number(found), F.try_variant_get(document, path, "double"))


def _loose_number(document: Column, path: str) -> Column:
    """A JSON number or a numeric string as double."""
    found = F.try_variant_get(document, path, "variant")
    text = F.when(
        is_string(found),
        F.try_variant_get(document, path, "string").try_cast("double"),
    )
    return F.coalesce(_number(document, path), text)


def _object_at(document: Column, names: list[str]) -> Column:
    """The first of the named fields that is an object."""
    candidates = []
    for name in names:
        found = F.try_variant_get(document, f"$.{name}", "variant")
        candidates.append(F.when(is_object(found), found))
    return F.coalesce(*candidates)


def _first(document: Column, names: list[str], read=_number) -> Column:
    return F.coalesce(*[read(document, f"$.{name}") for name in names])


def _truthy(value: Column) -> Column:
    return F.when(value != 0, value)


def usage_fields(usage: Column, prompt: Column, completion: Column) -> dict[str, Column]:
    """Counters of one response's usage object and its two detail objects."""
    reasoning = _number(completion, "$.reasoning_tokens")
    explicit = _number(completion, "$.explicit_reasoning_tokens")
    # a zero cost falls through to the total; a cost may come as text
    cost_text = F.when(
        is_string(F.try_variant_get(usage, "$.cost", "variant")),
        F.try_variant_get(usage, "$.cost", "string"),
    )
    cost = F.when(cost_text != "", cost_text.try_cast("double")).otherwise(
        F.coalesce(_truthy(_number(usage, "$.cost")), _loose_number(usage, "$.total_cost"))
    )
    return {
        **{name: _first(usage, aliases) for name, aliases in TOKEN_ALIASES.items()},
        "cached_prompt_tokens": _number(prompt, "$.cached_tokens"),
        "audio_prompt_tokens": _number(prompt, "$.audio_tokens"),
        "reasoning_tokens": reasoning,
        "explicit_reasoning_tokens": _added(reasoning, explicit),
        "cost_usd": cost,
    }


def _added(first: Column, second: Column) -> Column:
    """Sum that ignores one missing side."""
    return F.when(
        first.isNotNull() | second.isNotNull(),
        F.coalesce(first, F.lit(0.0)) + F.coalesce(second, F.lit(0.0)),
    )


def header_parts(header: Column) -> Column:
    """``struct(document, pairs)``: the header as JSON object, else its ``key=value`` pairs."""
    document = F.try_parse_json(header)
    as_json = F.coalesce(is_object(document), F.lit(False))
    pairs = F.transform(
        F.split(header, "[,;]"),
        lambda part: F.struct(
            F.trim(F.regexp_extract(part, r"^([^=]*)=", 1)).alias("key"),
            F.trim(F.regexp_extract(part, r"^[^=]*=(.*)$", 1)).try_cast("double").alias("value"),
        ),
    )
    return F.struct(
        F.when(as_json, document).alias("_document"), F.when(~as_json, pairs).alias("_pairs")
    )


def header_fields(
    document: Column, pairs: Column, prompt: Column, completion: Column
) -> dict[str, Column]:
    """The same counters from the parts of a usage header."""

    def pair(name: str) -> Column:
        """The last readable value of a key."""
        hits = F.filter(pairs, lambda p: (p["key"] == name) & p["value"].isNotNull())
        return F.try_element_at(hits, F.lit(-1))["value"]

    def any_of(names: list[str]) -> Column:
        return F.coalesce(_first(document, names), *[pair(name) for name in names])

    def detail(inner: Column, flat: list[str], name: str) -> Column:
        inside = _number(inner, f"$.{name}")
        dotted = [_loose_number(document, f"$['{key}.{name}']") for key in flat]
        return F.coalesce(inside, *dotted, *[pair(f"{key}.{name}") for key in flat])

    reasoning = detail(completion, COMPLETION_DETAILS, "reasoning_tokens")
    explicit = detail(completion, COMPLETION_DETAILS, "explicit_reasoning_tokens")
    cost = F.coalesce(_truthy(any_of(["cost"])), any_of(["total_cost"]))
    return {
        **{name: any_of(aliases) for name, aliases in TOKEN_ALIASES.items()},
        "cached_prompt_tokens": detail(prompt, PROMPT_DETAILS[:1], "cached_tokens"),
        "audio_prompt_tokens": detail(prompt, PROMPT_DETAILS[:1], "audio_tokens"),
        "reasoning_tokens": reasoning,
        "explicit_reasoning_tokens": _added(reasoning, explicit),
        "cost_usd": cost,
    }


COUNTERS = [
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "cached_prompt_tokens",
    "audio_prompt_tokens",
    "reasoning_tokens",
    "explicit_reasoning_tokens",
]


def normalize_usage(raw: DataFrame) -> DataFrame:
    """Usage per item over all its attempts.

    Numbers are summed over attempts. Where no attempt reports a number, the last usage
    object is read again with numeric strings allowed. The explicit reasoning count falls
    back to the completion tokens.
    """
    usage = F.try_variant_get(F.try_parse_json("response"), "$.usage", "variant")
    opened = _evaluated(raw, F.struct(F.when(is_object(usage), usage).alias("_usage")))
    opened = _evaluated(opened, header_parts(F.col("usage_header")))
    opened = _evaluated(
        opened,
        F.struct(
            *[
                _object_at(F.col(source), names).alias(f"{source}_{kind}")
                for source in ("_usage", "_document")
                for kind, names in (("prompt", PROMPT_DETAILS), ("completion", COMPLETION_DETAILS))
            ]
        ),
    )
    from_body = usage_fields(
        F.col("_usage"), F.col("_usage_prompt"), F.col("_usage_completion")
    )
    from_header = header_fields(
        F.col("_document"), F.col("_pairs"), F.col("_document_prompt"), F.col("_document_completion")
    )
    names = [*COUNTERS, "cost_usd"]
    per_attempt = opened.select(
        "item_id",
        "attempt",
        F.col("_usage").isNotNull().alias("_has_body"),
        *[
            F.when(F.col("_usage").isNotNull(), from_body[n]).otherwise(from_header[n]).alias(n)
            for n in names
        ],
        *[
            _first(F.col("_usage"), aliases, _loose_number).alias(f"_loose_{name}")
            for name, aliases in TOKEN_ALIASES.items()
        ],
        _first(F.col("_usage"), ["cost", "total_cost"], _loose_number).alias("_loose_cost_usd"),
    )
    loose = [*TOKEN_ALIASES, "cost_usd"]
    last = F.max_by(
        F.struct(*[f"_loose_{n}" for n in loose]),
        F.when(F.col("_has_body"), F.col("attempt")),
    )
    summed = per_attempt.groupBy("item_id").agg(
        *[F.sum(n).alias(n) for n in names], last.alias("_last")
    )
    known = F.coalesce(*[F.col(n) for n in loose]).isNotNull()
    filled = {
        n: F.when(known, F.col(n)).otherwise(F.col(f"_last._loose_{n}")) for n in loose
    }
    whole = summed.withColumns(filled)
    return whole.select(
        "item_id",
        *[F.col(n).cast("bigint").alias(n) for n in COUNTERS[:-1]],
        F.coalesce("explicit_reasoning_tokens", "completion_tokens")
        .cast("bigint")
        .alias("explicit_reasoning_tokens"),
        "cost_usd",
    )


def run_records(rows: DataFrame) -> DataFrame:
    """Scored run rows from items with their parsed answers; failures cost a quarter.

    A row with an ``error`` has no prediction. Needs ``points, answer, predicted, error``.
    """
    key = valid_key("answer")
    predicted = F.when(F.col("error").isNull(), F.col("predicted"))
    scored = score_question("points", F.col("_key"), F.col("predicted"))
    return (
        rows.withColumns({"_key": key, "predicted": predicted})
        .withColumn("_score", scored)
        .select(
            *[c for c in rows.columns if c not in ("answer", "predicted")],
            F.col("_key").alias("answer"),
            "predicted",
            F.col("_score.is_correct").alias("is_correct"),
            F.col("_score.points_earned").alias("points_earned"),
        )
    )


def latest_answers(parts: DataFrame, keys: list[str] | None = None, order: str = "finished_at") -> DataFrame:
    """One row per item over all parts of a run: the newest without an error.

    ``max_by`` combines map side, so an item that was asked very often costs no sort.
    """
    keys = keys or ["model", "item_id"]
    rest = [c for c in parts.columns if c not in keys]
    newest = F.max_by(
        F.struct(*rest), F.struct(F.col("error").isNull().alias("ok"), F.col(order).alias("at"))
    )
    return parts.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def missing_items(items: DataFrame, answered: DataFrame, runs: DataFrame) -> DataFrame:
    """``model, item_id`` of every item that a run still lacks in all its parts.

    ``runs`` holds the wanted ``model`` names, one row per run. A row with an error, or without
    an answer, does not count as answered.
    """
    done = answered.filter(F.col("error").isNull() & F.col("predicted").isNotNull()).select("model", "item_id")
    # the few runs become one list that every item unfolds: no join of items with runs
    models = runs.agg(F.sort_array(F.collect_set("model"))).scalar()
    wanted = items.select("item_id").withColumn("model", F.explode(models))
    return wanted.join(done, ["model", "item_id"], "left_anti").select("model", "item_id")


