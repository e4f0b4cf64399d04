"""Explicit schemas of the file formats; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

LETTERS = "ABCDE"


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STR, _INT, _LONG, _DBL, _BOOL, _BIN = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.BinaryType(),
)

# Columns an item dataset must have.
REQUIRED_ITEM_COLUMNS = [
    "id",
    "year",
    "group",
    "points",
    "problem_number",
    "problem_statement",
    "answer",
    "multimodal",
    *[f"sol_{x}" for x in LETTERS],
    "question_image",
    *[f"sol_{x}_image_bin" for x in LETTERS],
    "associated_images_bin",
    "language",
]

ITEMS = struct(
    id=_STR,
    year=_INT,
    group=_STR,
    points=_DBL,
    problem_number=_INT,
    problem_statement=_STR,
    answer=_STR,
    multimodal=_BOOL,
    **{f"sol_{x}": _STR for x in LETTERS},
    question_image=_BIN,
    **{f"sol_{x}_image_bin": _BIN for x in LETTERS},
    associated_images_bin=T.ArrayType(_BIN),
    language=_STR,
)

COMPACT_RUN = struct(
    id=_STR,
    source_id=_STR,
    year=_INT,
    group=_STR,
    problem_number=_INT,
    points=_DBL,
    multimodal=_BOOL,
    predicted=_STR,
    fallback_parse=_BOOL,
    stated_answer=_STR,
    output_capped=_BOOL,
)

RUN_RECORD = struct(
    id=_STR,
    year=_INT,
    group=_STR,
    problem_number=_INT,
    language=_STR,
    multimodal=_BOOL,
    points=_DBL,
    answer=_STR,
    predicted=_STR,
    is_correct=_BOOL,
    points_earned=_DBL,
    reasoning_mode=_STR,
    latency_ms=_DBL,
    prompt_tokens=_LONG,
    completion_tokens=_LONG,
    total_tokens=_LONG,
    reasoning_tokens=_LONG,
    explicit_reasoning_tokens=_LONG,
    cached_prompt_tokens=_LONG,
    audio_prompt_tokens=_LONG,
    cost_usd=_DBL,
    rationale=_STR,
    raw_text_response=_STR,
    generation_id=_STR,
    error=_STR,
    warnings=T.ArrayType(_STR),
)

USAGE_EVENT = struct(
    type=_STR,
    row_id=_STR,
    year=_INT,
    group=_STR,
    points=_DBL,
    problem_number=_INT,
    multimodal=_BOOL,
    latency_ms=_DBL,
    attempts=_INT,
    prompt_tokens=_LONG,
    completion_tokens=_LONG,
    total_tokens=_LONG,
    reasoning_tokens=_LONG,
    explicit_reasoning_tokens=_LONG,
    cached_prompt_tokens=_LONG,
    audio_prompt_tokens=_LONG,
    cost_usd_known=_DBL,
    cost_usd_calc=_DBL,
    predicted=_STR,
    correct=_BOOL,
    status_code=_INT,
    warnings=T.ArrayType(_STR),
    timestamp=_DBL,
    monotonic_ts=_DBL,
)

FORM_ADJUSTMENTS = struct(
    year=_INT,
    group=_STR,
    evaluated_items=_INT,
    official_items=_INT,
    additional_start_points=_DBL,
    automatic_credit=_DBL,
    fixed_bonus=_DBL,
    official_max=_DBL,
    evidence=_STR,
    source=_STR,
)

OPTION_MAPPING = struct(
    id=_STR,
    kept_order_reason=_STR,
    old_answer=_STR,
    new_answer=_STR,
    **{f"new_{x}_source": _STR for x in LETTERS},
)

_RANGE = struct(min=_DBL, max=_DBL)
COHORT = struct(
    year=_INT,
    grades=T.ArrayType(struct(id=_STR, members=T.ArrayType(_INT), max_points=_DBL)),
    totals_by_grade=T.MapType(_STR, _LONG),
    avg_score_by_grade=T.MapType(_STR, _DBL),
    counts_by_grade=T.MapType(_STR, T.ArrayType(_LONG)),
    bins=T.ArrayType(struct(range_default=_RANGE, ranges_by_grade=T.MapType(_STR, _RANGE))),
)

# rate_limit is an object in some entries and a number in others
REGISTRY = struct(
    models=T.ArrayType(
        struct(
            id=_STR,
            label=_STR,
            supports_vision=_BOOL,
            supports_json_response_format=_BOOL,
            rate_limit=_STR,
        )
    )
)

RUN_CONFIG = struct(
    args=struct(
        dataset=_STR,
        model=_STR,
        no_images=_BOOL,
        limit=_LONG,
        seed=_LONG,
        max_tokens=_LONG,
        temperature=_DBL,
        worker_count=_INT,
    ),
    model=struct(id=_STR, label=_STR, supports_vision=_BOOL, min_request_interval=_DBL),
    multimodal_policy=struct(
        cli_filtered_out_rows=_LONG,
        model_filtered_out_rows=_LONG,
        rows_after_filter=_LONG,
        total_rows_loaded=_LONG,
        effective_text_only=_BOOL,
    ),
    resumed=struct(
        reason=_STR,
        first_part=struct(items=_LONG, timestamp_utc=_STR),
        second_part=struct(folder=_STR, items=_LONG, timestamp_utc=_STR),
    ),
    timestamp_utc=_STR,
)

RESPONSE_LOG = struct(
    item_id=_STR, attempt=_INT, response=_STR, usage_header=_STR, max_tokens=_LONG
)
