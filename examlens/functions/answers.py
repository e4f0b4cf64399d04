"""Reading an answer letter out of free model text, as one Catalyst expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from examlens.functions.common import col, strip
from examlens.functions.scoring import DECLINED, LETTERS

# --- Fixed values: these patterns and word lists decide the parsed letter. ---------------
FINAL_LINE = (
    r"(?imdU)^\s*(?:final\s*answer|antwort)\s*[:：\-–—]?\s*([^\n]+?)\s*$"
)
TOKEN_QUOTES = "`\"'“”‘’"
TOKEN_TAIL = r"[\s\x1c-\x1f.!?؛。,…]"
DECLINE_PHRASES = [
    "declined",
    "i choose not to answer",
    "i choose to not answer",
    "choose not to answer",
    "i decline to answer",
    "i decline",
    "i cannot determine with confidence",
    "cannot determine with confidence",
    "i cannot determine the answer",
    "unable to determine",
    "ich entscheide mich, nicht zu antworten",
    "ich wähle, nicht zu antworten",
    "antwort verweigern",
    "ich verweigere die antwort",
    "nicht mit ausreichender sicherheit bestimmbar",
    "kann nicht mit ausreichender sicherheit bestimmen",
    "ich weiß es nicht",
    "weiß es nicht",
    "keine ahnung",
]
DECLINE_PATTERNS = [
    r"i\s+choose\s+not\s+to\s+answer",
    r"choose\s+not\s+to\s+answer",
    r"i\s+decline\s+to\s+answer",
    r"i\s+decline",
    r"cannot\s+determine\s+(?:with\s+)?confidence",
    r"unable\s+to\s+determine",
    r"ich\s+entscheide\s+mich,\s+nicht\s+zu\s+antworten",
    r"ich\s+wähle,\s+nicht\s+zu\s+antworten",
    r"antwort\s+verweigern",
    r"ich\s+verweigere\s+die\s+antwort",
    r"nicht\s+mit\s+ausreichender\s+sicherheit\s+bestimmbar",
    r"keine\s+ahnung",
    r"ich\s+weiß\s+es\s+nicht",
]
# --- End of fixed values. ------------------------------------------------------------------

# A word is made of letters, numbers and underscores; combining marks end it. Written out,
# because ``\b`` differs between regex engines and library versions.
NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"
DECLINE_SEARCH = (
    r"(?iU)" + NO_WORD_BEFORE + "(?:" + "|".join(DECLINE_PATTERNS) + ")" + NO_WORD_AFTER
)
# The phrases above hold lower-case letters, blanks and commas only.
DECLINE_SET = sorted({re.sub(r"\W+", " ", phrase) for phrase in DECLINE_PHRASES})
LONE_LETTER = NO_WORD_BEFORE + "([A-Ea-e])" + NO_WORD_AFTER
JSON_OBJECT = r"(?s)\A\s*\{.*\}\s*\z"
FIRST_BLOCK = r"(?s)(\{.*?\})"


def _or_null(value: Column) -> Column:
    """Spark's extractors return '' where nothing matched."""
    return F.when(value != "", value)


def last_final_line(text: Column | str) -> Column:
    """Content of the last 'final answer' line, or null."""
    found = F.regexp_extract_all(col(text), F.lit(FINAL_LINE), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def clean_token(raw: Column | str) -> Column:
    """Drop white space, quotes and closing punctuation around a candidate answer."""
    unquoted = F.btrim(strip(raw), F.lit(TOKEN_QUOTES))
    return strip(F.regexp_replace(unquoted, rf"(?U){TOKEN_TAIL}+\z", ""))


def normalize_phrase(value: Column | str) -> Column:
    """Lower-case words separated by single blanks, German letters kept."""
    words = F.regexp_replace(F.lower(col(value)), r"[^a-z0-9äöüß]+", " ")
    return F.trim(words)


def is_decline_phrase(value: Column | str) -> Column:
    return F.coalesce(normalize_phrase(value).isin(DECLINE_SET), F.lit(False))


def mentions_decline(text: Column | str) -> Column:
    return is_decline_phrase(text) | F.coalesce(
        col(text).rlike(DECLINE_SEARCH), F.lit(False)
    )


def first_lone_letter(text: Column | str) -> Column:
    return F.upper(_or_null(F.regexp_extract(col(text), LONE_LETTER, 1)))


def _candidate(raw: Column, rationale: Column | None = None, found: str | None = None) -> Column:
    """A parse result when ``raw`` reads as a letter or an explicit decline, else null."""
    token = clean_token(raw)
    letter = F.upper(token)
    rationale = F.lit(None).cast("string") if rationale is None else rationale
    note = F.lit(found).cast("string")
    return F.when(
        letter.isin(*LETTERS), _parsed(letter, rationale, note)
    ).when(
        is_decline_phrase(token),
        _parsed(F.lit(DECLINED), rationale, F.lit("declined_explicit")),
    )


def _parsed(predicted: Column, rationale: Column, warning: Column) -> Column:
    return F.struct(
        predicted.alias("predicted"),
        rationale.alias("rationale"),
        warning.alias("warning"),
    )


def json_string_field(document: Column, name: str) -> Column:
    """A field of a JSON object when the text is exactly one object and the field a string.

    The text is parsed as the only element of an array, because the variant parser ignores
    whatever follows a complete value and would accept text after the object. The variant parser
    refuses repeated keys and NaN; what it refuses is read by the lenient parser, for which the
    last of repeated keys counts.
    """
    listed = F.when(document.rlike(JSON_OBJECT), F.concat(F.lit("["), document, F.lit("]")))
    whole = F.try_parse_json(listed)
    lenient = F.from_json(listed, f"array<struct<`{name}`:string>>")
    values = F.regexp_extract_all(document, F.lit(rf'"{name}"\s*:\s*(\S)'), F.lit(1))
    last_is_text = F.try_element_at(values, F.lit(-1)) == '"'
    refused = listed.isNotNull() & whole.isNull()
    of_lenient = F.when(refused & (F.size(lenient) == 1) & last_is_text, lenient[0][name])
    field = F.try_variant_get(whole, f"$[0].{name}", "variant")
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull()
    of_variant = F.when(
        alone & (F.schema_of_variant(field) == "STRING"),
        F.try_variant_get(whole, f"$[0].{name}", "string"),
    )
    return F.coalesce(of_variant, of_lenient)


def extract_answer(text: Column | str) -> Column:
    """``struct(predicted, rationale, warning)`` for one model response.

    The order of the candidates is the rule: the last final-answer line, the whole text as
    JSON, the first ``{...}`` block, a decline phrase anywhere, the first lone letter.
    """
    text = col(text)
    none = F.lit(None).cast("string")
    block = _or_null(F.regexp_extract(text, FIRST_BLOCK, 1))
    blank = text.isNull() | ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")
    letter = first_lone_letter(text)
    return F.when(
        blank, _parsed(none, none, F.lit("empty_response"))
    ).otherwise(
        F.coalesce(
            _candidate(last_final_line(text)),
            _candidate(json_string_field(text, "answer"), json_string_field(text, "reason")),
            _candidate(
                json_string_field(block, "answer"),
                json_string_field(block, "reason"),
                "json_extracted",
            ),
            F.when(
                mentions_decline(text),
                _parsed(F.lit(DECLINED), none, F.lit("declined_phrase")),
            ),
            F.when(letter.isNotNull(), _parsed(letter, none, F.lit("regex_fallback"))),
            _parsed(none, none, F.lit("no_parse")),
        )
    )
