"""Message content: flattening provider replies and assembling chat prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examlens.functions.common import col
from examlens.functions.scoring import LETTERS

# --- Fixed values: the wording of the prompts. ----------------------------------------------
SYSTEM_DE = "\n".join(
    [
        "Du bist ein hilfreicher Assistent für Multiple-Choice-Aufgaben.",
        "Bewertung: Eine korrekte Antwort erhält die vollen Punkte der Aufgabe; eine falsche "
        "oder nicht eindeutig auswertbare Endantwort zieht ein Viertel der Aufgabenpunkte ab; "
        "'Ich entscheide mich, nicht zu antworten.' ergibt 0 Punkte ohne Abzug.",
        "Wähle die beste Option (A–E). Wenn die richtige Option nicht mit ausreichender "
        "Sicherheit bestimmbar ist oder die Aufgabe mehrdeutig ist, kannst du ausdrücklich mit "
        "'Ich entscheide mich, nicht zu antworten.' antworten. Begründungen sind optional.",
        "Füge am Ende eine einzelne Zeile an: Final answer: A|B|C|D|E|Declined.",
    ]
)
SYSTEM_EN = "\n".join(
    [
        "You are a helpful assistant for multiple-choice tasks.",
        "Scoring: a correct answer earns the task's full points; an incorrect or unparseable "
        "final answer subtracts one quarter of the task's points; choosing not to answer earns "
        "0 points with no penalty.",
        "Select the best option (A–E). If the correct option cannot be determined with "
        "sufficient confidence or the question is ambiguous, you may explicitly reply 'I choose "
        "not to answer.' Reasoning is optional.",
        "Add a single line at the end: Final answer: A|B|C|D|E|Declined.",
    ]
)
REMINDER_DE = (
    "Erinnere dich: Beende deine Antwort mit einer Zeile in diesem Format – "
    "Final answer: A|B|C|D|E|Declined."
)
REMINDER_EN = (
    "Remember to finish with a line in this format – Final answer: A|B|C|D|E|Declined."
)
# (German, English)
QUESTION = ("Frage:", "Question:")
QUESTION_IMAGE = ("Fragebild:", "Question image:")
EXTRA_IMAGE = ("Zusatzbild", "Additional image")
CHOICES = ("Antwortmöglichkeiten:", "Answer choices:")
OPTION_IMAGE = "Option {letter} Bild:"
# --- End of fixed values. ---------------------------------------------------------------------


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def is_number(value: Column) -> Column:
    return F.substring(F.schema_of_variant(value), 1, 6).isin("BIGINT", "DOUBLE", "DECIMA")


def _field(value: Column, name: str) -> Column:
    """A field that is present and not JSON null, as a variant."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


def _text(value: Column, path: str = "$") -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(
        is_string(found), F.try_variant_get(value, path, "string")
    )


def flatten_content(content: Column | str) -> Column:
    """Plain text of a message content given as a variant.

    Strings stay; lists join their non-empty parts with line breaks; objects give their
    ``text``, ``json`` or nested ``content``, lists in lists to any depth. JSON payloads are
    printed compactly.
    """
    content = col(content)
    nested = _field(content, "content")
    of_object = F.coalesce(_text(content, "$.text"), F.to_json(_field(content, "json")), _text(nested))
    listed = F.when(is_array(content), content).when(is_object(content) & of_object.isNull() & is_array(nested), nested)
    return (
        F.when(content.isNull() | F.is_variant_null(content), F.lit(""))
        .when(is_string(content), F.try_variant_get(content, "$", "string"))
        .when(listed.isNotNull(), _joined(listed))
        .otherwise(F.coalesce(of_object, F.to_json(content)))
    )


def _joined(parts: Column) -> Column:
    """Texts of a list's parts in order. Each step opens the lists that are still closed, one level.

    A document has no more levels than opening brackets, so that many steps are enough.
    """
    printed = F.to_json(parts)
    steps = F.length(printed) - F.length(F.replace(printed, F.lit("["), F.lit("")))
    closed = F.array(F.struct(parts.alias("list"), F.lit(None).cast("string").alias("text")))

    def open_lists(nodes: Column, _step: Column) -> Column:
        def opened(node: Column) -> Column:
            items = F.try_variant_get(node["list"], "$", "array<variant>")
            return F.when(node["list"].isNull(), F.array(node)).otherwise(F.transform(items, _part_of))

        return F.flatten(F.transform(nodes, opened))

    nodes = F.aggregate(F.sequence(F.lit(1), steps), closed, open_lists)
    texts = F.transform(nodes, lambda node: node["text"])
    return F.array_join(F.filter(texts, lambda text: text.isNotNull() & (text != "")), "\n")


def _part_of(item: Column) -> Column:
    """A part of a list: its text, or the list that it holds."""
    nested = _field(item, "content")
    payload, text = _field(item, "json"), _text(item, "$.text")
    holds = is_object(item) & payload.isNull() & text.isNull() & is_array(nested)
    calls = F.to_json(F.coalesce(_field(item, "tool_calls"), _field(item, "arguments")))
    of_object = F.coalesce(F.to_json(payload), text, _text(nested), calls)
    return F.struct(
        F.when(holds, nested).alias("list"),
        F.when(is_string(item), F.try_variant_get(item, "$", "string"))
        .when(is_object(item) & ~F.coalesce(holds, F.lit(False)), of_object)
        .alias("text"),
    )


def _part(kind: str, text: Column | None, url: Column | None, detail: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (none if text is None else text).alias("text"),
        (none if url is None else url).alias("url"),
        (F.lit(detail) if url is not None else none).alias("detail"),
    )


def image_url(data: Column, mime: str = "image/png") -> Column:
    """Bytes as a data URL, unchanged."""
    return F.when(data.isNotNull(), F.concat(F.lit(f"data:{mime};base64,"), F.base64(data)))


def chat_messages(
    question_image: Column,
    extra_images: Column,
    option_images: dict[str, Column],
    image_detail: str = "auto",
) -> Column:
    """``struct(system, content)`` of one item; images are URLs or null.

    Needs the columns ``language, problem_statement, sol_A..sol_E``.
    """
    german = F.lower(F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("de"))) == "de"

    def say(pair: tuple[str, str]) -> Column:
        return F.when(german, F.lit(pair[0])).otherwise(F.lit(pair[1]))

    def with_image(label: Column, url: Column) -> list[Column]:
        shown = url.isNotNull()
        return [
            F.when(shown, _part("text", label, None, image_detail)),
            F.when(shown, _part("image_url", None, url, image_detail)),
        ]

    statement = F.coalesce(F.col("problem_statement"), F.lit("None"))
    head = [
        _part("text", F.concat(say(QUESTION), F.lit(" "), statement), None, image_detail),
        *with_image(say(QUESTION_IMAGE), question_image),
    ]
    extras = F.flatten(
        F.transform(
            F.coalesce(extra_images, F.array().cast("array<string>")),
            lambda url, i: F.array(
                *with_image(
                    F.concat(say(EXTRA_IMAGE), F.lit(" "), (i + 1).cast("string"), F.lit(":")), url
                )
            ),
        )
    )
    tail = [_part("text", say(CHOICES), None, image_detail)]
    for letter in LETTERS:
        option = F.coalesce(F.col(f"sol_{letter}"), F.lit(""))
        tail.append(_part("text", F.concat(F.lit(f"{letter}) "), option), None, image_detail))
        label = F.lit(OPTION_IMAGE.format(letter=letter))
        tail += with_image(label, option_images.get(letter, F.lit(None).cast("string")))
    tail.append(_part("text", say((REMINDER_DE, REMINDER_EN)), None, image_detail))
    content = F.filter(
        F.concat(F.array(*head), extras, F.array(*tail)), lambda part: part.isNotNull()
    )
    return F.struct(say((SYSTEM_DE, SYSTEM_EN)).alias("system"), content.alias("content"))


def coerce_bytes(value: Column | str, kind: str) -> Column:
    """Image bytes from a binary column, or from base64 text longer than 16 characters."""
    value = col(value)
    if kind == "binary":
        return value
    letters = F.regexp_replace(value, r"[^A-Za-z0-9+/=]", "")
    return F.when(F.length(value) > 16, F.try_to_binary(letters, F.lit("base64")))


def coerce_byte_list(value: Column | str, kind: str) -> Column:
    """List of image bytes without unreadable entries; null when nothing is left."""
    kept = F.filter(
        F.transform(col(value), lambda item: coerce_bytes(item, kind)),
        lambda item: item.isNotNull(),
    )
    return F.when(F.size(kept) > 0, kept)
