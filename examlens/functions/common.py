"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that ends a token at the edges: the Unicode white space and the separators
# \x1c-\x1f. A literal list, so that stripping is a plain character scan and not a regex.
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes U+0020 only)."""
    return F.btrim(col(value), F.lit(WHITE_SPACE))


def normalized_letter(value: Column | str) -> Column:
    return F.upper(strip(value))


def hash32(*parts: Column) -> Column:
    """First 32 bits of an md5 over the parts joined by ':' — the same number in any engine."""
    text = F.concat_ws(":", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


#: Items that one task sorts.
TASK_ITEMS = 250_000


def dealt(frame: DataFrame, items: int, *keys: str) -> DataFrame:
    """``frame`` split by ``keys`` into tasks of about ``TASK_ITEMS`` of its ``items``.

    The number of tasks is set, so that they are not merged by their packed bytes: short,
    repetitive rows take many times those where they are sorted. What is joined to the frame on
    the keys is split alike, and so needs no fewer tasks than the session asks for. One task's
    worth stays as it is.
    """
    if items <= TASK_ITEMS:
        return frame
    asked = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(asked, -(-items // TASK_ITEMS)), *keys)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def share(condition: Column) -> Column:
    """Share of rows on which ``condition`` holds."""
    return F.avg(condition.cast("double"))


def share_where(condition: Column, where: Column) -> Column:
    return F.avg(F.when(where, condition.cast("double")))


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


CELL_ITEMS = "cell_items"


class Counted:
    """Aggregates of a frame whose rows may stand for several equal items.

    The column ``cell_items`` holds how many; a frame without it has one item per row. The
    same table function then serves item rows and their pre-aggregated cells.
    """

    def __init__(self, frame: DataFrame):
        counted = CELL_ITEMS in frame.columns
        self.frame = frame if counted else frame.withColumn(CELL_ITEMS, F.lit(1))

    def rows(self) -> Column:
        return F.sum(CELL_ITEMS).cast("bigint")

    def count_if(self, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(CELL_ITEMS)).otherwise(0)).cast("bigint")

    def share(self, condition: Column) -> Column:
        return self.count_if(condition) / F.sum(CELL_ITEMS)

    def share_where(self, condition: Column, where: Column) -> Column:
        return F.try_divide(self.count_if(condition & where), self.count_if(where))

    def total(self, name: str) -> Column:
        return F.sum(F.col(name) * F.col(CELL_ITEMS))


def ordinal(value: Column, ordered: list[str]) -> Column:
    """Position of ``value`` in a fixed list, for sorting a result at the sink."""
    return F.array_position(F.array(*[F.lit(item) for item in ordered]), value)


def lookup(value: Column, labels: dict[str, str]) -> Column:
    """Label of a value from a small literal map; null when it is not listed."""
    entries = [F.lit(part) for pair in labels.items() for part in pair]
    return F.create_map(*entries)[value]
