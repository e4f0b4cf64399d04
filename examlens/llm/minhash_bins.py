"""Document fingerprints by one-permutation MinHash, in column expressions only.

Every shingle is hashed once. The high bits of the hash name a bin, the smallest hash of a bin
is its value. Empty bins are filled by optimal densification: each walks its own fixed sequence
of random bins until it meets a filled one. The low bits of the values are stored, packed as
hexadecimal digits; likeness corrects for values that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.llm.common import SPACES, once, written

#: Bins (a power of two), bits kept of each, words of a shingle.
BINS, BITS, WORDS = 256, 8, 5
#: Steps of an empty bin's walk before the rest of its order is searched at once.
STEPS = 12


def _shingles(text: Column, words: int) -> Column:
    """Hashes of all runs of ``words`` words; of the whole sequence if it is shorter."""
    hashes = F.transform(F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    return once(
        hashes,
        lambda h: F.when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))),
                lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(words)]),
            )
        ),
    )


def _bins(shingles: Column, bins: int) -> Column:
    """One value per bin, null where it is empty. Sorted hashes lie bin by bin, so the first of
    each run is the least, and the gap to the next run is the number of empty bins between."""
    shift = 64 - (bins.bit_length() - 1)

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, shift).cast("int") + bins // 2

    def empty(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("long"), n)

    return once(
        F.sort_array(shingles),
        lambda s: once(
            F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))),
            lambda least: F.concat(
                empty(bin_of(least[0])),
                F.flatten(
                    F.transform(
                        least,
                        lambda h, i: F.concat(
                            F.array(h),
                            empty(F.coalesce(bin_of(F.get(least, i + 1)), F.lit(bins)) - bin_of(h) - 1),
                        ),
                    )
                ),
            ),
        ),
    )


def _filled(values: Column, bins: int) -> Column:
    """Empty bins take the value of the first filled bin on their walk.

    The walk of bin j visits hash(j, 1), hash(j, 2), ...; after ``STEPS`` misses it goes on
    with all bins in the order of hash(j, bin), so it always ends.
    """

    def donor(v: Column, j: Column) -> Column:
        steps = [F.get(v, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int")) for t in range(STEPS)]
        rest = F.array_min(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.get(v, b).isNotNull()),
                lambda b: F.struct(F.xxhash64(j, F.lit(-1), b).alias("order"), F.get(v, b).alias("value")),
            )
        )
        return F.coalesce(*steps, rest["value"])

    return once(values, lambda v: F.transform(v, lambda x, j: F.coalesce(x, donor(v, j))))


def _packed(values: Column, bits: int) -> Column:
    """Low ``bits`` of each value as hexadecimal digits, in the order of the bins."""
    if bits >= 4:
        digits = bits // 4
        return F.array_join(
            F.transform(values, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1)))), digits, "0")), ""
        )
    each = 4 // bits

    def digit(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for k in range(each):
            low = F.get(values, i * each + k).bitwiseAND(F.lit((1 << bits) - 1))
            total = total + F.shiftleft(low, bits * (each - 1 - k))
        return F.lower(F.hex(total))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / each).cast("int") - 1), digit), "")


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint of a text; a missing text counts as empty.

    A text of fewer than ``words`` words has one shingle, its whole word sequence; texts without
    words thus share one fingerprint. ``bits`` is 1, 2, 4, 8 or 16.
    """
    if bits not in (1, 2, 4, 8, 16) or bins & (bins - 1) or bins < 4:
        raise ValueError("bits must be 1, 2, 4, 8 or 16 and bins a power of two, 4 at least")
    filled = _filled(_bins(_shingles(F.coalesce(text, F.lit("")), words), bins), bins)
    return once(filled, lambda v: _packed(v, bits))


def likeness(left: Column, right: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less those equal by chance."""
    chance = 2.0**-bits
    places = F.sequence(F.lit(0), F.lit(bins - 1))
    if bits >= 8:  # whole bytes are found by place, unlike characters
        n = bits // 8

        def equal_bins(a: Column, b: Column) -> Column:
            return F.size(F.filter(places, lambda i: F.substr(a, i * n + 1, F.lit(n)) == F.substr(b, i * n + 1, F.lit(n))))

    else:
        each = 8 // bits

        def value(x: Column, i: Column) -> Column:
            byte = F.conv(F.hex(F.substr(x, F.floor(i / each).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), bits * (each - 1 - F.pmod(i, F.lit(each))))) % (1 << bits)

        def equal_bins(a: Column, b: Column) -> Column:
            return F.size(F.filter(places, lambda i: value(a, i) == value(b, i)))

    same = once(F.unhex(left), lambda a: once(F.unhex(right), lambda b: equal_bins(a, b)))
    share = same / F.lit(float(bins))
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def fingerprints(
    docs: DataFrame, text_col: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS
) -> DataFrame:
    """The documents with a column ``fingerprint`` (one of that name is replaced): no shuffle.

    Repeated rows stay; equal texts have equal fingerprints.
    """
    return docs.withColumn("fingerprint", fingerprint(F.col(text_col), words, bins, bits))


def with_next(
    rows: DataFrame,
    key: str,
    derive: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    blocks: int | None = None,
) -> DataFrame:
    """Each row with the row that follows it in descending order of an integer key, as ``next``.

    The last row is followed by the first; missing keys come last; rows with equal keys follow
    each other in the order of their other columns. A column ``next`` is replaced. ``derive`` adds
    columns to the rows and is applied where they are needed, once per row.

    Rows are dealt to blocks whose borders come from Spark's range partitioning of the keys (and of
    the beginning of the first text column, which splits one key of many rows), so blocks are even
    however sparse keys are. Each block is sorted by its own task; its last row is followed by the
    first row of the block after it. Borders are written, one row per block; only the blocks' first
    rows meet in one task.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "next"]
    rows = rows.select(*names)
    blocks = blocks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).desc_nulls_last(), *[F.col(c) for c in names if c != key]]
    texts = [c for c in names if c != key and dict(rows.dtypes)[c] == "string"]
    start = F.coalesce(F.left(F.col(texts[0]), F.lit(32)), F.lit("")) if texts else F.lit("")
    falling = F.coalesce(F.bitwise_not(F.col(key).cast("bigint")), F.lit(0))
    place = F.struct(F.col(key).isNull().alias("z"), falling.alias("k"), start.alias("t"))
    ranged = rows.select(place.alias("_place")).repartitionByRange(blocks, "_place")
    firsts = written(
        ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.min("_place").alias("_first")).select("_first"), "blocks"
    )
    borders = firsts.agg(F.sort_array(F.collect_set("_first"))).scalar()
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(blocks.bit_length()))])

    def blocked(frame: DataFrame) -> DataFrame:
        """With ``_block``, the number of borders at or before a row, and whether it is the block's first."""

        def further(at: Column, jump: Column) -> Column:
            reached = (at + jump <= F.size("_borders")) & (F.get("_borders", at + jump - 1) <= F.col("_place"))
            return F.when(reached, at + jump).otherwise(at)

        found = frame.select("*", place.alias("_place"), borders.alias("_borders")).select(
            "*", F.aggregate(jumps, F.lit(0), further).alias("_block")
        )
        return found.withColumn("_begins", F.get("_borders", F.col("_block") - 1) == F.col("_place")).drop("_place", "_borders")

    derived = derive(rows)
    fields = derived.columns
    window = Window.partitionBy("_block").orderBy(*order)
    placed = blocked(derived).withColumn("next", F.lead(F.struct(*fields)).over(window))
    head_rows = (
        blocked(rows).where("_begins").groupBy("_block").agg(F.min(F.struct(*names)).alias("row")).select("_block", "row.*")
    )
    heads = derive(head_rows).select("_block", F.struct(*fields).alias("head"))
    everything = Window.partitionBy(F.lit(0)).orderBy("_block")
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        "_block", F.coalesce(F.lead("head").over(everything), F.first("head").over(whole)).alias("_after")
    )
    return placed.join(after, "_block", "left").select(*fields, F.coalesce("next", "_after").alias("next"))
