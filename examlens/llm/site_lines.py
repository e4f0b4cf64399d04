"""Line deduplication by site-relative frequency, in column expressions only.

A line that stands on more than a given share of a site's unlike pages is boilerplate of that site.
Copies and near copies of a page say nothing about its lines, so pages are told apart by what else
stands on them: of a page's other lines one is picked, long ones more likely (its hash divided by
its length is least), and a line is counted once per line that it was picked with. Copies with
a changed headline pick the same line; a footer meets another line on every page. Two independent
picks must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.llm.common import SPACES, written

#: A line is dropped if it is on more than this share of its site's unlike pages, and on so many.
RATIO, LEAST_PAGES = 0.06, 3
#: Independent picks.
PICKS = 2
#: Boilerplate lines (of all sites) that may be broadcast; more are joined by a shuffle.
SMALL_ROWS = 200_000


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line without its outer white space."""
    trimmed = F.btrim(line, F.lit(SPACES))
    return F.struct(F.xxhash64(trimmed).alias("x"), F.xxhash64(F.lit(7), trimmed).alias("y"))


def _weighed(trimmed: Column) -> Column:
    """A trimmed line's key and, for each pick, its hash per character."""
    hashes = [F.crc32(trimmed), F.crc32(F.reverse(trimmed))]
    size = F.char_length(trimmed)
    return F.struct(
        F.xxhash64(trimmed).alias("x"),
        F.xxhash64(F.lit(7), trimmed).alias("y"),
        *[((h + 1) / size).alias(f"p{k}") for k, h in enumerate(hashes)],
    )


def frequent_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``host, x, y``: keys of each host's boilerplate lines.

    Pages of a host that pick the same line count once, in both numbers, so that copies and near
    copies of a page do not turn its content into boilerplate. Lines are counted by 128-bit keys
    per (host, line, picked line), which spreads a frequent line and a large host; only counts
    meet per line. A missing host is a host of its own; missing texts and blank lines count for
    nothing.
    """
    trimmed = F.transform(F.split(text_col, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    lines = F.array_remove(F.array_distinct(trimmed), "")
    pages = docs.where(F.col(text_col).isNotNull()).select(
        F.col(host_col).alias("host"), F.transform(lines, _weighed).alias("keys")
    )

    def first_two(n: int) -> Column:
        """The two lines that a page would pick first; the second is for the first itself."""
        weights = F.transform("keys", lambda k: F.struct(k[f"p{n}"].alias("p"), k["x"].alias("x"), k["y"].alias("y")))
        return F.slice(F.array_sort(weights), 1, 2).alias(f"f{n}")

    picked = pages.select("host", "keys", *map(first_two, range(PICKS)))

    def key(row: Column) -> Column:
        return F.struct(row["x"].alias("x"), row["y"].alias("y"))

    def other(n: int) -> Column:
        first, second, own = F.get(f"f{n}", F.lit(0)), F.get(f"f{n}", F.lit(1)), F.col("k")
        is_first = (first["x"] == own["x"]) & (first["y"] == own["y"])
        return F.when(~is_first, key(first)).when(second.isNotNull(), key(second)).otherwise(key(own))

    spread = (
        picked.select("host", F.explode("keys").alias("k"), *[f"f{n}" for n in range(PICKS)])
        .select("host", "k.x", "k.y", *[other(n).alias(f"c{n}") for n in range(PICKS)])
        .groupBy("host", "x", "y")
        .agg(*[F.count_distinct(f"c{n}").alias(f"n{n}") for n in range(PICKS)])
        .where(F.least(*[F.col(f"n{n}") for n in range(PICKS)]) >= least_pages)
    )
    totals = (
        picked.where(F.size("keys") > 0)
        .select(F.col("host").alias("_h"), *[key(F.get(f"f{n}", F.lit(0))).alias(f"f{n}") for n in range(PICKS)])
        .groupBy("_h")
        .agg(*[F.count_distinct(f"f{n}").alias(f"pages{n}") for n in range(PICKS)])
    )
    often = [F.col(f"n{n}") > F.lit(ratio) * F.col(f"pages{n}") for n in range(PICKS)]
    return spread.join(totals, F.col("host").eqNullSafe(F.col("_h"))).where(often[0] & often[1]).select("host", "x", "y")


def without_boilerplate(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text_col``, and ``dropped_lines``.

    All other lines, blank ones too, stay as they are and in order. A text of boilerplate only
    becomes empty; a missing text stays missing. Rows and columns are those of the input (a
    column ``dropped_lines`` is replaced); repeated rows stay.

    The boilerplate of a host, at most its mean lines per page divided by ``ratio``, becomes one
    row. It is written and counted: up to ``SMALL_ROWS`` lines are broadcast, so that no
    text is shuffled; beyond, hosts are joined by a shuffle that splits skewed hosts.
    """
    found = written(frequent_lines(docs, text_col, host_col, ratio, least_pages), "lines")
    listed = (
        found.groupBy("host").agg(F.collect_list(F.struct("x", "y")).alias("_bad")).withColumnRenamed("host", "_host")
    )
    if found.count() <= SMALL_ROWS:
        listed = F.broadcast(listed)
    names = [c for c in docs.columns if c != "dropped_lines"]
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("_bad"), _line_key(line)))
    joined = docs.select(*names).join(listed, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    cut = joined.withColumn("_kept", F.when(F.col("_bad").isNotNull(), kept))
    return cut.select(
        *[
            F.when(F.col("_kept").isNull(), F.col(c)).otherwise(F.array_join("_kept", "\n")).alias(c) if c == text_col else F.col(c)
            for c in names
        ],
        F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("dropped_lines"),
    )
