"""Near-duplicate texts by SimHash, compared exactly in tiles.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set.
Distinct fingerprints are sorted by their population counts and cut into tiles; two
fingerprints within a radius differ in their counts by the radius at most, so most pairs of
tiles need no look. The others are compared by exclusive-or and bit counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.llm.common import written
from examlens.llm.components import components, forest

SEED = 42
#: Fingerprints of a tile at least, and tiles at most (with more, tiles become larger).
TILE_ROWS, MAX_TILES = 16_384, 512
#: Rows of two tiles that are compared at once, small enough for the processor's cache.
BLOCK = 512
#: Edges that a task holds before it reduces them to a forest.
EDGES = 4_000_000
#: Sets compared at once, columns of their 0/1 matrices, and bytes of hashes in a tile of sets.
SETS, COLUMNS, TILE_BYTES = 512, 8192, 1 << 24
#: Fixed multiplier and shifts of a 64-bit mixer, for further words of a fingerprint.
MIX, SHIFTS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, lower-cased in A-Z; repeats included."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str, words: int, parts: int = 1) -> bytes:
    """``parts`` 64-bit words, most significant byte first; zeros for a text without words.

    Words after the first come from the same shingle hashes, mixed anew.
    """
    return _bits(shingle_hashes(text, words), parts)


def _bits(hashes: np.ndarray, parts: int) -> bytes:
    out = []
    for part in range(parts):
        h = hashes
        if part:
            h = h + np.uint64(GOLDEN * part & (2**64 - 1))
            for shift, factor in zip(SHIFTS, MIX):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h = h ^ (h >> np.uint64(SHIFTS[2]))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):  # bits of at most so many hashes at once
            ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
        out.append(np.packbits(ones * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, parts: int = 1) -> DataFrame:
    """``doc_id, fingerprint`` (binary) per document; no shuffle. A missing text is empty."""
    ids = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py(), words, parts) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"])

    return slim.mapInArrow(hashed, f"doc_id {ids}, fingerprint binary")


def _blocks(
    left: np.ndarray, right: np.ndarray, radius: int, whole_radius: int, same: bool, parts: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two sorted tiles within the radius, a pair of blocks at a time.

    The first ``parts`` columns are the words of the fingerprints. Blocks of rows whose population
    counts (of both halves of the first word) leave more than the radius between them are skipped.
    The first word decides which pairs are compared whole.
    """
    halves = [np.bitwise_count(t[:, :1] >> np.array([32, 0], np.uint64) & np.uint64(2**32 - 1)).astype(int) for t in (left, right)]
    cut = [[slice(i, i + BLOCK) for i in range(0, len(t), BLOCK)] for t in (left, right)]
    low, high = ([np.array([f(h[s], axis=0) for s in c]) for h, c in zip(halves, cut)] for f in (np.min, np.max))
    for i, s in enumerate(cut[0]):
        gap = np.maximum(0, np.maximum(low[1] - high[0][i], low[0][i] - high[1])).sum(1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            t = cut[1][j]
            x, y = np.nonzero(np.bitwise_count(left[s, 0][:, None] ^ right[t, 0]) <= radius)
            x, y = x + s.start, y + t.start
            if same:
                x, y = x[x < y], y[x < y]
            if parts > 1:
                total = np.bitwise_count(left[x, 0] ^ right[y, 0]).astype(int)
                for k in range(1, parts):
                    total += np.bitwise_count(left[x, k] ^ right[y, k])
                x, y = x[total <= whole_radius], y[total <= whole_radius]
            if len(x):
                yield x, y


def _joined(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins the rows that the found pairs join; holds ``EDGES`` pairs and a block's at most."""
    kept, wait, waiting = (np.zeros(0, int), np.zeros(0, int)), [], 0
    for x, y in found:
        wait.append((x, y))
        waiting += len(x)
        if waiting > EDGES:
            kept, wait, waiting = forest(n, *map(np.concatenate, zip(kept, *wait))), [], 0
    return forest(n, *map(np.concatenate, zip(kept, *wait)))


def _words(raw: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, parts)


def near_links(
    prints: DataFrame,
    radius: int,
    parts: int = 1,
    whole_radius: int = 0,
    tile_rows: int = TILE_ROWS,
    extra: int = 0,
) -> DataFrame:
    """``left, right`` fingerprints: a forest that joins all fingerprints within the radius.

    Fingerprints may be followed by ``extra`` 64-bit words that do not count as distance.

    ``prints`` holds distinct fingerprints. Their population counts, at most 33 * 33 numbers,
    go to the driver, which cuts the sorted order into tiles of about equal size (a count that
    alone exceeds a tile is split by hash) and lists the tile pairs to compare: at most
    ``MAX_TILES`` tiles, so both lists are bounded. Each tile becomes one binary row, each pair
    of tiles one task's worth of comparisons; all pairs within the radius are found, and a
    pair of tiles returns a forest of them, never the pairs.
    """
    spark = prints.sparkSession
    counts = [
        F.bit_count(F.conv(F.hex(F.substring("fingerprint", at, 4)), 16, 10).cast("long")).cast("int").alias(name)
        for at, name in ((1, "h"), (5, "l"))
    ]
    counted = written(prints.select("fingerprint", *counts), "prints")
    groups = sorted(counted.groupBy("h", "l").count().collect(), key=lambda r: (r.h + r.l, r.h))
    total = sum(r["count"] for r in groups)
    size = max(tile_rows, -(-total // MAX_TILES))
    # tiles: of each group of equal counts, its first tile and how many it is spread over
    tiles: list[list] = []  # rows, lowest and highest population count
    places = []
    for r in groups:
        pop, n = r.h + r.l, r["count"]
        if n > size:
            spread = -(-n // size)
            places.append((r.h, r.l, len(tiles), spread))
            tiles += [[n / spread, pop, pop] for _ in range(spread)]
        else:
            if not tiles or tiles[-1][0] + n > size:
                tiles.append([0, pop, pop])
            tiles[-1][0] += n
            tiles[-1][2] = pop
            places.append((r.h, r.l, len(tiles) - 1, 1))
    pairs = [
        (a, b) for a in range(len(tiles)) for b in range(a, len(tiles)) if tiles[b][1] - tiles[a][2] <= radius
    ]
    where = spark.createDataFrame(places or [(0, 0, 0, 1)], "h int, l int, tile int, spread int")

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        rows = _words(b"".join(table.column("fingerprint").to_pylist()), parts + extra)
        high, low = table.column("h").to_numpy(), table.column("l").to_numpy()
        order = np.lexsort((high, high + low))
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([rows[order].astype(">u8").tobytes()], pa.binary())})

    packs = written(
        counted.join(F.broadcast(where), ["h", "l"])
        .withColumn("tile", F.col("tile") + F.pmod(F.xxhash64("fingerprint"), F.col("spread")).cast("int"))
        .select("tile", "fingerprint", "h", "l")
        .groupBy("tile")
        .applyInArrow(packed, "tile int, rows binary"),
        "tiles",
    )
    listed = spark.createDataFrame(pairs or [(0, 0)], "a int, b int")
    jobs = (
        listed.join(packs.select(F.col("tile").alias("a"), F.col("rows").alias("left_rows")), "a")
        .join(packs.select(F.col("tile").alias("b"), F.col("rows").alias("right_rows")), "b")
        # a task holds a few pairs at a time, however many there are
        .repartition(max(1, min(len(pairs), max(4 * spark.sparkContext.defaultParallelism, len(pairs) // 8))))
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, x, y = (batch.column(c)[k].as_py() for c in ("a", "b", "left_rows", "right_rows"))
                left, right = _words(x, parts + extra), _words(y, parts + extra)
                raw = (left if a == b else np.concatenate([left, right])).astype(">u8")
                shift = 0 if a == b else len(left)
                pairs = ((i, j + shift) for i, j in _blocks(left, right, radius, whole_radius, a == b, parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[r].tobytes() for r in side], pa.binary()) for side in _joined(len(raw), pairs)],
                    names=["left", "right"],
                )

    return jobs.mapInArrow(compared, "left binary, right binary")


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
    parts: int = 1,
    whole_radius: int = 0,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint`` (lowercase hexadecimal) ``, component_id`` for every document.

    Fingerprints are linked if their first 64 bits differ in ``radius`` bits at most and, with
    several ``parts``, all their bits in ``whole_radius`` at most; ``component_id`` is the
    smallest id reachable, the document's own included. Empty and missing texts have the
    fingerprint zero, linked like any other. Equal fingerprints are one node, however many
    documents have them; rows without an id share their class's smallest id. Repeated rows stay.
    """
    prints = written(fingerprints(docs, id_col, text_col, words, parts), "fingerprints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    classes = written(classes, "classes")
    edges = near_links(classes.select("fingerprint"), radius, parts, whole_radius, tile_rows)
    known = classes.where(F.col("least").isNotNull())
    named = (
        edges.join(known.select(F.col("fingerprint").alias("left"), F.col("least").alias("a")), "left")
        .join(known.select(F.col("fingerprint").alias("right"), F.col("least").alias("b")), "right")
        .select("a", "b")
    )
    roots = components(named, "a", "b").withColumnRenamed("node", "least")
    graded = classes.join(roots, "least", "left").select("fingerprint", F.coalesce("root", "least").alias("component_id"))
    return prints.join(graded, "fingerprint").select(
        "doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


def _sets(docs: DataFrame, words: int, parts: int, whole: bool) -> DataFrame:
    """``doc_id, fingerprint`` and, if ``whole``, ``shingles``: the sorted distinct hashes as bytes.

    Here the fingerprint comes from distinct shingles and ends with 128 bits that stand for their
    set, so that texts have equal ones only if they have the same shingles.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
                prints = [_bits(h, parts) + xxhash.xxh128_digest(h.tobytes()) for h in sets]
                columns = [b.column("doc_id"), pa.array(prints, pa.binary())]
                if whole:
                    columns.append(pa.array([h.tobytes() for h in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "shingles"][: len(columns)])

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(hashed, f"doc_id {ids}, fingerprint binary" + ", shingles binary" * whole)


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two sets share: products of 0/1 matrices, some columns at a time."""
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    known, at = np.unique(np.concatenate(flat), return_inverse=True)
    places = [at[: len(flat[0])], at[len(flat[0]) :]]
    both = np.bincount(places[0], minlength=len(known)).astype(bool) & np.bincount(places[1], minlength=len(known)).astype(bool)
    column = np.cumsum(both) - 1
    total = np.zeros((len(left), len(right)), np.float64)
    sorted_sides = []
    for r, c in zip(rows, places):
        r, c = r[both[c]], column[c[both[c]]]
        order = np.argsort(c, kind="stable")
        sorted_sides.append((r[order], c[order]))
    for low in range(0, int(both.sum()), COLUMNS):
        dense = []
        for (r, c), side in zip(sorted_sides, (left, right)):
            a, b = np.searchsorted(c, [low, low + COLUMNS])
            matrix = np.zeros((len(side), COLUMNS), np.float32)
            matrix[r[a:b], c[a:b] - low] = 1
            dense.append(matrix)
        total += dense[0] @ dense[1].T  # whole numbers up to COLUMNS are exact
    return total


def similar_forest(sets: list[np.ndarray], least: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins the sets whose Jaccard similarity is ``least`` at least.

    With ``first``, only pairs of one of the first so many sets and one of the others count. Every
    pair is compared unless its sizes rule it out or links that were found join it already: before
    all others, sets are compared with the first of their block, which joins most of a group of
    near copies.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], float)
    sides = (np.arange(n), np.arange(n)) if first is None else (np.arange(first), np.arange(first, n))
    cut = [[side[np.argsort(size[side], kind="stable")][i : i + SETS] for i in range(0, len(side), SETS)] for side in sides]
    label = np.arange(n)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        if min(size[x].max(), size[y].max()) < least * max(size[x].min(), size[y].min()):
            return
        if label[x].min() == label[x].max() == label[y].min() == label[y].max():
            return
        shared = _shared_counts([sets[k] for k in x], [sets[k] for k in y])
        whole = size[x][:, None] + size[y] - shared
        i, j = np.nonzero(shared >= least * np.maximum(whole, 1))
        linked, root = forest(n, np.append(x[i], np.arange(n)), np.append(y[j], label))
        label = np.arange(n)
        label[linked] = root

    for a in cut[0]:
        for b in cut[1]:
            compare(a[:1], b)
    for a in cut[0]:
        for b in cut[1]:
            if first is not None or a[0] <= b[0] or size[a[0]] != size[b[0]]:
                compare(a, b)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _similar(groups: DataFrame, docs: DataFrame, words: int, parts: int, least: float, tile_bytes: int) -> DataFrame:
    """``a, b``: a forest of links between texts of one candidate group that have the similarity.

    ``groups`` has ``least`` (the id whose text stands for a class of equal sets) and ``root`` of
    every class that has a candidate. Texts are read again, one for each class. Groups share tiles
    of about ``tile_bytes`` of hashes; a larger group is dealt to several tiles, which are compared
    pair by pair. A task holds two tiles, and returns no more links than it has sets.
    """
    ids = groups.schema["least"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(groups.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
    # rows that repeat an id may differ in text: the one whose set is the class's is among them
    sets = _sets(texts, words, parts, True).join(groups.withColumnRenamed("fingerprint", "_f"), F.col("doc_id") == F.col("least"))
    sets = sets.where(F.col("fingerprint") == F.col("_f")).dropDuplicates(["fingerprint"]).select("root", "least", "shingles")
    sets = written(sets, "shingles")
    sizes = sets.groupBy("root").agg(F.sum(F.octet_length("shingles") + 64).alias("bytes"))
    sizes = written(sizes.withColumn("tiles", F.ceil(F.col("bytes") / tile_bytes).cast("int")), "groups")
    small = sizes.where("tiles = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, -(-small // tile_bytes))
    own = F.pmod(F.xxhash64("least"), F.col("tiles")).cast("int")
    placed = sets.join(sizes.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(
        "root", "least", "shingles", "tiles", own.alias("own"), F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).alias("bin")
    )
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        F.when(F.col("bin").isNull(), F.col("root")).alias("hot"),
        F.col("bin"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "root",
        "least",
        "shingles",
        "own",
    )

    def checked(key: tuple, table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
        names = table.column("least")
        # rows of the first tile come first; of a shared tile, rows of one group together
        root = pa.compute.dictionary_encode(table.column("root").combine_chunks()).indices.to_numpy()
        order = np.lexsort((table.column("own").to_numpy(), root))
        ends = np.append(np.flatnonzero(np.diff(root[order])) + 1, len(order))
        links, begin = [], 0
        across = key[2].as_py() != key[3].as_py()
        for end in ends.tolist():
            rows = order[begin:end]
            begin = end
            if len(rows) < 2:
                continue
            first = int((table.column("own").to_numpy()[rows] == key[2].as_py()).sum()) if across else None
            a, b = similar_forest([sets[k] for k in rows], least, first)
            links.append((rows[a], rows[b]))
        sides = [np.concatenate([np.zeros(0, int), *side]) for side in (zip(*links) if links else ([], []))]
        return pa.table({"a": names.take(pa.array(sides[0])), "b": names.take(pa.array(sides[1]))})

    return dealt.groupBy("hot", "bin", "i", "j").applyInArrow(checked, f"a {ids}, b {ids}")


def near_duplicates(
    docs: DataFrame,
    words: int,
    least: float,
    radius: int,
    parts: int,
    whole_radius: int,
    tile_rows: int = TILE_ROWS,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """``doc_id, component_id``: texts linked by the similarity of their sets of shingles.

    Fingerprints only find the candidates, as in ``groups``: they are joined to candidate groups.
    A link is a pair of texts of one group whose Jaccard similarity, counted over 64-bit hashes of
    the shingles, is ``least`` at least; all pairs of a group are looked at, in the tasks that hold
    their sets. No pair leaves a task, only forests do. Texts with the same set are one node.
    Missing texts are empty, and alike. Rows without an id must not be among ``docs``.
    """
    prints = written(_sets(docs, words, parts, False), "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    named = classes.select("fingerprint", "least")
    found = near_links(named.select("fingerprint"), radius, parts, whole_radius, tile_rows, 2)
    candidates = (
        found.join(named.select(F.col("fingerprint").alias("left"), F.col("least").alias("a")), "left")
        .join(named.select(F.col("fingerprint").alias("right"), F.col("least").alias("b")), "right")
        .select("a", "b")
    )
    roots = written(components(candidates, "a", "b"), "candidates")
    members = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "least")
    links = _similar(members.join(named, "least"), docs, words, parts, least, tile_bytes)
    roots = components(links, "a", "b").withColumnRenamed("node", "least")
    graded = classes.join(roots, "least", "left").select("fingerprint", F.coalesce("root", "least").alias("component_id"))
    return prints.join(graded, "fingerprint").select("doc_id", "component_id")
