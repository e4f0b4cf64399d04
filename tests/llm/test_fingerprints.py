"""MinHash and SimHash against brute force."""

import hashlib
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from examlens.llm import minhash_bins, simhash_tiles
from examlens.llm import queries as q
from examlens.llm.components import components


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_longs(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def hash_ints(*values, seed=42):
    """Spark hashes a 32-bit integer as four bytes."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v), seed)
    return signed(seed)


def brute_minhash(text, words=5, bins=256, bits=8):
    # splitting no text gives one empty word
    parts = (text or "").encode().split() or [b""]
    h = [signed(xxhash.xxh64_intdigest(p, 42)) for p in parts]
    n = len(h)
    shingles = [hash_longs(*h[i : i + words]) for i in range(n - words + 1)] if n >= words else [hash_longs(*h)]
    low = {}
    for s in shingles:
        b = (s >> (64 - bins.bit_length() + 1)) + bins // 2
        low[b] = min(s, low.get(b, s))
    out = []
    for j in range(bins):
        if j in low:
            out.append(low[j])
            continue
        for t in range(minhash_bins.STEPS):
            b = hash_ints(j, t) % bins
            if b in low:
                out.append(low[b])
                break
        else:
            out.append(low[min(low, key=lambda b: hash_ints(j, -1, b))])
    return "".join(f"{x & (1 << bits) - 1:0{bits // 4}x}" for x in out)


def words_of(text):
    """Words by ASCII white space only."""
    return (text or "").encode().split()


def test_minhash_equals_brute_force(docs, rows):
    got = minhash_bins.fingerprints(docs.drop("fingerprint")).select("text", "fingerprint").collect()
    assert len(got) == len(rows)
    for text, fingerprint in got:
        assert fingerprint == brute_minhash(text), text


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_likeness_is_close_to_jaccard(spark, bits):
    rng = np.random.default_rng(3)
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        base = [f"a{x}" for x in rng.integers(0, 10**9, 1500)]
        cut = int(len(base) * share)
        other = base[:cut] + [f"b{x}" for x in rng.integers(0, 10**9, len(base) - cut)]
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        pairs.append((" ".join(base), " ".join(other), len(a & b) / len(a | b)))
    frame = spark.createDataFrame(pairs, "a string, b string, j double")
    bins = 1024
    made = frame.select(*[minhash_bins.fingerprint(F.col(c), bins=bins, bits=bits).alias(c) for c in "ab"], "j")
    for r in made.select("a", "b", "j", minhash_bins.likeness(F.col("a"), F.col("b"), bins, bits).alias("got")).collect():
        assert len(r.a) == bins * bits // 4
        assert abs(r.got - r.j) < 0.06 + 0.1 * (bits == 1)


def test_op2_follows_the_contract(spark, rows, tmp_path):
    given = [r for r in rows if r[0] is not None and r[0] != 321]
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {r.doc_id: r for r in q.op2(spark, str(tmp_path)).collect()}
    down = sorted(given, reverse=True)
    assert len(got) == len(given)
    for k, r in enumerate(down):
        text, after = r[1] or "", down[(k + 1) % len(down)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = got[r[0]]
        assert x.n_chars == len(text)
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [brute_minhash(t) for t in (text, edited, after)]
        assert (x.fingerprint, x.edited_fingerprint) == tuple(prints[:2])
        for likeness, other in ((x.near_edited, prints[1]), (x.near_next, prints[2])):
            same = sum(prints[0][i : i + 2] == other[i : i + 2] for i in range(0, 512, 2)) / 256
            assert likeness == pytest.approx(max(0.0, (same - 1 / 256) / (255 / 256)), abs=1e-12)


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_next_row_over_blocks(spark, blocks):
    """Dense, sparse and hashed keys, one key with many rows, a missing key."""
    rng = random.Random(blocks)
    keys = [0, 1, 5, 6, 7, 40, 41, 1000, 1001, 5000, -3, -2000, None, 2**63 - 1, -(2**63), *[rng.getrandbits(63) for _ in range(200)]]
    rows = [(k, f"t{i}") for i, k in enumerate(keys)] + [(7, "again"), (7, "again")] + [(11, f"hot {i}") for i in range(150)]
    got = minhash_bins.with_next(spark.createDataFrame(rows, "k long, t string").repartition(4), "k", blocks=blocks).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((a, order[(i + 1) % len(order)]) for i, a in enumerate(order) if a[0] is not None)
    assert sorted(((r.k, r.t), tuple(r.next)) for r in got if r.k is not None) == want
    assert len(got) == len(rows)
    one = minhash_bins.with_next(spark.createDataFrame([(3, "x")], "k long, t string"), "k").collect()
    assert tuple(one[0].next) == (3, "x")
    assert minhash_bins.with_next(spark.createDataFrame([], "k long, t string"), "k").count() == 0


def test_blocks_of_sparse_keys_are_even(spark):
    """No task sorts more than a few blocks' share of hashed ids, of one id's many rows, or of rows without id."""
    rng = random.Random(1)
    rows = [(rng.getrandbits(63), f"t{i}") for i in range(3000)] + [(5, f"u{i}") for i in range(3000)] + [(None, f"v{i}") for i in range(3000)]
    frame = minhash_bins.with_next(spark.createDataFrame(rows, "k long, t string"), "k", blocks=32)
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000
    assert max(sizes) < 9000 * 0.6


def brute_simhash(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_groups(prints, near):
    """Component of each id by comparing all pairs of distinct fingerprints."""
    ids = defaultdict(list)
    for i, p in prints:
        ids[p].append(i)
    keys = list(ids)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if near(keys[a], keys[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: float("inf"))
    for k, key in enumerate(keys):
        known = [i for i in ids[key] if i is not None]
        if known:
            least[find(k)] = min(least[find(k)], *known)
    return {p: least[find(k)] for k, p in enumerate(keys)}


@pytest.mark.parametrize("tile_rows", [16_384, 20])
def test_simhash_groups_equal_brute_force(docs, rows, tile_rows):
    got = simhash_tiles.groups(docs, tile_rows=tile_rows).collect()
    assert len(got) == len(rows)
    prints = [(r[0], brute_simhash(r[1], 3)) for r in rows]
    want = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{p:016x}") for i, p in prints)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[int(r.fingerprint, 16)]


def test_tiles_find_all_pairs_at_any_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = {int(x) for x in base}
    for x in base:
        for k in (1, 2, 3, 4, 9):
            y = int(x)
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            values.add(y)
    frame = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fingerprint binary")
    for radius in (0, 3, 9):
        edges = simhash_tiles.near_links(frame, radius, tile_rows=50)
        named = edges.select(*[F.conv(F.hex(c), 16, 10).cast("decimal(20,0)").alias(c) for c in ("left", "right")])
        got = {int(r.node): int(r.root) for r in components(named, "left", "right").collect()} if radius else {}
        want = brute_groups([(v, v) for v in values], lambda a, b: (a ^ b).bit_count() <= radius)
        assert all(got.get(v, v) == want[v] for v in values)


def test_wide_fingerprints(docs):
    one, four = (simhash_tiles.fingerprint("some words that make a few shingles here", 3, n) for n in (1, 4))
    assert len(four) == 32 and four[:8] == one and len({four[k : k + 8] for k in range(0, 32, 8)}) == 4
    got = simhash_tiles.groups(docs, words=5, radius=16, parts=4, whole_radius=48).collect()
    near = {r.doc_id: r.component_id for r in got}
    assert near[5] == 2  # an exact copy


def test_no_documents(no_docs):
    assert simhash_tiles.groups(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400), (400, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 500: 400}
