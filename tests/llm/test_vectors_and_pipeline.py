"""Embedding near-duplicates against all pairs; the pipeline's stages; registration."""

import hashlib
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from examlens.llm import pq_dedup, simhash_tiles


def brute_links(rows, least=0.95):
    ok = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 16:
            ok[i] = np.array(v, float)
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    n = {i: 0 for i, _ in rows} | {i: int(k) for i, k in zip(ids, near.sum(1))}
    root = {i: i for i, _ in rows}
    for _ in ids:
        changed = False
        for a, b in zip(*np.nonzero(near)):
            low = min(root[ids[a]], root[ids[b]])
            if root[ids[a]] != low:
                root[ids[a]], changed = low, True
        if not changed:
            break
    return n, root


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((500, 16))
    out = [base]
    for cosine in (0.951, 0.96, 0.99, 0.949):
        noise = rng.standard_normal((40, 16))
        b = base[:40] / np.linalg.norm(base[:40], axis=1)[:, None]
        noise -= (noise * b).sum(1)[:, None] * b
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        out.append((cosine * b + np.sqrt(1 - cosine**2) * noise) * rng.uniform(0.1, 9, (40, 1)))
    out.append(np.repeat(base[100:101], 60, 0))  # copies
    out.append(base[101] + rng.standard_normal((120, 16)) * 0.03)  # a large group of near copies
    x = np.concatenate(out).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(len(x)), x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(5000 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("margin, tile", [(float("inf"), 4096), (float("inf"), 50), (pq_dedup.MARGIN, 4096)])
def test_links_equal_all_pairs(spark, vectors, monkeypatch, margin, tile):
    monkeypatch.setattr(pq_dedup, "TILE", tile)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4).withColumn("n_links", F.lit("clash"))
    got = pq_dedup.links(frame, list_rows=60, margin=margin).collect()
    assert len(got) == len(vectors)
    n, root = brute_links(vectors)
    if margin == float("inf"):
        assert {r.vec_id: r.n_links for r in got} == n
        assert {r.vec_id: r.component_id for r in got} == root
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    else:
        found = sum(r.n_links for r in got)
        assert 0.97 * sum(n.values()) <= found <= sum(n.values())
        assert all(r.n_links <= n[r.vec_id] for r in got)


def test_recall_on_the_given_vectors(spark, small_dir):
    """Planted neighbours at the limit, 64 dimensions."""
    x = np.array([r.embedding for r in spark.read.parquet(f"{small_dir}/../sf0.1/embeddings.parquet").collect()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rng = np.random.default_rng(1)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    y = 0.9502 * x + np.sqrt(1 - 0.9502**2) * noise
    rows = [(2 * i, a.tolist()) for i, a in enumerate(x)] + [(2 * i + 1, b.tolist()) for i, b in enumerate(y)]
    got = pq_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links >= 1 for r in got) >= 0.99 * len(rows)


@pytest.mark.parametrize("directions", [2, 4, 8])
def test_links_of_vectors_spread_over_few_directions(spark, directions):
    """A hot group that varies in few of 64 dimensions, besides scattered vectors: all links are found."""
    rng = np.random.default_rng(directions)
    basis = np.linalg.qr(rng.standard_normal((64, directions)))[0].T
    centre = rng.standard_normal(64) / 8
    hot = centre + 0.45 * rng.standard_normal((1000, directions)) @ basis / np.sqrt(directions)
    x = np.concatenate([hot, rng.standard_normal((1000, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pq_dedup.links(frame, list_rows=20).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want.sum() > 10_000
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq_dedup.links(empty).count() == 0
    odd = spark.createDataFrame([(3, None), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in pq_dedup.links(odd).collect()} == {(3, 0, 3, True), (None, 0, None, True)}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(1, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_odd_rows(spark, folder, rows):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert seen["quality_classifier"].count() == len(rows)  # all labels are good
    cut = seen["line_dedup"].collect()
    assert len(cut) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    assert not any("Home About" in (r.text or "") for r in cut if r.source == "s0" and r.doc_id % 3 == 0 and r.doc_id < 240)
    kept = seen["simhash_near_dedup"].collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and None in ids
    texts = defaultdict(int)
    for r in kept:
        texts[r.text] += 1
    assert max(texts.values()) == 1
    mixed = defaultdict(int)
    for r in seen["source_mix"].collect():
        mixed[r.doc_id] += 1
    assert set(mixed) <= set(ids) and max(mixed.values()) <= 2
    tokens = defaultdict(int)
    for r in seen["byte_bpe"].collect():
        tokens[r.doc_id] += 1
        assert r.n_tokens == len(r.ids)
    by_id = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen["source_mix"].collect()}
    assert all(r.decoded_sha256 == by_id[r.doc_id] for r in seen["byte_bpe"].collect())
    assert tokens == mixed


def test_near_duplicates_have_the_similarity(spark):
    """Edited texts of all lengths, a large group of near copies and repeated passages, against brute-force Jaccard."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]

    def some(n):
        return [words[k] for k in rng.integers(0, len(words), n)]

    texts = []
    for length in (8, 12, 16, 40, 100, 300):
        for _ in range(12):
            base = some(length)
            texts.append(base)
            for edits in (1, 2, 3, 5, 8):
                if edits < length / 4:
                    edited = list(base)
                    for at in rng.choice(length, edits, replace=False):
                        edited[at] = some(1)[0]
                    texts.append(edited)
            texts += [base[: int(length * 0.85)], base + some(max(1, length // 6))]
    hot = some(60)
    texts += [[*hot[:k], *some(1), *hot[k + 1 :]] for k in rng.integers(0, 60, 80)]
    passage = some(12)
    texts += [passage * 8 + some(30) for _ in range(4)] + [[], some(2)]
    rows = [(int(i), " ".join(t), "en", "s", 0) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    sets = {}
    for i, text, *_ in rows:
        parts = text.split()
        sets[i] = {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))}
    root, pairs = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b]
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in range(len(root)):
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert got == {i for i, r in root.items() if i == r} and len(got) < len(rows) - 150
    # groups dealt to many tiles, and fingerprints too
    tiled = simhash_tiles.near_duplicates(
        docs, 5, 0.8, corpus_pipeline.FIRST_RADIUS, corpus_pipeline.PARTS, corpus_pipeline.WHOLE_RADIUS, tile_rows=100, tile_bytes=8000
    )
    assert {r.doc_id: r.component_id for r in tiled.collect()} == root


@pytest.mark.parametrize("first", [None, 700])
def test_a_large_group_of_near_copies(monkeypatch, first):
    """2,000 edited copies of a text, at similarities around the limit, against all pairs."""
    monkeypatch.setattr(simhash_tiles, "SETS", 128)
    monkeypatch.setattr(simhash_tiles, "COLUMNS", 64)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for k in range(2000):
        changed = base[: 40 + k % 21].copy()
        at = rng.choice(len(changed), rng.integers(0, 9), replace=False)
        changed[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
        sets.append(np.unique(changed))
    sets[5] = np.zeros(0, np.uint64)
    known = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    matrix = np.zeros((len(sets), len(known)), np.float32)
    for k, one in enumerate(sets):
        matrix[k, [known[h] for h in one.tolist()]] = 1
    shared = matrix @ matrix.T
    size = matrix.sum(1)
    near = shared >= 0.8 * np.maximum(size[:, None] + size - shared, 1)
    if first:
        near[:first, :first] = near[first:, first:] = False
    label = np.arange(len(sets))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(sets)).min(1))
        if (new == label).all():
            break
        label = new
    linked, root = simhash_tiles.similar_forest(sets, 0.8, first)
    got = np.arange(len(sets))
    got[linked] = root
    assert (got == label).all() and 1 < len(set(label.tolist())) < 1900


def test_empty_tables_pass_through(spark, no_docs, tmp_path):
    path = str(tmp_path)
    no_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_rejected_documents_go(spark, small_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, small_dir).select("doc_id").collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i, y in quality.items() if (i in kept) != (y == 1)]
    assert len(wrong) <= 0.05 * len(quality)


def test_registered():
    queries = entry_module.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert queries["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


def test_nothing_else_imports_this_part():
    from pathlib import Path

    root = Path(entry_module.__file__).parent
    for path in [*root.glob("examlens/**/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "examlens.llm" not in path.read_text(), path
    assert "examlens.llm" in sys.modules
