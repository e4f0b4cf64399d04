"""Quality classifier and language identification: held-out accuracy, inputs, odd rows."""

import random
from zlib import crc32


import numpy as np
import pytest
from pyspark.sql import functions as F

from examlens.llm import langid_cnn, quality_fm
from examlens.llm import queries as q


def is_held_out(i):
    return i is not None and crc32(str(i).encode()) % 3 == 1


def brute_score(machine, words, stats):
    x = machine.join(words[None], stats[None])[0].astype(float)
    total = machine.bias + x @ machine.linear
    for i in np.flatnonzero(x):
        for j in np.flatnonzero(x):
            if i < j:
                total += machine.factors[i] @ machine.factors[j] * x[i] * x[j]
    return 1 / (1 + np.exp(-total))


def test_linear_time_pairs_equal_the_double_sum():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(
        0.2,
        rng.normal(size=quality_fm.BUCKETS + quality_fm.N_STATS).astype(np.float32),
        (rng.normal(size=(quality_fm.BUCKETS + quality_fm.N_STATS, 4)) * 0.3).astype(np.float32),
        np.zeros(quality_fm.N_STATS, np.float32),
        np.ones(quality_fm.N_STATS, np.float32),
    )
    words, stats = quality_fm.features("a short text, with A FEW words! and words", ())
    got = machine.score(words[None], stats[None])[0]
    assert got == pytest.approx(brute_score(machine, words, stats), rel=1e-4)


def test_quality_on_held_out_labels(spark, small_dir):
    docs = q.table(spark, "/root/testdata/sf0.1", "documents")
    labels = q.table(spark, "/root/testdata/sf0.1", "labels")
    got = q.op1(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(is_held_out)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((both.predicted == both.quality).mean()) > 0.98


def test_quality_ignores_held_out_labels(spark, docs, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    right = [(i, i % 2, 0) for i in ids]
    wrong = [(i, 1 - i % 2 if is_held_out(i) else i % 2, 0) for i in ids]
    a, b = (quality_fm.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (right, wrong))
    assert a.bias == b.bias and (a.factors == b.factors).all()


def test_quality_of_odd_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 0), (9, 1)], "doc_id long, quality int")
    machine = quality_fm.fit(docs, labels)
    got = quality_fm.score(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[300] == by_id[301]  # missing and empty texts
    kept = quality_fm.accepted(docs, machine, least=0.0)
    assert kept.count() == len(rows) and kept.columns == docs.columns
    assert quality_fm.accepted(docs, machine, least=2.0).count() == 0
    empty = quality_fm.fit(no_docs, labels.limit(0))
    assert [r.score for r in quality_fm.score(docs, empty).limit(1).collect()] == [0.5]
    assert quality_fm.score(no_docs, machine).count() == 0


def test_metadata_joins_the_statistics(spark):
    docs = spark.createDataFrame([(i, "same words", float(i % 2) * 50) for i in range(300)], "doc_id long, text string, rank double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    machine = quality_fm.fit(docs, labels, metadata=["rank"])
    got = quality_fm.score(docs, machine, metadata=["rank"]).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_language_on_held_out_documents(spark, small_dir):
    docs = q.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang").toPandas()
    got = q.op5(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    both = got[got.held_out].merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.97


def test_language_of_odd_rows(docs, rows, no_docs):
    net = langid_cnn.fit(docs, train_docs=40)
    assert net.languages == ["de", "en"]
    got = langid_cnn.predict(docs, net).collect()
    assert len(got) == len(rows)
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got)
    untaught = langid_cnn.fit(no_docs)
    assert {r.lang_pred for r in langid_cnn.predict(docs, untaught).collect()} == {"und"}
    assert langid_cnn.predict(no_docs, net).count() == 0


def test_windows_cover_the_text():
    raw = bytes(range(1, 256)) * 3
    rows = langid_cnn.windows(raw)
    assert rows.tobytes().rstrip(b"\0") == raw and langid_cnn.windows(b"").shape == (0, langid_cnn.WINDOW)


def test_training_gradient_lowers_the_loss():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 110, (200, langid_cnn.WINDOW)).astype(np.uint8)
    rows[::2, ::5] = 120
    target = (np.arange(200) + 1) % 2
    net = langid_cnn.fit_windows(rows, target, ["a", "b"])
    assert (net.log_probabilities(rows).argmax(1) == target).mean() > 0.97


def test_ids_of_any_type(spark):
    """Text ids: the same model and scores as with numbers."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "bad", "word"]) for _ in range(12)), i % 2) for i in range(60)]
    numbers = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    texts = numbers.withColumn("doc_id", F.col("doc_id").cast("string"))
    got = [
        {str(r.doc_id): round(r.score, 6) for r in quality_fm.score(docs, quality_fm.fit(docs, docs)).collect()}
        for docs in (numbers, texts)
    ]
    assert set(got[0]) == set(got[1]) and len(got[1]) == 60


def test_convolution_equals_a_loop_over_positions():
    """Embedding, filters of every width, maximum over positions, softmax: one position and one filter at a time."""
    rng = np.random.default_rng(6)
    raws = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 255, 256, 700)]
    rows = np.concatenate([langid_cnn.windows(r) for r in raws])
    assert len(rows) == 1 + 1 + 1 + 3
    net = langid_cnn.fit_windows(rows, np.arange(6) % 3, ["a", "b", "c"], epochs=2)
    got = net.log_probabilities(rows)
    for i, row in enumerate(rows):
        hidden = []
        for k, (width, weights) in enumerate(zip(langid_cnn.WIDTHS, net.filters)):
            for f in range(langid_cnn.FILTERS):
                best = -np.inf
                for at in range(langid_cnn.WINDOW - width + 1):
                    span = [net.table[b, e] for b in row[at : at + width] for e in range(langid_cnn.EMBEDDING)]
                    best = max(best, float(np.dot(np.array(span, float), weights[:, f].astype(float))))
                hidden.append(max(0.0, best + float(net.bias[k * langid_cnn.FILTERS + f])))
        z = np.array(hidden) @ net.out.astype(float) + net.out_bias
        want = z - z.max() - np.log(np.exp(z - z.max()).sum())
        assert np.allclose(got[i], want, atol=1e-4)
