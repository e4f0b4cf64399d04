"""Document quality by a factorisation machine over hashed words and structure statistics.

The score of a feature vector x is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pair
sum is computed in time linear in x as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.llm.common import held_out

#: Word buckets; a power of two.
BUCKETS = 4096
#: Labelled documents that a model is fitted on at most.
TRAIN_ROWS = 6000
RANK = 8
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
LOWER = bytes(range(97, 123))
MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())
N_STATS = 18


def structure(text: str) -> tuple[list[float], Counter]:
    """Statistics of a text's shape, and its counted lower-case words."""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    words = text.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))

    def share(kind: bytes) -> float:
        return 1 - len(raw.translate(None, kind)) / size

    upper, lower = share(UPPER), share(LOWER)
    repeats = sum(map(str.__eq__, words, words[1:]))
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(map(len, counts)) / max(1, len(counts)),
        len(text) / n,
        upper,
        upper / max(1e-9, upper + lower) if upper + lower else 0.0,
        share(DIGIT),
        share(MARKS),
        raw.count(b"!") / n,
        (raw.count(b".") + raw.count(b"?")) / n,
        raw.count(b",") / n,
        len(counts) / n,
        repeats / n,
        top / n,
        1 - len(set(lines)) / n_lines,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / n_lines,
        n / n_lines / 100,
    ], counts


def features(text: str | None, extra: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word part (unit length, by bucket) and statistics of one document; missing text is empty."""
    stats, counts = structure(text or "")
    buckets = [crc32(w.encode("utf-8", "replace")) & (BUCKETS - 1) for w in counts]
    part = np.bincount(buckets, np.log1p(np.fromiter(counts.values(), float, len(counts))), BUCKETS)
    norm = np.sqrt(part @ part)
    values = [*stats, *(0.0 if x is None or not np.isfinite(x) else np.sign(x) * np.log1p(abs(x)) for x in extra)]
    return (part / norm if norm else part).astype(np.float32), np.array(values, np.float32)


@dataclass
class Machine:
    """A fitted model; ``middle`` and ``spread`` standardise the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def join(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.middle) / self.spread, -4, 4) / 2
        return np.hstack([words, scaled]).astype(np.float32)

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x @ self.factors
        pairs = (sums**2).sum(1) - (x**2 @ self.factors**2).sum(1)
        return self.bias + x @ self.linear + pairs / 2, sums

    def score(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(self.join(words, stats))[0].astype(float), -30, 30)))


def fit_arrays(
    words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64
) -> Machine:
    """AdaGrad on the logistic loss; ``words`` holds (buckets, values) per row.

    With labels of one kind, or none, the model has weights of zero and gives every document
    that label's share (0.5 without labels).
    """
    rng = np.random.default_rng(7)
    width = BUCKETS + stats.shape[1]
    middle = stats.mean(0) if len(stats) else np.zeros(stats.shape[1])
    spread = np.where(stats.std(0) > 1e-6, stats.std(0), 1.0) if len(stats) else np.ones(stats.shape[1])
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    machine = Machine(
        float(np.log(share / (1 - share))),
        np.zeros(width, np.float32),
        (rng.standard_normal((width, RANK)) * 0.02).astype(np.float32),
        middle.astype(np.float32),
        spread.astype(np.float32),
    )
    if len(set(labels.tolist())) < 2:
        machine.factors[:] = 0
        return machine
    seen = [np.full(1, 1e-6), np.full(width, 1e-6, np.float32), np.full((width, RANK), 1e-6, np.float32)]
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            dense = np.zeros((len(rows), BUCKETS), np.float32)
            for k, r in enumerate(rows):
                dense[k, words[r][0]] = words[r][1]
            x = machine.join(dense, stats[rows])
            out, sums = machine.raw(x)
            miss = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows]) / len(rows)).astype(np.float32)
            steps = (
                np.array([miss.sum()]),
                x.T @ miss + 1e-6 * machine.linear,
                x.T @ (miss[:, None] * sums) - (x.T**2 @ miss)[:, None] * machine.factors + 1e-5 * machine.factors,
            )
            for total, step in zip(seen, steps):
                total += step**2
            machine.bias -= float(0.1 * steps[0][0] / np.sqrt(seen[0][0]))
            machine.linear -= 0.1 * steps[1] / np.sqrt(seen[1])
            machine.factors -= 0.03 * steps[2] / np.sqrt(seen[2])
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents that are not held out, chosen by a hash of the id.

    Of several labels of one document the lowest counts; missing labels and ids are left out.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers: the bound makes the broadcast safe
    return docs.join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    metadata: Sequence[str] = (),
    train_rows: int = TRAIN_ROWS,
) -> Machine:
    """Fit on a bounded sample of labelled documents.

    ``metadata`` names numeric columns that join the statistics. Whole texts become sparse
    vectors on the executors; the driver receives ``train_rows`` vectors of at most ``BUCKETS``
    entries. Ids may be of any type; documents that share an id all take part, in the order of their
    content.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.array(*[F.col(m).cast("double") for m in metadata]).cast("array<double>").alias("extra"),
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, label, text, extra in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text", "extra"))):
                part, stats = features(text, extra)
                at = np.flatnonzero(part)
                out.append((str(i), label, at.astype(np.int32).tobytes(), part[at].tobytes(), stats.tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), *[pa.binary()] * 3))],
                names=["doc_id", "label", "at", "value", "stats"],
            )

    rows = (
        training_rows(slim, labels, id_col, label_col, train_rows)
        .mapInArrow(vectors, "doc_id string, label double, at binary, value binary, stats binary")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.stats), bytes(r["at"])))
    width = N_STATS + len(metadata)
    return fit_arrays(
        [(np.frombuffer(r["at"], np.int32), np.frombuffer(r.value, np.float32)) for r in rows],
        np.array([np.frombuffer(r.stats, np.float32) for r in rows], np.float32).reshape(len(rows), width),
        np.array([r.label for r in rows]),
    )


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, one pass, no shuffle.

    Missing and empty texts get the score of a text without words; repeated rows stay, and
    equal texts have equal scores. Other columns of the input are not read.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).alias("text"),
        F.array(*[F.col(m).cast("double") for m in metadata]).cast("array<double>").alias("extra"),
    )

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                p = _scored(machine, b.column("text"), b.column("extra"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return slim.mapInArrow(scores, f"doc_id {ids}, held_out boolean, score double, predicted int")


def _scored(machine: Machine, texts: pa.Array, extra: pa.Array) -> np.ndarray:
    rows = [features(t.as_py(), e.as_py() or ()) for t, e in zip(texts, extra)]
    return machine.score(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: Sequence[str] = (), least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is ``least`` or more; one pass, no shuffle."""
    extra = F.array(*[F.col(m).cast("double") for m in metadata]).cast("array<double>")
    names = docs.columns

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                p = _scored(machine, b.column(names.index(text_col)), b.column(len(names)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).filter(pa.array(p >= least)) for k in range(len(names))], names=names
                )

    return docs.select(*docs.columns, extra.alias("_extra")).mapInArrow(chosen, docs.schema)
