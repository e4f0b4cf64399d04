"""Language of a text by a small byte convolutional network, trained and run in numpy.

A window of bytes is embedded, convolved with filters of several widths, max-pooled over its
positions and mapped to languages by a softmax layer. Texts are cut into windows that cover
them whole; a text's scores are the mean of its windows' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlens.llm.common import held_out

WINDOW, EMBEDDING, FILTERS = 256, 6, 16
WIDTHS = (2, 3, 4)
#: Training documents of each language, and languages, at most; windows taken of a document.
TRAIN_DOCS, LANGUAGES, TRAIN_WINDOWS = 600, 200, 3
#: The prediction for texts without a letter.
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, one per row; zeros fill up the last. Empty bytes have none."""
    padded = np.frombuffer(raw + bytes(-len(raw) % WINDOW), np.uint8)
    return padded.reshape(-1, WINDOW)


@dataclass
class Network:
    languages: list[str]
    table: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width * EMBEDDING x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded windows, pooled activations and the positions they come from."""
        x = self.table[rows]
        best, where = [], []
        for width, weights in zip(WIDTHS, self.filters):
            n = WINDOW - width + 1
            spans = np.concatenate([x[:, k : k + n] for k in range(width)], axis=2)
            maps = (spans.reshape(-1, width * EMBEDDING) @ weights).reshape(len(rows), n, FILTERS)
            at = maps.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(maps, at[:, None], 1)[:, 0])
        return x, np.hstack(best) + self.bias, np.hstack(where)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        best = []
        x = self.table[rows]
        for width, weights in zip(WIDTHS, self.filters):
            n = WINDOW - width + 1
            spans = np.concatenate([x[:, k : k + n] for k in range(width)], axis=2)
            maps = (spans.reshape(-1, width * EMBEDDING) @ weights).reshape(len(rows), n, FILTERS)
            best.append(maps.max(1))
        return log_softmax(np.maximum(np.hstack(best) + self.bias, 0) @ self.out + self.out_bias)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit_windows(rows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 48) -> Network:
    """Adam on the cross-entropy, its rate falling to zero; max-pooling sends a gradient to one
    span per filter only."""
    rng = np.random.default_rng(3)
    n_out, total = max(1, len(languages)), FILTERS * len(WIDTHS)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        languages,
        normal(256, EMBEDDING, scale=0.5),
        [normal(w * EMBEDDING, FILTERS, scale=0.3) for w in WIDTHS],
        np.zeros(total, np.float32),
        normal(total, n_out, scale=0.1),
        np.zeros(n_out, np.float32),
    )
    parameters = [net.table, *net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step, last = 0, epochs * -(-len(target) // batch)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x, best, where = net.pooled(rows[chosen])
            hidden = np.maximum(best, 0)
            error = np.exp(log_softmax(hidden @ net.out + net.out_bias))
            error[np.arange(len(chosen)), target[chosen]] -= 1
            error /= len(chosen)
            back = (error @ net.out.T) * (best > 0)
            table, filters = np.zeros_like(net.table), []
            for k, (width, weights) in enumerate(zip(WIDTHS, net.filters)):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                places = where[:, part, None] + np.arange(width)
                sample = np.arange(len(chosen))[:, None, None]
                spans = x[sample, places].reshape(len(chosen), FILTERS, -1)
                filters.append(np.einsum("bf,bfd->df", back[:, part], spans))
                down = (back[:, part, None] * weights.T).reshape(len(chosen), FILTERS, width, EMBEDDING)
                np.add.at(table, rows[chosen][sample, places], down)
            gradients = [table, *filters, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            rate = 0.01 * (1 - (step - 1) / last)
            for p, g, m, v in zip(parameters, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS
) -> Network:
    """Fit on at most ``train_docs`` documents of each language that are not held out.

    They are chosen by a hash of the id; the rank limit is applied before the shuffle, so that a
    frequent language does not meet in one task. At most ``LANGUAGES`` languages, the most
    frequent ones, are learned. Of each document some windows, spread over it, go to the driver:
    train_docs * LANGUAGES * TRAIN_WINDOWS * 256 bytes bound them. Documents without an id, a
    language or a letter teach nothing.
    """
    usable = docs.where(
        F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))
    ).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    frequent = usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).select("lang")
    line = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", "lang")
        .join(F.broadcast(frequent), "lang")
        .withColumn("_rank", F.row_number().over(line))
        .where(F.col("_rank") <= train_docs)
        .select("doc_id")
        .distinct()
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text")):
                if LETTER.search(text := text.as_py() or ""):
                    rows = windows(text.encode("utf-8", "replace"))
                    places = np.unique(np.linspace(0, len(rows) - 1, TRAIN_WINDOWS).astype(int))
                    out += [(i, lang, rows[p].tobytes()) for p in places]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "raw"]
            )

    # at most train_docs * LANGUAGES ids: the bound makes the broadcast safe
    found = usable.join(F.broadcast(chosen), "doc_id").mapInArrow(cut, "doc_id long, lang string, raw binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.raw)))
    languages = sorted({r.lang for r in found})
    rows = np.frombuffer(b"".join(bytes(r.raw) for r in found), np.uint8).reshape(-1, WINDOW)
    return fit_windows(rows, np.array([languages.index(r.lang) for r in found], int), languages)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document, one pass, no shuffle.

    Missing texts, texts without a letter, and all texts of a network without languages get
    ``und`` with score 0. Equal texts get equal predictions, repeated rows stay; windows are
    batched across texts, and a very long text passes through in several batches.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                sums, sizes = np.zeros((b.num_rows, max(1, len(net.languages)))), np.zeros(b.num_rows)
                raw, owners = [], []
                for k, text in enumerate(b.column("text")):
                    text = text.as_py()
                    if text and net.languages and LETTER.search(text):
                        rows = windows(text.encode("utf-8", "replace"))
                        raw.append(rows)
                        owners.append(np.full(len(rows), k))
                        sizes[k] = len(rows)
                if raw:
                    rows, owner = np.concatenate(raw), np.concatenate(owners)
                    for i in range(0, len(rows), 128):
                        np.add.at(sums, owner[i : i + 128], np.exp(net.log_probabilities(rows[i : i + 128])))
                mean = np.clip(sums / np.maximum(sizes, 1)[:, None], 0, 1)
                best = mean.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        b.column("held_out"),
                        pa.array([net.languages[i] if n else UNKNOWN for i, n in zip(best, sizes)], pa.string()),
                        pa.array(np.where(sizes > 0, mean.max(1), 0.0)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return slim.mapInArrow(predicted, f"doc_id {ids}, held_out boolean, lang_pred string, score double")
