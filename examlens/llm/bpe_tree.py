"""Byte-level BPE as a tree reduction.

A text is encoded by halves. What two halves say about their common boundary may be wrong, so
neighbours are joined by encoding a window around the boundary anew. The window grows until
what lies outside provably stays:

- Pieces (matches of the split pattern) depend on the text from their start on. Left of the
  boundary, a piece is final once the pattern saw its end before the half ended; only the last
  piece, and pieces starting in the last three characters (contractions), are open. Right of
  it, once the window has a piece boundary where the right half has one, all later pieces are
  those of the right half.
- Inside a long piece, a sequence of tokens is the encoding of its bytes exactly if every two
  neighbours are the encoding of theirs. Tokens outside the window are neighbours already; only
  the two pairs at the window's edges need a check, and the window grows where one fails.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text, and bytes of a piece, that are encoded without halving.
LEAF_CHARS, LEAF_BYTES = 2048, 48
#: Entries of each cache of a worker; a full cache is emptied.
CACHE = 400_000
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a file of base64 words and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes with one vocabulary; bounded caches of pieces and pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[bytes, list[bytes]] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens of a run of bytes: the leftmost pair of lowest rank is merged until none has one."""
        if len(piece) > 8 * LEAF_BYTES:
            return self._merged_by_queue(piece)
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(joined + parts[at + 1], NONE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + joined, NONE)
        return parts

    def _merged_by_queue(self, piece: bytes) -> list[bytes]:
        """The same for long runs: a queue of pairs by rank and place, and links between parts."""
        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the first byte of a part
        rank = self.ranks.get

        def pair(at: int) -> tuple[int, int, int] | None:
            middle = ends[at]
            if middle < n and (r := rank(piece[at : ends[middle]])) is not None:
                return r, at, ends[middle]
            return None

        queue = [x for i in range(n) if (x := pair(i))]
        heapq.heapify(queue)
        while queue:
            _, at, end = heapq.heappop(queue)
            middle = ends[at] if at >= 0 and ends[at] > 0 else n
            if middle >= n or ends[middle] != end:
                continue  # one of its parts was merged meanwhile
            ends[at], ends[middle] = end, -1
            if end < n:
                before[end] = at
            for start in (at, before[at]):
                if start >= 0 and (x := pair(start)):
                    heapq.heappush(queue, x)
        out, at = [], 0
        while at < n:
            out.append(piece[at : ends[at]])
            at = ends[at]
        return out

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        both = left + right
        found = self.pairs.get(both)
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[both] = self.merged(both)
        return found == [left, right]

    def _join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        a = b = 1
        while True:
            window = self.merged(b"".join(left[-a:]) + b"".join(right[:b]))
            fits_left = a >= len(left) or self._stays(left[-a - 1], window[0])
            fits_right = b >= len(right) or self._stays(window[-1], right[b])
            if fits_left and fits_right:
                return left[: max(0, len(left) - a)] + window + right[b:]
            a, b = (a if fits_left else 2 * a), (b if fits_right else 2 * b)

    def _tokens(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        return self._join_tokens(self._tokens(piece[:half]), self._tokens(piece[half:]))

    def ids_of(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers."""
        found = self.pieces.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            tokens = [rank] if rank is not None else [self.ranks[t] for t in self._tokens(raw)]
            found = np.array(tokens, "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _open_from(self, pieces: list[str]) -> int:
        """Number of leading pieces that stay whatever text follows."""
        at, tail = len(pieces), 0
        while at and (at == len(pieces) or tail + len(pieces[at - 1]) < 3):
            at -= 1
            tail += len(pieces[at])
        return at

    def _join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]):
        keep = self._open_from(left[0])
        rest, n = "".join(left[0][keep:]), 1
        while True:
            known, at = {}, len(rest)  # where the right half has boundaries
            for k, piece in enumerate(right[0][:n]):
                known[at] = k
                at += len(piece)
            window = self.split(rest + "".join(right[0][:n]))
            if n >= len(right[0]):
                used, resume = len(window), len(right[0])
                break
            known[at] = n
            end, used = 0, 0
            for used, piece in enumerate(window[: self._open_from(window)], 1):
                end += len(piece)
                if end in known:
                    break
            if end in known:
                resume = known[end]
                break
            n *= 2
        middle = window[:used]
        return (
            left[0][:keep] + middle + right[0][resume:],
            left[1][:keep] + [self.ids_of(p) for p in middle] + right[1][resume:],
        )

    def _encode(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= LEAF_CHARS:
            pieces = self.split(text)
            cached = self.pieces.get
            return pieces, [cached(p) or self.ids_of(p) for p in pieces]
        half = len(text) // 2
        return self._join(self._encode(text[:half]), self._encode(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(self._encode(text)[1])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, halves concatenated."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.words.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decoded: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids`` per document (ids as an array of integers); no shuffle.

    With ``digests`` the ids are decoded again, and the columns ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit numbers) and ``decoded_sha256`` replace ``ids``; with ``decoded``
    the ids stay and ``decoded_sha256``, of the bytes they decode to, stands beside them. A missing
    text is empty and has no tokens. Rows are independent: repeated rows stay, other columns are
    not read. The vocabulary, some 50,000 entries, is broadcast; batches are cut by their bytes.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                blobs = [coder.encode(t.as_py()) for t in b.column("text")]
                counts = pa.array([len(x) // 4 for x in blobs], pa.int64())
                if digests:
                    more, names = [pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string())], ["ids_sha256"]
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in blobs)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
                    more, names = [pa.ListArray.from_arrays(ends, values)], ["ids"]
                if digests or decoded:
                    back = [hashlib.sha256(coder.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in blobs]
                    more, names = [*more, pa.array(back, pa.string())], [*names, "decoded_sha256"]
                names = ["doc_id", "n_tokens", *names]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, *more], names=names)

    kinds = ("ids_sha256 string" if digests else "ids array<int>") + ", decoded_sha256 string" * (digests or decoded)
    return slim.mapInArrow(coded, f"doc_id {ids}, n_tokens long, {kinds}")
