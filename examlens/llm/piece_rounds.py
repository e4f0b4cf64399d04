"""SentencePiece BPE by vectorised merge rounds.

The library merges, one at a time, the pair of symbols whose joined piece scores best, the
leftmost of equals. Here all words of a batch lie in one flat array. Each round finds every
word's best rank and merges all its occurrences, from the left, in all words at once. What one
merge at a time would do differently is looked at before: a merge whose new neighbours form a
pair that is as good or better ends its word's round, so the next round starts as the library
would go on. Finished words leave the array; the others close up.

Words are cut where no piece of the vocabulary can span: at white space, at symbols that stand
in no longer piece, and between any two symbols that are neighbours in no piece.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: the sign for white space, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of a worker's cache of words (a full cache is emptied), and characters of a word that goes there.
CACHE, CACHED_CHARS = 400_000, 64
#: Characters of new words that are merged together; a longer word is merged alone.
FLAT_CHARS = 1 << 18
NO_RANK = np.iinfo(np.int32).max


class Model(NamedTuple):
    """What encoding needs of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool
    unknown_surface: str


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> Model:
    """The model of a file: BPE with byte fallback and without text normalisation; others raise ValueError."""
    with open(path, "rb") as file:
        raw = file.read()
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    # 3: model type, 2 is BPE; 24: white space as suffix; 35: byte fallback
    plain = trainer.get(3) == 2 and not trainer.get(24) and trainer.get(35)
    # 2: character map; 4: remove extra white space; 5: escape white space
    untouched = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    if not plain or not untouched or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback, identity normalisation and plain pieces are read")
    surface = trainer.get(44, " ⁇ ".encode()).decode()
    return Model(pieces, scores, kinds, bool(normalizer.get(3, 1)), surface)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """A byte that starts no character becomes one replacement sign; reading goes on after it."""
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, model: Model):
        self.model = model
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        # equal scores share a rank; of two pairs with one rank the leftmost goes first
        self.n_pieces = len(model.pieces)
        score = np.array([-model.scores[i] for i in normal.values()])
        dense = np.unique(score, return_inverse=True)[1]
        ranks = dict(zip(normal, dense.tolist()))
        # symbols: ids of pieces, and further numbers for single characters that are no piece
        self.symbols = {c: normal[c] for c in normal if len(c) == 1}
        self.extra: list[str] = []
        for p in normal:
            for c in p:
                if c not in self.symbols:
                    self.symbols[c] = self._extra(c)
        self.numbers = np.full(sys.maxunicode + 1, -1, np.int64)
        for c, number in self.symbols.items():
            self.numbers[ord(c)] = number
        known = {**normal, **self.symbols}
        merges, beside = {}, set()
        for p, i in normal.items():
            beside.update((self.symbols[a], self.symbols[b]) for a, b in zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = known.get(p[:cut]), known.get(p[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = (ranks[p], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], np.int32)
        self.joined = np.array([merges[k][1] for k in self.keys.tolist()], np.int64)
        self.beside = np.array(sorted(a << 32 | b for a, b in beside), np.int64)
        self.words = re.compile(self._word_pattern(normal, ranks), re.S)
        self.cache: dict[str, bytes] = {}
        self.surface = [p.replace(SPACE, " ") for p in model.pieces]
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else {CONTROL: "", UNKNOWN: model.unknown_surface}.get(k, text).encode()
            for p, k, text in zip(model.pieces, model.kinds, self.surface)
        ]

    def _extra(self, c: str) -> int:
        self.extra.append(c)
        return self.n_pieces + len(self.extra) - 1

    @staticmethod
    def _word_pattern(normal: dict[str, int], ranks: dict[str, int]) -> str:
        """Matches that no piece can cross: spaces and what follows them, and runs of loners.

        A long run of spaces is cut by the longest piece of spaces where that changes nothing:
        pieces of spaces share one rank, worse than that of all others with a space (so they are
        made last, from the left), no piece has two spaces and then something else, and a run is
        seen to begin with the longest piece whatever its length.
        """
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            return ".+"  # pieces across words: nothing to cut at
        inside = {c for p in normal if len(p) > 1 for c in p}
        loners = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside and chr(c) != SPACE)
        spaces = {len(p): ranks[p] for p in normal if len(p) > 1 and not p.strip(SPACE)}
        mixed = [p for p in normal if SPACE in p and p.strip(SPACE)]

        def first_of(run: int) -> int:
            sizes, at = [1] * run, 0
            while at + 1 < len(sizes):
                if sizes[at] + sizes[at + 1] in spaces:
                    sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                    at = 0
                else:
                    at += 1
            return sizes[0]

        most = max(spaces, default=0)
        last = len(set(spaces.values())) == 1 and max((ranks[p] for p in mixed), default=-1) < max(spaces.values())
        sure = last and not any(p.startswith(SPACE * 2) for p in mixed)
        sure = sure and all(first_of(run) == most for run in range(most, 2 * most + 1))
        long_run = f"{SPACE}{{{most}}}(?={SPACE})|" if sure else ""
        rest = f"|[{loners}]+" if loners else ""
        return f"{long_run}{SPACE}+[^{SPACE}{loners}]*|[^{SPACE}{loners}]+{rest}"

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every pair (``NO_RANK`` if it forms no piece) and the piece it forms."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NO_RANK), self.joined[at]

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left after all merges, and for each the place of its first character.

        ``starts`` marks the first symbol of every word.
        """
        n = len(symbols)
        origin = np.arange(n)
        first = starts.copy()
        if n > 1 and len(self.beside):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            first[1:] |= self.beside[at] != key
        # ranks[i] and pieces[i] belong to the pair (i, i + 1); a word's last symbol has none
        ranks, pieces = np.full(n, NO_RANK, np.int32), np.zeros(n, np.int64)
        if n > 1:
            ranks[:-1], pieces[:-1] = self._look_up(symbols[:-1], symbols[1:])
            ranks[:-1][first[1:]] = NO_RANK
        done = []
        while len(symbols):
            heads = np.flatnonzero(first)
            sizes = np.diff(np.append(heads, len(symbols)))
            least = np.minimum.reduceat(ranks, heads)
            if (least == NO_RANK).any():  # compaction: finished words leave
                stay = np.repeat(least != NO_RANK, sizes)
                done.append((origin[~stay], symbols[~stay]))
                symbols, origin, first, ranks, pieces = (x[stay] for x in (symbols, origin, first, ranks, pieces))
                sizes, least = sizes[least != NO_RANK], least[least != NO_RANK]
                if not len(symbols):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            hits = np.flatnonzero(ranks == least[word])
            # of overlapping hits every second one, counted from the left
            begins = np.append(True, np.diff(hits) > 1)
            run = np.cumsum(begins) - 1
            hits = hits[(np.arange(len(hits)) - np.flatnonzero(begins)[run]) % 2 == 0]
            hits = hits[self._in_order(symbols, first, word, hits, pieces[hits], least)]
            symbols[hits] = pieces[hits]
            gone = hits + 1
            stay = np.ones(len(symbols), bool)
            stay[gone] = False
            shifted = np.cumsum(stay) - 1
            symbols, origin, first, ranks, pieces = (x[stay] for x in (symbols, origin, first, ranks, pieces))
            at = shifted[hits]
            ends = np.append(first[1:], True)  # whether a symbol is its word's last
            changed = np.zeros(len(symbols), bool)
            changed[at] = changed[at[~first[at]] - 1] = True
            touched = np.flatnonzero(changed)
            ranks[touched[ends[touched]]] = NO_RANK
            touched = touched[~ends[touched]]
            ranks[touched], pieces[touched] = self._look_up(symbols[touched], symbols[touched + 1])
        places, left = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*done) if done else ([], [])))
        order = np.argsort(places)
        return left[order], places[order]

    def _in_order(self, symbols, first, word, hits, pieces, least) -> np.ndarray:
        """Which hits one merge at a time would take before any other pair of the word.

        After a hit is merged, its pair with the symbol on its left (already merged, if the hit
        before it ends there) and with the one on its right must be worse than the word's rank.
        Up to its first hit for which that fails, that one included, a word's hits are taken.
        """
        own = word[hits]
        left = symbols[np.maximum(hits - 1, 0)]
        follows = np.zeros(len(hits), bool)
        follows[1:] = hits[1:] == hits[:-1] + 2
        left = np.where(follows, np.roll(pieces, 1), left)
        before = np.where(first[hits], NO_RANK, self._look_up(left, pieces)[0])
        after_at = np.minimum(hits + 2, len(symbols) - 1)
        ends = (hits + 2 >= len(symbols)) | first[after_at]
        after = np.where(ends, NO_RANK, self._look_up(pieces, symbols[after_at])[0])
        broken = np.minimum(before, after) <= least[own]
        if not broken.any():
            return np.ones(len(hits), bool)
        stops = np.cumsum(broken) - broken  # broken hits before this one, over all words
        base = np.zeros(len(least), np.int64)
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        base[own[heads]] = stops[heads]
        return stops == base[own]

    def _encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not in the cache, merged together."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        numbers = self.numbers[codes]
        unknown = np.flatnonzero(numbers < 0)
        strange = [c.encode() for c in dict.fromkeys(text[k] for k in unknown.tolist())]
        if strange:
            place = {c.decode(): self.n_pieces + len(self.extra) + k for k, c in enumerate(strange)}
            numbers[unknown] = [place[text[k]] for k in unknown.tolist()]
        bounds = np.cumsum([0, *map(len, words)])
        starts = np.zeros(len(codes), bool)
        starts[bounds[:-1]] = True
        symbols, places = self.merged(numbers, starts)
        if len(symbols) and symbols.max() >= self.n_pieces:  # characters without a piece: their bytes
            spelled = [c.encode() for c in self.extra] + strange
            odd = np.flatnonzero(symbols >= self.n_pieces)
            raw = [spelled[s - self.n_pieces] for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(r) for r in raw]
            wide = np.repeat(symbols, times)
            wide[np.repeat(symbols >= self.n_pieces, times)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            symbols, places = wide, np.repeat(places, times)
        ids, ends = symbols.astype("<u4"), np.searchsorted(places, bounds)
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        prefix = SPACE if self.model.dummy_prefix else ""
        split = [self.words.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        fresh = list({w for words in split for w in words if w not in cache})
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
            fresh = list({w for words in split for w in words})
        found, at = {}, 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (end == at or size + len(fresh[end]) <= FLAT_CHARS):
                size += len(fresh[end])
                end += 1
            found.update(zip(fresh[at:end], self._encode_new(fresh[at:end])))
            at = end
        out = [b"".join([cache[w] if w in cache else found[w] for w in words]) for words in split]
        cache.update((w, ids) for w, ids in found.items() if len(w) <= CACHED_CHARS)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids, as the library decodes it.

        Bytes in a row become characters (a byte that belongs to none, one replacement sign);
        the white space that the first piece has for the dummy prefix goes.
        """
        kinds, out, raw, at_start = self.model.kinds, [], bytearray(), True
        ids = np.asarray(ids).tolist()
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        whole = b"".join(map(self.raw.__getitem__, ids))
        try:  # bytes that are whole characters need no second look
            cut = first is not None and kinds[first] == NORMAL and self.model.dummy_prefix and whole[:1] == b" "
            return whole[cut:].decode()
        except UnicodeDecodeError:
            pass

        def flush() -> None:
            nonlocal at_start
            if raw:
                out.append(raw.decode("utf-8", "each_byte"))
                raw.clear()
                at_start = False

        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                raw.append(int(self.model.pieces[i][3:5], 16))
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = self.model.unknown_surface if kind == UNKNOWN else self.surface[i]
            if at_start and kind == NORMAL and self.model.dummy_prefix and piece[:1] == " ":
                piece = piece[1:]
                at_start = False
            if piece:
                at_start = False
                out.append(piece)
        flush()
        return "".join(out)


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` per document (ids as an array of integers); no shuffle.

    With ``digests`` the ids are decoded again, and the columns ``ids_sha256`` (of the decimal ids
    joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8) replace ``ids``. A
    missing text is empty and has no tokens. Rows are independent: repeated rows stay, other
    columns are not read. The vocabulary is broadcast; a batch holds 256 documents at most.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)

        def digest(raw: bytes) -> str:
            return hashlib.sha256(raw).hexdigest()

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                blobs = coder.encode([t.as_py() for t in b.column("text")])
                counts = pa.array([len(x) // 4 for x in blobs], pa.int64())
                if digests:
                    lists = [np.frombuffer(x, "<u4") for x in blobs]
                    shown = [digest(",".join(map(str, x.tolist())).encode()) for x in lists]
                    back = [digest(coder.decode(x).encode()) for x in lists]
                    more = [pa.array(shown, pa.string()), pa.array(back, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in blobs)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
                    more, names = [pa.ListArray.from_arrays(ends, values)], ["doc_id", "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, *more], names=names)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return slim.mapInArrow(coded, f"doc_id {ids}, n_tokens long, {kinds}")
