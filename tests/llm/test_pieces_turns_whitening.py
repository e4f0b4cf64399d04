"""Operators 11 to 13 against the public library, brute force and numpy."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from examlens.llm import piece_rounds, turn_repair, whitening
from examlens.llm import queries as q

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "th", "er", " ", "  ", "\n", "'", "s", "re", "1", "!", "é", "ß", "日本", "\t", "😀", "　", "́", "--", "▁", "<s>", "      "]


@pytest.fixture(scope="module")
def model():
    return piece_rounds.read_model(PATH)


@pytest.fixture(scope="module")
def coder(model):
    return piece_rounds.Coder(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(coder, library, texts):
    for text, got in zip(texts, coder.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == library.encode(text), text[:200]
        assert coder.decode(ids) == library.decode(ids.tolist())


def test_pieces_equal_the_library(coder, library, model):
    rng = random.Random(2)
    check(coder, library, ["", " ", "  a\n\nb\tc  ", "▁a ▁", "\x00\x7f", "<unk><0x41>"])
    for k in range(40):
        check(coder, library, ["".join(rng.choice(PARTS[: rng.choice([3, 8, 24])]) for _ in range(rng.randrange(70))) for _ in range(60)])
    pieces = [p.replace("▁", " ") for p, kind in zip(model.pieces, model.kinds) if kind == piece_rounds.NORMAL]
    for k in range(20):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(50))) for _ in range(60)]
        check(coder, library, [t.replace(" ", "") for t in texts] if k % 2 else texts)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000 + "t", " a" * 9000, "-=" * 9000, "日" * 9000, "\n \n" * 5000, "\x00" * 5000])
def test_long_runs_of_pieces(coder, library, text):
    check(coder, library, [text])


def test_any_ids_decode_as_in_the_library(coder, library, model):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(len(model.pieces)) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(10))]
        assert coder.decode(ids) == library.decode(ids)


def one_at_a_time(text, scores):
    """The definition: the best-scored pair, the leftmost of equals, until no pair is a piece."""
    parts = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_rounds_equal_single_merges_for_any_scores(seed):
    """Vocabularies whose longer pieces may score better than their parts, and ties."""
    rng = random.Random(seed)
    longer = {"".join(rng.choice("ab▁c"[: 2 + seed % 3]) for _ in range(rng.randrange(2, 7))) for _ in range(40)}
    if seed % 2:
        longer = {p for p in longer if "▁" not in p[1:]}
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *"ab▁", *sorted(longer)]
    kinds = [piece_rounds.UNKNOWN] + [piece_rounds.BYTE] * 256 + [piece_rounds.NORMAL] * (len(pieces) - 257)
    scores = [0.0] * 257 + [float(-rng.randrange(12)) for _ in pieces[257:]]
    coder = piece_rounds.Coder(piece_rounds.Model(pieces, scores, kinds, True, " ⁇ "))
    by_piece = {p: s for p, s in zip(pieces[257:], scores[257:])}
    for _ in range(150):
        text = "".join(rng.choice("aabb cé") for _ in range(rng.randrange(1, 40)))
        want = []
        for part in one_at_a_time("▁" + text.replace(" ", "▁"), by_piece):
            want += [pieces.index(part)] if part in by_piece else [pieces.index(f"<0x{b:02X}>") for b in part.encode()]
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == want, text


def test_a_full_cache_of_words_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(piece_rounds, "CACHE", 3)
    monkeypatch.setattr(piece_rounds, "FLAT_CHARS", 5)
    check(coder, library, ["many different words in this short text, many words", "", "many"])


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes([0x12, 0x02, 0x18, 0x01]))  # trainer specification with model type 1
    with pytest.raises(ValueError):
        piece_rounds.read_model(str(path))


def test_pieces_of_documents(docs, rows, no_docs, model, library):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = piece_rounds.encode(docs, model, digests=True).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "")
        want.append((r[0] or -1, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    plain = piece_rounds.encode(docs, model).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in plain) == sorted((r[0] or -1, library.encode(r[1] or "")) for r in rows)
    assert piece_rounds.encode(no_docs, model).count() == 0


@pytest.mark.parametrize("prime", [5, 97, turn_repair.PRIME])
def test_trails_compare_as_strings(prime):
    """Small moduli make different strings collide."""
    rng = random.Random(prime)
    trails = turn_repair.Trails(prime, turn_repair.BASE % prime)
    nodes, strings = [0], [""]
    for _ in range(400):
        k = rng.randrange(len(nodes)) if rng.random() < 0.3 else rng.randrange(max(0, len(nodes) - 6), len(nodes))
        sign = rng.choice("DIKR")
        nodes.append(trails.add(nodes[k], sign))
        strings.append(strings[k] + sign)
    for _ in range(4000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert trails.less(nodes[i], nodes[j]) == (strings[i] < strings[j])
        assert trails.equal(nodes[i], nodes[j]) == (strings[i] == strings[j])
        assert trails.string(nodes[i]) == strings[i]


def all_edits(rows):
    """Cheapest edits by trying every string with two turns put in at most at any place."""
    best = None
    gaps = ["", "I", "II"]
    for choice in itertools.product("DKR", repeat=len(rows)):
        if any(r.must_go and c != "D" for r, c in zip(rows, choice)):
            continue
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            edits = between[0] + "".join(c + g for c, g in zip(choice, between[1:]))
            cost = sum({"D": 4, "K": 0, "R": 3}[c] + 3 * (r.truncated and c != "D") for r, c in zip(rows, choice)) + 3 * edits.count("I")
            if best and (cost, edits) >= best:
                continue
            at, last, legal = 0, "", True
            for sign in edits:
                row = rows[at] if sign != "I" else None
                at += sign != "I"
                if sign == "D":
                    continue
                if sign == "K":
                    now = row.initial
                    legal = legal and (now == "s" and last == "" or now == "u" and last != "u" or now == "a" and last == "u")
                else:
                    now = "a" if last == "u" else "u"
                last = now
            if legal and last in ("", "a"):
                best = (cost, edits)
    return best


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(4)
    for _ in range(150):
        rows = [turn_repair.Row(rng.choice("suaax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        assert turn_repair.cheapest_edits(rows) == all_edits(rows), rows


def plain_edits(rows):
    """The same programme over whole strings."""
    far = (10**9, "")
    state = [(0, ""), far, far, far]

    def more(s, cost, sign):
        return (s[0] + cost, s[1] + sign)

    def put_in(n):
        n[2] = min(n[2], *[more(n[k], 3, "I") for k in (0, 1, 3)])
        n[3] = min(n[3], more(n[2], 3, "I"))
        return n

    state = put_in(state)
    for r in rows:
        n = [more(s, 4, "D") for s in state]
        if not r.must_go:
            t = 3 * r.truncated
            if r.initial == "s":
                n[1] = min(n[1], more(state[0], t, "K"))
            for k, j, role in ((0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                if r.initial == role:
                    n[j] = min(n[j], more(state[k], t, "K"))
                n[j] = min(n[j], more(state[k], 3 + t, "R"))
        state = put_in(n)
    return min(state[0], state[3])


@pytest.mark.parametrize("prime", [3, turn_repair.PRIME])
def test_long_conversations_equal_whole_strings(prime):
    rng = random.Random(prime)
    for n in (30, 200, 700):
        rows = [turn_repair.Row(rng.choice("suauaa"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(n)]
        assert turn_repair.cheapest_edits(rows, turn_repair.Trails(prime, 2)) == plain_edits(rows)
    same = [turn_repair.Row("a", False, False)] * 500
    assert turn_repair.cheapest_edits(same) == plain_edits(same)


def told(turns):
    """The contract of the query, row by row."""
    out = {}
    by_conversation = {}
    for conv, turn, role, text in turns:
        by_conversation.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 4:
            role = "user"
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        by_conversation[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    for conv, rows in by_conversation.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        blank = duplicate = truncated = 0
        slim = []
        for k, (_, role, text) in enumerate(rows):
            words = text.strip(" \t\n\r\x0b\x0c")
            first = "b" if not words else "d" if any(r[1:] == (role, text) for r in rows[:k]) else "t" if words[-1] not in ".!?" else ""
            blank, duplicate, truncated = blank + (first == "b"), duplicate + (first == "d"), truncated + (first == "t")
            slim.append(turn_repair.Row(role[:1], first in ("b", "d"), first == "t"))
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(slim, slim[1:]))
        numbers = {r[0] for r in rows} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = plain_edits(slim)
        lines, at = [], 0
        for sign in audit:
            role, text = ("", "") if sign == "I" else rows[at][1:]
            at += sign != "I"
            if sign == "D":
                continue
            lines.append((role if sign == "K" else "assistant" if lines and lines[-1][0][0] == "u" else "user", text))
        body = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(6)
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice(["A whole sentence.", "cut short", "", None, " \n\t", "Really?! ", f"Own text {turn}.", "é。", "x" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 5, 2, None]), role, text))
    rows += [(None, k % 7, "user", f"Lost {k}.") for k in range(40)] + [(999, k, "user" if k % 2 else "assistant", f"Long {k}.") for k in range(900)]
    return rows + [(1000, 3, "user", "Same.")] * 4


def test_repair_equals_the_contract(spark, turns, tmp_path):
    path = str(tmp_path)
    frame = spark.createDataFrame(turns, TURNS).repartition(7)
    for name in ("times", "audit", "repaired", "cost"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in q.op12(spark, path).collect()}
    assert got == told(turns)
    twin = duckdb.sql(q.ORACLES["op12_conversation_repair"].replace("FROM conversations", f"FROM '{path}/conversations.parquet/*.parquet'"))
    assert {r[0]: r[1:] for r in twin.fetchall()} == got


def test_repaired_turns_are_legal(spark, turns):
    got = turn_repair.repair(spark.createDataFrame(turns, TURNS)).collect()
    assert len(got) == len({t[0] for t in turns})
    for r in got:
        initials = "".join(t.role[:1] for t in r.repaired)
        body = initials[1:] if initials[:1] == "s" else initials
        assert body == "ua" * (len(body) // 2) and (body or not initials)
        assert all(t.text.strip() or t.text == "" for t in r.repaired)


def test_no_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair(empty).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "x", 0)], f"{TURNS}, times int")
    row = turn_repair.repair(gone, times_col="times").first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", [])


def whitened_by_hand(rows, components):
    """Everything in fractions up to the eigenvectors."""
    ok = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    x = np.array([v for _, v in ok], object)
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    matrix = np.array([[float(Fraction(int(e), n**3)) for e in line] for line in scaled.T.dot(scaled)])
    values, vectors = np.linalg.eigh(matrix)
    w = scaled.astype(float) / n @ vectors[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])
    return ok, n, (scaled * scaled).sum(1), w, values[::-1][:components] / np.trace(matrix)


def vector_rows(width, count, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, width)) * np.linspace(0.2, 3, width) + rng.standard_normal(width) * 5
    rows = [(int(i), v.astype(np.float32).astype(float).tolist()) for i, v in zip(rng.permutation(count), base)]
    return rows + rows[:3]


ODD = [(9000, None), (9001, [1.0, None] * 20), (9002, [float("nan")] * 40), (9003, [float("inf")] + [0.0] * 39), (9004, [])]


@pytest.mark.parametrize("width", [40, 5])
def test_whitening_equals_fractions(spark, width):
    rows = vector_rows(width, 400)
    frame = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>").repartition(5)
    frame = frame.withColumn("component", F.lit("clash")).withColumn("v", F.lit("clash")).withColumn("n", F.lit(1))
    got = whitening.whitened(frame).collect()
    k = min(32, width)
    ok, n, far, w, explained = whitened_by_hand(rows, k)
    assert len(got) == len(ok) * k
    table = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        table.setdefault(r.vec_id, {}).setdefault(r.component, set()).add((r.deviation, r.whitened, r.explained))
    by_id = {i: at for at, (i, _) in enumerate(ok)}
    signs = {}
    for i, parts in table.items():
        for component, values in parts.items():
            assert len(values) == 1  # repeated rows agree
            deviation, value, share = next(iter(values))
            want = w[by_id[i], component - 1]
            assert deviation == far[by_id[i]] and share == pytest.approx(explained[component - 1], rel=1e-9)
            if abs(want) > 1e-6:
                assert signs.setdefault(component, np.sign(value * want)) == np.sign(value * want)
            assert abs(value) == pytest.approx(abs(want), abs=1e-7)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame(ODD, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance
    # two lengths, each with a fit of its own; a missing id; one dimension that never varies
    rows = vector_rows(6, 60, 1) + [(i + 500, v) for i, v in vector_rows(3, 50, 2)]
    rows = [(i, [*v[:-1], 1.0] if len(v) == 6 else v) for i, v in rows] + [(None, rows[0][1][:5] + [1.0])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert {(r.n, r.component) for r in got if r.vec_id and r.vec_id >= 500} == {(53, k) for k in (1, 2, 3)}
    assert {(r.n, r.component) for r in got if r.vec_id is None} == {(64, k) for k in range(1, 6)}
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening_of_large_numbers(spark):
    """Sums of squares far beyond 64 bits stay exact; a deviation beyond them is null."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(4) * 10.0**e).tolist()) for i, e in enumerate([11] * 30)]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    _, _, far, w, _ = whitened_by_hand(rows, 4)
    for (i, k), r in got.items():
        assert r.deviation == (far[i] if far[i] < 2**63 else None)
        assert abs(r.whitened) == pytest.approx(abs(w[i, k - 1]), abs=1e-7)


def test_eigenvectors_of_the_given_vectors(spark, small_dir):
    """The covariance recovered from variances is the covariance."""
    frame = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    one = whitening.fit(frame)[64]
    x = np.floor(64 * np.array([r.embedding for r in frame.collect()], float))
    direct = np.cov(x.T, bias=True)
    assert one.n == len(x)
    assert np.allclose(one.vectors.T * one.variances @ one.vectors, direct, atol=1e-8 * np.trace(direct))
