"""Source mix, line dedup and preference rows against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from examlens.llm import pareto_mix, preference, site_lines


def n_words(text):
    return len((text or "").encode().split())


def brute_targets(rows):
    """Targets by resharing the excess until no source is above twice its size."""
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += n_words(r[1])
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2 * size[s]
                open_.discard(s)
    return size, target


def test_mix(docs, rows):
    got = pareto_mix.mix(docs).collect()
    size, target = brute_targets(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, n_words(r[1])) for r in rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    again = pareto_mix.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_takes_the_first_in_pareto_order(spark):
    rows = [(i, "one two", "a", "a", 1) for i in range(3000)] + [(5000 + i, "x", "b", "b", 1) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pareto_mix.mix(docs, seed=3).withColumn("u", pareto_mix.uniform(3, "doc_id", "size", "content")).collect()
    for source in "ab":
        of = [r for r in got if r.source == source]
        whole = min(r.copies for r in of)
        more = [r.u for r in of if r.copies > whole]
        rest = [r.u for r in of if r.copies == whole]
        assert not more or not rest or max(more) < min(rest)


def test_mix_with_weights(spark):
    rows = [(i, "some words here", "a" if i % 2 else "b", 8.0 if i % 5 == 0 else 1.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = pareto_mix.mix(docs, weight_col="w", share=0.6).toPandas()
    assert (got.copies <= 2).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 3).all()
    by = got.assign(heavy=got.doc_id % 5 == 0).groupby(["source", "heavy"]).copies.mean()
    assert all(by[s, True] > 1.8 * by[s, False] or by[s, True] == 2 for s in "ab")


def test_mix_of_nothing(spark, no_docs):
    assert pareto_mix.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in pareto_mix.mix(blank).collect()] == [0, 0]


def brute_lines(rows, ratio, least):
    """Unlike pages per line: the picked lines that stand beside it, counted twice independently."""
    strip = " \t\n\r\x0b\x0c"
    pages, beside = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for r in rows:
        lines = {x.strip(strip) for x in (r[1] or "").split("\n")} - {""}
        for k in range(2):
            picked = sorted((((zlib.crc32((x[::-1] if k else x).encode()) + 1) / len(x)), x) for x in lines)
            names = [x for _, x in picked]
            if names:
                pages[k][r[3]].add(names[0])
            for x in names:
                beside[k][r[3], x].add(next((y for y in names if y != x), x))
    bad = {
        key
        for key in beside[0]
        if all(len(beside[k][key]) >= least and len(beside[k][key]) > ratio * len(pages[k][key[0]]) for k in range(2))
    }
    out = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        kept = None if lines is None else [x for x in lines if (r[3], x.strip(strip)) not in bad]
        out.append((r[0] or -1, None if kept is None else "\n".join(kept), 0 if lines is None else len(lines) - len(kept)))
    return bad, out


def test_lines(docs, rows, no_docs, monkeypatch):
    bad, want = brute_lines(rows, site_lines.RATIO, site_lines.LEAST_PAGES)
    assert bad
    for most in (site_lines.SMALL_ROWS, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(site_lines, "SMALL_ROWS", most)
        frame = site_lines.without_boilerplate(docs)
        assert sorted(frame.columns) == sorted(docs.columns)
        got = [(r.doc_id or -1, r.text, r.dropped_lines) for r in frame.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert site_lines.without_boilerplate(no_docs).count() == 0


def test_copies_of_a_page_are_not_boilerplate(spark):
    rows = [(i, f"unique {i}\nabout us", "h") for i in range(20)] + [(100 + i, "a copied page\nwith two lines", "h") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in site_lines.without_boilerplate(frame).collect()}
    assert got[3] == "unique 3" and got[110] == "a copied page\nwith two lines"


def test_near_copies_in_a_small_source_keep_their_body(spark):
    rng = random.Random(12)

    def sentence(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    bodies = [(sentence(60), sentence(45)) for _ in range(8)]
    rows = [(i, f"{sentence(6)}\n{sentence(50)}\n{sentence(40)}\nHome | About", "h") for i in range(40)]
    rows += [(100 + 5 * b + k, f"headline {b} {k} {sentence(4)}\n{x}\n{y}", "h" if b < 2 else f"s{b}") for b, (x, y) in enumerate(bodies) for k in range(5)]
    rows += [(500 + i, f"{sentence(30)}\n{sentence(30)}", f"s{i % 6 + 2}") for i in range(60)]
    got = {r.doc_id: r for r in site_lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].dropped_lines == 1 and "About" not in got[i].text for i in range(40))
    assert all(got[r[0]].text == r[1] for r in rows[40:])


def test_rare_boilerplate_and_tiny_sites(spark):
    """A newsletter line on 8 % of 1,200 pages, and a footer on all four pages of a host."""
    rng = random.Random(13)

    def sentence(n):
        return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))

    rows = [(i, f"{sentence(20)}\n{sentence(20)}" + "\nSign up for our newsletter" * (i < 100), "big") for i in range(1200)]
    rows += [(2000 + i, f"{sentence(20)}\nImprint", "tiny") for i in range(4)]
    got = {r.doc_id: r for r in site_lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in got.items() if r.dropped_lines} == {*range(100), *range(2000, 2004)}
    assert not any("newsletter" in r.text or "Imprint" in r.text for r in got.values())


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        end = at + len(render([(r, t)]))
        if r == "assistant":
            out.append((at + len("<|im_start|>assistant\n"), end))
        at = end
    return out


def test_preference_rows(spark):
    u, a = "user", "assistant"
    talks = {
        1: [(u, "q"), (a, "good"), (u, "more"), (a, "fine")],
        2: [(u, "q"), (a, "good"), (u, "more"), (a, "bad\nanswer ü")],
        3: [(u, "q"), (a, "other")],
        4: [(u, "q"), (a, "other")],  # equal to 3
        5: [(u, "alone"), (a, "x")],
        6: [("unknown", ""), (a, "")],
        7: [(u, "only asks")],
        8: [(u, "only asks"), (u, "only asks")],
    }
    rows = [(i, k, r if r != "unknown" else None, t or None, "x") for i, ts in talks.items() for k, (r, t) in enumerate(ts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string").repartition(3)
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (5, None), (6, 99), (7, 8)], "chosen_id long, rejected_id long")
    got = {(r.chosen_id, r.rejected_id): r for r in preference.formatted(turns, pairs).collect()}
    assert len(got) == 6
    for (c, d), n in {(1, 2): 3, (3, 4): 1, (2, 3): 1, (5, None): 0, (6, 99): 0, (7, 8): 1}.items():
        r = got[c, d]
        assert r.n_prompt_turns == n and r.prompt == render(talks[c][:n])
        assert r.chosen == render(talks[c][n:]) and [tuple(s) for s in r.chosen_spans] == spans(talks[c][n:])
        if d in talks:
            assert r.rejected == render(talks[d][n:]) and [tuple(s) for s in r.rejected_spans] == spans(talks[d][n:])
        else:
            assert r.rejected is None and r.rejected_spans is None
        for s, e in r.chosen_spans:
            assert r.chosen[:s].endswith("assistant\n") and r.chosen[:e].endswith("<|im_end|>\n")
    assert preference.formatted(turns.limit(0), pairs).count() == 0


def test_pairs_share_their_opening(spark):
    rows = [(i, 0, "user", "hot" if i % 3 == 0 else f"q{i // 4}") for i in range(301)] + [(i, 1, "assistant", f"a{i}") for i in range(301)]
    rows += [(None, 0, "user", "hot"), (7, 0, "user", f"q{7 // 4}")]  # no id; a repeated turn
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = preference.conversations(turns)
    opening = {r.conv_id: r.turns[0].text for r in convs.collect()}
    got = preference.paired_by_opening(convs, salts=8).collect()
    used = [x for r in got for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(used) == sorted(i for i in opening if i is not None)
    assert all(opening[r.chosen_id] == opening[r.rejected_id] for r in got if None not in (r.chosen_id, r.rejected_id))
    n = Counter(opening.values())
    single = Counter(opening[r.chosen_id] for r in got if r.rejected_id is None)
    assert all(single[o] <= 1 for o in n)
