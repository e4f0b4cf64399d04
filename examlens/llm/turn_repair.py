"""Repair of conversations: the cheapest edits that give a legal order of roles.

Faulty rows are deleted, roles changed and empty turns put in until the roles read as an optional
system turn and then user and assistant in turn, or as nothing. A dynamic programme goes over a
conversation's rows with four states (nothing yet, after system, after user, after assistant).
Each state keeps its cheapest edits as the end of a linked list whose beginnings are shared, so a
row adds a few nodes, however long the list. Of equally cheap edits the least string wins: two
lists are compared at their longest common prefix, which is searched with binary-lifting
ancestors and rolling hashes. Equal hashes are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlens.llm.common import SPACES

#: Costs of edits; a row cut short costs more unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fixed signs that end a whole text.
ENDS = ".!?"
#: Modulus (a Mersenne prime) and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A1C2E3F1 % ((1 << 61) - 1)
#: States of the programme, and from which of them a user turn may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (START, SYSTEM, ASSISTANT)
INITIALS = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
#: Conversations that a task turns into one batch of results.
BATCH = 1024


class Trails:
    """Strings as linked nodes that share their beginnings; node 0 is the empty string."""

    def __init__(self, prime: int = PRIME, base: int = BASE):
        self.prime, self.base = prime, base
        self.sign, self.depth, self.hash = [""], [0], [0]
        self.above: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... nodes before
        self.same_as = [0]

    def add(self, node: int, sign: str) -> int:
        """The node of the string of ``node`` followed by ``sign``."""
        above, level = [node], 0
        while level < len(self.above[above[level]]):
            above.append(self.above[above[level]][level])
            level += 1
        self.above.append(above)
        self.sign.append(sign)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(sign)) % self.prime)
        self.same_as.append(len(self.same_as))
        return len(self.sign) - 1

    def _known(self, node: int) -> int:
        while self.same_as[node] != node:
            self.same_as[node] = node = self.same_as[self.same_as[node]]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth stand for the same string.

        Different hashes say no. Equal ones are verified back to the node where the two meet;
        what was verified once is remembered.
        """
        x, y = self._known(a), self._known(b)
        if x == y:
            return True
        if self.depth[x] != self.depth[y] or self.hash[x] != self.hash[y]:
            return False
        p, q = x, y
        while p != q:
            if self.sign[p] != self.sign[q]:
                return False
            p, q = self._known(self.above[p][0]), self._known(self.above[q][0])
        self.same_as[max(x, y)] = min(x, y)
        return True

    def _cut(self, node: int, depth: int) -> int:
        """The beginning of a string that has the given length."""
        rest, level = self.depth[node] - depth, 0
        while rest:
            if rest & 1:
                node = self.above[node][level]
            rest >>= 1
            level += 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._cut(a, depth), self._cut(b, depth)
        if self.equal(x, y):
            return self.depth[a] < self.depth[b]
        for level in reversed(range(len(self.above[x]))):
            if level < len(self.above[x]) and not self.equal(self.above[x][level], self.above[y][level]):
                x, y = self.above[x][level], self.above[y][level]
        return self.sign[x] < self.sign[y]

    def string(self, node: int) -> str:
        signs = []
        while node:
            signs.append(self.sign[node])
            node = self.above[node][0]
        return "".join(reversed(signs))


class Row(NamedTuple):
    """What the programme needs to know of a row."""

    initial: str
    must_go: bool
    truncated: bool


def cheapest_edits(rows: list[Row], trails: Trails | None = None) -> tuple[int, str]:
    """Cost and string of the cheapest edits: K keep, R change the role, D delete, I put in.

    Of equal costs the string that is least in ASCII. Two strings of one state and cost are
    never a beginning of one another, because every put-in turn costs; so keeping the least
    string of each state is enough.
    """
    trails = trails or Trails()
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def offer(into: list, state: int, source: tuple[int, int] | None, cost: int, sign: str) -> None:
        if source is None:
            return
        cost += source[0]
        held = into[state]
        if held is None or cost < held[0]:
            into[state] = (cost, trails.add(source[1], sign))
        elif cost == held[0]:
            node = trails.add(source[1], sign)
            if trails.less(node, held[1]):
                into[state] = (cost, node)

    def put_in(states: list) -> None:
        # a turn put in after the assistant starts from what stood there before
        for before in [states[k] for k in BEFORE_USER]:
            offer(states, USER, before, INSERT, "I")
        offer(states, ASSISTANT, states[USER], INSERT, "I")

    put_in(best)
    for row in rows:
        new: list[tuple[int, int] | None] = [None] * 4
        for state in range(4):
            offer(new, state, best[state], DELETE, "D")
        if not row.must_go:
            more = TRUNCATED if row.truncated else 0
            moves = [*((k, USER) for k in BEFORE_USER), (USER, ASSISTANT), (START, SYSTEM)]
            for before, after in moves:
                if row.initial == INITIALS[after]:
                    offer(new, after, best[before], more, "K")
                if after != SYSTEM:
                    offer(new, after, best[before], REROLE + more, "R")
        put_in(new)
        best = new
    ends = [best[k] for k in (START, ASSISTANT) if best[k] is not None]
    cost = min(e[0] for e in ends)
    nodes = [e[1] for e in ends if e[0] == cost]
    node = nodes[0] if len(nodes) == 1 or trails.less(nodes[0], nodes[1]) else nodes[1]
    return cost, trails.string(node)


def repaired_turns(turns: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The turns after the edits; those put in have an empty text."""
    out: list[tuple[str, str]] = []
    at = 0
    for sign in edits:
        follows = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if sign == "I":
            out.append((follows, ""))
            continue
        if sign == "K":
            out.append(turns[at])
        elif sign == "R":
            out.append((follows, turns[at][1]))
        at += 1
    return out


def audited(turns: list[tuple[int | None, str, str]]) -> dict:
    """Counts of faults, the cheapest edits and the repaired turns of one conversation in order."""
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    seen, rows = set(), []
    for _, role, text in turns:
        body = text.strip(SPACES)
        fault = None
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif body[-1] not in ENDS:
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append(Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    counts["illegal"] = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    numbers = {t for t, *_ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, edits = cheapest_edits(rows)
    return {"gaps": gaps, **counts, "cost": cost, "audit": edits, "repaired": repaired_turns([t[1:] for t in turns], edits)}


def repair(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    times_col: str | None = None,
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` per conversation.

    ``repaired`` is an array of (role, text). Rows stand in the order of their turn, those without
    one first; rows of one turn by role and text. A missing role or text counts as one space. A
    row counts as blank if its text has no word, else as duplicate if role and text stood before,
    else as truncated if its last sign ends no sentence; blank and duplicate rows must be deleted.
    Rows without a conversation make up one conversation. ``times_col`` says how often a row
    stands (repeats are adjacent); a conversation of rows that stand zero times has zeros, no
    edits and no turns. An empty table gives no rows; other columns are not read.

    One shuffle brings a conversation's rows together, sorted; a task reads them one after the
    other and holds one conversation at a time, so a conversation must fit in a task.
    """
    ids = turns.schema[id_col].dataType
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    slim = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
        (F.col(times_col) if times_col else F.lit(1)).cast("int").alias("times"),
    )
    pairs = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [T.StructField("conv_id", ids), *[T.StructField(c, T.LongType()) for c in longs]]
        + [T.StructField("audit", T.StringType()), T.StructField("repaired", pairs)]
    )
    arrow_pairs = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, held, open_ = None, [], False
        for b in batches:
            keys = b.column("conv_id")
            for i, (key, turn, role, text, times) in enumerate(zip(*(b.column(c).to_pylist() for c in b.schema.names))):
                if not open_ or key != current[1]:
                    if open_:
                        yield current[0], held
                    current, held, open_ = (keys.slice(i, 1), key), [], True
                held.extend([(turn, role, text)] * times)
        if open_:
            yield current[0], held

    def result(found: list[tuple]) -> pa.RecordBatch:
        facts = [audited(held) for _, held in found]
        listed = [[{"role": r, "text": t} for r, t in f["repaired"]] for f in facts]
        columns = [pa.concat_arrays([key for key, _ in found]), *[pa.array([f[c] for f in facts], pa.int64()) for c in longs]]
        columns += [pa.array([f["audit"] for f in facts], pa.string()), pa.array(listed, arrow_pairs)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for one in conversations(batches):
            found.append(one)
            size += len(one[1])
            if len(found) >= BATCH or size >= 16 * BATCH:
                yield result(found)
                found, size = [], 0
        if found:
            yield result(found)

    return slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(audits, schema)
