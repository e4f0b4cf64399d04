"""SQL building blocks for the statistics oracles: draws, moments and elimination steps."""

from __future__ import annotations

from itertools import combinations_with_replacement

from examlens.operators.bootstrap import DIGITS, LANES, POISSON_LIMITS
from examlens.plans.oracle_tables import h

REPS = 2000


def draws_sql(source: str, cluster: str, seed: int, by: list[str] | None = None) -> str:
    """Clusters drawn with replacement, replicate 0 being the sample itself."""
    keys = "".join(f"{name}, " for name in by or [])
    listed = f"""(SELECT {keys}{cluster}, n,
                 row_number() OVER (PARTITION BY {keys}1 ORDER BY {cluster}) - 1 AS idx
          FROM (SELECT *, count(*) OVER (PARTITION BY {keys}1) AS n
                FROM (SELECT DISTINCT {keys}{cluster} FROM {source})))"""
    using = ", ".join([*(by or []), "idx"])
    return f"""SELECT {keys}0 AS rep, {cluster}, 1.0::DOUBLE AS weight FROM {listed}
        UNION ALL
        SELECT {keys}rep, {cluster}, count(*)::DOUBLE AS weight
        FROM (SELECT {keys}rep, {h(str(seed), 'rep', 'idx')} % n AS idx
              FROM {listed}, range(1, {REPS + 1}) r(rep)) d
        JOIN {listed} c USING ({using})
        GROUP BY {keys}rep, {cluster}"""


def item_draws_sql(cells: str, by: str, order: str, seed: int) -> dict[str, str]:
    """Tables ``placed``, ``fills`` and ``drawn`` (by, rep, idx, weight) over the cells with their count ``_n``.

    The same binomials one after the other: a recursion over the cells, with their probabilities
    in lists. Replicate 0 is the sample itself.
    """
    ratio = "{'w': (left_ - k)::DOUBLE / (k + 1)::DOUBLE * odds, 't': 0.0::DOUBLE, 'c': 0::BIGINT}"
    start = "[{'w': 1.0::DOUBLE, 't': 1.0::DOUBLE, 'c': 0::BIGINT}]"
    rows = f"list_concat({start}, list_transform(range(low, high), lambda k: {ratio}))"
    return {
        "placed": f"""SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS idx,
                sum(_n) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
                sum(_n) OVER (PARTITION BY {by}) AS total FROM {cells}""",
        "fills": f"""SELECT {by}, rep, 0::BIGINT AS idx, total::BIGINT AS left_, 0::BIGINT AS weight
                FROM (SELECT DISTINCT {by}, total FROM placed), range(1, {REPS + 1}) r(rep)
            UNION ALL
            SELECT {by}, rep, idx, left_ - n, n FROM (
              SELECT *, CASE WHEN _n = rest THEN left_ ELSE low + list_reduce(rows_, lambda s, e:
                  {{'w': s.w * e.w, 't': s.t + s.w * e.w, 'c': s.c + (s.t <= u * total_)::BIGINT}}).c END AS n FROM (
                SELECT *, CASE WHEN low = 0 THEN pow(1 - p, -left_) ELSE list_reduce(rows_, lambda s, e:
                  {{'w': s.w * e.w, 't': s.t + s.w * e.w, 'c': 0::BIGINT}}).t END AS total_ FROM (
                  SELECT *, {rows} AS rows_ FROM (
                    SELECT *, greatest(floor(left_ * p - reach), 0)::BIGINT AS low, least(ceil(left_ * p + reach), left_)::BIGINT AS high FROM (
                      SELECT *, 6.5 * sqrt(left_ * p * (1 - p)) + 8 AS reach, p / (1 - p) AS odds FROM (
                        SELECT {', '.join(f'f.{name.strip()}' for name in by.split(','))}, rep, c.idx, left_, _n, rest, _n::DOUBLE / rest::DOUBLE AS p,
                               ({h(str(seed), 'rep', '(c.idx - 1)')}::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u
                        FROM fills f JOIN placed c ON c.idx = f.idx + 1
                         AND {' AND '.join(f'c.{name.strip()} = f.{name.strip()}' for name in by.split(','))}))))))""",
        "drawn": f"""SELECT {by}, 0 AS rep, idx, _n::DOUBLE AS weight FROM placed
            UNION ALL SELECT {by}, rep, idx, weight::DOUBLE FROM fills WHERE idx > 0""",
    }


def poisson_sql(source: str, by: str, key: str, x: str, y: str, seed: int, repetitions: int = REPS) -> str:
    """Rows (by, rep, r): correlation of x and y under Poisson(1) weights from hashes of the key."""
    limits = ", ".join(f"'{limit}'" for limit in POISSON_LIMITS)
    keys = f"{by}, " if by else ""
    digits = f"substr(md5(concat_ws(':', '{seed}', (rep - 1) // {LANES}, {key})), ((rep - 1) % {LANES}) * {DIGITS} + 1, {DIGITS})"
    weight = f"CASE WHEN rep = 0 THEN 1.0 ELSE len(list_filter([{limits}], lambda limit_: {digits} >= limit_)) END::DOUBLE"
    cells = f"SELECT {keys}rep, {weight} AS w, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM {source}, range(0, {repetitions + 1}) r(rep)"
    sums = f"""SELECT {keys}rep, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx,
        sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM ({cells}) GROUP BY {keys}rep"""
    return f"SELECT {keys}rep, (xy - sx * sy / n) / nullif(sqrt((xx - sx * sx / n) * (yy - sy * sy / n)), 0) AS r FROM ({sums})"


def pair(a: str, b: str) -> str:
    return "__".join(sorted((a, b)))


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(sorted(columns), 2))


def moments_sql(
    source: str,
    columns: list[str],
    by: list[str],
    absorb: str | None,
    draws: str | None = "draws",
    cluster: str = "year",
    draw_keys: list[str] | None = None,
    weight: str = "1.0",
) -> str:
    """Row per (by, rep): n, s_*, w_* (within the absorbed factor) and t_* (total)."""
    keys = "".join(f"{name}, " for name in by)
    level = f", {absorb}" if absorb else ""
    join = ""
    rep, w = "0 AS rep", weight
    if draws:
        using = ", ".join([*(draw_keys or []), cluster])
        join, rep, w = f" JOIN {draws} USING ({using})", "rep", f"weight * {weight}"
    sums = ", ".join(
        [f"sum({w})::DOUBLE AS n"]
        + [f"sum({w} * {c})::DOUBLE AS s_{c}" for c in columns]
        + [f"sum({w} * {a} * {b})::DOUBLE AS q_{pair(a, b)}" for a, b in pairs(columns)]
    )
    pooled = ", ".join(
        ["sum(n) AS n", "count(*) AS levels"]
        + [f"sum(s_{c}) AS s_{c}" for c in columns]
        + [
            f"sum(q_{pair(a, b)} - s_{a} * s_{b} / n) AS w_{pair(a, b)}"
            for a, b in pairs(columns)
        ]
        + [
            f"sum(q_{pair(a, b)}) - sum(s_{a}) * sum(s_{b}) / sum(n) AS t_{pair(a, b)}"
            for a, b in pairs(columns)
        ]
    )
    return f"""SELECT {keys}rep, {pooled}
        FROM (SELECT {keys}{rep}{level}, {sums} FROM {source}{join}
              GROUP BY {keys}rep{level})
        GROUP BY {keys}rep"""


def eliminate(
    source: str, keys: list[str], prefix: str, columns: list[str], pivots: list[str]
) -> str:
    """Moments ``e_*`` of the remaining columns after regressing out the pivots in order."""
    head = ", ".join(keys)
    current = f"SELECT {head}, " + ", ".join(
        f"{prefix}_{pair(a, b)} AS e_{pair(a, b)}" for a, b in pairs(columns)
    ) + f" FROM {source}"
    left = list(columns)
    for p in pivots:
        left = [c for c in left if c != p]
        current = f"SELECT {head}, " + ", ".join(
            f"e_{pair(a, b)} - e_{pair(a, p)} * e_{pair(b, p)} / nullif(e_{pair(p, p)}, 0)"
            f" AS e_{pair(a, b)}"
            for a, b in pairs(left)
        ) + f" FROM ({current})"
    return current


def bounds(value: str, name: str | None = None, digits: int = 6) -> str:
    """Estimate and percentile bounds of one replicate column."""
    name = name or value
    return (
        f"round(max({value}) FILTER (WHERE rep = 0), {digits}) AS {name}, "
        f"round(quantile_cont({value}, 0.025) FILTER (WHERE rep > 0), {digits}) AS {name}_ci_low, "
        f"round(quantile_cont({value}, 0.975) FILTER (WHERE rep > 0), {digits}) AS {name}_ci_high"
    )


def samples(value: str) -> str:
    return f"count({value}) FILTER (WHERE rep > 0) AS bootstrap_samples"
