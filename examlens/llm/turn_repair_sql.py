"""SQL twin of the conversation repair: the same states, with whole strings instead of shared nodes."""

from __future__ import annotations


def _least(*offers: tuple[int, str, str, str]) -> str:
    """Of offers (state, cost, sign, condition) the cheapest, of equal ones the least string."""
    rows = [
        f"{{'c': d[{state}].c + {cost} + if({when}, 0, 1000000000), 's': d[{state}].s || '{sign}'}}"
        for state, cost, sign, when in offers
    ]
    return f"list_sort([{', '.join(rows)}])[1]"


def _put_in(source: str) -> str:
    """The four states of the list ``n`` and what turns put in add to them, as the list ``d``."""
    more = ", ".join(f"{{'c': n[{k}].c + 3, 's': n[{k}].s || 'I'}}" for k in (1, 2, 4))
    return f"""SELECT cid, i, [n[1], n[2], u, list_sort([n[4], {{'c': u.c + 3, 's': u.s || 'I'}}])[1]] AS d
    FROM (SELECT *, list_sort([n[3], {more}])[1] AS u FROM ({source}))"""


#: States: nothing, after system, after user, after assistant. ``g``: the row may stay; ``m``: what that costs more.
_DELETED = [(k, "4", "D", "true") for k in (1, 2, 3, 4)]
_SYSTEM = [_DELETED[1], (1, "m", "K", "g AND ini = 's'")]
_USER = [_DELETED[2], *[(k, *how) for k in (1, 2, 4) for how in (("m", "K", "g AND ini = 'u'"), ("m + 3", "R", "g"))]]
_ASSISTANT = [_DELETED[3], (3, "m", "K", "g AND ini = 'a'"), (3, "m + 3", "R", "g")]
_START = """SELECT cid, 0::BIGINT AS i, [{'c': 0::BIGINT, 's': ''}, {'c': 1000000000::BIGINT, 's': ''},
    {'c': 1000000000::BIGINT, 's': ''}, {'c': 1000000000::BIGINT, 's': ''}] AS n FROM ids"""
_STEP = f"""SELECT s.cid, f.i, [{_least(_DELETED[0])}, {_least(*_SYSTEM)}, {_least(*_USER)}, {_least(*_ASSISTANT)}] AS n
    FROM steps s JOIN (SELECT *, fault NOT IN ('b', 'd') AS g, CASE fault WHEN 't' THEN 3 ELSE 0 END AS m FROM faults) f
    ON f.cid = s.cid AND f.i = s.i + 1"""

SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
ids AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
          FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
coded AS (SELECT keyed.*, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)),
                 lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS code FROM keyed, crc),
hurt AS (SELECT cid, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
faults AS MATERIALIZED (SELECT cid, i, turn, role, text, left(role, 1) AS ini, CASE
             WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
             WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'd'
             WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lead(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS after FROM placed),
counts AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                  count(*) FILTER (fault = 't') AS truncated,
                  count(*) FILTER (after IS NOT NULL AND ini || after NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
           FROM faults GROUP BY cid),
steps AS ({_put_in(_START)} UNION ALL {_put_in(_STEP)}),
ended AS (SELECT s.cid, list_sort([d[1], d[4]])[1] AS e FROM steps s LEFT JOIN counts c ON c.cid = s.cid WHERE s.i = coalesce(c.last, 0)),
signs AS (SELECT cid, unnest(string_split(e.s, '')) AS sign, unnest(range(length(e.s))) AS j FROM ended WHERE e.s <> ''),
edits AS (SELECT *, sum((sign <> 'I')::INT) OVER (PARTITION BY cid ORDER BY j) AS i,
                 sum((sign <> 'D')::INT) OVER (PARTITION BY cid ORDER BY j) AS o FROM signs),
told AS (SELECT e.cid, e.j, e.sign, e.o, f.role, f.text,
                max((e.o = 1 AND e.sign = 'K' AND f.ini = 's')::INT) OVER (PARTITION BY e.cid) AS opening
         FROM edits e LEFT JOIN faults f ON f.cid = e.cid AND f.i = e.i WHERE e.sign <> 'D'),
lines AS (SELECT cid, string_agg(CASE WHEN sign = 'K' THEN role WHEN (o - opening) % 2 = 1 THEN 'user' ELSE 'assistant' END
                 || ':' || CASE WHEN sign = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM told GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.s AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN ended USING (cid) LEFT JOIN counts USING (cid) LEFT JOIN lines USING (cid)
"""
