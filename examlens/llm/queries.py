"""Registered queries of the operators: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.llm import (
    bpe_tree,
    html_density,
    langid_cnn,
    minhash_bins,
    pareto_mix,
    piece_rounds,
    pq_dedup,
    preference,
    quality_fm,
    simhash_tiles,
    site_lines,
    turn_repair,
    turn_repair_sql,
    whitening,
)
from examlens.llm.common import once

#: Columns besides the text that the quality classifier may see.
METADATA = ("n_chars",)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the model sees texts, their length column and labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"), metadata=METADATA)
    return quality_fm.score(docs, machine, metadata=METADATA)


@register("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their estimated likeness.

    Nulls: a missing text is empty. Rows that repeat an id follow each other in the order of
    their texts; a missing id comes last.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    linked = minhash_bins.with_next(docs, "doc_id", minhash_bins.fingerprints)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.col("next.text"), half))
    facts = once(
        edited,
        lambda e: once(
            minhash_bins.fingerprint(e),
            lambda f: F.struct(
                F.sha2(e, 256).alias("edited_sha256"),
                f.alias("edited_fingerprint"),
                minhash_bins.likeness(F.col("fingerprint"), f).alias("near_edited"),
            ),
        ),
    )
    return linked.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fingerprint",
        minhash_bins.likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
        facts.alias("facts"),
    ).select("doc_id", "n_chars", "facts.edited_sha256", "fingerprint", "facts.edited_fingerprint", "facts.near_edited", "near_next")


@register("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = pareto_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes they decode to."""
    ranks = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_tree.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid_cnn.predict(docs, langid_cnn.fit(docs))


@register(
    "op6_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT r.x AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept
    FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return pq_dedup.links(table(spark, sf_dir, "embeddings"))


_SPANS_SQL = """array_to_string(list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform({t}[1:i - 1], lambda x: length(x.role) + length(x.text) + 24)), 0) + 22)::BIGINT
    || ':' || (list_sum(list_transform({t}[1:i], lambda x: length(x.role) + length(x.text) + 24)))::BIGINT), ',')"""
_TEXT_SQL = """array_to_string(list_transform({t},
    lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')"""


@register(
    "op7_preference_format",
    f"""
    WITH c AS (SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}}
                    ORDER BY coalesce(turn, 4611686018427387904), coalesce(role, 'unknown'), coalesce(text, '')) AS turns
               FROM conversations GROUP BY conv_id),
    s AS (SELECT conv_id, turns[1] AS opening, conv_id % 64 AS salt FROM c),
    a AS (SELECT *, row_number() OVER w AS place, lead(conv_id) OVER w AS nxt FROM s
          WINDOW w AS (PARTITION BY opening, salt ORDER BY conv_id)),
    o AS (SELECT conv_id, opening FROM a WHERE place % 2 = 1 AND nxt IS NULL),
    b AS (SELECT *, row_number() OVER w AS place, lead(conv_id) OVER w AS nxt FROM o
          WINDOW w AS (PARTITION BY opening ORDER BY conv_id)),
    p AS (SELECT conv_id AS chosen_id, nxt AS rejected_id FROM a WHERE place % 2 = 1 AND nxt IS NOT NULL
          UNION ALL SELECT conv_id, nxt FROM b WHERE place % 2 = 1),
    j AS (SELECT chosen_id, rejected_id, x.turns AS ta, y.turns AS tb FROM p JOIN c x ON x.conv_id = chosen_id
          LEFT JOIN c y ON y.conv_id = rejected_id),
    k AS (SELECT *, CASE WHEN tb IS NULL THEN 0 ELSE least(
              coalesce(list_filter(range(1, least(len(ta), len(tb)) + 1), lambda i: ta[i] <> tb[i])[1] - 1, least(len(ta), len(tb))),
              coalesce(list_max(list_filter(range(1, len(ta) + 1), lambda i: ta[i].role = 'assistant')) - 1, len(ta)),
              coalesce(list_max(list_filter(range(1, len(tb) + 1), lambda i: tb[i].role = 'assistant')) - 1, len(tb))) END AS n
          FROM j),
    m AS (SELECT *, ta[n + 1:] AS ca, tb[n + 1:] AS cb FROM k)
    SELECT chosen_id, rejected_id, n::INT AS n_prompt_turns, {_TEXT_SQL.format(t="ta[1:n]")} AS prompt,
           {_TEXT_SQL.format(t="ca")} AS chosen, {_SPANS_SQL.format(t="ca")} AS chosen_spans,
           CASE WHEN tb IS NOT NULL THEN {_TEXT_SQL.format(t="cb")} END AS rejected,
           CASE WHEN tb IS NOT NULL THEN {_SPANS_SQL.format(t="cb")} END AS rejected_spans FROM m
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows of all conversations; those with the same first turn are paired."""
    turns = table(spark, sf_dir, "conversations")
    rows = preference.formatted(turns, preference.paired_by_opening(preference.conversations(turns)))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(spans)

    return rows.select(
        "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", listed("chosen_spans"), "rejected", listed("rejected_spans")
    )


@register("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_density.extract(table(spark, sf_dir, "pages"))


@register("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three words and their components within three bits."""
    return simhash_tiles.groups(table(spark, sf_dir, "documents"), words=3, radius=3)


#: crc32 of the bytes whose hexadecimal digits stand in a column, by the table ``t``.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, length({0}) // 2),
        lambda i: ('0x' || substr({0}, 2 * i + 1, 2))::UBIGINT)),
        lambda c, v: xor(c >> 8, t[((xor(c, v) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"""


@register(
    "op10_line_dedup",
    f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
    l AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
    k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
    u AS (SELECT DISTINCT rid, source, key FROM k WHERE key <> ''),
    crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
    x AS (SELECT key, hex(key) AS a, hex(reverse(key)) AS b, t FROM (SELECT DISTINCT key FROM u), crc),
    y AS (SELECT key, {_CRC.format('a')} AS c0, {_CRC.format('b')} AS c1 FROM x),
    w AS (SELECT u.*, (c0 + 1)::DOUBLE / length(key)::DOUBLE AS p0, (c1 + 1)::DOUBLE / length(key)::DOUBLE AS p1 FROM u JOIN y USING (key)),
    f AS (SELECT rid, min(source) AS source, min_by(key, p0, 2) AS f0, min_by(key, p1, 2) AS f1 FROM w GROUP BY rid),
    n AS (SELECT w.source, key, count(DISTINCT CASE WHEN f0[1] <> key THEN f0[1] ELSE coalesce(f0[2], key) END) AS n0,
                 count(DISTINCT CASE WHEN f1[1] <> key THEN f1[1] ELSE coalesce(f1[2], key) END) AS n1
          FROM w JOIN f USING (rid) GROUP BY w.source, key),
    h AS (SELECT source, count(DISTINCT f0[1]) AS h0, count(DISTINCT f1[1]) AS h1 FROM f GROUP BY source),
    bad AS (SELECT n.source, n.key FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source
            WHERE least(n0, n1) >= {site_lines.LEAST_PAGES} AND n0 > {site_lines.RATIO}::DOUBLE * h0
              AND n1 > {site_lines.RATIO}::DOUBLE * h1),
    m AS (SELECT k.*, bad.key IS NOT NULL AS b FROM k LEFT JOIN bad
          ON bad.key = k.key AND bad.source IS NOT DISTINCT FROM k.source),
    g AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT b) AS kept, count(*) FILTER (b) AS dropped
          FROM m GROUP BY rid)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.kept, '') END AS text,
           coalesce(g.dropped, 0)::BIGINT AS dropped_lines FROM d LEFT JOIN g ON g.rid = d.rid
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return site_lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the checksum of ``conv_id:turn``, and ``times`` a row stands.

    A missing id or turn is one space in the checksum; a missing role or text becomes one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )


@register("op12_conversation_repair", turn_repair_sql.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    repaired = turn_repair.repair(damaged(table(spark, sf_dir, "conversations")), times_col="times")
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    return repaired.select("*", digest).drop("repaired")


@register("op13_sentence_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text they decode to."""
    model = piece_rounds.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_rounds.encode(table(spark, sf_dir, "documents"), model, digests=True)
