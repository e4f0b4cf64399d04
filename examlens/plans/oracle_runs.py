"""SQL twins of the option-order and later-run adapters, added to ``oracle_tables.TABLES``."""

from __future__ import annotations

from examlens.operators.options import SEED
from examlens.plans.oracle_tables import TABLES, _attempts, _scored, h, letter

_ORDER = (
    "list_transform(list_sort(list_transform(['A','B','C','D','E'], lambda x: "
    f"{{'h': {h(str(SEED), 'item_id', 'x')}, 'l': x}})), lambda e: e.l)"
)
_SOURCES = ", ".join(f"ord[{i + 1}] AS new_{x}_source" for i, x in enumerate("ABCDE"))


def mapping_sql(source: str) -> str:
    return f"""SELECT item_id, kept_order_reason, answer AS old_answer,
        {letter("list_position(ord, answer) - 1")} AS new_answer, {_SOURCES}
    FROM (SELECT *, CASE WHEN kept_order_reason = '' THEN {_ORDER}
                         ELSE ['A','B','C','D','E'] END AS ord FROM {source})"""


_TEXT = """SELECT p_partkey AS item_id, substr('ABCDE', CAST(p_partkey % 5 AS INTEGER) + 1, 1) AS answer,
    CASE p_partkey % 9 WHEN 1 THEN p_name || ': welche Aussage B gilt?'
         WHEN 2 THEN p_name || ' wie in der obigen Figur'
         WHEN 3 THEN p_name || ' und (C) daneben' ELSE p_name END AS problem_statement,
    CASE WHEN p_partkey % 9 = 4 THEN '(A)' ELSE p_brand END AS sol_A,
    CASE WHEN p_partkey % 9 = 5 THEN 'A und C' ELSE p_type END AS sol_B,
    p_size::VARCHAR AS sol_C,
    CASE WHEN p_partkey % 9 = 6 THEN NULL ELSE 'size ' || p_size::VARCHAR END AS sol_D,
    CASE WHEN p_partkey % 9 = 7 THEN ' e. ' ELSE 'none of these' END AS sol_E,
    {hash} % 10 = 0 AS has_option_image FROM part""".format(hash=h("'img'", "p_partkey"))

_PLACE = "list_position([new_A_source, new_B_source, new_C_source, new_D_source, new_E_source], predicted)"

TABLES.update(
    {
        "item_texts": ([], _TEXT),
        "order_mapping": (
            ["items"],
            mapping_sql(
                "(SELECT *, CASE WHEN has_option_image THEN 'option images' ELSE '' END"
                " AS kept_order_reason FROM items)"
            ),
        ),
        "o_attempts": (["items"], _attempts("o", "items", 0)),
        "f_attempts": (["items"], _attempts("f", "items", 0)),
        "order_attempts": (
            ["o_attempts", "order_mapping"],
            f"""SELECT model, item_id, CASE WHEN {_PLACE} > 0 THEN {letter(_PLACE + ' - 1')}
                       ELSE predicted END AS predicted
                FROM o_attempts JOIN order_mapping USING (item_id) WHERE model = 'm4'""",
        ),
        # mapping back gives the originally drawn letter; the position is kept beside it
        "unmapped": (
            ["order_attempts", "order_mapping"],
            """SELECT model, item_id, upper(trim(coalesce(predicted, ''))) AS position,
                      CASE upper(trim(coalesce(predicted, ''))) WHEN 'A' THEN new_A_source
                        WHEN 'B' THEN new_B_source WHEN 'C' THEN new_C_source
                        WHEN 'D' THEN new_D_source WHEN 'E' THEN new_E_source
                        ELSE predicted END AS predicted
               FROM order_attempts JOIN order_mapping USING (item_id)""",
        ),
        "fallback_attempts": (
            ["f_attempts"],
            f"""SELECT model, item_id, predicted, flag < 8 AS fallback_parse,
                       flag >= 4 AND flag < 12 AS output_capped,
                       CASE WHEN flag < 6 THEN {letter('item_id % 5')} END AS stated_answer
                FROM (SELECT *, {h("'fb'", 'item_id')} % 100 AS flag FROM f_attempts
                      WHERE model = 'm3')""",
        ),
        "later_attempts": (
            ["unmapped", "repeat_attempts", "fallback_attempts"],
            """SELECT 'm4__option_order' AS model, item_id, predicted FROM unmapped
               UNION ALL SELECT 'm4__repeat', item_id, predicted FROM repeat_attempts
                         WHERE model = 'm4'
               UNION ALL SELECT 'm3__later', item_id, predicted FROM fallback_attempts
               UNION ALL SELECT 'm3__later__stated', item_id,
                         CASE WHEN fallback_parse THEN stated_answer ELSE predicted END
                         FROM fallback_attempts
               UNION ALL SELECT 'm3__later__unparsed', item_id,
                         CASE WHEN NOT fallback_parse THEN predicted END FROM fallback_attempts""",
        ),
        "later_scored": (["items", "later_attempts"], _scored("later_attempts")),
        "later_base": (
            ["later_scored", "scored"],
            "SELECT * FROM later_scored UNION ALL BY NAME SELECT * FROM scored WHERE model = 'm4'",
        ),
        "later_scores": (
            ["later_base", "adjustments"],
            TABLES["scores"][1].replace("FROM scored JOIN", "FROM later_base JOIN"),
        ),
        "later_panel": (
            ["later_scores", "human", "composition"],
            """SELECT s.*, h.human_pct, h.human_mean_source, h.histogram_pct, c.multimodal_share,
                      c.associated_image_share, c.option_image_share
               FROM (SELECT year, exam, model AS series, model_pct FROM later_scores
                     UNION ALL SELECT year, exam, 'm4__two_run_mean', avg(model_pct)
                     FROM later_scores WHERE model IN ('m4', 'm4__repeat') GROUP BY year, exam
                     UNION ALL SELECT year, exam, 'm4__three_run_mean', avg(model_pct)
                     FROM later_scores WHERE model IN ('m4', 'm4__repeat', 'm4__option_order')
                     GROUP BY year, exam) s
               JOIN human h USING (year, exam) JOIN composition c USING (year, exam)""",
        ),
    }
)
