"""DuckDB text of the survey-shaped views (the oracle side of ``sources.views``).

Each oracle query is ``WITH <views> <body>``; ``with_views`` pulls in the
views a body needs, in dependency order.  The literal tables are printed
from the same fixed-value lists the Spark side uses.
"""

from __future__ import annotations

from quorum.sources import views as V


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, (list, tuple)):
        return "CAST([" + ", ".join(_lit(x) for x in v) + "] AS DOUBLE[])"
    return str(v)


def _values(rows, cols) -> str:
    body = ",\n    ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n    {body}) AS t({', '.join(cols)})"


_ANSWER = ("CASE WHEN human_id % 17 = 0 THEN CAST(NULL AS DOUBLE) "
           "WHEN human_id % 29 = 0 THEN CAST(-8 AS DOUBLE) ELSE {valid} END")

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "respondents": ("""
  SELECT o.o_orderkey AS human_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS wave,
         CASE WHEN o.o_orderkey % 31 = 0 THEN CAST(NULL AS DOUBLE) ELSE o.o_totalprice END AS weight,
         c.c_mktsegment AS segment, r.r_name AS region, n.n_name AS nation,
         CAST(floor(c.c_acctbal / 1000) AS INTEGER) AS balance_code,
         o.o_custkey AS cust_id, o.o_orderpriority AS priority, o.o_orderstatus AS status
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "responses": ("""
  SELECT human_id, wave, 'PRIORITY_W' || CAST(wave AS VARCHAR) AS qkey, 'PRIORITY' AS var,
         """ + _ANSWER.format(valid="CAST(substr(priority, 1, 1) AS DOUBLE)") + """ AS code,
         weight, segment, region, nation, balance_code, cust_id
  FROM respondents
  UNION ALL
  SELECT human_id, wave, 'STATUS_W' || CAST(wave AS VARCHAR) AS qkey, 'STATUS' AS var,
         """ + _ANSWER.format(valid="CASE status WHEN 'F' THEN CAST(1 AS DOUBLE) WHEN 'O' THEN CAST(2 AS DOUBLE) "
                                    "WHEN 'P' THEN CAST(3 AS DOUBLE) END") + """ AS code,
         weight, segment, region, nation, balance_code, cust_id
  FROM respondents""", ("respondents",)),
    "line_answers": ("""
  SELECT l.l_orderkey * 8 + l.l_linenumber AS human_id, c.c_mktsegment AS segment,
         CASE WHEN (l.l_orderkey * 8 + l.l_linenumber) % 13 = 0 THEN CAST(NULL AS DOUBLE)
              WHEN l.l_returnflag = 'A' THEN CAST(1 AS DOUBLE) WHEN l.l_returnflag = 'N' THEN CAST(2 AS DOUBLE)
              WHEN l.l_returnflag = 'R' THEN CAST(3 AS DOUBLE) END AS RETURNFLAG,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(1 AS DOUBLE) WHEN l.l_linestatus = 'O' THEN CAST(2 AS DOUBLE) END AS LINESTATUS,
         CASE WHEN (l.l_orderkey * 8 + l.l_linenumber) % 11 = 0 THEN CAST(NULL AS DOUBLE)
              ELSE CAST(ceil(l.l_quantity / 5) AS DOUBLE) END AS QTY,
         CAST(round(l.l_discount * 100) + 1 AS DOUBLE) AS DISCOUNT
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey""", ()),
    "line_responses": ("""
  SELECT human_id, segment, 'RETURNFLAG' AS qkey, RETURNFLAG AS code FROM line_answers WHERE RETURNFLAG IS NOT NULL
  UNION ALL SELECT human_id, segment, 'LINESTATUS', LINESTATUS FROM line_answers WHERE LINESTATUS IS NOT NULL
  UNION ALL SELECT human_id, segment, 'QTY', QTY FROM line_answers WHERE QTY IS NOT NULL
  UNION ALL SELECT human_id, segment, 'DISCOUNT', DISCOUNT FROM line_answers WHERE DISCOUNT IS NOT NULL""",
                       ("line_answers",)),
    "codebook": (_values(V.CODEBOOK_ROWS, ["var", "pos", "code", "label"]), ()),
    "variables": (_values(V.VARIABLE_ROWS, ["var", "label"]), ()),
    "group_codes": (_values(V.GROUP_CODE_ROWS, ["attribute", "grp", "code"]), ()),
}


def with_views(*names: str, ctes: str = "") -> str:
    """``WITH`` clause holding ``names`` (and what they need) then ``ctes``."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for d in VIEWS[n][1]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n][0]}\n)" for n in order]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n"


VIEWS.update({
    # V9 in long form: one row per (row_idx, j) option, p = gold, q = model, o = ordinal
    "lg_x": ("""
  SELECT row_idx, label, k, CAST(x AS DOUBLE) AS x, i FROM (
    SELECT vec_id AS row_idx, label, 5 + label AS k, unnest(embedding) AS x,
           unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""", ()),
    "lg_sm": ("""
  SELECT row_idx, k, i, x, exp(x - max(x) OVER (PARTITION BY row_idx)) AS e FROM lg_x""", ("lg_x",)),
    "lg_q": ("""
  SELECT row_idx, k, i AS j, s / sum(s) OVER (PARTITION BY row_idx) AS q FROM (
    SELECT row_idx, k, i, e / sum(e) OVER (PARTITION BY row_idx) AS s FROM lg_sm) WHERE i <= k""", ("lg_sm",)),
    "lg_g0": ("""
  SELECT row_idx, k, i - 32 AS j, exp(x - max(x) OVER (PARTITION BY row_idx)) AS e
  FROM lg_x WHERE i >= 33 AND i < 33 + k""", ("lg_x",)),
    "lg_long": ("""
  SELECT g.row_idx, g.k, g.j, g.e / sum(g.e) OVER (PARTITION BY g.row_idx) AS p, q.q,
         CASE WHEN g.row_idx % 4 = 0 AND g.j = g.k THEN CAST(-1 AS DOUBLE) ELSE CAST(g.j AS DOUBLE) END AS o
  FROM lg_g0 g JOIN lg_q q ON q.row_idx = g.row_idx AND q.j = g.j""", ("lg_g0", "lg_q")),
})
