"""Queries: length batches, stripes, packing, padding, label masks, target records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.functions import metrics as M
from quorum.operators import sequences as S
from quorum.plans.registry import query
from quorum.sources.driver import table

BATCH = 4
REPLICAS = 3
CHUNK = 512
SEED = 42


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")


_LB_SQL = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents),
b AS (SELECT doc_id, rank, rank // {BATCH} AS batch FROM r WHERE rank < (n // {BATCH}) * {BATCH}),
bp AS (SELECT batch, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(batch AS VARCHAR)), batch) - 1 AS batch_pos
       FROM (SELECT DISTINCT batch FROM b))
SELECT b.doc_id, b.rank, b.batch, bp.batch_pos FROM b JOIN bp ON bp.batch = b.batch"""


@query("length_batches", _LB_SQL)
def q_length_batches(spark, sf_dir):
    b = S.length_batches(_docs(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id", BATCH, seed=SEED)
    return b.select("doc_id", "rank", "batch", "batch_pos")


@query("batch_stripes", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank FROM documents),
b AS (SELECT doc_id, rank // {BATCH} AS batch FROM r),
bp AS (SELECT batch, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(batch AS VARCHAR)), batch) - 1 AS batch_pos,
              count(*) OVER () AS nb FROM (SELECT DISTINCT batch FROM b))
SELECT b.doc_id, bp.batch_pos, CAST(bp.batch_pos % {REPLICAS} AS INTEGER) AS replica
FROM b JOIN bp ON bp.batch = b.batch WHERE bp.batch_pos < (bp.nb // {REPLICAS}) * {REPLICAS}""")
def q_batch_stripes(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "n_chars")
    b = S.length_batches(d, "n_chars", "doc_id", BATCH, drop_last=False, seed=SEED)
    return S.batch_stripes(b, REPLICAS, -(-d.count() // BATCH)).select("doc_id", "batch_pos", "replica")


def _tokens(col="text"):
    return F.array_remove(F.split(F.col(col), r"\s+"), "")


@query("pack_sequences", f"""
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tok,
                  generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), 1) AS i
           FROM documents),
g AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS gpos, count(*) OVER () AS total FROM t)
SELECT gpos // {CHUNK} AS chunk, gpos % {CHUNK} AS pos, tok AS token FROM g
WHERE (gpos // {CHUNK} + 1) * {CHUNK} < total""")
def q_pack_sequences(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text")
    p = S.pack_sequences(d, "tokens", ["doc_id"], CHUNK, made=_tokens())
    return p.select("chunk", F.posexplode("tokens").alias("pos", "token")).select(
        "chunk", F.col("pos").cast("bigint").alias("pos"), "token")


@query("head_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_idx, CASE WHEN row_idx < n // 20 THEN 'eval' ELSE 'train' END AS split FROM r""")
def q_head_split(spark, sf_dir):
    d, n = S.counted_row_index(_docs(spark, sf_dir).select("doc_id"), ["doc_id"])
    return d.select("doc_id", "row_idx",
                    F.when(F.col("row_idx") < n // 20, "eval").otherwise("train").alias("split"))


@query("left_pad", f"""
WITH t AS (SELECT doc_id, n_chars, {S.sql_token_ids('text')} AS ids FROM documents),
r AS (SELECT doc_id, ids, len(ids) AS n_tok, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // {BATCH} AS batch FROM t),
p AS (SELECT doc_id, batch, ids, n_tok, max(n_tok) OVER (PARTITION BY batch) AS padded_len FROM r),
x AS (SELECT *, unnest(range(padded_len)) AS pos FROM p)
SELECT doc_id, batch, CAST(padded_len - n_tok AS INTEGER) AS pad_len, padded_len AS target_token_position, pos,
       CASE WHEN pos < padded_len - n_tok THEN 0 ELSE ids[pos - (padded_len - n_tok) + 1] END AS id,
       CASE WHEN pos < padded_len - n_tok THEN 0 ELSE 1 END AS mask FROM x""")
def q_left_pad(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "n_chars", S.whitespace_ids("text").alias("ids"))
    d = d.withColumn("target", F.size("ids"))
    b = S.length_batches(d, "n_chars", "doc_id", BATCH, drop_last=False, shuffle=False)
    p = S.left_pad(b, "ids", "target")
    both = F.arrays_zip(F.col("input_ids").alias("id"), F.col("attention_mask").alias("mask"))
    return p.select("doc_id", "batch", "pad_len", F.col("target_token_position").cast("bigint").alias("target_token_position"),
                    F.posexplode(both).alias("pos", "x")).select(
        "doc_id", "batch", "pad_len", "target_token_position", F.col("pos").cast("bigint").alias("pos"), "x.id", "x.mask")


# ---- F21 / F22 on the prompt table, all steering types
def _prompts(spark, sf_dir):
    from quorum.plans.prompt_queries import prompt_table
    return prompt_table(spark, sf_dir, n_tokens=0)


def _prompt_sql(select: str) -> str:
    from quorum.plans.distribution_queries import _DIST_VIEWS
    from quorum.plans.oracle_views import with_views
    from quorum.plans.prompt_queries import _PROMPT_CTES
    return with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
qa AS (SELECT qkey, attribute, grp, steering_type, input_prompt,
              """ + S.sql_token_ids("input_prompt") + """ AS ids FROM pr),""") + select


_ANSWER = "A </s>"


@query("label_mask", _prompt_sql(f"""
SELECT qkey, attribute, grp, steering_type, pos, both_ids[pos + 1] AS id,
       CASE WHEN pos < n_p THEN {S.IGNORE_INDEX} ELSE both_ids[pos + 1] END AS label, 1 AS mask
FROM (SELECT *, unnest(range(len(both_ids))) AS pos
      FROM (SELECT *, len(ids) AS n_p, list_concat(ids, {S.sql_token_ids("'" + _ANSWER + "'")}) AS both_ids FROM qa))"""))
def q_label_mask(spark, sf_dir):
    ids, labels, mask = S.label_mask(S.token_ids("input_prompt"), S.token_ids(F.lit(_ANSWER)))
    z = F.arrays_zip(ids.alias("id"), labels.alias("label"), mask.alias("mask"))
    r = _prompts(spark, sf_dir).select("qkey", "attribute", "grp", "steering_type", F.posexplode(z).alias("pos", "x"))
    return r.select("qkey", "attribute", "grp", "steering_type", F.col("pos").cast("bigint").alias("pos"), "x.id", "x.label", "x.mask")


@query("target_record", _prompt_sql("""
SELECT q.qkey, q.attribute, q.grp, q.steering_type, CAST(len(q.ids) AS BIGINT) AS target_token_position,
       CAST(list_sum(list_transform(q.ids, lambda x: x % 1000003)) AS BIGINT) AS ids_sum, CAST(26 AS INTEGER) AS n_dist,
       round(s.s + d.refusal_rate, 9) AS dist_sum, max(CAST(o.opt_idx AS DOUBLE)) AS ord_max
FROM qa q JOIN (SELECT qkey, attribute, grp, sum(p) AS s FROM dist GROUP BY ALL) s
  ON s.qkey = q.qkey AND s.attribute = q.attribute AND s.grp = q.grp
JOIN (SELECT DISTINCT qkey, attribute, grp, refusal_rate FROM dist) d
  ON d.qkey = q.qkey AND d.attribute = q.attribute AND d.grp = q.grp
JOIN dist o ON o.qkey = q.qkey AND o.attribute = q.attribute AND o.grp = q.grp
GROUP BY q.qkey, q.attribute, q.grp, q.steering_type, q.ids, s.s, d.refusal_rate"""))
def q_target_record(spark, sf_dir):
    r = _prompts(spark, sf_dir).select("qkey", "attribute", "grp", "steering_type",
                                       *S.target_record("input_prompt", "output_dist", "ordinal"))
    from quorum.plans.distribution_queries import r9
    return r.select("qkey", "attribute", "grp", "steering_type", "target_token_position",
                    F.aggregate(F.transform("input_ids", lambda x: x % 1000003), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids_sum"),
                    F.size("response_distribution").alias("n_dist"),
                    r9(M.array_sum("response_distribution")).alias("dist_sum"),
                    F.array_max("ordinal_info").alias("ord_max"))
