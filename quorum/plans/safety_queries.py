"""Queries: safety examples, moderation, instruction and dialogue prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.functions import rng
from quorum.operators import safety as SF
from quorum.operators.sequences import sql_token_ids, token_ids
from quorum.plans.registry import query
from quorum.sources.driver import table

SEED = 42
# The guard categories and instruction template used here.
CATEGORIES = [
    ("Violence", "Threats or praise of physical harm."),
    ("Hate", "Attacks on people for who they are."),
    ("Harassment", "Targeted abuse or intimidation."),
    ("Self-harm", "Encouragement of self-injury."),
    ("Sexual content", "Explicit sexual material."),
    ("Child safety", "Anything endangering minors."),
    ("Weapons", "Help acquiring or building weapons."),
    ("Drugs", "Help producing or trading illegal drugs."),
    ("Fraud", "Scams, forgery or theft of money."),
    ("Privacy", "Exposure of personal data."),
    ("Extremism", "Support for violent extremist groups."),
    ("Malware", "Code or steps to attack computer systems."),
]
INSTRUCTIONS = ("Task: decide whether the conversation below is unsafe under these categories.\n"
                "<categories>\n{guidelines}\n</categories>\n<conversation>\n{conversation}\n</conversation>\n"
                "Answer safe or unsafe; if unsafe, list the violated categories.")
AUG_EXPLANATION = "Safe here: its risks belong to categories that are not checked."
MOD_CATEGORIES = list(SF.MODERATION_CODES)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def examples(spark, sf_dir):
    """V7: labelled documents as safety examples (whole texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    e = d.join(lab, "doc_id")
    unsafe = F.col("toxic") == 1
    codes = F.array_distinct(F.array(F.concat(F.lit("O"), (F.col("doc_id") % 12 + 1).cast("string")),
                                     F.concat(F.lit("O"), (F.floor(F.col("doc_id") / 12) % 12 + 1).cast("string"))))
    return e.select(
        F.col("doc_id").alias("id"), F.col("text").alias("prompt"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("N/A")).when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Reply in "), F.col("lang"))).alias("response"),
        F.when(unsafe, codes).otherwise(F.array().cast("array<string>")).alias("violated_category_codes"),
        F.when(unsafe, "unsafe").otherwise("safe").alias("label"),
        F.when(unsafe, "Flagged content.").otherwise("Nothing flagged.").alias("explanation"))


def formatted(spark, sf_dir):
    return SF.format_examples(examples(spark, sf_dir), CATEGORIES, INSTRUCTIONS, add_dropped_violated=True,
                              dropped_violated_explanation=AUG_EXPLANATION, seed=SEED)


def _u(key_sql: str) -> str:
    return f"(cast(('0x' || substr(md5({key_sql}), 1, 8)) AS UBIGINT) / 4294967296.0)"


_CATS = ", ".join(f"({i}, {_sq(n)}, {_sq(d)})" for i, (n, d) in enumerate(CATEGORIES))
_GUARD_CTES = f"""
WITH ex AS (SELECT d.doc_id AS id, d.text AS prompt,
                   CASE WHEN d.doc_id % 5 = 0 THEN 'N/A' WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'Reply in ' || d.lang END AS response,
                   CASE WHEN l.toxic = 1 THEN 'unsafe' ELSE 'safe' END AS label,
                   CASE WHEN l.toxic = 1 THEN 'Flagged content.' ELSE 'Nothing flagged.' END AS explanation
            FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
cat AS (SELECT * FROM (VALUES {_CATS}) AS t(ci, name, descr)),
vio AS (SELECT DISTINCT id, ci FROM (SELECT id, id % 12 AS ci FROM ex WHERE label = 'unsafe'
                                     UNION ALL SELECT id, (id // 12) % 12 FROM ex WHERE label = 'unsafe')),
nv AS (SELECT e.id, c.ci FROM ex e CROSS JOIN cat c
       WHERE NOT EXISTS (SELECT 1 FROM vio v WHERE v.id = e.id AND v.ci = c.ci)),
mm AS (SELECT e.id, e.label, count(nv.ci) AS m FROM ex e LEFT JOIN nv ON nv.id = e.id GROUP BY e.id, e.label),
na AS (SELECT id, CASE WHEN n0 = 12 THEN 11 ELSE n0 END AS n FROM (
         SELECT id, CAST(floor({_u("'42:' || CAST(id AS VARCHAR) || ':drop_nonviolated:n'")} * (m + 1)) AS INTEGER) AS n0 FROM mm)),
nb AS (SELECT id, label, m, CAST(floor({_u("'42:' || CAST(id AS VARCHAR) || ':drop_violated:n'")} * m) AS INTEGER) AS n FROM mm),
rk AS (SELECT id, ci,
              row_number() OVER (PARTITION BY id ORDER BY md5('42:' || CAST(id AS VARCHAR) || ':drop_nonviolated:drop:' || CAST(ci AS VARCHAR))) AS ra,
              row_number() OVER (PARTITION BY id ORDER BY md5('42:' || CAST(id AS VARCHAR) || ':drop_violated:drop:' || CAST(ci AS VARCHAR))) AS rb
       FROM nv),
inc AS (SELECT e.id, 'base' AS variant, c.ci FROM ex e CROSS JOIN cat c
        UNION ALL SELECT e.id, 'drop_nonviolated', c.ci FROM ex e CROSS JOIN cat c
          WHERE NOT EXISTS (SELECT 1 FROM rk JOIN na ON na.id = rk.id WHERE rk.id = e.id AND rk.ci = c.ci AND rk.ra <= na.n)
        UNION ALL SELECT rk.id, 'drop_violated', rk.ci FROM rk JOIN nb ON nb.id = rk.id
          WHERE nb.label = 'unsafe' AND nb.m > 0 AND rk.rb > nb.n),
ord AS (SELECT id, variant, ci, row_number() OVER (PARTITION BY id, variant
              ORDER BY md5('42:' || CAST(id AS VARCHAR) || ':' || variant || ':order:' || CAST(ci AS VARCHAR))) AS r FROM inc),
gl AS (SELECT o.id, o.variant, string_agg(CASE WHEN o.r > 1 THEN chr(10) ELSE '' END || 'O' || CAST(o.r AS VARCHAR) || ': '
              || c.name || '. ' || chr(10) || c.descr, '' ORDER BY o.r) AS guidelines
       FROM ord o JOIN cat c ON c.ci = o.ci GROUP BY o.id, o.variant),
cd AS (SELECT o.id, o.variant, string_agg('O' || CAST(o.r AS VARCHAR), ',' ORDER BY 'O' || CAST(o.r AS VARCHAR)) AS codes
       FROM ord o JOIN vio v ON v.id = o.id AND v.ci = o.ci WHERE o.variant <> 'drop_violated' GROUP BY o.id, o.variant),
fm AS (SELECT g.id, g.variant,
              replace(replace({_sq(INSTRUCTIONS)}, '{{guidelines}}', g.guidelines), '{{conversation}}',
                      CASE WHEN e.response IS NULL OR e.response = 'N/A' THEN 'human: ' || e.prompt
                           ELSE 'human: ' || e.prompt || chr(10) || chr(10) || 'chatbot: ' || e.response END) AS guard_prompt,
              CASE WHEN g.variant = 'drop_violated' THEN 'safe' || chr(10) || 'Explanation: ' || {_sq(AUG_EXPLANATION)}
                   WHEN e.label = 'unsafe' THEN 'unsafe' || chr(10) || coalesce(cd.codes, '') || chr(10) || 'Explanation: ' || e.explanation
                   ELSE 'safe' || chr(10) || 'Explanation: ' || e.explanation END AS guard_target
       FROM gl g JOIN ex e ON e.id = g.id LEFT JOIN cd ON cd.id = g.id AND cd.variant = g.variant)
"""


@query("guard_format", _GUARD_CTES + "SELECT id, variant, guard_prompt || ' ' || guard_target AS text FROM fm")
def q_guard_format(spark, sf_dir):
    return formatted(spark, sf_dir).select("id", "variant", "text")


@query("guard_prompt", _GUARD_CTES + "SELECT id, guard_prompt FROM fm WHERE variant = 'base'")
def q_guard_prompt(spark, sf_dir):
    return formatted(spark, sf_dir).where(F.col("variant") == "base").select("id", "guard_prompt")


@query("guard_target", _GUARD_CTES + "SELECT id, guard_target FROM fm WHERE variant = 'base'")
def q_guard_target(spark, sf_dir):
    return formatted(spark, sf_dir).where(F.col("variant") == "base").select("id", "guard_target")


@query("guard_aug_nonviolated", _GUARD_CTES + """
SELECT id, guard_prompt, guard_target FROM fm WHERE variant = 'drop_nonviolated'""")
def q_guard_aug_nonviolated(spark, sf_dir):
    return (formatted(spark, sf_dir).where(F.col("variant") == "drop_nonviolated")
            .select("id", "guard_prompt", "guard_target"))


@query("guard_aug_violated", _GUARD_CTES + """
SELECT id, guard_prompt, guard_target FROM fm WHERE variant = 'drop_violated'""")
def q_guard_aug_violated(spark, sf_dir):
    return (formatted(spark, sf_dir).where(F.col("variant") == "drop_violated")
            .select("id", "guard_prompt", "guard_target"))


# ---- moderation table (V7): scores per moderation category from hash draws
def moderation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    pairs = [F.when(rng.hash_uniform(SEED, F.col("doc_id"), F.lit("inc"), F.lit(c)) < 0.5,
                    F.concat(F.lit(f"['{c}', "),
                             F.format_number(rng.hash_uniform(SEED, F.col("doc_id"), F.lit(c)), 6), F.lit("]")))
             for c in MOD_CATEGORIES]
    lit = F.concat(F.lit("["), F.concat_ws(", ", *pairs), F.lit("]"))
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("user_input"), F.col("source").alias("model_output"),
        F.col("toxic").alias("toxicity"), lit.alias("openai_moderation"))


_MOD_VALUES = ", ".join(f"({i}, {_sq(c)}, {_sq(SF.MODERATION_CODES[c])})" for i, c in enumerate(MOD_CATEGORIES))
_MOD_CTES = f"""
WITH mc AS (SELECT * FROM (VALUES {_MOD_VALUES}) AS t(pos, cat, code)),
sc AS (SELECT d.doc_id, mc.pos, mc.cat, mc.code,
              round({_u("'42:' || CAST(d.doc_id AS VARCHAR) || ':' || mc.cat")}, 6) AS score
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id CROSS JOIN mc
       WHERE {_u("'42:' || CAST(d.doc_id AS VARCHAR) || ':inc:' || mc.cat")} < 0.5),
top AS (SELECT doc_id, arg_min(code, struct_pack(ns := -score, pos := pos)) AS code FROM sc GROUP BY doc_id)
"""


@query("primary_category", _MOD_CTES + """
SELECT d.doc_id AS id, t.code FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN top t ON t.doc_id = d.doc_id""")
def q_primary_category(spark, sf_dir):
    m = moderation(spark, sf_dir)
    return m.select("id", SF.primary_category("openai_moderation").alias("code"))


@query("safety_jsonl", _MOD_CTES + """
SELECT d.doc_id AS id, d.text AS prompt, d.source AS generation, CASE WHEN l.toxic = 0 THEN 'good' ELSE 'bad' END AS label,
       t.code AS unsafe_code
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN top t ON t.doc_id = d.doc_id""")
def q_safety_jsonl(spark, sf_dir):
    r = SF.safety_record(moderation(spark, sf_dir))
    return r.select("id", "prompt", "generation", "label", F.col("unsafe_content")[0].alias("unsafe_code"))


def moderation_examples(spark, sf_dir):
    """moderation rows -> safety examples (unsafe rows carry the mapped
    category) -> formatted text -> whitespace token ids, labels = ids."""
    m = moderation(spark, sf_dir)
    cat = SF.primary_category("openai_moderation")
    ex = m.select("id", F.col("user_input").alias("prompt"), F.col("model_output").alias("response"),
                  F.when((F.col("toxicity") == 1) & cat.isNotNull(), F.array(cat))
                   .otherwise(F.array().cast("array<string>")).alias("violated_category_codes"),
                  F.when(F.col("toxicity") == 1, "unsafe").otherwise("safe").alias("label"),
                  F.lit(None).cast("string").alias("explanation"))
    f = SF.format_examples(ex, CATEGORIES, INSTRUCTIONS, shuffle=False, explanation_position=None,
                           add_dropped_nonviolated=False, seed=SEED)
    ids = token_ids("text")
    return f.select("id", ids.alias("input_ids"), ids.alias("labels"),
                    F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def _moderation_sql():
    guidelines = "".join((chr(10) if i else "") + f"O{i + 1}: {n}. " + chr(10) + d for i, (n, d) in enumerate(CATEGORIES))
    head, rest = INSTRUCTIONS.split("{guidelines}")
    mid, tail = rest.split("{conversation}")
    return _MOD_CTES + f""",
fm AS (SELECT d.doc_id AS id,
              {_sq(head + guidelines + mid)} || 'human: ' || d.text || chr(10) || chr(10) || 'chatbot: ' || d.source
              || {_sq(tail)} || ' ' ||
              CASE WHEN l.toxic = 1 THEN 'unsafe' || chr(10) ||
                        coalesce('O' || CAST(CAST(t.code AS INTEGER) AS VARCHAR), '')
                   ELSE 'safe' END AS text
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN top t ON t.doc_id = d.doc_id),
nt AS (SELECT id, """ + sql_token_ids("text") + """ AS ids FROM fm)
SELECT id, pos, ids[pos + 1] AS token, ids[pos + 1] AS label FROM (SELECT id, ids, unnest(range(len(ids))) AS pos FROM nt)"""


@query("moderation_examples", _moderation_sql())
def q_moderation_examples(spark, sf_dir):
    both = F.arrays_zip(F.col("input_ids").alias("token"), F.col("labels").alias("label"))
    return (moderation_examples(spark, sf_dir).select("id", F.posexplode(both).alias("pos", "x"))
            .select("id", F.col("pos").cast("bigint").alias("pos"), "x.token", "x.label"))


# ---- F23 / F24 / S15
@query("instruction_prompt", f"""
SELECT doc_id, CASE WHEN coalesce(text, '') = ''
  THEN replace({_sq(SF.PROMPT_NO_INPUT)}, '{{instruction}}', 'Summarize the text from ' || source)
  ELSE replace(replace({_sq(SF.PROMPT_INPUT)}, '{{instruction}}', 'Summarize the text from ' || source), '{{input}}', text)
  END AS prompt, lang AS output
FROM documents""")
def q_instruction_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Summarize the text from "), "source").alias("instruction"),
        F.col("text").alias("input"),
        F.col("lang").alias("output"))
    return d.select("doc_id", SF.instruction_prompt("instruction", "input").alias("prompt"), "output")


@query("dialog_prompt", f"""
SELECT conv_id, replace({_sq(SF.DIALOG_PROMPT)}, '{{dialog}}',
       string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS prompt
FROM conversations GROUP BY conv_id""")
def q_dialog_prompt(spark, sf_dir):
    return SF.dialog_prompt(table(spark, sf_dir, "conversations"))


@query("scan_examples", "SELECT doc_id, 'Summarize the text from ' || source AS instruction, text AS input, lang AS output FROM documents")
def q_scan_examples(spark, sf_dir):
    """Instruction records written as JSON and scanned with a schema."""
    from quorum.sources import io as IO
    path = IO.scratch(spark, "examples")
    (table(spark, sf_dir, "documents")
     .select("doc_id", F.concat(F.lit("Summarize the text from "), "source").alias("instruction"), F.col("text").alias("input"),
             F.col("lang").alias("output")).groupBy(F.floor(F.col("doc_id") / 100).alias("file"))  # a file holds 100 records at most
     .agg(F.to_json(F.collect_list(F.struct("doc_id", "instruction", "input", "output"))).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(path))  # a JSON array per file
    return IO.read_json_records(spark, path, "doc_id long, instruction string, input string, output string")
