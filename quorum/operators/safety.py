"""Safety-classifier and instruction examples.

A training example is one row; its formatted variants (base prompt, plus
the two category-dropping augmentations) come from ``explode`` of a small
array built in the row.  Category shuffles and random drop counts are
hash-uniform, keyed by (seed, example id, variant), so reruns and retries
give the same text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions import rng

# Instruction and dialogue templates of the example builders.
PROMPT_INPUT = ("Below is an instruction that describes a task, paired with an input that provides further "
                "context. Write a response that appropriately completes the request.\n\n"
                "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:")
PROMPT_NO_INPUT = ("Below is an instruction that describes a task. Write a response that appropriately "
                   "completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:")
DIALOG_PROMPT = "Summarize this dialog:\n{dialog}\n---\nSummary:\n"

# Moderation category -> safety category code.
MODERATION_CODES = {
    "sexual": "012",
    "violence": "01",
    "sexual/minors": "04",
    "self-harm/intent": "011",
    "hate": "010",
    "harassment": "010",
    "self-harm": "011",
    "self-harm/instructions": "011",
    "violence/graphic": "01",
    "harassment/threatening": "010",
    "hate/threatening": "010",
}


def _fill(template: str, **cols: Column) -> Column:
    """Replace ``{name}`` placeholders of a fixed template with columns.  The
    template is split once, so text that a column brings is never a placeholder."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[cols[p] if i % 2 and p in cols else F.lit("{" + p + "}" if i % 2 else p)
                      for i, p in enumerate(pieces)])


def instruction_prompt(instruction, input_col) -> Column:
    """instruction template with or without an input."""
    i, x = F.col(instruction), F.col(input_col)
    return F.when(F.coalesce(x, F.lit("")) == "", _fill(PROMPT_NO_INPUT, instruction=i)) \
        .otherwise(_fill(PROMPT_INPUT, instruction=i, input=x))


def dialog_prompt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """turns of a conversation joined in turn order into the summary
    prompt.  One group per conversation (its turns), grouped by Spark."""
    g = (turns.groupBy(conv)
              .agg(F.sort_array(F.collect_list(F.struct(turn, role, text))).alias("_t")))
    dialog = F.array_join(F.transform("_t", lambda x: F.concat(x[role], F.lit(": "), x[text])), "\n")
    return g.select(conv, _fill(DIALOG_PROMPT, dialog=dialog).alias("prompt"))


def primary_category(moderation_literal) -> Column:
    """Parse ``[[category, score], …]`` (Python literal text), take the
    highest score (first on ties), map it to its safety code; NULL when empty."""
    s = F.col(moderation_literal) if isinstance(moderation_literal, str) else moderation_literal
    arr = F.from_json(s, "array<array<string>>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    z = F.transform(arr, lambda x, i: F.struct((-x[1].cast("double")).alias("ns"), i.alias("i"),
                                               x[0].alias("cat")))
    top = F.try_element_at(F.array_sort(z), F.lit(1))["cat"]
    mp = F.create_map(*[F.lit(v) for kv in MODERATION_CODES.items() for v in kv])
    return F.when(F.size(arr) > 0, F.try_element_at(mp, top))


def safety_record(df: DataFrame) -> DataFrame:
    """jsonl-style record: prompt, generation, good/bad, mapped category."""
    return df.select("id", F.col("user_input").alias("prompt"), F.col("model_output").alias("generation"),
                     F.when(F.col("toxicity") == 0, "good").otherwise("bad").alias("label"),
                     F.array(primary_category("openai_moderation")).alias("unsafe_content"))


def format_examples(examples: DataFrame, categories: Sequence[tuple[str, str]], instructions: str,
                    include_descriptions: bool = True, shuffle: bool = True, list_violated: bool = True,
                    explanation_position: str | None = "after", add_dropped_nonviolated: bool = True,
                    add_dropped_violated: bool = False, dropped_violated_explanation: str | None = None,
                    prefix: str = "O", seed: int = 42) -> DataFrame:
    """Formatted safety examples.

    ``examples``: ``id, prompt, response, violated_category_codes
    ARRAY<STRING>, label ('safe'/'unsafe'), explanation``; ``instructions``
    holds ``{guidelines}`` and ``{conversation}``.  Output: one row per
    variant (``base``, ``drop_nonviolated``, ``drop_violated``) with the
    guard prompt, the target and their concatenation.
    """
    if add_dropped_violated and explanation_position is not None and dropped_violated_explanation is None:
        raise ValueError("an explanation for the dropped-violated augmentation is required")
    K = len(categories)
    names = F.array(*[F.lit(n) for n, _ in categories])
    descs = F.array(*[F.lit(d) for _, d in categories])
    allc = F.sequence(F.lit(0), F.lit(K - 1))
    viol = F.array_distinct(F.transform(F.coalesce("violated_category_codes", F.array().cast("array<string>")),
                                        lambda c: F.regexp_replace(c, "^[" + prefix + "]+", "").cast("int") - 1))
    nonviol = F.array_except(allc, viol)

    def hashed(arr, variant, salt):
        z = F.transform(arr, lambda i: F.struct(rng.hash_order(seed, F.col("id"), F.lit(variant), F.lit(salt), i)
                                                .alias("h"), i.alias("i")))
        return F.transform(F.array_sort(z), lambda x: x["i"])

    def drop_some(variant, count):
        return F.slice(hashed(nonviol, variant, "drop"), 1, count)

    u_a = rng.hash_uniform(seed, F.col("id"), F.lit("drop_nonviolated"), F.lit("n"))
    n_a = F.floor(u_a * (F.size(nonviol) + 1)).cast("int")
    n_a = F.when(n_a == K, n_a - 1).otherwise(n_a)
    u_b = rng.hash_uniform(seed, F.col("id"), F.lit("drop_violated"), F.lit("n"))
    n_b = F.floor(u_b * F.size(nonviol)).cast("int")

    variants = [F.struct(F.lit("base").alias("variant"), allc.alias("inc"), F.col("label").alias("lab"),
                         viol.alias("vi"), F.col("explanation").alias("expl"))]
    if add_dropped_nonviolated:
        variants.append(F.struct(F.lit("drop_nonviolated").alias("variant"),
                                 F.array_except(allc, drop_some("drop_nonviolated", n_a)).alias("inc"),
                                 F.col("label").alias("lab"), viol.alias("vi"), F.col("explanation").alias("expl")))
    if add_dropped_violated:
        b = F.struct(F.lit("drop_violated").alias("variant"),
                     F.array_except(nonviol, drop_some("drop_violated", n_b)).alias("inc"),
                     F.lit("safe").alias("lab"), F.array().cast("array<int>").alias("vi"),
                     F.lit(dropped_violated_explanation).alias("expl"))
        # Q12: skipped when nothing non-violated is left to keep
        variants.append(F.when((F.col("label") == "unsafe") & (F.size(nonviol) > 0), b))
    x = (examples.withColumn("_v", F.explode(F.filter(F.array(*variants), lambda v: v.isNotNull())))
                 .select("*", "_v.*").drop("_v"))
    order = (hashed(F.col("inc"), F.col("variant"), "order") if shuffle
             else F.array_sort(F.col("inc")))
    x = x.withColumn("_ord", order)
    pieces = F.transform("_ord", lambda i, r: F.concat(
        F.when(r > 0, F.lit("\n")).otherwise(F.lit("")), F.lit(prefix), (r + 1).cast("string"), F.lit(": "),
        F.element_at(names, i + 1), F.lit(". "),
        (F.concat(F.lit("\n"), F.element_at(descs, i + 1)) if include_descriptions else F.lit(""))))
    guidelines = F.array_join(pieces, "")
    prompt_only = F.col("response").isNull() | (F.col("response") == "N/A")
    conversation = F.when(prompt_only, F.concat(F.lit("human: "), F.col("prompt"))).otherwise(
        F.concat(F.lit("human: "), F.col("prompt"), F.lit("\n\nchatbot: "), F.col("response")))
    guard_prompt = _fill(instructions, guidelines=guidelines, conversation=conversation)
    codes = F.array_sort(F.transform(F.filter("vi", lambda i: F.array_contains("_ord", i)),
                                     lambda i: F.concat(F.lit(prefix),
                                                        F.array_position("_ord", i).cast("string"))))
    target = F.col("lab")
    if list_violated:
        target = F.when(F.col("lab") == "unsafe", F.concat(target, F.lit("\n"), F.array_join(codes, ","))) \
            .otherwise(target)
    if explanation_position == "before":
        target = F.concat(F.lit("Explanation: "), F.coalesce("expl", F.lit("None")), F.lit("\n"), target)
    elif explanation_position == "after":
        target = F.concat(target, F.lit("\nExplanation: "), F.coalesce("expl", F.lit("None")))
    return x.select("id", "variant", guard_prompt.alias("guard_prompt"), target.alias("guard_target"),
                    F.concat(guard_prompt, F.lit(" "), target).alias("text"))
