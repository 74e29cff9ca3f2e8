"""Safety formatter edge rows: safe, unsafe (one / all categories), N/A and
NULL responses, ten or more categories (codes sort as strings)."""

import re

from quorum.operators import safety as SF

CATS = [(f"Cat{i}", f"Description {i}") for i in range(1, 12)]  # 11 categories
TEMPLATE = "G:\n{guidelines}\nC:\n{conversation}\nEnd"


def _examples(spark):
    rows = [
        (1, "hello", "hi there", [], "safe", "fine"),
        (2, "bad", "N/A", ["O2", "O10"], "unsafe", "two"),
        (3, "worse", None, [f"O{i}" for i in range(1, 12)], "unsafe", "all"),
    ]
    return spark.createDataFrame(rows, "id long, prompt string, response string, "
                                       "violated_category_codes array<string>, label string, explanation string")


def test_format_examples(spark):
    out = SF.format_examples(_examples(spark), CATS, TEMPLATE, add_dropped_violated=True,
                             dropped_violated_explanation="dropped").collect()
    by = {(r["id"], r["variant"]): r for r in out}
    # base prompts list every category, numbered 1..11
    base = by[(1, "base")]["guard_prompt"]
    assert [int(x) for x in re.findall(r"O(\d+): ", base)] == list(range(1, 12))
    assert "chatbot: hi there" in base
    # N/A and NULL responses are prompt-only
    assert "chatbot:" not in by[(2, "base")]["guard_prompt"]
    assert "chatbot:" not in by[(3, "base")]["guard_prompt"]
    # violated codes are rewritten and sorted as strings
    codes = by[(3, "base")]["guard_target"].split("\n")[1].split(",")
    assert codes == sorted(codes) and len(codes) == 11 and "O10" in codes
    # the non-violated augmentation never drops every category, nor a violated one
    aug = by[(2, "drop_nonviolated")]["guard_prompt"]
    names = re.findall(r"O\d+: (Cat\d+)\. ", aug)
    assert names and {"Cat2", "Cat10"} <= set(names)
    # augmentation B: only for unsafe rows with something non-violated left
    assert (1, "drop_violated") not in by and (3, "drop_violated") not in by
    b = by[(2, "drop_violated")]
    assert b["guard_target"] == "safe\nExplanation: dropped"
    assert "Cat2." not in b["guard_prompt"] and "Cat10." not in b["guard_prompt"]


def test_primary_category(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("[['hate', 0.2], ['violence', 0.7]]",), ("[]",), ("[['sexual', 0.5]]",)], "m string")
    got = [r[0] for r in df.select(SF.primary_category(F.col("m"))).collect()]
    assert got == ["01", None, "012"]
