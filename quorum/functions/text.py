"""Prompt text builders as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_OPTIONS = 26  # letters A..Z

# Prompt templates and sentences of the survey prompts.
QA_SEPARATOR = "\n\n"
KEEP_IN_MIND = "Answer the following question keeping in mind your previous answers.\n"
ANSWER_FORCING_HEAD = "Answer as a choice between "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (not just spaces)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def letter(i) -> Column:
    """F32: 0-based index -> 'A'..'Z'; error past 'Z' (Q10)."""
    i = _c(i) if not isinstance(i, int) else F.lit(i)
    return F.when(i < MAX_OPTIONS, F.char(F.lit(65) + i)).otherwise(
        F.raise_error(F.lit("more than 26 options")).cast("string"))


def mcq(question, options, surveyor: str = "Question:", respondent: str = "Answer:",
        pre_label: str = "", post_label: str = ". ", add_answer_forcing: bool = False,
        additional_instruction: str = "", faithful: bool = True) -> Column:
    """multiple-choice text.

    ``{surveyor} {question}\\n{A. opt1\\nB. opt2}\\n{instruction}`` stripped, then
    ``\\n\\n{respondent}``.  Answer forcing lists ``A.,B.,…`` when the post
    label is '.'-like; for another post label the reference emits just '.'
    (``faithful=True``) — ``faithful=False`` writes the full sentence.
    """
    opts = _c(options)
    lines = F.transform(opts, lambda o, i: F.concat(F.lit(pre_label), letter(i), F.lit(post_label), strip(o)))
    option_list = strip(F.array_join(lines, "\n"))
    if add_answer_forcing:
        labels = F.transform(opts, lambda o, i: strip(F.concat(F.lit(pre_label), letter(i), F.lit(post_label))))
        sentence = F.concat(F.lit(ANSWER_FORCING_HEAD), strip(F.array_join(labels, ",")))
        if post_label.strip() == "." or not faithful:
            instr = sentence
        else:
            instr = F.lit(".")
    else:
        instr = F.lit(additional_instruction.strip())
    body = strip(F.concat(F.lit(surveyor.strip() + " "), strip(_c(question)), F.lit("\n"),
                           option_list, F.lit("\n"), instr))
    return F.concat(body, F.lit(QA_SEPARATOR + respondent.strip()))


def steer_qa(qa_prompt, steer_options, group) -> Column:
    """steering MCQ + `` X. group`` + the keep-in-mind line."""
    pos = F.array_position(_c(steer_options), _c(group))
    return F.concat(mcq(qa_prompt, steer_options), F.lit(" "), letter(pos - 1), F.lit(". "), _c(group),
                    F.lit("\n\n" + KEEP_IN_MIND))


def steer_statement(prompt, group) -> Column:
    """F16 (BIO / PORTRAY): '. ' -> '.\\n', then `` group.`` and a blank line."""
    return F.concat(F.replace(_c(prompt), F.lit(". "), F.lit(".\n")), F.lit(" "), _c(group), F.lit(".\n\n"))


def chat_messages(prompt) -> Column:
    """prompt -> three chat turns (steering question, steering answer,
    survey question) split on 'Answer:' like the chat-template path."""
    p = _c(prompt)
    parts = F.split(p, "Answer:")
    # drop the last piece (after the final 'Answer:'), strip the others
    kept = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: strip(x))
    first = F.try_element_at(kept, F.lit(1))
    second = F.try_element_at(kept, F.lit(2))
    answer = strip(F.substring_index(second, "\n", 1))
    survey = strip(F.replace(second, answer, F.lit("")))
    return F.array(
        F.struct(F.lit("user").alias("role"), strip(first).alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
        F.struct(F.lit("user").alias("role"), survey.alias("content")))


def parse_literal(col, element_type: str = "double") -> Column:
    """Python list literal text -> array.  Spark's JSON reader accepts
    single quotes and escaped quotes; ``nan`` and NumPy's space-separated
    ``[0.1 0.2]`` form are rewritten first, outside of quoted strings only."""
    pieces = F.regexp_extract_all(_c(col), F.lit(r"""(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\"']+|[\"'])"""), F.lit(1))

    def rewrite(piece):
        plain = F.regexp_replace(piece, r"\bnan\b", "NaN")
        plain = F.regexp_replace(plain, r"([0-9])\.(?![0-9eE])", "$1.0")  # NumPy writes 3. for 3.0
        plain = F.regexp_replace(plain, r"([0-9.N])\s+(?=[-+0-9.N])", "$1, ")
        plain = F.regexp_replace(plain, r"^\s+$", ", ")  # between two quoted strings
        return F.when(piece.rlike("^[\"']"), piece).otherwise(plain)
    s = F.array_join(F.transform(pieces, rewrite), "")
    return F.from_json(s, f"array<{element_type}>", {"allowBackslashEscapingAnyCharacter": "true"})
