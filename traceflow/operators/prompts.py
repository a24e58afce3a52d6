"""Chat prompts and training lines from sequences."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.functions.parsing import answer_word, without_missing
from traceflow.functions.text import piece_count

# The instruction with and without the topic.
INSTRUCTION_WITH_KC = (
    "You are an instructor and want to trace how the student has learned to answer the questions over time. "
    "Each time, the user gives you the difficulty of a question (an integer ranging from 1 [easiest] to 3 [hardest] as estimated by the instructor) "
    "as well as the topic of the question (as an ID indicating the topic, as specified by the instructor), "
    "and you should output a single word: CORRECT if you think the student would answer the question correctly, and WRONG if you think the student would answer the question wrong. "
    "Output no other word at all, this is very important. "
    "Try to learn the pattern of the student over time and how they improve their knowledge of the course."
)
INSTRUCTION = (
    "You are an instructor and want to trace how the student has learned to answer the questions over time. "
    "Each time, the user gives you the difficulty of a question (an integer ranging from 1 [easiest] to 3 [hardest] as estimated by the instructor), "
    "and you should output a single word: CORRECT if you think the student would answer the question correctly, and WRONG if you think the student would answer the question wrong. "
    "Output no other word at all, this is very important. "
    "Try to learn the pattern of the student over time and how they improve their knowledge of the course."
)

# Separators of the training text.
STEP_SEPARATOR = " ||| "
END_OF_TEXT = "<|endoftext|>"

MAX_TOKENS = 4096


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompts(
    enriched: DataFrame,
    incl_id: bool = True,
    incl_q: bool = True,
    incl_kc: bool = True,
    incl_diff: bool = True,
    instruction_role: str = "assistant",
    missing: str = "error",
) -> DataFrame:
    """Add ``prompt``, a chat that ends before the last answer, and ``gt``, that answer.

    ``enriched`` is the output of ``enrich_steps``. A missing answer, or a
    missing value that the prompt shows, is an error or, with
    ``missing="drop"``, its sequence is left out.
    """
    shown = {"questions": incl_q, "kcs": incl_kc, "difficulties": incl_diff}
    enriched = without_missing(enriched, ["answers", *[c for c, used in shown.items() if used]], missing)
    base = F.array(
        _message(instruction_role, F.lit(INSTRUCTION_WITH_KC if incl_kc else INSTRUCTION))
    )
    steps = F.size("answers")

    def turn(answer: Column, j: Column) -> Column:
        content = []
        if incl_id:
            content += [F.lit("ID: "), F.get("question_ids", j).cast("string"), F.lit(", ")]
        if incl_q:
            content += [F.lit("Question: "), F.get("questions", j), F.lit(", ")]
        if incl_kc:
            content += [F.lit("Topic: "), F.get("kcs", j), F.lit(", ")]
        if incl_diff:
            content += [F.lit("Difficulty: "), F.get("difficulties", j).cast("string")]
        ask = _message("user", F.concat(*content) if content else F.lit(""))
        told = _message("assistant", answer_word(answer))
        return F.when(j < steps - 1, F.array(ask, told)).otherwise(F.array(ask))

    last = F.try_element_at("answers", F.lit(-1))
    return enriched.withColumns(
        {
            "prompt": F.concat(base, F.flatten(F.transform("answers", turn))),
            "gt": F.when(steps > 0, answer_word(last)),
        }
    )


def prompt_text(prompt: str | Column) -> Column:
    """A prompt as the text of a Python list of dicts, the form that is counted."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt

    def quoted(text: Column) -> Column:
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        single = F.replace(escaped, F.lit("'"), F.lit("\\'"))
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    shown = F.transform(
        prompt,
        lambda m: F.concat(
            F.lit("{'role': "), quoted(m["role"]), F.lit(", 'content': "), quoted(m["content"]),
            F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Turn a Python token counter into a column function (Arrow batches)."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(count, na_action="ignore").astype("Int32")

    return counted


def within_budget(
    prompts: DataFrame,
    max_tokens: int = MAX_TOKENS,
    counter: Callable[[Column], Column] = piece_count,
) -> DataFrame:
    """Prompts, with their ground truth, of at most ``max_tokens`` tokens.

    The default counter counts words and punctuation inside the JVM; pass
    ``token_counter(f)`` for a model's own tokenizer.
    """
    return prompts.withColumn("tokens", counter(prompt_text("prompt"))).where(
        F.col("tokens") <= max_tokens
    )


def training_lines(sequences: DataFrame, missing: str = "error") -> DataFrame:
    """Add ``line``: difficulty and answer of every step, the last one included.

    A missing answer or difficulty is an error or, with ``missing="drop"``, its
    sequence is left out.
    """
    sequences = without_missing(sequences, ["difficulties", "answers"], missing)
    step = F.zip_with(
        "difficulties",
        "answers",
        lambda d, a: F.concat(
            F.lit("Difficulty: "), d.cast("string"), F.lit(" -> Answer: "), answer_word(a)
        ),
    )
    return sequences.withColumn("line", F.array_join(step, STEP_SEPARATOR))
