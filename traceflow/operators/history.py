"""Student histories: positions, disjoint fixed-length sequences, lookups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceflow.operators.joins import HOT_ROWS, hot_keys, lookup_join, small_side
from traceflow.operators.ranking import group_positions

_ROW_KEY = ("student_id", "seq")
_VALUES = ("question_id", "answer", "difficulty", "hint")


def time_order() -> list[Column]:
    """Order of attempts inside a history: missing times come last."""
    return [F.col("start_time").asc_nulls_last(), F.col("seq").asc()]


def _positioned_parts(
    attempts: DataFrame, hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``pos`` and ``history_len``; returns usual and hot students apart."""
    known = attempts.where(F.col("student_id").isNotNull())
    usual = known
    if hot is not None:
        usual = known.join(small_side(hot.select("student_id")), "student_id", "left_anti")
    history = Window.partitionBy("student_id").orderBy(*time_order())
    whole = history.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usual = usual.select(
        "*",
        (F.row_number().over(history).cast("long") - 1).alias("pos"),
        F.count(F.lit(1)).over(whole).alias("history_len"),
    )
    if hot is None:
        return usual, None
    large = known.join(small_side(hot), "student_id").withColumnRenamed("key_rows", "history_len")
    return usual, group_positions(large, "student_id", time_order())


def history_positions(attempts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every attempt with its zero-based position and the history's length.

    One exchange on ``student_id`` serves all students of usual size. Histories
    of more than ``hot_rows`` attempts are cut over many tasks by range instead.
    """
    usual, large = _positioned_parts(attempts, hot_keys(attempts, "student_id", hot_rows))
    if large is None:
        return usual
    return usual.unionByName(large)


def first_per_key(table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key; ``order`` stands for the row order of a file.

    Without an order there is no first row, so a key that occurs twice is an error.
    """
    others = [c for c in table.columns if c != key]
    if not order:
        single = table.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in others]
        )
        message = F.concat(F.lit(f"{key} occurs twice and no order is given: "), F.col(key).cast("string"))
        return single.select(
            F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(message)).alias(key), *others
        )
    ranking = F.struct(*order, *[c for c in others if c not in order])
    return (
        table.groupBy(key)
        .agg(F.min_by(F.struct(*others), ranking).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in others])
    )


def with_difficulty(
    attempts: DataFrame, questions: DataFrame, order: Sequence[str] = (), **join_options
) -> DataFrame:
    """Add ``difficulty``, and ``known``: whether the question exists at all."""
    source = questions.select(*dict.fromkeys(["id", "difficulty", *order]))
    table = (
        first_per_key(source, "id", order)
        .withColumnRenamed("id", "question_id")
        .select("question_id", "difficulty", F.lit(True).alias("known"))
    )
    return lookup_join(
        attempts, table, "question_id", "left", row_key=_ROW_KEY, bound=source, **join_options
    ).withColumn("known", F.coalesce("known", F.lit(False)))


def _assemble(rows: DataFrame, lengths: Sequence[int], drop_full_tail: bool) -> DataFrame:
    """Cut positioned rows into chunks of each length and drop uniform chunks."""
    if len(lengths) == 1:
        cut = rows.withColumn("n", F.lit(lengths[0]))
    else:
        cut = rows.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    chunk = F.floor(F.col("pos") / F.col("n")).cast("long")
    end = (F.col("chunk") + 1) * F.col("n")
    # A chunk that ends exactly at the end of the history is left out as well.
    complete = end < F.col("history_len") if drop_full_tail else end <= F.col("history_len")
    step = F.struct("pos", "question_id", "answer", "difficulty", "hint")
    missing = F.greatest(*[F.col(name).isNull() for name in _VALUES])
    return (
        cut.withColumn("chunk", chunk)
        .where(complete)
        .groupBy("student_id", "n", "chunk")
        .agg(
            F.sort_array(F.collect_list(step)).alias("steps"),
            F.count_if(F.col("answer") == 0).alias("_wrong"),
            F.count_if(F.col("answer") == 1).alias("_right"),
            F.bool_and("known").alias("known"),
            F.bool_or(missing).alias("missing"),
        )
        .where((F.col("_wrong") != F.col("n")) & (F.col("_right") != F.col("n")))
        .select("student_id", "n", "chunk", "steps", "known", "missing")
    )


def _finish(chunks: DataFrame, unknown: str, dedup: bool) -> DataFrame:
    difficulties = F.col("steps.difficulty")
    if unknown == "error":
        message = F.concat(
            F.lit("unknown question in the history of student "), F.col("student_id").cast("string")
        )
        difficulties = F.when(F.col("known"), difficulties).otherwise(F.raise_error(message))
    elif unknown == "drop":
        chunks = chunks.where("known")
    else:
        raise ValueError("unknown must be 'error' or 'drop'")
    found = chunks.select(
        "student_id",
        "n",
        "chunk",
        F.col("steps.question_id").alias("question_ids"),
        F.col("steps.answer").alias("answers"),
        difficulties.alias("difficulties"),
        F.col("steps.hint").alias("hint_used"),
        "missing",
    )
    return drop_duplicate_sequences(found) if dedup else found.drop("missing")


def drop_duplicate_sequences(found: DataFrame) -> DataFrame:
    """Keep the first of equal sequences of one student and length.

    A missing value is unequal to everything, so sequences that have one, as
    column ``missing`` tells, all stay.
    """
    lists = ["question_ids", "answers", "difficulties", "hint_used"]
    return (
        found.withColumn("_own", F.when(F.col("missing"), F.col("chunk")))
        .groupBy("student_id", "n", *lists, "_own")
        .agg(F.min("chunk").alias("chunk"))
        .select("student_id", "n", "chunk", *lists)
    )


def sequences(
    attempts: DataFrame,
    questions: DataFrame,
    lengths: Sequence[int] = (5,),
    split: DataFrame | None = None,
    drop_full_tail: bool = True,
    unknown: str = "error",
    dedup: bool = True,
    hot_rows: int = HOT_ROWS,
    question_order: Sequence[str] = (),
) -> DataFrame:
    """Disjoint mixed-outcome sequences of each length, with difficulties.

    ``attempts`` has ``student_id, question_id, answer, hint, start_time, seq``
    with flags as 0/1. A question that occurs twice counts with its first row in
    ``question_order``. All lengths come from one pass. With ``split`` (see
    ``student_split``) each sequence also gets the block of its student.

    For usual students the window, the chunk aggregate, the removal of
    duplicates and the join with the split share one exchange on the student.
    """
    rows = attempts.select("student_id", "question_id", "answer", "hint", "start_time", "seq")
    hot = hot_keys(rows, "student_id", hot_rows)
    rows = with_difficulty(rows, questions, question_order, hot_rows=hot_rows)
    usual, large = _positioned_parts(rows, hot)
    result = _finish(_assemble(usual, lengths, drop_full_tail), unknown, dedup)
    blocks = None if split is None else split.select("student_id", "block")
    if blocks is not None:
        result = result.join(blocks, "student_id")
    if large is None:
        return result
    extra = _finish(_assemble(large, lengths, drop_full_tail), unknown, dedup)
    if blocks is not None:
        # At most one row per hot student.
        few = blocks.join(small_side(hot.select("student_id")), "student_id", "left_semi")
        extra = extra.join(small_side(few), "student_id")
    return result.unionByName(extra)
