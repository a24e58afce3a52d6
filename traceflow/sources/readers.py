"""Readers of attempt logs, question tables and sequence files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.functions.parsing import flag
from traceflow.operators.splits import in_test, in_training, in_validation, split_name
from traceflow.schemas import KC_LINK, KCS, QUESTION_KC, QUESTIONS, SEQUENCE_FILE, SEQUENCE_KEY
from traceflow.sources.ranges import read_json_array, read_quoted_csv


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    # All columns as text; the ones in use are picked by name and cast.
    if multi_line:
        return read_quoted_csv(spark, path)
    return spark.read.csv(path, header=True, escape='"', inferSchema=False)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_attempts(
    spark: SparkSession,
    path: str,
    seq: str | Column | None = "id",
    multi_line: bool = False,
) -> DataFrame:
    """Attempt log from CSV with flags as 0/1.

    ``seq`` names the tie-break column of the file. Without one, a hash of the
    used columns takes its place: it only leaves exact copies tied, and copies
    are interchangeable. Other columns of the file are never parsed. Set
    ``multi_line`` for files with line breaks inside fields: they are read by many tasks too,
    but twice.
    """
    return parse_attempts(_csv(spark, path, multi_line), seq)


def parse_attempts(raw: DataFrame, seq: str | Column | None = "id") -> DataFrame:
    """Attempts from a table of text columns.

    A student or question id that is no whole number is an error. A time that
    cannot be read becomes NULL, which orders last; ``unread_times`` counts them.
    """
    used = ["student_id", "question_id", "answer_state", "hint_used", "start_time"]
    if seq is None:
        tie = F.xxhash64(*used)
    else:
        tie = (F.col(seq) if isinstance(seq, str) else seq).cast("long")
    return raw.select(
        F.col("student_id").cast("long").alias("student_id"),
        F.col("question_id").cast("long").alias("question_id"),
        flag("answer_state").alias("answer"),
        flag("hint_used").alias("hint"),
        F.col("start_time").try_cast("timestamp").alias("start_time"),
        tie.alias("seq"),
    )


def unread_times(raw: DataFrame) -> DataFrame:
    """``n_unread``: texts of ``start_time`` that are no time."""
    time = F.col("start_time")
    return raw.agg(F.count_if(time.isNotNull() & time.try_cast("timestamp").isNull()).alias("n_unread"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark, path, True), QUESTIONS)


def read_kcs(spark: SparkSession, path: str) -> DataFrame:
    """Topics; their descriptions may span lines."""
    return _typed(_csv(spark, path, True), KCS)


def read_question_kc(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark, path, False), QUESTION_KC)


def read_kc_link(spark: SparkSession, path: str) -> DataFrame:
    """Question–topic link with names, as written by ``write_csv``."""
    return _typed(_csv(spark, path, True), KC_LINK)


def read_sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of sequence records; NaN becomes NULL.

    ``chunk`` is the place of the record, as the file has no other key, and
    ``n`` the number of its answers. Byte ranges of the file are read in parallel, however they are cut.
    """
    return parse_sequences(read_json_array(spark, path, SEQUENCE_FILE, position="chunk")).select(
        *SEQUENCE_KEY, "question_ids", "answers", "difficulties", "hint_used"
    )


def parse_sequences(raw: DataFrame) -> DataFrame:
    """Whole-number lists, and the length ``n``, of records read as SEQUENCE_FILE."""

    def whole(name: str) -> Column:
        clean = F.transform(name, lambda v: F.when(~F.isnan(v), v).cast("int"))
        return clean.alias(name)

    return raw.select(
        "student_id",
        F.size("answers").alias("n"),
        "question_ids",
        whole("answers"),
        whole("difficulties"),
        whole("hint_used"),
        *[c for c in raw.columns if c not in SEQUENCE_FILE.fieldNames()],
    )


def sequence_file_name(n: int, split: str, fold: int | None = None) -> str:
    """Name of the file of one length and split; hold-out files have no fold."""
    part = split if split == "test" else f"{split}_fold_{fold}"
    return f"{part}_n_{n}.json"


def read_sequence_folder(
    spark: SparkSession, folder: str, n: int, split: str, fold: int | None = None
) -> DataFrame:
    """The sequences of one split from a folder of single files."""
    return read_sequence_file(spark, f"{folder}/{sequence_file_name(n, split, fold)}")


_WRITTEN = (
    "student_id long, chunk long, question_ids array<long>, answers array<int>, difficulties array<int>, "
    "hint_used array<int>, n int"
)


def read_sequences(
    spark: SparkSession,
    path: str,
    n: int | None = None,
    split: str | None = None,
    fold: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Sequences written by ``write_sequences``; conditions prune directories.

    Hold-out sequences belong to no fold, so ``fold`` does not apply to them.
    """
    schema = f"{_WRITTEN}, split string, fold int"
    rows = spark.read.schema(schema).format(fmt).load(path)
    if n is not None:
        rows = rows.where(F.col("n") == n)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if fold is not None:
        rows = rows.where(F.col("fold").isin(fold, 0))
    return rows


def read_fold(
    spark: SparkSession,
    path: str,
    fold: int,
    split: str | None = None,
    n: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Sequences written by ``write_blocks`` as one fold, counted from 1, sees them.

    Gives the rows and columns of ``read_sequences`` with the same conditions. The split is a
    condition on the block, so only the directories of that split and length are read.
    """
    rows = spark.read.schema(f"{_WRITTEN}, block string").format(fmt).load(path)
    if n is not None:
        rows = rows.where(F.col("n") == n)
    if split is not None:
        members = {"train": in_training(fold), "val": in_validation(fold), "test": in_test()}
        if split not in members:
            raise ValueError(f"unknown split {split}")
        rows = rows.where(members[split])
    number = F.when(in_test(), 0).otherwise(fold).alias("fold")
    return rows.select(*[c for c in rows.columns if c != "block"], split_name(fold).alias("split"), number)
