"""Column layouts shared by readers, operators and writers."""

from pyspark.sql import types as T

ATTEMPTS = T.StructType(
    [
        T.StructField("student_id", T.LongType()),
        T.StructField("question_id", T.LongType()),
        T.StructField("answer_state", T.BooleanType()),
        T.StructField("hint_used", T.BooleanType()),
        T.StructField("start_time", T.TimestampType()),
        # Breaks ties of start_time; unique inside one student's history.
        T.StructField("seq", T.LongType()),
    ]
)

QUESTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("difficulty", T.IntegerType()),
        T.StructField("question_rich_text", T.StringType()),
    ]
)

KCS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

QUESTION_KC = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("question_id", T.LongType()),
        T.StructField("knowledgecomponent_id", T.LongType()),
    ]
)

KC_LINK = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("kc_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

SEQUENCE = T.StructType(
    [
        T.StructField("student_id", T.LongType()),
        T.StructField("question_ids", T.ArrayType(T.LongType())),
        T.StructField("answers", T.ArrayType(T.IntegerType())),
        T.StructField("difficulties", T.ArrayType(T.IntegerType())),
        T.StructField("hint_used", T.ArrayType(T.IntegerType())),
    ]
)

# What identifies a sequence.
SEQUENCE_KEY = ("student_id", "n", "chunk")
# Files written by other tools may hold NaN for a missing flag, so whole
# numbers are read as doubles first.
SEQUENCE_FILE = T.StructType(
    [
        T.StructField("student_id", T.LongType()),
        T.StructField("question_ids", T.ArrayType(T.LongType())),
        T.StructField("answers", T.ArrayType(T.DoubleType())),
        T.StructField("difficulties", T.ArrayType(T.DoubleType())),
        T.StructField("hint_used", T.ArrayType(T.DoubleType())),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

PROMPT = T.ArrayType(MESSAGE)

RUN_LOG = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("layers", T.IntegerType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("acc", T.DoubleType()),
        T.StructField("bal_acc", T.DoubleType()),
        T.StructField("f1_0", T.DoubleType()),
        T.StructField("f1_1", T.DoubleType()),
        T.StructField("sup_0", T.LongType()),
        T.StructField("sup_1", T.LongType()),
        T.StructField("auc", T.DoubleType()),
        # Place of the configuration in the grid; earlier wins ties.
        T.StructField("grid_order", T.IntegerType()),
    ]
)
# The log of a grid also has the mean loss of each epoch.
GRID_LOG = T.StructType([*RUN_LOG.fields, T.StructField("loss", T.DoubleType())])
