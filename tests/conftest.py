import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from traceflow.session import local_session  # noqa: E402

ATTEMPT_SCHEMA = (
    "student_id long, question_id long, answer int, hint int, start_time timestamp, seq long"
)
QUESTION_SCHEMA = "id long, difficulty int, question_rich_text string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_attempts(spark):
    """Attempts from {student: answers}; questions are numbered 1, 2, … per student."""

    def make(histories, hints=None, questions=None):
        rows, seq = [], 0
        for student, answers in histories.items():
            for i, answer in enumerate(answers):
                question = questions[student][i] if questions else i + 1
                hint = hints[student][i] if hints else 0
                when = datetime(2024, 1, 1) + timedelta(minutes=i)
                rows.append((student, question, answer, hint, when, seq))
                seq += 1
        return spark.createDataFrame(rows, ATTEMPT_SCHEMA)

    return make


@pytest.fixture
def questions(spark):
    rows = [(i, i % 3 + 1, f" question {i}\n") for i in range(1, 101)]
    return spark.createDataFrame(rows, QUESTION_SCHEMA)


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, v) for v in r]
    )
