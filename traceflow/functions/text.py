"""Words, pieces and white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and numbers of every script and the underscore.
WORD = r"[\p{L}\p{N}_]+"
# A word, or one character that is neither a word character nor blank.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"
# The white space that Python's str.strip removes.
BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _column(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip(text: str | Column) -> Column:
    """Remove white space, not only blanks, on both ends."""
    return F.regexp_replace(_column(text), f"^{BLANK}+|{BLANK}+$", "")


def words(text: str | Column) -> Column:
    """Lower-cased words in order of appearance."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(WORD), F.lit(0))


def pieces(text: str | Column) -> Column:
    """Words and single punctuation characters in order of appearance."""
    return F.regexp_extract_all(_column(text), F.lit(PIECE), F.lit(0))


def piece_count(text: str | Column) -> Column:
    return F.regexp_count(_column(text), F.lit(PIECE))
