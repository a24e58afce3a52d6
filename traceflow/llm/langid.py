"""Language identification by cross-parsing entropy.

Each language has a bounded sample of labelled text and the suffix automaton of
it. A text is parsed greedily into the longest phrases that occur in a sample;
``phrases * log2(sample length)`` is the cost of the text in that language and
the language with the least cost wins. The automaton is laid out as a dense
table, in which a missing transition holds the state after a phrase break, so a
batch of texts is parsed in step with one table look-up per symbol.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bounds of the training sample of each language.
SAMPLE_ROWS = 64
SAMPLE_CHARS = 512
# Long texts are cut into stretches of this many symbols, each parsed from the root.
STRETCH = 1024
# Symbols that are parsed at once.
SLAB = 2_000_000
# Texts that are Python strings at once where only a flag of each is asked for.
KEPT_ROWS = 4096

_SPACE = 0
_OTHER_LETTER = 255


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no language may be learned from; null ids are never held out."""
    part = F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1
    return F.coalesce(part, F.lit(False))


def training_sample(
    docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> dict[str, list[str]]:
    """Per language, ``rows`` pieces of up to ``chars`` characters of labelled text.

    Rows are chosen by a hash of doc_id. The number of rows per language is
    counted first, and only about twice the wanted share is ranked, so no
    language is sorted as a whole. The result is bounded by the number of
    languages times ``rows * chars`` characters.
    """
    labelled = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~is_held_out()
    ).select("lang", "doc_id", "text", F.abs(F.xxhash64("doc_id")).alias("_order"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.least(F.lit(1.0), F.lit(2.0 * rows + 16) / F.col("_rows")) * F.lit(float(2**63))
    near = labelled.join(F.broadcast(sizes), "lang").where(F.col("_order") <= limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id", "text"))
    picked = (
        near.withColumn("_rank", rank)
        .where(F.col("_rank") <= rows)
        .select("lang", "_rank", F.substring("text", 1, chars).alias("piece"))
    )
    found: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "_rank").collect():
        found.setdefault(row["lang"], []).append(row["piece"])
    return found


def _suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions ``[state * width + symbol]``: next state times ``width``, or ``~`` the state after a break."""
    links, lengths, moves = [-1], [0], [{}]
    last = 0
    for c in symbols:
        new = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                twin = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = links[p]
                links[q] = links[new] = twin
        last = new
    # A symbol the sample lacks is a phrase of its own: one more state, which nothing continues.
    alone = len(moves)
    after_break = np.full(width, alone * width, np.int32)
    for c, target in moves[0].items():
        after_break[c] = target * width
    table = np.tile(~after_break, (len(moves) + 1, 1)).astype(np.int32)
    table[0] = after_break
    for state, out in enumerate(moves):
        for c, target in out.items():
            table[state, c] = target * width
    return table.ravel()


class CrossParser:
    """Automata of all languages over one alphabet; costs of many texts at once."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        letters = sorted({c for s in samples.values() for t in s for c in t.lower() if c.isalpha()})
        self._ids = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            if chr(code).isalpha():
                self._ids[code] = _OTHER_LETTER
        # Alphabets beyond 250 letters share ids, which only makes phrases longer.
        known = {c: 1 + i % 250 for i, c in enumerate(letters)}
        for code in np.flatnonzero(self._ids):
            lower = chr(code).lower()
            if lower in known:
                self._ids[code] = known[lower]
        self.width = max(known.values(), default=0) + 2
        self._ids[self._ids == _OTHER_LETTER] = self.width - 1
        self._tables, self._weight = [], []
        for language in self.languages:
            symbols = self._symbols(" ".join(samples[language])).tolist()
            self._tables.append(_suffix_automaton(symbols, self.width))
            self._weight.append(float(np.log2(max(2, len(symbols)))))

    def _symbols(self, text: str) -> np.ndarray:
        """Letters as small numbers, every run of anything else as one space."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self._ids[codes]
        if len(ids) > 1:
            ids = ids[np.r_[True, (ids[1:] != _SPACE) | (ids[:-1] != _SPACE)]]
        return ids

    def _phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stretch (rows) in each language (columns)."""
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        grid = np.zeros((int(lengths[0]), len(stretches)), np.int32)
        for column, i in enumerate(order):
            grid[: lengths[column], column] = stretches[i]
        alive = np.searchsorted(-lengths, -np.arange(1, len(grid) + 1), side="right")
        out = np.empty((len(stretches), len(self.languages)), np.int64)
        for k, table in enumerate(self._tables):
            state = np.zeros(len(stretches), np.int32)
            breaks = np.zeros(len(stretches), np.int32)
            for row, n in zip(grid, alive, strict=True):
                step = table.take(row[:n] + state[:n])
                broken = step >> 31
                breaks[:n] -= broken
                state[:n] = step ^ broken
            out[order, k] = breaks + (state != 0)
        return out

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cost per symbol of each text in each language, and whether it has a letter."""
        costs = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        stretches: list[np.ndarray] = []
        owners: list[int] = []
        held = 0

        def parse() -> None:
            if stretches:
                np.add.at(costs, owners, self._phrases(stretches))
                stretches.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            ids = self._symbols(text)
            letters[i] = bool(ids.any())
            sizes[i] = len(ids)
            if not letters[i] or not self.languages:
                continue
            for at in range(0, len(ids), STRETCH):
                stretches.append(ids[at : at + STRETCH])
                owners.append(i)
                held += min(STRETCH, len(ids) - at)
                if held >= SLAB:
                    parse()
                    held = 0
        parse()
        costs *= np.array(self._weight)
        return costs / np.maximum(sizes, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether there is a letter, for each text."""
        costs, letters = self.costs(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), letters.tolist()
        best = costs.argmin(axis=1)
        least = costs[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(costs, 1, axis=1)[:, 1]
        else:
            second = np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(second > 0, 1.0 - least / second, 0.0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0).tolist(), letters.tolist()


_built: dict[int, CrossParser] = {}


def _parsed(docs: DataFrame, samples: dict[str, list[str]] | None, columns: list[str], text: str, schema: str) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score and letters (whether the text has one) of column ``text``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(training_sample(docs) if samples is None else samples)
    # Known to the driver only; tells a reused worker that its parser is of another model.
    number = model._jbroadcast.id()
    place = columns.index(text)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _built:
            _built.clear()
            _built[number] = CrossParser(model.value)
        for batch in batches:
            names, scores, letters = _built[number].predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "letters"],
            )

    return docs.select(*columns).mapInArrow(parse, f"{schema}, lang_pred string, score double, letters boolean")


def identify(docs: DataFrame, samples: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``samples`` default to those of ``training_sample(docs)``; predictions see
    the whole text and nothing else. ``und`` (score 0) stands for a null text, a
    text without a letter, or a corpus without labels. ``score`` is one minus
    the ratio of the least to the second least cost, 1.0 if only one language
    was learned. Equal costs go to the language first in order. Texts longer
    than a stretch are parsed in stretches, all of which count. Repeated rows
    are answered row by row and other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = training_sample(docs) if samples is None else samples
    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    found = _parsed(
        rows, learned, ["doc_id", "held_out", "text"], "text", f"doc_id {kind}, held_out boolean, text string"
    )
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; columns stay as they are.

    A row goes if its own text is null or has no letter, in no language and whatever its doc_id is. Rows stay
    when there are no labels to learn from. Decisions are made row by row, so repeated ids
    and rows do not touch each other; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(training_sample(docs))

    # Texts alone go to Python and one flag comes back; the rows wait beside it.
    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = CrossParser(model.value)
        for texts in batches:
            found = []
            for at in range(0, len(texts), KEPT_ROWS):
                names, _, letters = parser.predict(texts.slice(at, KEPT_ROWS).to_pylist())
                found += [name != "und" or letter for name, letter in zip(names, letters, strict=True)]
            yield pa.array(found, pa.bool_())

    return docs.where(identified(F.col("text").cast("string")))
