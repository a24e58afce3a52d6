"""Benchmark decontamination with an Aho-Corasick automaton over normalised words.

Every window of 13 consecutive words of a benchmark item is a pattern. Each
distinct benchmark word is one character of the automaton's alphabet, so a
document is scanned once, word by word, whatever its length. Hits are mapped
back to character offsets of the original text.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store, utf8

WINDOW = 13
# UTF-8 bytes of items in one automaton; more are scanned by several, one after the other.
SHARD_BYTES = 4_000_000
# Automata that one stage runs one after the other.
PASSES = 4

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
# A-Z in lower case, separators as spaces, bytes of words as they are.
NORMALISE = bytes(
    b + 32 if 65 <= b <= 90 else b if bytes([b]) in _KEPT else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_UNKNOWN = "\0"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMALISE).split()


def _letter(index: int) -> str:
    """The index-th usable character, surrogates left out."""
    code = index + 1
    return chr(code if code < 0xD800 else code + 0x800)


class Matcher:
    """The automaton of some items (id as text, text)."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            words = words_of(text)
            coded = "".join(
                [self.letters.setdefault(w, _letter(len(self.letters))) for w in words]
            )
            for at in range(max(1, len(words) - WINDOW + 1) if words else 0):
                owners.setdefault(coded[at : at + WINDOW], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, names in owners.items():
            self.automaton.add_word(pattern, (len(pattern), sorted(names)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) that lie in an occurrence, and the items that occur."""
        if self.empty or not words:
            return [], set()
        get = self.letters.get
        ranges, items = [], set()
        for end, (length, names) in self.automaton.iter("".join([get(w, _UNKNOWN) for w in words])):
            ranges.append((end - length + 1, end + 1))
            items.update(names)
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def character_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(NORMALISE))]
    return [
        {
            "start": len(text[: at[a][0]].decode("utf-8", "replace")),
            "end": len(text[: at[b - 1][1]].decode("utf-8", "replace")),
        }
        for a, b in ranges
    ]


_built: dict[int, Matcher] = {}

_HITS = "array<struct<start:int,end:int>>"
_RESULT = f"n_words long, n_hit long, items array<string>, spans {_HITS}"


def _scan_shard(shard: Broadcast, number: int, last: bool, key_type: str):
    """A batch function: adds the hits of one shard, and sums up after the last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _built:
            _built.clear()
            _built[number] = Matcher(shard.value)
        matcher = _built[number]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            counts, hit, found, spans = [], [], [], []
            for scalar, (ranges, items) in zip(texts, before, strict=True):
                text = scalar.as_py()
                words = words_of(text)
                own, names = matcher.scan(words)
                all_ranges = merged([(r["start"], r["end"]) for r in ranges] + own)
                found.append(sorted(names.union(items)))
                counts.append(len(words))
                hit.append(sum(b - a for a, b in all_ranges))
                spans.append(
                    (character_spans(text, all_ranges) if all_ranges else [])
                    if last
                    else [{"start": a, "end": b} for a, b in all_ranges]
                )
            pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            out_items, out_spans = pa.array(found, pa.list_(pa.string())), pa.array(spans, pair)
            if last:
                columns = [ids, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), out_items, out_spans]
                names_out = ["doc_id", "n_words", "n_hit", "items", "spans"]
            else:
                columns, names_out = [ids, texts, out_spans, out_items], ["doc_id", "text", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return scan


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in groups of about ``shard_bytes``; only one group is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8("text").alias("text"))
    items = items.where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for k in range(count):
        yield [(r["item"], bytes(r["text"])) for r in items.where(shard == k).collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items, spans.

    ``items`` are the ids (as text, sorted) of the items with an occurring
    window, ``spans`` the character ranges [start, end) of hit runs in the
    original text. A null text has no words. Items with a null id or text, or
    without words, match nothing; repeated items count once. Texts are scanned
    whole, without a shuffle. The items are broadcast in shards of bounded size.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = [context.broadcast(s) for s in _shards(benchmark, shard_bytes)]
    rows = docs.select(
        "doc_id",
        utf8("text").alias("text"),
        F.array().cast(_HITS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k, shard in enumerate(shards[:-1], 1):
        number = shard._jbroadcast.id()
        rows = rows.mapInArrow(
            _scan_shard(shard, number, False, kind),
            f"doc_id {kind}, text binary, spans {_HITS}, items array<string>",
        )
        # Each pass in a row has a Python worker of its own.
        if k % PASSES == 0:
            rows = store(rows)
    number = shards[-1]._jbroadcast.id()
    return rows.mapInArrow(_scan_shard(shards[-1], number, True, kind), f"doc_id {kind}, {_RESULT}")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; all columns as they are."""
    found = find_contamination(docs, benchmark).where(is_contaminated())
    return docs.join(found.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")
