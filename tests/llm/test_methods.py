"""Operators against plain versions of the method they are named for."""

import random

import pytest
from pyspark.sql import functions as F

from traceflow.llm import chat, mixing


def plain_queue(rows, targets, repeats=2):
    """Words taken per (source, place) from one sorted queue that is cut at the total budget."""
    packets = []
    for (source, place), (start, size, source_size) in rows.items():
        target = targets[source]
        for turn in range(repeats):
            begin = start + turn * source_size
            own = min(size, max(0, int(target) - begin))
            for beyond, words, end in ((0, own, begin + own), (1, size - own, begin + size)):
                if words:
                    packets.append((end / target, beyond, source or "", place, turn, words))
    left = sum(int(t) for t in targets.values())
    taken = dict.fromkeys(rows, 0)
    for _, _, source, place, _, words in sorted(packets):
        taken[source or None, place] += min(words, left)
        left -= min(words, left)
    return taken


@pytest.mark.parametrize("partitions", [2, 7])
def test_mixing_is_the_cut_queue(spark, partitions):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 900]))) for i in range(150)]
    docs += docs[:3]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = mixing.plan_mix(frame, bucket_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(docs)
    rows, got, targets = {}, {}, {}
    for n, r in enumerate(found):
        targets[r["source"]] = r["target"]
        if r["size"]:
            start = round(r["first_finish"] * r["target"]) - r["size"]
            rows[r["source"], start] = (start, r["size"], r["source_size"])
            got[r["source"], start] = r["taken"]
        else:
            assert r["taken"] == 0
    assert got == plain_queue(rows, targets)


def test_queue_is_cut_inside_one_range(spark):
    queue = spark.range(100).select(
        F.lit("s").alias("source"), F.lit(0).alias("_bucket"), F.col("id").alias("_number"), F.lit(0).alias("turn"),
        F.lit(10).cast("long").alias("words"), (F.col("id") / 100).alias("finish"), F.lit(0).alias("beyond"),
    )
    for budget, want in ((0, []), (235, [10] * 23 + [5]), (5000, [10] * 100)):
        served = [r["served"] for r in mixing.cut_at_budget(queue, budget).orderBy("_number").collect()]
        assert served == want + [0] * (100 - len(want))
    assert mixing.cut_at_budget(queue.limit(0), 10).count() == 0


def test_varied_layouts_keep_all_turns(spark):
    texts = ["", "one", "two\nlines", "\nstart", "end\n", "a\n\nb", "\\\"{}[]", None]
    rows = []
    for i in range(240):
        roles = [("user", "assistant"), ("user", "assistant"), ("human", "gpt"), ("assistant", "user"), ("user",), ("system", "user", "assistant")]
        rows += [(i, k, role, texts[(i + 3 * k) % len(texts)]) for k, role in enumerate(roles[i % len(roles)])]
    rows += [(None, 0, None, "x"), (None, 1, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.canonical_turns(chat.conversation_records(frame, varied=True), paths="paths").collect()
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found} == want
    assert {r["layout"] for r in found} == {layout.name for layout in chat.LAYOUTS}
    assert all(r["paths"] is None for r in found)
