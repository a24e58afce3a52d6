"""URL filter: parsing and rules against plain code, trees by held-out accuracy."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traceflow.llm import queries, urls

SF = "/root/testdata/sf0.01"


def parsed(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest).group() if mark else ""
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if mark else ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path, rules=urls.RULES):
    fits = []
    for rule, verdict in rules:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


EDGES = [
    None,
    "",
    "no scheme at all",
    "http://",
    "http:///en/",
    "://net/",
    "HTTP://WWW.Example.NET/en/a?b=c://d",
    "http://example.net/EN/",
    "http://example.net",
    "http://example.net?x=/en/",
    "http://a.net#/x",
    "http://xnet/",
    "http://x.net:80/",
    "http://user@a.example.com/de/x//y",
    "http://notexample.com/de/",
    "ftp://x://y.org/fr/",
    "http://org/fr/",
    "http://\u00c4.net/\u00e9?\u00fc#\u00df",
    "http://a.org/fr/" + "x/" * 50_000,
    "http://a.com/\nb?\nc#\n",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(EDGES)] + [(None, EDGES[6], "x", "y"), (6, EDGES[6], "x", "y")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    want = []
    for i, u, _, _ in rows:
        host, path = parsed(u)
        want.append((i, host, path, *ruled(host, path)))
    kept = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got.collect()]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in got.collect()} <= {"allow", "block"}


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in queries.op11_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for r in pages:
        host, path = parsed(r["url"])
        rule, verdict = ruled(host, path)
        found = got[r["page_id"]]
        assert (found["host"], found["path"], found["rule"]) == (host, path, rule)
        assert found["verdict"] == (verdict or ("block" if found["score"] >= 0.5 else "allow"))


def test_longest_rule_wins_and_ties_block(spark):
    rules = [("b.c/", "allow"), ("a.b.c/", "block"), ("b.c/x/", "allow"), ("c/abcd", "allow"), ("b.c/ab", "block")]
    hosts = [("a.b.c", "/x/y"), ("a.b.c", "/"), ("b.c", "/abcd"), ("c", "/abcde"), ("bb.c", "/x/")]
    df = spark.createDataFrame(hosts, "host string, path string").select("*", urls.matching_rule(rules).alias("r"))
    assert [r["r"] and tuple(r["r"]) for r in df.collect()] == [
        ("a.b.c/", "block"),
        ("a.b.c/", "block"),
        ("b.c/ab", "block"),
        ("c/abcd", "allow"),
        None,
    ]
    with pytest.raises(ValueError):
        urls.matching_rule([("net", "block")])


def test_features(spark):
    rows = [("http://a.b/c/d1/?x=1&y=22&&z#f=3",), ("",), (None,), ("aaaa",), ("\u00e9\u00fc" * 4,)]
    df = spark.createDataFrame(rows, "url string").select("url", urls.host_of().alias("host"), urls.path_of().alias("path"))
    for r in urls.with_features(df).collect():
        text = r["url"] or ""
        counts = Counter(text)
        bits = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
        assert r["entropy"] == pytest.approx(bits, abs=1e-9)
        assert r["url_length"] == len(text)
        assert r["digit_ratio"] == pytest.approx(sum(c.isdigit() for c in text) / max(1, len(text)))
    first = urls.with_features(df).first()
    assert (first["depth"], first["n_params"], first["n_labels"], first["query_length"]) == (2, 3, 2, 11)


def test_suffix_statistics_cover_all_labelled(spark):
    told = [("a.x.com", 1), ("b.x.com", 1), ("x.com", 0), ("com", 1), ("a.x.com", 1)]
    found = urls.suffix_statistics(spark.createDataFrame(told, "host string, block int"))
    assert {r["suffix"]: (r["n"], r["blocked"]) for r in found.collect()} == {
        "1:com": (5, 4),
        "2:x.com": (4, 3),
        "2:com": (1, 1),
        "0:a.x.com": (2, 2),
        "0:b.x.com": (1, 1),
        "0:x.com": (1, 0),
        "0:com": (1, 1),
    }


def made_up(rng):
    """Spam has many parameters, digits and a deep path; the host tells nothing."""
    block = rng.random() < 0.4
    host = "".join(rng.choice("abcdef") for _ in range(6)) + rng.choice([".com", ".info"])
    depth = rng.randint(3, 7) if block else rng.randint(1, 4)
    path = "/".join(("%06d" % rng.randrange(10**6)) if block else "page" for _ in range(depth))
    query = "&".join(f"k{i}={rng.randrange(99)}" for i in range(rng.randint(2, 5) if block else rng.randint(0, 2)))
    return f"http://{host}/{path}?{query}", int(block)


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    told = [made_up(rng) for _ in range(600)]
    asked = [made_up(rng) for _ in range(400)]
    labelled = spark.createDataFrame([*told, (None, 1), ("http://x.y/", None), ("http://x.y/", 7)], "url string, block int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(asked)], "page_id long, url string")
    judged = urls.judge_urls(pages, rules=(), labelled=labelled, sample_rows=200).cache()
    got = {r["page_id"]: r for r in judged.collect()}
    right = sum((got[i]["verdict"] == "block") == bool(b) for i, (_, b) in enumerate(asked))
    assert right / len(asked) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["rule"] is None for r in got.values())
    again = urls.judge_urls(pages.repartition(7), rules=(), labelled=labelled.repartition(5), sample_rows=200)
    assert {r["page_id"]: r["verdict"] for r in again.collect()} == {i: r["verdict"] for i, r in got.items()}


def test_nothing_or_one_label_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.info/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(pages).collect()} == {"allow"}
    blocked = spark.createDataFrame([("http://b.info/", 1)], "url string, block int")
    assert {r["verdict"] for r in urls.judge_urls(pages, labelled=blocked).collect()} == {"block"}
    assert urls.judge_urls(pages.limit(0)).count() == 0
    nulls = urls.judge_urls(pages.withColumn("url", F.lit(None)))
    assert nulls.select("host", "path").distinct().collect() == [("", "")]
