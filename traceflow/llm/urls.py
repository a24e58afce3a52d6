"""URL filter: rules first, then gradient-boosted trees on lexical features.

Features of a URL are its lengths, depth, digit share, character entropy, counts of
parameters and of labels, and statistics of the suffixes of its host: how many labelled URLs
share the suffix and which part of them is blocked. The statistics cover all labelled
URLs; the trees are fitted on a bounded sample of them.
"""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import ascii_lower, store
from traceflow.operators.joins import lookup_join

ALLOW, BLOCK = "allow", "block"
# The rules of the registered query.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

# Labelled URLs the trees are fitted on, those with the smallest hashes of each verdict. Up to
# 10,000 rows in all, every distinct value can become a split.
SAMPLE_ROWS = 5_000
TREES, DEPTH = 10, 3
# Suffix statistics count as if this many labelled URLs of the average verdict were added.
PRIOR = 5.0
# Suffixes of a host that have statistics: its last label, its last two, all of it.
SUFFIX_LABELS = (1, 2, 0)

LEXICAL = (
    "url_length",
    "host_length",
    "path_length",
    "query_length",
    "depth",
    "n_labels",
    "n_params",
    "digit_ratio",
    "other_ratio",
    "entropy",
)


def host_of(url: str = "url") -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    text = F.col(url).cast("string")
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise("")


def matching_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits columns host and path, as a struct of rule and verdict, else null.

    A rule is a host, then a path that starts with ``/``. It fits its host and all below it, where the path starts
    with the rule's. Of equally long rules that fit the one that blocks wins, then the least.
    """
    # Literals in order of preference: the list of rules is a parameter of the plan, not data.
    ranked = sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != BLOCK, r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(ranked):
        host, slash, path = rule.partition("/")
        if verdict not in (ALLOW, BLOCK) or not slash:
            raise ValueError(f"rule {rule!r} with verdict {verdict!r}")
        name = F.col("host")
        fits = ((name == host) | F.endswith(name, F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character of a text by its own character counts; 0 for an empty text."""
    chars = F.array_sort(F.split(text, ""))
    n = F.size(chars).cast("double")

    def bits(state: Column) -> Column:
        return state["sum"] + state["run"] * F.log2(F.greatest(state["run"], F.lit(1.0)))

    def step(state: Column, char: Column) -> Column:
        same = state["last"] == char
        return F.struct(
            char.alias("last"),
            F.when(same, state["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["sum"]).otherwise(bits(state)).alias("sum"),
        )

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    total = F.aggregate(chars, start, step, bits)
    return F.when(F.char_length(text) > 0, F.greatest(F.log2(n) - total / n, F.lit(0.0))).otherwise(F.lit(0.0))


def _suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels) if labels else F.col("host")


def with_features(urls: DataFrame) -> DataFrame:
    """Add the lexical features of column url; needs host and path."""
    text = F.coalesce(F.col("url").cast("string"), F.lit(""))
    length = F.char_length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def share(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, "")) / F.greatest(length, F.lit(1))

    columns = {
        "url_length": length,
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "query_length": F.char_length(query),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "n_labels": F.size(F.split("host", r"\.")),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "digit_ratio": share("[^0-9]"),
        "other_ratio": share("[A-Za-z0-9]"),
        "entropy": entropy(text),
    }
    return urls.withColumns({k: columns[k].cast("double") for k in LEXICAL})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, n, blocked) of the host suffixes of all labelled URLs (host, block).

    A suffix carries the number of its labels in front, so that ``com`` as a last label and as
    a whole host are two.
    """
    suffixes = F.array(*[F.concat(F.lit(f"{k}:"), _suffix(k)) for k in SUFFIX_LABELS])
    return (
        labelled.select(F.explode(suffixes).alias("suffix"), "block")
        .groupBy("suffix")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("blocked"))
    )


def _with_suffixes(urls: DataFrame, statistics: DataFrame, base: float) -> DataFrame:
    """Add per suffix the part that is blocked, drawn to the average, and the logarithm of its count.

    A labelled row, one whose block is not null, does not count itself.
    """
    for k in SUFFIX_LABELS:
        key, own = f"_suffix_{k}", F.col("block").isNotNull().cast("long")
        found = statistics.select(F.col("suffix").alias(key), F.col("n").alias("_n"), F.col("blocked").alias("_blocked"))
        keyed = urls.withColumn(key, F.concat(F.lit(f"{k}:"), _suffix(k)))
        n = F.coalesce("_n", F.lit(0)) - own
        blocked = F.coalesce("_blocked", F.lit(0)) - F.coalesce("block", F.lit(0))
        urls = (
            lookup_join(keyed, found, key, row_key=["url"])
            .withColumns(
                {
                    f"blocked_{k}": (blocked + PRIOR * base) / (n + PRIOR),
                    f"count_{k}": F.log1p(n.cast("double")),
                }
            )
            .drop(key, "_n", "_blocked")
        )
    return urls


def _assembled(urls: DataFrame) -> DataFrame:
    names = [*LEXICAL, *[f"{kind}_{k}" for k in SUFFIX_LABELS for kind in ("blocked", "count")]]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(urls)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A URL that a rule fits gets the verdict of ``matching_rule``. All others get
    that of trees fitted on ``labelled`` (url, block 0 or 1); without it the URLs that the rules judge
    are the labelled ones. ``score`` is the trees' probability of block, null where a rule decided.
    The fit reads at most ``sample_rows`` distinct URLs of either label, those with the smallest hashes;
    suffix statistics cover all labelled URLs.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are judged
    by their features. Without labelled URLs all others are allowed; if all have one label it
    is the verdict. Labels that are null or neither 0 nor 1 are left out. Repeated rows and null ids
    are returned as they come, an empty table gives no rows, other columns are ignored. Texts are read whole.
    """
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host_of().alias("host"), path_of().alias("path")
    )
    ruled = parsed.withColumn("_rule", matching_rule(rules))
    decided = F.col("_rule").isNotNull()
    if labelled is None:
        told = ruled.where(decided).select("url", "host", (F.col("_rule.verdict") == BLOCK).cast("int").alias("block"), "path")
    else:
        told = labelled.select(F.col("url").cast("string").alias("url"), F.col("block").cast("int").alias("block")).select(
            "url", host_of().alias("host"), "block", path_of().alias("path")
        )
    told = told.where("url is not null and block in (0, 1)")
    rest = ruled.where(~decided).select("page_id", "url", "host", "path", F.lit(None).cast("int").alias("block"))
    columns = ["page_id", "host", "path"]
    by_rule = ruled.where(decided).select(
        *columns, "_rule.rule", "_rule.verdict", F.lit(None).cast("double").alias("score")
    )

    counts = {r["block"]: r["n"] for r in told.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    no_rule = F.lit(None).cast("string").alias("rule")
    if len(counts) < 2:
        only = float(counts.get(1, 0) > 0)
        verdict = F.lit(BLOCK if only else ALLOW).alias("verdict")
        return by_rule.unionByName(rest.select(*columns, no_rule, verdict, F.lit(only).alias("score")))

    base = counts[1] / sum(counts.values())
    statistics = store(suffix_statistics(told))
    kept = ["url", "host", "path", "block"]
    order = [F.xxhash64("url", F.lit(seed)), F.col("url")]
    picked = [told.where(F.col("block") == k).select(*kept).distinct().orderBy(*order).limit(sample_rows) for k in (0, 1)]
    sample = _assembled(_with_suffixes(with_features(picked[0].unionByName(picked[1])), statistics, base))
    fitted = GBTClassifier(
        featuresCol="_features", labelCol="block", maxIter=TREES, maxDepth=DEPTH, seed=seed
    ).fit(store(sample.select("_features", "block")).coalesce(1))
    fitted = fitted.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    judged = fitted.transform(_assembled(_with_suffixes(with_features(rest), statistics, base)))
    scored = judged.select(*columns, vector_to_array("_probability")[1].alias("score"))
    verdict = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW).alias("verdict")
    return by_rule.unionByName(scored.select(*columns, no_rule, verdict, "score"))

