"""Registered queries: each takes a session and a table folder.

Lists are shown as joined text so that every result is flat.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceflow.functions.features import model_inputs, truncate_steps
from traceflow.functions.parsing import (
    answer_word,
    flag,
    is_padded,
    last,
    threshold,
    tolerant_int,
    tolerant_ints,
    verdict,
)
from traceflow.functions.text import strip
from traceflow.operators import (
    history,
    linear,
    lookups,
    metrics,
    models,
    modeltables,
    packing,
    prompts,
    sampling,
    scoring,
    selection,
    slices,
    splits,
    stats,
    vocabulary,
)
from traceflow.operators.ranking import hash_positions
from traceflow.schemas import SEQUENCE_FILE
from traceflow.session import checkpoint
from traceflow.sources import readers
from traceflow.sources import testtables as tt
from traceflow.sources.writers import json_records, training_text

Query = Callable[[SparkSession, str], DataFrame]

# Between prompts of ten and of twenty steps.
PROMPT_BUDGET = 700

LISTS = ["question_ids", "answers", "difficulties", "hint_used"]
SEQUENCE_KEY = ["student_id", "chunk"]


def joined(name: str, separator: str = ",") -> Column:
    """A list as text, in which a missing value shows as ``?``."""
    return F.array_join(F.col(name).cast("array<string>"), separator, "?").alias(name)


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            joined(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def _sequences(spark: SparkSession, sf: str, *lengths: int, labelled: bool = False) -> DataFrame:
    log = tt.attempts(spark, sf)
    split = splits.student_split(log) if labelled else None
    return history.sequences(log, tt.questions(spark, sf), lengths, split)


def _matrix(name: str) -> Column:
    """A matrix of whole numbers as text: steps by ``;`` and values by ``,``."""
    rows = F.col(name).cast("array<array<bigint>>").cast("array<array<string>>")
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";").alias(name)


def sequences_of(n: int) -> Query:
    return lambda spark, sf: flat(_sequences(spark, sf, n))


def history_positions(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_positions(tt.attempts(spark, sf)).select(
        "student_id", "seq", "pos", "history_len"
    )


def history_positions_large(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all but the shortest histories on the path for hot students."""
    found = history.history_positions(tt.attempts(spark, sf), hot_rows=60)
    return found.select("student_id", "seq", "pos", "history_len")


def sequences_large(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled sequences with long histories on the path for hot students."""
    log = tt.attempts(spark, sf)
    split = splits.student_split(log)
    return flat(history.sequences(log, tt.questions(spark, sf), (5, 10, 20), split, hot_rows=60))


def student_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.student_split(tt.attempts(spark, sf))


def sequences_by_split(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_sequences(spark, sf, 5, 10, 20, labelled=True))


def fold_members(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _sequences(spark, sf, 5, 10, 20, labelled=True)
    return splits.expand_folds(labelled).select("n", "split", "fold", "student_id", "chunk")


def fold_union(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _sequences(spark, sf, 20, labelled=True).select("student_id", "chunk", "block")
    return stats.union_all(
        labelled.where(splits.in_training(1)).withColumn("split", F.lit("train")),
        labelled.where(splits.in_validation(1)).withColumn("split", F.lit("val")),
        labelled.where(splits.in_test()).withColumn("split", F.lit("test")),
    ).drop("block")


def distinct_students(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_students(tt.attempts(spark, sf))


def student_ids(spark: SparkSession, sf: str) -> DataFrame:
    return splits.distinct_students(tt.attempts(spark, sf))


def questions_per_student(spark: SparkSession, sf: str) -> DataFrame:
    return stats.questions_per_student(tt.attempts(spark, sf))


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _sequences(spark, sf, 20, labelled=True)
    return stats.split_sizes(labelled.withColumn("split", splits.split_name(1)))


def correct_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correct_ratio(_sequences(spark, sf, 20, labelled=True))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    log = tt.attempts(spark, sf).select("student_id", "question_id", "answer", "seq")
    return stats.preview(log.orderBy("seq"))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    events = tt.table(spark, sf, "events")
    return events.select(
        "event_id",
        flag(F.col("event_type") != "error").alias("answer"),
        flag((F.col("value") > 100).cast("string")).alias("hint"),
        flag("event_type").alias("not_a_flag"),
    )


def stripped_text(spark: SparkSession, sf: str) -> DataFrame:
    return tt.texts(spark, sf).select("doc_id", strip("text").alias("text"))


def leading_slice(spark: SparkSession, sf: str) -> DataFrame:
    return flat(slices.leading_slice(_sequences(spark, sf, 5), SEQUENCE_KEY, 100))


def leading_slice_compat(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sequences(spark, sf, 5).select("student_id", "chunk")
    return slices.leading_slice(rows, SEQUENCE_KEY, -1, compat=True)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return tt.scored_lines(spark, sf).withColumn("pred", threshold("conf"))


def position_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predictions(spark, sf)
    report = slices.position_slice(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "label", "conf"], 55, 66)
    return report.withColumn("verdict", verdict("label", "pred", "conf")).withColumn(
        "percent", F.round(F.col("conf") * 100, 6)
    ).drop("conf")


def position_slice_ranged(spark: SparkSession, sf: str) -> DataFrame:
    """Every position of the training log, from a range sort instead of a top-k."""
    log = tt.attempts(spark, sf).select("student_id", "seq", "start_time")
    placed = slices.position_slice(log, ["start_time", "seq"], 0, 2**62, top_rows=0)
    return placed.select("seq", "pos")


def features_json(spark: SparkSession, sf: str) -> DataFrame:
    inputs = model_inputs(_sequences(spark, sf, 5), 5)
    return json_records(inputs.select("student_id", "chunk", "features", "label"))


def tolerant_integers(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split(F.col("props"), "[:}]")
    return tt.table(spark, sf, "events").select(
        "event_id",
        joined_expression(tolerant_ints(parts)).alias("parsed"),
        tolerant_int(F.col("value").cast("string")).alias("from_text"),
        tolerant_int("value").alias("from_number"),
        tolerant_int("event_type").alias("from_word"),
    )


def joined_expression(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def unpadded(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of numbers as text; those of an error event hold a non-number."""
    events = tt.table(spark, sf, "events")
    answers = F.array(
        F.get_json_object("props", "$.k"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.lit("1")),
    )
    parsed = events.select("event_id", tolerant_ints(answers).alias("answers"))
    return flat(parsed.where(~is_padded("answers")))


def truncated(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sequences(spark, sf, 10)
    cut = truncate_steps(rows, 5, LISTS)
    return flat(cut.withColumn("last_correct", (last("answers") == 1).cast("int")))


def kc_link(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.kc_link(tt.question_kc(spark, sf), tt.kcs(spark, sf))


def kc_link_salted(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a shuffle join with every frequent topic salted."""
    return lookups.kc_link(tt.question_kc(spark, sf), tt.kcs(spark, sf), max_rows=0, hot_rows=500)


def kc_rule(rule: str) -> Query:
    return lambda spark, sf: lookups.one_kc(tt.question_kc(spark, sf), rule, tt.KC_ORDER)


def _enriched(spark: SparkSession, sf: str, *lengths: int) -> DataFrame:
    return lookups.enrich_steps(
        _sequences(spark, sf, *(lengths or (5,))),
        tt.questions(spark, sf),
        lookups.one_kc(tt.question_kc(spark, sf), "first", tt.KC_ORDER),
    )


def sequence_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return flat(_enriched(spark, sf))


def downsampled(spark: SparkSession, sf: str) -> DataFrame:
    labels = tt.table(spark, sf, "labels")
    return sampling.downsample(labels, "quality", ["doc_id"])


def downsampled_sequences(spark: SparkSession, sf: str) -> DataFrame:
    train = _sequences(spark, sf, 5, labelled=True).where(splits.in_training(1))
    # Written once, as balancing reads its input several times.
    rows = checkpoint(train.select("student_id", "chunk", last("answers").alias("label")))
    return sampling.downsample(rows, "label", SEQUENCE_KEY)


def features_n5(spark: SparkSession, sf: str) -> DataFrame:
    inputs = model_inputs(_sequences(spark, sf, 5), 5)
    return inputs.select("student_id", "chunk", _matrix("features"), "label")


def features_kc_n5(spark: SparkSession, sf: str) -> DataFrame:
    topics = lookups.one_kc(tt.question_kc(spark, sf), "last", tt.KC_ORDER)
    inputs = model_inputs(lookups.with_kc(_sequences(spark, sf, 5), topics), 5, with_kc=True)
    return inputs.select("student_id", "chunk", _matrix("features"), "label")


def _label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    labels = tt.table(spark, sf, "labels")
    return metrics.pair_predictions(
        labels.select("doc_id", F.col("quality").alias("label")),
        labels.select("doc_id", F.col("toxic").alias("pred")),
        "doc_id",
    )


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(_label_pairs(spark, sf))


def auc_pred(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(_label_pairs(spark, sf), score="pred")


def auc_score(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(tt.scored_lines(spark, sf))


def auc_score_by_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = tt.table(spark, sf, "lineitem").select(
        "l_returnflag",
        (F.col("l_linestatus") == "O").cast("int").alias("label"),
        F.col("l_extendedprice").alias("conf"),
    )
    return metrics.auc(rows, by=["l_returnflag"])


def _word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as words; some wrong answers come in a malformed spelling."""
    odd = (F.col("quality") == 0) & (F.col("toxic") == 0)
    return tt.table(spark, sf, "labels").select(
        "doc_id",
        answer_word("quality").alias("gt"),
        F.when(odd, F.lit("Wrong.")).otherwise(answer_word("toxic")).alias("pred"),
    )


def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exact_match(_word_pairs(spark, sf))


def word_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.word_metrics(_word_pairs(spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "label",
        "pred",
        verdict("label", "pred", "conf").alias("verdict"),
    )


def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.mean_loss(tt.scored_lines(spark, sf))
    return loss.select(*[F.round(c, 8).alias(c) for c in loss.columns])


def _run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Line items grouped into runs, as if each had been predicted by one run."""
    lengths = F.array(F.lit(5), F.lit(10), F.lit(20))
    depths = F.array(F.lit(1), F.lit(2), F.lit(5))
    length_no = F.pmod(F.col("l_linenumber"), F.lit(3))
    depth_no = F.pmod(F.col("l_suppkey"), F.lit(3)).cast("int")
    rows = tt.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.get(lengths, length_no).alias("n"),
        F.get(depths, depth_no).alias("layers"),
        F.month("l_shipdate").alias("epoch"),
        F.when(F.col("l_tax") < 0.04, F.lit("val")).otherwise(F.lit("test")).alias("split"),
        (length_no * 3 + depth_no).cast("int").alias("grid_order"),
        (F.col("l_linestatus") == "O").cast("int").alias("label"),
        (F.col("l_discount") >= 0.05).cast("int").alias("pred"),
    )
    return metrics.binary_metrics(
        rows, by=["model", "n", "layers", "epoch", "split", "grid_order"]
    )


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    return _run_log(spark, sf)


def best_run(spark: SparkSession, sf: str) -> DataFrame:
    return selection.best_run(_run_log(spark, sf), ["model", "n", "layers", "split"])


def _flat_best(best: DataFrame) -> DataFrame:
    fields = [
        F.col(f"{side}.{name}").alias(f"{side}_{name}")
        for side in ("val", "test")
        for name in ("epoch", *selection.METRICS)
    ]
    return best.select("model", "n", "layers", *fields)


def best_config(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_best(selection.best_config(_run_log(spark, sf)))


def best_config_at_val(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_best(selection.best_config(_run_log(spark, sf), test_at="val"))


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.vocabulary(tt.texts(spark, sf))


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.word_counts(tt.texts(spark, sf))


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tt.table(spark, sf, "embeddings").select("vec_id", "embedding")
    # Words are spread over all vectors, of which some stay without a word.
    many = vectors.count()

    def word_key(word: Column) -> Column:
        digest = F.conv(F.substring(F.md5(word), 1, 12), 16, 10).cast("long")
        return F.pmod(digest, F.lit(many))

    pooled = vocabulary.mean_vectors(tt.texts(spark, sf), vectors, word_key)
    shown = F.transform("embedding", lambda v: F.round(v * 1e6).cast("long").cast("string"))
    return pooled.select("doc_id", F.array_join(shown, ",").alias("embedding"))


def training_lines(spark: SparkSession, sf: str) -> DataFrame:
    return training_text(_sequences(spark, sf, 5)).select("student_id", "chunk", "line", "value")


def shuffled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Training lines with their place in the shuffled file."""
    rows = prompts.training_lines(_sequences(spark, sf, 5))
    return hash_positions(
        rows.select("student_id", "n", "chunk", "line"), ["student_id", "n", "chunk"], seed=1
    ).select("pos", "line")


def packed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = packing.pack_blocks(tt.texts(spark, sf), ["doc_id"])
    return blocks.select("block", F.array_join("tokens", " ").alias("tokens"))


def _prompts(spark: SparkSession, sf: str, n: int = 5, **parts) -> DataFrame:
    return prompts.build_prompts(_enriched(spark, sf, n), **parts)


def all_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select(
        "student_id",
        "chunk",
        F.size("prompt").alias("messages"),
        prompts.prompt_text("prompt").alias("prompt"),
        "gt",
    )


def prompts_in_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of three lengths, of which the budget keeps the shorter ones."""
    rows = prompts.within_budget(
        prompts.build_prompts(_enriched(spark, sf, 5, 10, 20)), max_tokens=PROMPT_BUDGET
    )
    return rows.select(
        "student_id", "n", "chunk", "tokens", prompts.prompt_text("prompt").alias("prompt"), "gt"
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prompts(spark, sf, incl_id=False, incl_q=False).select(
        "student_id", "chunk", "prompt", "gt"
    )
    return scoring.score_prompts(rows, scoring.previous_answer).drop("prompt")


def batch_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def batch_scored_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.word_metrics(_scored(spark, sf))


def batch_scored_exact(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exact_match(_scored(spark, sf))


def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    scored = models.fit_and_predict(_sequences(spark, sf, 5, labelled=True), 5)
    return scored.select("student_id", "chunk", "label", "pred", F.round("conf", 8).alias("conf"))


def _linear_inputs(spark: SparkSession, sf: str, n: int) -> DataFrame:
    rows = _sequences(spark, sf, n, labelled=True).withColumn("split", splits.split_name(1))
    return checkpoint(model_inputs(rows, n).select("n", "split", "label", "vector"))


def linear_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Bias and weights of two configurations after each of three epochs, with their training loss."""
    train = _linear_inputs(spark, sf, 5).where("split = 'train'")
    fitted = linear.fit(train, 5, (1, 5), epochs=3, steps=8)
    numbers = F.posexplode(F.concat(F.array("bias"), "weights")).alias("j", "weight")
    return fitted.select("model", "n", "layers", "epoch", F.round("train_loss", 8).alias("train_loss"), numbers).withColumn(
        "weight", F.round("weight", 8)
    )


def linear_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and loss of each epoch on validation and hold-out students."""
    inputs = _linear_inputs(spark, sf, 10)
    fitted = linear.fit(inputs.where("split = 'train'"), 10, (1, 2), epochs=3, steps=8)
    return linear.epoch_metrics(fitted, inputs.where("split <> 'train'")).withColumn("loss", F.round("loss", 8))


def stump_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of a boosted tree of depth one, as rows of the table of models."""
    train = _linear_inputs(spark, sf, 5).where("split = 'train'")
    fitted = models.fit(train, "trees", 1, iterations=1)
    table = modeltables.from_trees(spark, fitted, ("trees", 5, 1, 0))
    return modeltables.node_rows(table).select(
        "tree", F.col("node").cast("long").alias("node"), "feature", "threshold", "low", "high", F.round("value", 8).alias("value")
    )


def grid_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out scores of nine models of three families, in one pass over the sequences."""
    inputs = _linear_inputs(spark, sf, 5)
    train, width = inputs.where("split = 'train'"), 10
    table = modeltables.from_linear(linear.fit(train, 5, (1, 2, 5)))
    for depth in (1, 2, 5):
        trees = models.fit(train, "trees", depth, iterations=5)
        layers = models.fit(train, "layers", depth, width=width, iterations=5)
        table = table.unionByName(modeltables.from_trees(spark, trees, ("trees", 5, depth, 0)))
        table = table.unionByName(modeltables.from_layers(spark, layers, ("layers", 5, depth, 0)))
    scored = modeltables.score(table, inputs.where("split = 'test'"))
    return scored.groupBy("model", "layers", "label", "pred").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("conf"), 8).alias("conf")
    )


def counts_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out and validation scores of the family that is fitted from counts."""
    scored = models.fit_and_predict(
        _sequences(spark, sf, 5, labelled=True), 5, models.COUNTS, splits=("val", "test")
    )
    return scored.select("student_id", "chunk", "label", "pred", F.round("conf", 8).alias("conf"))


def _rough_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log with repeated times, missing answers, unknown questions and copied histories."""
    log = tt.attempts(spark, sf)
    rough = log.withColumns(
        {
            "start_time": F.date_trunc("week", "start_time"),
            "answer": F.when(F.pmod("seq", F.lit(23)) != 0, F.col("answer")),
            "question_id": F.when(F.pmod("seq", F.lit(41)) != 0, F.col("question_id")).otherwise(
                F.col("question_id") + 10**9
            ),
        }
    )
    # The first five attempts of a student come again right after, as a second chunk.
    order = Window.partitionBy("student_id").orderBy("start_time", "seq")
    placed = rough.withColumn("_pos", F.row_number().over(order) - 1)
    again = placed.where("_pos < 5").withColumn("seq", F.col("seq") - 10**9)
    again = again.withColumn("start_time", F.lit("1990-01-01").cast(log.schema["start_time"].dataType))
    first = placed.where("_pos < 5").withColumn("seq", F.col("seq") - 2 * 10**9)
    first = first.withColumn("start_time", F.lit("1980-01-01").cast(log.schema["start_time"].dataType))
    return placed.union(again).union(first).drop("_pos")


def sequences_rough(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of a log in which every special rule of the chunks applies."""
    found = history.sequences(_rough_log(spark, sf), tt.questions(spark, sf), (5,), unknown="drop")
    return flat(found)


def _repeated_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as questions that occur many times; the line order is the file's order."""
    return tt.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"),
        (F.pmod(F.col("l_quantity").cast("int"), F.lit(3)) + 1).cast("int").alias("difficulty"),
        *tt.KC_ORDER,
    )


def sequences_question_order(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulties from the first row of each repeated question."""
    found = history.sequences(
        tt.attempts(spark, sf), _repeated_questions(spark, sf), (5,), unknown="drop", question_order=tt.KC_ORDER
    )
    return flat(found)


def metrics_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics where a third of the labels has no prediction, with their number."""
    labels = tt.table(spark, sf, "labels")
    rows = metrics.pair_predictions(
        labels.select("doc_id", F.col("quality").alias("label")),
        labels.where(F.pmod("doc_id", F.lit(3)) != 0).select("doc_id", F.col("toxic").alias("pred")),
        "doc_id",
    )
    return metrics.binary_metrics(rows).join(metrics.unpaired(rows))


def enriched_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a question table that lacks most questions; no sequence is lost."""
    few = tt.questions(spark, sf).where(F.pmod("id", F.lit(7)) == 0)
    found = lookups.enrich_steps(
        _sequences(spark, sf, 5), few, lookups.one_kc(tt.question_kc(spark, sf), "first", tt.KC_ORDER)
    )
    return flat(found)


def parsed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts through the form in which a log file holds them, one CSV line each."""
    events = tt.table(spark, sf, "events")
    line = F.to_csv(
        F.struct(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("student_id"),
            F.get_json_object("props", "$.k").alias("question_id"),
            F.when(F.col("event_type") != "error", "True").otherwise("False").alias("answer_state"),
            F.when(F.col("event_type") == "view", "n/a").otherwise((F.col("value") > 100).cast("string")).alias("hint_used"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"),
        )
    )
    names = ("id", "student_id", "question_id", "answer_state", "hint_used", "start_time")
    fields = F.from_csv(line, F.lit(", ".join(f"{n} string" for n in names)))
    read = readers.parse_attempts(events.select(fields.alias("_row")).select("_row.*"))
    return read.withColumn("start_time", F.unix_micros("start_time"))


def sequence_records(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences as JSON records and read back from them."""
    found = _sequences(spark, sf, 5)
    record = F.to_json(F.struct("student_id", *LISTS))
    raw = found.select("chunk", F.from_json(record, SEQUENCE_FILE).alias("_row"))
    return flat(readers.parse_sequences(raw.select("_row.*", "chunk")))


def prediction_report(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven hold-out predictions with their confidence and a verdict, at places every scale has."""
    scored = model_predictions(spark, sf)
    report = slices.position_slice(scored, SEQUENCE_KEY, 10, 21)
    return report.withColumn("percent", F.col("conf") * 100).withColumn(
        "verdict", verdict("label", "pred", "conf")
    )


def balanced_kc_run(spark: SparkSession, sf: str) -> DataFrame:
    """One perceptron on balanced training data with topics as a feature."""
    topics = lookups.one_kc(tt.question_kc(spark, sf), "last", tt.KC_ORDER)
    labelled = lookups.with_kc(_sequences(spark, sf, 5, labelled=True), topics)
    cells = models.grid((5,), (5,), ("layers",))
    return models.run_grid(labelled, cells, with_kc=True, balance=True)


def grid_best(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _sequences(spark, sf, 5, 10, 20, labelled=True)
    log = models.run_grid(labelled, models.grid())
    return _flat_best(selection.best_config(log))


def queries() -> dict[str, Query]:
    return {
        "sequences_n5": sequences_of(5),
        "sequences_n10": sequences_of(10),
        "sequences_n20": sequences_of(20),
        "history_positions": history_positions,
        "history_positions_large": history_positions_large,
        "sequences_large": sequences_large,
        "student_split": student_split,
        "sequences_by_split": sequences_by_split,
        "fold_members": fold_members,
        "fold_union": fold_union,
        "distinct_students": distinct_students,
        "student_ids": student_ids,
        "questions_per_student": questions_per_student,
        "split_sizes": split_sizes,
        "correct_ratio": correct_ratio,
        "preview": preview,
        "flags": flags,
        "stripped_text": stripped_text,
        "leading_slice": leading_slice,
        "leading_slice_compat": leading_slice_compat,
        "position_slice": position_slice,
        "position_slice_ranged": position_slice_ranged,
        "features_json": features_json,
        "tolerant_int": tolerant_integers,
        "unpadded": unpadded,
        "truncated": truncated,
        "kc_link": kc_link,
        "kc_link_salted": kc_link_salted,
        "kc_first": kc_rule("first"),
        "kc_last": kc_rule("last"),
        "sequence_enriched": sequence_enriched,
        "downsampled": downsampled,
        "downsampled_sequences": downsampled_sequences,
        "features_n5": features_n5,
        "features_kc_n5": features_kc_n5,
        "binary_metrics": binary_metrics,
        "auc_pred": auc_pred,
        "auc_score": auc_score,
        "auc_score_by_flag": auc_score_by_flag,
        "exact_match": exact_match,
        "word_metrics": word_metrics,
        "verdicts": verdicts,
        "log_loss": log_loss,
        "metric_log": metric_log,
        "best_run": best_run,
        "best_config": best_config,
        "best_config_at_val": best_config_at_val,
        "vocab": vocab,
        "word_counts": word_counts,
        "mean_pool": mean_pool,
        "training_lines": training_lines,
        "shuffled_lines": shuffled_lines,
        "packed_blocks": packed_blocks,
        "prompts": all_prompts,
        "prompts_in_budget": prompts_in_budget,
        "batch_scored": batch_scored,
        "batch_scored_metrics": batch_scored_metrics,
        "batch_scored_exact": batch_scored_exact,
        "model_predictions": model_predictions,
        "linear_weights": linear_weights,
        "linear_epochs": linear_epochs,
        "stump_nodes": stump_nodes,
        "grid_confidences": grid_confidences,
        "counts_predictions": counts_predictions,
        "sequences_rough": sequences_rough,
        "sequences_question_order": sequences_question_order,
        "metrics_with_gaps": metrics_with_gaps,
        "enriched_with_gaps": enriched_with_gaps,
        "parsed_attempts": parsed_attempts,
        "sequence_records": sequence_records,
        "prediction_report": prediction_report,
        "balanced_kc_run": balanced_kc_run,
        "grid_best": grid_best,
    }
