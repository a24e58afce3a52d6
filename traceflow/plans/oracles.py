"""DuckDB SQL for the registered queries, over the same parquet tables."""

from traceflow.operators.prompts import INSTRUCTION_WITH_KC
from traceflow.functions.text import BLANK, PIECE, WORD

ATTEMPTS = """attempts AS (
    SELECT user_id AS student_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id,
           CAST(event_type <> 'error' AS INTEGER) AS answer,
           CAST(value > 100 AS INTEGER) AS hint,
           ts AS start_time, event_id AS seq
    FROM events)"""

QUESTIONS = """questions AS (
    SELECT p_partkey AS id, CAST(p_size % 3 + 1 AS INTEGER) AS difficulty,
           p_name AS question_rich_text
    FROM part)"""

POSITIONS = """positions AS (
    SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY start_time, seq) - 1 AS pos,
           count(*) OVER (PARTITION BY student_id) AS history_len
    FROM attempts WHERE student_id IS NOT NULL)"""

SPLIT = """ranked AS (
    SELECT student_id,
           row_number() OVER (ORDER BY md5('42:' || student_id), student_id) - 1 AS pos,
           count(*) OVER () AS students
    FROM (SELECT DISTINCT student_id FROM attempts WHERE student_id IS NOT NULL)),
split AS (
    SELECT student_id, pos,
           CASE WHEN pos >= m THEN 'test'
                WHEN pos < (m % 3) * (m // 3 + 1) THEN CAST(pos // (m // 3 + 1) AS VARCHAR)
                ELSE CAST(m % 3 + (pos - (m % 3) * (m // 3 + 1)) // (m // 3) AS VARCHAR)
           END AS block
    FROM (SELECT *, CAST(floor(0.85::DOUBLE * students) AS BIGINT) AS m FROM ranked))"""

LISTS = ("question_ids", "answers", "difficulties", "hint_used")


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _chunks(*lengths: int) -> str:
    values = ", ".join(f"({n})" for n in lengths)
    return f"""chunks AS (
    SELECT student_id, n, pos // n AS chunk,
           list(question_id ORDER BY pos) AS question_ids,
           list(answer ORDER BY pos) AS answers,
           list(difficulty ORDER BY pos) AS difficulties,
           list(hint ORDER BY pos) AS hint_used
    FROM positions
    JOIN questions ON questions.id = positions.question_id
    CROSS JOIN (VALUES {values}) AS lengths(n)
    WHERE (pos // n + 1) * n < history_len
    GROUP BY student_id, n, pos // n
    HAVING count(*) FILTER (answer = 0) <> n AND count(*) FILTER (answer = 1) <> n),
seqs AS (
    SELECT student_id, n, min(chunk) AS chunk, question_ids, answers, difficulties, hint_used
    FROM chunks
    GROUP BY student_id, n, question_ids, answers, difficulties, hint_used)"""


def _base(*lengths: int, labelled: bool = False) -> str:
    parts = [ATTEMPTS, QUESTIONS, POSITIONS, _chunks(*lengths)]
    if labelled:
        parts.append(SPLIT)
        parts.append(
            "labelled AS (SELECT seqs.*, split.block FROM seqs JOIN split USING (student_id))"
        )
    return _with(*parts)


def _joined(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda x: coalesce(CAST(x AS VARCHAR), '?')), ',') AS {name}"


JOINED = ", ".join(_joined(name) for name in LISTS)

# Row order of the question-topic relation: order, line, supplier.
FIRST_KC = """kc_first AS (
    SELECT l_partkey AS question_id,
           first(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS kc_id
    FROM lineitem GROUP BY l_partkey)"""
LAST_KC = """kc_last AS (
    SELECT l_partkey AS question_id,
           last(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS kc_id
    FROM lineitem GROUP BY l_partkey)"""

KC_LINK = """SELECT l_partkey AS question_id, l_suppkey AS kc_id, s_name AS name,
       'Topic ' || s_name AS description, l_orderkey, l_linenumber, l_suppkey
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""

STEPS = """steps AS (
    SELECT student_id, n, chunk, unnest(question_ids) AS question_id, unnest(answers) AS answer,
           unnest(difficulties) AS difficulty, generate_subscripts(answers, 1) AS i
    FROM seqs)"""

ENRICHED = f"""enriched AS (
    SELECT steps.*, regexp_replace(question_rich_text, '^{BLANK}+|{BLANK}+$', '', 'g') AS question,
           CAST(kc_id AS VARCHAR) AS kc
    FROM steps JOIN questions ON questions.id = steps.question_id
    JOIN kc_first USING (question_id))"""


def _enriched(*lengths: int) -> str:
    return _with(
        ATTEMPTS, QUESTIONS, POSITIONS, _chunks(*(lengths or (5,))), STEPS, FIRST_KC, ENRICHED
    )


def _word(flag: str) -> str:
    return f"CASE WHEN {flag} = 1 THEN 'CORRECT' ELSE 'WRONG' END"


def _prompt(content: str, *lengths: int) -> str:
    """Prompt texts as a CTE ``chat``; contents hold no quote characters."""
    return (
        _enriched(*lengths)
        + f""", chat AS (
    SELECT student_id, CAST(n AS INTEGER) AS n, chunk, 2 * count(*) AS messages,
           '[{{''role'': ''assistant'', ''content'': ''{INSTRUCTION_WITH_KC}''}}, ' ||
           string_agg('{{''role'': ''user'', ''content'': ''' || {content} || '''}}' ||
                      CASE WHEN i < n THEN ', {{''role'': ''assistant'', ''content'': ''' ||
                      {_word('answer')} || '''}}' ELSE '' END, ', ' ORDER BY i) || ']' AS prompt,
           {_word('last(answer ORDER BY i)')} AS gt,
           {_word('last(answer ORDER BY i) FILTER (i < n)')} AS previous
    FROM enriched GROUP BY student_id, n, chunk)
"""
    )


FULL = (
    "'ID: ' || question_id || ', Question: ' || question || ', Topic: ' || kc || "
    "', Difficulty: ' || difficulty"
)
SHORT = "'Topic: ' || kc || ', Difficulty: ' || difficulty"

LINE = f"""string_agg('Difficulty: ' || difficulty || ' -> Answer: ' || {_word('answer')},
               ' ||| ' ORDER BY i)"""


def _metrics(select: str = "", group: str = "") -> str:
    """Metrics over a relation ``pairs(label, pred)``."""
    lead = f"{select}, " if select else ""
    return f"""SELECT {lead}
       (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS acc,
       coalesce((r0 + r1) / 2, r0, r1) AS bal_acc,
       coalesce((2 * tn)::DOUBLE / nullif(2 * tn + fp + fn, 0), 0) AS f1_0,
       coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1_1,
       tn + fp AS sup_0, tp + fn AS sup_1, (r0 + r1) / 2 AS auc
FROM (SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS r1, tn::DOUBLE / nullif(tn + fp, 0) AS r0
      FROM (SELECT {lead}
                   count(*) FILTER (label = 1 AND pred = 1) AS tp,
                   count(*) FILTER (label = 0 AND pred = 0) AS tn,
                   count(*) FILTER (label = 0 AND pred = 1) AS fp,
                   count(*) FILTER (label = 1 AND pred = 0) AS fn
            FROM pairs {group}))"""


def _word_metrics(source: str) -> str:
    """Word metrics over ``source``, a relation with ``gt`` and ``pred``."""
    return f"""SELECT f1_0, f1_1, sup_0 AS supp_0, sup_1 AS supp_1, acc, bal_acc, n_malformed
FROM ({_metrics()})
CROSS JOIN (SELECT count(*) FILTER (pred IS NULL OR pred NOT IN ('CORRECT', 'WRONG'))
                   AS n_malformed FROM {source})"""


EXACT = """SELECT count(*) FILTER (pred IS NOT DISTINCT FROM gt) AS correct, count(*) AS total,
       count(*) FILTER (pred IS NOT DISTINCT FROM gt) / count(*)::DOUBLE * 100 AS percentage
FROM {source}"""


def _auc(source: str, by: str = "") -> str:
    lead, part, group = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"""SELECT {lead}sum(ones * (before + zeros / 2.0::DOUBLE))
       / (sum(zeros)::DOUBLE * sum(ones)::DOUBLE) AS auc_score
FROM (SELECT *, coalesce(sum(zeros) OVER ({part} ORDER BY conf
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
      FROM (SELECT {lead}conf, count(*) FILTER (label = 0) AS zeros,
                   count(*) FILTER (label = 1) AS ones
            FROM ({source}) GROUP BY {lead}conf))
{group}"""


SCORED = """SELECT l_orderkey, l_linenumber, l_suppkey,
       CAST(l_linestatus = 'O' AS INTEGER) AS label, l_discount * 10 AS conf FROM lineitem"""

VERDICT = """CASE WHEN label <> pred AND conf > 0.9 THEN 'Overconfident'
            WHEN label = pred AND conf < 0.1 THEN 'Underconfident' ELSE 'Balanced' END"""

RUN_PAIRS = """runs AS (
    SELECT l_returnflag AS model,
           CAST([5, 10, 20][l_linenumber % 3 + 1] AS INTEGER) AS n,
           CAST([1, 2, 5][l_suppkey % 3 + 1] AS INTEGER) AS layers,
           CAST(month(l_shipdate) AS INTEGER) AS epoch,
           CASE WHEN l_tax < 0.04 THEN 'val' ELSE 'test' END AS split,
           CAST(l_linenumber % 3 * 3 + l_suppkey % 3 AS INTEGER) AS grid_order,
           CAST(l_linestatus = 'O' AS INTEGER) AS label,
           CAST(l_discount >= 0.05 AS INTEGER) AS pred
    FROM lineitem)"""
RUN_KEY = "model, n, layers, epoch, split, grid_order"
RUN_LOG = (
    RUN_PAIRS
    + ",\nlog AS ("
    + _metrics(RUN_KEY, f"GROUP BY {RUN_KEY}").replace("FROM pairs", "FROM runs")
    + ")"
)
METRIC_NAMES = ("acc", "bal_acc", "f1_0", "f1_1", "sup_0", "sup_1", "auc")


def _best_config(test: str) -> str:
    fields = ", ".join(
        f"{side}.{name} AS {side}_{name}" for side in ("val", "test")
        for name in ("epoch", *METRIC_NAMES)
    )
    return (
        _with(RUN_LOG)
        + f""", best AS (
    SELECT * FROM log WHERE bal_acc > 0
    QUALIFY row_number() OVER (PARTITION BY {RUN_KEY.replace('epoch, ', '')}
                               ORDER BY bal_acc DESC, epoch) = 1)
SELECT val.model, val.n, val.layers, {fields}
FROM best AS val LEFT JOIN {test}
WHERE val.split = 'val'
QUALIFY row_number() OVER (PARTITION BY val.model
                           ORDER BY val.bal_acc DESC, val.grid_order) = 1"""
    )


SAME_CONFIG = (
    "test.model = val.model AND test.n = val.n AND test.layers = val.layers "
    "AND test.grid_order = val.grid_order AND test.split = 'test'"
)

WORDS = f"""words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents))"""


def _sequence_oracles() -> dict[str, str]:
    out = {}
    for n in (5, 10, 20):
        out[f"sequences_n{n}"] = (
            _base(n) + f"SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {JOINED} FROM seqs"
        )
    out["history_positions"] = (
        _with(ATTEMPTS, POSITIONS) + "SELECT student_id, seq, pos, history_len FROM positions"
    )
    out["history_positions_large"] = out["history_positions"]
    out["student_split"] = _with(ATTEMPTS, SPLIT) + "SELECT student_id, pos, block FROM split"
    out["sequences_by_split"] = (
        _base(5, 10, 20, labelled=True)
        + f"SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {JOINED}, block FROM labelled"
    )
    out["sequences_large"] = out["sequences_by_split"]
    out["fold_members"] = (
        _base(5, 10, 20, labelled=True)
        + """SELECT CAST(n AS INTEGER) AS n,
       CASE WHEN block = CAST(fold - 1 AS VARCHAR) THEN 'val' ELSE 'train' END AS split,
       CAST(fold AS INTEGER) AS fold, student_id, chunk
FROM labelled CROSS JOIN (VALUES (1), (2), (3)) AS folds(fold) WHERE block <> 'test'
UNION ALL
SELECT CAST(n AS INTEGER), 'test', 0, student_id, chunk FROM labelled WHERE block = 'test'"""
    )
    split = "CASE block WHEN 'test' THEN 'test' WHEN '0' THEN 'val' ELSE 'train' END AS split"
    out["fold_union"] = (
        _base(20, labelled=True) + f"SELECT student_id, chunk, {split} FROM labelled"
    )
    out["split_sizes"] = (
        _base(20, labelled=True)
        + f"""SELECT coalesce(split, 'all') AS split, count(*) AS sequences
FROM (SELECT {split} FROM labelled) GROUP BY ROLLUP (split)"""
    )
    out["correct_ratio"] = (
        _base(20, labelled=True)
        + """SELECT count(*) AS sequences, count(*) FILTER (answers[-1] = 1) AS correct,
       count(*) FILTER (answers[-1] = 1) / count(*)::DOUBLE AS correct_ratio FROM labelled"""
    )
    out["leading_slice"] = (
        _base(5)
        + f"""SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {JOINED}
FROM seqs ORDER BY student_id, chunk LIMIT 100"""
    )
    out["leading_slice_compat"] = (
        _base(5)
        + """SELECT student_id, chunk FROM seqs
QUALIFY row_number() OVER (ORDER BY student_id DESC, chunk DESC) > 1"""
    )
    cut = ", ".join(f"array_to_string({c}[1:5], ',') AS {c}" for c in LISTS)
    out["truncated"] = (
        _base(10)
        + f"""SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {cut},
       CAST(answers[5] = 1 AS INTEGER) AS last_correct FROM seqs"""
    )
    out["downsampled_sequences"] = (
        _base(5, labelled=True)
        + """, train AS (
    SELECT student_id, chunk, answers[-1] AS label,
           md5('42:' || student_id || ':' || chunk) AS h
    FROM labelled WHERE block NOT IN ('0', 'test'))
SELECT student_id, chunk, label FROM train
QUALIFY label = 0 OR row_number() OVER (PARTITION BY label ORDER BY h, student_id, chunk)
        <= (SELECT count(*) FROM train WHERE label = 0)"""
    )
    row = "difficulty || ',' || CASE WHEN i < n THEN answer ELSE 0 END"
    steps = _with(ATTEMPTS, QUESTIONS, POSITIONS, _chunks(5), STEPS)
    out["features_n5"] = (
        steps
        + f"""SELECT student_id, chunk, string_agg({row}, ';' ORDER BY i) AS features,
       last(answer ORDER BY i) AS label FROM steps GROUP BY student_id, chunk"""
    )
    row = row.replace("difficulty", "difficulty || ',' || kc_id", 1)
    out["features_kc_n5"] = (
        _with(ATTEMPTS, QUESTIONS, POSITIONS, _chunks(5), STEPS, LAST_KC)
        + f"""SELECT student_id, chunk, string_agg({row}, ';' ORDER BY i) AS features,
       last(answer ORDER BY i) AS label
FROM steps JOIN kc_last USING (question_id) GROUP BY student_id, chunk"""
    )
    pair = "'[' || difficulty || '.0,' || CASE WHEN i < n THEN answer ELSE 0 END || '.0]'"
    out["features_json"] = (
        steps
        + f"""SELECT '{{"student_id":' || student_id || ',"chunk":' || chunk || ',"features":['
       || string_agg({pair}, ',' ORDER BY i) || '],"label":' || last(answer ORDER BY i) || '}}'
       AS record
FROM steps GROUP BY student_id, chunk"""
    )
    fields = {
        "question_ids": "question_id", "questions": "question", "kcs": "kc",
        "difficulties": "difficulty", "answers": "answer",
    }
    lists = ", ".join(f"string_agg({c}, ',' ORDER BY i) AS {name}" for name, c in fields.items())
    out["sequence_enriched"] = (
        _enriched()
        + f"""SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {lists}
FROM enriched GROUP BY student_id, n, chunk"""
    )
    lines = f", lines AS (SELECT student_id, n, chunk, {LINE} AS line FROM steps GROUP BY ALL)\n"
    out["training_lines"] = (
        steps + lines + "SELECT student_id, chunk, line, line || chr(10) || '<|endoftext|>' AS value "
        "FROM lines"
    )
    out["shuffled_lines"] = (
        steps
        + lines
        + """SELECT row_number() OVER (ORDER BY md5('1:' || student_id || ':' || n || ':' || chunk),
                         student_id, n, chunk) - 1 AS pos, line FROM lines"""
    )
    return out


def _prompt_oracles() -> dict[str, str]:
    scored = _prompt(SHORT) + ", pairs AS (SELECT CAST(gt = 'CORRECT' AS INTEGER) AS label, " \
        "CAST(previous = 'CORRECT' AS INTEGER) AS pred FROM chat), " \
        "answered AS (SELECT gt, previous AS pred FROM chat)\n"
    return {
        "prompts": _prompt(FULL) + "SELECT student_id, chunk, CAST(messages AS INTEGER) AS messages, "
        "prompt, gt FROM chat",
        "prompts_in_budget": _prompt(FULL, 5, 10, 20)
        + f"""SELECT student_id, n, chunk, CAST(tokens AS INTEGER) AS tokens, prompt, gt
FROM (SELECT *, length(regexp_extract_all(prompt, '{PIECE}')) AS tokens FROM chat)
WHERE tokens <= 700""",
        "batch_scored": _prompt(SHORT)
        + "SELECT student_id, chunk, gt, previous AS pred FROM chat",
        "batch_scored_metrics": scored + _word_metrics("answered"),
        "batch_scored_exact": scored + EXACT.format(source="answered"),
    }


def _table_oracles() -> dict[str, str]:
    guard = r"^\s*[+-]?[0-9]+\s*$"

    def parsed(text: str) -> str:
        return (
            f"coalesce(CASE WHEN regexp_matches({text}, '{guard}') "
            f"THEN try_cast(trim({text}) AS BIGINT) END, -1)"
        )

    words = """SELECT CASE WHEN quality = 1 THEN 'CORRECT' ELSE 'WRONG' END AS gt,
       CASE WHEN quality = 0 AND toxic = 0 THEN 'Wrong.'
            WHEN toxic = 1 THEN 'CORRECT' ELSE 'WRONG' END AS pred FROM labels"""
    word_pairs = (
        f"answered AS ({words}), pairs AS (SELECT CAST(gt = 'CORRECT' AS INTEGER) AS label, "
        "CAST(pred = 'CORRECT' AS INTEGER) AS pred FROM answered)"
    )
    label_pairs = (
        "pairs AS (SELECT a.quality AS label, b.toxic AS pred FROM labels a JOIN labels b "
        "USING (doc_id))"
    )
    prediction = f"SELECT *, CAST(conf >= 0.5 AS DOUBLE) AS pred FROM ({SCORED})"
    return {
        "distinct_students": "SELECT count(DISTINCT user_id) AS students FROM events",
        "student_ids": "SELECT DISTINCT user_id AS student_id FROM events "
        "WHERE user_id IS NOT NULL",
        "questions_per_student": "SELECT user_id AS student_id, count(*) AS num_questions "
        "FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
        "preview": _with(ATTEMPTS)
        + "SELECT student_id, question_id, answer, seq FROM attempts ORDER BY seq LIMIT 5",
        "flags": """SELECT event_id, CAST(event_type <> 'error' AS INTEGER) AS answer,
       CAST(value > 100 AS INTEGER) AS hint, CAST(NULL AS INTEGER) AS not_a_flag FROM events""",
        "stripped_text": f"""SELECT doc_id,
       regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS text FROM documents""",
        "position_slice": f"""SELECT l_orderkey, l_linenumber, l_suppkey, label, pred, pos,
       {VERDICT} AS verdict, round(conf * 100, 6) AS percent
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, label, conf) - 1 AS pos
      FROM ({prediction})) WHERE pos BETWEEN 55 AND 65""",
        "position_slice_ranged": """SELECT event_id AS seq,
       row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events""",
        "tolerant_int": f"""SELECT event_id,
       array_to_string(list_transform(regexp_split_to_array(props, '[:}}]'),
                       lambda x: {parsed('x')}), ',') AS parsed,
       {parsed('CAST(value AS VARCHAR)')} AS from_text,
       coalesce(CAST(trunc(value) AS BIGINT), -1) AS from_number,
       CAST(-1 AS BIGINT) AS from_word FROM events""",
        "unpadded": """SELECT event_id, json_extract_string(props, '$.k') || ',1' AS answers
FROM events WHERE event_type <> 'error'""",
        "kc_link": KC_LINK,
        "kc_link_salted": KC_LINK,
        "kc_first": _with(FIRST_KC) + "SELECT question_id, kc_id FROM kc_first",
        "kc_last": _with(LAST_KC) + "SELECT question_id, kc_id FROM kc_last",
        "downsampled": """SELECT doc_id, quality, toxic FROM labels WHERE quality IN (0, 1)
QUALIFY quality = 0 OR row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id)
        <= (SELECT count(*) FROM labels WHERE quality = 0)""",
        "binary_metrics": _with(label_pairs) + _metrics(),
        "auc_pred": _auc("SELECT quality AS label, toxic AS conf FROM labels"),
        "auc_score": _auc(SCORED),
        "auc_score_by_flag": _auc(
            "SELECT l_returnflag, CAST(l_linestatus = 'O' AS INTEGER) AS label, "
            "l_extendedprice AS conf FROM lineitem",
            "l_returnflag",
        ),
        "exact_match": EXACT.format(source=f"({words})"),
        "word_metrics": _with(word_pairs) + _word_metrics("answered"),
        "verdicts": f"""SELECT l_orderkey, l_linenumber, l_suppkey, label, pred, {VERDICT} AS verdict
FROM ({prediction})""",
        "log_loss": f"""SELECT
       round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 8) AS log_loss,
       round(avg(ln(1 + exp(conf)) - label * conf), 8) AS logit_loss
FROM (SELECT *, least(greatest(conf, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM ({SCORED}))""",
        "metric_log": _with(RUN_LOG) + "SELECT * FROM log",
        "best_run": _with(RUN_LOG)
        + """SELECT * FROM log WHERE bal_acc > 0
QUALIFY row_number() OVER (PARTITION BY model, n, layers, split
                           ORDER BY bal_acc DESC, epoch) = 1""",
        "best_config": _best_config(f"best AS test ON {SAME_CONFIG}"),
        "best_config_at_val": _best_config(
            f"log AS test ON {SAME_CONFIG} AND test.epoch = val.epoch"
        ),
        "vocab": _with(WORDS)
        + """SELECT doc_id, word,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS INTEGER) AS ix
FROM (SELECT doc_id, word, min(pos) AS first_pos FROM words GROUP BY doc_id, word)""",
        "word_counts": _with(WORDS)
        + """SELECT word, count(*) AS occurrences, first(doc_id ORDER BY doc_id, pos) AS first_doc,
       CAST(first(pos ORDER BY doc_id, pos) AS INTEGER) AS first_pos FROM words GROUP BY word""",
        "mean_pool": _with(WORDS)
        + """, counted AS (
    SELECT doc_id,
           CAST('0x' || substr(md5(word), 1, 12) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id,
           count(*) AS times
    FROM words GROUP BY ALL),
dims AS (
    SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
    FROM embeddings),
means AS (
    SELECT doc_id, d, sum(x * times) / sum(times) AS m
    FROM counted JOIN dims USING (vec_id) GROUP BY doc_id, d)
SELECT documents.doc_id, string_agg(CAST(round(m * 1e6) AS BIGINT), ',' ORDER BY d) AS embedding
FROM documents LEFT JOIN means USING (doc_id) GROUP BY documents.doc_id""",
        "packed_blocks": f"""WITH counted AS (
    SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS t FROM documents),
placed AS (
    SELECT doc_id, t, coalesce(sum(length(t)) OVER (ORDER BY md5('1:' || doc_id), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM counted),
tokens AS (
    SELECT unnest(t) AS token, start + generate_subscripts(t, 1) - 1 AS pos FROM placed)
SELECT CAST(pos // 128 AS BIGINT) AS block, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM tokens GROUP BY ALL HAVING count(*) = 128""",
    }


COUNTS_SQL = """, inputs AS (
    SELECT student_id, chunk, block, answers[5] AS label, answers, difficulties FROM labelled),
features AS (
    SELECT student_id, chunk, (i - 1) * 6 + (difficulties[i] - 1) * 2 + answers[i] AS f
    FROM inputs, range(1, 5) t(i)
    UNION ALL SELECT student_id, chunk, 24 + difficulties[5] - 1 FROM inputs),
train AS (SELECT * FROM inputs WHERE block NOT IN ('0', 'test')),
prior AS (
    SELECT label, ln(count(*) + 1.0::DOUBLE) - ln((SELECT count(*) FROM train) + 2.0::DOUBLE) AS pi,
           5 * count(*) AS total
    FROM train GROUP BY label),
seen AS (SELECT label, f, count(*) AS times FROM train JOIN features USING (student_id, chunk) GROUP BY ALL),
theta AS (
    SELECT label, f, pi, ln(coalesce(times, 0) + 1.0::DOUBLE) - ln(total + 27.0::DOUBLE) AS w
    FROM prior CROSS JOIN range(27) t(f) LEFT JOIN seen USING (label, f)),
scores AS (
    SELECT student_id, chunk, theta.label AS c, any_value(pi) + sum(w) AS s
    FROM features JOIN theta USING (f) GROUP BY ALL),
scored AS (
    SELECT student_id, chunk, 1 / (1 + exp(max(s) FILTER (c = 0) - max(s) FILTER (c = 1))) AS conf
    FROM scores GROUP BY ALL)
SELECT student_id, chunk, CAST(label AS INTEGER) AS label, CAST(conf >= 0.5 AS INTEGER) AS pred,
       round(conf, 8) AS conf
FROM scored JOIN inputs USING (student_id, chunk) WHERE block IN ('0', 'test')"""


def _linear(n: int, layers: tuple[int, ...], epochs: int, steps: int) -> str:
    """Weights of every step by recursion, then ``models(layers, epoch, bias, weights, train_loss)``."""
    width = 2 * n
    sums = ", ".join(f"sum(many * off * x[{j}])" for j in range(1, width + 1))
    cells = ", ".join(f"({k})" for k in layers)
    return f""", inputs AS (
    SELECT student_id, chunk, CASE WHEN block = '0' THEN 'val' WHEN block = 'test' THEN 'test' ELSE 'train' END AS split,
           answers[{n}] AS label,
           flatten(list_transform(range(1, {n + 1}), lambda i: [difficulties[i]::DOUBLE,
               CASE WHEN i < {n} THEN answers[i] ELSE 0 END::DOUBLE])) AS x
    FROM labelled),
counted AS (SELECT x, label, count(*)::DOUBLE AS many FROM inputs WHERE split = 'train' GROUP BY ALL),
moments AS (
    SELECT j, sum(many * x[j]) / sum(many) AS mean,
           sqrt(greatest(sum(many * x[j] * x[j]) / sum(many) - (sum(many * x[j]) / sum(many)) ** 2, 0)) AS deviation
    FROM counted, range(1, {width + 1}) t(j) GROUP BY j),
units AS (
    SELECT list(mean ORDER BY j) AS mean,
           list(CASE WHEN deviation < 1e-8 THEN 1.0::DOUBLE ELSE deviation END ORDER BY j) AS scale FROM moments),
train AS MATERIALIZED (
    SELECT list_transform(range(1, {width + 1}), lambda j: (x[j] - mean[j]) / scale[j]) AS x, label, many,
           sum(many) OVER () AS total
    FROM counted, units),
steps AS (
    SELECT 0 AS t, layers, list_transform(range({width + 1}), lambda j: 0.0::DOUBLE) AS w,
           list_transform(range({width + 1}), lambda j: 0.0::DOUBLE) AS m,
           list_transform(range({width + 1}), lambda j: 0.0::DOUBLE) AS v, NULL::DOUBLE AS loss
    FROM (VALUES {cells}) cells(layers)
    UNION ALL
    SELECT t + 1, layers,
           list_transform(range(1, {width + 2}), lambda j: w[j] - 0.1::DOUBLE * (m2[j] / (1 - 0.9::DOUBLE ** (t + 1)))
               / (sqrt(v2[j] / (1 - 0.999::DOUBLE ** (t + 1))) + 1e-8)),
           m2, v2, loss
    FROM (
        SELECT *, list_transform(range(1, {width + 2}), lambda j: 0.9::DOUBLE * m[j] + (1 - 0.9::DOUBLE) * g[j]) AS m2,
               list_transform(range(1, {width + 2}), lambda j: 0.999::DOUBLE * v[j] + (1 - 0.999::DOUBLE) * g[j] * g[j]) AS v2
        FROM (
            SELECT t, layers, w, m, v, loss, list_transform(range(1, {width + 2}), lambda j:
                       slopes[j] + CASE WHEN j = 1 THEN 0 ELSE 0.01::DOUBLE / layers * w[j] END) AS g
            FROM (
                SELECT t, layers, w, m, v, sum(many * (greatest(z, 0) + ln(1 + exp(-abs(z))) - label * z)) / any_value(total) AS loss,
                       list_transform([sum(many * off), {sums}], lambda s: s / any_value(total)) AS slopes
                FROM (
                    SELECT *, 1 / (1 + exp(-z)) - label AS off
                    FROM (SELECT steps.*, x, label, many, total, w[1] + list_dot_product(w[2:], x) AS z FROM steps, train
                          WHERE t < {epochs * steps}))
                GROUP BY t, layers, w, m, v)))),
models AS (
    SELECT layers, (e.t // {steps} - 1)::INTEGER AS epoch,
           w[1] - list_dot_product(list_transform(range(1, {width + 1}), lambda j: w[j + 1] / scale[j]), mean) AS bias,
           list_transform(range(1, {width + 1}), lambda j: w[j + 1] / scale[j]) AS weights,
           (SELECT avg(s.loss) FROM steps s WHERE s.layers = e.layers AND s.t > e.t - {steps} AND s.t <= e.t) AS train_loss
    FROM steps e, units WHERE e.t > 0 AND e.t % {steps} = 0),
scored AS (
    SELECT *, 1 / (1 + exp(-(bias + list_dot_product(weights, x)))) AS conf FROM inputs, models WHERE split <> 'train'),
pairs AS (SELECT *, CAST(conf >= 0.5 AS INTEGER) AS pred FROM scored)
"""


# One tree of depth one on labels of -1 and 1: the test that lowers their variance most, halfway between two values.
_STUMP = """, inputs AS (
    SELECT 2 * answers[5] - 1 AS y, flatten(list_transform(range(1, 6), lambda i: [difficulties[i]::DOUBLE,
               CASE WHEN i < 5 THEN answers[i] ELSE 0 END::DOUBLE])) AS x
    FROM labelled WHERE block NOT IN ('0', 'test')),
sums AS (SELECT j, x[j + 1] AS v, count(*) AS many, sum(y) AS y FROM inputs, range(10) t(j) GROUP BY ALL),
cuts AS (
    SELECT j, (v + lead(v) OVER (PARTITION BY j ORDER BY v)) / 2 AS threshold,
           sum(many) OVER w AS n_low, sum(y) OVER w AS y_low,
           sum(many) OVER (PARTITION BY j) AS n_all, sum(y) OVER (PARTITION BY j) AS y_all
    FROM sums WINDOW w AS (PARTITION BY j ORDER BY v)),
best AS (
    SELECT * FROM cuts WHERE threshold IS NOT NULL
    ORDER BY round(y_low * y_low / n_low + (y_all - y_low) ** 2 / (n_all - n_low), 9) DESC, j, threshold LIMIT 1)
SELECT 0 AS tree, node, CASE WHEN node = 0 THEN j::INTEGER END AS feature, CASE WHEN node = 0 THEN threshold END AS threshold,
       CASE WHEN node = 0 THEN 1 ELSE -1 END AS low, CASE WHEN node = 0 THEN 2 ELSE -1 END AS high,
       round(CASE node WHEN 0 THEN y_all / n_all WHEN 1 THEN y_low / n_low ELSE (y_all - y_low) / (n_all - n_low) END, 8) AS value
FROM best, range(3) t(node)"""


def _linear_oracles() -> dict[str, str]:
    def base(n: int) -> str:
        return _base(n, labelled=True).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()

    once = base(5) + _linear(5, (1,), 1, 20)
    predicted = """SELECT student_id, chunk, CAST(label AS INTEGER) AS label, pred, round(conf, 8) AS conf
        FROM pairs WHERE split = 'test'"""
    by = "layers, epoch, split"
    loss = f"SELECT {by}, round(avg(-(label * ln(conf) + (1 - label) * ln(1 - conf))), 8) AS loss FROM pairs GROUP BY {by}"
    return {
        "model_predictions": once + predicted,
        "linear_weights": base(5)
        + _linear(5, (1, 5), 3, 8)
        + """SELECT 'linear' AS model, 5 AS n, layers, epoch, j::INTEGER AS j,
            round(CASE WHEN j = 0 THEN bias ELSE weights[j] END, 8) AS weight, round(train_loss, 8) AS train_loss
            FROM models, range(0, 11) t(j)""",
        "stump_nodes": base(5) + _STUMP,
        "linear_epochs": base(10)
        + _linear(10, (1, 2), 3, 8)
        + f"SELECT 'linear' AS model, 10 AS n, * FROM ({_metrics(by, f'GROUP BY {by}')}) JOIN ({loss}) USING ({by})",
    }


def _file_oracles() -> dict[str, str]:
    """What must come back from files."""
    spread = "'say \"' || {0} || '\",' || chr(10) || {0}"
    topic = spread.format("s_name")
    lines = """array_to_string(list_transform(range(1, 6), lambda i: 'Difficulty: ' || difficulties[i] || ' -> Answer: '
        || CASE WHEN answers[i] = 1 THEN 'CORRECT' ELSE 'WRONG' END), ' ||| ')"""
    return {
        "documents_from_csv": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
        "attempts_from_csv": _with(ATTEMPTS)
        + """SELECT student_id, question_id, answer, hint, epoch_us(start_time) AS start_time, seq FROM attempts""",
        "questions_from_csv": "SELECT p_partkey AS id, CAST(p_size % 3 + 1 AS INTEGER) AS difficulty, "
        f"{spread.format('p_name')} AS question_rich_text FROM part",
        "kcs_from_csv": f"SELECT s_suppkey AS id, s_name AS name, {topic} AS description FROM supplier",
        "question_kc_from_csv": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS question_id, "
        "l_suppkey AS knowledgecomponent_id FROM lineitem",
        "kc_link_from_csv": f"SELECT l_partkey AS question_id, s_suppkey AS kc_id, s_name AS name, {topic} AS description "
        "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
        "sequence_files": _base(5) + f"SELECT student_id, CAST(n AS INTEGER) AS n, {JOINED} FROM seqs",
        "sequences_of_fold": _base(5, labelled=True)
        + f"SELECT student_id, chunk, {_joined('answers')}, 5 AS n, 'val' AS split, 2 AS fold FROM labelled WHERE block = '1'",
        "sequences_of_blocks": _base(5, 10, labelled=True)
        + f"""SELECT student_id, chunk, {_joined('answers')}, CAST(n AS INTEGER) AS n,
            CASE block WHEN 'test' THEN 'test' WHEN '0' THEN 'val' ELSE 'train' END AS split,
            CASE block WHEN 'test' THEN 0 ELSE 1 END AS fold FROM labelled
        UNION ALL SELECT student_id, chunk, {_joined('answers')}, 10, 'val', 3 FROM labelled WHERE block = '2' AND n = 10""",
        "metrics_files": _with(RUN_LOG)
        + """SELECT model, n, layers, epoch, acc, bal_acc, f1_0, f1_1, sup_0, sup_1, auc, split FROM log WHERE bal_acc > 0
QUALIFY row_number() OVER (PARTITION BY model, n, layers, split ORDER BY bal_acc DESC, epoch) = 1""",
        "training_text_file": _base(5) + f"SELECT {lines} AS line, count(*) AS times FROM seqs GROUP BY ALL",
    }


def _edge_oracles() -> dict[str, str]:
    """Queries on data in which the rare rules apply."""
    rough = """rough AS (
    SELECT student_id, CASE WHEN seq % 41 <> 0 THEN question_id ELSE question_id + 1000000000 END AS question_id,
           CASE WHEN seq % 23 <> 0 THEN answer END AS answer, hint,
           CAST(date_trunc('week', start_time) AS TIMESTAMP) AS start_time, seq
    FROM attempts),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY start_time, seq) - 1 AS pos FROM rough),
log AS (
    SELECT student_id, question_id, answer, hint, start_time, seq FROM placed
    UNION ALL SELECT student_id, question_id, answer, hint, TIMESTAMP '1990-01-01', seq - 1000000000 FROM placed WHERE pos < 5
    UNION ALL SELECT student_id, question_id, answer, hint, TIMESTAMP '1980-01-01', seq - 2000000000 FROM placed WHERE pos < 5)"""
    positions = POSITIONS.replace("FROM attempts", "FROM log")
    # Chunks with an unknown question go; one with a missing value is never a copy.
    chunks = (
        _chunks(5)
        .replace("JOIN questions", "LEFT JOIN questions")
        .replace("HAVING ", "HAVING count(questions.id) = n AND ")
        .replace("list(hint ORDER BY pos) AS hint_used", "list(hint ORDER BY pos) AS hint_used, "
                 "CASE WHEN count(answer) < n OR count(hint) < n OR count(difficulty) < n THEN pos // n END AS own")
        .replace("difficulties, hint_used)", "difficulties, hint_used, own)")
    )
    found = f"SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {JOINED} FROM seqs"
    first_line = """questions AS (
    SELECT l_partkey AS id, CAST(first(CAST(l_quantity AS INTEGER) % 3 + 1 ORDER BY l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) % 3) AS INTEGER) AS difficulty
    FROM lineitem GROUP BY l_partkey)"""
    few = {
        "question_ids": "question_id", "questions": "question", "kcs": "kc",
        "difficulties": "difficulty", "answers": "answer",
    }
    lists = ", ".join(
        f"coalesce(string_agg({c}, ',' ORDER BY i) FILTER (enriched.question_id % 7 = 0), '') AS {name}"
        for name, c in few.items()
    )
    gaps = (
        "pairs AS (SELECT a.quality AS label, b.toxic AS pred FROM labels a LEFT JOIN "
        "(SELECT * FROM labels WHERE doc_id % 3 <> 0) b USING (doc_id))"
    )
    return {
        "counts_predictions": _base(5, labelled=True) + COUNTS_SQL,
        "sequences_rough": _with(ATTEMPTS, QUESTIONS, rough, positions, chunks) + found,
        "sequences_question_order": _with(ATTEMPTS, first_line, POSITIONS, chunks) + found,
        "metrics_with_gaps": _with(gaps)
        + f"""SELECT * FROM ({_metrics()}), (SELECT count(*) FILTER (label IS NOT NULL AND pred IS NULL) AS n_unpaired,
       count(*) FILTER (label IS NULL) AS n_unlabelled FROM pairs)""",
        "enriched_with_gaps": _enriched()
        + f"SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {lists} FROM enriched GROUP BY student_id, n, chunk",
        "parsed_attempts": """SELECT user_id AS student_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id,
       CAST(event_type <> 'error' AS INTEGER) AS answer,
       CASE WHEN event_type <> 'view' THEN CAST(value > 100 AS INTEGER) END AS hint,
       epoch_us(ts) AS start_time, event_id AS seq FROM events""",
        "sequence_records": _base(5)
        + f"SELECT student_id, CAST(n AS INTEGER) AS n, chunk, {JOINED} FROM seqs",
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_sequence_oracles(),
        **_prompt_oracles(),
        **_table_oracles(),
        **_edge_oracles(),
        **_linear_oracles(),
        **_file_oracles(),
    }
