"""Benchmark evaluation: annotation joins, vocabularies, scoring, summaries, samples and packs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequarry.functions import answers as A
from scenequarry.operators import items as I
from scenequarry.operators import packing, sampling, scoring, vocabulary
from scenequarry.operators.joins import join_small
from scenequarry.plans.bindings import bind, oracle, table
from scenequarry.plans.registry import Register
from scenequarry.session import checkpoint_folder, cut_lineage
from scenequarry.sources import predictions as P
from scenequarry.sources.annotations import load_benchmark

BENCHMARK = "rsvqa-lr"
query = Register()
QUERIES, ORACLES = query.queries, query.oracles


# ------------------------------------------------------------------ inputs


def triplets(spark: SparkSession, d: str) -> DataFrame:
    answers = bind(spark, d, "answers")
    listed = answers.groupBy("question_id").agg(F.array_sort(F.collect_list("id")).alias("answers_ids"))
    questions = bind(spark, d, "questions").join(listed.withColumnRenamed("question_id", "id"), "id", "left")
    return I.first_answer_triplets(questions, answers, bind(spark, d, "images"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return I.assemble_single_items(triplets(spark, d), BENCHMARK, "Images_LR")


def stored_items(spark: SparkSession, d: str) -> DataFrame:
    """Items written once, as every job over a benchmark reads them several times."""
    return cut_lineage(items(spark, d))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Scored predictions of the items."""
    all_items = stored_items(spark, d)
    answered = all_items.join(bind(spark, d, "replies"), "item_id")
    return scoring.score_replies(answered, vocabulary.build_answer_spaces(all_items))


def _r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# ------------------------------------------------------------------ shared SQL


def norm(x: str) -> str:
    """ASCII form of the matching normalisation."""
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s%]', ' ', 'g'), "
        "'\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def readable(x: str) -> str:
    return (
        f"CASE WHEN {x} = 'NVG_surface' THEN 'non-vegetated ground surface' WHEN {x} = 'low_vegetation' THEN 'low vegetation' "
        f"WHEN regexp_matches({x}, '^\\d+_to_\\d+$') THEN replace({x}, '_to_', '-') || '%' WHEN {x} = '0' THEN '0%' ELSE {x} END"
    )


SPACES = f"""vocab AS (SELECT DISTINCT qtype, answer, {norm('answer')} AS nrm FROM items),
kinds AS (SELECT qtype, CASE WHEN bool_and(regexp_full_match(nrm, '[0-9]+')) THEN 'numeric'
    WHEN count(DISTINCT nrm) <= 12 THEN 'closed' ELSE 'open' END AS kind FROM vocab GROUP BY qtype),
opts AS (SELECT v.qtype, v.answer AS code, row_number() OVER (PARTITION BY v.qtype ORDER BY
    CASE WHEN v.answer = '0' OR regexp_matches(v.answer, '^\\d+_to_') THEN 0 ELSE 1 END,
    CASE WHEN v.answer = '0' THEN -1 WHEN regexp_matches(v.answer, '^\\d+_to_') THEN CAST(split_part(v.answer, '_', 1) AS BIGINT) ELSE 0 END,
    v.nrm, v.answer) AS ord FROM vocab v JOIN kinds k ON k.qtype = v.qtype AND k.kind = 'closed'),
spaces AS (SELECT k.qtype, k.kind, coalesce((SELECT string_agg(code, ',' ORDER BY ord) FROM opts o WHERE o.qtype = k.qtype), '') AS options,
    coalesce((SELECT string_agg({readable('code')}, ', ' ORDER BY ord) FROM opts o WHERE o.qtype = k.qtype), '') AS shown FROM kinds k)"""

WORDS = ", ".join(f"('{w}', {n})" for w, n in A.NUMBER_WORDS.items())
SCORED = f"""{SPACES},
words(word, num) AS (VALUES {WORDS}),
joined AS (SELECT i.item_id, i.pos, i.qtype, i.answer, k.kind, r.reply, r.confidence, r.error, r.latency_s, r.seq, {norm('r.reply')} AS txt
    FROM items i JOIN replies r ON r.item_id = i.item_id JOIN kinds k ON k.qtype = i.qtype),
toks AS (SELECT item_id, unnest(string_split(txt, ' ')) AS word, unnest(range(len(string_split(txt, ' ')))) AS wpos FROM joined WHERE txt IS NOT NULL),
firstword AS (SELECT t.item_id, arg_min(w.num, t.wpos) AS num FROM toks t JOIN words w ON w.word = t.word GROUP BY t.item_id),
numeric_form AS (SELECT j.item_id, CASE WHEN regexp_matches(txt, '[0-9]') THEN CAST(CAST(regexp_extract(txt, '[0-9]+') AS BIGINT) AS VARCHAR)
    WHEN f.num IS NOT NULL THEN CAST(f.num AS VARCHAR) ELSE txt END AS form FROM joined j LEFT JOIN firstword f ON f.item_id = j.item_id),
names AS (SELECT qtype, code, ord, {norm('code')} AS name FROM opts UNION SELECT qtype, code, ord, {norm(readable('code'))} FROM opts),
exact AS (SELECT j.item_id, arg_min(n.code, n.ord) AS code FROM joined j JOIN names n ON n.qtype = j.qtype AND n.name = j.txt GROUP BY j.item_id),
spots AS (SELECT j.item_id, n.code, n.ord, length(n.name) AS len, strpos(' ' || j.txt || ' ', ' ' || n.name || ' ') AS p
    FROM joined j JOIN names n ON n.qtype = j.qtype),
earliest AS (SELECT item_id, code FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p, len DESC, ord) AS rn FROM spots WHERE p > 0) WHERE rn = 1),
predicted AS (SELECT j.*, CASE WHEN j.error IS NOT NULL THEN NULL WHEN j.kind = 'numeric' THEN nf.form
    WHEN j.kind = 'closed' THEN coalesce(e.code, s.code, j.txt) ELSE j.txt END AS predicted, nf.form AS num_form
    FROM joined j LEFT JOIN numeric_form nf ON nf.item_id = j.item_id LEFT JOIN exact e ON e.item_id = j.item_id LEFT JOIN earliest s ON s.item_id = j.item_id),
records AS (SELECT *, coalesce(error IS NULL AND CASE WHEN kind = 'closed' THEN predicted = answer OR {norm('predicted')} = {norm('answer')}
    WHEN regexp_full_match({norm('answer')}, '[0-9]+') THEN num_form = CAST(CAST({norm('answer')} AS BIGINT) AS VARCHAR)
    ELSE predicted = {norm('answer')} END, false) AS correct FROM predicted)"""

WILSON = """CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, (correct*1.0/n + z*z/(2*n) - z*sqrt(correct*1.0/n*(1-correct*1.0/n)/n + z*z/(4.0*n*n)))/(1+z*z/n)), 6) END AS ci_low,
  CASE WHEN n = 0 THEN 0 ELSE round(least(1, (correct*1.0/n + z*z/(2*n) + z*sqrt(correct*1.0/n*(1-correct*1.0/n)/n + z*z/(4.0*n*n)))/(1+z*z/n)), 6) END AS ci_high"""
BY_TYPE = """SELECT coalesce(qtype, '(all)') AS qtype, count(*) AS n, count(*) FILTER (correct) AS correct,
  count(*) FILTER (error IS NOT NULL) AS errors, 1.959964 AS z FROM records GROUP BY GROUPING SETS ((qtype), ())"""
FLOOR_BY_TYPE = """SELECT coalesce(qtype, '(all)') AS qtype, sum(total)::BIGINT AS n, sum(hits)::BIGINT AS correct, 1.959964 AS z,
  CASE WHEN qtype IS NULL THEN NULL ELSE max(top) END AS floor_answer
  FROM (SELECT qtype, sum(n) AS total, max(n) AS hits, arg_max(answer, n * 1000000 - rnk) AS top
    FROM (SELECT qtype, answer, count(*) AS n, row_number() OVER (PARTITION BY qtype ORDER BY answer) AS rnk FROM records GROUP BY qtype, answer) GROUP BY qtype)
  GROUP BY GROUPING SETS ((qtype), ())"""
EVAL = "items replies"


# ------------------------------------------------------------------ queries


@query("annotation_items", oracle("items", "SELECT item_id, qtype, question, answer, path FROM items"))
def annotation_items(spark, d):
    return items(spark, d).select("item_id", "qtype", "question", "answer", F.col("image_paths")[0].alias("path"))


def _written_annotations(spark: SparkSession, d: str, base: str) -> str:
    """The bound annotations written as files of JSON lines, in a fresh folder: its path."""
    folder = f"{checkpoint_folder(spark)}/annotations-{uuid.uuid4()}"
    answers = bind(spark, d, "answers")
    listed = answers.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("answers_ids"))
    bind(spark, d, "questions").join(listed, "id", "left").write.json(f"{folder}/{base}_questions")
    answers.write.json(f"{folder}/{base}_answers")
    bind(spark, d, "images").write.json(f"{folder}/{base}_images")
    return folder


@query("annotation_files", oracle("items", "SELECT item_id, qtype, question, answer, path FROM items"))
def annotation_files(spark, d):
    """The three-file source, chosen by benchmark name with its default split."""
    found = load_benchmark(spark, BENCHMARK, _written_annotations(spark, d, "LR_split_test"), layout="lines", image_dir="Images_LR")
    return found.select("item_id", "qtype", "question", "answer", F.col("image_paths")[0].alias("path"))


@query("annotation_pair_files", oracle("items", "SELECT item_id, answer, 'im/im1/' || file_name AS before, 'im/im2/' || file_name AS after FROM items"))
def annotation_pair_files(spark, d):
    found = load_benchmark(spark, "cdvqa", _written_annotations(spark, d, "Val"), split="Val", layout="lines", image_dir="im")
    return found.select("item_id", "answer", F.col("image_paths")[0].alias("before"), F.col("image_paths")[1].alias("after"))


@query(
    "annotation_flat_file",
    "SELECT CAST(d.doc_id AS VARCHAR) AS item_id, md5(d.text) AS question, d.lang AS answer, CASE WHEN d.doc_id % 3 = 0 THEN 'unknown' ELSE d.source END AS qtype, 'imgs/' || d.doc_id || '.png' AS path FROM documents d",
)
def annotation_flat_file(spark, d):
    """The flat-list source over a written copy of the documents."""
    folder = f"{checkpoint_folder(spark)}/annotations-{uuid.uuid4()}"
    rows = table(spark, d, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image_id"), F.col("text").alias("question"), F.col("lang").alias("ground_truth"),
        F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("type"), F.lit("documents").alias("dataset"),
    )
    rows.write.json(f"{folder}/VRSBench_EVAL_vqa")
    found = load_benchmark(spark, "vrsbench-vqa", folder, layout="lines", image_dir="imgs")
    return found.select("item_id", F.md5("question").alias("question"), "answer", "qtype", F.col("image_paths")[0].alias("path"))


@query(
    "annotation_pair_items",
    oracle("items", "SELECT item_id, answer, 'im/im1/' || file_name AS before, 'im/im2/' || file_name AS after FROM items"),
)
def annotation_pair_items(spark, d):
    pairs = I.assemble_pair_items(triplets(spark, d), "cdvqa", "im")
    return pairs.select("item_id", "answer", F.col("image_paths")[0].alias("before"), F.col("image_paths")[1].alias("after"))


@query("answer_spaces", oracle("items", f"WITH {SPACES} SELECT qtype, kind, options FROM spaces"))
def answer_spaces(spark, d):
    spaces = vocabulary.build_answer_spaces(stored_items(spark, d))
    return spaces.select("qtype", "kind", F.array_join("options", ",").alias("options"))


@query("distinct_answers", oracle("items", "SELECT qtype, answer FROM items GROUP BY qtype, answer"))
def distinct_answers(spark, d):
    return vocabulary.distinct_answers(items(spark, d))


@query("distinct_item_images", oracle("items", "SELECT path FROM items GROUP BY path"))
def distinct_item_images(spark, d):
    return I.distinct_images(items(spark, d))


PROMPT_SQL = """CASE WHEN trim(i.question) LIKE '%?' THEN trim(i.question) ELSE trim(i.question) || '?' END || chr(10) ||
  CASE WHEN s.kind = 'closed' AND s.options IN ('no,yes', 'yes,no') THEN 'Answer with yes or no only.'
    WHEN s.kind = 'closed' THEN 'Answer with exactly one of: ' || s.shown || '. Reply with the answer only.'
    WHEN s.kind = 'numeric' THEN 'Answer with a single number in digits only.'
    ELSE 'Answer with a single word or a short phrase only.' END"""


@query(
    "benchmark_prompts",
    oracle("items", f"WITH {SPACES} SELECT i.item_id, {PROMPT_SQL} AS prompt FROM items i JOIN spaces s ON s.qtype = i.qtype"),
)
def benchmark_prompts(spark, d):
    all_items = stored_items(spark, d)
    return scoring.with_prompts(all_items, vocabulary.build_answer_spaces(all_items)).select("item_id", "prompt")


@query(
    "prior_answers",
    oracle(
        "items",
        "SELECT qtype, answer AS prior FROM (SELECT qtype, answer, row_number() OVER (PARTITION BY qtype ORDER BY count(*) DESC, min(pos)) AS rn "
        "FROM items GROUP BY qtype, answer) WHERE rn = 1",
    ),
)
def prior_answers(spark, d):
    return vocabulary.prior_answers(items(spark, d))


@query("scored_replies", oracle(EVAL, f"WITH {SCORED} SELECT item_id, predicted, CAST(correct AS INTEGER) AS correct FROM records"))
def scored_replies(spark, d):
    return records(spark, d).select("item_id", "predicted", F.col("correct").cast("int").alias("correct"))


@query(
    "accuracy_by_type",
    oracle(EVAL, f"WITH {SCORED} SELECT qtype, n, correct, errors, round(correct * 1.0 / n, 6) AS accuracy, {WILSON} FROM ({BY_TYPE})"),
)
def accuracy_by_type(spark, d):
    table_ = scoring.accuracy_summary(records(spark, d))
    return table_.select("qtype", "n", "correct", "errors", *_r6("accuracy", "ci_low", "ci_high"))


@query(
    "average_over_types",
    oracle(
        EVAL,
        f"WITH {SCORED}, t AS (SELECT qtype, avg(CAST(correct AS INTEGER)) AS acc FROM records GROUP BY qtype) "
        "SELECT round(avg(acc) FILTER (qtype NOT IN ('count', 'area')), 6) AS average_over_types, "
        "string_agg(qtype, ',' ORDER BY qtype) FILTER (qtype IN ('count', 'area')) AS excludes FROM t",
    ),
)
def average_over_types(spark, d):
    summary = scoring.accuracy_summary(records(spark, d))
    out = scoring.average_over_types(summary, scoring.PAPER_EXCLUDED_TYPES[BENCHMARK])
    return out.select(*_r6("average_over_types"), "excludes")


@query("excluded_types_present", oracle("items", "SELECT DISTINCT qtype FROM items WHERE qtype IN ('count', 'area')"))
def excluded_types_present(spark, d):
    excluded = spark.createDataFrame([(t,) for t in scoring.PAPER_EXCLUDED_TYPES[BENCHMARK]], "qtype string")
    return scoring.excluded_types_present(items(spark, d), excluded)


CALIBRATION = """SELECT sum(m)::BIGINT AS n, round(sum(gap * m) / sum(m), 6) AS ece, round(max(gap), 6) AS mce, round(sum(sq) / sum(m), 6) AS brier,
  round(sum(c) / sum(m), 6) AS mean_confidence FROM (SELECT count(*) AS m, abs(avg(confidence) - avg(CAST(correct AS INTEGER))) AS gap,
  sum(confidence) AS c, sum((confidence - CAST(correct AS INTEGER)) ** 2) AS sq FROM records WHERE error IS NULL AND confidence IS NOT NULL
  GROUP BY least(floor(confidence * 10), 9))"""


@query("calibration", oracle(EVAL, f"WITH {SCORED} {CALIBRATION}"))
def calibration(spark, d):
    return scoring.calibration(records(spark, d)).select("n", *_r6("ece", "mce", "brier", "mean_confidence"))


VERDICTS = """records AS (SELECT *, coalesce(error IS NULL AND (CASE WHEN reply LIKE 'Yes%' THEN 'yes' ELSE 'no' END) = answer, false) AS correct FROM verdicts)"""


def verdict_records(spark, d):
    judged = bind(spark, d, "verdicts")
    return scoring.score_replies(judged, vocabulary.build_answer_spaces(judged))


@query("calibration_documents", oracle("verdicts", f"WITH {VERDICTS} {CALIBRATION}"))
def calibration_documents(spark, d):
    return scoring.calibration(verdict_records(spark, d)).select("n", *_r6("ece", "mce", "brier", "mean_confidence"))


@query(
    "accuracy_documents",
    oracle("verdicts", f"WITH {VERDICTS} SELECT qtype, n, correct, errors, round(correct * 1.0 / n, 6) AS accuracy, {WILSON} FROM ({BY_TYPE})"),
)
def accuracy_documents(spark, d):
    table_ = scoring.accuracy_summary(verdict_records(spark, d))
    return table_.select("qtype", "n", "correct", "errors", *_r6("accuracy", "ci_low", "ci_high"))


@query(
    "latency_summary",
    oracle(
        "replies",
        "SELECT round(avg(latency_s), 6) AS mean_s, round(median(latency_s), 6) AS median_s, max(latency_s) AS max_s FROM replies WHERE error IS NULL",
    ),
)
def latency_summary(spark, d):
    return scoring.latency_summary(bind(spark, d, "replies")).select(*_r6("mean_s", "median_s"), "max_s")


@query(
    "majority_floor",
    oracle(EVAL, f"WITH {SCORED} SELECT qtype, floor_answer, n, correct, round(correct * 1.0 / n, 6) AS accuracy, {WILSON} FROM ({FLOOR_BY_TYPE})"),
)
def majority_floor(spark, d):
    floor = scoring.majority_floor(records(spark, d))
    return floor.select("qtype", "floor_answer", "n", "correct", *_r6("accuracy", "ci_low", "ci_high"))


REPORT = f"""WITH {SCORED}, model AS ({BY_TYPE}), floors AS ({FLOOR_BY_TYPE})
SELECT m.qtype, m.n, m.correct, m.errors, round(m.correct * 1.0 / m.n, 6) AS accuracy, m.ci_low, m.ci_high,
  round(coalesce(f.correct * 1.0 / f.n, 0), 6) AS floor FROM (SELECT *, {WILSON} FROM model) m LEFT JOIN floors f ON f.qtype = m.qtype"""


def _report(scored):
    scored = cut_lineage(scored)
    model = scoring.accuracy_summary(scored)
    joined = scoring.report_table(model, scoring.majority_floor(scored))
    return joined.select("qtype", "n", "correct", "errors", *_r6("accuracy", "ci_low", "ci_high", "floor"))


@query("report_vs_floor", oracle(EVAL, REPORT))
def report_vs_floor(spark, d):
    return _report(records(spark, d))


@query(
    "paper_protocol",
    oracle(EVAL, REPORT.replace("FROM predicted)", "FROM predicted WHERE qtype NOT IN ('count', 'area'))")),
)
def paper_protocol(spark, d):
    rows = [(b, t) for b, types in scoring.PAPER_EXCLUDED_TYPES.items() for t in types]
    excluded = spark.createDataFrame(rows, "benchmark string, qtype string")
    return _report(scoring.paper_protocol(records(spark, d), excluded))


@query(
    "report_lines",
    oracle(
        EVAL,
        f"SELECT qtype, '| ' || qtype || ' | ' || n || ' | ' || printf('%.1f%%', accuracy * 100) || ' | ' || printf('%.1f%%', ci_low * 100) || '-' "
        f"|| printf('%.1f%%', ci_high * 100) || ' | ' || printf('%.1f%%', floor * 100) || ' |' AS line FROM ({REPORT})",
    ),
)
def report_lines(spark, d):
    return P.report_lines(_report(records(spark, d)))


PRIOR_RUN = """prior AS (SELECT qtype, answer AS prior FROM (SELECT qtype, answer, row_number() OVER (PARTITION BY qtype ORDER BY count(*) DESC, min(pos)) AS rn
  FROM items GROUP BY qtype, answer) WHERE rn = 1)"""


@query(
    "prior_run_report",
    oracle(
        "items",
        f"WITH {PRIOR_RUN}, records AS (SELECT i.*, NULL AS error, i.answer = p.prior AS correct FROM items i JOIN prior p ON p.qtype = i.qtype), "
        f"model AS ({BY_TYPE}) SELECT qtype, n, correct, round(correct * 1.0 / n, 6) AS accuracy, {WILSON} FROM model",
    ),
)
def prior_run_report(spark, d):
    """The flagship path: join annotations, build vocabularies, answer with the prior, score and summarise."""
    all_items = stored_items(spark, d)
    spaces = vocabulary.build_answer_spaces(all_items)
    answered = join_small(all_items, vocabulary.prior_answers(all_items).withColumnRenamed("prior", "reply"), ["qtype"])
    summary = scoring.accuracy_summary(scoring.score_replies(answered, spaces))
    return summary.select("qtype", "n", "correct", *_r6("accuracy", "ci_low", "ci_high"))


SAMPLE_LIMIT = 500
QUOTAS = f"""sizes AS (SELECT qtype, count(*) AS size, min(pos) AS first_pos, greatest(1, CAST(round_even({SAMPLE_LIMIT}.0 * count(*) / (SELECT count(*) FROM items), 0) AS BIGINT)) AS q0 FROM items GROUP BY qtype),
units AS (SELECT qtype, first_pos, unnest(range(2, q0 + 1)) AS unit FROM sizes),
lost AS (SELECT qtype, count(*) AS lost FROM (SELECT qtype, row_number() OVER (ORDER BY unit DESC, first_pos) AS rn FROM units)
  WHERE rn <= (SELECT greatest(sum(q0) - {SAMPLE_LIMIT}, 0) FROM sizes) GROUP BY qtype),
quotas AS (SELECT s.qtype, s.size, CAST(s.q0 - coalesce(l.lost, 0) AS BIGINT) AS quota FROM sizes s LEFT JOIN lost l ON l.qtype = s.qtype)"""


@query("sample_quotas", oracle("items", f"WITH {QUOTAS} SELECT qtype, size, quota FROM quotas"))
def sample_quotas(spark, d):
    return sampling.sample_quotas(stored_items(spark, d), SAMPLE_LIMIT)


@query(
    "stratified_sample",
    oracle(
        "items",
        f"WITH {QUOTAS} SELECT item_id, qtype FROM (SELECT i.item_id, i.qtype, q.quota, row_number() OVER (PARTITION BY i.qtype ORDER BY md5('7' || chr(1) || i.item_id), i.item_id) AS rn "
        "FROM items i JOIN quotas q ON q.qtype = i.qtype) WHERE rn <= quota",
    ),
)
def stratified_sample(spark, d):
    return sampling.stratified_sample(stored_items(spark, d), SAMPLE_LIMIT, seed=7).select("item_id", "qtype")


PACK_SIZE = 4
PACKS = f"""{SPACES}, ranked AS (SELECT i.item_id, i.path, i.qtype, row_number() OVER (PARTITION BY i.path ORDER BY md5('0' || chr(1) || i.item_id), i.item_id) AS rn,
  {PROMPT_SQL} AS prompt, CASE s.kind WHEN 'closed' THEN {readable('i.answer')} WHEN 'numeric' THEN CAST(CAST(i.answer AS BIGINT) AS VARCHAR) ELSE i.answer END AS target
  FROM items i JOIN spaces s ON s.qtype = i.qtype)"""


def packs(spark, d):
    all_items = stored_items(spark, d)
    return packing.build_packs(all_items, vocabulary.build_answer_spaces(all_items), PACK_SIZE, seed=0)


@query(
    "training_packs",
    oracle(
        "items",
        f"WITH {PACKS} SELECT path AS image_key, CAST(floor((rn - 1) / {PACK_SIZE}) AS BIGINT) AS pack_no, CAST((rn - 1) % {PACK_SIZE} AS BIGINT) AS position, item_id, prompt, target, "
        f"md5('0' || chr(1) || path || chr(1) || CAST(floor((rn - 1) / {PACK_SIZE}) AS BIGINT)) AS pack_order FROM ranked",
    ),
)
def training_packs(spark, d):
    turns = packs(spark, d).select("image_key", "pack_no", "pack_order", F.posexplode("turns").alias("position", "t"))
    return turns.select("image_key", "pack_no", "pack_order", F.col("position").cast("long").alias("position"), "t.*")


@query(
    "pack_messages",
    oracle(
        "items",
        f"WITH {PACKS}, turns AS (SELECT path, CAST(floor((rn - 1) / {PACK_SIZE}) AS BIGINT) AS pack_no, (rn - 1) % {PACK_SIZE} AS k, prompt, target FROM ranked) "
        "SELECT path AS image_key, pack_no, CAST(2 * k AS BIGINT) AS position, 'user' AS role, CASE WHEN k = 0 THEN 1 ELSE 0 END AS n_images, prompt AS text FROM turns UNION ALL "
        "SELECT path, pack_no, CAST(2 * k + 1 AS BIGINT), 'assistant', 0, target FROM turns",
    ),
)
def pack_messages(spark, d):
    return packing.pack_messages(packs(spark, d)).withColumn("position", F.col("position").cast("long"))


START, END, HEADER = 1, 2, (7, 8)


@query(
    "loss_mask",
    oracle(
        "",
        f"""WITH tok AS (SELECT doc_id AS seq_id, unnest(range(len(w))) AS pos, unnest(list_transform(w, lambda x: length(x) % 10)) AS token
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
m AS (SELECT *, CASE WHEN lag(token, 3) OVER o = {START} AND lag(token, 2) OVER o = {HEADER[0]} AND lag(token, 1) OVER o = {HEADER[1]} THEN pos END AS b,
  CASE WHEN token = {END} THEN pos END AS e FROM tok WINDOW o AS (PARTITION BY seq_id ORDER BY pos)),
f AS (SELECT *, max(b) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lb,
  max(e) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM m)
SELECT seq_id, count(*) AS tokens, count(*) FILTER (coalesce(lb > coalesce(le, -1), false)) AS in_loss FROM f GROUP BY seq_id""",
    ),
)
def loss_mask(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    sequences = docs.select(F.col("doc_id").alias("seq_id"), F.transform("w", lambda x: F.length(x) % 10).alias("tokens"))
    masked = packing.loss_mask(sequences, START, END, HEADER)
    return masked.groupBy("seq_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("in_loss").alias("in_loss"))


@query(
    "resume_items",
    oracle(EVAL, "SELECT item_id, qtype FROM items WHERE item_id NOT IN (SELECT item_id FROM replies WHERE error IS NULL AND seq % 3 = 0)"),
)
def resume_items(spark, d):
    done = bind(spark, d, "replies").where("error IS NULL AND seq % 3 = 0")
    return scoring.unanswered(items(spark, d), done).select("item_id", "qtype")


@query("wanted_predictions", oracle(EVAL, "SELECT item_id, seq FROM replies WHERE item_id IN (SELECT item_id FROM items)"))
def wanted_predictions(spark, d):
    return scoring.wanted_only(bind(spark, d, "replies"), items(spark, d)).select("item_id", "seq")


@query(
    "missing_images",
    oracle(
        "items",
        """WITH inv AS (SELECT 'im/im1/' || c_name || '.png' AS path FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT 'im/im2/' || c_name || '.png' FROM customer WHERE c_custkey % 6 <> 2),
w AS (SELECT item_id, 0 AS p, 'im/im1/' || file_name AS path FROM items UNION ALL SELECT item_id, 1, 'im/im2/' || file_name FROM items)
SELECT item_id, 'FileNotFoundError: image not found: ' || arg_min(path, p) AS error FROM w WHERE path NOT IN (SELECT path FROM inv) GROUP BY item_id""",
    ),
)
def missing_images(spark, d):
    c = table(spark, d, "customer")
    path = lambda side: F.concat(F.lit(f"im/{side}/"), "c_name", F.lit(".png")).alias("path")
    inventory = c.where("c_custkey % 4 <> 1").select(path("im1")).unionAll(c.where("c_custkey % 6 <> 2").select(path("im2")))
    return I.missing_images(I.assemble_pair_items(triplets(spark, d), "cdvqa", "im"), inventory)


@query(
    "split_leakage",
    oracle(
        "",
        """WITH s AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, o_custkey AS image FROM orders)
SELECT image, count(*) AS n_splits, string_agg(split, ',' ORDER BY split) AS splits FROM s GROUP BY image HAVING count(*) > 1""",
    ),
)
def split_leakage(spark, d):
    split = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END")
    return I.split_leakage(table(spark, d, "orders").select(split.alias("split"), F.col("o_custkey").alias("image")))


@query(
    "latest_predictions",
    oracle(
        "",
        "SELECT CAST(l_orderkey AS VARCHAR) AS item_id, max(k) AS seq, arg_max(l_extendedprice, k) AS latency_s FROM "
        "(SELECT *, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS k FROM lineitem) GROUP BY l_orderkey",
    ),
)
def latest_predictions(spark, d):
    log = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("item_id"),
        (F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"),
        F.col("l_extendedprice").alias("latency_s"),
    )
    return P.latest_predictions(log)


@query(
    "running_progress",
    oracle(
        EVAL,
        f"""WITH {SCORED}, p AS (SELECT seq, CAST(correct AS INTEGER) AS hit, latency_s FROM records),
r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS done, avg(hit) OVER o AS acc, sum(latency_s) OVER o AS s, max(seq) OVER () AS last
  FROM p WINDOW o AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, done, round(acc, 6) AS running_accuracy, round(s / done + 1e-9, 6) AS seconds_per_item, round(s / done * (20000 - done) / 60 + 1e-7, 4) AS minutes_left
FROM r WHERE done % 25 = 0 OR seq = last""",
    ),
)
def running_progress(spark, d):
    out = scoring.running_progress(records(spark, d), total=20000, bucket_rows=4096)
    return out.select(
        "seq", "done", *_r6("running_accuracy"),
        F.round(F.col("seconds_per_item") + 1e-9, 6).alias("seconds_per_item"),
        F.round(F.col("minutes_left") + 1e-7, 4).alias("minutes_left"),
    )


@query(
    "run_identity_conflicts",
    oracle(
        "",
        """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, f AS field FROM (
  SELECT o_orderkey, unnest(['split', 'seed', 'adapter']) AS f, unnest([CAST(o_orderstatus AS VARCHAR), CAST(o_orderkey % 5 AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'm' END]) AS a,
    unnest(['P', CAST(o_orderkey % 7 AS VARCHAR), CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'm' END]) AS b FROM orders) WHERE a IS DISTINCT FROM b""",
    ),
)
def run_identity_conflicts(spark, d):
    o = table(spark, d, "orders")
    fixed = [F.lit("x").alias(k) for k in ("benchmark", "limit", "predictor")]
    key = F.col("o_orderkey").cast("string").alias("run_id")
    adapter = lambda m: F.when(F.col("o_orderkey") % m != 0, "m").alias("adapter")
    stored = o.select(key, *fixed, F.col("o_orderstatus").alias("split"), (F.col("o_orderkey") % 5).alias("seed"), adapter(4))
    wanted = o.select(key, *fixed, F.lit("P").alias("split"), (F.col("o_orderkey") % 7).alias("seed"), adapter(6))
    return P.same_run(stored, wanted).select("run_id", "field")


# Python-style normalisation without look-around: mark '%' boundaries, then drop article tokens.
NORMALISED = """SELECT doc_id, trim(regexp_replace(replace(replace(array_to_string(list_transform(string_split(
    replace(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s%]', ' ', 'g'), '\\s+', ' ', 'g')), '%', chr(1) || ' % ' || chr(1)), ' '),
    lambda x: CASE WHEN replace(x, chr(1), '') IN ('a', 'an', 'the') THEN '' ELSE x END), ' '), chr(1) || ' ', ''), ' ' || chr(1), ''), '\\s+', ' ', 'g')) AS t FROM documents"""


@query("normalized_text", oracle("", f"SELECT doc_id, md5(replace(t, chr(1), '')) AS digest, length(replace(t, chr(1), '')) AS n FROM ({NORMALISED})"))
def normalized_text(spark, d):
    text = table(spark, d, "documents").select("doc_id", A.normalize(F.col("text")).alias("t"))
    return text.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("readable_codes", oracle("items", f"SELECT item_id, {readable('answer')} AS shown FROM items"))
def readable_codes(spark, d):
    return items(spark, d).select("item_id", A.readable(F.col("answer")).alias("shown"))
