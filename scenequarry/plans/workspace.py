"""Conversations, captions, runs, reports, uploads and small cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import language as L
from scenequarry.functions import measures as M
from scenequarry.functions import places, telemetry
from scenequarry.operators import chat, runs, uploads
from scenequarry.plans.bindings import bind, oracle, table
from scenequarry.plans.registry import Register
from scenequarry.sources import records

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return STRIP.format(x)


def squeeze(x: str) -> str:
    return SQUEEZE.format(x)


# ------------------------------------------------------------------ conversations


@query(
    "model_history",
    oracle(
        "turns prompts",
        f"""WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'ai' THEN 'assistant' ELSE role END AS role, text FROM turns
  WHERE role IN ('user', 'assistant', 'ai') AND scope IS NULL AND {strip('text')} <> '' AND NOT starts_with({strip('text')}, '[System]')),
n AS (SELECT u.*, row_number() OVER (PARTITION BY u.conv_id ORDER BY turn DESC) AS rn, {strip('p.prompt')} AS prompt FROM u JOIN prompts p ON p.conv_id = u.conv_id),
k AS (SELECT *, max(CASE WHEN rn = 1 AND role = 'user' AND {strip('text')} = prompt THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS dropped FROM n),
c AS (SELECT conv_id, turn, role, {squeeze("CASE WHEN role = 'assistant' AND strpos(text, 'ASSESSMENT:') > 0 THEN substr(text, strpos(text, 'ASSESSMENT:')) ELSE text END")} AS t
  FROM k WHERE rn > dropped AND rn - dropped <= 6)
SELECT conv_id, turn, role, CASE WHEN length(t) <= 500 THEN t ELSE rtrim(substr(t, 1, 499)) || '…' END AS content FROM c""",
    ),
)
def model_history(spark, d):
    return chat.model_history(bind(spark, d, "turns"), bind(spark, d, "prompts"))


@query(
    "clarification_gate",
    oracle(
        "openings",
        r"""WITH f AS (SELECT conv_id, min_by(text, turn) AS text FROM openings WHERE role = 'user' GROUP BY conv_id),
g AS (SELECT conv_id, regexp_replace(lower(text), '^[?!.,\s]+|[?!.,\s]+$', '', 'g') AS t FROM f)
SELECT conv_id, CASE WHEN t = '' THEN 'empty' ELSE 'vague' END AS reason FROM g WHERE t IN ('', 'hello', 'tell me more', 'ok', 'test', 'hi', 'thanks')""",
    ),
)
def clarification_gate(spark, d):
    return chat.clarification_gate(bind(spark, d, "openings"))


ASCII_TEXT = r"trim(regexp_replace(regexp_replace(lower(question), '[^\x00-\x7F]', 'x', 'g'), '\s+', ' ', 'g'))"
ROUTED = f"""routed AS (SELECT conv_id, turn, CASE WHEN q = '' THEN 'open'
  WHEN regexp_matches(q, '\\b(rural|urban)\\b.*\\b(rural|urban)\\b') THEN 'rural_urban'
  WHEN regexp_matches(q, '^(how many|what is the (number|amount|count) of|what''s the number of|number of|count (the|how))\\b') THEN 'numeric'
  WHEN regexp_extract(q, '^([^\\s,?]*)', 1) IN ('is','are','was','were','does','do','did','can','could','has','have','had','will','would','should')
    AND NOT regexp_matches(q, '\\bor\\b') AND NOT regexp_matches(q, '^(can|could|would|will) (you|u)\\b')
    AND NOT regexp_matches(q, '\\b(describe|explain|tell|show|list|identify|highlight|locate|where|which|what|why|how)\\b') THEN 'yes_no'
  ELSE 'open' END AS route FROM (SELECT conv_id, turn, {ASCII_TEXT} AS q FROM asked))"""


@query("question_routes", oracle("asked", f"WITH {ROUTED} SELECT * FROM routed"))
def question_routes(spark, d):
    return bind(spark, d, "asked").select("conv_id", "turn", L.question_route(F.col("question")).alias("route"))


@query(
    "route_counts",
    oracle(
        "asked",
        f"WITH {ROUTED} SELECT route, count(*) AS n, count(*) FILTER (route IN ('yes_no', 'rural_urban')) AS to_adapter FROM routed GROUP BY route",
    ),
)
def route_counts(spark, d):
    return chat.route_counts(bind(spark, d, "asked"))


@query(
    "generic_questions",
    oracle("asked", r"SELECT conv_id, turn, CAST(regexp_matches(question, '(?i)chang|differ|compar|what.*(happen|new)|^\s*$') AS INTEGER) AS generic FROM asked"),
)
def generic_questions(spark, d):
    return bind(spark, d, "asked").select("conv_id", "turn", L.is_generic_question(F.col("question")).cast("int").alias("generic"))


@query(
    "display_answers",
    oracle(
        "replies",
        "SELECT item_id, CASE seq % 3 WHEN 0 THEN CASE WHEN lower(reply) LIKE 'yes%' THEN 'Yes' WHEN lower(reply) LIKE 'no, %' THEN 'No' END "
        "WHEN 1 THEN CASE WHEN reply = 'There are twelve.' THEN '12' WHEN reply LIKE 'No, %' THEN '0' WHEN reply = '10-20%' THEN '10' WHEN reply LIKE 'the Thing%' THEN CAST(seq % 40 AS VARCHAR) END END AS shown FROM replies",
    ),
)
def display_answers(spark, d):
    from scenequarry.functions import answers as A

    kind = F.expr("CASE seq % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'numeric' ELSE 'open' END")
    options = F.when(kind == "closed", F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array().cast("array<string>"))
    predicted = A.canonical(kind, A.option_forms(options), F.col("reply"))
    return bind(spark, d, "replies").select("item_id", L.display_answer(kind, options, predicted).alias("shown"))


@query("emphasis_removed", oracle("", "SELECT doc_id, md5(regexp_replace(text, '\\*', '', 'g')) AS digest FROM documents"))
def emphasis_removed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(L.strip_emphasis(F.col("text"))).alias("digest"))


NUM = r"(^| )\d+\. "
CLEANED = f"""flat AS (SELECT doc_id, {squeeze('text')} AS o FROM captions),
body AS (SELECT doc_id, o, regexp_replace(o, '(?i)^\\s*The (?:image|crop) shows a satellite (?:view|image) of [^.:]*[.:]\\s*(?:Visible features include:?\\s*)?', '') AS b FROM flat),
plain AS (SELECT doc_id, o, CASE WHEN NOT regexp_matches(b, '{NUM}') THEN b WHEN strpos(b, ':') > 0 THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(^| )\\d+\\. [A-Z][^:.]{{1,40}}:\\s*', '\\1', 'g'), '(^| )\\d+\\. [A-Z][^:.]{{1,40}}:\\s*', '\\1', 'g'), '{NUM}', '\\1', 'g'), '{NUM}', '\\1', 'g')
  ELSE (SELECT CASE WHEN count(*) = 0 THEN '' ELSE 'Noted: ' || string_agg(p, ', ' ORDER BY i) || '.' END FROM (
    SELECT i, regexp_replace(x, '^[ ,;.]+|[ ,;.]+$', '', 'g') AS p FROM (SELECT unnest(parts) AS x, unnest(range(len(parts))) AS i FROM
      (SELECT string_split(regexp_replace(regexp_replace(b, '{NUM}', '\\1' || chr(2), 'g'), '{NUM}', '\\1' || chr(2), 'g'), chr(2)) AS parts))) WHERE p <> '') END AS t FROM body),
kept AS (SELECT doc_id, o, trim(array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)),
  lambda s: s <> '' AND NOT regexp_matches(s, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:there (?:is|are) no|no visible|not visible|nothing visible|no (?:[\\p{{L}}\\p{{N}}_-]+ ){{0,3}}(?:is|are) (?:visible|present))($|[^\\p{{L}}\\p{{N}}_])')), ' ')) AS k FROM plain),
cleaned AS (SELECT doc_id, CASE WHEN k = '' THEN o ELSE k END AS c FROM kept)"""


@query("clean_captions", oracle("captions", f"WITH {CLEANED} SELECT doc_id, md5(c) AS digest, length(c) AS n FROM cleaned"))
def clean_captions(spark, d):
    cleaned = bind(spark, d, "captions").select("doc_id", L.clean_caption(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query(
    "clipped_captions",
    oracle(
        "captions",
        f"""WITH f AS (SELECT doc_id, {squeeze('text')} AS t FROM captions), h AS (SELECT *, substr(t, 1, 200) AS h FROM f),
e AS (SELECT *, list_max(list_filter(range(1, length(h) + 1), lambda i: substr(h, i, 1) IN ('.', '!', '?') AND (i = length(h) OR substr(h, i + 1, 1) = ' ')
  AND NOT regexp_matches(substr(h, 1, i - 1), '(^| )\\d+ ?$'))) AS cut FROM h)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN cut >= 66 THEN substr(h, 1, cut)
  ELSE regexp_replace(regexp_replace(h, ' [^ ]*$', ''), '[,;:]+$', '') || '…' END AS clipped FROM e""",
    ),
)
def clipped_captions(spark, d):
    return bind(spark, d, "captions").select("doc_id", L.clip_sentence(F.col("text"), 200).alias("clipped"))


# ------------------------------------------------------------------ runs and reports

RUN_RANK = "CASE WHEN kind IN ('scan', 'change', 'fusion') THEN 1 ELSE 0 END"


@query(
    "report_runs",
    oracle(
        "runs picks",
        f"""SELECT workspace, run_id, kind, ran_at FROM (SELECT r.*, row_number() OVER (PARTITION BY r.workspace ORDER BY
  CASE WHEN p.run_id = r.run_id THEN 1 ELSE 0 END DESC, {RUN_RANK} DESC, ran_at DESC, r.run_id DESC) AS rn FROM runs r JOIN picks p ON p.workspace = r.workspace) WHERE rn = 1""",
    ),
)
def report_runs(spark, d):
    return runs.report_runs(bind(spark, d, "runs"), bind(spark, d, "picks"))


@query(
    "latest_runs",
    oracle(
        "runs",
        "SELECT workspace, run_id, kind, ran_at FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY ran_at DESC, run_id DESC) AS rn FROM runs WHERE kind IN ('scan', 'change')) WHERE rn = 1",
    ),
)
def latest_runs(spark, d):
    return runs.latest_runs(bind(spark, d, "runs"), ("scan", "change"))


@query(
    "surviving_runs",
    oracle(
        "runs slot_changes",
        """WITH m(slot, kind) AS (VALUES ('a', 'chat'), ('a', 'scan'), ('before', 'change'), ('after', 'change'), ('optical', 'fusion'), ('sar', 'fusion'))
SELECT run_id, workspace, kind FROM runs r WHERE NOT EXISTS (SELECT 1 FROM slot_changes s JOIN m ON m.slot = s.slot WHERE s.workspace = r.workspace AND m.kind = r.kind AND s.changed_at >= r.ran_at)""",
    ),
)
def surviving_runs(spark, d):
    return runs.surviving_runs(bind(spark, d, "runs"), bind(spark, d, "slot_changes")).select("run_id", "workspace", "kind")


@query(
    "report_history",
    oracle(
        "report_log",
        """SELECT user_id, position, session_id, created_at, md5(title) AS title FROM (SELECT user_id, session_id, created_at, CASE WHEN coalesce(title, '') = '' THEN query ELSE title END AS title,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id DESC) AS position FROM report_log) WHERE position <= 100""",
    ),
)
def report_history(spark, d):
    return runs.report_history(bind(spark, d, "report_log")).withColumn("title", F.md5("title"))


@query(
    "latest_reports",
    oracle(
        "report_log",
        "SELECT session_id, max_by(user_id, created_at) AS user_id, md5(max_by(substr(query, 1, 2000), created_at)) AS digest, max(created_at) AS created_at FROM report_log GROUP BY session_id",
    ),
)
def latest_reports(spark, d):
    latest = runs.latest_reports(bind(spark, d, "report_log"))
    return latest.select("session_id", "user_id", F.md5("query").alias("digest"), "created_at")


JUDGED = """judged AS (SELECT u.*, trim(u.title) AS t, CASE WHEN trim(u.title) = '' THEN 'empty title' WHEN length(trim(u.title)) > 200 THEN 'title too long'
  WHEN r.user_id IS DISTINCT FROM u.user_id THEN 'no such report' END AS reason FROM renames u LEFT JOIN reports r ON r.session_id = u.session_id)"""


@query(
    "renamed_reports",
    oracle(
        "reports renames",
        f"WITH {JUDGED} SELECT r.session_id, r.user_id, j.t AS title FROM reports r LEFT JOIN (SELECT session_id, max_by(t, update_id) AS t FROM judged WHERE reason IS NULL GROUP BY session_id) j ON j.session_id = r.session_id",
    ),
)
def renamed_reports(spark, d):
    return runs.rename_reports(bind(spark, d, "reports"), bind(spark, d, "renames"))[0]


@query("rejected_renames", oracle("reports renames", f"WITH {JUDGED} SELECT update_id, session_id, user_id, reason FROM judged WHERE reason IS NOT NULL"))
def rejected_renames(spark, d):
    return runs.rename_reports(bind(spark, d, "reports"), bind(spark, d, "renames"))[1]


@query("owned_reports", oracle("reports renames", "SELECT u.update_id FROM renames u WHERE EXISTS (SELECT 1 FROM reports r WHERE r.session_id = u.session_id AND r.user_id = u.user_id)"))
def owned_reports(spark, d):
    return runs.owned_reports(bind(spark, d, "renames"), bind(spark, d, "reports")).select("update_id")


@query(
    "valid_sessions",
    oracle(
        "runs",
        "SELECT r.run_id AS request_id, c.c_custkey AS user_id FROM runs r JOIN customer c ON c.c_custkey = r.event_id % 2000 WHERE 1704067200 + c.c_custkey * 2000 > r.ran_at",
    ),
)
def valid_sessions(spark, d):
    key = F.concat(F.lit("tok"), F.col("c_custkey").cast("string"))
    sessions = table(spark, d, "customer").select(
        F.sha2(key, 256).alias("token_hash"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 2000 + 1704067200).alias("expires_at")
    )
    token = F.concat(F.lit("tok"), (F.col("event_id") % 2000).cast("string")).alias("token")
    return runs.valid_sessions(bind(spark, d, "runs").select(F.col("run_id").alias("request_id"), token, F.col("ran_at").alias("now")), sessions)


NOW, MAX_AGE = 1706659200.0, 24.0


@query(
    "expired_sessions",
    oracle("session_files", f"SELECT session, max(mtime) AS newest FROM session_files WHERE session NOT LIKE 'scratch%' GROUP BY session HAVING max(mtime) < {NOW} - {MAX_AGE} * 3600"),
)
def expired_sessions(spark, d):
    return runs.expired_sessions(bind(spark, d, "session_files"), NOW, MAX_AGE)


@query("newest_file_times", oracle("session_files", "SELECT session, max(mtime) AS newest FROM session_files GROUP BY session"))
def newest_file_times(spark, d):
    return runs.newest_file_times(bind(spark, d, "session_files"))


def traces(spark, d):
    k = F.col("o_orderkey")
    stages = F.array_compact(F.array(F.lit("RuleBasedRouter"), F.lit("InputPreprocessor"), F.when(k % 2 == 0, "TemporalOrdering"), F.when(k % 3 == 1, "EvidenceReport")))
    return table(spark, d, "orders").select(
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'change' ELSE 'fusion' END").alias("task"),
        stages.alias("nodes"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 3).cast("int")).alias("warnings"),
        F.when(k % 7 == 0, "failed").otherwise("completed").alias("status"),
    )


@query(
    "trace_rollup",
    oracle(
        "",
        """WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'change' ELSE 'fusion' END AS task, o_orderkey % 3 AS w, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS bad, o_orderkey AS k FROM orders),
s AS (SELECT task, w, bad, 'RuleBasedRouter' AS stage FROM t UNION ALL SELECT task, w, bad, 'InputPreprocessor' FROM t UNION ALL SELECT task, w, bad, 'TemporalOrdering' FROM t WHERE k % 2 = 0 UNION ALL SELECT task, w, bad, 'EvidenceReport' FROM t WHERE k % 3 = 1)
SELECT coalesce(task, '(all)') AS task, coalesce(stage, '(all)') AS stage, count(*) AS visits, CAST(sum(w) AS BIGINT) AS warnings, CAST(sum(bad) AS BIGINT) AS not_completed FROM s GROUP BY ROLLUP (task, stage)""",
    ),
)
def trace_rollup(spark, d):
    return runs.trace_rollup(traces(spark, d))


CONF = "CASE WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL ELSE value / 40 - 0.1 END"


@query(
    "confidence_bands",
    oracle(
        "",
        f"""WITH c AS (SELECT event_id, CASE WHEN isnan(c) OR c IS NULL THEN NULL ELSE least(greatest(c, 0), 1) END AS c FROM (SELECT event_id, {CONF} AS c FROM events))
SELECT event_id, CASE WHEN c >= 0.85 THEN 'High' WHEN c >= 0.6 THEN 'Medium' WHEN c IS NOT NULL THEN 'Low' END AS band, CAST(floor(c * 100 + 0.5) AS BIGINT) AS pct FROM c""",
    ),
)
def confidence_bands(spark, d):
    scored = table(spark, d, "events").select("event_id", F.expr(CONF).alias("c"))
    return scored.select("event_id", M.confidence_band(F.col("c")).alias("band"), F.floor(M.usable_confidence(F.col("c")) * 100 + 0.5).alias("pct"))


@query(
    "finding_labels",
    oracle("", "SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'High confidence' WHEN value / 100 >= 0.75 THEN 'Likely' ELSE 'Possible' END AS label FROM events"),
)
def finding_labels(spark, d):
    return table(spark, d, "events").select("event_id", M.finding_label(F.col("value") / 100).alias("label"))


# ------------------------------------------------------------------ uploads

PREFIXES = {0: "89504E470D0A1A0A", 1: "FFD8FFE0", 2: "49492A00", 3: "4D4D002B", 4: "524946460000000057454250", 5: "524946460000000057415645", 6: ""}
UPLOADS = """up AS (SELECT CAST(floor(page_id * 2 / 5) AS BIGINT) AS request_id, page_id AS idx, CASE WHEN page_id % 23 = 0 THEN '' ELSE url END AS file_name,
  CASE page_id % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 8 THEN 'text/html' ELSE 'image/tiff' END AS declared_type,
  CASE WHEN page_id % 13 = 0 THEN 'lidar' WHEN page_id % 4 = 0 THEN 'sar' ELSE 'optical' END AS modality,
  CASE page_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'tiff' WHEN 3 THEN 'tiff' WHEN 4 THEN 'webp' END AS kind,
  strlen(html) + CASE page_id % 7 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 12 WHEN 5 THEN 12 ELSE 0 END AS bytes FROM pages)"""
UPLOAD_LIMIT = 6000


def upload_table(spark, d):
    p = F.col("page_id")
    head = F.unhex(F.get(F.array(*[F.lit(x) for x in PREFIXES.values()]), (p % 7).cast("int")))
    return table(spark, d, "pages").select(
        F.floor(p * 2 / 5).alias("request_id"),
        p.alias("idx"),
        F.when(p % 23 == 0, "").otherwise(F.col("url")).alias("file_name"),
        F.expr("CASE page_id % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 8 THEN 'text/html' ELSE 'image/tiff' END").alias("declared_type"),
        F.expr("CASE WHEN page_id % 13 = 0 THEN 'Lidar' WHEN page_id % 4 = 0 THEN 'SAR' ELSE 'optical' END").alias("modality"),
        F.concat(head, F.encode("html", "utf-8")).alias("content"),
    )


@query("upload_kinds", oracle("", f"WITH {UPLOADS} SELECT idx, kind, CAST(bytes AS BIGINT) AS bytes FROM up"))
def upload_kinds(spark, d):
    return uploads.inventory(upload_table(spark, d)).select("idx", "kind", "bytes")


FILE_REASON = f"""judged AS (SELECT *, CASE WHEN file_name = '' THEN 'no file name' WHEN modality = 'lidar' THEN 'invalid modality' WHEN declared_type = 'text/html' THEN 'unsupported type'
  WHEN bytes > {UPLOAD_LIMIT} THEN 'file too large' WHEN kind IS NULL THEN 'not an image' END AS reason FROM up)"""


@query("upload_rejections", oracle("", f"WITH {UPLOADS}, {FILE_REASON} SELECT idx, reason FROM judged WHERE reason IS NOT NULL"))
def upload_rejections(spark, d):
    return uploads.with_rejections(uploads.inventory(upload_table(spark, d)), UPLOAD_LIMIT).where("reason IS NOT NULL").select("idx", "reason")


@query(
    "upload_requests",
    oracle(
        "",
        f"""WITH {UPLOADS}, {FILE_REASON}, r AS (SELECT request_id, count(*) AS n_images, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) FILTER (kind = 'tiff') AS tiffs,
  min_by(reason, idx) FILTER (reason IS NOT NULL) AS fr FROM judged GROUP BY request_id)
SELECT request_id, n_images, total_bytes, CASE WHEN total_bytes > 2 * {UPLOAD_LIMIT} + 1048576 THEN 'request too large' WHEN n_images > 2 THEN 'too many images'
  WHEN fr IS NOT NULL THEN fr WHEN n_images = 2 AND tiffs = 1 THEN 'mixed file kinds' END AS reason FROM r""",
    ),
)
def upload_requests(spark, d):
    return uploads.judge_requests(uploads.inventory(upload_table(spark, d)), UPLOAD_LIMIT)


@query(
    "task_routes",
    oracle(
        "",
        f"""WITH {UPLOADS}, r AS (SELECT request_id, count(*) AS n, min_by(modality, idx) AS a, max_by(modality, idx) AS b FROM up GROUP BY request_id)
SELECT request_id, CASE WHEN n = 1 THEN 'SINGLE_IMAGE_VQA' WHEN a = b THEN 'CHANGE_DETECTION' ELSE 'OPTICAL_SAR_FUSION' END AS task,
  CASE WHEN n = 1 THEN '1 image uploaded' WHEN a = b THEN '2 images of the same sensor type (' || a || ' + ' || b || ')' ELSE '2 images of different sensor types (' || a || ' + ' || b || ')' END AS reason FROM r WHERE n <= 2""",
    ),
)
def task_routes(spark, d):
    return uploads.route_tasks(uploads.inventory(upload_table(spark, d)))


@query(
    "domain_rejects",
    oracle(
        "",
        "SELECT o_orderkey, CAST(o_orderpriority IN ('1-URGENT') AS INTEGER) AS known FROM orders",
    ),
)
def domain_rejects(spark, d):
    adapter = F.when(F.col("o_orderpriority") == "1-URGENT", "mining").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", uploads.adapter_is_known(adapter).cast("int").alias("known"))


# ------------------------------------------------------------------ cleaning jobs


@query(
    "telemetry_text",
    oracle(
        "",
        """SELECT event_id, n AS name, t AS text FROM (SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['model', 'k', 'ok', 'none', 'props'] WHEN 1 THEN ['list', 'empty', 'ok', 'deep'] WHEN 2 THEN ['order', 'raw', 'props'] ELSE CASE WHEN event_id % 100 IN (3, 7) THEN ['deep', 'k'] ELSE ['k'] END END) AS n,
  unnest(CASE event_id % 4 WHEN 0 THEN ['base', '7', 'yes', 'n/a', replace(props, ' ', '')] WHEN 1 THEN ['1; a; no; n/a', 'none', 'no', 'yes; n/a; ' || replace(props, ' ', '')]
  WHEN 2 THEN ['as uploaded', '{"b":1}', replace(props, ' ', '')] ELSE CASE event_id % 100 WHEN 3 THEN [']x['] WHEN 7 THEN ['none'] ELSE [] END || [regexp_extract(props, '(-?[0-9]+)', 1)] END) AS t FROM events)""",
    ),
)
def telemetry_text(spark, d):
    return telemetry.flatten_telemetry(bind(spark, d, "telemetry"), "event_id", "telemetry")


@query(
    "run_records",
    oracle(
        "",
        """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS query, CASE WHEN event_id % 9 <> 0 THEN 'SINGLE_IMAGE_VQA' END AS task,
  CASE WHEN event_id % 9 <> 0 THEN 2 END AS nodes, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS corrupt FROM events""",
    ),
)
def run_records(spark, d):
    body = F.concat(
        F.lit('{"query":"'), F.col("event_type"),
        F.lit('","answer":"x","agent_execution_trace":{"task":"SINGLE_IMAGE_VQA","nodes_traversed":["RuleBasedRouter","InputPreprocessor"],"telemetry":{"k":1},"warnings":[]},"chat_history":[{"role":"user","content":"hi"}],"scan":null}'),
    )
    text = F.when(F.col("event_id") % 9 == 0, F.lit('{"query": "broken')).otherwise(body)
    parsed = records.parse_run_records(table(spark, d, "events").select("event_id", text.alias("text")), "text")
    trace = F.col("agent_execution_trace")
    return parsed.select(
        "event_id",
        F.when(F.col("_corrupt_record").isNull(), F.col("query")).alias("query"),
        trace["task"].alias("task"),
        F.when(trace["nodes_traversed"].isNotNull(), F.size(trace["nodes_traversed"])).alias("nodes"),
        F.col("_corrupt_record").isNotNull().cast("int").alias("corrupt"),
    )


EXPECTED_COORDINATES = """SELECT k, CASE WHEN r IS NULL THEN round(lat, 6) END AS lat, CASE WHEN r IS NULL THEN round(lng, 6) END AS lng, r AS reason FROM (
SELECT k, lat, lng, coalesce(early, CASE WHEN c = 4 AND mi >= 60 THEN 'minutes' WHEN c = 5 AND si >= 60 THEN 'seconds' WHEN abs(lat) > 90 THEN 'latitude range' WHEN abs(lng) > 180 THEN 'longitude range' END) AS r FROM (
SELECT *, CASE WHEN k % 50 = 49 THEN 'empty' WHEN k % 50 = 48 THEN 'no numbers' WHEN c = 8 THEN 'characters' WHEN c = 9 THEN 'separator' WHEN c = 10 THEN 'same axis' WHEN c = 11 THEN 'one letter' END AS early,
  CASE c WHEN 0 THEN ai + 0.5 WHEN 1 THEN ai + 0.5 WHEN 2 THEN ai + 0.5 WHEN 3 THEN -(ai + 0.5) WHEN 4 THEN ai + mi / 60.0 WHEN 5 THEN ai + si / 3600.0 WHEN 6 THEN -ai ELSE ai END AS lat,
  CASE c WHEN 0 THEN bi + 0.25 WHEN 1 THEN bi + 0.25 WHEN 2 THEN bi + 0.25 WHEN 3 THEN -bi WHEN 4 THEN -(bi + mi / 60.0) ELSE bi END AS lng FROM (SELECT *, k % 12 AS c FROM coordinates)))"""


@query("clean_coordinates", oracle("coordinates", EXPECTED_COORDINATES))
def clean_coordinates(spark, d):
    cleaned = places.clean_coordinates(bind(spark, d, "coordinates").select("k", "typed"), "typed")
    return cleaned.select("k", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "reason")


@query(
    "coordinate_rejects",
    oracle("coordinates", f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ({EXPECTED_COORDINATES}) GROUP BY 1"),
)
def coordinate_rejects(spark, d):
    cleaned = places.clean_coordinates(bind(spark, d, "coordinates").select("k", "typed"), "typed")
    return cleaned.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolution_units",
    oracle("units", "SELECT k, CASE k % 6 WHEN 0 THEN 'degree' WHEN 1 THEN 'metre' WHEN 2 THEN 'metre' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' END AS unit FROM units"),
)
def resolution_units(spark, d):
    return bind(spark, d, "units").select("k", places.resolution_unit(F.col("crs")).alias("unit"))
