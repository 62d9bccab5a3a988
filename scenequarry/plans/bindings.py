"""Domain tables derived from the given parquet tables.

Each binding is one SELECT in the dialect both engines share, so the same text feeds a Spark query and its SQL
check. Fragments that differ between engines are named in braces and filled in per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FRAGMENTS = {
    "spark": {
        # vectors meet their image row whole and are spread afterwards
        "image_values": """(SELECT vec_id, i, x FROM (SELECT s.slot AS vec_id, e.kept FROM ({image_rows}) s
  LEFT JOIN (SELECT vec_id, collect_list(embedding) AS kept FROM embeddings GROUP BY vec_id) e ON e.vec_id = s.slot) t
  LATERAL VIEW explode((SELECT collect_set(i) FROM vectors)) c AS i
  LATERAL VIEW OUTER explode(transform(filter(kept, a -> size(a) > i), a -> CAST(a[i] AS DOUBLE))) l AS x) g""",
        "image_rows": "SELECT id AS slot FROM image_slots",
        "vectors": "SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS i, x",
        "epoch_ts": "unix_timestamp(ts)",
        "iso_orderdate": "date_format(o_orderdate, 'yyyy-MM-dd')",
        "compact_orderdate": "date_format(o_orderdate, 'yyyyMMdd')",
        "iso_shipdate": "date_format(l_shipdate, 'yyyy-MM-dd')",
    },
    "duckdb": {
        "image_rows": "SELECT unnest(range(0, (SELECT CAST(ceil(count(*) / 192.0) AS BIGINT) * 192 FROM embeddings))) AS slot",
        "image_values": "image_grid g LEFT JOIN vectors v ON v.vec_id = g.vec_id AND v.i = g.i",
        "vectors": "SELECT vec_id, label, CAST(r.i AS INTEGER) AS i, CAST(embedding[r.i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)",
        "epoch_ts": "CAST(floor(epoch(ts)) AS BIGINT)",
        "iso_orderdate": "strftime(o_orderdate, '%Y-%m-%d')",
        "compact_orderdate": "strftime(o_orderdate, '%Y%m%d')",
        "iso_shipdate": "strftime(l_shipdate, '%Y-%m-%d')",
    },
}

SQL: dict[str, str] = {}

# ---- benchmark annotations: questions from orders, answers from line items, images from customers ----
SQL["questions"] = """
SELECT o_orderkey AS id, o_custkey AS img_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'presence' WHEN 1 THEN 'count' WHEN 2 THEN 'change_ratio'
    WHEN 3 THEN 'land_cover' ELSE 'object' END AS type,
  CASE WHEN o_orderkey % 3 = 0 THEN ' What about area ' || CAST(o_orderkey AS STRING) || ' '
    ELSE 'Is area ' || CAST(o_orderkey AS STRING) || ' built up?' END AS question,
  CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderstatus = 'O' THEN true ELSE NULL END AS active
FROM orders"""
SQL["answers"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS question_id, l_linenumber AS list_pos,
  min(CASE l_orderkey % 5
    WHEN 0 THEN CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END
    WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS STRING)
    WHEN 2 THEN CASE WHEN l_discount < 0.015 THEN '0' WHEN l_discount < 0.035 THEN '0_to_10'
      WHEN l_discount < 0.055 THEN '10_to_20' WHEN l_discount < 0.075 THEN '20_to_30' ELSE '30_to_40' END
    WHEN 3 THEN CASE l_partkey % 4 WHEN 0 THEN 'NVG_surface' WHEN 1 THEN 'low_vegetation' WHEN 2 THEN 'trees' ELSE 'water' END
    ELSE 'The thing-' || CAST(l_partkey % 40 AS STRING) END) AS answer,
  max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) = 1 AS active
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
SQL["images"] = """
SELECT c_custkey AS id, c_name || '.png' AS file_name,
  CASE WHEN c_custkey % 10 = 0 THEN false WHEN c_acctbal < 0 THEN NULL ELSE true END AS active
FROM customer"""
SQL["items"] = """
SELECT CAST(q.id AS STRING) AS item_id, q.id AS pos, q.question, a.answer, q.type AS qtype,
  'Images_LR/' || CAST(i.id AS STRING) || '.tif' AS path, i.file_name
FROM questions q
JOIN (SELECT question_id, answer FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY list_pos) AS rn FROM answers WHERE coalesce(active, true)
  ) t WHERE rn = 1) a ON a.question_id = q.id
JOIN images i ON i.id = q.img_id
WHERE coalesce(q.active, true) AND coalesce(i.active, true)"""
# replies in several wordings; every seventeenth item failed
SQL["replies"] = """
SELECT q.id AS seq, CAST(q.id AS STRING) AS item_id,
  CASE WHEN q.id % 17 = 0 THEN NULL ELSE CASE q.id % 7
    WHEN 0 THEN 'Yes.' WHEN 1 THEN 'No, there is no water.' WHEN 2 THEN 'There are twelve.'
    WHEN 3 THEN 'It changed to low vegetation' WHEN 4 THEN '10-20%' WHEN 5 THEN 'I do not know'
    ELSE 'the Thing-' || CAST(q.id % 40 AS STRING) || '!' END END AS reply,
  CASE WHEN q.id % 17 = 0 OR q.id % 13 = 0 THEN NULL ELSE CAST((q.id * 37) % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN q.id % 17 = 0 THEN 'ValueError: unreadable' END AS error,
  CAST(q.id % 997 AS DOUBLE) / 128 AS latency_s
FROM questions q"""
# judged predictions over documents: one verdict per labelled document
SQL["verdicts"] = """
SELECT d.doc_id AS seq, CAST(d.doc_id AS STRING) AS item_id, d.lang AS qtype,
  CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS answer,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN l.toxic = 1 THEN 'No, it is not.' ELSE 'Yes.' END AS reply,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN d.doc_id % 17 = 0 THEN 'ValueError: unreadable' END AS error,
  CAST(d.n_chars AS DOUBLE) / 1000 AS latency_s
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
# token sequences: word lengths stand for token ids
SQL["vectors"] = "{vectors}"

DEPENDS = {
    "items": ("questions", "answers", "images"),
    "replies": ("questions",),
}


def _order(names: tuple[str, ...] | list[str], seen: list[str]) -> list[str]:
    for name in names:
        _order(DEPENDS.get(name, ()), seen)
        if name not in seen:
            seen.append(name)
    return seen


def ctes(*names: str, engine: str = "duckdb") -> str:
    """``a AS (...), b AS (...)`` for the named bindings and what they need."""
    parts = []
    for name in _order(list(names), []):
        text = SQL[name]
        for key, value in FRAGMENTS[engine].items():
            text = text.replace("{" + key + "}", value)
        parts.append(f"{name} AS ({text})")
    return ",\n".join(parts)


def oracle(names: str, body: str) -> str:
    """A DuckDB query: the bindings named in ``names``, then ``body`` (which may add CTEs before its SELECT)."""
    head = ctes(*names.split()) if names else ""
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        body = body.lstrip()[len("WITH RECURSIVE ") :]
        return f"WITH RECURSIVE {head},\n{body}" if head else f"WITH RECURSIVE {body}"
    if body.lstrip().upper().startswith("WITH "):
        body = body.lstrip()[5:]
        return f"WITH {head},\n{body}" if head else f"WITH {body}"
    return f"WITH {head}\n{body}" if head else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named binding over the tables in ``sf_dir``."""
    text = ctes(name, engine="spark")
    for base in TABLES:
        if re.search(rf"\b{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    if "image_slots" in text:           # whole scenes of 192 image rows
        scenes = -(-table(spark, sf_dir, "embeddings").count() // 192)
        spark.range(scenes * 192).createOrReplaceTempView("image_slots")
    return spark.sql(f"WITH {text}\nSELECT * FROM {name}")

# ---- conversations, runs and reports ----
SQL["asked"] = """
SELECT conv_id, turn, role, CASE (conv_id + turn) % 9 WHEN 0 THEN 'Is there ' || text WHEN 1 THEN 'How many ' || text
  WHEN 2 THEN 'Is it rural or urban? ' || text WHEN 3 THEN 'Can you ' || text WHEN 4 THEN 'Are they big or small ' || text
  WHEN 5 THEN 'Does ' || text || ' where' WHEN 6 THEN 'Count the ' || text WHEN 7 THEN '  ' ELSE text END AS question
FROM conversations"""
SQL["turns"] = """
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'ai' ELSE role END AS role,
  CASE WHEN turn % 5 = 3 THEN 'pair' END AS scope,
  CASE WHEN conv_id % 6 = 0 AND turn = 2 THEN '  [System] scan done' WHEN conv_id % 7 = 0 AND turn = 1 THEN '   '
    WHEN role = 'assistant' AND conv_id % 4 = 1 THEN 'Words before. ASSESSMENT: ' || text ELSE text END AS text
FROM conversations"""
SQL["prompts"] = """
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'another question' ELSE '  ' || max_by(text, turn) || ' ' END AS prompt
FROM conversations GROUP BY conv_id"""
SQL["openings"] = """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -1 - conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN ' Hello!! ' WHEN 1 THEN '?!' WHEN 2 THEN 'Tell me more...' ELSE 'water?' END FROM conversations"""
SQL["runs"] = """
SELECT CAST(event_id AS STRING) AS run_id, event_id, user_id AS workspace,
  CASE event_type WHEN 'view' THEN 'scan' WHEN 'purchase' THEN 'change' WHEN 'signup' THEN 'fusion' ELSE 'chat' END AS kind,
  {epoch_ts} AS ran_at FROM events"""
SQL["picks"] = "SELECT user_id AS workspace, CAST(min(event_id) + user_id % 3 AS STRING) AS run_id FROM events GROUP BY user_id"
SQL["slot_changes"] = """
SELECT user_id AS workspace, CASE event_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'before' WHEN 2 THEN 'after' WHEN 3 THEN 'optical'
  WHEN 4 THEN 'sar' ELSE 'a' END AS slot, {epoch_ts} - 86400 * 12 AS changed_at FROM events WHERE event_type = 'click'"""
SQL["report_log"] = """
SELECT user_id, 's' || CAST(event_id % 2000 AS STRING) AS session_id, repeat(props, 300) AS query, event_type AS task,
  CASE WHEN event_id % 4 = 0 THEN 'Title ' || CAST(event_id AS STRING) WHEN event_id % 4 = 1 THEN '' END AS title,
  CAST(event_id AS DOUBLE) AS created_at FROM events"""
SQL["reports"] = """
SELECT CAST(k % 150 AS BIGINT) AS user_id, 's' || CAST(k AS STRING) AS session_id, CAST(NULL AS STRING) AS title
FROM (SELECT DISTINCT event_id % 2500 AS k FROM events) t"""
SQL["renames"] = """
SELECT o_orderkey AS update_id, 's' || CAST(o_orderkey % 3000 AS STRING) AS session_id,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 3000) % 150 ELSE o_custkey % 150 END AS BIGINT) AS user_id,
  CASE o_orderkey % 5 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 201) ELSE ' Name ' || CAST(o_orderkey AS STRING) || ' ' END AS title
FROM orders"""
SQL["session_files"] = """
SELECT CASE WHEN user_id % 10 = 0 THEN 'scratch' || CAST(user_id AS STRING) ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' ||
  substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS session,
  'f' || CAST(event_id AS STRING) AS path, CAST({epoch_ts} AS DOUBLE) AS mtime
FROM (SELECT *, md5(CAST(user_id AS STRING)) AS h FROM events) t"""
SQL["telemetry"] = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"model":"base","k":7,"ok":true,"none":null,"props":' || props || '}'
  WHEN 1 THEN '{"list":[1,"a",false,null],"empty":[],"ok":false,"deep":[[[[[true,null],' || props || ']]]]}'
  WHEN 2 THEN '{"order":{"summary":"as uploaded","b":1},"raw":{"b":1},"props":' || props || '}'
  ELSE CASE event_id % 100 WHEN 3 THEN '{"deep":' || repeat('[', 120) || '"]x["' || repeat(']', 120) || ',' || substr(props, 2)
    WHEN 7 THEN '{"deep":' || repeat('[', 5000) || repeat(']', 5000) || ',' || substr(props, 2) ELSE props END END AS telemetry FROM events"""
SQL["coordinates"] = """
SELECT k, CASE WHEN k % 50 = 49 THEN '  ' WHEN k % 50 = 48 THEN 'N - E' ELSE CASE k % 12
  WHEN 0 THEN a || '.5, ' || b || '.25' WHEN 1 THEN a || '.5n ' || b || '.25E' WHEN 2 THEN b || '.25E ' || a || '.5N'
  WHEN 3 THEN 'S ' || a || '.5 W ' || b WHEN 4 THEN a || '°' || m || '′N ' || b || '°' || m || '′W'
  WHEN 5 THEN a || ' 0 ' || s || ' N ' || b || ' 0 0 E' WHEN 6 THEN '−' || a || ',' || b WHEN 7 THEN 'lat ' || a || ' lon ' || b
  WHEN 8 THEN 'abc ' || a WHEN 9 THEN a || ' ' || b || ' ' || a WHEN 10 THEN a || 'N ' || b || 'S' ELSE a || 'N ' || b END END AS typed,
  ai, bi, mi, si FROM (SELECT c_custkey AS k, c_custkey % 95 AS ai, c_custkey % 185 AS bi, c_custkey % 70 AS mi, c_custkey % 65 AS si,
  CAST(c_custkey % 95 AS STRING) AS a, CAST(c_custkey % 185 AS STRING) AS b, CAST(c_custkey % 70 AS STRING) AS m,
  CAST(c_custkey % 65 AS STRING) AS s FROM customer) t"""
SQL["captions"] = """
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'The image shows a satellite view of a landscape. Visible features include: 1. Land Cover: ' || text || ' There is no visible water.'
  WHEN 3 THEN text || ' No large dam is visible. 12. Fields ' ELSE text END AS text FROM documents
UNION ALL SELECT -1 - doc_id, CASE doc_id % 2 WHEN 0 THEN '1. Bare ground 2. Buildings, 3. Roads' ELSE 'There are no roads. Nothing visible here.' END FROM documents"""
SQL["units"] = """
SELECT n_nationkey AS k, CASE n_nationkey % 6 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'epsg:32643' WHEN 2 THEN 'EPSG:3857'
  WHEN 3 THEN 'EPSG:9999' WHEN 4 THEN 'EPSG:32661' END AS crs FROM nation"""

# ---- scans, dates and places ----
SQL["scan_cells"] = """
SELECT vec_id * 2 + CAST(floor(i / 32) AS BIGINT) AS scan_id, CASE label % 4 WHEN 0 THEN 'mining' WHEN 1 THEN 'deforestation' WHEN 2 THEN 'agriculture' ELSE 'roads' END AS adapter,
  CASE WHEN i % 32 < 16 THEN 'before' ELSE 'after' END AS date_role, CAST(floor((i % 16) / 4) AS INT) AS grid_row, CAST(i % 4 AS INT) AS grid_col,
  round(1 / (1 + exp(-16 * x)), 6) AS p
FROM vectors"""
SQL["token_scores"] = "SELECT vec_id AS row_id, CAST(i AS BIGINT) AS token, 10 * x AS logit FROM vectors"
SQL["step_scores"] = "SELECT CAST(floor(vec_id / 8) AS BIGINT) AS gen_id, vec_id % 8 AS step, CAST(i AS BIGINT) AS token, 10 * x AS logit FROM vectors"
SQL["chosen_tokens"] = "SELECT CAST(floor(vec_id / 8) AS BIGINT) AS gen_id, vec_id % 8 AS step, (vec_id * 7) % 64 AS token FROM embeddings"
SQL["shapes"] = "SELECT p_partkey AS scene_id, CAST(p_size * 37 + 53 AS INT) AS width, CAST(p_size * 21 + 41 AS INT) AS height FROM part"
SQL["file_names"] = """
SELECT o_orderkey AS file_id, {iso_orderdate} AS iso, CASE o_orderkey % 8 WHEN 0 THEN 'up/s2a_MSIL1C_' || d || 'T051121_N0510.tif' WHEN 1 THEN 'T43PGQ_' || d || 'T051121_B04_10m.tif'
  WHEN 2 THEN 'S1A_IW_GRDH_1SDV_' || d || 'T125034_20240110T125059.tif' WHEN 3 THEN 'LC08_L1TP_144051_' || d || '_20240120_02_T1.tif'
  WHEN 4 THEN 'photo_' || d || '.png' WHEN 5 THEN 'IMG_' || d || '_123456.jpg' WHEN 6 THEN 'S2A_MSIL2A_20241345T051121_X.tif'
  ELSE 'myS2A_MSIL2A_' || d || 'T051121_X.tif' END AS file_name FROM (SELECT *, {compact_orderdate} AS d FROM orders) t"""
SQL["tag_rows"] = """
SELECT o_orderkey AS scene_id, 0 AS ns_order, 'Sensing_Time' AS key, {iso_orderdate} || 'T10:20:30Z' AS value FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 1, 'SENSING_TIME', '2003-04-05' FROM orders WHERE o_orderkey % 15 = 0
UNION ALL SELECT o_orderkey, 0, 'TIFFTAG_DATETIME', '2001:02:03 04:05:06' FROM orders WHERE o_orderkey % 5 = 1
UNION ALL SELECT o_orderkey, 0, 'acquisitiondate', 'unknown' FROM orders WHERE o_orderkey % 5 = 2
UNION ALL SELECT o_orderkey, 0, 'DATE_ACQUIRED', {iso_orderdate} FROM orders WHERE o_orderkey % 5 = 2"""
SQL["date_texts"] = """
SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN {iso_orderdate} || 'T05:11:21Z' WHEN 1 THEN replace({iso_orderdate}, '-', ':') || ' 05:11:21'
  WHEN 2 THEN {compact_orderdate} WHEN 3 THEN {iso_orderdate} WHEN 4 THEN '' WHEN 5 THEN '2024-13-45' WHEN 6 THEN '1850-01-01'
  WHEN 7 THEN '2999-01-01' ELSE {iso_orderdate} || ' 25:00:00' END AS text, {iso_orderdate} AS iso FROM orders"""
SQL["ranges"] = """
SELECT o_orderkey AS k, {iso_orderdate} AS iso, CASE o_orderkey % 8 WHEN 0 THEN ' ' || {iso_orderdate} WHEN 1 THEN {iso_orderdate} || ' / 2002-01-01'
  WHEN 2 THEN {iso_orderdate} || '/1990-01-01' WHEN 3 THEN '2024-02-31' WHEN 4 THEN '' WHEN 5 THEN '2024-1-1'
  WHEN 6 THEN '2024-01-01/2024-01-02/2024-01-03' ELSE '2024-02-29/2025-02-29' END AS text FROM orders"""
SQL["release_rows"] = """
SELECT o_custkey AS catalog, CAST(o_orderkey AS STRING) AS id, {iso_orderdate} AS day,
  CASE WHEN o_orderkey % 11 = 0 THEN 'World Imagery' ELSE 'World Imagery (Wayback ' || {iso_orderdate} || ')' END AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN 'https://x/tile/{level}/{row}' ELSE 'https://x/tile/' || CAST(o_orderkey AS STRING) || '/{level}/{row}/{col}' END AS url
FROM orders"""
SQL["ship_days"] = "SELECT l_orderkey, l_linenumber, l_partkey, {iso_shipdate} AS day FROM lineitem"
SQL["boxes"] = """
SELECT p_partkey AS region_no, p_partkey % 200 AS pair_id, CAST(p_partkey * 7 % 300 AS INT) AS x, CAST(p_partkey * 13 % 300 AS INT) AS y,
  CAST(40 + p_size * 2 AS INT) AS w, CAST(30 + p_size AS INT) AS h, 400 AS width, 400 AS height FROM part"""
SQL["gained_tiles"] = """
SELECT c_custkey % 200 AS pair_id, CASE c_custkey % 3 WHEN 0 THEN 'mining' WHEN 1 THEN 'deforestation' ELSE 'agriculture' END AS scan,
  CAST(c_custkey % 3 AS INT) AS scan_order, CAST(c_custkey % 4 AS INT) AS grid_row, CAST(floor(c_custkey / 4) AS BIGINT) % 4 AS grid_col,
  4 AS n_rows, 4 AS n_cols FROM customer"""
SQL["footprints"] = """
SELECT o_orderkey AS pair_id, 0.0 AS a_left, 0.0 AS a_bottom, CAST(600 + o_custkey % 700 AS DOUBLE) AS a_right, CAST(500 + o_custkey % 300 AS DOUBLE) AS a_top,
  CAST(60 + o_custkey % 700 AS INT) AS a_width, CAST(50 + o_custkey % 300 AS INT) AS a_height,
  CAST(o_orderkey % 97 * 8 - 300 AS DOUBLE) + 0.37 AS b_left, CAST(o_orderkey % 89 * 6 - 200 AS DOUBLE) + 0.37 AS b_bottom,
  CAST(o_orderkey % 97 * 8 + 700 AS DOUBLE) + 0.37 AS b_right, CAST(o_orderkey % 89 * 6 + 500 AS DOUBLE) + 0.37 AS b_top FROM orders"""
SQL["footprint_grids"] = """
SELECT o_orderkey AS id, CAST(o_orderkey * 7919 % 100003 AS DOUBLE) AS x0, CAST(o_orderkey * 104729 % 100019 AS DOUBLE) - 50000 AS y0,
  CAST(o_orderkey * 7919 % 100003 + CASE WHEN o_orderkey % 50 = 0 THEN 9000 WHEN o_orderkey % 7 = 0 THEN 0 ELSE 40 + o_custkey % 900 END AS DOUBLE) AS x1,
  CASE WHEN o_orderkey % 77 = 1 THEN NULL ELSE CAST(o_orderkey * 104729 % 100019 + 30 + o_custkey % 700 AS DOUBLE) - 50000 END AS y1,
  CAST(60 + o_custkey % 700 AS INT) AS width, CAST(50 + o_custkey % 300 AS INT) AS height FROM orders"""
SQL["footprint_boxes"] = """
SELECT c_custkey AS id, CAST(c_custkey * 6151 % 99991 AS DOUBLE) + 0.37 AS x0, CAST(c_custkey * 49157 % 99989 AS DOUBLE) - 49999.63 AS y0,
  CAST(c_custkey * 6151 % 99991 + CASE WHEN c_custkey % 300 = 0 THEN 60000 ELSE 5 + c_custkey % 1300 END AS DOUBLE) + 0.37 AS x1,
  CAST(c_custkey * 49157 % 99989 + CASE WHEN c_custkey % 300 = 0 THEN 30000 ELSE 300 + c_custkey % 11 END AS DOUBLE) - 49999.63 AS y1 FROM customer"""
SQL["scene_bounds"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE w / 8 - 90 END AS south, w / 4 - 170 AS west, w / 8 - 90 + CASE WHEN c_custkey % 31 = 0 THEN -1 ELSE s END AS north,
  w / 4 - 170 + s + CAST(c_custkey % 5 AS DOUBLE) / 64 AS east
FROM (SELECT c_custkey, CAST(c_custkey % 3 + c_nationkey % 17 * 5 AS DOUBLE) AS w, CASE c_custkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 8.0 ELSE 7.5 END AS s FROM customer) t"""
SQL["captures"] = """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS s1, CAST(o_custkey % 60 AS DOUBLE) AS w1,
  CAST(o_custkey % 50 + 10 - o_orderkey % 12 AS DOUBLE) AS n1, CAST(o_custkey % 60 + 8 AS DOUBLE) AS e1,
  CAST(o_custkey % 50 + o_orderkey % 3 AS DOUBLE) AS s2, CAST(o_custkey % 60 + o_orderkey % 4 AS DOUBLE) AS w2,
  CAST(o_custkey % 50 + 11 AS DOUBLE) AS n2, CAST(o_custkey % 60 + 9 AS DOUBLE) AS e2 FROM orders"""
DEPENDS |= {"scan_cells": ("vectors",), "token_scores": ("vectors",), "step_scores": ("vectors",)}

# ---- pixels: 64x64 scenes of three bands, one vector per image row; odd scenes are the later date. The last scene
# is incomplete: its absent image rows are 0 and not valid ----
SQL["image_grid"] = """
SELECT slot AS vec_id, c.i FROM ({image_rows}) s CROSS JOIN (SELECT DISTINCT i FROM vectors) c"""
SQL["bands"] = """
SELECT CAST(floor(g.vec_id / 192) AS BIGINT) AS scene_id, CAST(floor((g.vec_id % 192) / 64) AS INT) + 1 AS band, CAST(g.vec_id % 64 AS INT) AS row, CAST(g.i AS INT) AS col,
  x IS NOT NULL AS present, CASE WHEN x IS NULL THEN 0.0 ELSE greatest(0.0, least(255.0, round(128 + 400 * x) - CASE WHEN floor(g.vec_id / 192) % 2 = 1 AND g.vec_id % 64 BETWEEN 16 AND 47 AND g.i BETWEEN 16 AND 47 THEN 90 ELSE 0 END
  + CASE WHEN floor(g.vec_id / 192) % 2 = 0 AND g.vec_id % 64 BETWEEN 48 AND 60 AND g.i BETWEEN 48 AND 60 THEN 140 ELSE 0 END)) END AS value
FROM {image_values}"""
SQL["pixels"] = """
SELECT scene_id, row, col, max(CASE WHEN band = 1 THEN value END) AS r, max(CASE WHEN band = 2 THEN value END) AS g,
  max(CASE WHEN band = 3 THEN value END) AS b, (scene_id % 2 = 0 OR col >= 2) AND min(CASE WHEN present THEN 1 ELSE 0 END) = 1 AS valid, 64 AS height, 64 AS width,
  CASE WHEN floor(scene_id / 2) % 4 = 3 THEN 'sar' ELSE 'optical' END AS modality
FROM bands GROUP BY scene_id, row, col"""
SQL["scene_pairs"] = """
SELECT CAST(floor(scene_id / 2) AS BIGINT) AS pair_id, min(scene_id) AS scene_a, max(scene_id) AS scene_b,
  CASE WHEN floor(scene_id / 2) % 4 = 3 THEN 'sar' ELSE 'optical' END AS modality
FROM bands GROUP BY floor(scene_id / 2) HAVING min(scene_id) < max(scene_id)"""
SQL["pair_regions"] = """
SELECT pair_id, 1 AS region_no, 10 AS x, 12 AS y, 30 AS w, 25 AS h FROM scene_pairs UNION ALL
SELECT pair_id, 2, 0, 0, 12, 9, FROM scene_pairs UNION ALL SELECT pair_id, 3, 16, 16, 32, 32 FROM scene_pairs"""
SQL["pair_regions"] = SQL["pair_regions"].replace("9, FROM", "9 FROM")
# radar values: even scenes linear power, odd scenes decibels; the left border is empty
SQL["radar_bands"] = """
SELECT scene_id, band, row, col, CASE WHEN scene_id % 2 = 0 THEN value / 50 + 0.02 ELSE (value - 128) / 10 END AS value,
  (col >= 2 AND present) AS valid, 64 AS height, 64 AS width FROM bands"""
SQL["band_meta"] = " UNION ALL ".join(
    f"""SELECT p_partkey AS scene_id, {b} AS band,
  CASE WHEN p_partkey % 5 = 0 THEN CASE ({b} + p_partkey) % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' ELSE 'gray' END ELSE 'undefined' END AS colorinterp,
  CASE WHEN p_partkey % 5 IN (1, 2) THEN CASE ({b} * 3 + p_partkey) % 5 WHEN 0 THEN ' B04' WHEN 1 THEN 'green' WHEN 2 THEN 'Blue' WHEN 3 THEN 'b08' ELSE 'red' END END AS description
FROM part WHERE {b} <= 1 + p_partkey % 7"""
    for b in range(1, 5)
)
SQL["transforms"] = """
SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1 + (o_orderkey % 9 - 4) * 0.05 END AS m00, (o_orderkey % 7 - 3) * 0.08 AS m10,
  CAST(o_custkey % 200 - 100 AS DOUBLE) AS m02, CAST(o_custkey % 90 - 45 AS DOUBLE) AS m12, CAST(o_orderkey % 40 AS INT) AS inliers, 300 AS height, 300 AS width FROM orders"""
SQL["matches"] = "SELECT l_suppkey AS pair_id, l_orderkey * 1000000 + l_linenumber * 10000 + l_partkey AS match_id, l_quantity + floor(l_extendedprice) / 100000 AS distance FROM lineitem"
DEPENDS |= {
    "image_grid": ("vectors",), "bands": ("image_grid",), "pixels": ("bands",), "scene_pairs": ("bands",), "pair_regions": ("scene_pairs",), "radar_bands": ("bands",),
}

# ---- logins: minutes of the event log stand for seconds, so that attempts fall close together ----
SQL["attempts"] = """
SELECT CAST(user_id % 10 AS STRING) AS account, CAST({epoch_ts} AS DOUBLE) / 60 AS t, event_type = 'signup' AS ok, event_id AS seq
FROM events WHERE event_type IN ('error', 'signup')"""
