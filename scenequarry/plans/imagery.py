"""Feature scans, capture dates, release catalogues and overlap joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import dates, places
from scenequarry.functions.places import SAME_AREA_MIN
from scenequarry.operators import scan, spatial
from scenequarry.plans.bindings import bind, oracle
from scenequarry.plans.registry import Register
from scenequarry.sources import releases

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

T = 0.6


def cells(spark, d, role="before"):
    return bind(spark, d, "scan_cells").where(F.col("date_role") == role)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ------------------------------------------------------------------ scans

PLACE = """CASE WHEN {r} = 1 AND {c} = 1 THEN 'centre' WHEN {r} = 1 THEN ['left', 'centre', 'right'][{c} + 1]
  ELSE ['upper', 'middle', 'lower'][{r} + 1] || '-' || ['left', 'centre', 'right'][{c} + 1] END"""
LABELS = f"""hot AS (SELECT scan_id, adapter, grid_row AS r, grid_col AS c, p FROM scan_cells WHERE date_role = 'before' AND p >= {T}),
reach(scan_id, r, c, r2, c2) AS (SELECT scan_id, r, c, r, c FROM hot UNION
  SELECT a.scan_id, a.r, a.c, h.r, h.c FROM reach a JOIN hot h ON h.scan_id = a.scan_id AND abs(h.r - a.r2) + abs(h.c - a.c2) = 1),
lab AS (SELECT scan_id, r2 AS r, c2 AS c, min(r * 4 + c) AS g FROM reach GROUP BY 1, 2, 3)"""
FINDINGS = f"""{LABELS},
grp AS (SELECT h.scan_id, h.adapter, l.g, min(h.r) AS r0, max(h.r) AS r1, min(h.c) AS c0, max(h.c) AS c1, avg(h.r) AS ar, avg(h.c) AS ac, count(*) AS n, avg(p) AS m, max(p) AS pk,
  string_agg(h.r || ':' || h.c, ' ' ORDER BY h.r, h.c) AS tiles FROM hot h JOIN lab l ON l.scan_id = h.scan_id AND l.r = h.r AND l.c = h.c GROUP BY 1, 2, 3),
found AS (SELECT scan_id, adapter, g, n AS n_tiles, tiles, r0 / 4 AS ymin, c0 / 4 AS xmin, (r1 + 1) / 4 AS ymax, (c1 + 1) / 4 AS xmax, ar, ac,
  least(2, floor(3 * (ar + 0.5) / 4))::INT AS pr, least(2, floor(3 * (ac + 0.5) / 4))::INT AS pc,
  round_even(100.0 * n / 16, 0)::INT AS coverage_pct, round_even(100 * m, 0)::INT AS confidence, round_even(100 * pk, 0)::INT AS peak,
  CASE WHEN pk >= 0.9 THEN 'High confidence' WHEN pk >= 0.75 THEN 'Likely' ELSE 'Possible' END AS label,
  row_number() OVER (PARTITION BY scan_id ORDER BY r0, c0, g) AS finding_no FROM grp)"""


@query(
    "tile_groups",
    oracle("scan_cells", f"WITH RECURSIVE {LABELS} SELECT h.scan_id, h.adapter, h.r AS grid_row, h.c AS grid_col, l.g AS group_id FROM hot h JOIN lab l ON l.scan_id = h.scan_id AND l.r = h.r AND l.c = h.c"),
)
def tile_groups(spark, d):
    return scan.group_tiles(cells(spark, d), T).drop("p")


@query(
    "scan_findings",
    oracle(
        "scan_cells",
        f"WITH RECURSIVE {FINDINGS} SELECT scan_id, adapter, finding_no, n_tiles, tiles, ymin, xmin, ymax, xmax, {PLACE.format(r='pr', c='pc')} AS place, coverage_pct, confidence, peak, label FROM found",
    ),
)
def scan_findings(spark, d):
    found = scan.findings(cells(spark, d), T)
    tiles = F.array_join(F.transform("tiles", lambda t: F.concat_ws(":", t["grid_row"].cast("string"), t["grid_col"].cast("string"))), " ")
    return found.withColumn("tiles", tiles)


@query("scan_tile_boxes", oracle("scan_cells", f"WITH RECURSIVE {FINDINGS} SELECT scan_id, adapter, finding_no, ymin, xmin, ymax, xmax FROM found"))
def scan_tile_boxes(spark, d):
    return scan.tile_boxes(cells(spark, d), T)


@query(
    "scan_pins",
    oracle(
        "scan_cells",
        f"""WITH RECURSIVE {FINDINGS} SELECT scan_id, adapter, finding_no, (c + 0.5) / 4 AS x, (r + 0.5) / 4 AS y FROM (SELECT f.scan_id, f.adapter, f.finding_no, h.r, h.c,
  row_number() OVER (PARTITION BY f.scan_id, f.finding_no ORDER BY (h.r - ar) ** 2 + (h.c - ac) ** 2, h.r, h.c) AS rn
  FROM found f JOIN lab l ON l.scan_id = f.scan_id AND l.g = f.g JOIN hot h ON h.scan_id = l.scan_id AND h.r = l.r AND h.c = l.c) WHERE rn = 1""",
    ),
)
def scan_pins(spark, d):
    return scan.pin_tiles(scan.findings(cells(spark, d), T))


@query(
    "finding_lines",
    oracle(
        "scan_cells",
        f"WITH RECURSIVE {FINDINGS} SELECT scan_id, adapter, finding_no, finding_no || '. ' || label || ' - ' || {PLACE.format(r='pr', c='pc')} || ', ' || n_tiles || CASE WHEN n_tiles = 1 THEN ' tile' ELSE ' tiles' END || "
        "' (about ' || coverage_pct || '% of the view), average score ' || confidence || '%' AS line FROM found",
    ),
)
def finding_lines(spark, d):
    return scan.finding_lines(scan.findings(cells(spark, d), T))


SUMMARY = f"""{FINDINGS},
base AS (SELECT scan_id, adapter, count(*) AS size, count(*) FILTER (p >= 0.5) AS yes, count(*) FILTER (p >= 0.5 AND p < {T}) AS faint FROM scan_cells WHERE date_role = 'before' GROUP BY 1, 2),
s AS (SELECT b.*, f.areas, f.covered, f.best, CASE b.adapter WHEN 'mining' THEN 'surface mining activity' WHEN 'deforestation' THEN 'forest clearing' WHEN 'agriculture' THEN 'cultivated land' ELSE 'the target feature' END AS subject
  FROM base b LEFT JOIN (SELECT scan_id, count(*) AS areas, sum(n_tiles) AS covered, max(peak) AS best FROM found GROUP BY scan_id) f ON f.scan_id = b.scan_id),
lv AS (SELECT *, round_even(100.0 * coalesce(covered, 0) / size, 0)::INT AS coverage_pct, CASE WHEN best IS NULL THEN 'none' WHEN best / 100 >= 0.9 THEN 'high' WHEN best / 100 >= 0.75 THEN 'likely' ELSE 'possible' END AS level FROM s),
summary AS (SELECT scan_id, adapter, subject, level, coalesce(areas, 0) AS areas, coverage_pct, faint AS faint_areas, CASE level
  WHEN 'high' THEN upper(substr(subject, 1, 1)) || substr(subject, 2) || ' found in ' || areas || CASE WHEN areas = 1 THEN ' area' ELSE ' areas' END || ' (high confidence)'
  WHEN 'likely' THEN 'Likely ' || subject || ' in ' || areas || CASE WHEN areas = 1 THEN ' area' ELSE ' areas' END
  WHEN 'possible' THEN 'Possible ' || subject || ' in ' || areas || CASE WHEN areas = 1 THEN ' area' ELSE ' areas' END
  ELSE 'No confident ' || subject || ' found.' || CASE WHEN faint > 0 THEN ' ' || faint || CASE WHEN faint = 1 THEN ' faint area scored above chance and is' ELSE ' faint areas scored above chance and are' END || ' tinted lightly.' ELSE '' END END
  || CASE WHEN level = 'none' THEN '' ELSE ', covering about ' || coverage_pct || '% of the view.' END AS headline,
  CASE WHEN yes / size >= 0.5 THEN 'The scan answered yes for ' || yes || ' of ' || size || ' areas, which is more than one feature usually covers, so it may be over-reporting. Treat the highlights as a starting point and check them by eye.' ELSE '' END AS note FROM lv)"""


@query("scan_summaries", oracle("scan_cells", f"WITH RECURSIVE {SUMMARY} SELECT * FROM summary"))
def scan_summaries(spark, d):
    return scan.scan_summary(cells(spark, d), T).drop("grid")


@query("scan_answers", oracle("scan_cells", f"WITH RECURSIVE {SUMMARY} SELECT scan_id, adapter, trim(headline || ' ' || note) AS answer FROM summary"))
def scan_answers(spark, d):
    return scan.scan_answers(scan.scan_summary(cells(spark, d), T))


@query(
    "tile_windows",
    oracle(
        "shapes",
        """WITH c AS (SELECT scene_id, width, height, gr.r, gc.c, floor(c * width / 3)::INT AS x0, floor((c + 1) * width / 3)::INT AS x1, floor(r * height / 2)::INT AS y0, floor((r + 1) * height / 2)::INT AS y1 FROM shapes, range(2) gr(r), range(3) gc(c))
SELECT scene_id, r AS grid_row, c AS grid_col, greatest(0, x0 - round_even((x1 - x0) * 0.25, 0))::INT AS "left", greatest(0, y0 - round_even((y1 - y0) * 0.25, 0))::INT AS top,
  least(width, x1 + round_even((x1 - x0) * 0.25, 0))::INT AS "right", least(height, y1 + round_even((y1 - y0) * 0.25, 0))::INT AS bottom FROM c""",
    ),
)
def tile_windows(spark, d):
    return scan.tile_windows(bind(spark, d, "shapes"), 2, 3)


@query(
    "yes_probabilities",
    oracle("token_scores", "SELECT row_id, round(sum(exp(logit)) FILTER (token < 2) / sum(exp(logit)) FILTER (token < 4), 6) AS p_yes FROM token_scores GROUP BY row_id"),
)
def yes_probabilities(spark, d):
    classes = spark.createDataFrame([(0, "yes"), (1, "yes"), (2, "no"), (3, "no")], "token int, answer string")
    return scan.yes_probability(bind(spark, d, "token_scores"), classes).select("row_id", *r6("p_yes"))


@query(
    "token_probabilities",
    oracle(
        "step_scores chosen_tokens",
        "WITH t AS (SELECT gen_id, step, sum(exp(logit)) AS z FROM step_scores GROUP BY 1, 2) SELECT c.gen_id, round(avg(exp(s.logit) / t.z), 6) AS probability FROM chosen_tokens c "
        "JOIN step_scores s ON s.gen_id = c.gen_id AND s.step = c.step AND s.token = c.token JOIN t ON t.gen_id = c.gen_id AND t.step = c.step GROUP BY c.gen_id",
    ),
)
def token_probabilities(spark, d):
    out = scan.mean_token_probability(bind(spark, d, "step_scores"), bind(spark, d, "chosen_tokens"))
    return out.select("gen_id", *r6("probability"))


COMPARED = """m AS (SELECT scan_id, adapter, grid_row AS r, grid_col AS c, max(p) FILTER (date_role = 'before') AS b, max(p) FILTER (date_role = 'after') AS a FROM scan_cells GROUP BY 1, 2, 3, 4),
f AS (SELECT *, b < 0.5 AND a >= 0.5 AND a - b >= 0.4 AS gained, b >= 0.5 AND a < 0.5 AND b - a >= 0.4 AS lost,
  least(2, floor(3 * (r + 0.5) / 4))::INT AS pr, least(2, floor(3 * (c + 0.5) / 4))::INT AS pc FROM m),
w AS (SELECT *, {place} || ' (row ' || (r + 1) || ', col ' || (c + 1) || ')' AS word FROM f),
cmp AS (SELECT scan_id, adapter, count(*) AS total, count(*) FILTER (b >= 0.5) AS positive_before, count(*) FILTER (a >= 0.5) AS positive_after,
  count(*) FILTER (b < 0.5 AND a >= 0.5) AS crossed_up, count(*) FILTER (b >= 0.5 AND a < 0.5) AS crossed_down, count(*) FILTER (gained) AS n_gained, count(*) FILTER (lost) AS n_lost,
  coalesce(string_agg(word, ', ' ORDER BY r, c) FILTER (gained), 'none') AS gained_text, coalesce(string_agg(word, ', ' ORDER BY r, c) FILTER (lost), 'none') AS lost_text,
  CASE WHEN greatest(count(*) FILTER (b >= 0.5), count(*) FILTER (a >= 0.5)) >= 0.5 * count(*) THEN 1 ELSE 0 END AS saturated,
  round(avg(b), 4) AS mean_before, round(avg(a), 4) AS mean_after FROM w GROUP BY 1, 2)""".replace("{place}", PLACE.format(r="pr", c="pc"))


def compared(spark, d):
    return scan.compare_scans(scan.match_dates(cells(spark, d, "before"), cells(spark, d, "after")))


@query(
    "scan_comparisons",
    oracle("scan_cells", f"WITH {COMPARED} SELECT scan_id, adapter, total, positive_before, positive_after, crossed_up, crossed_down, n_gained, n_lost, saturated FROM cmp"),
)
def scan_comparisons(spark, d):
    return compared(spark, d).select(
        "scan_id", "adapter", "total", "positive_before", "positive_after", "crossed_up", "crossed_down",
        F.size("gained").alias("n_gained"), F.size("lost").alias("n_lost"), F.col("saturated").cast("int").alias("saturated"),
    )


@query(
    "scan_change_lines",
    oracle(
        "scan_cells",
        f"""WITH {COMPARED} SELECT scan_id, adapter, CASE adapter WHEN 'mining' THEN 'mining / extraction pits' WHEN 'deforestation' THEN 'cleared or logged land' WHEN 'agriculture' THEN 'cultivated fields' ELSE adapter END
  || ': ' || positive_before || ' of ' || total || ' tiles positive before, ' || positive_after || ' after. Clearly newly positive (score up by 0.4 or more): ' || gained_text || '. Clearly dropped: ' || lost_text || '.'
  || CASE WHEN crossed_up > n_gained THEN ' ' || (crossed_up - n_gained) || ' more tile(s) crossed to positive by a smaller margin.' ELSE '' END
  || CASE WHEN crossed_down > n_lost THEN ' ' || (crossed_down - n_lost) || ' more tile(s) crossed to negative by a smaller margin.' ELSE '' END
  || CASE WHEN saturated = 1 THEN ' Already positive on many tiles, so this scan separates the dates poorly.' ELSE '' END AS line FROM cmp""",
    ),
)
def scan_change_lines(spark, d):
    return scan.scan_change_lines(compared(spark, d))


@query(
    "scan_shape_errors",
    oracle(
        "scan_cells",
        "SELECT scan_id, adapter, 'scan grids must have the same shape' AS error FROM scan_cells WHERE date_role = 'after' AND grid_row = 3 AND scan_id % 3 = 0 GROUP BY 1, 2",
    ),
)
def scan_shape_errors(spark, d):
    after = cells(spark, d, "after").where("NOT (grid_row = 3 AND scan_id % 3 = 0)")
    return scan.compare_scans(scan.match_dates(cells(spark, d, "before"), after)).where("error IS NOT NULL").select("scan_id", "adapter", "error")


# ------------------------------------------------------------------ dates

YEAR = 2026


@query(
    "parsed_dates",
    oracle(
        "date_texts",
        "SELECT k, CASE k % 9 WHEN 0 THEN iso || ' 05:11:21' WHEN 1 THEN iso || ' 05:11:21' WHEN 2 THEN iso || ' 00:00:00' WHEN 3 THEN iso || ' 00:00:00' END AS parsed, CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS has_time FROM date_texts",
    ),
)
def parsed_dates(spark, d):
    p = dates.parse_date(F.col("text"), YEAR)
    return bind(spark, d, "date_texts").select("k", F.date_format(p["when"], "yyyy-MM-dd HH:mm:ss").alias("parsed"), p["has_time"].cast("int").alias("has_time"))


@query(
    "filename_dates",
    oracle(
        "file_names",
        """SELECT file_id, CASE file_id % 8 WHEN 0 THEN iso || ' 05:11:21 UTC' WHEN 1 THEN iso || ' 05:11:21 UTC' WHEN 2 THEN iso || ' 12:50:34 UTC' WHEN 3 THEN iso END AS captured,
  CASE file_id % 8 WHEN 0 THEN 'filename (Sentinel-2 product ID)' WHEN 1 THEN 'filename (Sentinel-2 tile/band name)' WHEN 2 THEN 'filename (Sentinel-1 product ID)' WHEN 3 THEN 'filename (Landsat Collection 2 scene ID)' END AS source FROM file_names""",
    ),
)
def filename_dates(spark, d):
    found = bind(spark, d, "file_names").withColumn("a", dates.date_from_filename(F.col("file_name"), YEAR))
    return found.select("file_id", dates.capture_text(F.col("a")).alias("captured"), F.col("a.source").alias("source"))


@query(
    "merged_tags",
    oracle(
        "tag_rows",
        "WITH w AS (SELECT scene_id, upper(key) AS key, max_by(value, ns_order) AS value FROM tag_rows GROUP BY 1, 2) SELECT scene_id, string_agg(key || '=' || value, ';' ORDER BY key) AS tags FROM w GROUP BY scene_id",
    ),
)
def merged_tags(spark, d):
    merged = dates.merged_tags(bind(spark, d, "tag_rows"))
    pairs = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("scene_id", F.array_join(pairs, ";").alias("tags"))


TAGGED = """tagged AS (SELECT file_id, iso, CASE WHEN file_id % 15 = 0 THEN '2003-04-05' WHEN file_id % 5 = 0 THEN iso || ' 10:20:30 UTC' WHEN file_id % 5 = 2 THEN iso END AS t_date,
  CASE WHEN file_id % 5 = 0 THEN 'raster tag SENSING_TIME' WHEN file_id % 5 = 2 THEN 'raster tag DATE_ACQUIRED' END AS t_source,
  CASE file_id % 8 WHEN 0 THEN iso || ' 05:11:21 UTC' WHEN 1 THEN iso || ' 05:11:21 UTC' WHEN 2 THEN iso || ' 12:50:34 UTC' WHEN 3 THEN iso END AS n_date,
  CASE file_id % 8 WHEN 0 THEN 'filename (Sentinel-2 product ID)' WHEN 1 THEN 'filename (Sentinel-2 tile/band name)' WHEN 2 THEN 'filename (Sentinel-1 product ID)' WHEN 3 THEN 'filename (Landsat Collection 2 scene ID)' END AS n_source FROM file_names),
dated AS (SELECT file_id, coalesce(t_date, n_date, CASE WHEN file_id % 5 = 1 THEN '2001-02-03 04:05:06 UTC' END) AS captured,
  coalesce(t_source, n_source, CASE WHEN file_id % 5 = 1 THEN 'raster tag TIFFTAG_DATETIME (file creation time, not necessarily capture)' END) AS source,
  CASE WHEN coalesce(t_date, n_date) IS NOT NULL THEN 1 WHEN file_id % 5 = 1 THEN 0 END AS trusted FROM tagged)"""


def dated_files(spark, d):
    tags = dates.merged_tags(bind(spark, d, "tag_rows")).withColumnRenamed("scene_id", "file_id")
    return dates.attach_capture_dates(bind(spark, d, "file_names").join(tags, "file_id", "left"), YEAR)


@query("capture_dates", oracle("file_names", f"WITH {TAGGED} SELECT file_id, captured, source, trusted FROM dated"))
def capture_dates(spark, d):
    a = F.col("acquired")
    return dated_files(spark, d).select("file_id", dates.capture_text(a).alias("captured"), a["source"].alias("source"), a["trusted"].cast("int").alias("trusted"))


@query(
    "dates_by_source",
    oracle("file_names", f"WITH {TAGGED} SELECT coalesce(source, 'none') AS source, coalesce(trusted, 0) AS trusted, count(*) AS files FROM dated GROUP BY 1, 2"),
)
def dates_by_source(spark, d):
    return dates.dates_by_source(dated_files(spark, d)).withColumn("trusted", F.col("trusted").cast("int"))


@query(
    "pair_order",
    oracle(
        "file_names",
        f"""WITH {TAGGED}, w AS (SELECT *, CASE WHEN length(captured) = 10 THEN captured || ' 00:00:00 UTC' ELSE captured END AS at_text FROM dated),
p AS (SELECT floor(a.file_id / 2)::BIGINT AS pair_id, a.captured AS ca, b.captured AS cb, a.at_text AS wa, b.at_text AS wb, a.trusted = 1 AND b.trusted = 1 AS tr FROM w a JOIN w b ON b.file_id = a.file_id + 1 WHERE a.file_id % 2 = 0)
SELECT pair_id, CASE WHEN tr AND wa > wb THEN 1 ELSE 0 END AS swapped, CASE WHEN tr AND wa <> wb THEN 'metadata' ELSE 'as-uploaded' END AS basis, CASE WHEN tr THEN CASE WHEN wa > wb THEN cb ELSE ca END END AS before,
  CASE WHEN tr THEN CASE WHEN wa > wb THEN ca ELSE cb END END AS after, CASE WHEN tr AND wa = wb THEN 'same' WHEN NOT coalesce(tr, false) AND wa > wb THEN 'unreliable' ELSE '' END AS warning FROM p""",
    ),
)
def pair_order(spark, d):
    files = dated_files(spark, d).select("file_id", "acquired")
    pair = F.floor(F.col("file_id") / 2).alias("pair_id")
    a = files.where("file_id % 2 = 0").select(pair, F.col("acquired").alias("a"))
    b = files.where("file_id % 2 = 1").select(pair, F.col("acquired").alias("b"))
    ordered = dates.order_pairs(a.join(b, "pair_id"))
    warning = F.when(F.array_contains("warnings", dates.SAME_DATE_WARNING), "same").when(F.size("warnings") > 0, "unreliable").otherwise("")
    return ordered.select(
        "pair_id", F.col("swap").cast("int").alias("swapped"), "basis",
        dates.capture_text(F.col("before")).alias("before"), dates.capture_text(F.col("after")).alias("after"), warning.alias("warning"),
    )


@query(
    "time_ranges",
    oracle(
        "ranges",
        """SELECT k, CASE k % 8 WHEN 0 THEN iso || 'T00:00:00Z' WHEN 1 THEN iso || 'T00:00:00Z' END AS starts, CASE k % 8 WHEN 0 THEN iso || 'T23:59:59Z' WHEN 1 THEN '2002-01-01T23:59:59Z' END AS ends,
  CASE k % 8 WHEN 2 THEN 'reversed' WHEN 3 THEN 'no such day' WHEN 5 THEN 'shape' WHEN 6 THEN 'shape' WHEN 7 THEN 'no such day' END AS reason FROM ranges""",
    ),
)
def time_ranges(spark, d):
    start, end, reason = dates.time_range(F.col("text"))
    return bind(spark, d, "ranges").select("k", start.alias("starts"), end.alias("ends"), reason.alias("reason"))


# ------------------------------------------------------------------ releases

RELEASES = """rel AS (SELECT day AS date, max_by(id, CAST(id AS BIGINT)) AS id FROM release_rows WHERE CAST(id AS BIGINT) % 11 <> 0 AND CAST(id AS BIGINT) % 7 <> 0 GROUP BY day)"""


def catalog(spark, d):
    entry = F.struct(F.col("id"), F.struct(F.col("title").alias("itemTitle"), F.col("url").alias("itemURL")))
    configs = bind(spark, d, "release_rows").groupBy("catalog").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("config"))
    return releases.one_per_date(releases.parse_catalogs(configs, "config"))


@query("release_catalog", oracle("release_rows", f"WITH {RELEASES} SELECT date, id, 'https://x/tile/' || id || '/{{z}}/{{y}}/{{x}}' AS template FROM rel"))
def release_catalog(spark, d):
    return catalog(spark, d)


@query(
    "nearest_releases",
    oracle(
        "release_rows ship_days",
        f"""WITH {RELEASES}, days AS (SELECT DISTINCT day FROM ship_days),
near AS (SELECT day, date FROM (SELECT day, date, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', CAST(day AS DATE), CAST(date AS DATE))), date) AS rn FROM days, rel) WHERE rn = 1)
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.day, n.date AS release_date FROM ship_days s JOIN near n ON n.day = s.day""",
    ),
)
def nearest_releases(spark, d):
    return releases.nearest_releases(bind(spark, d, "ship_days"), catalog(spark, d), "day")


@query(
    "release_year_ticks",
    oracle(
        "release_rows",
        f"""WITH {RELEASES}, n AS (SELECT substr(date, 1, 4) AS year, row_number() OVER (ORDER BY date) - 1 AS i FROM rel), y AS (SELECT year, min(i) AS index FROM n GROUP BY year),
o AS (SELECT *, row_number() OVER (ORDER BY year) - 1 AS k, count(*) OVER () AS n FROM y)
SELECT year, index FROM o WHERE n <= 6 OR k IN (SELECT floor(j * ((SELECT count(*) FROM y) - 1) / 5 + 0.5) FROM range(6) t(j))""",
    ),
)
def release_year_ticks(spark, d):
    return releases.year_ticks(catalog(spark, d))


# ------------------------------------------------------------------ overlap


@query(
    "scans_on_regions",
    oracle(
        "boxes gained_tiles",
        """WITH h AS (SELECT DISTINCT b.region_no, g.scan, g.scan_order FROM boxes b JOIN gained_tiles g ON g.pair_id = b.pair_id
  WHERE greatest(0, least(b.x + b.w, (g.grid_col + 1) * 100) - greatest(b.x, g.grid_col * 100)) * greatest(0, least(b.y + b.h, (g.grid_row + 1) * 100) - greatest(b.y, g.grid_row * 100)) >= 1500)
SELECT b.region_no, b.pair_id, coalesce((SELECT string_agg(scan, ',' ORDER BY scan_order) FROM h WHERE h.region_no = b.region_no), '') AS scans FROM boxes b""",
    ),
)
def scans_on_regions(spark, d):
    matched = spatial.match_scans_to_regions(bind(spark, d, "boxes"), bind(spark, d, "gained_tiles"))
    return matched.select("region_no", "pair_id", F.array_join("scans", ",").alias("scans"))


@query(
    "subtle_outside_major",
    oracle(
        "boxes",
        """SELECT region_no, pair_id FROM boxes s WHERE region_no % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM boxes m WHERE m.region_no % 3 = 0 AND m.pair_id = s.pair_id
  AND s.x + s.w / 2 BETWEEN m.x AND m.x + m.w AND s.y + s.h / 2 BETWEEN m.y AND m.y + m.h)""",
    ),
)
def subtle_outside_major(spark, d):
    boxes = bind(spark, d, "boxes")
    return spatial.outside_major(boxes.where("region_no % 3 <> 0"), boxes.where("region_no % 3 = 0")).select("region_no", "pair_id")


@query(
    "footprint_coverage",
    oracle(
        "footprints",
        """WITH s AS (SELECT *, a_width AS w, a_height AS h FROM footprints),
c AS (SELECT *, len(list_filter(range(w), lambda i: (i + 0.5) * a_right / w >= b_left AND (i + 0.5) * a_right / w < b_right)) AS nx, len(list_filter(range(h), lambda j: (j + 0.5) * a_top / h >= b_bottom AND (j + 0.5) * a_top / h < b_top)) AS ny FROM s)
SELECT pair_id, round(nx * ny / (w * h) + 1e-9, 6) AS coverage, CASE WHEN nx * ny / (w * h) < 0.5 THEN 1 ELSE 0 END AS rejected FROM c""",
    ),
)
def footprint_coverage(spark, d):
    out = spatial.footprint_coverage(bind(spark, d, "footprints"))
    return out.select("pair_id", F.round(F.col("coverage") + 1e-9, 6).alias("coverage"), F.col("rejected").cast("int").alias("rejected"))


@query(
    "covering_footprints",
    oracle(
        "footprint_grids footprint_boxes",
        """WITH p AS (SELECT a.id AS a_id, b.id AS b_id, a.width AS w, a.height AS h, (a.x1 - a.x0) / a.width AS sx, (a.y1 - a.y0) / a.height AS sy, a.x0 AS al, a.y0 AS ab, b.x0 AS bl, b.x1 AS br, b.y0 AS bb, b.y1 AS bt
FROM footprint_grids a JOIN footprint_boxes b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.x1 > a.x0 AND a.y1 > a.y0),
c AS (SELECT *, greatest(0, least(ceil((br - al) / sx - 0.5), w) - greatest(ceil((bl - al) / sx - 0.5), 0)) * greatest(0, least(ceil((bt - ab) / sy - 0.5), h) - greatest(ceil((bb - ab) / sy - 0.5), 0)) / (w * h) AS v FROM p)
SELECT a_id, b_id, round(v + 1e-9, 6) AS coverage, CASE WHEN v < 0.5 THEN 1 ELSE 0 END AS rejected FROM c""",
    ),
)
def covering_footprints(spark, d):
    out = spatial.covering_footprints(bind(spark, d, "footprint_grids"), bind(spark, d, "footprint_boxes"))
    return out.select("a_id", "b_id", F.round(F.col("coverage") + 1e-9, 6).alias("coverage"), F.col("rejected").cast("int").alias("rejected"))


@query(
    "same_area_captures",
    oracle(
        "scene_bounds",
        """WITH s AS (SELECT * FROM scene_bounds WHERE south IS NOT NULL AND north > south AND east > west),
p AS (SELECT x.id AS a, y.id AS b, greatest(0, least(x.north, y.north) - greatest(x.south, y.south)) * greatest(0, least(x.east, y.east) - greatest(x.west, y.west)) AS i,
  (x.north - x.south) * (x.east - x.west) + (y.north - y.south) * (y.east - y.west) AS t FROM s x JOIN s y ON x.id < y.id)
SELECT a, b, round(i / (t - i), 6) AS overlap FROM p WHERE i / (t - i) >= 0.85""",
    ),
)
def same_area_captures(spark, d):
    bounds = F.struct("south", "west", "north", "east").alias("bounds")
    out = spatial.same_area_pairs(bind(spark, d, "scene_bounds").select("id", bounds))
    return out.select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(
    "capture_overlap",
    oracle(
        "captures",
        """WITH b AS (SELECT *, greatest(0, least(n1, n2) - greatest(s1, s2)) * greatest(0, least(e1, e2) - greatest(w1, w2)) AS i FROM captures),
o AS (SELECT k, CASE WHEN s1 IS NOT NULL AND n1 > s1 THEN i / ((n1 - s1) * (e1 - w1) + (n2 - s2) * (e2 - w2) - i) END AS v FROM b)
SELECT k, round(v, 6) AS overlap, CASE WHEN v < 0.85 THEN 1 WHEN v IS NOT NULL THEN 0 END AS different_area FROM o""",
    ),
)
def capture_overlap(spark, d):
    box = lambda n: F.struct(*[F.col(f"{s}{n}").alias(name) for s, name in (("s", "south"), ("w", "west"), ("n", "north"), ("e", "east"))])
    out = bind(spark, d, "captures").withColumn("v", places.box_overlap(box(1), box(2)))
    return out.select("k", F.round("v", 6).alias("overlap"), (F.col("v") < SAME_AREA_MIN).cast("int").alias("different_area"))
