"""Pixel work: bands, radiometry, measures, filters, masks, change, fusion and regridding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scenequarry.functions.colour import gray
from scenequarry.operators import change, fusion, masks, measures, radiometry, rasters, regrid, scan
from scenequarry.plans.bindings import bind, oracle, table
from scenequarry.plans.registry import Register
from scenequarry.session import cut_lineage

query = Register()
QUERIES, ORACLES = query.queries, query.oracles
SIDE = 64


def r4(*names):
    return [F.round(F.col(n) + 1e-9, 4).alias(n) for n in names]


def pixels(spark, d):
    return bind(spark, d, "pixels")


# ------------------------------------------------------------------ bands and validity


@query(
    "chosen_bands",
    oracle(
        "band_meta",
        """WITH m AS (SELECT *, CASE lower(trim(description)) WHEN 'b04' THEN 'red' WHEN 'red' THEN 'red' WHEN 'green' THEN 'green' WHEN 'b03' THEN 'green' WHEN 'blue' THEN 'blue' WHEN 'b02' THEN 'blue' END AS nm FROM band_meta),
g AS (SELECT scene_id, max(band) AS n, min(band) FILTER (colorinterp = 'red') AS dr, min(band) FILTER (colorinterp = 'green') AS dg, min(band) FILTER (colorinterp = 'blue') AS db,
  min(band) FILTER (nm = 'red') AS wr, min(band) FILTER (nm = 'green') AS wg, min(band) FILTER (nm = 'blue') AS wb FROM m GROUP BY scene_id)
SELECT scene_id, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '1,2' WHEN dr IS NOT NULL AND dg IS NOT NULL AND db IS NOT NULL THEN dr || ',' || dg || ',' || db
  WHEN wr IS NOT NULL AND wg IS NOT NULL AND wb IS NOT NULL THEN wr || ',' || wg || ',' || wb ELSE '1,2,3' END AS bands,
  CASE WHEN n > 2 AND NOT coalesce(dr > 0 AND dg > 0 AND db > 0, false) AND NOT coalesce(wr > 0 AND wg > 0 AND wb > 0, false) THEN 1 ELSE 0 END AS warned FROM g""",
    ),
)
def chosen_bands(spark, d):
    chosen = radiometry.choose_bands(bind(spark, d, "band_meta"))
    return chosen.select("scene_id", F.array_join("bands", ",").alias("bands"), F.col("warning").isNotNull().cast("int").alias("warned"))


def _raw(spark, d):
    bands = bind(spark, d, "bands")
    bands = bands.withColumn("value", F.when((F.col("row") == F.col("col")) & (F.col("band") == 1), F.lit(float("nan"))).otherwise(F.col("value")))
    choice = bands.select("scene_id").distinct().withColumn(
        "bands", F.when(F.col("scene_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("scene_id") % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(3), F.lit(2), F.lit(1)))
    )
    nodata = choice.select("scene_id", F.when(F.col("scene_id") % 2 == 1, 120.0).alias("nodata"), F.when(F.col("scene_id") % 3 == 0, 3).alias("alpha_band"))
    return bands, choice, nodata


@query(
    "standard_pixels",
    oracle(
        "bands",
        """WITH p AS (SELECT scene_id, row, col, max(value) FILTER (band = 1) AS v1, max(value) FILTER (band = 2) AS v2, max(value) FILTER (band = 3) AS v3 FROM bands GROUP BY 1, 2, 3),
q AS (SELECT *, scene_id % 3 AS k, row = col AS bad, CASE WHEN row = col THEN 0 ELSE v1 END AS c1 FROM p)
SELECT scene_id, row, col, CASE k WHEN 0 THEN c1 WHEN 1 THEN v2 ELSE v3 END AS r, CASE k WHEN 0 THEN v2 WHEN 1 THEN v2 ELSE v2 END AS g, CASE k WHEN 0 THEN (c1 + v2) / 2 WHEN 1 THEN v2 ELSE c1 END AS b,
  CASE WHEN k IN (0, 2) AND bad THEN 0 WHEN scene_id % 2 = 1 AND CASE k WHEN 0 THEN v1 = 120 AND v2 = 120 WHEN 1 THEN v2 = 120 ELSE v1 = 120 AND v2 = 120 AND v3 = 120 END THEN 0 WHEN k = 0 AND v3 <= 0 THEN 0 ELSE 1 END AS valid FROM q""",
    ),
)
def standard_pixels(spark, d):
    out = radiometry.standard_pixels(*_raw(spark, d))
    return out.withColumn("valid", F.col("valid").cast("int"))


@query("scenes_without_data", oracle("pixels", "SELECT scene_id, 'no valid pixels' AS error FROM pixels GROUP BY scene_id HAVING scene_id % 2 = 1 OR NOT bool_or(valid)"))
def scenes_without_data(spark, d):
    return radiometry.scenes_without_data(pixels(spark, d).withColumn("valid", F.col("valid") & (F.col("scene_id") % 2 == 0)))


@query(
    "payload_violations",
    oracle("scene_pairs", "SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN 'shape mismatch' WHEN 1 THEN 'not 8-bit' END AS reason FROM scene_pairs WHERE pair_id % 3 < 2"),
)
def payload_violations(spark, d):
    pair = F.floor(F.col("scene_id") / 2)
    damaged = pixels(spark, d).where(~((pair % 3 == 0) & (F.col("scene_id") % 2 == 1) & (F.col("row") == 63)))
    damaged = damaged.withColumn("r", F.when((pair % 3 == 1) & (F.col("row") == 5), F.col("r") + 300).otherwise(F.col("r")))
    return radiometry.payload_violations(damaged, bind(spark, d, "scene_pairs"))


# ------------------------------------------------------------------ measures

GRAY = "(0.299 * r + 0.587 * g + 0.114 * b)"


def measures_sql(source: str, keys: str, height: str, width: str) -> str:
    return f"""gr AS (SELECT *, {GRAY} AS gray FROM {source}),
ed AS (SELECT *, coalesce((lead(gray) OVER rw - lag(gray) OVER rw) / 2, lead(gray) OVER rw - gray, gray - lag(gray) OVER rw, 0) AS gx,
  coalesce((lead(gray) OVER cw - lag(gray) OVER cw) / 2, lead(gray) OVER cw - gray, gray - lag(gray) OVER cw, 0) AS gy FROM gr
  WINDOW rw AS (PARTITION BY {keys}, row ORDER BY col), cw AS (PARTITION BY {keys}, col ORDER BY row)),
ms AS (SELECT {keys}, max({width}) AS width_px, max({height}) AS height_px, max(modality) AS modality, round_even(100 * avg(CASE WHEN gray <= 50 THEN 1 ELSE 0 END) FILTER (valid), 0)::INT AS dark_pct,
  round_even(100 * avg(CASE WHEN gray >= 200 THEN 1 ELSE 0 END) FILTER (valid), 0)::INT AS bright_pct, round_even(avg(gray) FILTER (valid), 0)::INT AS mean_brightness, round_even(100 * avg(CASE WHEN sqrt(gx * gx + gy * gy) > 25 THEN 1 ELSE 0 END) FILTER (valid), 0)::INT AS edge_pct,
  round_even(avg(r) FILTER (valid), 0)::INT AS mean_r, round_even(avg(g) FILTER (valid), 0)::INT AS mean_g, round_even(avg(b) FILTER (valid), 0)::INT AS mean_b,
  CASE WHEN max(modality) <> 'sar' THEN round_even(100 * avg(CASE WHEN 2 * g - r - b > 20 THEN 1 ELSE 0 END) FILTER (valid), 0)::INT END AS green_dominant_pct FROM ed GROUP BY {keys})"""


SCENE_MS = measures_sql("pixels", "scene_id", "height", "width")


@query("scene_measures", oracle("pixels", f"WITH {SCENE_MS} SELECT * FROM ms"))
def scene_measures(spark, d):
    return measures.scene_measures(pixels(spark, d), ["scene_id"])


@query(
    "scene_facts",
    oracle(
        "pixels",
        f"""WITH {SCENE_MS} SELECT scene_id, 'image ' || width_px || 'x' || height_px || ' px; ' || CASE WHEN dark_pct IS NULL THEN 'no valid pixels' ELSE coalesce(green_dominant_pct || '% of pixels green-dominant; ', '') || dark_pct || '% dark pixels; ' || bright_pct || '% bright pixels; texture ' ||
  CASE WHEN edge_pct < 3 THEN 'very smooth (few edges)' WHEN edge_pct < 10 THEN 'mostly smooth' WHEN edge_pct < 25 THEN 'moderately detailed' ELSE 'highly detailed / busy' END END || '.' AS facts FROM ms""",
    ),
)
def scene_facts(spark, d):
    return measures.scene_facts(measures.scene_measures(pixels(spark, d), ["scene_id"])).select("scene_id", "facts")


def _pair_measures(spark, d):
    """Scene measures of both dates; the later date is smoothed so that the levels of detail differ."""
    by_scene = measures.scene_measures(pixels(spark, d), ["scene_id"])
    by_scene = by_scene.withColumn("edge_pct", F.when(F.col("scene_id") % 4 == 1, F.floor(F.col("edge_pct") / 3).cast("int")).otherwise(F.col("edge_pct")))
    keyed = by_scene.withColumn("pair_id", F.floor(F.col("scene_id") / 2))
    side = lambda k: keyed.where(F.col("scene_id") % 2 == k).drop("scene_id")
    return measures.pair_measures(side(0), side(1), ["pair_id"])


PAIR_MS = f"""{SCENE_MS}, e AS (SELECT * REPLACE (CASE WHEN scene_id % 4 = 1 THEN floor(edge_pct / 3)::INT ELSE edge_pct END AS edge_pct) FROM ms),
pm AS (SELECT floor(a.scene_id / 2)::BIGINT AS pair_id, {', '.join(f'a.{c} AS {c}_1, b.{c} AS {c}_2' for c in ('green_dominant_pct', 'dark_pct', 'bright_pct', 'edge_pct'))} FROM e a JOIN e b ON b.scene_id = a.scene_id + 1 WHERE a.scene_id % 2 = 0)"""


def shift_sql(name: str, c: str) -> str:
    return f"'{name} ' || CASE WHEN abs({c}_2 - {c}_1) < 3 THEN 'about the same' WHEN {c}_2 > {c}_1 THEN 'up' ELSE 'down' END || ' (' || {c}_1 || '% -> ' || {c}_2 || '%)'"


@query(
    "pair_shift_text",
    oracle(
        "pixels",
        f"WITH {PAIR_MS} SELECT pair_id, coalesce({shift_sql('green-dominant pixels', 'green_dominant_pct')} || '; ', '') || {shift_sql('dark pixels', 'dark_pct')} || '; ' || {shift_sql('bright pixels', 'bright_pct')} || '; ' || {shift_sql('edge/detail pixels', 'edge_pct')} || '.' AS shift FROM pm",
    ),
)
def pair_shift_text(spark, d):
    return _pair_measures(spark, d).select("pair_id", measures.pair_shift_text().alias("shift"))


@query(
    "comparability",
    oracle(
        "pixels",
        f"""WITH {PAIR_MS} SELECT pair_id, CASE WHEN abs(edge_pct_1 - edge_pct_2) >= 5 AND greatest(edge_pct_1, edge_pct_2) >= 2 * greatest(least(edge_pct_1, edge_pct_2), 1) THEN
  'The two images differ strongly in level of detail (' || edge_pct_1 || '% vs ' || edge_pct_2 || '% edge pixels; the ' || CASE WHEN edge_pct_2 > edge_pct_1 THEN 'second' ELSE 'first' END || ' is much sharper or closer). That usually means different zoom, resolution or sharpness, so they cannot be compared pixel to pixel: ''no change'' may be false and any located change may be misaligned. Capture both at the same zoom and position.' END AS warning FROM pm""",
    ),
)
def comparability(spark, d):
    return _pair_measures(spark, d).select("pair_id", measures.comparability_warning().alias("warning"))


def _region_measures(spark, d):
    keyed = pixels(spark, d).withColumns({"pair_id": F.floor(F.col("scene_id") / 2), "date": F.col("scene_id") % 2})
    by_date = measures.region_measures(keyed, ["pair_id", "date"], bind(spark, d, "pair_regions"), ["pair_id"])
    side = lambda k: by_date.where(F.col("date") == k).drop("date")
    return measures.pair_measures(side(0), side(1), ["pair_id", "region_no"])


REGION_MS = f"""boxed AS (SELECT p.* REPLACE (p.row - q.y AS row, p.col - q.x AS col), q.pair_id, q.region_no, p.scene_id % 2 AS date, q.w, q.h FROM pixels p JOIN pair_regions q ON q.pair_id = floor(p.scene_id / 2)
  WHERE p.col >= q.x AND p.col < q.x + q.w AND p.row >= q.y AND p.row < q.y + q.h), {measures_sql('boxed', 'pair_id, region_no, date', 'h', 'w')}"""


@query(
    "region_measures",
    oracle(
        "pixels pair_regions",
        f"""WITH {REGION_MS} SELECT a.pair_id, a.region_no, a.dark_pct AS dark_1, b.dark_pct AS dark_2, a.bright_pct AS bright_1, b.bright_pct AS bright_2, a.edge_pct AS edge_1, b.edge_pct AS edge_2, a.mean_brightness AS mean_1, b.mean_brightness AS mean_2
FROM ms a JOIN ms b ON b.pair_id = a.pair_id AND b.region_no = a.region_no AND b.date = 1 WHERE a.date = 0""",
    ),
)
def region_measures(spark, d):
    names = {"dark": "dark_pct", "bright": "bright_pct", "edge": "edge_pct", "mean": "mean_brightness"}
    return _region_measures(spark, d).select(
        "pair_id", "region_no", *[F.col(f"{s}.{c}").alias(f"{n}_{i}") for n, c in names.items() for i, s in ((1, "before"), (2, "after"))]
    )


@query(
    "region_shift_text",
    oracle(
        "pixels pair_regions",
        f"""WITH {REGION_MS}, j AS (SELECT a.pair_id, a.region_no, a.green_dominant_pct AS g1, b.green_dominant_pct AS g2, a.bright_pct AS b1, b.bright_pct AS b2, a.mean_brightness AS m1, b.mean_brightness AS m2,
  a.mean_r || ',' || a.mean_g || ',' || a.mean_b AS c1, b.mean_r || ',' || b.mean_g || ',' || b.mean_b AS c2, greatest(abs(a.mean_r - b.mean_r), abs(a.mean_g - b.mean_g), abs(a.mean_b - b.mean_b)) AS cd
  FROM ms a JOIN ms b ON b.pair_id = a.pair_id AND b.region_no = a.region_no AND b.date = 1 WHERE a.date = 0)
SELECT pair_id, region_no, coalesce(nullif(concat_ws('; ', CASE WHEN abs(g2 - g1) >= 3 THEN 'green-dominant pixels ' || g1 || '% -> ' || g2 || '%' END, CASE WHEN abs(b2 - b1) >= 3 THEN 'bright pixels ' || b1 || '% -> ' || b2 || '%' END,
  CASE WHEN abs(m2 - m1) >= 15 THEN 'average brightness ' || m1 || ' -> ' || m2 || ' (0-255)' WHEN cd >= 12 THEN 'average colour (R,G,B) ' || c1 || ' -> ' || c2 END), ''), 'averages over this area barely moved; the change is patchy or local') AS shift FROM j""",
    ),
)
def region_shift_text(spark, d):
    return _region_measures(spark, d).select("pair_id", "region_no", measures.region_shift_text().alias("shift"))


@query(
    "edge_gradient",
    oracle("pixels", f"WITH {SCENE_MS} SELECT scene_id, row, col, round(sqrt(gx * gx + gy * gy) + 1e-9, 4) AS edge FROM ed"),
)
def edge_gradient(spark, d):
    grayed = pixels(spark, d).withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b")))
    return rasters.gradient(grayed, ["scene_id"], "gray", "edge").select("scene_id", "row", "col", *r4("edge"))


# ------------------------------------------------------------------ stretch


def grouped(spark, d):
    return pixels(spark, d).withColumn("group_id", F.floor(F.col("scene_id") / 2))


LONG = "lng AS (SELECT floor(scene_id / 2)::BIGINT AS group_id, scene_id, row, col, valid, b AS band, CASE b WHEN 1 THEN r WHEN 2 THEN g ELSE pixels.b END AS value FROM pixels, (VALUES (1), (2), (3)) t(b))"
BOUNDS = f"""{LONG.replace('b AS band, CASE b', 't.k AS band, CASE t.k').replace('t(b)', 't(k)')},
bd AS (SELECT group_id, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi0 FROM lng WHERE valid GROUP BY 1, 2),
bounds AS (SELECT group_id, band, lo, CASE WHEN hi0 <= lo THEN lo + 1 ELSE hi0 END AS hi FROM bd)"""


@query("shared_bounds", oracle("pixels", f"WITH {BOUNDS} SELECT group_id, band, round(lo + 1e-9, 4) AS lo, round(hi + 1e-9, 4) AS hi FROM bounds"))
def shared_bounds(spark, d):
    return radiometry.shared_bounds(grouped(spark, d)).select("group_id", "band", *r4("lo", "hi"))


@query(
    "sampled_bounds",
    oracle(
        "pixels",
        """WITH n AS (SELECT *, floor(scene_id / 2)::BIGINT AS group_id, row_number() OVER (PARTITION BY scene_id ORDER BY row, col) - 1 AS k, greatest(1, floor(count(*) OVER (PARTITION BY scene_id) / 1000)) AS step FROM pixels WHERE valid),
l AS (SELECT group_id, t.k2 AS band, CASE t.k2 WHEN 1 THEN r WHEN 2 THEN g ELSE b END AS value FROM n, (VALUES (1), (2), (3)) t(k2) WHERE k % step = 0)
SELECT group_id, band, round(quantile_cont(value, 0.02) + 1e-9, 4) AS lo, round(quantile_cont(value, 0.98) + 1e-9, 4) AS hi FROM l GROUP BY 1, 2""",
    ),
)
def sampled_bounds(spark, d):
    return radiometry.sampled_bounds(grouped(spark, d), 1000).select("group_id", "band", *r4("lo", "hi"))


@query(
    "stretched_pixels",
    oracle(
        "pixels",
        f"""WITH {BOUNDS}, s AS (SELECT l.*, CASE WHEN valid THEN floor(least(greatest((value - lo) / (hi - lo) * 255, 0), 255)) ELSE 0 END AS s FROM lng l LEFT JOIN bounds b ON b.group_id = l.group_id AND b.band = l.band)
SELECT scene_id, row, col, CAST(max(s) FILTER (band = 1) AS INT) AS r, CAST(max(s) FILTER (band = 2) AS INT) AS g, CAST(max(s) FILTER (band = 3) AS INT) AS b FROM s GROUP BY 1, 2, 3""",
    ),
)
def stretched_pixels(spark, d):
    source = grouped(spark, d)
    return radiometry.stretch(source, radiometry.shared_bounds(source)).select("scene_id", "row", "col", "r", "g", "b")


@query(
    "normalization_labels",
    oracle("bands", "SELECT floor(scene_id / 2)::BIGINT AS group_id, CASE WHEN count(DISTINCT scene_id) > 1 THEN 'shared' ELSE 'single-image' END AS normalization FROM bands GROUP BY 1"),
)
def normalization_labels(spark, d):
    return radiometry.normalization_labels(grouped(spark, d))


# ------------------------------------------------------------------ filters


def mirror(x: str, repeat: bool, size: str = "64") -> str:
    return f"CASE WHEN {x} < 0 THEN -({x}){' - 1' if repeat else ''} WHEN {x} >= {size} THEN 2 * {size} - {1 if repeat else 2} - ({x}) ELSE {x} END"


def box_sql(source: str, keys: str, radius: int, out: str) -> str:
    join = " AND ".join(f"q.{k} = p.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    offs = f"range(-{radius}, {radius + 1})"
    return f"""{out} AS (SELECT {pk}, p.row, p.col, any_value(p.value) AS value, avg(q.value) AS mean, avg(q.value * q.value) AS sq FROM {source} p, {offs} a(dr), {offs} b(dc)
  JOIN {source} q ON {join} AND q.row = {mirror('p.row + a.dr', True)} AND q.col = {mirror('p.col + b.dc', True)} GROUP BY {pk}, p.row, p.col)"""


LOCAL = f"{box_sql('bands', 'scene_id, band', 3, 'loc')}, var AS (SELECT *, greatest(sq - mean * mean, 0) / greatest(mean * mean, 1e-12) AS ci2 FROM loc)"


def sized_bands(spark, d):
    return bind(spark, d, "bands").withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})


@query("local_variation", oracle("bands", f"WITH {LOCAL} SELECT scene_id, band, row, col, round(mean + 1e-9, 4) AS mean, round(ci2 + 1e-9, 4) AS ci2 FROM var"))
def local_variation(spark, d):
    out = radiometry.local_variation(sized_bands(spark, d), ["scene_id", "band"], "value", 7)
    return out.select("scene_id", "band", "row", "col", *r4("mean", "ci2"))


@query("noise_levels", oracle("bands", f"WITH {LOCAL} SELECT scene_id, band, round(least(greatest(quantile_cont(ci2, 0.25), 0.02), 0.5), 6) AS cu2 FROM var GROUP BY 1, 2"))
def noise_levels(spark, d):
    varied = radiometry.local_variation(sized_bands(spark, d), ["scene_id", "band"], "value", 7)
    return radiometry.noise_level(varied, ["scene_id", "band"]).select("scene_id", "band", F.round("cu2", 6).alias("cu2"))


@query("radar_units", oracle("radar_bands", "SELECT scene_id, band, CASE WHEN scene_id % 4 = 2 THEN 'display' WHEN min(value) < 0 THEN 'db' ELSE 'linear' END AS units FROM radar_bands WHERE valid GROUP BY 1, 2"))
def radar_units(spark, d):
    bands = bind(spark, d, "radar_bands")
    return radiometry.radar_units(bands, bands.where("scene_id % 4 = 2").select("scene_id").distinct())


def lee_sql(source: str, keys: str, radius: int) -> str:
    join = " AND ".join(f"c.{k} = v.{k}" for k in keys.split(", "))
    return f"""{box_sql(source, keys, radius, 'loc')}, var AS (SELECT *, greatest(sq - mean * mean, 0) / greatest(mean * mean, 1e-12) AS ci2 FROM loc),
cu AS (SELECT {keys}, least(greatest(quantile_cont(ci2, 0.25), 0.02), 0.5) AS cu2 FROM var GROUP BY {keys}),
lee AS (SELECT v.*, v.mean + least(greatest(1 - cu2 / greatest(ci2, 1e-12), 0), 1) * (v.value - v.mean) AS f FROM var v JOIN cu c ON {join})"""


@query(
    "despeckled_bands",
    oracle(
        "radar_bands",
        f"""WITH med AS (SELECT scene_id, band, median(value) AS m, min(value) AS lo FROM radar_bands WHERE valid GROUP BY 1, 2),
lin AS (SELECT b.scene_id, b.band, b.row, b.col, CASE WHEN lo < 0 THEN greatest(pow(10, (CASE WHEN valid THEN value ELSE m END) / 10), 1e-6) ELSE greatest(CASE WHEN valid THEN value ELSE m END, 1e-6) END AS value FROM radar_bands b JOIN med ON med.scene_id = b.scene_id AND med.band = b.band),
{lee_sql('lin', 'scene_id, band', 3)} SELECT scene_id, band, row, col, round(10 * log10(greatest(f, 1e-6)) + 1e-9, 4) AS value FROM lee""",
    ),
)
def despeckled_bands(spark, d):
    bands = bind(spark, d, "radar_bands")
    integer = bands.where("scene_id < 0").select("scene_id")
    return radiometry.despeckle(bands, integer).select("scene_id", "band", "row", "col", *r4("value"))


@query(
    "despeckled_previews",
    oracle(
        "bands",
        f"""WITH src AS (SELECT scene_id, band, row, col, CASE WHEN scene_id % 2 = 0 THEN max(CASE WHEN band = 1 THEN value END) OVER (PARTITION BY scene_id, row, col) ELSE value END AS value FROM bands),
{lee_sql('src', 'scene_id, band', 2)}
SELECT scene_id, row, col, CAST(floor(max(f) FILTER (band = 1) + 1e-9) AS INT) AS r, CAST(floor(max(f) FILTER (band = 2) + 1e-9) AS INT) AS g, CAST(floor(max(f) FILTER (band = 3) + 1e-9) AS INT) AS b FROM lee GROUP BY 1, 2, 3""",
    ),
)
def despeckled_previews(spark, d):
    even = F.col("scene_id") % 2 == 0
    source = pixels(spark, d).withColumns({c: F.when(even, F.col("r")).otherwise(F.col(c)) for c in "gb"})
    return radiometry.despeckle_previews(source).select("scene_id", "row", "col", "r", "g", "b")


def blur_sql(source: str, keys: str, columns: list[str], size: int, out: str, carry: str = "", sigma: float | None = None) -> str:
    weights = ", ".join(f"({i - size // 2}, {w!r})" for i, w in enumerate(rasters.gaussian_weights(size, sigma)))
    extra = "".join(f", any_value(p.{c}) AS {c}" for c in carry.split())
    step = lambda src, name, axis, other: (
        f"{name} AS (SELECT p.{keys}, p.row, p.col{extra}, {', '.join(f'sum(q.{c} * o.w) AS {c}' for c in columns)} FROM {src} p, {out}_o o "
        f"JOIN {src} q ON q.{keys} = p.{keys} AND q.{other} = p.{other} AND q.{axis} = {mirror(f'p.{axis} + o.i', False)} GROUP BY p.{keys}, p.row, p.col)"
    )
    return f"{out}_o(i, w) AS (VALUES {weights}), {step(source, out + '_h', 'col', 'row')}, {step(out + '_h', out, 'row', 'col')}"


@query("gaussian_blur", oracle("pixels", f"WITH {blur_sql('pixels', 'scene_id', ['r', 'g', 'b'], 21, 'bl')} SELECT scene_id, row, col, round(r + 1e-9, 4) AS r, round(g + 1e-9, 4) AS g, round(b + 1e-9, 4) AS b FROM bl"))
def gaussian_blur(spark, d):
    return rasters.gaussian_blur(pixels(spark, d), ["scene_id"], ["r", "g", "b"], 21).select("scene_id", "row", "col", *r4("r", "g", "b"))


SIZES = "s AS (SELECT scene_id * 3 + k AS scene_id, k, p.row, p.col, r, g, valid, h AS height, w AS width FROM pixels p, (VALUES (0, 64, 64), (1, 40, 25), (2, 9, 64)) z(k, h, w) WHERE p.row < h AND p.col < w)"


def scenes_of_three_sizes(spark, d):
    sizes = spark.createDataFrame([(0, 64, 64), (1, 40, 25), (2, 9, 64)], "k int, height int, width int")
    cut = pixels(spark, d).drop("height", "width").join(F.broadcast(sizes), (F.col("row") < F.col("height")) & (F.col("col") < F.col("width")))
    return cut.select((F.col("scene_id") * 3 + F.col("k")).alias("scene_id"), "row", "col", "r", "g", "valid", "height", "width")


SIZED_WEIGHTS = ", ".join(f"({k}, {i - n // 2}, {w!r})" for k, n in enumerate((21, 15, 3)) for i, w in enumerate(rasters.gaussian_weights(n)))
SIZED_STEP = lambda src, out, axis, other: (
    f"{out} AS (SELECT p.scene_id, p.row, p.col, any_value(p.k) AS k, any_value(p.height) AS height, any_value(p.width) AS width, sum(q.r * o.w) AS r, sum(q.g * o.w) AS g FROM {src} p JOIN o ON o.k = p.k "
    f"JOIN {src} q ON q.scene_id = p.scene_id AND q.{other} = p.{other} AND q.{axis} = {mirror(f'p.{axis} + o.i', False, 'p.width' if axis == 'col' else 'p.height')} GROUP BY 1, 2, 3)"
)


@query(
    "blurred_sizes",
    oracle("pixels", f"WITH {SIZES}, o(k, i, w) AS (VALUES {SIZED_WEIGHTS}), {SIZED_STEP('s', 'bh', 'col', 'row')}, {SIZED_STEP('bh', 'bl', 'row', 'col')} SELECT scene_id, row, col, round(r + 1e-9, 4) AS r, round(g + 1e-9, 4) AS g FROM bl"),
)
def blurred_sizes(spark, d):
    size = F.when(F.col("height") == 64, 21).when(F.col("height") == 40, 15).otherwise(3)
    return rasters.gaussian_blur(scenes_of_three_sizes(spark, d), ["scene_id"], ["r", "g"], size).select("scene_id", "row", "col", *r4("r", "g"))


@query(
    "eroded_sizes",
    oracle(
        "pixels",
        f"WITH {SIZES} SELECT p.scene_id, p.row, p.col, CASE WHEN bool_and(q.valid) THEN 1 ELSE 0 END AS valid FROM s p JOIN s q ON q.scene_id = p.scene_id AND abs(q.row - p.row) <= p.height // 8 AND abs(q.col - p.col) <= p.height // 8 GROUP BY 1, 2, 3",
    ),
)
def eroded_sizes(spark, d):
    kernel = F.floor(F.col("height") / 8) * 2 + 1
    return rasters.erode_valid(scenes_of_three_sizes(spark, d), ["scene_id"], "valid", kernel).select("scene_id", "row", "col", F.col("valid").cast("int").alias("valid"))


@query(
    "eroded_validity",
    oracle("pixels", "SELECT p.scene_id, p.row, p.col, CASE WHEN bool_and(q.valid) THEN 1 ELSE 0 END AS valid FROM pixels p JOIN pixels q ON q.scene_id = p.scene_id AND abs(q.row - p.row) <= 11 AND abs(q.col - p.col) <= 11 GROUP BY 1, 2, 3"),
)
def eroded_validity(spark, d):
    out = rasters.erode_valid(pixels(spark, d), ["scene_id"], "valid", 23)
    return out.select("scene_id", "row", "col", F.col("valid").cast("int").alias("valid"))


@query(
    "bilateral_filter",
    oracle(
        "pixels",
        f"""WITH o AS (SELECT a.dy, b.dx, exp(-(dy * dy + dx * dx) / (2 * 3.0 * 3.0)) AS w FROM range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE dy * dy + dx * dx <= 16),
n AS (SELECT p.scene_id, p.row, p.col, q.r AS v, o.w * exp(-((q.r - p.r) ** 2) / (2 * 40.0 * 40.0)) AS w FROM pixels p, o JOIN pixels q ON q.scene_id = p.scene_id AND q.row = {mirror('p.row + o.dy', False)} AND q.col = {mirror('p.col + o.dx', False)})
SELECT scene_id, row, col, round(sum(v * w) / sum(w) + 1e-9, 4) AS r FROM n GROUP BY 1, 2, 3""",
    ),
)
def bilateral_filter(spark, d):
    return rasters.bilateral_filter(pixels(spark, d), ["scene_id"], "r", 9, 40.0, 3.0).select("scene_id", "row", "col", *r4("r"))


@query("block_preview", oracle("pixels", "SELECT scene_id, floor(row / 4)::INT AS row, floor(col / 4)::INT AS col, round(avg(r) + 1e-9, 4) AS r, round(avg(g) + 1e-9, 4) AS g, round(avg(b) + 1e-9, 4) AS b FROM pixels GROUP BY 1, 2, 3"))
def block_preview(spark, d):
    return rasters.preview(pixels(spark, d), ["scene_id"], ["r", "g", "b"], longest=16).select("scene_id", "row", "col", *r4("r", "g", "b"))


@query(
    "area_resize",
    oracle(
        "pixels",
        """WITH t AS (SELECT p.scene_id, a.t AS tr, b.t AS tc, r, greatest(0, least((p.row + 1) * 24.0 / 64, a.t + 1) - greatest(p.row * 24.0 / 64, a.t)) * greatest(0, least((p.col + 1) * 40.0 / 64, b.t + 1) - greatest(p.col * 40.0 / 64, b.t)) AS w
  FROM pixels p, range(24) a(t), range(40) b(t) WHERE a.t BETWEEN floor(p.row * 24.0 / 64) AND floor(p.row * 24.0 / 64) + 1 AND b.t BETWEEN floor(p.col * 40.0 / 64) AND floor(p.col * 40.0 / 64) + 1)
SELECT scene_id, CAST(tr AS INT) AS row, CAST(tc AS INT) AS col, round(sum(r * w) / sum(w) + 1e-9, 4) AS r FROM t WHERE w > 1e-9 GROUP BY 1, 2, 3""",
    ),
)
def area_resize(spark, d):
    return rasters.area_resize(pixels(spark, d), ["scene_id"], ["r"], F.lit(24), F.lit(40)).select("scene_id", "row", "col", *r4("r"))


@query(
    "nearest_resize",
    oracle("pixels", "SELECT p.scene_id, CAST(a.t AS INT) AS row, CAST(b.t AS INT) AS col, r FROM range(100) a(t), range(24) b(t) JOIN pixels p ON p.row = floor(a.t * 64.0 / 100) AND p.col = floor(b.t * 64.0 / 24)"),
)
def nearest_resize(spark, d):
    return rasters.nearest_resize(pixels(spark, d), ["scene_id"], ["r"], F.lit(100), F.lit(24))


# ------------------------------------------------------------------ tiles


@query(
    "tile_pixels",
    oracle(
        "pixels",
        """SELECT p.scene_id, CAST(a.t AS INT) AS grid_row, CAST(b.t AS INT) AS grid_col, count(*) AS n, round(avg(r) + 1e-9, 4) AS mean_r FROM pixels p, range(4) a(t), range(4) b(t)
WHERE p.row >= a.t * 16 - 4 AND p.row < a.t * 16 + 20 AND p.col >= b.t * 16 - 4 AND p.col < b.t * 16 + 20 GROUP BY 1, 2, 3""",
    ),
)
def tile_pixels(spark, d):
    source = pixels(spark, d)
    scenes = source.select("scene_id", "width", "height").distinct()
    tiles = scan.tile_pixels(source.drop("width", "height"), scenes)
    return tiles.groupBy("scene_id", "grid_row", "grid_col").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r") + 1e-9, 4).alias("mean_r"))


TILE_BYTES = """wi AS (SELECT a.t AS gr, b.t AS gc, greatest(0, a.t * 16 - 4) AS y, least(64, a.t * 16 + 20) - greatest(0, a.t * 16 - 4) AS h, greatest(0, b.t * 16 - 4) AS x, least(64, b.t * 16 + 20) - greatest(0, b.t * 16 - 4) AS w FROM range(4) a(t), range(4) b(t)),
rd AS (SELECT gr, gc, i.t AS i, j.t AS j, y + (i.t * h) // 24 AS row, x + (j.t * w) // 24 AS col FROM wi, range(24) i(t), range(24) j(t)),
by8 AS (SELECT p.scene_id, CAST(gr AS INT) AS grid_row, CAST(gc AS INT) AS grid_col, i * 24 + j AS place, least(255, greatest(0, round_even(r, 0)))::INT AS r8, least(255, greatest(0, round_even(g, 0)))::INT AS g8, least(255, greatest(0, round_even(b, 0)))::INT AS b8
  FROM rd JOIN pixels p ON p.row = rd.row AND p.col = rd.col)"""


def _tile_blocks(spark, d):
    source = pixels(spark, d)
    return scan.tile_blocks(source, source.select("scene_id", "width", "height").distinct(), side=24)


@query(
    "tile_blocks",
    oracle("pixels", f"WITH {TILE_BYTES} SELECT scene_id, grid_row, grid_col, sha256(string_agg(printf('%02X%02X%02X', r8, g8, b8), '' ORDER BY place)) AS tile_sha256 FROM by8 GROUP BY 1, 2, 3"),
)
def tile_blocks(spark, d):
    return _tile_blocks(spark, d).select("scene_id", "grid_row", "grid_col", F.sha2(F.hex("tile"), 256).alias("tile_sha256"))


def _weighted_level(tiles):
    """A scorer to which order and channel matter."""
    weights = (np.arange(tiles[0].size) % 7).reshape(tiles[0].shape)
    return (tiles * weights).sum(axis=(1, 2, 3)) / (255 * weights.sum())


@query(
    "tile_scores",
    oracle(
        "pixels",
        f"""WITH {TILE_BYTES}, v AS (SELECT scene_id, grid_row, grid_col, place * 3 + c AS n, CASE c WHEN 0 THEN r8 WHEN 1 THEN g8 ELSE b8 END AS v FROM by8, range(3) k(c))
SELECT scene_id AS scan_id, 'mining' AS adapter, grid_row, grid_col, round(sum(v * (n % 7)) / (255.0 * sum(n % 7)), 6) AS p FROM v GROUP BY 1, 2, 3, 4""",
    ),
)
def tile_scores(spark, d):
    blocks = _tile_blocks(spark, d).select(F.col("scene_id").alias("scan_id"), F.lit("mining").alias("adapter"), "grid_row", "grid_col", "tile")
    return scan.score_tiles(blocks, _weighted_level).withColumn("p", F.round("p", 6))


# ------------------------------------------------------------------ masks

CROSS, DISC5 = {0: 1, 1: 0}, {0: 2, 1: 2, 2: 0}


def offsets(half: dict[int, int]) -> str:
    return ", ".join(f"({dy}, {dx})" for k, w in half.items() for dy in {k, -k} for dx in range(-w, w + 1))


def morph(chain: list[tuple[str, str, str]], key: str, grid: str) -> str:
    """SQL chain over pixel sets (key, row, col): ('dilate:kernel' | 'not', in, out)."""
    parts = []
    for op, a, b in chain:
        if op == "not":
            parts.append(f"{b} AS MATERIALIZED (SELECT {key}, row, col FROM {grid} EXCEPT SELECT {key}, row, col FROM {a})")
        else:
            parts.append(
                f"{b} AS MATERIALIZED (SELECT DISTINCT s.{key}, s.row + o.dy AS row, s.col + o.dx AS col FROM {a} s, {op.split(':')[1]} o WHERE s.row + o.dy BETWEEN 0 AND 63 AND s.col + o.dx BETWEEN 0 AND 63)"
            )
    return ", ".join(parts)


KERNELS = f"cross3(dy, dx) AS (VALUES {offsets(CROSS)}), disc5(dy, dx) AS (VALUES {offsets(DISC5)})"
NOISY = "m0 AS (SELECT scene_id, row, col FROM pixels WHERE r + g + b > 360)"
GRID = "grid AS (SELECT scene_id, row, col FROM pixels)"
SCENE = ["scene_id"]


def noisy(spark, d, level=360):
    return masks.to_runs(pixels(spark, d), SCENE, F.col("r") + F.col("g") + F.col("b") > level)


def shapes(spark, d):
    return pixels(spark, d).select("scene_id", "height", "width").distinct()


def open_chain(a: str, out: str, kernel: str, times: int, tag: str) -> list:
    chain, last = [("not", a, f"{tag}n0")], f"{tag}n0"
    for i in range(times):
        chain.append((f"dilate:{kernel}", last, f"{tag}e{i}"))
        last = f"{tag}e{i}"
    chain.append(("not", last, f"{tag}k"))
    last = f"{tag}k"
    for i in range(times):
        name = out if i == times - 1 else f"{tag}d{i}"
        chain.append((f"dilate:{kernel}", last, name))
        last = name
    return chain


def close_chain(a: str, out: str, kernel: str, times: int, tag: str) -> list:
    chain, last = [], a
    for i in range(times):
        chain.append((f"dilate:{kernel}", last, f"{tag}d{i}"))
        last = f"{tag}d{i}"
    chain.append(("not", last, f"{tag}n"))
    last = f"{tag}n"
    for i in range(times):
        chain.append((f"dilate:{kernel}", last, f"{tag}e{i}"))
        last = f"{tag}e{i}"
    return [*chain, ("not", last, out)]


@query("mask_opened", oracle("pixels", f"WITH {KERNELS}, {GRID}, {NOISY}, {morph(open_chain('m0', 'done', 'cross3', 1, 'o'), 'scene_id', 'grid')} SELECT * FROM done"))
def mask_opened(spark, d):
    return masks.to_pixels(masks.opened(noisy(spark, d), shapes(spark, d), SCENE, F.lit(3)), SCENE)


@query("mask_closed", oracle("pixels", f"WITH {KERNELS}, {GRID}, m0 AS (SELECT scene_id, row, col FROM pixels WHERE r + g + b > 480), {morph(close_chain('m0', 'done', 'disc5', 2, 'c'), 'scene_id', 'grid')} SELECT * FROM done"))
def mask_closed(spark, d):
    return masks.to_pixels(masks.closed(noisy(spark, d, 480), shapes(spark, d), SCENE, F.lit(5), times=2), SCENE)


def groups_sql(source: str, key: str, near: str, tag: str = "") -> str:
    """Groups found from their possible first pixels only: those without an earlier neighbour."""
    return f"""seed{tag} AS (SELECT {key}, row, col FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {source} h WHERE h.{key} = s.{key} AND {near.format(a='s', b='h')} AND h.row * 64 + h.col < s.row * 64 + s.col)),
reach{tag}({key}, r, c, row, col) AS (SELECT {key}, row, col, row, col FROM seed{tag} UNION SELECT a.{key}, a.r, a.c, h.row, h.col FROM reach{tag} a JOIN {source} h ON h.{key} = a.{key} AND {near.format(a='a', b='h')}),
lab{tag} AS MATERIALIZED (SELECT {key}, row, col, min(r * 64 + c) AS label FROM reach{tag} GROUP BY 1, 2, 3)"""


NEAR8 = "abs({b}.row - {a}.row) <= 1 AND abs({b}.col - {a}.col) <= 1"
NEAR4 = "abs({b}.row - {a}.row) + abs({b}.col - {a}.col) <= 1"
SPARSE = "m0 AS MATERIALIZED (SELECT scene_id, row, col FROM pixels WHERE r + g + b > 440)"


@query("mask_groups", oracle("pixels", f"WITH RECURSIVE {SPARSE}, {groups_sql('m0', 'scene_id', NEAR8)} SELECT scene_id, row, col, label FROM lab"))
def mask_groups(spark, d):
    labelled = masks.label_runs(noisy(spark, d, 440), SCENE)
    return labelled.select("scene_id", "row", F.explode(F.sequence("start", "end")).alias("col"), "label")


@query(
    "mask_group_measures",
    oracle(
        "pixels",
        f"WITH RECURSIVE {SPARSE}, {groups_sql('m0', 'scene_id', NEAR4)} SELECT scene_id, label, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS w, max(row) - min(row) + 1 AS h, count(*) AS area, round(count(*) / 4096, 6) AS frac FROM lab GROUP BY 1, 2",
    ),
)
def mask_group_measures(spark, d):
    grouped_ = masks.group_measures(masks.label_runs(noisy(spark, d, 440), SCENE, connectivity=4), SCENE)
    return grouped_.select("scene_id", "label", "x", "y", "w", "h", "area", F.round("frac", 6).alias("frac"))


@query(
    "grown_seeds",
    oracle(
        "pixels",
        f"""WITH RECURSIVE {SPARSE}, s0 AS (SELECT scene_id, row, col FROM pixels WHERE r + g + b > 520), {groups_sql('m0', 'scene_id', NEAR8)},
ok AS (SELECT l.scene_id, l.label FROM lab l LEFT JOIN s0 s ON s.scene_id = l.scene_id AND s.row = l.row AND s.col = l.col GROUP BY 1, 2 HAVING count(s.row) > 0 AND count(*) <= 3 * count(s.row))
SELECT l.scene_id, l.row, l.col FROM lab l JOIN ok ON ok.scene_id = l.scene_id AND ok.label = l.label UNION SELECT scene_id, row, col FROM s0""",
    ),
)
def grown_seeds(spark, d):
    grown = masks.grow_seeds(noisy(spark, d, 440), noisy(spark, d, 520), SCENE, 3.0)
    return masks.to_pixels(grown, SCENE)


# ------------------------------------------------------------------ change


def joined(spark, d):
    return change.join_dates(bind(spark, d, "scene_pairs"), pixels(spark, d))


CHANGE = "pixels scene_pairs"
JOINED = """jd AS MATERIALIZED (SELECT s.pair_id, s.modality, a.row, a.col, a.r AS r_a, a.g AS g_a, a.b AS b_a, b.r AS r_b, b.g AS g_b, b.b AS b_b, a.valid AND b.valid AS valid
  FROM scene_pairs s JOIN pixels a ON a.scene_id = s.scene_a JOIN pixels b ON b.scene_id = s.scene_b AND b.row = a.row AND b.col = a.col)"""


@query("joined_dates", oracle(CHANGE, f"WITH {JOINED} SELECT pair_id, row, col, r_a, r_b, CAST(valid AS INT) AS valid FROM jd"))
def joined_dates(spark, d):
    return joined(spark, d).select("pair_id", "row", "col", "r_a", "r_b", F.col("valid").cast("int").alias("valid"))


SIGNALS = f"""{JOINED}, {blur_sql('jd', 'pair_id', ['r_a', 'g_a', 'b_a', 'r_b', 'g_b', 'b_b'], 21, 'bl', 'modality')},
sg AS MATERIALIZED (SELECT x.pair_id, x.row, x.col, x.modality, abs(0.299 * x.r_a + 0.587 * x.g_a + 0.114 * x.b_a - 0.299 * x.r_b - 0.587 * x.g_b - 0.114 * x.b_b) AS diff,
  j.modality <> 'sar' AND greatest(0.299 * j.r_a + 0.587 * j.g_a + 0.114 * j.b_a, 0.299 * j.r_b + 0.587 * j.g_b + 0.114 * j.b_b) > 200 AS cloud, x.col >= 13 AS safe,
  x.r_a, x.g_a, x.b_a, x.r_b, x.g_b, x.b_b FROM bl x JOIN jd j ON j.pair_id = x.pair_id AND j.row = x.row AND j.col = x.col)"""


def signals(spark, d):
    return cut_lineage(change.pair_signals(joined(spark, d)))


@query("change_signals", oracle(CHANGE, f"WITH {SIGNALS} SELECT pair_id, row, col, round(diff + 1e-9, 4) AS diff, CAST(cloud AS INT) AS cloud, CAST(safe AS INT) AS safe FROM sg"))
def change_signals(spark, d):
    return signals(spark, d).select("pair_id", "row", "col", *r4("diff"), F.col("cloud").cast("int").alias("cloud"), F.col("safe").cast("int").alias("safe"))


CLOUDS = f"""c0 AS (SELECT pair_id, row, col FROM sg WHERE cloud), pgrid AS (SELECT pair_id, row, col FROM sg),
{morph([*open_chain('c0', 'c1', 'cross3', 1, 'co'), ('dilate:cross3', 'c1', 'c2'), ('dilate:cross3', 'c2', 'clouds')], 'pair_id', 'pgrid')}"""


@query("cloud_mask", oracle(CHANGE, f"WITH {KERNELS}, {SIGNALS}, {CLOUDS} SELECT * FROM clouds"))
def cloud_mask(spark, d):
    found = signals(spark, d)
    return masks.to_pixels(change.cloud_mask(found, change.pair_shapes(found)), ["pair_id"])


MAJOR = f"""{KERNELS}, {SIGNALS}, {CLOUDS}, t0 AS MATERIALIZED (SELECT pair_id, row, col FROM sg WHERE safe AND diff > 40 EXCEPT SELECT pair_id, row, col FROM clouds),
{morph([*open_chain('t0', 't1', 'cross3', 2, 'to'), *close_chain('t1', 'changed', 'disc5', 2, 'tc')], 'pair_id', 'pgrid')}, {groups_sql('changed', 'pair_id', NEAR8)},
regions AS (SELECT pair_id, label, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS w, max(row) - min(row) + 1 AS h, count(*) AS area FROM lab GROUP BY 1, 2),
major AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY area DESC, label) AS position FROM regions WHERE area > 15000 * (64 / 512) ** 2 AND w * h / 4096 < 0.75)"""


@query("major_regions", oracle(CHANGE, f"WITH RECURSIVE {MAJOR} SELECT pair_id, position, x, y, w, h, area FROM major"))
def major_regions(spark, d):
    found = signals(spark, d)
    pair_shapes = change.pair_shapes(found)
    major = change.major_regions(found, change.cloud_mask(found, pair_shapes), pair_shapes)
    return major.select("pair_id", "position", "x", "y", "w", "h", "area")


LIN = "CASE WHEN ({0}) / 255 <= 0.04045 THEN ({0}) / 255 / 12.92 ELSE pow((({0}) / 255 + 0.055) / 1.055, 2.4) END"


def lab_sql(s: str) -> str:
    r, g, b = (LIN.format(f"{c}_{s}") for c in "rgb")
    return f"""x{s} AS (SELECT pair_id, row, col, (0.412453 * ({r}) + 0.357580 * ({g}) + 0.180423 * ({b})) / 0.950456 AS x, 0.212671 * ({r}) + 0.715160 * ({g}) + 0.072169 * ({b}) AS y, (0.019334 * ({r}) + 0.119193 * ({g}) + 0.950227 * ({b})) / 1.088754 AS z FROM sg),
f{s} AS (SELECT pair_id, row, col, y, {', '.join(f'CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16 / 116.0 END AS f{t}' for t in 'xyz')} FROM x{s}),
lab{s} AS (SELECT pair_id, row, col, (CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END) * 255 / 100 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f{s})"""


DELTAS = f"""{SIGNALS}, {lab_sql('a')}, {lab_sql('b')},
dd AS (SELECT g.pair_id, g.row, g.col, g.safe, q.l - p.l AS dl, q.a - p.a AS da, q.b - p.b AS db FROM sg g JOIN laba p ON p.pair_id = g.pair_id AND p.row = g.row AND p.col = g.col JOIN labb q ON q.pair_id = g.pair_id AND q.row = g.row AND q.col = g.col WHERE g.modality <> 'sar'),
sh AS (SELECT pair_id, median(dl) AS sl, median(da) AS sa, median(db) AS sb FROM dd WHERE safe GROUP BY 1),
de AS MATERIALIZED (SELECT d.pair_id, d.row, d.col, d.safe, sqrt((dl - sl) ** 2 + (da - sa) ** 2 + (db - sb) ** 2) AS delta FROM dd d JOIN sh ON sh.pair_id = d.pair_id),
md AS (SELECT pair_id, median(delta) AS med FROM de WHERE safe GROUP BY 1),
st AS (SELECT d.pair_id, greatest(14.0, any_value(med) + 4 * 1.4826 * median(abs(delta - med))) AS strict FROM de d JOIN md ON md.pair_id = d.pair_id WHERE safe GROUP BY 1)"""


@query("colour_deltas", oracle(CHANGE, f"WITH {DELTAS} SELECT pair_id, row, col, round(delta, 3) AS delta FROM de"))
def colour_deltas(spark, d):
    out = change.colour_deltas(signals(spark, d).where("modality <> 'sar'"))
    return out.select("pair_id", "row", "col", F.round("delta", 3).alias("delta"))


@query("subtle_thresholds", oracle(CHANGE, f"WITH {DELTAS} SELECT pair_id, round(strict + 1e-9, 4) AS strict FROM st"))
def subtle_thresholds(spark, d):
    return change.subtle_thresholds(change.colour_deltas(signals(spark, d).where("modality <> 'sar'"))).select("pair_id", *r4("strict"))


SUBTLE = f"""{MAJOR}, {DELTAS[len(SIGNALS) + 2:]},
usable AS MATERIALIZED (SELECT d.pair_id, d.row, d.col, delta, strict FROM de d JOIN st ON st.pair_id = d.pair_id ANTI JOIN clouds c ON c.pair_id = d.pair_id AND c.row = d.row AND c.col = d.col WHERE d.safe),
sds AS MATERIALIZED (SELECT pair_id, row, col FROM usable WHERE delta > strict), lse AS MATERIALIZED (SELECT pair_id, row, col FROM usable WHERE delta > strict * 0.7),
{groups_sql('lse', 'pair_id', NEAR8, 'l')},
okl AS (SELECT l.pair_id, l.label FROM labl l LEFT JOIN sds s ON s.pair_id = l.pair_id AND s.row = l.row AND s.col = l.col GROUP BY 1, 2 HAVING count(s.row) > 0 AND count(*) <= 3 * count(s.row)),
u0 AS MATERIALIZED (SELECT l.pair_id, l.row, l.col FROM labl l JOIN okl ON okl.pair_id = l.pair_id AND okl.label = l.label UNION SELECT pair_id, row, col FROM sds),
{morph([*open_chain('u0', 'u1', 'cross3', 2, 'uo'), *close_chain('u1', 'uc', 'disc5', 2, 'ux')], 'pair_id', 'pgrid')}, {groups_sql('uc', 'pair_id', NEAR8, 's')},
sreg AS (SELECT pair_id, label, min(col) AS x, min(row) AS y, max(col) - min(col) + 1 AS w, max(row) - min(row) + 1 AS h, count(*) AS area FROM labs GROUP BY 1, 2),
subt AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY area DESC, label) AS position FROM sreg s WHERE area > 15000 * (64 / 512) ** 2 * 0.4 AND w * h / 4096 < 0.75
  AND NOT EXISTS (SELECT 1 FROM major m WHERE m.pair_id = s.pair_id AND s.x + s.w / 2 BETWEEN m.x AND m.x + m.w AND s.y + s.h / 2 BETWEEN m.y AND m.y + m.h)),
both_kinds AS (SELECT 0 AS k, 'major' AS kind, pair_id, position, x, y, w, h, area FROM major UNION ALL SELECT 1, 'possible', pair_id, position, x, y, w, h, area FROM subt WHERE position <= 4)"""


@query(
    "change_items",
    oracle(
        CHANGE,
        f"WITH RECURSIVE {SUBTLE} SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY k, position) AS region_no, kind, x, y, w, h, round(area / 4096, 6) AS frac FROM both_kinds",
    ),
)
def change_items(spark, d):
    """The whole pipeline: major and subtle regions of every pair in one list."""
    _, items = change.detect(joined(spark, d))
    return items.select("pair_id", "region_no", "kind", "x", "y", "w", "h", F.round("frac", 6).alias("frac"))


@query(
    "transform_judgements",
    oracle(
        "transforms",
        """SELECT pair_id, CASE WHEN m00 IS NULL THEN 'no valid matrix' WHEN inliers < 12 THEN 'only ' || inliers || ' inliers' WHEN abs(sqrt(m00 * m00 + m10 * m10) - 1) > 0.15 THEN 'implausible scale'
  WHEN abs(degrees(atan2(m10, m00))) > 10 THEN 'implausible rotation' WHEN abs(m02) > 75 OR abs(m12) > 75 THEN 'implausible translation' END AS reason FROM transforms""",
    ),
)
def transform_judgements(spark, d):
    return change.judge_transforms(bind(spark, d, "transforms")).select("pair_id", "reason")


@query(
    "best_matches",
    oracle(
        "matches",
        "WITH m AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY distance, match_id) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM matches) SELECT pair_id, match_id FROM m WHERE rn <= floor(n * 0.15)",
    ),
)
def best_matches(spark, d):
    return change.best_matches(bind(spark, d, "matches")).select("pair_id", "match_id")


# ------------------------------------------------------------------ fusion and regridding


def fusion_input(spark, d):
    a, b = pixels(spark, d), pixels(spark, d)
    optical = a.where("scene_id % 2 = 0").select(F.floor(F.col("scene_id") / 2).alias("pair_id"), "row", "col", "r", "g", "b", "height", "width")
    radar = b.where("scene_id % 2 = 1").select(F.floor(F.col("scene_id") / 2).alias("pair_id"), "row", "col", F.col("r").alias("sar"), "valid")
    return optical.join(radar, ["pair_id", "row", "col"])


FUSED = f"""fj AS MATERIALIZED (SELECT s.pair_id, a.row, a.col, a.r, a.g, a.b, b.r AS sar0, b.valid FROM scene_pairs s JOIN pixels a ON a.scene_id = s.scene_a JOIN pixels b ON b.scene_id = s.scene_b AND b.row = a.row AND b.col = a.col),
pb AS (SELECT pair_id, quantile_cont(sar0, 0.02) AS lo, quantile_cont(sar0, 0.98) AS hi FROM fj WHERE valid GROUP BY 1),
nm AS MATERIALIZED (SELECT fj.pair_id, row, col, floor(least(greatest((sar0 - lo) / (hi - lo + 1e-5) * 255, 0), 255)) AS sar FROM fj JOIN pb ON pb.pair_id = fj.pair_id),
{blur_sql('nm', 'pair_id', ['sar'], 7, 'fb', sigma=1.0)},
o9 AS (SELECT a.dy, b.dx, exp(-(dy * dy + dx * dx) / (2 * 3.0 * 3.0)) AS w FROM range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE dy * dy + dx * dx <= 16),
nb AS (SELECT p.pair_id, p.row, p.col, q.sar AS v, o9.w * exp(-((q.sar - p.sar) ** 2) / (2 * 40.0 * 40.0)) AS w FROM fb p, o9 JOIN fb q ON q.pair_id = p.pair_id AND q.row = {mirror('p.row + o9.dy', False)} AND q.col = {mirror('p.col + o9.dx', False)}),
sm AS MATERIALIZED (SELECT pair_id, row, col, sum(v * w) / sum(w) AS s FROM nb GROUP BY 1, 2, 3),
ce AS (SELECT f.pair_id, median(s.s) AS centre FROM fj f JOIN sm s ON s.pair_id = f.pair_id AND s.row = f.row AND s.col = f.col WHERE f.valid GROUP BY 1),
vv AS (SELECT f.*, greatest(r, g, b) AS top, floor(least(greatest(greatest(r, g, b) + CASE WHEN valid THEN 0.7 * (s.s - centre) ELSE 0 END, 0), 255)) AS v FROM fj f JOIN sm s ON s.pair_id = f.pair_id AND s.row = f.row AND s.col = f.col JOIN ce ON ce.pair_id = f.pair_id)"""


@query(
    "fused_scenes",
    oracle(CHANGE, f"WITH {FUSED} SELECT pair_id, row, col, {', '.join(f'CAST(round_even(CASE WHEN top > 0 THEN {c} * v / top ELSE v END, 0) AS INT) AS {c}' for c in 'rgb')} FROM vv"),
)
def fused_scenes(spark, d):
    return fusion.fuse(fusion_input(spark, d))


@query(
    "rescaled_optical",
    oracle("pixels", "WITH k AS (SELECT scene_id, max(greatest(r, g, b)) * 16 AS peak FROM pixels GROUP BY 1) SELECT p.scene_id, row, col, CAST(floor(r * 16 / peak * 255) AS INT) AS r FROM pixels p JOIN k ON k.scene_id = p.scene_id"),
)
def rescaled_optical(spark, d):
    deep = pixels(spark, d).withColumns({c: F.col(c) * 16 for c in "rgb"})
    return fusion.to_eight_bit(deep).select("scene_id", "row", "col", "r")


def grids(spark, d):
    return bind(spark, d, "scene_pairs").select(
        "pair_id",
        *[F.lit(v).alias(n) for n, v in {"a_x": 35.0, "a_y": -35.0, "a_res": 10.0, "a_height": SIDE, "a_width": SIDE, "b_x": 0.0, "b_y": 0.0, "b_res": 10.0, "b_height": SIDE, "b_width": SIDE}.items()],
    )


def regrid_source(spark, d):
    after = pixels(spark, d).where("scene_id % 2 = 1")
    return after.select(F.floor(F.col("scene_id") / 2).alias("pair_id"), "row", "col", F.col("r").alias("value"), "valid")


RGRID = "c AS (SELECT s.pair_id, s.scene_b, CAST(a.t AS INT) AS row, CAST(b.t AS INT) AS col FROM scene_pairs s, range(64) a(t), range(64) b(t))"


@query(
    "regrid_bilinear",
    oracle(
        CHANGE,
        f"""WITH {RGRID}, w AS (SELECT c.pair_id, c.row, c.col, p.r, 1.0 AS wt FROM c, (VALUES (3), (4)) i(dr), (VALUES (3), (4)) j(dc) JOIN pixels p ON p.scene_id = c.scene_b AND p.row = c.row + i.dr AND p.col = c.col + j.dc AND p.valid WHERE c.row + 4 < 64 AND c.col + 4 < 64)
SELECT c.pair_id, c.row, c.col, round(avg(w.r) + 1e-9, 4) AS value FROM c LEFT JOIN (SELECT * FROM w UNION ALL SELECT c.pair_id, c.row, c.col, p.r, 1.0 FROM c, (VALUES (3), (4)) i(dr), (VALUES (3), (4)) j(dc) JOIN pixels p ON p.scene_id = c.scene_b AND p.row = c.row + i.dr AND p.col = c.col + j.dc AND p.valid
  WHERE c.row + 4 >= 64 AND c.row + 4.0 < 64 AND c.col + 4.0 < 64) w ON w.pair_id = c.pair_id AND w.row = c.row AND w.col = c.col GROUP BY 1, 2, 3""",
    ),
)
def regrid_bilinear(spark, d):
    return regrid.regrid(grids(spark, d), regrid_source(spark, d)).withColumn("value", F.round(F.col("value") + 1e-9, 4))


@query(
    "regrid_nearest",
    oracle(CHANGE, f"WITH {RGRID} SELECT c.pair_id, c.row, c.col, p.r AS value FROM c LEFT JOIN pixels p ON p.scene_id = c.scene_b AND p.row = c.row + 4 AND p.col = c.col + 4 AND p.valid"),
)
def regrid_nearest(spark, d):
    return regrid.regrid(grids(spark, d), regrid_source(spark, d), "nearest")


# ------------------------------------------------------------------ answers


def answer_items(spark, d):
    """Every part that is no pair is an item; of each ten groups of parts one goes to a pair of another number, so some pairs have none."""
    p = F.col("p_partkey")
    group = F.ceil(p / 8)
    return table(spark, d, "part").where(p % 8 != 0).select(
        F.when(group % 10 == 3, group - 1).otherwise(group).alias("pair_id"), p.alias("region_no"), F.when(p % 3 == 0, "major").otherwise("possible").alias("kind"), F.lit("centre").alias("place"),
        (F.col("p_size") / 200).alias("frac"),
        F.when(p % 5 == 0, F.array(F.lit("mining"))).when(p % 5 == 1, F.array(F.lit("mining"), F.lit("agriculture"))).otherwise(F.array().cast("array<string>")).alias("scans"),
        F.when(p % 7 == 0, F.concat(F.lit("Green "), F.col("p_name"), F.lit("."))).alias("before"),
        F.when(p % 7 == 0, "").otherwise(None).alias("after"),
        F.when(p % 2 == 0, F.concat(F.lit("bright pixels 1% -> "), F.col("p_size").cast("string"), F.lit("%"))).otherwise("").alias("measured"),
    )


def answer_pairs(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").where(p % 8 == 0).select(
        F.floor(p / 8).alias("pair_id"),
        F.filter(F.array(F.when(p % 16 == 0, "Different zoom."), F.lit("")), lambda w: w.isNotNull() & (w != "")).alias("warnings"),
        F.when(p % 24 == 0, "how many trucks are visible?").otherwise("what changed?").alias("user_query"),
        F.when(p % 32 == 0, "").otherwise("dark pixels up (1% -> 9%).").alias("measured_facts"),
        F.when(p % 40 == 0, "sar").otherwise("optical").alias("modality"),
        F.when(p % 48 == 0, "2020-01-01").alias("before_date"), F.when(p % 48 == 0, "2021-01-01").alias("after_date"),
    )


ITEMS = """it AS (SELECT (ceil(p_partkey / 8) - CASE WHEN ceil(p_partkey / 8) % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS pair_id, p_partkey AS no, CASE WHEN p_partkey % 3 = 0 THEN 'Major change' WHEN p_partkey % 5 < 2 THEN 'Likely change' ELSE 'Possible smaller change' END AS label,
  round_even(p_size / 200 * 100, 0)::INT AS pct, CASE p_partkey % 5 WHEN 0 THEN 'the mining scan' WHEN 1 THEN 'the mining and agriculture scans' END AS scans, p_partkey % 7 = 0 AS noted, p_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'bright pixels 1% -> ' || p_size || '%' ELSE '' END AS measured, p_partkey % 3 = 0 AS major FROM part WHERE p_partkey % 8 <> 0),
pr AS (SELECT floor(p_partkey / 8)::BIGINT AS pair_id, p_partkey % 16 = 0 AS warned, p_partkey % 24 = 0 AS asked, p_partkey % 32 <> 0 AS facts, p_partkey % 40 = 0 AS sar, p_partkey % 48 = 0 AS dated FROM part WHERE p_partkey % 8 = 0)"""
ANSWER = f"""{ITEMS}, ln AS (SELECT i.pair_id, string_agg('- ' || label || ', centre (~' || pct || '% of the scene).' || coalesce(' Also flagged by ' || scans || '.', '')
  || CASE WHEN noted THEN chr(10) || '    Before: Green ' || p_name || '.' || chr(10) || '    After: not described' ELSE '' END
  || CASE WHEN measured <> '' THEN chr(10) || '    Measured: ' || measured || '.' || CASE WHEN warned THEN ' This may reflect the two images differing in source, not the ground.' ELSE '' END ELSE '' END, chr(10) ORDER BY no) AS t
  FROM it i JOIN pr ON pr.pair_id = i.pair_id GROUP BY 1),
an AS (SELECT pr.pair_id, CASE WHEN warned THEN 'WARNING: Different zoom.' || chr(10) || chr(10) ELSE '' END || 'Changed areas' || chr(10)
  || coalesce(t, CASE WHEN warned THEN '- No changed area was flagged, but the warning above means this is NOT evidence that nothing changed.' ELSE '- No changed area was found.' END)
  || CASE WHEN asked THEN chr(10) || chr(10) || 'Your question (how many trucks are visible?) is not answered separately in comparison mode. Ask about one image in the Assistant panel for follow-up questions.' ELSE '' END AS answer FROM pr LEFT JOIN ln ON ln.pair_id = pr.pair_id)"""


def answers(spark, d):
    return change.compose_answers(answer_pairs(spark, d), answer_items(spark, d))


@query("change_answers", oracle("", f"WITH {ANSWER} SELECT pair_id, answer FROM an"))
def change_answers(spark, d):
    return answers(spark, d)


@query(
    "parsed_answers",
    oracle(
        "",
        f"""WITH {ITEMS}, o AS (SELECT i.*, row_number() OVER (PARTITION BY i.pair_id ORDER BY no) AS k, warned FROM it i JOIN pr ON pr.pair_id = i.pair_id)
SELECT pair_id, 'area' AS part, k AS item_no, CASE label WHEN 'Major change' THEN 'major' WHEN 'Likely change' THEN 'likely' ELSE 'possible' END AS kind, 'centre' AS place, pct AS size_pct,
  coalesce(replace(replace(replace(replace(scans, 'the ', ''), ' scans', ''), ' scan', ''), ' and ', ','), '') AS scans, CASE WHEN noted THEN 'Green ' || p_name || '.' ELSE '' END AS before, CASE WHEN noted THEN 'not described' ELSE '' END AS after,
  CASE WHEN measured = '' THEN '' ELSE measured || '.' || CASE WHEN warned THEN ' This may reflect the two images differing in source, not the ground.' ELSE '' END END AS measured, NULL AS text FROM o
UNION ALL SELECT pair_id, 'warning', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Different zoom.' FROM pr WHERE warned
UNION ALL SELECT pair_id, 'footer', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Your question (how many trucks are visible?) is not answered separately in comparison mode. Ask about one image in the Assistant panel for follow-up questions.' FROM pr WHERE asked
UNION ALL SELECT pair_id, 'note', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN warned THEN 'No changed area was flagged, but the warning above means this is NOT evidence that nothing changed.' ELSE 'No changed area was found.' END FROM pr WHERE pair_id NOT IN (SELECT pair_id FROM it)""",
    ),
)
def parsed_answers(spark, d):
    parsed = change.parse_answers(answers(spark, d))
    scans = F.when(F.col("part") == "area", F.array_join("scans", ","))
    return parsed.select("pair_id", "part", "item_no", "kind", "place", "size_pct", scans.alias("scans"), "before", "after", "measured", "text")


DETAILS = """sc AS (SELECT pair_id FROM pr WHERE pair_id % 2 = 0), b AS (SELECT i.* FROM it i JOIN sc ON sc.pair_id = i.pair_id),
l AS (SELECT pair_id, 'How this was produced' AS section, 0 AS line_no, 'Assembled by code from pixel measurements, flagged regions, LoRA scan scores and single-image model captions of the flagged regions. The model did not write the conclusion, so nothing in the answer is guessed about change.' AS line FROM pr
UNION ALL SELECT pair_id, 'Image order', 0, CASE WHEN dated THEN 'Before: captured 2020-01-01. After: captured 2021-01-01.' ELSE 'First image treated as BEFORE, second as AFTER (as uploaded). Capture dates are unknown, so no time span is stated.' END FROM pr
UNION ALL SELECT pair_id, 'Measured overall shift', 0, 'Pixel counts, not materials: dark pixels up (1% -> 9%).' FROM pr WHERE facts
UNION ALL SELECT pair_id, 'Measured overall shift', 1, 'Because of the warning(s), these shifts may reflect the two images differing in source, zoom, haze or exposure rather than a change on the ground.' FROM pr WHERE facts AND warned
UNION ALL SELECT pair_id, 'Flagged regions', no, label || ', centre (~' || pct || '% of the scene)' || CASE WHEN measured <> '' THEN ': ' || measured || ' (pixel counts, not materials)' ELSE '' END FROM it
UNION ALL (SELECT DISTINCT pair_id, 'Flagged regions', 1000000, '''Possible'' and ''Likely'' areas are subtler colour differences after removing the overall shift; ''Likely'' means a specialist scan also flagged the same place. They can also be lighting or season.' FROM it WHERE NOT major)
UNION ALL SELECT pair_id, 'Specialist scans on both dates', 0, 'LoRA adapter scores over a 4x4 grid. WEAK evidence: accuracy is not validated, and a scan that is already positive on many tiles separates the dates poorly.' FROM sc
UNION ALL SELECT pair_id, 'Specialist scans on both dates', 1, 'mining: 1 of 16 tiles positive before' FROM sc
UNION ALL SELECT pair_id, 'Agreement between scans and flagged regions', no, 'centre: ' || scans || ' also turned positive on a tile overlapping this area.' FROM b WHERE scans IS NOT NULL
UNION ALL SELECT pair_id, 'Agreement between scans and flagged regions', 0, 'No scan flip overlaps a flagged region, so nothing independently backs the flagged areas.' FROM b GROUP BY pair_id HAVING count(scans) = 0
UNION ALL SELECT pair_id, 'SAR note', 0, 'Brightness is backscatter, not colour; the colour-based measures are omitted.' FROM pr WHERE sar)"""


@query("answer_details", oracle("", f"WITH {ITEMS}, {DETAILS} SELECT pair_id, section, line_no, line FROM l"))
def answer_details(spark, d):
    pairs = answer_pairs(spark, d)
    lines = pairs.where("pair_id % 2 = 0").select("pair_id", F.lit(0).alias("scan_order"), F.lit("mining: 1 of 16 tiles positive before").alias("line"))
    return change.compose_details(pairs, answer_items(spark, d), lines)


@query(
    "merged_warnings",
    oracle(
        "",
        "SELECT o_orderkey AS k, concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN 'order' END, CASE WHEN o_orderkey % 5 = 0 THEN 'bands' END, CASE WHEN o_orderkey % 7 = 0 THEN 'detail' END) AS warnings FROM orders",
    ),
)
def merged_warnings(spark, d):
    k = F.col("o_orderkey")
    stage = lambda m, word: F.array(F.when(k % m == 0, word).otherwise(""))
    merged = change.merge_warnings(stage(3, "order"), F.when(k % 5 == 0, F.array(F.lit("bands"), F.lit(None))), stage(7, "detail"))
    return table(spark, d, "orders").select(k.alias("k"), F.array_join(merged, "|").alias("warnings"))


@query(
    "note_crops",
    oracle(
        "boxes",
        """SELECT pair_id, k AS region_no, greatest(0, x - floor(w * 0.15)::INT) AS "left", greatest(0, y - floor(h * 0.15)::INT) AS top, least(width, x + w + floor(w * 0.15)::INT) AS "right", least(height, y + h + floor(h * 0.15)::INT) AS bottom
FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY w * h DESC, region_no) AS k FROM boxes) WHERE k <= 3""",
    ),
)
def note_crops(spark, d):
    boxes = bind(spark, d, "boxes").select("pair_id", F.col("region_no").alias("label"), "x", "y", "w", "h", "width", "height", (F.col("w") * F.col("h")).alias("area"))
    return change.note_crops(change.rank_regions(boxes).withColumnRenamed("position", "region_no"))


@query(
    "region_items",
    oracle(
        "boxes",
        """WITH m AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY w * h DESC, region_no) AS pos FROM boxes WHERE region_no % 3 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY w * h DESC, region_no) AS pos FROM boxes WHERE region_no % 3 <> 0),
u AS (SELECT 0 AS k, * FROM m UNION ALL SELECT 1, * FROM s WHERE pos <= 4), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k, pos) AS item_no, least(2, floor(3 * (x + w / 2) / 400))::INT AS c, least(2, floor(3 * (y + h / 2) / 400))::INT AS r FROM u)
SELECT pair_id, item_no, CASE k WHEN 0 THEN 'major' ELSE 'possible' END AS kind, CASE WHEN r = 1 AND c = 1 THEN 'centre' WHEN r = 1 THEN ['left', 'centre', 'right'][c + 1] ELSE ['upper', 'middle', 'lower'][r + 1] || '-' || ['left', 'centre', 'right'][c + 1] END AS place, x, y FROM n""",
    ),
)
def region_items(spark, d):
    boxes = bind(spark, d, "boxes").withColumns({"label": F.col("region_no"), "area": F.col("w") * F.col("h"), "frac": F.lit(0.1)})
    major = change.rank_regions(boxes.where("region_no % 3 = 0"))
    subtle = change.rank_regions(boxes.where("region_no % 3 <> 0"), change.MAX_SUBTLE_REGIONS)
    items = change.region_items(major, subtle)
    return items.select("pair_id", F.col("region_no").alias("item_no"), "kind", "place", "x", "y")
