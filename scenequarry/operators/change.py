"""Before / after change over all pairs at once: signals, major and subtle regions, answers and their parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.functions import language as L
from scenequarry.functions.colour import gray, lab
from scenequarry.functions.places import location_word
from scenequarry.operators import masks, spatial
from scenequarry.operators.joins import join_small
from scenequarry.operators.ranking import SKETCH_ACCURACY, bucketed_row_number, exact_percentiles
from scenequarry.operators.rasters import erode_valid, gaussian_blur
from scenequarry.session import cut_lineage

# --- Fixed values: kernels, thresholds, limits and sentences. ---
REFERENCE_SIDE = 512
MIN_REGION_AREA = 15000
MAX_BOX_SHARE = 0.75
BLUR, NOISE, CLOSE, CLOUD = 21, 11, 35, 21
CLOUD_GRAY = 200
CHANGE_GRAY = 40
SUBTLE_MIN_DELTA, SUBTLE_AREA_FACTOR, SUBTLE_LOW_FACTOR, SUBTLE_MAX_GROWTH = 14.0, 0.4, 0.7, 3.0
MAX_SUBTLE_REGIONS = 4
MAD_TO_SIGMA = 1.4826
MAX_REGION_NOTES, REGION_PAD = 3, 0.15
MIN_INLIERS, MAX_SCALE_DEVIATION, MAX_ROTATION_DEG, MAX_SHIFT_SHARE = 12, 0.15, 10.0, 0.25
MATCH_SHARE = 0.15
AREAS_HEADING = "Changed areas"
KIND_WORDS = {"Major change": "major", "Likely change": "likely", "Possible smaller change": "possible"}
AREA_LINE = (
    r"^- (Major change|Likely change|Possible smaller change), (.+?) \(~(\d+)% of the scene\)\."
    r"(?: Also flagged by (.+)\.)?\s*$"
)
FIELD_LINE = r"^\s+(Before|After|Measured):\s*(.*)$"
# --- End of fixed values. ---

PAIR = ["pair_id"]
COLOURS = [f"{c}_{s}" for s in "ab" for c in "rgb"]


def join_dates(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Both dates of each pair pixel by pixel; a pixel counts only where both dates hold real data.

    pairs(pair_id, scene_a, scene_b, modality), pixels(scene_id, row, col, r, g, b, valid, height, width).
    """
    a = pixels.select(
        F.col("scene_id").alias("scene_a"), "row", "col", "height", "width",
        *[F.col(c).alias(f"{c}_a") for c in "rgb"], F.col("valid").alias("_va"),
    )
    b = pixels.select(
        F.col("scene_id").alias("scene_b"), "row", "col", *[F.col(c).alias(f"{c}_b") for c in "rgb"], F.col("valid").alias("_vb")
    )
    joined = join_small(a, pairs, ["scene_a"]).join(b, ["scene_b", "row", "col"])
    return joined.withColumn("valid", F.col("_va") & F.col("_vb")).drop("_va", "_vb", "scene_a", "scene_b")


def blur_size(height: Column, width: Column) -> Column:
    """The blur kernel of a scene size: it only grows with the scene, noise does not shrink with it."""
    scale = F.sqrt(height.cast("double") * width) / REFERENCE_SIDE
    size = F.greatest(F.lit(3), F.bround(BLUR * F.greatest(scale, F.lit(1.0))).cast("int"))
    return size + 1 - size % 2


def cloud_flag(modality: Column, gray_a: Column, gray_b: Column) -> Column:
    """Bright on either date; radar brightness is no cloud."""
    return (modality != "sar") & (F.greatest(gray_a, gray_b) > CLOUD_GRAY)


def pair_signals(joined: DataFrame) -> DataFrame:
    """(pair_id, row, col, height, width, modality, diff, cloud, safe, d_l, d_a, d_b) for pairs of all sizes.

    Gray is linear in the channels, so blurring the six channels once serves the gray and the colour difference.
    """
    flagged = joined.withColumn(
        "cloud",
        cloud_flag(
            F.col("modality"),
            gray(F.col("r_a"), F.col("g_a"), F.col("b_a")),
            gray(F.col("r_b"), F.col("g_b"), F.col("b_b")),
        ),
    )
    size = blur_size(F.col("height"), F.col("width"))
    blurred = gaussian_blur(flagged, PAIR, COLOURS, size)
    safe = erode_valid(blurred, PAIR, "valid", size + 2)
    before, after = ([F.col(f"{c}_{s}") for c in "rgb"] for s in "ab")
    lab_before, lab_after = lab(*before), lab(*after)
    return safe.select(
        *PAIR, "row", "col", "height", "width", "modality", "cloud", F.col("valid").alias("safe"),
        F.abs(gray(*before) - gray(*after)).alias("diff"),
        *[(y - x).alias(f"d_{n}") for n, x, y in zip("lab", lab_before, lab_after)],
    )


def pair_shapes(signals: DataFrame) -> DataFrame:
    return signals.groupBy("pair_id").agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.max("modality").alias("modality")
    )


def cloud_mask(signals: DataFrame, shapes: DataFrame) -> DataFrame:
    """Bright patches bigger than the kernel, grown twice; specks of pale ground do not survive the opening."""
    kernel = masks.odd_kernel(CLOUD, masks.scene_scale())
    bright = masks.to_runs(signals, PAIR, F.col("cloud"))
    grown = masks.opened(bright, shapes, PAIR, kernel)
    for _ in range(2):
        grown = masks.dilate(grown, PAIR, kernel)
    return grown


def change_mask(signals: DataFrame, clouds: DataFrame, shapes: DataFrame) -> DataFrame:
    """Strong blurred differences outside clouds and unsafe borders."""
    strong = masks.to_runs(signals, PAIR, F.col("safe") & (F.col("diff") > CHANGE_GRAY))
    return cut_lineage(masks.subtract(strong, clouds, shapes, PAIR))


def clean_mask(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Noise removed by opening, holes and gaps bridged by closing, both twice."""
    scale = masks.scene_scale()
    quiet = cut_lineage(masks.opened(runs, shapes, PAIR, masks.odd_kernel(NOISE, scale), times=2))
    return masks.closed(quiet, shapes, PAIR, masks.odd_kernel(CLOSE, scale), times=2)


def mask_regions(runs: DataFrame, area_factor: float = 1.0) -> DataFrame:
    """Groups large enough for their scene whose box does not cover most of it."""
    groups = masks.group_measures(masks.label_runs(runs, PAIR), PAIR)
    scale = masks.scene_scale()
    share = F.col("w").cast("long") * F.col("h") / (F.col("width").cast("long") * F.col("height"))
    return groups.where((F.col("area") > MIN_REGION_AREA * area_factor * scale * scale) & (share < MAX_BOX_SHARE))


def rank_regions(regions: DataFrame, limit: int | None = None) -> DataFrame:
    """Numbers regions by area within their pair, largest first; optionally only the first ``limit``."""
    largest = Window.partitionBy("pair_id").orderBy(F.desc("area"), "label")
    ranked = regions.withColumn("position", F.row_number().over(largest))
    return ranked.where(F.col("position") <= limit) if limit else ranked


def major_regions(signals: DataFrame, clouds: DataFrame, shapes: DataFrame) -> DataFrame:
    changed = cut_lineage(clean_mask(change_mask(signals, clouds, shapes), shapes))
    return rank_regions(mask_regions(changed))


def colour_deltas(signals: DataFrame) -> DataFrame:
    """Adds ``delta``: colour difference after removing the pair's median shift over safe pixels.

    The result feeds several passes (two more medians and two thresholds), so it is written once.
    """
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"d_{c}").alias("value")) for c in "lab"])
    long = signals.where("safe").select("pair_id", F.explode(channels).alias("s")).select("pair_id", "s.*")
    shift = exact_percentiles(long, ["pair_id", "channel"], "value", {"shift": 0.5})
    wide = shift.groupBy("pair_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("shift"))).alias(f"_s_{c}") for c in "lab"])
    squares = [F.pow(F.col(f"d_{c}") - F.col(f"_s_{c}"), 2) for c in "lab"]
    shifted = join_small(signals, wide, PAIR).withColumn("delta", F.sqrt(squares[0] + squares[1] + squares[2]))
    return cut_lineage(shifted.drop("_s_l", "_s_a", "_s_b"))


def subtle_thresholds(deltas: DataFrame) -> DataFrame:
    """(pair_id, strict): median + 4 robust deviations of the safe deltas, at least the fixed minimum."""
    safe = deltas.where("safe").select("pair_id", "delta")
    middle = exact_percentiles(safe, PAIR, "delta", {"_med": 0.5})
    away = join_small(safe, middle, PAIR).select("pair_id", F.abs(F.col("delta") - F.col("_med")).alias("away"))
    spread = exact_percentiles(away, PAIR, "away", {"_mad": 0.5})
    strict = F.greatest(F.lit(SUBTLE_MIN_DELTA), F.col("_med") + 4 * MAD_TO_SIGMA * F.col("_mad"))
    return middle.join(spread, "pair_id").select("pair_id", strict.alias("strict"))


def subtle_regions(signals: DataFrame, clouds: DataFrame, shapes: DataFrame, major: DataFrame) -> DataFrame:
    """Smaller local colour changes of optical pairs outside major boxes, at most four per pair after filtering."""
    deltas = colour_deltas(signals.where(F.col("modality") != "sar"))
    marked = join_small(deltas, subtle_thresholds(deltas), PAIR)
    optical = shapes.where(F.col("modality") != "sar")
    hazy = clouds.join(optical.select("pair_id"), "pair_id", "left_semi")
    seeds = masks.to_runs(marked, PAIR, F.col("safe") & (F.col("delta") > F.col("strict")))
    loose = masks.to_runs(marked, PAIR, F.col("safe") & (F.col("delta") > F.col("strict") * SUBTLE_LOW_FACTOR))
    seeds, loose = (cut_lineage(masks.subtract(m, hazy, optical, PAIR)) for m in (seeds, loose))
    grown = masks.grow_seeds(loose, seeds, PAIR, SUBTLE_MAX_GROWTH)
    cleaned = cut_lineage(clean_mask(grown, optical))
    found = mask_regions(cleaned, SUBTLE_AREA_FACTOR)
    return rank_regions(spatial.outside_major(found, major), MAX_SUBTLE_REGIONS)


def region_items(major: DataFrame, subtle: DataFrame) -> DataFrame:
    """Major then possible regions of each pair in one numbered list with a location word."""
    columns = ["pair_id", "position", "x", "y", "w", "h", "frac", "height", "width"]
    both = major.select(*columns, F.lit("major").alias("kind"), F.lit(0).alias("_k")).unionByName(
        subtle.select(*columns, F.lit("possible").alias("kind"), F.lit(1).alias("_k"))
    )
    place = location_word(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("width"), F.col("height"))
    order = Window.partitionBy("pair_id").orderBy("_k", "position")
    return both.withColumn("region_no", F.row_number().over(order)).withColumn("place", place).drop("_k", "position")


def detect(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, items): the whole change pipeline, for pairs of all sizes at once."""
    signals = cut_lineage(pair_signals(joined))
    shapes = pair_shapes(signals)
    clouds = cut_lineage(cloud_mask(signals, shapes))
    major = cut_lineage(major_regions(signals, clouds, shapes))
    return signals, region_items(major, subtle_regions(signals, clouds, shapes, major))


def merge_warnings(*stages: Column) -> Column:
    """The warnings of several stages in order, without blanks."""
    empty = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(stage, empty) for stage in stages])
    return F.filter(merged, lambda w: F.coalesce(w, F.lit("")) != "")


def note_crops(items: DataFrame) -> DataFrame:
    """The padded crop boxes of the first regions of each pair, which get before and after captions."""
    pad = lambda side: F.floor(F.col(side) * F.lit(REGION_PAD)).cast("int")
    return items.where(F.col("region_no") <= MAX_REGION_NOTES).select(
        "pair_id", "region_no",
        F.greatest(F.lit(0), F.col("x") - pad("w")).alias("left"), F.greatest(F.lit(0), F.col("y") - pad("h")).alias("top"),
        F.least("width", F.col("x") + F.col("w") + pad("w")).alias("right"),
        F.least("height", F.col("y") + F.col("h") + pad("h")).alias("bottom"),
    )


# ------------------------------------------------------------------ estimated transforms


def judge_transforms(transforms: DataFrame) -> DataFrame:
    """Adds ``reason``: the first plausibility rule a 2x3 transform breaks, null when it may be used.

    transforms(pair_id, m00, m01, m02, m10, m11, m12, inliers, height, width).
    """
    scale = F.hypot("m00", "m10")
    rotation = F.abs(F.degrees(F.atan2(F.col("m10"), F.col("m00"))))
    shifted = (F.abs("m02") > MAX_SHIFT_SHARE * F.col("width")) | (F.abs("m12") > MAX_SHIFT_SHARE * F.col("height"))
    return transforms.withColumn(
        "reason",
        F.when(F.col("m00").isNull() | F.col("inliers").isNull(), "no valid matrix")
        .when(F.col("inliers") < MIN_INLIERS, F.format_string("only %d inliers", "inliers"))
        .when(F.abs(scale - 1) > MAX_SCALE_DEVIATION, "implausible scale")
        .when(rotation > MAX_ROTATION_DEG, "implausible rotation")
        .when(shifted, "implausible translation"),
    )


def best_matches(matches: DataFrame, buckets: int = 64) -> DataFrame:
    """The closest 15% of each pair's matches(pair_id, match_id, distance).

    Distances are cut into buckets at a sketch's quantiles of their pair, so a pair with very many matches is ranked in windows of
    about a ``buckets``-th of them, whatever the distances are.
    """
    shares = [k / buckets for k in range(1, buckets)]
    per_pair = matches.groupBy("pair_id").agg(
        F.floor(F.count(F.lit(1)) * F.lit(MATCH_SHARE)).alias("_keep"), F.percentile_approx("distance", shares, SKETCH_ACCURACY).alias("_edges")
    )
    marked = join_small(matches, per_pair, PAIR)
    bucketed = marked.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("distance")))).drop("_edges")
    ranked = bucketed_row_number(bucketed, PAIR, "_b", ["distance", "match_id"], "rank")
    return ranked.where(F.col("rank") <= F.col("_keep")).drop("_b", "_keep")


# ------------------------------------------------------------------ answers


def item_label(kind: Column, scans: Column) -> Column:
    return F.when(kind == "major", "Major change").when(F.size(scans) > 0, "Likely change").otherwise("Possible smaller change")


def scan_names(scans: Column) -> Column:
    several = F.concat(
        F.lit("the "), F.array_join(F.slice(scans, F.lit(1), F.greatest(F.size(scans) - 1, F.lit(0))), ", "), F.lit(" and "),
        F.get(scans, F.size(scans) - 1), F.lit(" scans"),
    )
    return F.when(F.size(scans) == 1, F.concat(F.lit("the "), F.get(scans, F.lit(0)), F.lit(" scan"))).when(F.size(scans) > 1, several)


def area_share(frac: Column) -> Column:
    return F.concat(F.lit("(~"), F.bround(frac * 100).cast("int").cast("string"), F.lit("% of the scene)"))


def compose_answers(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(pair_id, answer): warnings, changed areas with their before / after, and the question note.

    pairs(pair_id, warnings, user_query), items(pair_id, region_no, kind, place, frac, scans, before, after, measured).
    A pair holds at most about twenty regions: each is a fixed share of its scene.
    """
    described = items.withColumns({"before": F.nullif("before", F.lit("")), "after": F.nullif("after", F.lit(""))})
    caption = lambda c: L.clip_sentence(L.clean_caption(F.coalesce(c, F.lit("not described"))))
    captions = described.withColumns(
        {"_head": item_label(F.col("kind"), F.col("scans")), "_before": caption("before"), "_after": caption("after")}
    )
    noted = F.col("before").isNotNull() | F.col("after").isNotNull()
    caveat = F.when(F.size("warnings") > 0, " This may reflect the two images differing in source, not the ground.").otherwise("")
    head = F.concat(
        F.lit("- "), F.col("_head"), F.lit(", "), F.col("place"), F.lit(" "), area_share(F.col("frac")), F.lit("."),
        F.coalesce(F.concat(F.lit(" Also flagged by "), scan_names(F.col("scans")), F.lit(".")), F.lit("")),
    )
    lines = F.array_compact(
        F.array(
            head,
            F.when(noted, F.concat(F.lit("    Before: "), F.col("_before"))),
            F.when(noted, F.concat(F.lit("    After: "), F.col("_after"))),
            F.when(F.col("measured") != "", F.concat(F.lit("    Measured: "), F.col("measured"), F.lit("."), caveat)),
        )
    )
    listed = (
        captions.join(pairs.select("pair_id", "warnings"), "pair_id")
        .groupBy("pair_id")
        .agg(F.array_sort(F.collect_list(F.struct("region_no", lines.alias("lines")))).alias("_items"))
        .select("pair_id", F.flatten(F.transform("_items", lambda i: i["lines"])).alias("_lines"))
    )
    warned = F.size("warnings") > 0
    opening = F.transform("warnings", lambda w: F.concat(F.lit("WARNING: "), w))
    nothing = F.when(
        warned, "- No changed area was flagged, but the warning above means this is NOT evidence that nothing changed."
    ).otherwise("- No changed area was found.")
    asked = F.coalesce(F.col("user_query"), F.lit(""))
    question = F.concat(
        F.lit("Your question ("), L.clip_sentence(asked, 120),
        F.lit(") is not answered separately in comparison mode. Ask about one image in the Assistant panel for follow-up questions."),
    )
    none = F.array().cast("array<string>")
    body = F.concat(
        F.when(warned, F.concat(opening, F.array(F.lit("")))).otherwise(none),
        F.array(F.lit(AREAS_HEADING)),
        F.coalesce("_lines", F.array(nothing)),
        F.when(~L.is_generic_question(asked), F.array(F.lit(""), question)).otherwise(none),
    )
    return pairs.join(listed, "pair_id", "left").select("pair_id", F.array_join(body, "\n").alias("answer"))


def compose_details(pairs: DataFrame, items: DataFrame, scan_lines: DataFrame) -> DataFrame:
    """(pair_id, section, line_no, line): the supporting data behind each answer.

    pairs(pair_id, warnings, measured_facts, modality, before_date, after_date), scan_lines(pair_id, scan_order, line).
    """
    warned = F.size("warnings") > 0
    labelled = items.withColumn("_label", item_label(F.col("kind"), F.col("scans")))
    flagged = F.concat(
        F.col("_label"), F.lit(", "), F.col("place"), F.lit(" "), area_share(F.col("frac")),
        F.when(F.col("measured") != "", F.concat(F.lit(": "), F.col("measured"), F.lit(" (pixel counts, not materials)"))).otherwise(""),
    )
    backed = F.concat(F.col("place"), F.lit(": "), scan_names(F.col("scans")), F.lit(" also turned positive on a tile overlapping this area."))

    def section(df: DataFrame, title: str, line_no: Column, line: Column) -> DataFrame:
        return df.select("pair_id", F.lit(title).alias("section"), line_no.cast("int").alias("line_no"), line.alias("line")).where("line IS NOT NULL")

    method = F.lit(
        "Assembled by code from pixel measurements, flagged regions, LoRA scan scores and single-image model captions of the "
        "flagged regions. The model did not write the conclusion, so nothing in the answer is guessed about change."
    )
    dated = F.concat(F.lit("Before: captured "), F.col("before_date"), F.lit(". After: captured "), F.col("after_date"), F.lit("."))
    undated = F.lit(
        "First image treated as BEFORE, second as AFTER (as uploaded). Capture dates are unknown, so no time span is stated."
    )
    shift_note = F.lit(
        "Because of the warning(s), these shifts may reflect the two images differing in source, zoom, haze or exposure "
        "rather than a change on the ground."
    )
    subtle_note = F.lit(
        "'Possible' and 'Likely' areas are subtler colour differences after removing the overall shift; 'Likely' means a "
        "specialist scan also flagged the same place. They can also be lighting or season."
    )
    weak = F.lit(
        "LoRA adapter scores over a 4x4 grid. WEAK evidence: accuracy is not validated, and a scan that is already positive "
        "on many tiles separates the dates poorly."
    )
    no_flip = F.lit("No scan flip overlaps a flagged region, so nothing independently backs the flagged areas.")
    first, last = F.lit(0), F.lit(1_000_000)
    measured = pairs.where(F.col("measured_facts") != "")
    scanned = scan_lines.select("pair_id").distinct()
    with_scans = labelled.join(scanned, "pair_id", "left_semi")
    per_pair = with_scans.groupBy("pair_id").agg(F.count_if(F.size("scans") > 0).alias("_backed"))
    parts = [
        section(pairs, "How this was produced", first, method),
        section(pairs, "Image order", first, F.coalesce(dated, undated)),
        section(measured, "Measured overall shift", first, F.concat(F.lit("Pixel counts, not materials: "), F.col("measured_facts"))),
        section(measured.where(warned), "Measured overall shift", F.lit(1), shift_note),
        section(labelled, "Flagged regions", F.col("region_no"), flagged),
        section(labelled.where("kind = 'possible'").select("pair_id").distinct(), "Flagged regions", last, subtle_note),
        section(scanned, "Specialist scans on both dates", first, weak),
        section(scan_lines, "Specialist scans on both dates", F.col("scan_order") + 1, F.col("line")),
        section(with_scans, "Agreement between scans and flagged regions", F.col("region_no"), backed),
        section(per_pair.where("_backed = 0"), "Agreement between scans and flagged regions", first, no_flip),
        section(
            pairs.where("modality = 'sar'"), "SAR note", first,
            F.lit("Brightness is backscatter, not colour; the colour-based measures are omitted."),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_answers(answers: DataFrame) -> DataFrame:
    """(pair_id, part, item_no, ...): an answer text read back into warnings, areas, notes and footer lines.

    part is warning | area | note | footer | legacy; area rows carry kind, place, size_pct, scans, before, after and
    measured, the others ``text``. A text without the heading is one legacy row.
    """
    lines = answers.select("pair_id", F.posexplode(F.split(F.regexp_replace("answer", "\r", ""), "\n")).alias("i", "line"))
    order = Window.partitionBy("pair_id").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("pair_id")
    trimmed = F.trim("line")
    marked = lines.withColumn("_h", F.min(F.when(trimmed == AREAS_HEADING, F.col("i"))).over(whole))
    below = F.col("i") > F.col("_h")
    is_head, is_field = F.col("line").rlike(AREA_LINE), F.col("line").rlike(FIELD_LINE)
    breaks = below & ~is_head & ~is_field
    staged = marked.withColumns(
        {
            "_area": F.sum(F.when(below & is_head, 1).otherwise(0)).over(upto),
            "_last_head": F.max(F.when(below & is_head, F.col("i"))).over(upto),
            "_last_break": F.max(F.when(breaks, F.col("i"))).over(upto),
        }
    )
    open_ = F.col("_last_head").isNotNull() & (F.col("_last_head") > F.coalesce("_last_break", F.lit(-1)))
    part = (
        F.when(F.col("_h").isNull(), "legacy")
        .when(F.col("i") < F.col("_h"), F.when(trimmed.startswith("WARNING: "), "warning"))
        .when(below & (trimmed != ""), F.when(is_head | (is_field & open_), "area").when(F.col("line").startswith("- "), "note").otherwise("footer"))
    )
    tagged = staged.withColumn("part", part).where("part IS NOT NULL")
    plain = tagged.where("part <> 'area' AND part <> 'legacy'").select(
        "pair_id", "part", F.row_number().over(Window.partitionBy("pair_id", "part").orderBy("i")).alias("item_no"),
        F.when(F.col("part") == "warning", F.substr(trimmed, F.lit(10)))
        .when(F.col("part") == "note", F.trim(F.substr(F.col("line"), F.lit(3))))
        .otherwise(trimmed).alias("text"),
    )
    legacy = tagged.where("part = 'legacy'").select("pair_id", "part").distinct().withColumn("item_no", F.lit(1))
    head = lambda g: F.max(F.when(is_head, F.regexp_extract("line", AREA_LINE, g)))
    field = lambda n: F.coalesce(
        F.max_by(F.trim(F.regexp_extract("line", FIELD_LINE, 2)), F.when(F.regexp_extract("line", FIELD_LINE, 1) == n, F.col("i"))), F.lit("")
    )
    areas = tagged.where("part = 'area'").groupBy("pair_id", "part", F.col("_area").cast("int").alias("item_no")).agg(
        head(1).alias("_label"), head(2).alias("place"), head(3).cast("int").alias("size_pct"), head(4).alias("_scans"),
        field("Before").alias("before"), field("After").alias("after"), field("Measured").alias("measured"),
    )
    kinds = F.create_map(*[F.lit(x) for p in KIND_WORDS.items() for x in p])
    names = F.transform(
        F.split(F.regexp_replace(F.regexp_replace("_scans", "^the ", ""), " scans?$", ""), ", | and "),
        lambda s: F.regexp_replace(s, "^the ", ""),
    )
    areas = areas.withColumns(
        {
            "kind": F.element_at(kinds, F.col("_label")),
            "scans": F.when(F.col("_scans") != "", names).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_label", "_scans")
    return areas.unionByName(plain, allowMissingColumns=True).unionByName(legacy, allowMissingColumns=True)
