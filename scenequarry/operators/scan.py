"""Feature scans: tile windows, scores, touching tiles grouped into findings, summaries and two-date comparison.

scan_cells(scan_id, adapter, grid_row, grid_col, p). A scan grid is small and fixed (4x4 by default), so the
cells of one scan are gathered into one array; nothing larger than a grid is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.functions.measures import finding_label, percent, plural
from scenequarry.functions.places import location_word
from scenequarry.operators.joins import join_small

# --- Fixed values: thresholds, labels and sentences of a scan. ---
GRID = (4, 4)
CONTEXT = 0.25
YES_THRESHOLD = 0.5
SCAN_THRESHOLD = 0.8
FAINT_FLOOR = 0.5
OVER_REPORTING_SHARE = 0.5
MIN_SHIFT = 0.4
SATURATED_SHARE = 0.5
TILES_PER_CALL = 4
SUBJECTS = {
    "mining": "surface mining activity",
    "deforestation": "forest clearing",
    "agriculture": "cultivated land",
}
DEFAULT_SUBJECT = "the target feature"
CHANGE_LABELS = {
    "mining": "mining / extraction pits",
    "deforestation": "cleared or logged land",
    "agriculture": "cultivated fields",
}
# --- End of fixed values. ---

TILE_SIDE = 224      # side of a tile that is handed to a scorer

SCAN = ("scan_id", "adapter")


def _lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    found = None
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)) if found is None else found.when(key == k, F.lit(v))
    return found.otherwise(default)


def tile_windows(scenes: DataFrame, rows: int = GRID[0], cols: int = GRID[1], context: float = CONTEXT) -> DataFrame:
    """(scene_id, grid_row, grid_col, left, top, right, bottom): padded crop boxes of every cell, inside the scene."""
    cells = scenes.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("grid_row")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("grid_col"))
    edge = lambda cell, side, n: F.floor(cell * F.col(side) / n).cast("int")
    x0, x1 = edge(F.col("grid_col"), "width", cols), edge(F.col("grid_col") + 1, "width", cols)
    y0, y1 = edge(F.col("grid_row"), "height", rows), edge(F.col("grid_row") + 1, "height", rows)
    pad_x, pad_y = (F.bround(size * F.lit(context)).cast("int") for size in (x1 - x0, y1 - y0))
    return cells.select(
        "scene_id", "grid_row", "grid_col",
        F.greatest(F.lit(0), x0 - pad_x).alias("left"), F.greatest(F.lit(0), y0 - pad_y).alias("top"),
        F.least(F.col("width"), x1 + pad_x).alias("right"), F.least(F.col("height"), y1 + pad_y).alias("bottom"),
    )


def tile_pixels(pixels: DataFrame, scenes: DataFrame, rows: int = GRID[0], cols: int = GRID[1], context: float = CONTEXT) -> DataFrame:
    """Pixels labelled with every tile whose padded window holds them; padded windows overlap, so pixels repeat.

    A pixel can only lie in the padded window of its own cell or a neighbouring one, so the candidates are
    computed from its position instead of joining pixels to windows.
    """
    sized = join_small(pixels, scenes.select("scene_id", "width", "height"), ["scene_id"])

    def candidates(position: str, side: str, n: int) -> Column:
        def inside(cell: Column) -> Column:
            low, high = F.floor(cell * F.col(side) / n), F.floor((cell + 1) * F.col(side) / n)
            pad = F.bround((high - low) * F.lit(context))
            return (F.col(position) >= low - pad) & (F.col(position) < high + pad)

        home = F.least(F.lit(n - 1), F.floor(F.col(position) * n / F.col(side))).cast("int")
        near = F.sequence(F.greatest(F.lit(0), home - 1), F.least(F.lit(n - 1), home + 1))
        return F.filter(near, inside)

    return sized.select("*", F.explode(candidates("row", "height", rows)).alias("grid_row")).select(
        "*", F.explode(candidates("col", "width", cols)).alias("grid_col")
    )


def _byte(values: pa.ChunkedArray) -> np.ndarray:
    numbers = values.cast(pa.float64()).to_numpy()
    return np.clip(np.rint(np.nan_to_num(numbers)), 0, 255).astype(np.uint8)


def tile_blocks(
    pixels: DataFrame, scenes: DataFrame, side: int = TILE_SIDE, rows: int = GRID[0], cols: int = GRID[1], context: float = CONTEXT
) -> DataFrame:
    """(columns of scenes but width and height, grid_row, grid_col, tile): every padded tile as ``side`` x ``side`` x 3 bytes, by row,
    column and channel (r, g, b).

    pixels(scene_id, row, col, r, g, b), scenes(scene_id, width, height, ..), a row per scan of a scene. Tiles are resized by the nearest
    pixel: place t of a window of n pixels reads pixel floor(t * n / side). Each pixel is kept for the places that read it only, before
    anything is shuffled, so a scan gathers rows * cols * side * side places however large its scene is. Values are rounded and cut to 0..255;
    missing pixels, nulls and values that are not numbers are 0. A cell without any pixel has no tile.
    """
    keys = [c for c in scenes.columns if c not in ("width", "height")]
    sized = join_small(pixels.select("scene_id", "row", "col", "r", "g", "b"), scenes, ["scene_id"])

    def places(position: str, size: str, n: int) -> Column:
        at = F.col(position)
        home = F.least(F.lit(n - 1), F.floor(at * n / F.col(size))).cast("int")

        def read_by(cell: Column) -> Column:
            low, high = F.floor(cell * F.col(size) / n), F.floor((cell + 1) * F.col(size) / n)
            pad = F.bround((high - low) * F.lit(context)).cast("long")
            first, last = F.greatest(F.lit(0), low - pad), F.least(F.col(size), high + pad)
            start = F.ceil((at - first) * side / (last - first)).cast("int")
            end = F.ceil((at - first + 1) * side / (last - first)).cast("int") - 1
            inside = (at >= first) & (at < last) & (start <= end)
            none = F.array().cast("array<int>")
            return F.transform(F.when(inside, F.sequence(start, end)).otherwise(none), lambda t: F.struct(cell.alias("cell"), t.alias("t")))

        near = F.sequence(F.greatest(F.lit(0), home - 1), F.least(F.lit(n - 1), home + 1))
        return F.explode(F.flatten(F.transform(near, read_by)))

    read = sized.withColumn("_down", places("row", "height", rows)).withColumn("_across", places("col", "width", cols))
    values = read.select(
        *keys, F.col("_down.cell").alias("grid_row"), F.col("_across.cell").alias("grid_col"),
        (F.col("_down.t") * side + F.col("_across.t")).alias("_place"), "r", "g", "b",
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys).schema.fields)

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        cell = table.column("grid_row").to_numpy().astype(np.int64) * cols + table.column("grid_col").to_numpy()
        found, slot = np.unique(cell, return_inverse=True)
        blocks = np.zeros((len(found), side * side, 3), np.uint8)
        place = table.column("_place").to_numpy()
        for channel, name in enumerate("rgb"):
            blocks[slot, place, channel] = _byte(table.column(name))
        same = {c: pa.repeat(k, len(found)) for c, k in zip(keys, key)}
        return pa.table(
            {**same, "grid_row": pa.array((found // cols).astype(np.int32)), "grid_col": pa.array((found % cols).astype(np.int32)), "tile": pa.array([x.tobytes() for x in blocks], pa.binary())}
        )

    return values.groupBy(*keys).applyInArrow(gathered, f"{schema}, grid_row int, grid_col int, tile binary")


def score_tiles(tiles: DataFrame, scorer: Callable[[np.ndarray], Sequence[float]], per_call: int = TILES_PER_CALL) -> DataFrame:
    """tiles(.., grid_row, grid_col, tile) with ``p`` from a caller's batch ``scorer`` in place of ``tile``.

    A call gets up to ``per_call`` tiles of one scan, in order of their cells, as an array (tile, row, column, channel) of bytes, and
    returns a number for each.
    """
    keys = [c for c in tiles.columns if c not in ("grid_row", "grid_col", "tile")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.drop("tile").schema.fields)

    def scored(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grid_row", "ascending"), ("grid_col", "ascending")])
        scores: list[float] = []
        for start in range(0, table.num_rows, per_call):
            blocks = np.stack([np.frombuffer(b, np.uint8) for b in table.column("tile").slice(start, per_call).to_pylist()])
            side = math.isqrt(blocks.shape[1] // 3)
            part = scorer(blocks.reshape(len(blocks), side, side, 3))
            if len(part) != len(blocks):
                raise ValueError(f"the scorer returned {len(part)} scores for {len(blocks)} tiles")
            scores.extend(float(p) for p in part)
        return table.drop_columns("tile").append_column("p", pa.array(scores, pa.float64()))

    return tiles.groupBy(*keys).applyInArrow(scored, f"{schema}, p double")


def yes_probability(logits: DataFrame, classes: DataFrame) -> DataFrame:
    """(row_id, p_yes) from logits(row_id, token, logit), comparing only classes(token, answer) 'yes' with 'no'.

    Two log-sum-exps with the maximum taken out, so extreme logits do not overflow.
    """
    scored = logits.join(classes, "token").groupBy("row_id").agg(
        F.collect_list(F.when(F.col("answer") == "yes", F.col("logit"))).alias("yes"),
        F.collect_list(F.when(F.col("answer") == "no", F.col("logit"))).alias("no"),
    )

    def log_sum_exp(values: str) -> Column:
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return top + F.log(total)

    return scored.select("row_id", (1 / (1 + F.exp(log_sum_exp("no") - log_sum_exp("yes")))).alias("p_yes"))


def mean_token_probability(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gen_id, probability): softmax share of the generated token at each step, averaged over the steps.

    scores(gen_id, step, token, logit), chosen(gen_id, step, token).
    """
    tops = scores.groupBy("gen_id", "step").agg(F.max("logit").alias("_top"))
    picked = chosen.join(tops, ["gen_id", "step"]).withColumnRenamed("token", "_chosen")
    weighted = scores.join(picked, ["gen_id", "step"]).withColumn("_w", F.exp(F.col("logit") - F.col("_top")))
    steps = weighted.groupBy("gen_id", "step").agg(
        (F.sum(F.when(F.col("token") == F.col("_chosen"), F.col("_w"))) / F.sum("_w")).alias("p")
    )
    return steps.groupBy("gen_id").agg(F.avg("p").alias("probability"))


def group_tiles(cells: DataFrame, threshold: float, rows: int = GRID[0], cols: int = GRID[1]) -> DataFrame:
    """Positive tiles with the id of their edge-connected group: (scan_id, adapter, grid_row, grid_col, p, group_id).

    Labels start as the cell number and take the smallest neighbouring label until every cell has had its turn.
    """
    size = rows * cols
    index = F.col("grid_row") * cols + F.col("grid_col")
    grids = cells.groupBy(*SCAN).agg(F.map_from_entries(F.collect_list(F.struct(index.alias("i"), F.col("p")))).alias("_p"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(F.col("_p"), i))
    first = F.transform("_scores", lambda p, i: F.when(p >= threshold, i))

    def spread(labels: Column) -> Column:
        return F.transform(
            labels,
            lambda own, i: F.when(
                own.isNotNull(),
                F.least(
                    own,
                    F.get(labels, i - cols),
                    F.get(labels, i + cols),
                    F.when(i % cols > 0, F.get(labels, i - 1)),
                    F.when(i % cols < cols - 1, F.get(labels, i + 1)),
                ),
            ),
        )

    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.filter("_scores", lambda p: p >= threshold))))
    labelled = grids.withColumn("_scores", scores).withColumn(
        "_labels", F.aggregate(turns, first, lambda labels, _: spread(labels))
    )
    tiles = labelled.select(*SCAN, F.explode(F.arrays_zip("_labels", "_scores", F.sequence(F.lit(0), F.lit(size - 1)).alias("i"))).alias("t"))
    return tiles.where(F.col("t._labels").isNotNull()).select(
        *SCAN,
        F.floor(F.col("t.i") / cols).cast("int").alias("grid_row"),
        (F.col("t.i") % cols).cast("int").alias("grid_col"),
        F.col("t._scores").alias("p"),
        F.col("t._labels").alias("group_id"),
    )


def findings(cells: DataFrame, threshold: float = SCAN_THRESHOLD, rows: int = GRID[0], cols: int = GRID[1]) -> DataFrame:
    """One row per finding: box, tiles, place, coverage, mean and best score, label and number within its scan."""
    grouped = group_tiles(cells, threshold, rows, cols).groupBy(*SCAN, "group_id").agg(
        F.min("grid_row").alias("_r0"), F.max("grid_row").alias("_r1"),
        F.min("grid_col").alias("_c0"), F.max("grid_col").alias("_c1"),
        F.avg("grid_row").alias("_r"), F.avg("grid_col").alias("_c"),
        F.count(F.lit(1)).alias("n_tiles"),
        F.avg("p").alias("_mean"), F.max("p").alias("_peak"),
        F.array_sort(F.collect_list(F.struct("grid_row", "grid_col"))).alias("tiles"),
    )
    third = lambda c: F.bround(c, 3)
    boxed = grouped.select(
        *SCAN, "tiles", "n_tiles", "group_id",
        third(F.col("_r0") / rows).alias("ymin"), third(F.col("_c0") / cols).alias("xmin"),
        third((F.col("_r1") + 1) / rows).alias("ymax"), third((F.col("_c1") + 1) / cols).alias("xmax"),
        location_word((F.col("_c") + 0.5) / cols, (F.col("_r") + 0.5) / rows, F.lit(1.0), F.lit(1.0)).alias("place"),
        percent(F.col("n_tiles") / (rows * cols)).alias("coverage_pct"),
        percent(F.col("_mean")).alias("confidence"),
        percent(F.col("_peak")).alias("peak"),
        finding_label(F.col("_peak")).alias("label"),
    )
    order = Window.partitionBy(*SCAN).orderBy("ymin", "xmin", "group_id")
    return boxed.withColumn("finding_no", F.row_number().over(order)).drop("group_id")


def tile_boxes(cells: DataFrame, threshold: float, rows: int = GRID[0], cols: int = GRID[1]) -> DataFrame:
    """Just the merged boxes of positive tiles, normalised to 0..1."""
    return findings(cells, threshold, rows, cols).select(*SCAN, "finding_no", "ymin", "xmin", "ymax", "xmax")


def pin_tiles(found: DataFrame, rows: int = GRID[0], cols: int = GRID[1]) -> DataFrame:
    """The tile of each finding nearest its centre, as a point in 0..1; the first one on ties."""
    mean = lambda name: F.aggregate("tiles", F.lit(0.0), lambda acc, t: acc + t[name]) / F.size("tiles")
    centred = found.withColumns({"_r": mean("grid_row"), "_c": mean("grid_col")})
    distance = F.transform(
        "tiles",
        lambda t: F.struct(
            (F.pow(t["grid_row"] - F.col("_r"), 2) + F.pow(t["grid_col"] - F.col("_c"), 2)).alias("d"),
            t["grid_row"].alias("r"), t["grid_col"].alias("c"),
        ),
    )
    nearest = F.array_min(distance)
    return centred.select(
        *SCAN, "finding_no", ((nearest["c"] + 0.5) / cols).alias("x"), ((nearest["r"] + 0.5) / rows).alias("y")
    )


def scan_summary(cells: DataFrame, threshold: float = SCAN_THRESHOLD, rows: int = GRID[0], cols: int = GRID[1]) -> DataFrame:
    """One row per scan: level, headline, over-reporting note, coverage, faint areas and the rounded score grid."""
    per_scan = cells.groupBy(*SCAN).agg(
        F.count(F.lit(1)).alias("_size"),
        F.count_if(F.col("p") >= FAINT_FLOOR).alias("_yes"),
        F.count_if((F.col("p") >= FAINT_FLOOR) & (F.col("p") < threshold)).alias("faint_areas"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("grid_row", "grid_col", F.bround("p", 2).alias("p")))), lambda t: t["p"]
        ).alias("grid"),
    )
    found = findings(cells, threshold, rows, cols).groupBy(*SCAN).agg(
        F.count(F.lit(1)).alias("_areas"), F.sum("n_tiles").alias("_covered"), F.max("peak").alias("_best")
    )
    joined = per_scan.join(found, list(SCAN), "left").withColumns(
        {
            "subject": _lookup(F.col("adapter"), SUBJECTS, F.lit(DEFAULT_SUBJECT)),
            "areas": F.coalesce("_areas", F.lit(0)),
            "coverage_pct": percent(F.coalesce("_covered", F.lit(0)) / F.col("_size")),
            "level": F.when(F.col("_best").isNull(), "none")
            .when(F.col("_best") / 100 >= 0.9, "high")
            .when(F.col("_best") / 100 >= 0.75, "likely")
            .otherwise("possible"),
        }
    )
    subject, level, faint = F.col("subject"), F.col("level"), F.col("faint_areas")
    opened = F.concat(F.upper(F.substring(subject, 1, 1)), F.substr(subject, F.lit(2)))
    where = plural(F.col("areas"), "area")
    found_text = (
        F.when(level == "high", F.concat(opened, F.lit(" found in "), where, F.lit(" (high confidence)")))
        .when(level == "likely", F.concat(F.lit("Likely "), subject, F.lit(" in "), where))
        .otherwise(F.concat(F.lit("Possible "), subject, F.lit(" in "), where))
    )
    covering = F.concat(F.lit(", covering about "), F.col("coverage_pct").cast("string"), F.lit("% of the view."))
    faint_text = F.concat(
        F.lit(" "), plural(faint, "faint area"), F.lit(" scored above chance and "),
        F.when(faint == 1, "is").otherwise("are"), F.lit(" tinted lightly."),
    )
    nothing = F.concat(
        F.lit("No confident "), subject, F.lit(" found."), F.when(faint > 0, faint_text).otherwise("")
    )
    note = F.when(
        F.col("_yes") / F.col("_size") >= OVER_REPORTING_SHARE,
        F.concat(
            F.lit("The scan answered yes for "), F.col("_yes").cast("string"), F.lit(" of "), F.col("_size").cast("string"),
            F.lit(
                " areas, which is more than one feature usually covers, so it may be over-reporting. "
                "Treat the highlights as a starting point and check them by eye."
            ),
        ),
    ).otherwise("")
    return joined.select(
        *SCAN, "subject", "level", "areas", "coverage_pct", "faint_areas", "grid",
        F.when(level == "none", nothing).otherwise(F.concat(found_text, covering)).alias("headline"),
        note.alias("note"),
    )


def scan_answers(summary: DataFrame) -> DataFrame:
    """The chat sentence of a scan: headline and note."""
    return summary.select(*SCAN, F.trim(F.concat_ws(" ", "headline", "note")).alias("answer"))


def finding_lines(found: DataFrame) -> DataFrame:
    return found.select(
        *SCAN, "finding_no",
        F.concat(
            F.col("finding_no").cast("string"), F.lit(". "), F.col("label"), F.lit(" - "), F.col("place"), F.lit(", "),
            plural(F.col("n_tiles"), "tile"), F.lit(" (about "), F.col("coverage_pct").cast("string"),
            F.lit("% of the view), average score "), F.col("confidence").cast("string"), F.lit("%"),
        ).alias("line"),
    )


# ------------------------------------------------------------------ two dates


def match_dates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scan_id, adapter, grid_row, grid_col, before, after): both dates' cells side by side, nulls where unmatched."""
    tagged = before.select(*SCAN, "grid_row", "grid_col", F.col("p").alias("before"), F.lit(None).cast("double").alias("after"))
    tagged = tagged.unionByName(
        after.select(*SCAN, "grid_row", "grid_col", F.lit(None).cast("double").alias("before"), F.col("p").alias("after"))
    )
    return tagged.groupBy(*SCAN, "grid_row", "grid_col").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def compare_scans(matched: DataFrame, threshold: float = YES_THRESHOLD, min_shift: float = MIN_SHIFT) -> DataFrame:
    """One row per scan: positives on both dates, clear gains and losses, quiet crossings, saturation and means.

    A scan whose two grids differ in shape gets ``error`` instead.
    """
    was, now = F.col("before") >= threshold, F.col("after") >= threshold
    gained = now & ~was & (F.col("after") - F.col("before") >= min_shift)
    lost = was & ~now & (F.col("before") - F.col("after") >= min_shift)
    cell = F.struct("grid_row", "grid_col")
    listed = lambda flag: F.array_sort(F.collect_list(F.when(flag, cell)))
    counted = matched.groupBy(*SCAN).agg(
        F.count(F.lit(1)).alias("total"),
        (F.max("grid_row") + 1).alias("n_rows"), (F.max("grid_col") + 1).alias("n_cols"),
        F.count_if(was).alias("positive_before"), F.count_if(now).alias("positive_after"),
        F.count_if(now & ~was).alias("crossed_up"), F.count_if(was & ~now).alias("crossed_down"),
        listed(gained).alias("gained"), listed(lost).alias("lost"),
        F.bround(F.avg("before"), 2).alias("mean_before"), F.bround(F.avg("after"), 2).alias("mean_after"),
        F.count_if(F.col("before").isNull() | F.col("after").isNull()).alias("_unmatched"),
    )
    return counted.withColumns(
        {
            "saturated": F.greatest("positive_before", "positive_after") >= SATURATED_SHARE * F.col("total"),
            "error": F.when(F.col("_unmatched") > 0, "scan grids must have the same shape"),
        }
    ).drop("_unmatched")


def cell_words(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """Cells as 'place (row r, col c)', counted from 1."""
    return F.transform(
        cells,
        lambda t: F.concat(
            location_word(t["grid_col"] + 0.5, t["grid_row"] + 0.5, n_cols, n_rows),
            F.lit(" (row "), (t["grid_row"] + 1).cast("string"), F.lit(", col "), (t["grid_col"] + 1).cast("string"), F.lit(")"),
        ),
    )


def scan_change_lines(compared: DataFrame) -> DataFrame:
    """One sentence per compared scan; tiles that crossed by a small margin are counted, not listed."""
    places = lambda c: F.when(F.size(c) > 0, F.array_join(cell_words(F.col(c), F.col("n_rows"), F.col("n_cols")), ", ")).otherwise("none")
    text = lambda c: c.cast("string")
    quiet_up = F.col("crossed_up") - F.size("gained")
    quiet_down = F.col("crossed_down") - F.size("lost")

    def quiet(n: Column, side: str) -> Column:
        return F.when(n > 0, F.concat(F.lit(" "), text(n), F.lit(f" more tile(s) crossed to {side} by a smaller margin."))).otherwise("")

    line = F.concat(
        _lookup(F.col("adapter"), CHANGE_LABELS, F.col("adapter")),
        F.lit(": "), text(F.col("positive_before")), F.lit(" of "), text(F.col("total")), F.lit(" tiles positive before, "),
        text(F.col("positive_after")), F.lit(" after. Clearly newly positive (score up by 0.4 or more): "),
        places("gained"), F.lit(". Clearly dropped: "), places("lost"), F.lit("."),
        quiet(quiet_up, "positive"), quiet(quiet_down, "negative"),
        F.when(F.col("saturated"), " Already positive on many tiles, so this scan separates the dates poorly.").otherwise(""),
    )
    return compared.where("error IS NULL").select(*SCAN, line.alias("line"))
