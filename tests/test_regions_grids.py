"""Region measures and regridding against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from scenequarry.operators import measures, regrid

SIZES = {0: (9, 14), 1: (30, 7), 2: (1, 1)}
NAMES = ("width_px", "height_px", "modality", "dark_pct", "bright_pct", "mean_brightness", "edge_pct", "mean_r", "mean_g", "mean_b", "green_dominant_pct")


def grids(rng):
    """Per (pair, date): three colours and validity; sizes differ between pairs."""
    made = {}
    for pair, (h, w) in SIZES.items():
        for date in (0, 1):
            colour = rng.integers(0, 256, (3, h, w)) // (1 + 4 * date)
            made[pair, date] = (colour.astype(float), rng.random((h, w)) < 0.8)
    return made


def pixel_table(spark, made):
    frames = []
    for (pair, date), (colour, valid) in made.items():
        h, w = valid.shape
        row, col = np.mgrid[:h, :w]
        frames.append(pd.DataFrame({
            "pair_id": pair, "date": date, "row": row.ravel(), "col": col.ravel(), **{c: colour[i].ravel() for i, c in enumerate("rgb")},
            "valid": valid.ravel(), "height": h, "width": w, "modality": "sar" if pair == 1 else "optical",
        }))
    return spark.createDataFrame(pd.concat(frames))


def half_even(x):
    return int(round(x))


def plain_measures(colour, valid, box, modality):
    x, y, w, h = box
    height, width = valid.shape
    rows, cols = slice(max(y, 0), max(min(y + h, height), 0)), slice(max(x, 0), max(min(x + w, width), 0))
    r, g, b = (c[rows, cols] for c in colour)
    ok = valid[rows, cols]
    if ok.size == 0:
        return None
    gray = 0.299 * r + 0.587 * g + 0.114 * b

    def slope(axis):
        return np.gradient(gray, axis=axis) if gray.shape[axis] > 1 else np.zeros_like(gray)

    edge = np.hypot(slope(1), slope(0))
    if not ok.any():
        return (w, h, modality, *[None] * 8)
    share = lambda flag: half_even(100 * (flag[ok].sum() / ok.sum()))
    mean = lambda v: half_even(v[ok].sum() / ok.sum())
    return (
        w, h, modality, share(gray <= 50), share(gray >= 200), mean(gray), share(edge > 25), mean(r), mean(g), mean(b),
        share(2 * g - r - b > 20) if modality != "sar" else None,
    )


def test_region_measures_are_those_of_the_cut_out_box(spark):
    rng = np.random.default_rng(3)
    made = grids(rng)
    made[0, 0][1][:4, :5] = False
    fixed = [(0, 0, 14, 9), (0, 0, 1, 1), (3, 2, 1, 6), (3, 2, 6, 1), (4, 4, 2, 2), (0, 0, 5, 4), (2, 3, 3, 3), (-3, -2, 6, 5), (10, 6, 40, 40), (30, 30, 4, 4), (0, 0, 2, 30)]
    boxes = fixed + [tuple(int(v) for v in (rng.integers(0, 12), rng.integers(0, 8), rng.integers(1, 9), rng.integers(1, 9))) for _ in range(40)]
    regions = spark.createDataFrame([(p, i, *b) for p in SIZES for i, b in enumerate(boxes)], "pair_id bigint, region_no int, x int, y int, w int, h int")
    got = {
        (r["pair_id"], r["date"], r["region_no"]): tuple(r[c] for c in NAMES)
        for r in measures.region_measures(pixel_table(spark, made), ["pair_id", "date"], regions, ["pair_id"]).collect()
    }
    want = {}
    for (pair, date), (colour, valid) in made.items():
        for i, box in enumerate(boxes):
            found = plain_measures(colour, valid, box, "sar" if pair == 1 else "optical")
            if found:
                want[pair, date, i] = found
    assert got == want


def test_region_measures_of_nothing_and_of_colours_without_numbers(spark):
    made = grids(np.random.default_rng(4))
    made[0, 0][0][0, 1, 1] = math.nan
    table = pixel_table(spark, made)
    regions = spark.createDataFrame([(0, 1, 0, 0, 5, 5), (0, 2, 3, 3, 4, 4), (7, 1, 0, 0, 2, 2)], "pair_id bigint, region_no int, x int, y int, w int, h int")
    got = {(r["date"], r["region_no"]): r["mean_r"] for r in measures.region_measures(table, ["pair_id", "date"], regions, ["pair_id"]).collect()}
    colour, valid = made[0, 0]
    valid = valid & ~np.isnan(colour[0])
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert got[0, 1] == half_even(colour[0][:5, :5][valid[:5, :5]].mean())
    assert got[0, 2] == half_even(colour[0][3:7, 3:7][valid[3:7, 3:7]].mean())
    assert measures.region_measures(table, ["pair_id", "date"], regions.limit(0), ["pair_id"]).count() == 0
    assert measures.region_measures(table.limit(0), ["pair_id", "date"], regions, ["pair_id"]).count() == 0


def plain_regrid(grid, source, method):
    a_x, a_y, a_res, a_h, a_w, b_x, b_y, b_res, b_h, b_w = grid
    out = {}
    for row in range(a_h):
        for col in range(a_w):
            y, x = (b_y - a_y + (row + 0.5) * a_res) / b_res, (a_x + (col + 0.5) * a_res - b_x) / b_res
            out[row, col] = None
            if not (0 <= y < b_h and 0 <= x < b_w):
                continue
            if method == "nearest":
                out[row, col] = source.get((math.floor(y), math.floor(x)))
                continue
            low_y, low_x = math.floor(y - 0.5), math.floor(x - 0.5)
            part_y, part_x = y - 0.5 - low_y, x - 0.5 - low_x
            top = bottom = 0.0
            for r, wy in ((low_y, 1 - part_y), (low_y + 1, part_y)):
                for c, wx in ((low_x, 1 - part_x), (low_x + 1, part_x)):
                    if (r, c) in source and wy * wx > 0:
                        top += source[r, c] * wy * wx
                        bottom += wy * wx
            if bottom > 0:
                out[row, col] = top / bottom
    return out


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
def test_regrid_for_grids_of_any_ratio(spark, method):
    rng = np.random.default_rng(5)
    pairs = {
        "same": (35.0, -35.0, 10.0, 20, 20, 0.0, 0.0, 10.0, 20, 20),
        "finer": (-7.0, 13.0, 1.3, 150, 140, 0.0, 0.0, 10.0, 16, 17),
        "coarser": (0.0, 0.0, 97.0, 5, 7, -50.0, 31.0, 10.0, 60, 70),
        "apart": (9000.0, 0.0, 10.0, 3, 3, 0.0, 0.0, 10.0, 5, 5),
        "empty": (0.0, 0.0, 10.0, 2, 2, 0.0, 0.0, 10.0, 5, 5),
        "blocks": (4.0, -6.0, 10.0, 131, 260, 0.0, 0.0, 10.0, 135, 262),
    }
    sources = {
        k: {(r, c): float(rng.integers(0, 256)) for r in range(g[8]) for c in range(g[9]) if rng.random() < 0.9} for k, g in pairs.items() if k != "empty"
    }
    rows = [(k, r, c, v, True) for k, cells in sources.items() for (r, c), v in cells.items()]
    rows += [("same", -1, 3, 9.0, True), ("same", 3, 99, 9.0, True), ("other", 0, 0, 1.0, True), ("empty", 0, 0, 5.0, False), ("empty", 0, 1, None, True), ("empty", 1, 1, math.nan, True)]
    source = spark.createDataFrame(rows, "pair_id string, row int, col int, value double, valid boolean")
    grid_table = spark.createDataFrame(
        [(k, *g) for k, g in pairs.items()],
        "pair_id string, a_x double, a_y double, a_res double, a_height int, a_width int, b_x double, b_y double, b_res double, b_height int, b_width int",
    )
    got = regrid.regrid(grid_table, source, method).collect()
    assert len(got) == sum(g[3] * g[4] for g in pairs.values())
    want = {(k, *at): v for k, g in pairs.items() for at, v in plain_regrid(g, sources.get(k, {}), method).items()}
    for r in got:
        expected = want[r["pair_id"], r["row"], r["col"]]
        assert (r["value"] is None) == (expected is None), r
        assert expected is None or r["value"] == pytest.approx(expected, abs=1e-9), r


def test_regrid_of_empty_tables_and_unknown_method(spark):
    pairs = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 2, 2, 0.0, 0.0, 1.0, 2, 2)], "pair_id string, a_x double, a_y double, a_res double, a_height int, a_width int, b_x double, b_y double, b_res double, b_height int, b_width int")
    source = spark.createDataFrame([], "pair_id string, row int, col int, value double")
    assert [r["value"] for r in regrid.regrid(pairs, source).collect()] == [None] * 4
    assert regrid.regrid(pairs.limit(0), source).count() == 0
    with pytest.raises(ValueError):
        regrid.regrid(pairs, source, "cubic")
