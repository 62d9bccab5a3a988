"""Tile crops as blocks of bytes, and batch scorers over them, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from scenequarry.operators import scan


def scene_pixels(spark, scenes):
    frames = []
    for scene_id, image in scenes.items():
        h, w, _ = image.shape
        row, col = np.mgrid[:h, :w]
        frames.append(pd.DataFrame({"scene_id": scene_id, "row": row.ravel(), "col": col.ravel(), **{c: image[:, :, i].ravel() for i, c in enumerate("rgb")}}))
    return spark.createDataFrame(pd.concat(frames))


def plain_tile(image, cell, side, rows=4, cols=4):
    def window(i, size, n):
        low, high = i * size // n, (i + 1) * size // n
        pad = round((high - low) * 0.25)
        return max(0, low - pad), min(size, high + pad)

    (top, bottom), (left, right) = window(cell[0], image.shape[0], rows), window(cell[1], image.shape[1], cols)
    if top >= bottom or left >= right:
        return None
    at = lambda low, high: low + np.arange(side) * (high - low) // side
    return np.clip(np.rint(image[np.ix_(at(top, bottom), at(left, right))]), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("side", [1, 8, 40])
def test_tiles_are_ordered_blocks_of_three_channels(spark, side):
    rng = np.random.default_rng(side)
    scenes = {i: rng.uniform(-20, 280, (h, w, 3)) for i, (h, w) in enumerate([(64, 64), (37, 90), (150, 23), (3, 5)])}
    sizes = spark.createDataFrame([(i, x.shape[1], x.shape[0], a) for i, x in scenes.items() for a in ("mining", "agriculture")], "scene_id bigint, width int, height int, adapter string")
    got = {(r["scene_id"], r["adapter"], r["grid_row"], r["grid_col"]): r["tile"] for r in scan.tile_blocks(scene_pixels(spark, scenes), sizes, side).collect()}
    want = {}
    for i, image in scenes.items():
        for cell in np.ndindex(4, 4):
            tile = plain_tile(image, cell, side)
            if tile is not None:
                want |= {(i, a, *cell): tile.tobytes() for a in ("mining", "agriculture")}
    assert {k: bytes(v) for k, v in got.items()} == want


def test_missing_values_are_zero_and_empty_tables_give_none(spark):
    image = np.full((8, 8, 3), 7.0)
    table = scene_pixels(spark, {1: image}).where("not (row = 0 and col = 0)")
    table = table.selectExpr("scene_id", "row", "col", "case when row = 0 and col = 1 then null when row = 0 and col = 2 then double('nan') else r end as r", "g", "b", "'x' as tile", "0 as grid_row")
    sizes = spark.createDataFrame([(1, 8, 8)], "scene_id bigint, width int, height int")
    tiles = {(r["grid_row"], r["grid_col"]): np.frombuffer(r["tile"], np.uint8).reshape(3, 3, 3) for r in scan.tile_blocks(table, sizes, 3).collect()}
    assert len(tiles) == 16
    # windows are two pixels wide, so places 0 and 1 read the first of them; pixel (0, 0) is missing, (0, 1) null, (0, 2) not a number
    np.testing.assert_array_equal(tiles[0, 0][0], [[0, 0, 0], [0, 0, 0], [0, 7, 7]])
    np.testing.assert_array_equal(tiles[0, 1][0], [[0, 7, 7], [0, 7, 7], [7, 7, 7]])
    np.testing.assert_array_equal(tiles[3, 3], np.full((3, 3, 3), 7))
    assert scan.tile_blocks(table.limit(0), sizes, 3).count() == 0
    assert scan.tile_blocks(table, sizes.limit(0), 3).count() == 0


def test_scorer_gets_tiles_of_one_scan_four_at_a_time_in_order(spark):
    rng = np.random.default_rng(9)
    scenes = {i: rng.integers(0, 256, (40, 32, 3)).astype(float) for i in range(3)}
    sizes = spark.createDataFrame([(i, 32, 40) for i in scenes], "scene_id bigint, width int, height int")
    tiles = scan.tile_blocks(scene_pixels(spark, scenes), sizes, 10)

    def scorer(batch):
        assert batch.shape == (4, 10, 10, 3) and batch.dtype == np.uint8
        return [i + b[0, 1, 2] / 1000 + b[1, 0, 0] / 1e6 for i, b in enumerate(batch)]

    for r in scan.score_tiles(tiles, scorer).collect():
        tile = plain_tile(scenes[r["scene_id"]], (r["grid_row"], r["grid_col"]), 10)
        assert r["p"] == pytest.approx(r["grid_col"] + tile[0, 1, 2] / 1000 + tile[1, 0, 0] / 1e6)
    assert scan.score_tiles(tiles, lambda batch: np.full(len(batch), 0.5), per_call=5).where("p = 0.5").count() == 48
    with pytest.raises(Exception, match="scores for 4 tiles"):
        scan.score_tiles(tiles, lambda batch: [0.5]).collect()
