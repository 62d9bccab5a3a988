import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.operators import change, components, masks
from tests.test_rasters import pixel_table

KEY = ["scene_id"]


def ellipse(size):
    r = size // 2
    out = np.zeros((size, size), bool)
    for i in range(size):
        half = int(np.rint(r * np.sqrt((r * r - (i - r) ** 2) / (r * r))))
        out[i, r - half : r + half + 1] = True
    return out


def grow(mask, size):
    k, r = ellipse(size), size // 2
    p = np.pad(mask, r)
    out = np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(k)):
        out |= p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def shrink(mask, size):
    return ~grow(~mask, size)


def mask_table(spark, mask):
    table = pixel_table(spark, {"v": mask.astype(float)})
    return masks.to_runs(table, KEY, F.col("v") > 0), table.select("scene_id", "height", "width").distinct()


def as_mask(runs, shape):
    out = np.zeros(shape, bool)
    for r in masks.to_pixels(runs, KEY).collect():
        out[r["row"], r["col"]] = True
    return out


@pytest.mark.parametrize("size, times", [(3, 2), (5, 1), (9, 2)])
def test_opening_and_closing_match_brute_force(spark, size, times):
    mask = np.random.default_rng(size).random((21, 34)) < .8
    mask[5:16, 8:26] = True
    runs, shapes = mask_table(spark, mask)
    opened, closed = mask, mask
    for step in (shrink, grow):
        for _ in range(times):
            opened = step(opened, size)
    for step in (grow, shrink):
        for _ in range(times):
            closed = step(closed, size)
    assert np.array_equal(as_mask(masks.opened(runs, shapes, KEY, F.lit(size), times), mask.shape), opened)
    assert np.array_equal(as_mask(masks.closed(runs, shapes, KEY, F.lit(size), times), mask.shape), closed)
    assert np.array_equal(as_mask(masks.erode(runs, shapes, KEY, F.lit(size)), mask.shape), shrink(mask, size))


def flood(mask, eight):
    labels, near = np.full(mask.shape, -1), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for start in zip(*np.nonzero(mask)):
        if labels[start] < 0:
            stack, labels[start] = [start], start[0] * mask.shape[1] + start[1]
            while stack:
                r, c = stack.pop()
                for dr, dc in near:
                    n = (r + dr, c + dc)
                    if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and labels[n] < 0:
                        labels[n] = labels[start]
                        stack.append(n)
    return labels


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("band", [64, 7, 1])
def test_groups_match_a_flood_fill(spark, monkeypatch, eight, band):
    monkeypatch.setattr(masks, "BAND", band)
    mask = np.random.default_rng(7).random((30, 150)) < .45
    runs, _ = mask_table(spark, mask)
    labelled = masks.label_runs(runs, KEY, 8 if eight else 4)
    got = np.full(mask.shape, -1)
    for r in labelled.collect():
        got[r["row"], r["start"] : r["end"] + 1] = r["label"]
    assert np.array_equal(got, flood(mask, eight))


def test_a_long_path_is_one_component(spark):
    n = 300
    nodes = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("node"))
    order = [(i * 7) % n for i in range(n)]
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(order, order[1:])], "k int, u bigint, v bigint")
    got = components.connected_components(nodes, edges, ["k"])
    assert {r["root"] for r in got.collect()} == {0} and got.count() == n
    alone = components.connected_components(nodes, edges.where("false"), ["k"])
    assert alone.where("root = node").count() == n


def test_seeds_grow_unless_they_leak(spark):
    loose, seeds = np.zeros((20, 40), bool), np.zeros((20, 40), bool)
    loose[2:6, 2:6] = seeds[3:6, 2:6] = True          # grows 16 / 12
    loose[10:18, 10:30] = True
    seeds[12, 12:16] = True                           # would grow 160 / 4
    loose[2:4, 30:34] = True                          # no seed
    got = as_mask(masks.grow_seeds(mask_table(spark, loose)[0], mask_table(spark, seeds)[0], KEY, 3.0), loose.shape)
    expected = np.zeros_like(loose)
    expected[2:6, 2:6] = True
    expected[12, 12:16] = True
    assert np.array_equal(got, expected)


# ------------------------------------------------------------------ change


def block(side, spread=60, seed=0):
    return np.random.default_rng(seed).integers(100 - spread // 2, 100 + spread // 2, (side, side, 3)).astype(float)


def scene(spark, img, scene_id, valid=None):
    return pixel_table(spark, dict(zip("rgb", np.moveaxis(img, 2, 0))), scene_id, valid)


@pytest.fixture(scope="module")
def detected(spark):
    """One run of the pipeline over all pairs: pair id -> its items."""
    side = 96
    textured, smooth = block(side), block(side, spread=6)
    dark, bright, mild, cut = textured.copy(), textured.copy(), smooth + 3.0, smooth.copy()
    dark[30:66, 24:60] = 0
    bright[20:70, 20:70] = 255
    mild[30:70, 30:70] += np.array([22.0, -16.0, 0.0])      # the overall shift of 3 must not matter
    cut[:, :30] = 0
    border = np.ones((side, side), bool)
    border[:, :30] = False
    cases = {
        "dark": (textured, dark, "optical", None),
        "bright": (textured, bright, "optical", None),
        "bright radar": (textured, bright, "sar", None),
        "mild": (smooth, mild, "optical", None),
        "border": (smooth, cut, "optical", border),
        "border unmasked": (smooth, cut, "optical", None),
    }
    pixels, pairs = None, []
    for i, (before, after, modality, valid) in enumerate(cases.values()):
        for j, img in enumerate((before, after)):
            one = scene(spark, img, 2 * i + j, valid)
            pixels = one if pixels is None else pixels.unionByName(one)
        pairs.append((i, 2 * i, 2 * i + 1, modality))
    pair_table = spark.createDataFrame(pairs, "pair_id bigint, scene_a bigint, scene_b bigint, modality string")
    _, items = change.detect(change.join_dates(pair_table, pixels))
    rows = items.orderBy("pair_id", "region_no").collect()
    return {name: [r for r in rows if r["pair_id"] == i] for i, name in enumerate(cases)}


def test_a_dark_block_is_one_major_region(detected):
    (item,) = detected["dark"]
    assert item["kind"] == "major" and item["place"] == "centre"
    assert abs(item["x"] - 24) <= 12 and abs(item["w"] - 36) <= 20


def test_a_bright_block_is_cloud_in_optical_and_change_in_radar(detected):
    assert detected["bright"] == [] and [i["kind"] for i in detected["bright radar"]] == ["major"]


def test_a_mild_colour_change_is_a_possible_region(detected):
    assert [(i["kind"], i["place"]) for i in detected["mild"]] == [("possible", "centre")]


def test_an_empty_border_is_no_change(detected):
    assert detected["border"] == [] and detected["border unmasked"] != []


def test_answer_and_details_round_trip(spark):
    pairs = spark.createDataFrame(
        [(1, [], "how many trucks are visible?", "dark pixels up (1% -> 9%).", "optical", None, None), (2, ["Zoom differs."], "", "", "sar", "2020-01-01", "2021-01-01"), (3, [], "", "", "optical", None, None)],
        "pair_id int, warnings array<string>, user_query string, measured_facts string, modality string, before_date string, after_date string",
    )
    items = spark.createDataFrame(
        [(1, 1, "major", "centre", .25, [], None, None, ""), (1, 2, "possible", "upper-left", .06, ["mining", "agriculture"], "1. Land Cover: Bare pale ground. 2. Water: There is no visible water.", "", "bright pixels 1% -> 9%")],
        "pair_id int, region_no int, kind string, place string, frac double, scans array<string>, before string, after string, measured string",
    )
    answers = change.compose_answers(pairs, items)
    text = {r["pair_id"]: r["answer"] for r in answers.collect()}
    assert text[1].splitlines() == [
        "Changed areas",
        "- Major change, centre (~25% of the scene).",
        "- Likely change, upper-left (~6% of the scene). Also flagged by the mining and agriculture scans.",
        "    Before: Bare pale ground.",
        "    After: not described",
        "    Measured: bright pixels 1% -> 9%.",
        "",
        "Your question (how many trucks are visible?) is not answered separately in comparison mode. Ask about one image in the Assistant panel for follow-up questions.",
    ]
    assert text[2].startswith("WARNING: Zoom differs.\n\nChanged areas\n- No changed area was flagged, but") and text[3] == "Changed areas\n- No changed area was found."
    old = spark.createDataFrame([(9, "Some older text.")], "pair_id int, answer string")
    parsed = change.parse_answers(answers.unionByName(old)).collect()
    area = next(r for r in parsed if r["part"] == "area" and r["item_no"] == 2)
    assert (area["kind"], area["size_pct"], area["scans"], area["before"]) == ("likely", 6, ["mining", "agriculture"], "Bare pale ground.")
    assert {(r["pair_id"], r["part"]) for r in parsed} == {(1, "area"), (1, "footer"), (2, "warning"), (2, "note"), (3, "note"), (9, "legacy")}
    lines = spark.createDataFrame([(1, 0, "mining: ...")], "pair_id int, scan_order int, line string")
    sections = {(r["pair_id"], r["section"]) for r in change.compose_details(pairs, items, lines).collect()}
    assert (2, "SAR note") in sections and (1, "Agreement between scans and flagged regions") in sections and (3, "Flagged regions") not in sections
