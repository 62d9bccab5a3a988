import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.operators import fusion, measures, radiometry, ranking, rasters, stencils


def pixel_table(spark, arrays, scene_id=0, valid=None):
    h, w = next(iter(arrays.values())).shape
    rows = [
        (scene_id, r, c, *[float(a[r, c]) for a in arrays.values()], True if valid is None else bool(valid[r, c]), h, w, "optical")
        for r in range(h) for c in range(w)
    ]
    names = ", ".join(f"{n} double" for n in arrays)
    return spark.createDataFrame(rows, f"scene_id bigint, row int, col int, {names}, valid boolean, height int, width int, modality string")


def to_array(df, value):
    rows = df.select("row", "col", value).collect()
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r[value]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).integers(0, 256, (9, 14)).astype(float)


def window_mean(img, k, mode):
    p = np.pad(img, k, mode=mode)
    return np.array([[p[r : r + 2 * k + 1, c : c + 2 * k + 1].mean() for c in range(img.shape[1])] for r in range(img.shape[0])])


@pytest.mark.parametrize("window", [3, 7])
def test_box_mean_mirrors_edges(spark, noise, window):
    got = to_array(rasters.box_mean(pixel_table(spark, {"v": noise}), ["scene_id"], ["v"], window), "v")
    assert np.allclose(got, window_mean(noise, window // 2, "symmetric"))


def test_blur_wider_than_the_scene(spark, noise):
    weights = np.array(rasters.gaussian_weights(21))
    p = np.pad(noise, 10, mode="reflect")
    flat = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 1, p)
    expected = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 0, flat)
    got = to_array(rasters.gaussian_blur(pixel_table(spark, {"v": noise}), ["scene_id"], ["v"], 21), "v")
    assert np.allclose(got, expected)


def plain_blur(img, size, sigma=None):
    weights, half = np.array(rasters.gaussian_weights(size, sigma)), size // 2
    flat = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 1, np.pad(img, half, mode="reflect"))
    return np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 0, flat)


@pytest.mark.parametrize("line", [1024, 8, 3])
def test_blur_of_many_sizes_in_blocks(spark, monkeypatch, line):
    """Scenes of three sizes and kernels in one call, lines cut into blocks shorter than a kernel."""
    monkeypatch.setattr(stencils, "LINE", line)
    rng = np.random.default_rng(1)
    images = {0: rng.random((9, 14)), 1: rng.random((20, 31)), 2: rng.random((1, 5))}
    sizes = {0: (21, 2.0), 1: (9, 0.7), 2: (3, 1.5)}
    table = None
    for i, img in images.items():
        one = pixel_table(spark, {"v": img, "w": 2 * img}, i)
        table = one if table is None else table.unionByName(one)
    by = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, s in sizes.items() for x in (k, s[n])]), F.col("scene_id").cast("int"))
    out = rasters.gaussian_blur(table, ["scene_id"], ["v", "w"], by(0), by(1))
    assert out.columns == table.columns and out.count() == table.count()
    for i, img in images.items():
        assert np.allclose(to_array(out.where(F.col("scene_id") == i), "v"), plain_blur(img, *sizes[i]))
        assert np.allclose(to_array(out.where(F.col("scene_id") == i), "w"), 2 * plain_blur(img, *sizes[i]))


def test_kernels_of_all_sizes_have_one_plan(spark, noise):
    def operators(size):
        plan = rasters.gaussian_blur(pixel_table(spark, {"v": noise}), ["scene_id"], ["v"], size)._jdf.queryExecution().optimizedPlan().toString()
        return len(plan.splitlines()), len(plan)

    small, large = operators(21), operators(169)
    assert small[0] == large[0] and abs(small[1] - large[1]) < 20


def test_nulls_reach_as_far_as_the_kernel(spark):
    img = np.ones((1, 12))
    table = pixel_table(spark, {"v": img}).withColumn("v", F.when(F.col("col") != 6, F.col("v")))
    got = rasters.gaussian_blur(table, ["scene_id"], ["v"], 5).orderBy("col").collect()
    assert [r["v"] is None for r in got] == [4 <= c <= 8 for c in range(12)]


@pytest.mark.parametrize("tile", [128, 6])
def test_bilateral_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(stencils, "TILE", tile)
    rng = np.random.default_rng(2)
    images = {0: rng.integers(0, 255, (9, 14)).astype(float), 1: rng.integers(0, 255, (3, 20)).astype(float)}
    table = pixel_table(spark, {"v": images[0]}, 0).unionByName(pixel_table(spark, {"v": images[1]}, 1))
    out = rasters.bilateral_filter(table, ["scene_id"], "v", 5, 40.0, F.when(F.col("scene_id") == 0, 3.0).otherwise(1.5))
    for i, img in images.items():
        p, want = np.pad(img, 2, mode="reflect"), np.zeros_like(img)
        for r, c in np.ndindex(img.shape):
            w = {(y, x): np.exp(-(y * y + x * x) / (2 * (3.0 if i == 0 else 1.5) ** 2) - (p[r + 2 + y, c + 2 + x] - img[r, c]) ** 2 / 3200) for y in range(-2, 3) for x in range(-2, 3) if x * x + y * y <= 4}
            want[r, c] = sum(v * p[r + 2 + y, c + 2 + x] for (y, x), v in w.items()) / sum(w.values())
        assert np.allclose(to_array(out.where(F.col("scene_id") == i), "v"), want)


def test_erosion_of_many_sizes(spark):
    rng = np.random.default_rng(3)
    masks = {0: rng.random((20, 30)) < 0.97, 1: rng.random((6, 9)) < 0.9}
    table = None
    for i, mask in masks.items():
        one = pixel_table(spark, {"v": mask.astype(float)}, i, mask)
        table = one if table is None else table.unionByName(one)
    out = rasters.erode_valid(table, ["scene_id"], "valid", F.when(F.col("scene_id") == 0, 7).otherwise(3)).withColumn("e", F.col("valid").cast("double"))
    for i, half in ((0, 3), (1, 1)):
        p = np.pad(masks[i], half, constant_values=True)
        want = np.array([[p[r : r + 2 * half + 1, c : c + 2 * half + 1].all() for c in range(masks[i].shape[1])] for r in range(masks[i].shape[0])])
        assert np.array_equal(to_array(out.where(F.col("scene_id") == i), "e").astype(bool), want)


def test_gradient_matches_numpy(spark, noise):
    gy, gx = np.gradient(noise)
    assert np.allclose(to_array(rasters.gradient(pixel_table(spark, {"v": noise}), ["scene_id"], "v", "e"), "e"), np.hypot(gx, gy))


def test_scene_measures(spark):
    img = np.zeros((4, 4))
    green = np.full((4, 4), 90.0)
    row = measures.scene_measures(pixel_table(spark, {"r": img, "g": green, "b": img}), ["scene_id"]).first()
    assert (row["green_dominant_pct"], row["dark_pct"], row["edge_pct"], row["mean_g"]) == (100, 0, 0, 90)
    hidden = pixel_table(spark, {"r": img, "g": img, "b": img}, valid=np.zeros((4, 4)))
    row = measures.scene_measures(hidden, ["scene_id"]).first()
    assert (row["width_px"], row["dark_pct"], row["edge_pct"], row["mean_g"]) == (4, None, None, None)
    assert measures.scene_facts(measures.scene_measures(hidden, ["scene_id"])).first()["facts"] == "image 4x4 px; no valid pixels."


def test_groups_and_bands_without_valid_pixels_stay(spark):
    img = np.full((4, 4), 90.0)
    hidden = pixel_table(spark, {"r": img, "g": img, "b": img}, valid=np.zeros((4, 4))).withColumn("group_id", F.lit(1))
    stretched = radiometry.stretch(hidden, radiometry.shared_bounds(hidden))
    assert stretched.count() == 16 and stretched.where("r + g + b > 0").isEmpty()
    bands = hidden.selectExpr("scene_id", "1 AS band", "row", "col", "r AS value", "valid", "height", "width")
    filled = radiometry.fill_invalid(bands)
    assert filled.count() == 16 and filled.where("value IS NOT NULL").isEmpty()
    assert [tuple(r) for r in fusion.unfused_pairs(hidden.withColumnRenamed("scene_id", "pair_id")).collect()] == [(hidden.first()["scene_id"], "no valid radar pixels")]


def test_percentiles_with_one_huge_value(spark):
    df = spark.range(100_000).selectExpr("if(id = 7, 1e12, cast(pmod(hash(id), 99991) AS double)) AS v")
    values = [r["v"] for r in df.collect()]
    got = ranking.exact_percentiles(df, [], "v", {"lo": .02, "mid": .5, "top": 1.0}).first()
    assert np.allclose(list(got), np.percentile(values, [2, 50, 100]))


def test_percentiles_match_numpy_with_hot_and_tiny_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": np.concatenate([rng.normal(0, 1, 3000), np.zeros(3000), [1e6]]), "one": np.array([4.5]), "flat": np.full(50, 7.0), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values], "k string, v double")
    got = {r["k"]: r for r in ranking.exact_percentiles(df, ["k"], "v", {"lo": .02, "mid": .5, "hi": .98}).collect()}
    for k, values in groups.items():
        assert np.allclose([got[k]["lo"], got[k]["mid"], got[k]["hi"]], np.percentile(values, [2, 50, 98])), k
    whole = ranking.exact_percentiles(df, [], "v", {"mid": .5}).first()["mid"]
    assert np.isclose(whole, np.median(np.concatenate(list(groups.values()))))


def test_ranks_and_running_sums_across_buckets(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.floor(F.col("id") / 17).alias("b"))
    rows = ranking.bucketed_row_number(df, ["k"], "b", ["v"], "rn").collect()
    assert all(r["rn"] == r["v"] // 3 + 1 for r in rows)
    sums = ranking.bucketed_running_sum(df, ["k"], "b", ["v"], {"s": F.col("v")}).collect()
    assert all(r["s"] == sum(range(r["v"] % 3, r["v"] + 1, 3)) for r in sums)
    before = ranking.bucketed_previous(df, ["k"], "b", "v", "v", "p").collect()
    assert all(r["p"] == (r["v"] - 3 if r["v"] >= 3 else None) for r in before)


def lee(x, window):
    k = window // 2
    mean = window_mean(x, k, "symmetric")
    ci2 = np.maximum(window_mean(x * x, k, "symmetric") - mean**2, 0) / np.maximum(mean**2, 1e-12)
    cu2 = np.clip(np.percentile(ci2, 25), .02, .5)
    return mean + np.clip(1 - cu2 / np.maximum(ci2, 1e-12), 0, 1) * (x - mean)


def radar_table(spark, values, scene_id=1):
    return pixel_table(spark, {"value": values}, scene_id).withColumn("band", F.lit(1))


def test_despeckling_smooths_flat_ground_and_treats_units_alike(spark):
    linear = 5.0 * np.random.default_rng(0).gamma(4, 1 / 4, (40, 40))
    none = spark.createDataFrame([], "scene_id bigint")
    from_linear = to_array(radiometry.despeckle(radar_table(spark, linear - 0.0), none), "value")
    db = 10 * np.log10(linear)
    from_db = to_array(radiometry.despeckle(radar_table(spark, db), none), "value")
    assert np.allclose(from_linear, 10 * np.log10(lee(linear, 7)))
    assert (db < 0).any() and np.allclose(from_db, from_linear)
    assert from_linear.std() < db.std() / 2


def test_preview_despeckling_of_gray_and_colour(spark):
    rng = np.random.default_rng(3)
    gray, other = rng.integers(0, 256, (2, 12, 12)).astype(float)
    for g in (gray, other):
        out = radiometry.despeckle_previews(pixel_table(spark, {"r": gray, "g": g, "b": gray}))
        assert np.array_equal(to_array(out, "g"), np.floor(np.clip(lee(g, 5), 0, 255) + 1e-9))


def test_unchanged_ground_stays_unchanged_under_one_stretch(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 4000, (16, 16)).astype(float)
    b = a.copy()
    b[:4, :4] = 9000
    pair = pixel_table(spark, {c: a for c in "rgb"}, 1).unionByName(pixel_table(spark, {c: b for c in "rgb"}, 2)).withColumn("group_id", F.lit(1))
    out = radiometry.stretch(pair, radiometry.shared_bounds(pair))
    one, two = (to_array(out.where(f"scene_id = {s}"), "r") for s in (1, 2))
    assert np.array_equal(one[4:, :], two[4:, :]) and one.max() <= 255


def test_area_resize_keeps_the_mean(spark, noise):
    got = to_array(rasters.area_resize(pixel_table(spark, {"v": noise}), ["scene_id"], ["v"], F.lit(4), F.lit(5)), "v")
    assert got.shape == (4, 5) and np.isclose(got.mean(), noise.mean())
