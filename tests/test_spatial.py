"""Candidate searches over boxes, and telemetry of any depth, against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scenequarry.functions.telemetry import TOKEN, flatten_telemetry
from scenequarry.operators import spatial

SCHEMA = "id long, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, hot):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        side = rng.choice([0.01, 0.5, 1.0, 2.0, 7.0, 64.0, 900.0])
        x, y = (3.0, -2.0) if i % hot == 0 else (rng.uniform(-500, 500), rng.uniform(-50, 50))
        out.append((i, x, y, x + side * rng.choice([1, 1, 0.3]), y + side))
    return out + [(n, 1.0, 1.0, 1.0, 5.0), (n + 1, None, 0.0, 1.0, 1.0), (n + 2, 0.0, 0.0, float("inf"), 1.0), (n + 3, float("nan"), 0.0, 2.0, 1.0), (5, 0.0, 0.0, 1.0, 1.0), (n + 4, -1e300, -1.0, 1e300, 1.0), (n + 5, 1e15, 0.0, 1e15 + 1, 1e-9)]


def sound(b):
    return all(v is not None and v == v and abs(v) < 1e301 for v in b[1:]) and b[3] > b[1] and b[4] > b[2]


@pytest.mark.parametrize("hot_cell", [2000, 7])
def test_overlapping_pairs(spark, monkeypatch, hot_cell):
    monkeypatch.setattr(spatial, "HOT_CELL", hot_cell)
    a, b = boxes(1, 250, 3), boxes(2, 120, 4)
    want = sorted((p[0], q[0]) for p in a for q in b if sound(p) and sound(q) and max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    found = spatial.overlapping_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    assert sorted((r.a_id, r.b_id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    none = spark.createDataFrame([], SCHEMA)
    assert spatial.overlapping_pairs(none, spark.createDataFrame(b, SCHEMA)).count() == 0


def test_same_area_pairs_of_copies(spark):
    rows = [(i, {"south": 0.0, "west": 0.0, "north": 1.0, "east": 1.0 + (i % 2) / 8}) for i in range(30)] + [(99, None)]
    captures = spark.createDataFrame(rows, "id long, bounds struct<south: double, west: double, north: double, east: double>")
    got = spatial.same_area_pairs(captures, 0.9).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((i, j) for i in range(30) for j in range(i + 1, 30) if i % 2 == j % 2)


def tasks_of(found):
    return found.groupBy(F.spark_partition_id()).count().count()


def test_few_large_boxes_over_many_small_ones_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 20)
    small = [(i, 10.0 + i % 20, 10.0 + i // 20, 10.5 + i % 20, 10.5 + i // 20) for i in range(400)]
    large = [(-1, 0.0, 0.0, 60.0, 60.0), (-2, 0.0, 0.0, 61.0, 50.0)]
    for a, b in ((small, large), (large, small)):
        found = spatial.overlapping_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
        assert sorted((r.a_id, r.b_id) for r in found.collect()) == sorted((p[0], q[0]) for p in a for q in b)
        assert tasks_of(found) > 1


@pytest.mark.parametrize(("least", "hot_cell"), [(0.85, 7), (0.3, 2000), (1.0, 2000)])
def test_same_area_pairs_of_many_sizes(spark, monkeypatch, least, hot_cell):
    monkeypatch.setattr(spatial, "HOT_CELL", hot_cell)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        side, x, y = rng.choice([1e-6, 1.0, 1.1, 7.5, 8.0]), rng.choice([0.0, -3.0, 1e6]), rng.uniform(-1, 1) * rng.choice([0, 0.1, 1])
        rows.append((i // 2, (y, x + rng.choice([0, 0.1]) * side, y + side * rng.choice([1, 1.05, 2]), x + side * rng.choice([1, 1, 0.9, 1.2]))))
    overlap = []
    for i, (s, w, n, e) in rows:
        for j, (s2, w2, n2, e2) in rows:
            shared = max(0.0, min(n, n2) - max(s, s2)) * max(0.0, min(e, e2) - max(w, w2))
            if i < j and n > s and e > w and n2 > s2 and e2 > w2 and shared > 0 and shared / ((n - s) * (e - w) + (n2 - s2) * (e2 - w2) - shared) >= least:
                overlap.append((i, j))
    captures = spark.createDataFrame(rows, "id long, bounds struct<south: double, west: double, north: double, east: double>")
    assert sorted((r.a, r.b) for r in spatial.same_area_pairs(captures, least).collect()) == sorted(overlap)


def test_same_area_pairs_of_one_place_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 20)
    rows = [(i, (0.0, 0.0, 8.0, 8.0 + i / 1e4)) for i in range(200)]
    found = spatial.same_area_pairs(spark.createDataFrame(rows, "id long, bounds struct<south: double, west: double, north: double, east: double>"))
    assert found.count() == 199 * 100
    assert tasks_of(found) > 1


def sent_copies(monkeypatch):
    """The shares of crowded cells that the searches ask for: (of the left side, of the right side)."""
    asked = []
    monkeypatch.setattr(spatial, "join_small", lambda large, small, on, how, f=spatial.join_small: asked.extend((r._of_n, r._of_m) for r in small.collect()) or f(large, small, on, how))
    return asked


def test_copies_of_crowded_captures_do_not_grow_with_comparisons(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 10)
    monkeypatch.setattr(spatial, "BLOCKS", 4, raising=False)
    asked = sent_copies(monkeypatch)
    for n in (100, 400):
        rows = [(i, (0.0, 0.0, 8.0, 8.0 + i / 1e4)) for i in range(n)]
        asked.clear()
        found = spatial.same_area_pairs(spark.createDataFrame(rows, "id long, bounds struct<south: double, west: double, north: double, east: double>"))
        assert found.count() == n * (n - 1) // 2
        assert 1 < max(max(a) for a in asked) <= 5         # four partitions of four blocks, and a part; not n / 10


def test_copies_of_few_boxes_over_very_many_do_not_grow_with_comparisons(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 10)
    monkeypatch.setattr(spatial, "BLOCKS", 4, raising=False)
    asked = sent_copies(monkeypatch)
    small = [(i, 10.0 + i % 40, 10.0 + i // 40, 10.5 + i % 40, 10.5 + i // 40) for i in range(1600)]
    large = [(-i, 0.0, 0.0, 60.0 + i / 100, 60.0) for i in range(1, 31)]
    for a, b in ((small, large), (large, small)):
        asked.clear()
        found = spatial.overlapping_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
        assert found.count() == 30 * 1600 and tasks_of(found) > 1
        assert max(n * m for n, m in asked) <= 36          # not 3 x 160; shares are round numbers


def test_shares_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT_CELL", 10)
    monkeypatch.setattr(spatial, "MOST_SHARE", 50, raising=False)
    asked = sent_copies(monkeypatch)
    rows = [(i, (0.0, 0.0, 8.0, 8.0)) for i in range(120)]
    monkeypatch.setattr(spatial, "BLOCKS", 0.001, raising=False)
    assert spatial.same_area_pairs(spark.createDataFrame(rows, "id long, bounds struct<south: double, west: double, north: double, east: double>")).count() == 60 * 119
    assert set(asked) == {(3, 3)}


def test_scans_on_regions_by_the_tiles_they_touch(spark, monkeypatch):
    rng = random.Random(3)
    regions = [(i % 3, i, rng.randrange(-50, 420), rng.randrange(0, 300), rng.randrange(0, 200), rng.randrange(1, 150), 400, 300) for i in range(120)] + [(7, 1, 0, 0, 9, 9, 400, 300), (None, 2, 0, 0, 9, 9, 400, 300)]
    regions += [(0, 200, 90, 10, None, 250, 400, 300), (1, 201, None, 0, 5, 200, 400, 300), (2, 202, 0, 0, 9, 9, 0, 300), (2, 203, 0, 0, 90, 90, None, 300), (2, 204, 90, 9, -9, 90, 400, 300)]
    tiles = [(p, name, order, rng.randrange(rows), rng.randrange(cols), rows, cols) for p in (0, 1, 2, None) for rows, cols in ((4, 4), (3, 7)) for order, name in enumerate("cab") for _ in range(15)] * 3
    made = []
    monkeypatch.setattr(spatial, "join_small", lambda *a, f=spatial.join_small: made.append(f(*a)) or made[-1])
    found = spatial.match_scans_to_regions(
        spark.createDataFrame(regions, "pair_id int, region_no int, x int, y int, w int, h int, width int, height int"),
        spark.createDataFrame(tiles, "pair_id int, scan string, scan_order int, grid_row int, grid_col int, n_rows int, n_cols int"),
    )

    def covers(region, tile):
        _, _, x, y, w, h, width, height = region
        _, _, _, r, c, rows, cols = tile
        if width is None:
            return False
        x, end = (-math.inf, math.inf) if x is None else (x, math.inf if w is None else x + w)      # without a start or an end: up to the border
        across = max(0, min(end, (c + 1) * width / cols) - max(x, c * width / cols))
        down = max(0, min(y + h, (r + 1) * height / rows) - max(y, r * height / rows))
        return across * down >= 0.15 * (width / cols) * (height / rows)

    want = {r[:2]: [n for _, n in sorted({(t[2], t[1]) for t in tiles if t[0] is not None and t[0] == r[0] and covers(r, t)})] for r in regions}
    assert {(r.pair_id, r.region_no): r.scans for r in found.collect()} == want
    assert [m.count() for m in made][0] == 250 and made[-1].count() < 127 * 20     # 125 regions on two grids each; each pair has 90 x 3 tiles


@pytest.mark.parametrize("hot_cell", [2000, 5])
def test_outside_major_is_no_comparison_of_whole_pairs(spark, monkeypatch, hot_cell):
    monkeypatch.setattr(spatial, "HOT_CELL", hot_cell)
    rng = random.Random(5)
    some = lambda n: [(rng.choice([0, 0, 0, 1, None]), i, float(rng.randrange(300)), rng.randrange(300) - 0.5, float(rng.choice([0, 2, 40, 300])), float(rng.choice([0, 1, 60]))) for i in range(n)]
    subtle, major = some(200), some(60) + [(0, 99, 10.0, 10.0, 0.0, 0.0), (0, 98, 0.0, 0.0, -5.0, 5.0), (0, 97, 1e15, 0.0, 1.0, 1e-9)]
    subtle += [subtle[0], (0, 500, 10.0, 10.0, 0.0, 0.0), (0, 501, None, 0.0, 1.0, 1.0), (0, 502, 1e15, 0.0, 1.0, 1e-9), (0, 503, 8.0, 9.0, 4.0, 2.0)]

    def held(s, m):
        if s[0] is None or s[0] != m[0] or s[2] is None:
            return False
        cx, cy = s[2] + s[4] / 2, s[3] + s[5] / 2
        return m[2] <= cx <= m[2] + m[4] and m[3] <= cy <= m[3] + m[5]

    schema = "pair_id int, region_no int, x double, y double, w double, h double"
    found = spatial.outside_major(spark.createDataFrame(subtle, schema), spark.createDataFrame(major, schema))
    assert found.columns == ["pair_id", "region_no", "x", "y", "w", "h"]
    assert sorted(r.region_no for r in found.collect()) == sorted(s[1] for s in subtle if not any(held(s, m) for m in major))
    assert not [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in line and ">=" in line]
    assert spatial.outside_major(spark.createDataFrame(subtle, schema), spark.createDataFrame([], schema)).count() == len(subtle)


def plain(value, ascii_only):
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, list):
        return "; ".join(plain(v, ascii_only) for v in value) if value else "none"
    if isinstance(value, dict):
        return value["summary"] if isinstance(value.get("summary"), str) else json.dumps(value, ensure_ascii=ascii_only, separators=(",", ":"))
    return value if isinstance(value, str) else json.dumps(value)


def some_json(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice([None, True, False, 17, -3, "", "text", 'q"[]{}:,\\', "ü\n\t", "summary", "\\\\", '\\"'])
    if kind == 6:
        return {rng.choice(["summary", "b", "a", "c:d"]): some_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [some_json(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_telemetry_of_any_shape(spark):
    rng = random.Random(4)
    records = [{f"f{k}": some_json(rng, 5) for k in range(rng.randrange(5))} for _ in range(120)]
    rows = [(i, json.dumps(r, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None)) for i, r in enumerate(records)]
    broken = [(1000, None), (1001, ""), (1002, '{"a": 1'), (1003, '{"a": [1}'), (1004, "[1]"), (1005, '{"a": 1} {'), (1006, "7"), (1007, '{"a": "x]}')]
    got = flatten_telemetry(spark.createDataFrame(rows + broken, "k long, t string").repartition(3), "k", "t").collect()
    assert sorted((r.k, r.name, r.text) for r in got) == sorted((i, n, plain(v, i % 2 == 0)) for i, r in enumerate(records) for n, v in r.items())


def test_telemetry_of_any_depth(spark):
    deep = [(n, '{"d": ' + "[" * n + '"]["' + "]" * n + ', "e": ' + '{"a":' * n + "1" + "}" * n + "}") for n in (8, 120, 5000)]
    twice = [(1, '{"d": 1, "d": 2}')]
    got = {(r.k, r.name): r.text for r in flatten_telemetry(spark.createDataFrame(deep + twice, "k long, t string"), "k", "t").collect()}
    assert got == {(n, "d"): "][" for n in (8, 120, 5000)} | {(n, "e"): '{"a":' * n + "1" + "}" * n for n in (8, 120, 5000)} | {(1, "d"): "2"}


def test_brackets_in_a_row_are_one_token(spark):
    deep = '{"d": ' + "[ [\n" * 2500 + " " + "]" * 5000 + ', "e": {"a": ' + "[" * 50 + "] " * 50 + "}}"
    rows = spark.createDataFrame([(1, deep)], "k long, t string")
    assert rows.select(F.size(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)))).first()[0] < 20
    got = {r.name: r.text for r in flatten_telemetry(rows, "k", "t").collect()}
    assert got == {"d": "none", "e": '{"a":' + "[" * 50 + "]" * 50 + "}"}
