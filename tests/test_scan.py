import pytest

from scenequarry.operators import scan

MIXED = [[.84, .41, .15, .12], [.91, .25, .88, .27], [.91, .59, .97, .35], [.82, .62, .88, .85]]
SINGLE = [[.1] * 4, [.95, .9, .2, .1], [.1, .2, .1, .2], [.2] * 4]


def cells(spark, grid, scan_id=1, adapter="mining"):
    rows = [(scan_id, adapter, r, c, float(p)) for r, line in enumerate(grid) for c, p in enumerate(line)]
    return spark.createDataFrame(rows, "scan_id bigint, adapter string, grid_row int, grid_col int, p double")


def grid(*hot, cold=.1, warm=.9):
    g = [[cold] * 4 for _ in range(4)]
    for r, c in hot:
        g[r][c] = warm
    return g


def test_mixed_grid_gives_two_numbered_findings(spark):
    found = scan.findings(cells(spark, MIXED)).orderBy("finding_no").collect()
    assert [[f[k] for k in ("ymin", "xmin", "ymax", "xmax")] for f in found] == [[0, 0, 1, .25], [.25, .5, 1, 1]]
    assert [f["label"] for f in found] == ["High confidence"] * 2 and found[0]["peak"] == 91
    summary = scan.scan_summary(cells(spark, MIXED)).first()
    assert summary["level"] == "high" and "over-reporting" in summary["note"]


def test_half_percent_rounds_to_even_and_faint_tiles_are_counted(spark):
    one = scan.scan_summary(cells(spark, SINGLE)).first()
    assert (one["areas"], one["level"], one["coverage_pct"], one["note"]) == (1, "high", 12, "")
    faint = scan.scan_summary(cells(spark, grid((0, 0), (2, 2), warm=.6))).first()
    assert faint["level"] == "none" and faint["faint_areas"] == 2
    assert faint["headline"] == "No confident surface mining activity found. 2 faint areas scored above chance and are tinted lightly."


def test_label_uses_the_raw_score_and_level_the_rounded_one(spark):
    near = cells(spark, grid((1, 1), warm=.896))
    assert scan.findings(near).first()["label"] == "Likely" and scan.scan_summary(near).first()["level"] == "high"


def test_diagonals_do_not_join_and_an_l_shape_is_one_box(spark):
    assert scan.tile_boxes(cells(spark, grid((0, 0), (0, 1), (2, 3), (3, 2))), .5).count() == 3
    box = scan.tile_boxes(cells(spark, grid((1, 1), (2, 1), (2, 2))), .5).first()
    assert [box[k] for k in ("ymin", "xmin", "ymax", "xmax")] == [.25, .25, .75, .75]


def test_winding_group_is_one(spark):
    snake = [(0, c) for c in range(4)] + [(1, 3)] + [(2, c) for c in range(4)] + [(3, 0)]
    assert scan.findings(cells(spark, grid(*snake)), .5).count() == 1


def test_windows_cover_and_stay_inside(spark):
    scenes = spark.createDataFrame([(1, 103, 50)], "scene_id int, width int, height int")
    got = scan.tile_windows(scenes, 2, 3).collect()
    assert len(got) == 6 and min(w["left"] for w in got) == 0 and max(w["right"] for w in got) == 103 and max(w["bottom"] for w in got) == 50


def test_two_dates(spark):
    before, after = cells(spark, grid((0, 3))), cells(spark, grid((0, 3), (3, 0), (3, 3)))
    compared = scan.compare_scans(scan.match_dates(before, after))
    row = compared.first()
    assert (row["positive_before"], row["positive_after"], len(row["lost"])) == (1, 3, 0)
    line = scan.scan_change_lines(compared).first()["line"]
    assert "lower-left (row 4, col 1), lower-right (row 4, col 4). Clearly dropped: none." in line


@pytest.mark.parametrize("b, a, gained, crossed", [(.48, .52, 0, 16), (.3, .9, 16, 16), (.3, .6, 0, 16)])
def test_small_moves_are_not_gains(spark, b, a, gained, crossed):
    compared = scan.compare_scans(scan.match_dates(cells(spark, grid(cold=b)), cells(spark, grid(cold=a))))
    row = compared.first()
    assert (len(row["gained"]), row["crossed_up"]) == (gained, crossed)


def test_saturated_scan_and_shape_error(spark):
    many = grid(*[(r, c) for r in range(3) for c in range(3)])
    compared = scan.compare_scans(scan.match_dates(cells(spark, many), cells(spark, many)))
    assert compared.first()["saturated"] and "separates the dates poorly" in scan.scan_change_lines(compared).first()["line"]
    short = cells(spark, many).where("grid_row < 3")
    assert scan.compare_scans(scan.match_dates(cells(spark, many), short)).first()["error"]


def test_yes_probability_ignores_other_tokens_and_does_not_overflow(spark):
    rows = [(1, 10, 9.0), (1, 20, 0.0), (1, 3, 50.0), (2, 11, 0.0), (2, 21, 9.0), (3, 10, 4.0), (3, 20, 4.0), (4, 10, 1000.0), (4, 20, -1000.0)]
    classes = spark.createDataFrame([(10, "yes"), (11, "yes"), (20, "no"), (21, "no")], "token int, answer string")
    got = {r["row_id"]: r["p_yes"] for r in scan.yes_probability(spark.createDataFrame(rows, "row_id int, token int, logit double"), classes).collect() if r["row_id"] > 2}
    assert got == {3: .5, 4: 1.0}


def test_mean_token_probability(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 0.0), (1, 1, 0, 500.0), (1, 1, 1, -500.0)], "gen_id int, step int, token int, logit double")
    chosen = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "gen_id int, step int, token int")
    assert scan.mean_token_probability(scores, chosen).first()["probability"] == 0.75
