"""Dates, releases, conversations, runs, uploads, coordinates and lockout on small literal tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scenequarry.functions import dates, language, places
from scenequarry.operators import chat, runs, uploads
from scenequarry.sources import records, releases, reports
from scenequarry.sources.uploads import read_session_files, read_uploads
from scenequarry.streaming import lockout, retention


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_date_texts(spark):
    texts = ["2024-01-10T05:11:21Z", "2024:01:10 05:11:21", "20240110", "2024-01-10", "", "2024-13-45", "1850-01-01", "2999-01-01", "2024-02-30"]
    got = column(spark, texts, lambda v: dates.parse_date(v, 2026))
    assert [g and (g["when"].strftime("%Y%m%d"), g["has_time"]) for g in got] == [("20240110", True)] * 2 + [("20240110", False)] * 2 + [None] * 5


def test_product_file_names(spark):
    good = ["S1A_IW_GRDH_1SDV_20240110T125034_20240110T125059_x.tif", "LC08_L1TP_144051_20240110_20240120_02_T1.tif", "a/T43PGQ_20240110T051121_B04_10m.tif"]
    bad = ["photo_20240110.png", "IMG_20240110_123456.jpg", "S2A_MSIL2A_20241345T000000_x.tif", "myS2A_MSIL2A_20240110T000000_x.tif", None]
    got = column(spark, good + bad, lambda v: dates.date_from_filename(v, 2026))
    assert all(g["trusted"] and g["when"].day == 10 for g in got[:3]) and got[3:] == [None] * 5


def test_pair_order(spark):
    struct = "struct<when: timestamp, has_time: boolean, source: string, trusted: boolean>"
    import datetime as dt

    late, early = dt.datetime(2024, 5, 1), dt.datetime(2023, 5, 1)
    rows = [(0, (late, False, "t", True), (early, False, "t", True)), (1, (late, False, "t", False), (early, False, "t", True)), (2, (late, False, "t", True), (late, False, "t", True)), (3, None, (early, False, "t", True))]
    got = dates.order_pairs(spark.createDataFrame(rows, f"i int, a {struct}, b {struct}")).orderBy("i").collect()
    assert [(r["swap"], r["basis"], len(r["warnings"])) for r in got] == [(True, "metadata", 0), (False, "as-uploaded", 1), (False, "as-uploaded", 1), (False, "as-uploaded", 0)]
    assert got[0]["before"]["when"] < got[0]["after"]["when"] and got[1]["before"] is None


def test_releases(spark):
    import json

    entry = lambda day, url="u/{level}/{row}/{col}": {"itemTitle": f"World Imagery (Wayback {day})", "itemURL": url}
    config = {"5": entry("2026-08-05"), "1": entry("2014-06-11"), "9": entry("2020-01-01"), "10": entry("2020-01-01"), "7": entry("2017-02-27"), "8": entry("2018-05-16", "u/{level}"), "6": {"itemTitle": "x"}}
    catalog = releases.one_per_date(releases.parse_catalogs(spark.createDataFrame([(json.dumps(config),)], "c string"), "c"))
    assert [(r["date"], r["id"]) for r in catalog.orderBy("date").collect()] == [("2014-06-11", "1"), ("2017-02-27", "7"), ("2020-01-01", "10"), ("2026-08-05", "5")]
    assert catalog.first()["template"] == "u/{z}/{y}/{x}"
    targets = spark.createDataFrame([("2000-01-01",), ("2030-01-01",), ("2018-07-31",), ("2018-08-01",), ("2020-01-01",)], "d string")
    got = {r["d"]: r["release_date"] for r in releases.nearest_releases(targets, catalog, "d").collect()}
    assert got == {"2000-01-01": "2014-06-11", "2030-01-01": "2026-08-05", "2018-07-31": "2017-02-27", "2018-08-01": "2020-01-01", "2020-01-01": "2020-01-01"}
    many = spark.createDataFrame([(f"{y}-0{m}-01",) for y in range(2010, 2021) for m in (1, 6)], "date string")
    assert [(r["year"], r["index"]) for r in releases.year_ticks(many).orderBy("year").collect()] == [("2010", 0), ("2012", 4), ("2014", 8), ("2016", 12), ("2018", 16), ("2020", 20)]


def test_history_window(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "ai", f"m{i}") for i in range(40)] + [(1, 40, "user", "now?")]
    rows += [(2, 0, "user", "[System] scan"), (2, 1, "tool", "x"), (2, 2, "ai", "long " * 200 + "ASSESSMENT: fine"), (2, 3, "user", "other")]
    prompts = spark.createDataFrame([(1, " now? "), (2, "q")], "conv_id int, prompt string")
    got = chat.model_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), prompts).orderBy("conv_id", "turn").collect()
    assert [r["content"] for r in got] == [f"m{i}" for i in range(34, 40)] + ["ASSESSMENT: fine", "other"]


def test_question_routes_and_clarification(spark):
    questions = ["Is there a road?", "Is it rural or urban?", "How many roads?", "Is it forest or farmland?", "Can you describe it", "Are there buildings, and where?", "describe", ""]
    assert column(spark, questions, language.question_route) == ["yes_no", "rural_urban", "numeric", "open", "open", "open", "open", "open"]
    assert column(spark, [" Hi!! ", "??", "water?", "and this?"], language.vague_opening) == ["vague", "empty", None, "vague"]
    assert column(spark, ["", "what changed?", "Any differences?", "how many trucks are visible?"], language.is_generic_question) == [True, True, True, False]


def test_captions(spark):
    stock = (
        "The image shows a satellite view of a landscape with various land cover types. Visible features include: 1. Land Cover: A mix. "
        "2. Water: There is no visible water body in the image. 3. Bare Ground: A large area."
    )
    texts = [stock, "1. Bare ground 2. Buildings 3. Roads", "There is no visible water. Nothing visible here.", "Plain prose. More.", None]
    assert column(spark, texts, language.clean_caption) == ["A mix. A large area.", "Noted: Bare ground, Buildings, Roads.", texts[2], texts[3], ""]
    text = "1. Land cover is mixed. 2. Water is visible. 3. Bare ground is seen. 4. Roads run through the area and continue on."
    limit = text.index("4.") + 3
    assert column(spark, [text], lambda v: language.clip_sentence(v, limit)) == [text[: text.index(" 4.")]]
    assert column(spark, ["word " * 100, "short one."], lambda v: language.clip_sentence(v, 50)) == [("word " * 10).strip() + "…", "short one."]


def test_coordinates(spark):
    typed = ["23.75, 86.42", "86.42E 23.75N", "23°45'N 86°25'E", "S 23 45 30 W 46", "-23.75,-46.6", "91, 0", "1 2 3", "x", "23N 24S", "23N 24", "23 61 N 4 E", "-0, 5"]
    df = spark.createDataFrame(list(enumerate(typed)), "i int, t string")
    got = places.clean_coordinates(df, "t").orderBy("i").collect()
    assert [r["reason"] for r in got] == [None] * 5 + ["latitude range", "separator", "characters", "same axis", "one letter", "minutes", None]
    assert [round(got[i]["lat"], 4) for i in (0, 1, 2, 3, 4)] == [23.75, 23.75, 23.75, -23.7583, -23.75] and got[3]["lng"] == -46


def test_report_choice_and_invalidation(spark):
    table = spark.createDataFrame([("r1", "w", "scan", 1), ("r2", "w", "chat", 2), ("r3", "v", "chat", 1)], "run_id string, workspace string, kind string, ran_at int")
    none = spark.createDataFrame([("w", "gone")], "workspace string, run_id string")
    pick = spark.createDataFrame([("w", "r2")], "workspace string, run_id string")
    assert {r["run_id"] for r in runs.report_runs(table, none).collect()} == {"r1", "r3"}
    assert {r["run_id"] for r in runs.report_runs(table, pick).collect()} == {"r2", "r3"}
    changed = spark.createDataFrame([("w", "a", 1)], "workspace string, slot string, changed_at int")
    assert {r["run_id"] for r in runs.surviving_runs(table, changed).collect()} == {"r2", "r3"}


def test_report_log_and_renames(spark, tmp_path):
    log = f"{tmp_path}/log"
    rows = [(1, "s", "q" * 3000, "t", None, 1.0), (1, "s", "new", "t", None, 2.0), (2, "x", "other", "t", None, 1.0)]
    reports.append_reports(spark.createDataFrame(rows, reports.REPORT_SCHEMA), log)
    current = reports.compact_reports(spark, log, f"{tmp_path}/now")
    assert {r["session_id"]: r["query"] for r in current.collect()} == {"s": "new", "x": "other"}
    updates = spark.createDataFrame([(1, "s", 1, " Site "), (2, "x", 1, "Mine"), (3, "s", 1, " "), (4, "s", 1, "y" * 201)], "update_id int, session_id string, user_id bigint, title string")
    renamed, rejected = runs.rename_reports(current, updates)
    assert {r["session_id"]: (r["title"], r["query"]) for r in renamed.collect()} == {"s": ("Site", "new"), "x": (None, "other")}
    assert {r["update_id"]: r["reason"] for r in rejected.collect()} == {2: "no such report", 3: "empty title", 4: "title too long"}
    assert runs.report_history(renamed).where("user_id = 1").first()["title"] == "Site"


def test_retention_and_file_sources(spark, tmp_path):
    name = "0123abcd-0123-4123-8123-0123456789ab"
    for folder in (name, "keep"):
        (tmp_path / "reports" / folder).mkdir(parents=True)
        (tmp_path / "reports" / folder / "data.json").write_text("{}")
    files = read_session_files(spark, f"{tmp_path}/reports")
    newest = {r["session"]: r["newest"] for r in runs.newest_file_times(files).collect()}
    assert set(newest) == {name, "keep"}
    later = newest[name] + 49 * 3600
    assert [r["session"] for r in runs.expired_sessions(files, later, 48).collect()] == [name]
    assert runs.expired_sessions(files, later, 0).isEmpty() and runs.expired_sessions(files, later - 2 * 3600, 48).isEmpty()


def test_uploads(spark, tmp_path):
    contents = {"0_a.png": b"\x89PNG\r\n\x1a\nxx", "1_b.tif": b"II*\x00data"}
    (tmp_path / "up" / "r1").mkdir(parents=True)
    for n, c in contents.items():
        (tmp_path / "up" / "r1" / n).write_bytes(c)
    declared = read_uploads(spark, f"{tmp_path}/up").withColumns({"declared_type": F.lit("image/png"), "modality": F.lit("SAR")})
    extra = spark.createDataFrame([("r2", 0, "c.jpg", "image/jpeg", "optical", b"text"), ("r3", 0, "d.webp", "image/webp", "optical", b"RIFF1234WEBPx")], "request_id string, idx int, file_name string, declared_type string, modality string, content binary")
    files = uploads.inventory(declared.drop("bytes").unionByName(extra))
    assert {r["file_name"]: r["kind"] for r in files.collect()} == {"a.png": "png", "b.tif": "tiff", "c.jpg": None, "d.webp": "webp"}
    verdicts = {r["request_id"]: r["reason"] for r in uploads.judge_requests(files).collect()}
    assert verdicts == {"r1": "mixed file kinds", "r2": "not an image", "r3": None}
    assert uploads.judge_requests(files, max_bytes=5).where("request_id = 'r3'").first()["reason"] == "file too large"
    assert {r["request_id"]: r["task"] for r in uploads.route_tasks(files).collect()}["r1"] == "CHANGE_DETECTION"


def test_files_over_the_limit_are_not_opened(spark, tmp_path):
    folder = tmp_path / "up" / "r1"
    folder.mkdir(parents=True)
    (folder / "0_a.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    with open(folder / "1_big.png", "wb") as big:
        big.truncate(3 << 30)                        # sparse, and longer than any binary value of Spark
    found = read_uploads(spark, f"{tmp_path}/up", max_bytes=100)
    files = uploads.inventory(found.withColumns({"declared_type": F.lit("image/png"), "modality": F.lit("optical")}))
    assert {r["idx"]: (r["kind"], r["bytes"]) for r in files.collect()} == {0: ("png", 10), 1: (None, 3 << 30)}
    assert {r["idx"]: r["reason"] for r in uploads.with_rejections(files, 100).collect()} == {0: None, 1: "file too large"}


def test_run_records_keep_broken_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query": "q", "agent_execution_trace": {"task": "T", "nodes_traversed": ["A"]}}\n{"query": \n')
    got = records.read_run_records(spark, f"{tmp_path}/a.json").cache().collect()
    assert {r["query"] for r in got} == {"q", None} and sum(r["_corrupt_record"] is not None for r in got) == 1


def attempts(spark, rows):
    return spark.createDataFrame([(a, float(t), ok, i) for i, (a, t, ok) in enumerate(rows)], "account string, t double, ok boolean, seq int")


CASES = [("a", t, False) for t in range(5)] + [("a", 10, True), ("a", 899, True), ("a", 900, True), ("b", 0, False), ("b", 1, True), ("b", 2, False), ("c", 0, False), ("c", 899, False), ("c", 901, False)]
EXPECTED = ["failed"] * 5 + ["refused", "refused", "ok", "failed", "ok", "failed", "failed", "failed", "failed"]


def test_lockout_in_batch(spark):
    got = lockout.lockout_verdicts(attempts(spark, CASES)).orderBy("seq").collect()
    assert [r["verdict"] for r in got] == EXPECTED and got[5]["wait_s"] == 891


def test_lockout_matches_a_plain_walk_on_a_hot_account(spark):
    import random

    rng, t, rows = random.Random(2), 0.0, []
    for _ in range(3000):
        t += rng.choice([1, 30, 200, 400, 1000, 40000])
        rows.append(("hot", t, rng.random() < .2))
    failures, first, expected = 0, 0.0, []
    for _, t, ok in rows:
        if failures and t >= first + 900:
            failures = 0
        if failures >= 5:
            expected.append("refused")
        elif ok:
            failures = 0
            expected.append("ok")
        else:
            first = first if failures else t
            failures += 1
            expected.append("failed")
    got = lockout.lockout_verdicts(attempts(spark, rows)).orderBy("seq").collect()
    assert [r["verdict"] for r in got] == expected and "refused" in expected


def test_lockout_as_a_stream_keeps_state_between_batches(spark, tmp_path):
    """State survives restarts, goes with its window, and rows behind the watermark have no verdict."""
    table = attempts(spark, [(a, t + 5000, ok) for a, t, ok in CASES])       # a stream's watermark begins at 0
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lockout.ROCKSDB)
    end = max(t for _, t, _ in CASES) + 5000.0
    tick = spark.createDataFrame([(None, end + 1e4, True, -1)], table.select("account", "t", "ok", "seq").schema)
    late = spark.createDataFrame([("late", 1.0, True, 999), ("new", end + 2e4, False, 1000)], tick.schema)
    columns = table.select("account", "t", "ok", "seq")
    left = []
    for part in (columns.where("t < 5003"), columns.where("t >= 5003"), tick, late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(columns.schema).parquet(f"{tmp_path}/in")
        query = lockout.lockout_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        left.append(spark.read.format("statestore").option("stateVarName", "lockout").load(f"{tmp_path}/cp").count())
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [r["verdict"] for r in got] == [*EXPECTED, "failed"]
    assert left[0] > 0 and left[2] == 0 and left[3] == 1


def test_sweep_reports_a_session_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lockout.ROCKSDB)
    a, b = "0123abcd-0123-4123-8123-0123456789ab", "1123abcd-0123-4123-8123-0123456789ab"
    schema, hour = "session string, path string, mtime double, listed double", 3600.0
    batches = [
        [(a, "x", 0.0, 10.0), (a, "y", 5 * hour, 10.0), (b, "z", 20 * hour, 10.0), ("scratch", "s", 0.0, 10.0), (a, None, None, 11.0)],
        [(None, None, None, 29 * hour + 1)],                       # a is 24 hours old
        [(None, None, None, 30 * hour), (a, "new", 30 * hour, 30 * hour)],
        [(None, None, None, 60 * hour)],                           # b, and a once more
        [(None, None, None, 90 * hour)],
    ]
    swept = []
    expire = lambda found: swept[-1].extend((r.session, r.newest / hour) for r in found.collect())
    for rows in batches:
        swept.append([])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        retention.start_sweeps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 24, expire, f"{tmp_path}/cp", every=None).awaitTermination()
    assert [sorted(s) for s in swept] == [[], [(a, 5.0)], [], [(a, 30.0), (b, 20.0)], []]
    assert spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/cp").count() == 0


def test_join_small_salts_beyond_the_bound(spark, monkeypatch):
    from scenequarry.operators import joins

    large = spark.range(1000).selectExpr("id", "id % 7 AS k")
    small = spark.range(5).selectExpr("id AS k", "id * 10 AS v")
    want = sorted(map(tuple, large.join(small, ["k"], "left").select("id", "k", "v").collect()), key=str)
    for bound in (10, 2):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
        got = joins.join_small(large, small, ["k"], "left").select("id", "k", "v").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_join_small_sends_no_salted_rows_to_the_driver(spark, monkeypatch):
    from scenequarry.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    large, small = spark.range(1000).selectExpr("id", "id % 700 AS k"), spark.range(500).selectExpr("id AS k", "id * 10 AS v")
    for one, how in ((large, "inner"), (large, "left"), (small.selectExpr("k"), "inner")):
        joined = joins.join_small(one, small, ["k"], how)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


REPORT = "session_id string, user_id long, created_at double, query string, task string, title string"


def test_latest_reports_look_texts_up(spark):
    rows = [(f"s{i % 7}" if i % 5 else None, i % 3, float(i % 11) if i % 13 else None, "q" * 1999 + f"{i}", "t", None if i % 2 else "") for i in range(200)]
    rows += rows[:40] + [("alone", 1, None, "q", "t", "x"), ("alone", 2, None, "q", "t", "x")]
    found = runs.latest_reports(spark.createDataFrame(rows, REPORT))
    assert found.columns == ["session_id", "user_id", "created_at", "task", "title", "query"]
    got = {r.session_id: tuple(r)[1:] for r in found.collect()}
    assert len(got) == found.count() == len({r[0] for r in rows})
    for session, (user, at, task, title, query) in got.items():
        times = [r[2] for r in rows if r[0] == session and r[2] is not None]
        assert at == max(times, default=None)
        if times:
            assert (session, user, at, task, title, query) in {(r[0], r[1], r[2], r[4], r[5], r[3][:2000]) for r in rows}
    assert got["alone"] == (None,) * 5
    assert "Join" in found._jdf.queryExecution().executedPlan().toString()      # texts take no part in the search for the newest


@pytest.mark.parametrize("few", [0, 10_000])
def test_report_history_orders_no_texts(spark, monkeypatch, few):
    monkeypatch.setattr(runs, "BROADCAST_ROWS", few)
    rows = [(f"s{i % 4}" if i % 9 else None, i % 3 if i % 10 else None, float(i % 8) if i % 7 else None, f"query {i % 6}", "t", ["", None, "Site"][i % 3]) for i in range(120)]
    rows += rows[:30] + rows[:10]
    found = runs.report_history(spark.createDataFrame(rows, REPORT).repartition(3), 15)
    assert found.columns == ["user_id", "position", "session_id", "created_at", "title"]
    got = found.collect()
    want = {}
    for session, user, at, query, _, title in rows:
        want.setdefault(user, []).append((-1.0 if at is None else at, session or "", title or query))
    assert sorted((r.user_id is None, r.user_id, r.position) for r in got) == sorted((u is None, u, k + 1) for u, x in want.items() for k in range(min(15, len(x))))
    for user, x in want.items():
        mine = sorted((r for r in got if r.user_id == user), key=lambda r: r.position)
        assert [(-1.0 if r.created_at is None else r.created_at, r.session_id or "") for r in mine] == sorted((v[:2] for v in x), reverse=True)[:15]
        held = Counter((-1.0 if r.created_at is None else r.created_at, r.session_id or "", r.title) for r in mine)
        assert held <= Counter(x)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()     # texts meet positions that are known
