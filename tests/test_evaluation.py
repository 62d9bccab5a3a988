import json

import pytest
from pyspark.sql import functions as F

from scenequarry.operators import items as I
from scenequarry.operators import packing, predictor, sampling, scoring, vocabulary
from scenequarry.sources import annotations, predictions
from scenequarry.streaming import scoring as stream_scoring


def make_items(spark, sizes):
    rows, pos = [], 0
    for qtype, n in sizes.items():
        for _ in range(n):
            rows.append((str(pos), qtype, f"q{pos}", "yes" if pos % 3 else "no", [f"img{pos % 7}.tif"], pos))
            pos += 1
    return spark.createDataFrame(rows, "item_id string, qtype string, question string, answer string, image_paths array<string>, pos int")


def counts(df):
    return {r["qtype"]: r["count"] for r in df.groupBy("qtype").count().collect()}


def test_sample_keeps_shares_and_depends_on_the_seed(spark):
    items = make_items(spark, {"presence": 60, "comp": 30, "rural_urban": 10})
    first = sampling.stratified_sample(items, 20, seed=1)
    assert counts(first) == {"presence": 12, "comp": 6, "rural_urban": 2}
    ids = lambda s: {r["item_id"] for r in sampling.stratified_sample(items, 20, seed=s).collect()}
    assert ids(1) == ids(1) != ids(2)


def test_rare_types_stay_and_no_limit_keeps_all(spark):
    items = make_items(spark, {"common": 97, "x": 1, "y": 1, "z": 1})
    assert counts(sampling.stratified_sample(items, 5)) == {"common": 2, "x": 1, "y": 1, "z": 1}
    assert sampling.stratified_sample(items, None).count() == sampling.stratified_sample(items, 500).count() == 100


def test_quotas_match_the_stepwise_rule(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"t{i}": rng.randint(1, 40) for i in range(rng.randint(2, 9))}
        limit = rng.randint(1, sum(sizes.values()))
        items = make_items(spark, sizes)
        quotas = {t: max(1, round(limit * n / sum(sizes.values()))) for t, n in sizes.items()}
        while sum(quotas.values()) > limit and max(quotas.values()) > 1:
            quotas[max(quotas, key=quotas.get)] -= 1
        assert {r["qtype"]: r["quota"] for r in sampling.sample_quotas(items, limit).collect()} == quotas


def test_spaces(spark):
    rows = [("n", str(i)) for i in range(3)] + [("c", a) for a in ("yes", "no")] + [("r", a) for a in ("20_to_30", "0", "10_to_20", "0_to_10")]
    rows += [("o", f"word{i}") for i in range(13)]
    items = spark.createDataFrame(rows, "qtype string, answer string")
    got = {r["qtype"]: (r["kind"], r["options"]) for r in vocabulary.build_answer_spaces(items).collect()}
    assert got["n"] == ("numeric", []) and got["c"] == ("closed", ["no", "yes"]) and got["o"] == ("open", [])
    assert got["r"] == ("closed", ["0", "0_to_10", "10_to_20", "20_to_30"])


def test_many_spellings_are_one_option(spark):
    rows = [("presence", "yes" if i == 7 else " " * (i % 40) + "Yes" + "." * (i // 40)) for i in range(3000)] + [("presence", "no"), ("ratio", "0"), ("ratio", "0."), ("ratio", "10_to_20")]
    spaces = vocabulary.build_answer_spaces(spark.createDataFrame(rows, "qtype string, answer string"))
    got = {r["qtype"]: r["options"] for r in spaces.collect()}
    assert len(got["presence"]) == 2 and got["presence"][0] == "no" and got["presence"][1].strip(" .").lower() == "yes"
    assert got["ratio"] == ["0", "10_to_20"]


def test_wilson_and_failures_count_as_wrong(spark):
    rows = [("a", True, None)] * 2 + [("b", False, None), ("b", False, "boom")]
    summary = {r["qtype"]: r for r in scoring.accuracy_summary(spark.createDataFrame(rows, "qtype string, correct boolean, error string")).collect()}
    assert summary["(all)"]["accuracy"] == 0.5 and summary["(all)"]["errors"] == 1
    table = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("(all)", 0.5)], "qtype string, accuracy double")
    assert scoring.average_over_types(table).first()["average_over_types"] == 0.5
    assert scoring.average_over_types(table, ["b"]).first().asDict() == {"average_over_types": 1.0, "excludes": "b"}
    eight = spark.createDataFrame([("a", i < 8) for i in range(10)], "qtype string, correct boolean")
    row = scoring.accuracy_summary(eight).where("qtype = 'a'").first()
    assert abs(row["ci_low"] - 0.4902) < 1e-3 and abs(row["ci_high"] - 0.9433) < 1e-3
    empty = scoring.accuracy_summary(eight.where("false")).collect()
    assert all((r["accuracy"], r["ci_low"], r["ci_high"]) == (0.0, 0.0, 0.0) for r in empty)


@pytest.mark.parametrize(
    "rows, ece", [([(0.75, True)] * 3 + [(0.75, False)], 0.0), ([(0.95, False)] * 4, 0.95), ([(None, True)] * 3, None)]
)
def test_calibration(spark, rows, ece):
    got = scoring.calibration(spark.createDataFrame(rows, "confidence double, correct boolean")).first()["ece"]
    assert (got is None) if ece is None else abs(got - ece) < 1e-9


def test_floor(spark):
    records = spark.createDataFrame([("a", "yes")] * 3 + [("a", "no")], "qtype string, answer string")
    rows = {r["qtype"]: r for r in scoring.majority_floor(records).collect()}
    assert rows["a"]["accuracy"] == rows["(all)"]["accuracy"] == 0.75 and rows["a"]["floor_answer"] == "yes"


def test_packs_hold_every_question_once(spark):
    rows = [(str(i * 10 + q), "presence", f"q{q}", "yes" if q % 2 else "no", [f"{i}.tif"], q) for i in range(3) for q in range(10)]
    items = spark.createDataFrame(rows, "item_id string, qtype string, question string, answer string, image_paths array<string>, pos int")
    packs = packing.build_packs(items, vocabulary.build_answer_spaces(items), 4, seed=3).collect()
    assert sorted(len(p["turns"]) for p in packs) == [2, 2, 2, 4, 4, 4, 4, 4, 4]
    asked = [t["item_id"] for p in packs for t in p["turns"]]
    assert len(asked) == len(set(asked)) == 30
    assert all(int(t["item_id"]) // 10 == int(p["image_key"].split(".")[0]) for p in packs for t in p["turns"])
    messages = packing.pack_messages(packing.build_packs(items, vocabulary.build_answer_spaces(items), 4)).where("role = 'user'")
    assert {(r["position"] == 0, r["n_images"]) for r in messages.collect()} == {(True, 1), (False, 0)}


def brute_mask(tokens, start, end, header):
    mask, i = [False] * len(tokens), 0
    while i < len(tokens):
        if tokens[i] == start and tokens[i + 1 : i + 1 + len(header)] == header:
            i += 1 + len(header)
            while i < len(tokens):
                mask[i] = True
                i += 1
                if tokens[i - 1] == end:
                    break
        else:
            i += 1
    return mask


def test_loss_mask_matches_a_walk(spark):
    import random

    rng = random.Random(1)
    sequences = [[rng.choice([1, 2, 7, 8, 5]) for _ in range(60)] + [1, 7, 8, 5, 1, 7, 8, 9] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sequences)), "seq_id int, tokens array<int>")
    got = packing.loss_mask(df, 1, 2, [7, 8]).orderBy("seq_id", "pos").collect()
    for k, tokens in enumerate(sequences):
        assert [r["in_loss"] for r in got if r["seq_id"] == k] == brute_mask(tokens, 1, 2, [7, 8])


# ------------------------------------------------------------------ files


def write(path, value):
    path.write_text(json.dumps(value))


def three_files(folder, prefix):
    write(folder / f"{prefix}_questions.json", {"questions": [
        {"id": 1, "img_id": 7, "type": "presence", "question": "Is there a road?", "answers_ids": [90, 10], "active": True},
        {"id": 2, "img_id": 7, "type": "rural_urban", "question": "Is it a rural or an urban area", "answers_ids": [11]},
        {"id": 999, "img_id": 7, "type": "presence", "question": "Old?", "answers_ids": [12], "active": False}]})
    write(folder / f"{prefix}_answers.json", {"answers": [
        {"id": 10, "question_id": 1, "answer": "yes", "active": True}, {"id": 11, "question_id": 2, "answer": "urban"},
        {"id": 12, "question_id": 999, "answer": "no", "active": True}, {"id": 90, "question_id": 1, "answer": "no", "active": False}]})
    write(folder / f"{prefix}_images.json", {"images": [{"id": 7, "file_name": "00007.png", "active": True}]})


def test_three_file_layouts(spark, tmp_path):
    three_files(tmp_path, "LR_split_test")
    three_files(tmp_path, "Test")
    single = {r["item_id"]: r for r in annotations.load_benchmark(spark, "rsvqa-lr", str(tmp_path)).collect()}
    assert {k: v["answer"] for k, v in single.items()} == {"1": "yes", "2": "urban"}
    assert single["1"]["image_paths"] == [f"{tmp_path}/Images_LR/7.tif"]
    pair = annotations.load_benchmark(spark, "cdvqa", str(tmp_path), image_dir="img").first()
    assert pair["image_paths"] == ["img/im1/00007.png", "img/im2/00007.png"]
    again = annotations.convert_to_parquet(annotations.load_benchmark(spark, "rsvqa-lr", str(tmp_path)), f"{tmp_path}/items")
    assert again.count() == 2


def test_wrong_shape_unknown_name_and_flat_list(spark, tmp_path):
    three_files(tmp_path, "LR_split_test")
    write(tmp_path / "LR_split_test_questions.json", {"items": []})
    with pytest.raises(ValueError, match="expected a 'questions' list, found keys \\['items'\\]"):
        annotations.load_benchmark(spark, "rsvqa-lr", str(tmp_path))
    with pytest.raises(ValueError, match="Unknown benchmark"):
        annotations.load_benchmark(spark, "nope", str(tmp_path))
    write(tmp_path / "VRSBench_EVAL_vqa.json", [{"image_id": "a.png", "question": "?", "ground_truth": "3", "question_id": 5, "type": "count", "dataset": "d"}])
    assert annotations.load_benchmark(spark, "vrsbench-vqa", str(tmp_path)).first()["answer"] == "3"


def test_predictions_log_keeps_the_last_record_and_skips_blank_lines(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [{"seq": 1, "item_id": "a", "reply": "x"}, {"seq": 3, "item_id": "a", "reply": "z"}, {"seq": 2, "item_id": "b", "reply": "y"}]
    (folder / "part.json").write_text("\n\n".join(json.dumps(r) for r in lines) + "\n\n")
    assert {r["item_id"]: r["reply"] for r in predictions.read_predictions(spark, str(folder)).collect()} == {"a": "z", "b": "y"}


def test_run_guard(spark, tmp_path):
    config = {"benchmark": "cdvqa", "split": None, "limit": 5, "seed": 0, "predictor": "prior"}
    predictions.guard_run(spark, f"{tmp_path}/c", config)
    predictions.guard_run(spark, f"{tmp_path}/c", dict(config))
    with pytest.raises(ValueError, match="seed"):
        predictions.guard_run(spark, f"{tmp_path}/c", {**config, "seed": 1})


def test_missing_image_names_the_first_path(spark):
    items = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "c"])], "item_id string, image_paths array<string>")
    got = I.missing_images(items, spark.createDataFrame([("c",)], "path string")).collect()
    assert {r["item_id"]: r["error"][-1] for r in got} == {"1": "a", "2": "a"}


def test_stream_scoring_resumes(spark, tmp_path):
    items = make_items(spark, {"presence": 6, "comp": 4})
    spaces = vocabulary.build_answer_spaces(items)
    items.where("pos < 5").write.parquet(f"{tmp_path}/in")
    config = {"benchmark": "x"}

    def run():
        stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
        stream_scoring.start_scoring(stream, spaces, lambda items: [("yes", 0.5)] * len(items), f"{tmp_path}/run", config).awaitTermination()
        return stream_scoring.read_log(spark, f"{tmp_path}/run/predictions")

    assert run().count() == 5
    items.where("pos >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    log = run()
    assert log.count() == 10 and log.where("correct").count() == items.where("answer = 'yes'").count()
    assert run().count() == 10
    # killed before its last batch was committed: the batch is replayed and takes the place of what it had written
    commits = [c for c in (tmp_path / "run/checkpoint/commits").iterdir() if c.name.isdigit()]
    last = max(commits, key=lambda c: int(c.name))
    for c in (last, last.with_name(f".{last.name}.crc")):
        c.unlink(missing_ok=True)
    log = run()
    assert log.count() == 10 and log.select("item_id").distinct().count() == 10
    (tmp_path / "run/checkpoint/metadata").rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="checkpoint"):
        run()


def test_items_without_images_are_error_records(spark):
    items = make_items(spark, {"presence": 8})
    spaces = vocabulary.build_answer_spaces(items)
    inventory = spark.createDataFrame([(f"img{i}.tif",) for i in range(1, 7)], "path string")
    got = stream_scoring.score_new_items(items, spaces, lambda items: [("yes", None)] * len(items), None, inventory).collect()
    lost = {r["item_id"]: r["error"] for r in got if r["error"]}
    assert set(lost) == {"0", "7"} and lost["0"].endswith("img0.tif") and not any(r["correct"] for r in got if r["error"])


def test_summary_tables_are_written(spark, tmp_path):
    records = spark.createDataFrame([("a", "yes", True)], "qtype string, answer string, correct boolean")
    report = scoring.report_table(scoring.accuracy_summary(records), scoring.majority_floor(records))
    predictions.write_summary({"report": report, "lines": predictions.report_lines(report)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/report.parquet").count() == 2
    assert "| a | 1 | 100.0% |" in spark.read.json(f"{tmp_path}/lines.json").where("qtype = 'a'").first()["line"]


def test_predictor_errors_become_records(spark):
    def fails(items):
        if any(item["item_id"] == "1" for item in items):
            raise KeyError("gone")
        return [("yes", 0.5)] * len(items)

    rows = [("1", "p", None), ("2", "p", "missing"), ("3", "p", None), ("4", "p", None)]
    df = spark.createDataFrame(rows, "item_id string, prompt string, error string").coalesce(1)
    got = {r["item_id"]: (r["reply"], r["error"]) for r in predictor.run_predictor(df, fails).collect()}
    assert got == {"1": (None, "KeyError: 'gone'"), "2": (None, "missing"), "3": ("yes", None), "4": ("yes", None)}


def test_progress(spark):
    rows = [(i, i % 2 == 0, 2.0) for i in range(60)]
    got = scoring.running_progress(spark.createDataFrame(rows, "seq int, correct boolean, latency_s double"), 100, bucket_rows=7).orderBy("seq").collect()
    assert [r["done"] for r in got] == [25, 50, 60] and got[-1]["running_accuracy"] == 0.5
    assert abs(got[1]["minutes_left"] - 2.0 * 50 / 60) < 1e-9
