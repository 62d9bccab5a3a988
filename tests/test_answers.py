from pyspark.sql import functions as F

from scenequarry.functions import answers as A


def canonical(spark, kind, options, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    opts = F.array(*[F.lit(o) for o in options]) if options else F.array().cast("array<string>")
    out = df.select("i", A.canonical(F.lit(kind), A.option_forms(opts), F.col("reply")).alias("p")).orderBy("i").collect()
    return [r["p"] for r in out]


def test_yes_no_replies(spark):
    got = canonical(spark, "closed", ["no", "yes"], ["Yes.", "No, there is no water.", "I do not know", "The answer: YES"])
    assert got == ["yes", "no", "i do not know", "yes"]


def test_numbers_in_digits_and_words(spark):
    got = canonical(spark, "numeric", [], ["There are twelve.", "three", "None.", "about 007 trucks", "many"])
    assert got == ["12", "3", "0", "7", "many"]


def test_codes_and_ratio_buckets(spark):
    options = ["0", "0_to_10", "10_to_20", "20_to_30"]
    assert canonical(spark, "closed", options, ["10-20%", "0%", "it is 0-10%", "20_to_30"]) == ["10_to_20", "0", "0_to_10", "20_to_30"]
    land = ["NVG_surface", "low_vegetation", "water"]
    assert canonical(spark, "closed", land, ["It changed to low vegetation", "non vegetated ground surface"]) == ["low_vegetation", "NVG_surface"]


def test_normalisation_keeps_letters_digits_and_percent(spark):
    texts = ["  The A-frame, é 50%! ", "a%the b", "Banana theory", "an_apple the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", A.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == ["frame é 50%", "% b", "banana theory", "an_apple"]


def test_correctness_rules(spark):
    rows = [
        ("closed", "yes", "Yes.", "yes", True),
        ("numeric", "4", "four", "4", True),
        ("numeric", "4", "four", "04", True),
        ("open", "a red thing", "red thing", "Red thing", True),
        ("open", "3", "three", "3", True),
        ("open", "harbour", "harbour", "port", False),
        ("closed", None, None, "yes", False),
    ]
    df = spark.createDataFrame(rows, "kind string, predicted string, reply string, answer string, expected boolean")
    got = df.select(A.is_correct(F.col("kind"), F.col("predicted"), F.col("reply"), F.col("answer")).alias("c"), "expected").collect()
    assert [r["c"] for r in got][:2] == [True, True] and got[4]["c"] and not got[5]["c"] and not got[6]["c"]
    assert got[2]["c"]


def test_prompts(spark):
    df = spark.createDataFrame([("Is there a road",)], "q string")
    yes_no = F.array(F.lit("yes"), F.lit("no"))
    prompt = df.select(A.benchmark_prompt(F.col("q"), F.lit("closed"), yes_no, F.lit(True), F.lit("Note.")).alias("p")).first()["p"]
    assert prompt.startswith("The first image is the earlier date") and prompt.endswith("Is there a road?\nAnswer with yes or no only.\nNote.")
