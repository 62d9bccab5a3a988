"""Stateful rules in batch and stream form, and the predictor hooks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from scenequarry.operators import predictor, scoring, vocabulary
from scenequarry.plans import evaluation
from scenequarry.plans.bindings import bind, oracle, table
from scenequarry.plans.registry import Register
from scenequarry.session import ensure_checkpoint_dir
from scenequarry.streaming import lockout, retention
from scenequarry.streaming import scoring as stream_scoring

query = Register()
QUERIES, ORACLES = query.queries, query.oracles


def work_folder(spark) -> str:
    """A fresh folder beside the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams-{uuid.uuid4()}"


FOLD = oracle(
    "attempts",
    """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, seq) AS rn FROM attempts),
f AS (SELECT account, CAST(0 AS BIGINT) AS rn, 0 AS fails, CAST(0 AS DOUBLE) AS first_at, CAST(0 AS DOUBLE) AS t, CAST(0 AS BIGINT) AS seq, '' AS verdict, CAST(NULL AS BIGINT) AS wait_s FROM (SELECT DISTINCT account FROM attempts)
  UNION ALL SELECT a.account, a.rn,
    CASE WHEN f.fails >= 5 AND f.first_at + 900 > a.t THEN f.fails WHEN a.ok THEN 0 WHEN f.fails > 0 AND f.first_at + 900 > a.t THEN f.fails + 1 ELSE 1 END,
    CASE WHEN f.fails >= 5 AND f.first_at + 900 > a.t THEN f.first_at WHEN a.ok THEN 0 WHEN f.fails > 0 AND f.first_at + 900 > a.t THEN f.first_at ELSE a.t END, a.t, a.seq,
    CASE WHEN f.fails >= 5 AND f.first_at + 900 > a.t THEN 'refused' WHEN a.ok THEN 'ok' ELSE 'failed' END,
    CASE WHEN f.fails >= 5 AND f.first_at + 900 > a.t THEN CAST(floor(f.first_at + 900 - a.t) AS BIGINT) + 1 END
  FROM f JOIN a ON a.account = f.account AND a.rn = f.rn + 1)
SELECT account, seq, verdict, wait_s FROM f WHERE rn > 0""",
)


@query("lockout_verdicts", FOLD)
def lockout_verdicts(spark, d):
    return lockout.lockout_verdicts(bind(spark, d, "attempts")).select("account", "seq", "verdict", "wait_s")


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@contextmanager
def rocksdb(spark):
    """The state store that the stateful streams need, for as long as they run."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, lockout.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(provider, before)


@query("lockout_stream", FOLD)
def lockout_stream(spark, d):
    """The attempts arrive as files of a quarter of the time each, then a tick far behind the last one; at the end no account has state."""
    attempts = bind(spark, d, "attempts").select("account", F.col("t").cast("double").alias("t"), "ok", "seq")
    folder = work_folder(spark)
    start, end = attempts.agg(F.min("t"), F.max("t")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("t") - start) / (end - start) * 4))
    tick = spark.createDataFrame([(None, end + 1e5, True, -1)], attempts.schema).coalesce(1)
    with rocksdb(spark):
        for part in [*(attempts.where(quarter == k) for k in range(4)), tick]:
            part.write.mode("append").parquet(f"{folder}/in")
            running = (
                lockout.lockout_stream(spark.readStream.schema(attempts.schema).parquet(f"{folder}/in")).writeStream.format("parquet")
                .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            )
            running.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "lockout").load(f"{folder}/checkpoint").count()
    if left:
        raise RuntimeError(f"{left} rows of state are left after the last window")
    return spark.read.schema(lockout.VERDICTS).parquet(f"{folder}/out").select("account", "seq", "verdict", "wait_s")


NOW, MAX_AGE = 1706659200.0, 24.0


@query(
    "retention_stream",
    oracle("session_files", f"SELECT session, max(mtime) AS newest FROM session_files WHERE session NOT LIKE 'scratch%' GROUP BY session HAVING max(mtime) < {NOW} - {MAX_AGE} * 3600"),
)
def retention_stream(spark, d):
    """The inventory as it is listed, then a tick of the clock, at which the timers up to now fire."""
    h = F.md5(F.col("user_id").cast("string"))
    uuid_like = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    seconds = F.unix_timestamp("ts").cast("double")
    inventory = table(spark, d, "events").select(
        F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("scratch"), F.col("user_id").cast("string"))).otherwise(uuid_like).alias("session"),
        F.col("event_id").cast("string").alias("path"), seconds.alias("mtime"), F.least(seconds, F.lit(NOW - 1)).alias("listed"),
    )
    folder = work_folder(spark)
    expire = lambda expired: expired.write.mode("append").parquet(f"{folder}/out")
    tick = spark.createDataFrame([(None, None, None, NOW)], inventory.schema).coalesce(1)
    with rocksdb(spark):
        for part in (inventory, tick):
            part.write.mode("append").parquet(f"{folder}/in")
            arriving = spark.readStream.schema(inventory.schema).parquet(f"{folder}/in")
            retention.start_sweeps(arriving, MAX_AGE, expire, f"{folder}/checkpoint", every=None).awaitTermination()
    return spark.read.schema(retention.EXPIRED).parquet(f"{folder}/out")


def sample_predictor(items: list[dict]) -> list[tuple[str, float | None]]:
    """A stand-in model: fails on a batch with a nineteenth item and answers others from the prompts alone."""
    if any(item["pos"] % 19 == 0 for item in items):
        raise ValueError("unreadable")

    def other(prompt: str) -> tuple[str, None]:
        return ("There are twelve." if "number" in prompt else "low vegetation"), None

    return [("Yes.", 0.75) if "yes or no" in item["prompt"] else other(item["prompt"]) for item in items]


ANSWERED = """an AS (SELECT i.*, CASE WHEN pos % 19 = 0 THEN NULL WHEN qtype = 'presence' THEN 'Yes.' WHEN qtype = 'count' THEN 'There are twelve.' ELSE 'low vegetation' END AS reply,
  CASE WHEN pos % 19 <> 0 AND qtype = 'presence' THEN 0.75 END AS confidence, CASE WHEN pos % 19 = 0 THEN 'ValueError: unreadable' END AS error FROM items i)"""


@query("predictor_replies", oracle("items", f"WITH {ANSWERED} SELECT item_id, reply, confidence, error FROM an"))
def predictor_replies(spark, d):
    items = evaluation.items(spark, d)
    prompted = scoring.with_prompts(items, vocabulary.build_answer_spaces(items))
    return predictor.run_predictor(prompted, sample_predictor).select("item_id", "reply", "confidence", "error")


@query(
    "captioned_crops",
    oracle("boxes", "SELECT region_no, CASE WHEN region_no % 11 = 0 THEN '' ELSE 'crop ' || x || ' ' || y END AS caption FROM boxes"),
)
def captioned_crops(spark, d):
    def captioner(crops: list[dict]) -> list[str]:
        if any(crop["region_no"] % 11 == 0 for crop in crops):
            raise RuntimeError("no caption")
        return [f" crop  {crop['x']}\n{crop['y']} " for crop in crops]

    return predictor.run_captioner(bind(spark, d, "boxes"), captioner).select("region_no", "caption")


@query(
    "incremental_scoring",
    oracle(
        "items",
        f"""WITH {ANSWERED} SELECT item_id, CASE WHEN error IS NULL THEN CASE qtype WHEN 'presence' THEN 'yes' WHEN 'count' THEN '12' WHEN 'land_cover' THEN 'low_vegetation' ELSE 'low vegetation' END END AS predicted,
CASE WHEN error IS NULL AND ((qtype = 'presence' AND answer = 'yes') OR (qtype = 'count' AND answer = '12') OR (qtype = 'land_cover' AND answer = 'low_vegetation')) THEN 1 ELSE 0 END AS correct, error FROM an""",
    ),
)
def incremental_scoring(spark, d):
    """Items arrive as a stream of files; a second run finds everything answered and appends nothing."""
    found = evaluation.items(spark, d)
    folder = work_folder(spark)
    found.write.parquet(f"{folder}/items")
    items = spark.read.schema(found.schema).parquet(f"{folder}/items")
    spaces = vocabulary.build_answer_spaces(items)
    config = {"benchmark": evaluation.BENCHMARK, "split": "test", "limit": 0, "seed": 0, "predictor": "sample"}
    for _ in range(2):
        arriving = spark.readStream.schema(items.schema).parquet(f"{folder}/items")
        stream_scoring.start_scoring(arriving, spaces, sample_predictor, f"{folder}/run", config).awaitTermination()
    return stream_scoring.read_log(spark, f"{folder}/run/predictions").select(
        "item_id", "predicted", F.col("correct").cast("int").alias("correct"), "error"
    )
