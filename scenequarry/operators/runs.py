"""Run history, report choice, retention and account tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.functions.answers import strip
from scenequarry.operators.joins import BROADCAST_ROWS
from scenequarry.session import cut_lineage

# --- Fixed values: run kinds, limits and folder pattern. ---
ANNOTATED_KINDS = ("scan", "change", "fusion")
KINDS_BY_SLOT = {
    "a": ("chat", "scan"),
    "before": ("change",),
    "after": ("change",),
    "optical": ("fusion",),
    "sar": ("fusion",),
}
HISTORY_LIMIT = 100
QUERY_CHARS = 2000
TITLE_CHARS = 200
SESSION_FOLDER = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# --- End of fixed values. ---


def report_runs(runs: DataFrame, picks: DataFrame) -> DataFrame:
    """The run each workspace's report uses: its pick if that run exists, else the newest annotated, else the newest."""
    joined = runs.join(picks.select("workspace", F.col("run_id").alias("pick")), "workspace", "left")
    rank = F.struct(
        F.coalesce(F.col("pick") == F.col("run_id"), F.lit(False)).alias("picked"),
        F.col("kind").isin(*ANNOTATED_KINDS).alias("annotated"),
        F.col("ran_at"),
        F.col("run_id"),
    )
    return joined.groupBy("workspace").agg(F.max_by(F.struct("run_id", "kind", "ran_at"), rank).alias("r")).select(
        "workspace", "r.*"
    )


def latest_runs(runs: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    wanted = runs.where(F.col("kind").isin(*kinds)) if kinds else runs
    return wanted.groupBy("workspace").agg(F.max_by(F.struct("run_id", "kind", "ran_at"), F.struct("ran_at", "run_id")).alias("r")).select(
        "workspace", "r.*"
    )


def surviving_runs(runs: DataFrame, slot_changes: DataFrame) -> DataFrame:
    """Runs still meaningful after image changes(workspace, slot, changed_at): a run is dropped when an image of
    one of its slots changed at or after it."""
    kinds = F.create_map(
        *[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(k) for k in x]) for pair in KINDS_BY_SLOT.items() for x in pair]
    )
    changed = (
        slot_changes.select("workspace", "changed_at", F.explode(F.element_at(kinds, F.col("slot"))).alias("kind"))
        .groupBy("workspace", "kind")
        .agg(F.max("changed_at").alias("changed_at"))
    )
    joined = runs.join(changed, ["workspace", "kind"], "left")
    return joined.where(F.col("changed_at").isNull() | (F.col("ran_at") > F.col("changed_at"))).drop("changed_at")


def _mark(*columns: str) -> list[Column]:
    """96 bits that stand for a row, nulls told from each other."""
    told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*told).alias("_h"), F.hash(*told).alias("_g")]


def _marked_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with a wanted mark. Few marks go to every task; else rows are dealt out by their mark and pass by the marks, without being sorted."""
    mark = ["_h", "_g"]
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), mark)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *mark).join(wanted.repartition(parts, *mark).hint("shuffle_hash"), mark)


def report_history(reports: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Each user's newest ``limit`` reports, titled by their own title, else by the query.

    Rows are ordered by what is short and stand for by a mark; their texts are looked up afterwards and are sorted nowhere. Rows that come
    several times have several positions and one text.
    """
    row, mark = ["user_id", "session_id", "created_at"], ["_h", "_g"]
    titled = reports.select(*row, F.coalesce(F.nullif("title", F.lit("")), F.col("query")).alias("title"))
    marked = titled.select("*", *_mark(*row, "title"))
    short = cut_lineage(marked.select(*row, *mark))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("session_id"), *mark)
    placed = short.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)
    placed = placed.groupBy(*mark).agg(F.min("position").alias("position"), F.max("position").alias("_last"))
    placed = cut_lineage(placed.join(short.groupBy(*mark).agg(F.count(F.lit(1)).alias("_copies")), mark))
    shown = ["user_id", "position", "session_id", "created_at", "title"]
    once = _marked_rows(marked, placed.where("_copies = 1")).select(*shown)
    if placed.where("_copies > 1").isEmpty():
        return once
    copies = _marked_rows(marked, placed.where("_copies > 1")).dropDuplicates(mark)
    return once.unionByName(copies.withColumn("position", F.explode(F.sequence("position", "_last"))).select(*shown))


def latest_reports(changes: DataFrame) -> DataFrame:
    """Insert-or-replace over an append-only log: the newest row per session, its query clipped.

    The newest row is found by its mark, without its texts, which are looked up afterwards.
    """
    columns = [c for c in changes.columns if c not in ("session_id", "query")]
    clipped = changes.select("session_id", *columns, F.substring("query", 1, QUERY_CHARS).alias("query"))
    marked = clipped.select("*", *_mark(*clipped.columns))
    newest = cut_lineage(marked.groupBy("session_id").agg(F.max("created_at").alias("created_at"), F.max_by("_h", "created_at").alias("_h"), F.max_by("_g", "created_at").alias("_g")))
    wanted = newest.where("created_at IS NOT NULL").select("_h", "_g").distinct()
    row = F.struct(*columns, "query")
    found = _marked_rows(marked, wanted).groupBy("session_id").agg(F.max_by(row, "created_at").alias("r")).select("session_id", "r.*")
    untimed = newest.where("created_at IS NULL").select("session_id")
    return found.unionByName(untimed, allowMissingColumns=True)


def rename_reports(reports: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply updates(update_id, session_id, user_id, title); returns (reports, rejected updates with a reason).

    When several valid updates name one report, the one with the largest ``update_id`` stays.
    """
    title = strip(F.coalesce(F.col("new_title"), F.lit("")))
    owners = reports.select("session_id", F.col("user_id").alias("owner"))
    judged = (
        updates.withColumnRenamed("title", "new_title")
        .withColumn("new_title", title)
        .join(owners, "session_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("new_title") == "", "empty title")
            .when(F.length("new_title") > TITLE_CHARS, "title too long")
            .when(~F.col("owner").eqNullSafe(F.col("user_id")), "no such report"),
        )
    )
    valid = judged.where("reason IS NULL").groupBy("session_id").agg(F.max_by("new_title", "update_id").alias("new_title"))
    renamed = reports.join(valid, "session_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")
    return renamed, judged.where("reason IS NOT NULL").select("update_id", "session_id", "user_id", "reason")


def owned_reports(requests: DataFrame, reports: DataFrame) -> DataFrame:
    return requests.join(reports.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi")


def valid_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests(request_id, token, now) joined to live sessions(token_hash, user_id, expires_at)."""
    hashed = requests.withColumn("token_hash", F.sha2("token", 256))
    live = hashed.join(sessions, "token_hash").where(F.col("expires_at") > F.col("now"))
    return live.select("request_id", "user_id")


def newest_file_times(files: DataFrame) -> DataFrame:
    return files.groupBy("session").agg(F.max("mtime").alias("newest"))


def expired_sessions(files: DataFrame, now: float, max_age_hours: float) -> DataFrame:
    """Session folders whose newest file is older than the limit; a limit of 0 or less expires nothing."""
    newest = newest_file_times(files.where(F.col("session").rlike(SESSION_FOLDER)))
    return newest.where(F.lit(max_age_hours > 0) & (F.col("newest") < now - max_age_hours * 3600))


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Runs, warnings and failures by task and stage with subtotals; traces(task, nodes, warnings, status)."""
    staged = traces.select("task", "status", F.size("warnings").alias("warned"), F.explode("nodes").alias("stage"))
    return (
        staged.rollup("task", "stage")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.sum("warned").alias("warnings"),
            F.count_if(F.col("status") != "completed").alias("not_completed"),
        )
        .withColumns({"task": F.coalesce("task", F.lit("(all)")), "stage": F.coalesce("stage", F.lit("(all)"))})
    )
