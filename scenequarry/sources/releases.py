"""Imagery-release catalogues: parsing, nearest release and year ticks.

After ``one_per_date`` a catalogue holds at most one row per calendar day, so windows over it stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: catalogue fields and template placeholders. ---
ENTRY = "map<string, struct<itemTitle: string, itemURL: string>>"
TITLE_DATE = r"(\d{4}-\d{2}-\d{2})"
PLACEHOLDERS = (("{level}", "{z}"), ("{row}", "{y}"), ("{col}", "{x}"))
MAX_TICKS = 6
# --- End of fixed values. ---


def parse_catalogs(catalogs: DataFrame, column: str) -> DataFrame:
    """(id, date, template) from JSON text {id: {itemTitle, itemURL}}; entries without a date or a full URL drop out."""
    entries = catalogs.select(F.explode(F.from_json(column, ENTRY)).alias("id", "entry"))
    url = F.col("entry.itemURL")
    template = url
    complete = url.isNotNull()
    for theirs, ours in PLACEHOLDERS:
        complete = complete & url.contains(theirs)
        template = F.regexp_replace(template, rf"^(.*?)\Q{theirs}\E", "$1" + ours.replace("{", r"\{").replace("}", r"\}"))
    dated = entries.select("id", F.regexp_extract("entry.itemTitle", TITLE_DATE, 1).alias("date"), template.alias("template"), complete.alias("_ok"))
    return dated.where(F.col("_ok") & (F.col("date") != "")).drop("_ok")


def one_per_date(releases: DataFrame) -> DataFrame:
    """The release with the largest numeric id of each date."""
    return (
        releases.groupBy("date")
        .agg(F.max_by(F.struct("id", "template"), F.col("id").cast("long")).alias("r"))
        .select("date", "r.*")
    )


def nearest_releases(targets: DataFrame, releases: DataFrame, day: str) -> DataFrame:
    """Adds the release nearest to each target's ``day`` text (ties to the older one).

    Only the distinct days are matched (backward and forward fill over the union of days); the targets then
    join on the day itself.
    """
    days = targets.select(F.col(day).alias("date")).distinct()
    timeline = days.select("date", F.lit(None).cast("string").alias("release"), F.lit(True).alias("wanted")).unionByName(
        releases.select("date", F.col("date").alias("release"), F.lit(False).alias("wanted"))
    )
    ordered = Window.partitionBy(F.lit(0)).orderBy("date")
    backward = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forward = ordered.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    filled = timeline.select(
        "date",
        "wanted",
        F.max("release").over(backward).alias("older"),
        F.min("release").over(forward).alias("newer"),
    ).where("wanted")
    gap = lambda c: F.abs(F.date_diff(F.to_date(c), F.to_date("date")))
    nearest = F.when(F.col("newer").isNull() | (gap("older") <= gap("newer")), F.col("older")).otherwise(F.col("newer"))
    matched = filled.select(F.col("date").alias(day), nearest.alias("release_date"))
    return targets.join(matched, day, "left")


def year_ticks(releases: DataFrame, max_ticks: int = MAX_TICKS) -> DataFrame:
    """(year, index): the first release of each year, thinned to at most ``max_ticks`` evenly spaced ones."""
    ordered = releases.select(
        F.substring("date", 1, 4).alias("year"),
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("index"),
    )
    firsts = ordered.groupBy("year").agg(F.min("index").alias("index"))
    everything = Window.partitionBy(F.lit(0))
    placed = firsts.withColumns(
        {
            "_i": F.row_number().over(everything.orderBy("year")) - 1,
            "_n": F.count(F.lit(1)).over(everything),
        }
    )
    step = (F.col("_n") - 1) / F.lit(max_ticks - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(max_ticks - 1)), lambda k: F.floor(k * step + 0.5))
    keep = (F.col("_n") <= max_ticks) | F.array_contains(chosen, F.col("_i").cast("long"))
    return placed.where(keep).select("year", "index")
