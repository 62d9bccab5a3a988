"""Capture dates from text, file names and raster tags, and the before / after decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.functions.answers import let

# --- Fixed values: tag names in order of trust, product naming conventions and the date shape. ---
ACQUISITION_TAGS = (
    "ACQUISITIONDATETIME", "ACQUISITION_DATETIME", "ACQUISITIONDATE", "ACQUISITION_DATE",
    "DATE_ACQUIRED", "SENSING_TIME", "SENSING_START", "PRODUCT_START_TIME",
    "DATATAKE_1_DATATAKE_SENSING_START", "FIRST_LINE_TIME",
)
FILE_TIME_TAG = "TIFFTAG_DATETIME"
PRODUCT_NAMES = (
    ("Sentinel-2 product ID", r"(?i)^S2[A-D]_MSIL[12][AC]_(\d{8})T(\d{6})_"),
    ("Sentinel-2 tile/band name", r"(?i)(?:^|_)T\d{2}[A-Z]{3}_(\d{8})T(\d{6})_"),
    ("Sentinel-1 product ID", r"(?i)^S1[A-D]_[A-Z0-9]{2}_[A-Z]{3}[A-Z_]_\d[SA][A-Z]{2}_(\d{8})T(\d{6})_"),
    ("Landsat Collection 2 scene ID", r"(?i)^L[CETOM]0?\d_[A-Z0-9]{4}_\d{6}_(\d{8})()_\d{8}_\d{2}_[A-Z0-9]{2}(?:_|$)"),
)
DATE_SHAPE = r"(\d{4})[-:/]?(\d{2})[-:/]?(\d{2})(?:[T ]+(\d{2}):?(\d{2}):?(\d{2})?)?"
FIRST_YEAR = 1972
SAME_DATE_WARNING = "Both images carry the same capture date/time; order kept as uploaded."
UNRELIABLE_WARNING = (
    "Date tags suggest Image A is later than Image B, but they are not reliable capture dates "
    "(e.g. file creation time); order kept as uploaded. Swap the uploads if that is wrong."
)
DAY = r"^\d{4}-\d{2}-\d{2}$"
# --- End of fixed values. ---


def parse_date(text: Column, reference_year: int) -> Column:
    """struct(when, has_time) from ISO, EXIF or compact text; null unless it is a real date from 1972 to next year."""
    found = F.regexp_extract(text, DATE_SHAPE, 0)
    groups = F.split(F.regexp_replace(found, DATE_SHAPE, "$1|$2|$3|$4|$5|$6"), r"\|")

    def build(parts: Column) -> Column:
        number = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("")).cast("int")
        year, month, day = (number(i) for i in (0, 1, 2))
        hour, minute, second = (F.coalesce(number(i), F.lit(0)) for i in (3, 4, 5))
        sound = (hour < 24) & (minute < 60) & (second < 60) & year.between(FIRST_YEAR, reference_year + 1)
        when = F.try_make_timestamp(year, month, day, hour, minute, second)
        has_time = F.get(parts, F.lit(3)) != ""
        return F.when(sound & when.isNotNull(), F.struct(when.alias("when"), has_time.alias("has_time")))

    return F.when(found != "", let(groups, build))


def _first_dated(candidates: Column, reference_year: int) -> Column:
    """The first of an array of (source, trusted, raw) whose raw text is a real date."""
    dated = F.transform(
        F.filter(candidates, lambda c: c["raw"] != ""),
        lambda c: F.struct(parse_date(c["raw"], reference_year).alias("p"), c["source"].alias("source"), c["trusted"].alias("trusted")),
    )
    found = F.transform(
        F.filter(dated, lambda c: c["p"].isNotNull()),
        lambda c: F.struct(
            c["p"]["when"].alias("when"), c["p"]["has_time"].alias("has_time"),
            c["source"].alias("source"), c["trusted"].alias("trusted"),
        ),
    )
    return F.get(found, F.lit(0))


def _candidate(source: str, trusted: bool, raw: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(trusted).alias("trusted"), raw.alias("raw"))


def date_from_filename(name: Column, reference_year: int) -> Column:
    """The first product naming convention that matches the whole pattern and holds a real date."""
    base = F.regexp_replace(name, r"^.*/", "")
    stem = F.regexp_replace(base, r"^(.*[^.].*)\.[^.]*$", "$1")

    def conventions(name_stem: Column) -> Column:
        return F.array(
            *[
                _candidate(
                    f"filename ({label})", True,
                    F.concat_ws("T", F.regexp_extract(name_stem, p, 1), F.regexp_extract(name_stem, p, 2)),
                )
                for label, p in PRODUCT_NAMES
            ]
        )

    return _first_dated(let(stem, conventions), reference_year)


def date_from_tags(tags: Column, reference_year: int) -> Column:
    """Acquisition tags in order (trusted), then the file-time tag (not trusted); keys are upper case."""
    candidates = [_candidate(f"raster tag {k}", True, F.try_element_at(tags, F.lit(k))) for k in ACQUISITION_TAGS]
    source = f"raster tag {FILE_TIME_TAG} (file creation time, not necessarily capture)"
    candidates.append(_candidate(source, False, F.try_element_at(tags, F.lit(FILE_TIME_TAG))))
    return _first_dated(F.array(*candidates), reference_year)


def attach_capture_dates(files: DataFrame, reference_year: int) -> DataFrame:
    """Adds ``acquired`` to files(file_name, tags): trusted tag, else file name, else untrusted tag."""
    return (
        files.withColumn("_tag", date_from_tags(F.col("tags"), reference_year))
        .withColumn("_name", date_from_filename(F.col("file_name"), reference_year))
        .withColumn("acquired", F.when(F.col("_tag.trusted"), F.col("_tag")).otherwise(F.coalesce("_name", "_tag")))
        .drop("_tag", "_name")
    )


def capture_text(acquired: Column) -> Column:
    return F.when(
        acquired["has_time"], F.concat(F.date_format(acquired["when"], "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    ).otherwise(F.date_format(acquired["when"], "yyyy-MM-dd"))


def order_pairs(pairs: DataFrame) -> DataFrame:
    """Adds swap, basis, before, after and warnings to pairs with ``a`` and ``b`` capture dates.

    Only two trusted dates may swap a pair; equal dates keep the upload order with a warning, unreliable ones
    never reorder but warn when they point the other way.
    """
    a, b = F.col("a"), F.col("b")
    trusted = F.coalesce(a["trusted"] & b["trusted"], F.lit(False))
    later = F.coalesce(a["when"] > b["when"], F.lit(False))
    same = F.coalesce(a["when"] == b["when"], F.lit(False))
    swap = trusted & later
    return pairs.withColumns(
        {
            "swap": swap,
            "basis": F.when(trusted & ~same, "metadata").otherwise("as-uploaded"),
            "before": F.when(swap, b).when(trusted, a),
            "after": F.when(swap, a).when(trusted, b),
            "warnings": F.array_compact(
                F.array(
                    F.when(trusted & same, F.lit(SAME_DATE_WARNING)),
                    F.when(~trusted & later, F.lit(UNRELIABLE_WARNING)),
                )
            ),
        }
    )


def dates_by_source(files: DataFrame) -> DataFrame:
    return files.groupBy(
        F.coalesce(F.col("acquired.source"), F.lit("none")).alias("source"),
        F.coalesce(F.col("acquired.trusted"), F.lit(False)).alias("trusted"),
    ).agg(F.count(F.lit(1)).alias("files"))


def time_range(text: Column) -> tuple[Column, Column, Column]:
    """(from, to, reason) of 'day' or 'day/day'; both null for blank text, which means no restriction."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    parts = F.transform(F.split(raw, "/"), lambda p: F.trim(p))
    start = F.get(parts, F.lit(0))
    end = F.coalesce(F.get(parts, F.lit(1)), start)
    reason = (
        F.when((F.size(parts) > 2) | ~start.rlike(DAY) | ~end.rlike(DAY), "shape")
        .when(F.try_to_date(start, "yyyy-MM-dd").isNull() | F.try_to_date(end, "yyyy-MM-dd").isNull(), "no such day")
        .when(start > end, "reversed")
    )
    usable = (raw != "") & reason.isNull()
    return (
        F.when(usable, F.concat(start, F.lit("T00:00:00Z"))),
        F.when(usable, F.concat(end, F.lit("T23:59:59Z"))),
        F.when(raw != "", reason),
    )


def merged_tags(tag_rows: DataFrame) -> DataFrame:
    """(scene_id, tags): all namespaces merged with upper-case keys, the later namespace winning."""
    winners = tag_rows.groupBy("scene_id", F.upper("key").alias("key")).agg(F.max_by("value", "ns_order").alias("value"))
    return winners.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tags"))
