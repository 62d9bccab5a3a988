"""Telemetry values (any JSON) as text, at any depth: texts become tokens, and running counts of brackets say where a token stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that JSON allows in no string stand for an escaped backslash and quote, so that a string has no quote inside.
BACKSLASH, QUOTE = "\x01", "\x02"
# Brackets of lists that follow each other are one token, however many: between them only their number counts.
TOKEN = r'"[^"]*+"|\[[\[\s]*+|\][\]\s]*+|[{}:,]|[^\s\[\]{}:,"]++'
BLANKS = " \t\n\x0b\f\r"
# --- Fixed values: the words for values. ---
WORDS = {"null": "n/a", "true": "yes", "false": "no"}
NO_ENTRIES, BETWEEN, SUMMARY = "none", "; ", "summary"
# --- End of fixed values. ---


def _marked(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))


def _raw(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def _string(token: Column) -> Column:
    """What a string token stands for; only those with escapes are parsed."""
    parsed = F.get(F.from_json(F.concat(F.lit("["), _raw(token), F.lit("]")), "array<string>"), F.lit(0))
    return F.when(token.rlike(rf"[\\{BACKSLASH}{QUOTE}]"), parsed).otherwise(F.substr(token, F.lit(2), F.length(token) - 2))


def flatten_telemetry(runs: DataFrame, key: str, telemetry: str) -> DataFrame:
    """(key, name, text): one row per field of a JSON text column that holds objects.

    null, true and false become words, an object with a text ``summary`` that text, other objects their compact JSON, and lists the texts of
    their entries, of whatever depth, joined. Of fields with one name the last counts. Texts that are null or no object (brackets that
    do not match, anything behind the object) have no fields. A text's tokens are sorted in one task; the plan does not depend on the data.
    """
    marked = runs.where(F.ltrim(telemetry).startswith("{")).select(F.monotonically_increasing_id().alias("_row"), key, _marked(F.col(telemetry)).alias("_text"))
    tokens = marked.select("_row", key, F.posexplode(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))).alias("_i", "_t"))
    tokens = tokens.withColumn("_t", F.when(F.substr("_t", F.lit(1), F.lit(1)).isin("[", "]"), F.translate("_t", BLANKS, "")).otherwise(F.col("_t")))
    # a number of parts of its own: the exchange would be merged into few tasks by its compressed size
    tokens = tokens.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row")
    order = Window.partitionBy("_row").orderBy("_i")
    whole = Window.partitionBy("_row")
    t = F.col("_t")
    lists, ends = t.startswith("["), t.startswith("]")
    tokens = tokens.withColumns(
        {
            "_o": F.sum(F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).over(order), "_l": F.sum(F.when(lists, F.length(t)).when(ends, -F.length(t)).otherwise(0)).over(order),
            "_next": F.lead("_t").over(order), "_third": F.lead("_t", 2).over(order),
        }
    )
    # the record ends with its last token, nowhere before
    ended = F.sum(F.when((F.col("_o") < 1) | (F.col("_l") < 0), 1).otherwise(0)).over(whole)
    sound = tokens.withColumns({"_ended": ended, "_open": F.max(F.when(F.col("_next").isNull(), (F.col("_o") != 0) | (F.col("_l") != 0) | (t != "}"))).over(whole)})
    sound = sound.where((F.col("_ended") == 1) & ~F.col("_open"))

    within = F.greatest("_o", F.when(t == "}", F.col("_o") + 1).otherwise(F.col("_o"))) > 1         # inside an object that is a value
    key_here = (F.col("_o") == 1) & t.startswith('"') & (F.col("_next") == ":")
    empty = (F.col("_o") == 1) & lists & F.col("_next").startswith("]")
    scalar = (F.col("_o") == 1) & ~key_here & ~lists & ~ends & ~t.isin("{", "}", ":", ",")
    opens = (F.col("_o") == 2) & (t == "{")
    summary = F.when((F.col("_o") == 2) & (t == f'"{SUMMARY}"') & (F.col("_next") == ":") & F.col("_third").startswith('"'), F.col("_third"))
    parts = sound.withColumns(
        {
            "_field": F.sum(F.when(key_here, 1).otherwise(0)).over(order), "_part": F.sum(F.when(scalar | empty | opens, 1).otherwise(0)).over(order),
            "_name": F.when(key_here, t), "_value": F.when(scalar | empty | within, t), "_summary": summary,
        }
    )
    of_parts = parts.where("_value IS NOT NULL OR _name IS NOT NULL").groupBy("_row", key, "_field", F.when(F.col("_value").isNotNull(), F.col("_part")).alias("_part"))
    joined = of_parts.agg(
        F.array_sort(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_i", "_value")))).alias("_values"), F.max("_summary").alias("_summary"), F.max("_name").alias("_name"),
    )
    first, text = F.get("_values", F.lit(0))["_value"], F.array_join(F.transform("_values", lambda v: v["_value"]), "")
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    shown = (
        F.when(first == "{", F.coalesce(_string(F.col("_summary")), _raw(text))).when(first.startswith("["), NO_ENTRIES).when(first.startswith('"'), _string(first))
        .otherwise(F.coalesce(F.try_element_at(words, first), first))
    )
    fields = joined.withColumn("_shown", F.when(F.col("_part").isNotNull(), F.struct("_part", shown.alias("text")))).groupBy("_row", key, "_field").agg(
        F.max(_string(F.col("_name"))).alias("name"), F.array_sort(F.collect_list("_shown")).alias("_entries")
    )
    named = fields.where("_field > 0").groupBy("_row", key, "name").agg(F.max_by("_entries", "_field").alias("_entries"))
    return named.select(key, "name", F.array_join(F.transform("_entries", lambda e: e["text"]), BETWEEN).alias("text"))
