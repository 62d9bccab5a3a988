"""Chat formatting in budgeted windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequarry.llm.common import word_count

# Fixed values of the template. A turn is OPEN role \n text CLOSE; a window ends with END.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"

BUDGET, HISTORY = 1024, 256        # tokens of a window, and of the earlier turns repeated in front of its own
CELL = 64                          # turns of a conversation summed up at once
SYSTEM, TARGET = "system", "assistant"


def escape(text: Column) -> Column:
    """Every control string begins with [ or <: a backslash goes behind each of these, and is doubled itself."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("["), F.lit("[\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at the line's end, so its own line ends become [n, which no escaped text holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("[n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("[n"), F.lit("\n")))


def _before(turns: DataFrame) -> DataFrame:
    """``turns`` with __before: tokens of the conversation's earlier turns.

    Sums run inside cells of CELL turn numbers first, then over the cells of a conversation: a long one is many small windows and one over
    its cells' totals.
    """
    cell = turns.withColumn("__cell", F.floor(F.col("turn") / CELL))
    order = Window.partitionBy("conv_id", "__cell").orderBy("turn", "__tie", "role", "text")
    cell = cell.withColumn("__sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cell = cell.withColumn("__in_cell", F.row_number().over(order))
    totals = cell.groupBy(F.col("conv_id").alias("__conv"), F.col("__cell").alias("__of")).agg(F.sum("tokens").alias("__total"))
    cells = Window.partitionBy("__conv").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__total").over(cells), F.lit(0))).drop("__total")
    joined = cell.join(totals, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("__cell").eqNullSafe(F.col("__of")))
    return joined.withColumn("__before", F.col("__base") + F.coalesce("__sum", F.lit(0))).drop("__sum", "__base", "__conv", "__of")


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, window, formatted, own_from, loss): windows of whole turns.

    Tokens are words and two for the marks. With the tokens before each turn summed up, a turn belongs to the window in whose stride of
    budget - history tokens it begins, so a window overruns it by its last turn at most. Windows after the first start with the
    conversation's first system turn, if it came before, and with the earlier turns that begin within the last
    ``history`` tokens. ``own_from`` is the character where a window's own turns begin; ``loss`` lists (start, length) in
    characters of the target role's texts among them, so a repeated target is masked and each one counts once.

    A null text is empty and a null role is an empty role; a null turn comes first, a null conv_id is a conversation of
    its own. Turns of one number are ordered by hash, role and text; repeated rows are turns of their own. An empty
    table gives no windows, and further columns are ignored.
    """
    stride = budget - history
    given = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    given = given.withColumn("__tie", F.xxhash64("role", "text")).withColumn("tokens", word_count(F.col("text")) + 2)
    placed = _before(given).withColumn("window", F.floor(F.col("__before") / stride))
    body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    place = F.struct("__before", "turn", "__cell", "__in_cell")
    entry = placed.select(
        "conv_id", "window", "__before", place.alias("place"), (F.col("role") == SYSTEM).alias("is_system"), (F.col("role") == TARGET).alias("is_target"),
        body.alias("body"), F.length(escape(F.col("text"))).alias("chars"),
    )
    system = entry.where("is_system").groupBy(F.col("conv_id").alias("s_conv")).agg(F.min_by(F.struct("place", "window", "body"), "place").alias("s"))
    windows = entry.groupBy("conv_id", "window").agg(F.min("__before").alias("w_from"), F.array_sort(F.collect_list(F.struct("place", "body", "chars", "is_target"))).alias("own"))

    # a turn is repeated in the windows whose first turn begins at most ``history`` tokens later: these lie in the strides up to there
    later = F.explode(F.sequence(F.col("window") + 1, F.floor((F.col("__before") + history) / stride) + 1))
    again = entry.where(F.floor((F.col("__before") + history) / stride) + 1 > F.col("window")).select("conv_id", later.alias("window"), "__before", "place", "body", "is_system")
    starts = windows.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "w_from")
    again = again.join(starts, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("window") == F.col("w_window"))).where(F.col("__before") >= F.col("w_from") - history)
    again = again.groupBy(F.col("conv_id").alias("h_conv"), F.col("window").alias("h_window")).agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("h"))

    joined = windows.join(again, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("window") == F.col("h_window")), "left")
    joined = joined.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    empty = F.lit("")
    history_text = F.coalesce(F.array_join(F.transform(F.filter("h", lambda x: ~x["place"].eqNullSafe(F.col("s.place"))), lambda x: x["body"]), ""), empty)
    head = F.concat(F.when(F.col("s.window") < F.col("window"), F.col("s.body")).otherwise(empty), history_text)
    laid = joined.select("conv_id", "window", "own", head.alias("head"))
    ends = F.aggregate(
        "own", F.array(F.length("head")), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + F.length(x["body"])))
    )
    spans = F.transform(F.filter(F.zip_with("own", F.slice("ends", 2, F.size("own")), lambda x, end: F.struct(
        x["is_target"].alias("is_target"), (end - len(CLOSE) - x["chars"]).alias("start"), x["chars"].alias("length"))), lambda x: x["is_target"]),
        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    laid = laid.withColumn("ends", ends)
    formatted = F.concat("head", F.array_join(F.transform("own", lambda x: x["body"]), ""), F.lit(END))
    return laid.select("conv_id", "window", formatted.alias("formatted"), F.length("head").alias("own_from"), spans.alias("loss"))


def own_turns(formatted: Column, own_from: Column) -> Column:
    """The window's own turns read back: an array of (role, text)."""
    own = F.substring(formatted, own_from + 1, F.length(formatted) - own_from - len(END))
    bodies = F.filter(F.split(own, r"\[/INST\]"), lambda b: b != "")
    inner = F.transform(bodies, lambda b: F.substring(b, F.lit(len(OPEN) + 1), F.length(b)))
    return F.transform(inner, lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted windows alone.

    The digests of a conversation need its whole text in a row, so its windows meet here, in their order.
    """
    per = windows.select("conv_id", "window", F.length("formatted").alias("chars"), own_turns(F.col("formatted"), F.col("own_from")).alias("turns"), F.array_join(
        F.transform("loss", lambda x: unescape(F.substring("formatted", x["start"] + 1, x["length"]))), "").alias("target"))
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = per.select("conv_id", "window", "chars", F.size("turns").cast("long").alias("n"), turn_text.alias("turns"), "target")
    whole = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "target"))).alias("w"),
    )
    turns, target = F.array_join(F.col("w.turns"), ""), F.array_join(F.col("w.target"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"), "formatted_chars",
    )
