"""Answer matching as column expressions: normalisation, readable forms, canonical answers, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: answer codes, number words, patterns and prompt sentences the scores depend on. ---
MAX_CLOSED_OPTIONS = 12
READABLE_CODES = {
    "NVG_surface": "non-vegetated ground surface",
    "low_vegetation": "low vegetation",
}
NUMBER_WORDS = {
    "zero": 0, "none": 0, "no": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20,
}
RATIO_CODE = r"^(\d+)_to_(\d+)$"
YES_NO_INSTRUCTION = "Answer with yes or no only."
CLOSED_INSTRUCTION = ("Answer with exactly one of: ", ". Reply with the answer only.")
NUMERIC_INSTRUCTION = "Answer with a single number in digits only."
OPEN_INSTRUCTION = "Answer with a single word or a short phrase only."
PAIR_LEAD = (
    "The first image is the earlier date (before) and the second image is the later date (after) of the same area. "
)
# --- End of fixed values. ---

WORD = r"\p{L}\p{N}_"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Blanks of every kind removed from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case without punctuation (letters, digits, ``_`` and ``%`` stay), articles or extra blanks."""
    cleaned = F.regexp_replace(F.lower(text.cast("string")), rf"(?U)[^{WORD}\s%]", " ")
    return squeeze(F.regexp_replace(cleaned, rf"(?<![{WORD}])(a|an|the)(?![{WORD}])", " "))


def readable(code: Column) -> Column:
    """An answer code as shown to a person: class codes as words, ratio buckets as percent ranges."""
    shown = None
    for key, words in READABLE_CODES.items():
        shown = F.when(code == key, F.lit(words)) if shown is None else shown.when(code == key, F.lit(words))
    ranged = F.concat(F.regexp_extract(code, RATIO_CODE, 1), F.lit("-"), F.regexp_extract(code, RATIO_CODE, 2), F.lit("%"))
    return shown.when(code.rlike(RATIO_CODE), ranged).when(code == "0", F.lit("0%")).otherwise(code)


def is_digits(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def as_integer_text(digits: Column) -> Column:
    """'007' -> '7', '000' -> '0'; text arithmetic, so any length is safe."""
    return F.regexp_replace(digits, r"^0+(?=[0-9])", "")


def option_order(code: Column) -> Column:
    """Sort key of an answer option: ratio buckets in numeric order with '0' first, then the rest by text."""
    number = F.when(code.rlike(RATIO_CODE), F.regexp_extract(code, RATIO_CODE, 1).cast("long")).when(
        code == "0", F.lit(-1).cast("long")
    )
    return F.struct(
        F.when(number.isNotNull(), 0).otherwise(1).alias("group"),
        F.coalesce(number, F.lit(0).cast("long")).alias("number"),
        F.when(number.isNotNull(), F.lit("")).otherwise(normalize(code)).alias("text"),
        code.alias("code"),
    )


def option_forms(options: Column) -> Column:
    """Per option: its position, code and the normalised names it can be recognised by."""
    return F.transform(
        options,
        lambda code, i: F.struct(
            i.alias("ord"),
            code.alias("code"),
            F.array_distinct(F.array(normalize(code), normalize(readable(code)))).alias("names"),
        ),
    )


def numeric_answer(text: Column) -> Column:
    """From normalised text: the first digit run, else the first number word, else the text itself."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], str(pair[1]))])
    known = F.filter(F.split(text, " "), lambda w: w.isin(*NUMBER_WORDS))
    digits = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(digits != "", as_integer_text(digits)).when(
        F.size(known) > 0, F.element_at(words, F.get(known, F.lit(0)))
    ).otherwise(text)


def closed_answer(text: Column, forms: Column) -> Column:
    """From normalised text: the option named exactly, else the one named earliest (longest name on ties)."""
    exact = F.filter(forms, lambda f: F.array_contains(f["names"], text))

    def whole_word(name: Column) -> Column:
        return F.concat(F.lit(rf"(?<![{WORD}-])\Q"), name, F.lit(rf"\E(?![{WORD}-])"))

    hits = F.flatten(
        F.transform(
            forms,
            lambda f: F.transform(
                f["names"],
                lambda name: F.struct(
                    F.regexp_instr(text, whole_word(name)).alias("start"),
                    (-F.length(name)).alias("neg_len"),
                    f["ord"].alias("ord"),
                    f["code"].alias("code"),
                ),
            ),
        )
    )
    found = F.array_min(F.filter(hits, lambda h: h["start"] > 0))
    return F.when(F.size(exact) > 0, F.get(exact, F.lit(0))["code"]).otherwise(F.coalesce(found["code"], text))


def canonical(kind: Column, forms: Column, reply: Column) -> Column:
    """A model reply mapped onto the answer space of its question type."""
    text = normalize(reply)
    return F.when(kind == "numeric", numeric_answer(text)).when(
        kind == "closed", closed_answer(text, forms)
    ).otherwise(text)


def is_correct(kind: Column, predicted: Column, reply: Column, answer: Column) -> Column:
    """Whether ``predicted`` (the canonical form of ``reply``) answers the question; null replies are wrong."""
    gold = normalize(answer)
    gold_number = as_integer_text(gold)
    closed = (predicted == answer) | (normalize(predicted) == gold)
    numeric = predicted == F.when(is_digits(gold), gold_number).otherwise(gold)
    open_ = F.when(is_digits(gold), numeric_answer(normalize(reply)) == gold_number).otherwise(predicted == gold)
    return F.coalesce(F.when(kind == "closed", closed).when(kind == "numeric", numeric).otherwise(open_), F.lit(False))


def instruction(kind: Column, options: Column) -> Column:
    yes_no = F.sort_array(F.transform(options, normalize)) == F.array(F.lit("no"), F.lit("yes"))
    listed = F.array_join(F.transform(options, readable), ", ")
    return (
        F.when((kind == "closed") & yes_no, F.lit(YES_NO_INSTRUCTION))
        .when(kind == "closed", F.concat(F.lit(CLOSED_INSTRUCTION[0]), listed, F.lit(CLOSED_INSTRUCTION[1])))
        .when(kind == "numeric", F.lit(NUMERIC_INSTRUCTION))
        .otherwise(F.lit(OPEN_INSTRUCTION))
    )


def benchmark_prompt(question: Column, kind: Column, options: Column, is_pair: Column, note: Column | None = None) -> Column:
    asked = strip(question)
    asked = F.when(asked.endswith("?"), asked).otherwise(F.concat(asked, F.lit("?")))
    lead = F.when(is_pair, F.lit(PAIR_LEAD)).otherwise(F.lit(""))
    return F.concat_ws("\n", F.concat(lead, asked), instruction(kind, options), note if note is not None else F.lit(None))


def target_text(kind: Column, answer: Column) -> Column:
    """The answer as a training target: readable when closed, plain integer when numeric."""
    return F.when(kind == "closed", readable(answer)).when(
        kind == "numeric", as_integer_text(strip(answer))
    ).otherwise(answer)
