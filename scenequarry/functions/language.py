"""Question routing, clarification, history clipping and caption cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenequarry.functions.answers import let, squeeze, strip

# --- Fixed values: word lists and patterns the routing and cleaning rules depend on. ---
YES_NO_OPENERS = (
    "is", "are", "was", "were", "does", "do", "did", "can", "could", "has", "have", "had", "will", "would", "should",
)
COUNT_QUESTION = r"^(how many|what is the (number|amount|count) of|what's the number of|number of|count (the|how))\b"
RURAL_URBAN = r"\b(rural|urban)\b.*\b(rural|urban)\b"
POLITE_REQUEST = r"^(can|could|would|will) (you|u)\b"
OPEN_WORD = r"\b(describe|explain|tell|show|list|identify|highlight|locate|where|which|what|why|how)\b"
EITHER_OR = r"\bor\b"
VAGUE_OPENINGS = (
    "hi", "hii", "hiii", "hey", "heyy", "hello", "yo", "sup", "hola", "namaste",
    "test", "testing", "ok", "okay", "k", "cool", "nice", "thanks", "thank you",
    "and this", "go on", "more info", "tell me more", "what about it",
)
GENERIC_QUESTION = r"chang|differ|compar|what.*(happen|new)|^\s*$"
CAPTION_OPENER = (
    r"^\s*The (?:image|crop) shows a satellite (?:view|image) of [^.:]*[.:]\s*(?:Visible features include:?\s*)?"
)
ITEM_NUMBER = r"(?:(?<=\s)|^)\d+\.\s+"
ITEM_LABEL = r"(?:(?<=\s)|^)\d+\.\s+[A-Z][^:.]{1,40}:\s*"
ABSENCE = (
    r"\b(?:there (?:is|are) no|no visible|not visible|nothing visible|"
    r"no (?:[\w-]+ ){0,3}(?:is|are) (?:visible|present))\b"
)
ASSESSMENT = "ASSESSMENT:"
PSEUDO_TURN = "[System]"
HISTORY_TURNS = 6
HISTORY_CHARS = 500
CAPTION_CHARS = 500
ELLIPSIS = "…"
# --- End of fixed values. ---


def _unicode(pattern: str, flags: str = "U") -> str:
    return f"(?{flags})" + pattern


def question_route(question: Column) -> Column:
    """rural_urban | numeric | yes_no | open."""
    text = squeeze(F.lower(question))
    first = F.regexp_extract(text, r"^([^\s,?]*)", 1)
    yes_no = (
        first.isin(*YES_NO_OPENERS)
        & ~text.rlike(_unicode(EITHER_OR))
        & ~text.rlike(_unicode(POLITE_REQUEST))
        & ~text.rlike(_unicode(OPEN_WORD))
    )
    return (
        F.when(text == "", "open")
        .when(text.rlike(_unicode(RURAL_URBAN)), "rural_urban")
        .when(text.rlike(_unicode(COUNT_QUESTION)), "numeric")
        .when(yes_no, "yes_no")
        .otherwise("open")
    )


def adapter_route(question: Column) -> Column:
    """The route when the trained adapter may answer; counts and open questions are not sent to it."""
    route = question_route(question)
    return F.when(route.isin("yes_no", "rural_urban"), route)


def display_answer(kind: Column, options: Column, predicted: Column) -> Column:
    """What a person is shown: digits for numbers, a capitalised option for closed answers, else null."""
    capitalised = F.concat(F.upper(F.substring(predicted, 1, 1)), F.lower(F.substr(predicted, F.lit(2))))
    return F.when(kind == "numeric", F.when(predicted.rlike(r"^[0-9]+$"), predicted)).when(
        F.array_contains(options, predicted), capitalised
    )


def vague_opening(query: Column) -> Column:
    """empty | vague | null for the opening question of a conversation."""
    text = F.regexp_replace(F.lower(query), _unicode(r"^[?!.,\s]+|[?!.,\s]+$"), "")
    return F.when(text == "", "empty").when(text.isin(*VAGUE_OPENINGS), "vague")


def is_generic_question(query: Column) -> Column:
    return F.coalesce(query, F.lit("")).rlike(_unicode(GENERIC_QUESTION, "iUd"))


def clip_history(text: Column, limit: int = HISTORY_CHARS) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit(ELLIPSIS))
    )


def compress_turn(role: Column, text: Column) -> Column:
    """A user turn clipped; an assistant turn cut to its assessment first."""
    at = F.instr(text, ASSESSMENT)
    conclusion = F.when(at > 0, F.substr(text, at)).otherwise(text)
    return clip_history(F.when(role == "assistant", conclusion).otherwise(text))


def strip_emphasis(text: Column) -> Column:
    return F.replace(text, F.lit("*"), F.lit(""))


def _without_numbering(body: Column) -> Column:
    """List labels and numbers removed from prose; a bare numbered list becomes one sentence."""
    unlabelled = F.regexp_replace(F.regexp_replace(body, _unicode(ITEM_LABEL), ""), _unicode(ITEM_NUMBER), "")
    parts = F.transform(
        F.split(body, _unicode(ITEM_NUMBER)), lambda p: F.regexp_replace(p, r"^[ ,;.]+|[ ,;.]+$", "")
    )
    listed = let(
        F.filter(parts, lambda p: p != ""),
        lambda kept: F.when(F.size(kept) > 0, F.concat(F.lit("Noted: "), F.array_join(kept, ", "), F.lit("."))).otherwise(""),
    )
    return F.when(~body.rlike(_unicode(ITEM_NUMBER)), body).when(body.contains(":"), unlabelled).otherwise(listed)


def clean_caption(text: Column) -> Column:
    """A caption without its stock opener, list numbering and sentences that only report an absence; never emptied."""

    def clean(original: Column) -> Column:
        body = F.regexp_replace(original, _unicode(CAPTION_OPENER, "iU"), "")
        sentences = F.split(let(body, _without_numbering), _unicode(r"(?<=[.!?])\s+"))
        # every absence phrase holds "no", so most sentences skip the pattern
        kept = F.filter(sentences, lambda s: (s != "") & ~(F.lower(s).contains("no") & s.rlike(_unicode(ABSENCE, "iU"))))
        return let(strip(F.array_join(kept, " ")), lambda cleaned: F.when(cleaned != "", cleaned).otherwise(original))

    return let(squeeze(F.coalesce(text, F.lit(""))), clean)


def clip_sentence(text: Column, limit: int = CAPTION_CHARS) -> Column:
    """Shortened at the last sentence end that fits (a list number is not one), else at a word with an ellipsis."""

    def clip(flat: Column) -> Column:
        head = F.substring(flat, 1, limit)
        sentence = F.regexp_extract(head, rf"(?s)^(.*(?<!(?:^|\s)\d{{1,{limit}}}\s?)[.!?])(?=\s|$)", 1)
        word = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[,;:]+$", "")
        fits = lambda s: F.when((s != "") & (F.length(s) >= limit // 3), s).otherwise(F.concat(word, F.lit(ELLIPSIS)))
        return F.when(F.length(flat) <= limit, flat).otherwise(let(sentence, fits))

    return let(squeeze(F.coalesce(text, F.lit(""))), clip)
