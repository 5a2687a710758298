"""Text normalisation, tokenisation and rules as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken digits and abbreviations of the transcript style.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ALIASES = {"st": "saint", "st.": "saint", "john's": "johns", "ft": "feet", "hpa": ""}
# Misspellings of broadcast words, applied in order.
PHRASES = (("ARNAV", "RNAV"), ("VISABILITY", "VISIBILITY"), ("WETHER", "WEATHER"), ("WHETHER", "WEATHER"), ("ALCIMBER", "ALTIMETER"))
# ASCII punctuation, and the full-width marks that are stripped beside it.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDE_PUNCTUATION = "。？！，、；：“”‘’（）《》【】…—～·"
# Marks that count as punctuation when manifests are flagged.
FLAG_PUNCTUATION = "，。、；：？！（）【】《》〈〉「」『』〔〕［］｛｝～·…—–"


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_text(text: Column) -> Column:
    """Lower case; anything but ASCII letters, digits and apostrophes becomes a space."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(norm_text(text), " "), lambda t: t != "")


def spoken_digits(text: Column) -> Column:
    """Digits read one by one: 240 becomes two four zero."""
    out = F.regexp_replace(text, r"([0-9])(?=[0-9])", "$1 ")
    for k, word in enumerate(DIGIT_WORDS):
        out = F.replace(out, F.lit(str(k)), F.lit(word))
    return out


def norm_asr(text: Column) -> Column:
    """norm_text with digits spelt and abbreviations opened."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    parts = F.transform(F.split(spoken_digits(norm_text(text)), " "), lambda t: F.coalesce(names[t], t))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def norm_upper(text: Column) -> Column:
    """Upper case with a decimal point read as POINT."""
    out = F.regexp_replace(F.upper(text), r"(?<=[0-9])\.(?=[0-9])", " POINT ")
    return squeeze(F.regexp_replace(out, r"[^A-Z0-9'\s]", " "))


def strip_tags(text: Column) -> Column:
    """Without <|...|> marks."""
    return F.trim(F.regexp_replace(text, r"<\|[^|]*\|>", ""))


def context_length(text: Column) -> Column:
    """Words if the text holds a space, else characters."""
    body = F.trim(text)
    return F.when(F.contains(body, F.lit(" ")), F.size(F.split(squeeze(body), " "))).otherwise(F.char_length(body))


def _class_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


def has_punctuation(text: Column) -> Column:
    return text.rlike(_class_of(ASCII_PUNCTUATION + FLAG_PUNCTUATION))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, _class_of(ASCII_PUNCTUATION + WIDE_PUNCTUATION), "")


def guess_language(text: Column) -> Column:
    """zh where CJK characters outnumber Latin letters and pass 30% of the text, or nothing is there; else en."""
    cjk = F.char_length(F.regexp_replace(text, r"[^一-鿿]", ""))
    latin = F.char_length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    n = F.char_length(text)
    return F.when(n == 0, "zh").when((cjk > latin) & (cjk > n * 0.3), "zh").otherwise("en")


def script_of(text: Column) -> Column:
    """number, english, mixed (with Chinese) or other, by the characters that occur."""
    marks = r",\.!\?:;，。！？：；、%'\s"
    return (
        F.when(text.rlike(f"^[0-9{marks}]+$"), "number").when(text.rlike(rf"^[A-Za-z0-9{marks}\-~]+$"), "english").when(text.rlike(rf"^[一-龥A-Za-z0-9{marks}\-~]+$"), "mixed").otherwise("other")
    )


def sentences(text: Column) -> Column:
    """Cut after a closing mark that white space follows."""
    marked = F.regexp_replace(text, r"([.!?。！？]+)\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def drop_sentences(text: Column, pattern: str) -> Column:
    """Text without the sentences that match."""
    return F.array_join(F.filter(sentences(text), lambda s: ~F.lower(s).rlike(pattern)), " ")


# Sentences that decoders make up over noise; each pattern condemns the whole sentence.
MADE_UP = (
    r"thank you(?:,?\s*thank you)*",
    r"b[e]{2,}p(?:,?\s*b[e]{2,}p)*",
    r"i don'?t know if you'?re ready or not",
    r"i'?ll talk to you later",
    r"if you'?re interested in talking\s+about any other things",
    r"austrian air force",
    r"siren\s+waiting",
    r"cleared for touch and go",
    r"speedbird(?:\s+ready)?",
    r"silent takeoff",
    r"softly touched to landing",
    r"bee air",
    r"box\s+(?:strong|dog)",
    r"takeoff time",
    r"\btwo seven four\b",
    r"\bryna?ir\b",
)


def decode_again(ratio: Column, log_prob: Column, no_speech: Column, most_ratio: float = 2.4, least_log_prob: float = -1.0, silence: float = 0.6) -> Column:
    """Whether a decode is repetitive (compression ratio) or unlikely (mean log-probability); silence is never decoded again. Null measures do not count."""
    bad = F.coalesce(ratio > most_ratio, F.lit(False)) | F.coalesce(log_prob < least_log_prob, F.lit(False))
    return bad & ~F.coalesce(no_speech > silence, F.lit(False))


def srt_time(ms: Column) -> Column:
    """hh:mm:ss,mmm"""
    ms = F.greatest(F.round(ms), F.lit(0)).cast("long")
    part = lambda div, mod, width: F.lpad((F.floor(ms / div) % mod).cast("string"), width, "0")
    return F.concat(part(3_600_000, 100, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), part(1, 1000, 3))


def apply_phrases(text: Column) -> Column:
    out = F.upper(text)
    for wrong, right in PHRASES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return squeeze(out)


# Words that stand for a digit in a broadcast, and its closing sentence.
SPOKEN = ("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "OH")
CLOSING = ("THAT", "YOU", "HAVE", "INFORMATION")


class Slot(NamedTuple):
    """Words that belong after a token. `around`: by distance from it, the tokens that must stand there ("#": a digit);
    `without`: alternatives, each of which, if it stands there, means that nothing lacks."""

    words: str
    around: dict[int, str]
    without: tuple[dict[int, str], ...] = ()


def _at(start: int, *tokens: str) -> dict[int, str]:
    return {start + k: x for k, x in enumerate(tokens)}


SLOTS = (
    # a time of four digits is in Zulu
    Slot("ZULU", _at(-5, "WEATHER", "AT", "#", "#", "#", "#"), (_at(1, "ZULU"),)),
    # after the time comes the wind, three digits at a speed
    Slot("WIND", _at(0, "ZULU", "#", "#", "#", "AT")),
    # a frequency has a decimal point after three digits, or after two of four
    Slot("DECIMAL", _at(-3, "FREQUENCY", "#", "#", "#", "#", "#")),
    Slot("DECIMAL", _at(-2, "FREQUENCY", "#", "#", "#", "#"), (_at(3, "#"),)),
    Slot("SAINT", _at(1, "JOHNS", "INFORMATION"), (_at(0, "SAINT"),)),
    Slot("ATC", _at(0, "INFORM", *CLOSING)),
    Slot("INFORM ATC", _at(1, *CLOSING), (_at(0, "INFORM"), _at(-1, "INFORM", "ATC"))),
)


def _filled(words: Column) -> Column:
    """Each token with the words of the slots that open after it."""

    def stands(i: Column, around: dict[int, str]) -> Column:
        out = F.lit(True)
        for offset, token in around.items():
            x = F.coalesce(F.get(words, i + offset), F.lit(""))
            out = out & (x.isin(*SPOKEN) if token == "#" else x == token)
        return out

    def one(x: Column, i: Column) -> Column:
        more = []
        for slot in SLOTS:
            lacks = stands(i, slot.around)
            for there in slot.without:
                lacks = lacks & ~stands(i, there)
            more.append(F.when(lacks, F.lit(slot.words)))
        return F.array_compact(F.array(x, *more))

    return F.transform(words, one)


def complete_grammar(text: Column) -> Column:
    """(text, fixes): adds the words that a broadcast always has, removes none; fixes counts the places.

    Words are filled in twice, since the first (ZULU) may open a place for the next (WIND). An empty token in
    front lets words come before the first.
    """
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    places = lambda filled: F.aggregate(filled, F.lit(0), lambda n, x: n + F.size(x) - 1)
    split = lambda filled: F.flatten(F.transform(filled, lambda x: F.split(F.array_join(x, " "), " ")))

    def second(first: Column) -> Column:
        return once(fill(split(first)), lambda last: F.struct(joined(last).alias("text"), (places(first) + places(last)).cast("int").alias("fixes")))

    fill = lambda words: once(words, _filled)
    joined = lambda filled: F.array_join(F.filter(split(filled), lambda x: x != ""), " ")
    words = F.concat(F.array(F.lit("")), F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return once(fill(words), second)


# What decoders invent at the end of a text.
STOCK_PHRASES = (
    "bye bye",
    "bye-bye",
    "byebye",
    "thanks",
    "thank you",
    "thank you everyone",
    "thank you for watching",
    "thank you for listening",
    "sub now",
    "subscribe now",
    "subnow",
    "subscribenow",
    "amara.org",
)


def strip_closing(text: Column) -> Column:
    """Without the stock phrases at the end, however often repeated; white space is squeezed.

    A fold from the last word to the first: where the text ends so far, the longest phrase that ends there goes.
    """
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    phrases = sorted((p.split(" ") for p in STOCK_PHRASES), key=len, reverse=True)

    def end_of(plain: Column) -> Column:
        def step(end: Column, at: Column) -> Column:
            cut = F.lit(0)
            for p in reversed(phrases):
                cut = F.when((at >= len(p)) & (F.slice(plain, F.greatest(at - len(p) + 1, F.lit(1)), len(p)) == F.array(*[F.lit(w) for w in p])), len(p)).otherwise(cut)
            return F.when(end == at, end - cut).otherwise(end)

        n = F.size(plain)
        return F.when(n == 0, 0).otherwise(F.aggregate(F.sequence(F.greatest(n, F.lit(1)), F.lit(1)), n, step))

    bare = lambda w: F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[,\-]+|[.,!\-]+$", ""))
    kept = once(words, lambda w: F.slice(w, F.lit(1), once(bare(w), end_of)))
    return F.array_join(kept, " ")


def merge_thousands(text: Column) -> Column:
    """15,240 becomes 15240; groups that are not of three digits stay."""
    whole = r"(?<![0-9.])[0-9]{1,3}(?:,[0-9]{3})+(?![0-9.])"
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    return F.aggregate(found, text, lambda t, x: F.replace(t, x, F.replace(x, F.lit(","), F.lit(""))))


def canonical_number(token: Column) -> Column:
    """Sign and digits, without decimal point; leading zeros stay."""
    body = F.ltrim(F.replace(F.replace(merge_thousands(token), F.lit("."), F.lit("")), F.lit("．"), F.lit("")))
    return F.concat(F.when(body.startswith("-"), "-").otherwise(""), F.regexp_replace(body, "^-+", ""))


def words_cjk(text: Column) -> Column:
    """Latin words whole, other characters one by one."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9']+|[^\sA-Za-z0-9']"), F.lit(0))
