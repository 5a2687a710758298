"""Words with times: marks that belong to neighbours, long words, surface spans of tokens, sentences shared among speakers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that go to the word after, and to the word before.
OPENING, CLOSING = "\"'“¿([{-", "\"'.。,，!！?？:：”)]}、"
SENTENCE_ENDS = ".。!！?？"

Word = tuple[str, float, float]
_space = re.compile(r"\s*").match


def attach_marks(words: list[Word], opening: str = OPENING, closing: str = CLOSING) -> list[Word]:
    """Opening marks (with the space before them) join the next word, closing marks the word before, which keep their times.

    A run of opening marks joins one word; marks without such a neighbour stay. An opening mark that stands after a word without a
    space is a closing one.
    """
    joined: list[Word] = []
    for text, begin, stop in reversed(words):
        # from the end, so that the last of a run of marks has its word already
        if joined and text.startswith(" ") and len(text.strip()) == 1 and text.strip() in opening:
            joined[-1] = (text + joined[-1][0], *joined[-1][1:])
        else:
            joined.append((text, begin, stop))
    out: list[Word] = []
    for text, begin, stop in reversed(joined):
        if out and len(text) == 1 and text in closing and not out[-1][0].endswith(" "):
            out[-1] = (out[-1][0] + text, *out[-1][1:])
        else:
            out.append((text, begin, stop))
    return out


def shorten(words: list[Word], most_median: float = 0.7, ends: str = SENTENCE_ENDS) -> list[Word]:
    """Words over twice the median length are cut at sentence ends: a mark keeps its begin, the word after one its end.

    The median is that of words with a length, and most_median at most.
    """
    lengths = sorted(b - a for _, a, b in words if b > a)
    if not lengths:
        return list(words)
    k = len(lengths) // 2
    most = 2 * min(most_median, lengths[k] if len(lengths) % 2 else (lengths[k - 1] + lengths[k]) / 2)
    out = list(words)
    for k in range(1, len(words)):
        text, begin, stop = words[k]
        if stop - begin <= most:
            continue
        if text in ends:
            out[k] = (text, begin, begin + most)
        elif words[k - 1][0] in ends:
            out[k] = (text, stop - most, stop)
    return out


def surface_spans(text: str, tokens: list[str]) -> list[tuple[int, int]] | None:
    """Where each token stands in the text, in order, with nothing but white space between; None if they do not cover it. Case is not told apart."""
    out, at = [], 0
    for token in tokens:
        at = _space(text, at).end()
        stop = at + len(token)
        if text[at:stop].casefold() != token.casefold():
            return None
        out.append((at, stop))
        at = stop
    return out if _space(text, at).end() == len(text) else None


def marked(text: str, tokens: list[str], marks: list[str]) -> str | None:
    """The text as it stands, with a mark after each token that has one; None if the tokens do not cover it."""
    spans = surface_spans(text, tokens)
    if spans is None:
        return None
    ends = [0, *[b for _, b in spans]]
    return "".join(text[a:b] + m for a, b, m in zip(ends, ends[1:], marks)) + text[ends[-1] :]


def share_sentence(begin: int, stop: int, text: str, turns: list[tuple[int, int, int]], least: int = 3000) -> list[tuple[int | None, int, int, str]]:
    """(speaker, begin, stop, text) of the parts of a sentence (ms) that speakers' turns (begin, stop, speaker) divide.

    Turns are cut to the sentence. A part goes on while the speaker is the same, and takes a turn shorter than `least` along; what is
    still shorter at the front joins the part after it, at the end the one before. Text is shared by time and cut
    at the end of a word (anywhere where there is no space). A sentence without two parts stays whole, without a speaker if no turn overlaps it.
    """
    pieces = [(max(begin, a), min(stop, b), s) for a, b, s in turns if min(stop, b) > max(begin, a)]
    runs: list[list[int]] = []
    for a, b, s in pieces:
        if runs and (s == runs[-1][2] or b - a < least):
            runs[-1][1] = b
        else:
            runs.append([a, b, s])
    parts: list[list[int]] = []
    waits: int | None = None
    for a, b, s in runs:
        a = a if waits is None else waits
        waits = a if b - a < least else None
        if waits is None:
            parts.append([a, b, s])
    if waits is not None and parts:
        parts[-1][1] = runs[-1][1]
    if len(parts) < 2:
        return [(parts[0][2] if parts else runs[-1][2] if runs else None, begin, stop, text)]
    total, out, at = sum(b - a for a, b, _ in parts), [], 0
    for k, (a, b, s) in enumerate(parts):
        cut = len(text) if k == len(parts) - 1 else min(len(text), at + max(1, len(text) * (b - a) // total))
        space = text.find(" ", cut)
        if 0 < cut < len(text) and " " in text and not text[cut - 1].isspace():
            cut = space if space >= 0 else len(text)
        if text[at:cut].strip():
            out.append((s, a, b, text[at:cut].strip()))
        at = cut
    return out


_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("begin", T.DoubleType()), T.StructField("stop", T.DoubleType())]))
_PARTS = T.ArrayType(T.StructType([T.StructField("speaker", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.pandas_udf(_WORDS)
def words_with_marks(words: pd.Series) -> pd.Series:
    """Long words cut, then marks attached, of arrays of (word, begin, stop)."""
    made = [attach_marks(shorten([(w["word"], w["begin"], w["stop"]) for w in own])) for own in words]
    return pd.Series([[dict(zip(("word", "begin", "stop"), w)) for w in own] for own in made])


@F.pandas_udf(_SPANS)
def token_spans(text: pd.Series, tokens: pd.Series) -> pd.Series:
    found = [surface_spans(t, list(k)) for t, k in zip(text, tokens)]
    return pd.Series([None if s is None else [{"begin": a, "stop": b} for a, b in s] for s in found], dtype=object)


@F.pandas_udf(_PARTS)
def speaker_parts(begin: pd.Series, stop: pd.Series, text: pd.Series, turns: pd.Series) -> pd.Series:
    out = []
    for a, b, t, own in zip(begin, stop, text, turns):
        got = share_sentence(int(a), int(b), t, [(x["a"], x["b"], x["spk"]) for x in own])
        out.append([dict(zip(("speaker", "begin", "stop", "text"), p)) for p in got])
    return pd.Series(out)
