"""Arrow-fed text functions for what expressions cannot say: Unicode forms, compression, overlaps."""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes over compressed bytes."""
    return text.map(lambda t: None if t is None else len(b := t.encode()) / len(zlib.compress(b))).astype(float)


def fold(text: str, keep_marks: bool = False) -> str:
    """Lower case, without brackets' content, symbols, marks and punctuation."""
    form = unicodedata.normalize("NFKC" if keep_marks else "NFKD", text.lower())
    kinds = ((c, unicodedata.category(c)) for c in form)
    return " ".join("".join(c if k[0] not in "MSP" else "" if k == "Mn" else " " for c, k in kinds).split())


@F.pandas_udf(T.StringType())
def basic_normal(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold(t))


def joined(first: str, second: str, least: int = 4) -> str | None:
    """Two rolling transcripts as one, where the end of the first is the beginning of the second; None if it is not.

    Case, punctuation and white space do not count; the overlap must be `least` characters and a quarter of the shorter.
    """
    kept = [[(k, x) for k, c in enumerate(t) if unicodedata.category(c)[0] not in "PS" and not c.isspace() for x in c.casefold()] for t in (first, second)]
    a, b = ("".join(x for _, x in t) for t in kept)
    shortest = min(len(a), len(b))
    # the longest beginning of b that a ends with: how far b matches itself, then a, in linear time
    borders, n = [0], 0
    for c in itertools.chain(b[1:shortest], [None], a[len(a) - shortest :]):
        while n and (n == shortest or c != b[n]):
            n = borders[n - 1]
        n += n < shortest and c == b[n]
        borders.append(n)
    if n and n >= max(least, shortest // 4):
        return first + second[kept[1][n - 1][0] + 1 :]
    return None


@F.pandas_udf(T.StringType())
def overlap_join(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else joined(a, b) for a, b in zip(first, second)], dtype=object)


_word_run = re.compile(r"(?<!\S)(\w+)(?:\s+\1){2,}(?!\S)", re.IGNORECASE)


def end_of_repeats(text: str, longest: int = 11) -> int | None:
    """Where the first of three or more repeats in a row ends: of a word, else of `longest` characters or fewer; None without any.

    Punctuation does not count, nor do numbers. Repeats of n characters are runs of 2 n positions that equal the one n later.
    """
    at = np.array([k for k, c in enumerate(text) if unicodedata.category(c)[0] != "P"], np.int64)
    plain = "".join(text[k] for k in at)
    for m in _word_run.finditer(plain):
        if not m.group(1).isdigit():
            return int(at[m.end(1) - 1]) + 1
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
    white = np.array([c.isspace() for c in plain], bool)
    for n in range(1, longest + 1):
        same = np.r_[False, (codes[:-n] == codes[n:]) & ~white[:-n], False] if len(codes) > n else np.zeros(1, bool)
        edges = np.flatnonzero(same[1:] != same[:-1])
        for begin, stop in zip(edges[::2], edges[1::2]):
            if stop - begin >= 2 * n and not plain[begin : begin + n].isdigit():
                return int(at[begin + n - 1]) + 1
    return None


@F.pandas_udf(T.StringType())
def cut_repeats(text: pd.Series) -> pd.Series:
    """Texts cut after the first of their repeats, with the marks that close it."""

    def cut(t: str | None) -> str | None:
        end = None if t is None else end_of_repeats(t)
        if end is None:
            return t
        while end < len(t) and unicodedata.category(t[end]) in ("Pe", "Pf", "Po", "Pd", "Pc"):
            end += 1
        return t[:end].rstrip()

    return text.map(cut)


def cut_text(text: str, longest: int = 80) -> list[str]:
    """Words gathered into parts of at most `longest` characters, closed early at a mark once half full; hard cuts where a word is longer."""
    parts: list[list[str]] = [[]]
    for word in text.split():
        if parts[-1] and len(" ".join([*parts[-1], word])) > longest:
            parts.append([])
        parts[-1].append(word)
        if word[-1] in ".!?;:" and len(" ".join(parts[-1])) >= longest // 2:
            parts.append([])
    out = [" ".join(p) for p in parts if p]
    body = text.strip()
    return [body[k : k + longest] for k in range(0, len(body), longest)] if any(len(p) > longest for p in out) else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_parts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else cut_text(t))


# Tags of emotions, events and languages.
EMOTIONS = {"<|HAPPY|>": "😊", "<|SAD|>": "😔", "<|ANGRY|>": "😡", "<|NEUTRAL|>": "", "<|FEARFUL|>": "😰", "<|DISGUSTED|>": "🤢", "<|SURPRISED|>": "😮"}
EVENTS = {"<|BGM|>": "🎼", "<|Speech|>": "", "<|Applause|>": "👏", "<|Laughter|>": "😀", "<|Cry|>": "😭", "<|Sneeze|>": "🤧", "<|Breath|>": "", "<|Cough|>": "🤧"}
LANGUAGES = ("<|zh|>", "<|en|>", "<|yue|>", "<|ja|>", "<|ko|>", "<|nospeech|>")
_UNKNOWN, _NO_TEXT = "<|nospeech|><|Event_UNK|>", "<|EMO_UNKNOWN|>"
_languages = re.compile("|".join(map(re.escape, LANGUAGES)))
_tags = re.compile("|".join(map(re.escape, [*EMOTIONS, *EVENTS, _NO_TEXT])))
_faces = {x for x in [*EMOTIONS.values(), *EVENTS.values(), "😷"] if x}
_around = re.compile(f" ?([{''.join(sorted(_faces))}]) ?")


def tagged_part(text: str) -> tuple[str, str, str]:
    """Event signs, text and the sign of the dominant emotion of a part; of emotions that come as often, neutral, then the first named wins."""
    count = Counter(_tags.findall(text))
    emotion = max(["<|NEUTRAL|>", *EMOTIONS], key=lambda e: count[e])
    signs = "".join(EVENTS[e] for e in reversed(EVENTS) if count[e])
    return signs, _tags.sub("", text), EMOTIONS[emotion]


def rich_text(text: str | None) -> str | None:
    """A tagged transcript with signs for its tags: events before each language's part, the dominant emotion after it. A sign
    that the part before already has is not repeated."""
    if text is None:
        return None
    out, event = "", ""
    for k, part in enumerate(_languages.split(text.replace(_UNKNOWN, "❓"))):
        signs, body, emotion = tagged_part(part)
        part = _around.sub(r"\1", f"{signs}{body}{emotion}").strip()
        first = part[:1] if part[:1] in _faces else ""
        if k and first and first == event:
            part = part[1:]
            first = part[:1] if part[:1] in _faces else ""
        if not part:
            continue
        event = first
        last = part[-1:]
        if k and last in _faces and out.endswith(last):
            out = out[:-1]
        out += part
    return out.replace("The.", " ").strip()


@F.pandas_udf(T.StringType())
def rich_texts(text: pd.Series) -> pd.Series:
    return text.map(rich_text)
