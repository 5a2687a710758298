"""Votes of several engines over the tokens of one text, each aligned with the base once, in its own row: nothing is shuffled."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def against(base: list[str], said: list[str]) -> list[tuple[int, str, bool, bool]]:
    """(position in base, token said there, whether it is the same, whether its stretch is as long on both sides); case is not told apart."""
    base, said, out = [t.upper() for t in base], [t.upper() for t in said], []
    for tag, a0, a1, b0, b1 in SequenceMatcher(None, base, said, autojunk=False).get_opcodes():
        if tag in ("equal", "replace"):
            out += [(i, said[j], base[i] == said[j], a1 - a0 == b1 - b0) for i, j in zip(range(a0, a1), range(b0, b1))]
    return out


def rover(base: list[str], engines: list[list[str]], least: int = 2) -> tuple[list[str], int]:
    """The base's tokens, each given up for another that `least` engines agree on (ties: the first in the alphabet), and how many were."""
    votes: dict[int, Counter] = {}
    for said in engines:
        for at, token, same, _ in against(base, said):
            if not same:
                votes.setdefault(at, Counter())[token] += 1
    out, wins = list(base), 0
    for at, own in votes.items():
        token, n = min(own.items(), key=lambda x: (-x[1], x[0]))
        if n >= least:
            out[at], wins = token, wins + 1
    return out, wins


def fuse(base: list[str], engines: list[list[str]], families: list[str], least: int = 2, accept: float = 0.3) -> tuple[list[str], int, int, int, bool]:
    """The fused tokens, how many were applied, stand by the template alone, are attested, and whether enough are.

    A template token that an engine says stays; others give way to a token that `least` engines of two families or more say in a
    stretch as long as the template's (ties: the engine that comes first).
    """
    attested: set[int] = set()
    other: dict[int, dict[str, list[int]]] = {}
    for k, said in enumerate(engines):
        for at, token, same, even in against(base, said):
            if same:
                attested.add(at)
            elif even:
                other.setdefault(at, {}).setdefault(token, []).append(k)
    out, applied = list(base), 0
    for at, own in other.items():
        token, by = min(own.items(), key=lambda x: (-len(x[1]), x[1][0]))
        if at not in attested and len(by) >= least and len({families[k] for k in by}) >= 2:
            out[at], applied = token, applied + 1
    alone = len(base) - applied - len(attested)
    return out, applied, alone, len(attested), len(attested) >= accept * len(base)


def consensus(base: list[str], passes: list[list[str]], need: int = 2) -> tuple[list[str], int]:
    """The base's tokens without those that no pass repeats though `need` passes say something there, and how many went."""
    votes, covered = Counter(), Counter()
    for said in passes:
        for at, _, same, _ in against(base, said):
            covered[at] += 1
            votes[at] += same
    out = [t for k, t in enumerate(base) if votes[k] or covered[k] < need]
    return out, len(base) - len(out)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


@F.pandas_udf(_fields(text=T.StringType(), wins=T.LongType()))
def rover_vote(base: pd.Series, engines: pd.Series) -> pd.DataFrame:
    got = [rover(list(b), [list(e) for e in es]) for b, es in zip(base, engines)]
    return pd.DataFrame({"text": [" ".join(t) for t, _ in got], "wins": [n for _, n in got]})


def template_fusion(families: list[str]):
    """text, applied, template_only, attested and accepted for a template and its engines (arrays of tokens)."""

    @F.pandas_udf(_fields(text=T.StringType(), applied=T.LongType(), template_only=T.LongType(), attested=T.LongType(), accepted=T.BooleanType()))
    def run(base: pd.Series, engines: pd.Series) -> pd.DataFrame:
        got = [fuse(list(b), [list(e) for e in es], families) for b, es in zip(base, engines)]
        return pd.DataFrame([(" ".join(t), *rest) for t, *rest in got], columns=["text", "applied", "template_only", "attested", "accepted"])

    return run


@F.pandas_udf(_fields(text=T.StringType(), dropped=T.LongType()))
def multi_pass(base: pd.Series, passes: pd.Series) -> pd.DataFrame:
    got = [consensus(list(b), [list(e) for e in es]) for b, es in zip(base, passes)]
    return pd.DataFrame({"text": [" ".join(t) for t, _ in got], "dropped": [n for _, n in got]})

