"""Keyword search over frames of symbol chances by a beam of prefixes, a frame at a time."""

from __future__ import annotations

import math
from typing import NamedTuple

from tidewater.streaming.machines import Machine


class Beam(NamedTuple):
    """Symbols of a frame that are looked at, the least chance of one, and the prefixes that are kept."""

    symbols: int = 3
    least: float = 0.05
    prefixes: int = 20


class Prefix(NamedTuple):
    """A prefix as its number, with its last symbol; how likely paths to it end in a blank, and in that symbol; its peaks (the ones
    before, chance, frame), the last of them first."""

    number: int
    last: int
    blank: float
    symbol: float
    peaks: tuple | None


def keyword_search(keywords: dict[str, tuple[int, ...]], beam: Beam = Beam(), blank: int = 0) -> Machine:
    """(keyword, first and last frame, score) of each session: the first keyword that the likeliest prefix with one holds.

    Rows give the frame's chances by symbol. Two paths are one prefix when they collapse to the same symbols; its mass is split by how
    the paths end, so that a symbol that comes twice with a blank between counts twice. Masses are scaled to 1 each frame. A prefix is a
    number, given by the one before and its last symbol, and peaks are shared between prefixes: a frame costs the same wherever it lies.
    The score is the root of the product of the chances at the peaks. A session without a keyword gives one row of nulls.
    """
    allowed = {blank, *(s for k in keywords.values() for s in k)}

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        beams, numbers, symbols, pos = state
        chances = row[0]
        some = sorted(range(len(chances)), key=lambda s: -chances[s])[: beam.symbols]
        some = [s for s in some if chances[s] > beam.least and s in allowed]
        if not some:
            return (beams, numbers, symbols, pos + 1), []
        new: dict[int, list] = {}

        def add(number: int, last: int, blank_mass: float, mass: float, peaks: tuple | None) -> None:
            if number in new:
                own = new[number]
                own[1] += blank_mass
                own[2] += mass
                # of the ways to a prefix the higher last peak stays
                if peaks and (own[3] is None or peaks[1] > own[3][1]):
                    own[3] = peaks
            else:
                new[number] = [last, blank_mass, mass, peaks]

        for s in some:
            p = chances[s]
            for b in beams:
                if s == blank:
                    add(b.number, b.last, (b.blank + b.symbol) * p, 0.0, b.peaks)
                    continue
                if s == b.last and b.symbol > 0:
                    add(b.number, b.last, 0.0, b.symbol * p, b.peaks if b.peaks[1] >= p else (b.peaks[0], p, pos))
                mass = b.blank if s == b.last else b.blank + b.symbol
                if mass > 0:
                    key = (b.number, s)
                    if key not in numbers:
                        numbers[key] = len(symbols)
                        symbols.append(s)
                    add(numbers[key], s, 0.0, mass * p, (b.peaks, p, pos))
        best = sorted(new.items(), key=lambda x: (-(x[1][1] + x[1][2]), x[0]))[: beam.prefixes]
        total = sum(own[1] + own[2] for _, own in best)
        kept = [Prefix(k, own[0], own[1] / total, own[2] / total, own[3]) for k, own in best]
        return (kept, numbers, symbols, pos + 1), []

    def finish(state: tuple) -> list[tuple]:
        beams, numbers, symbols, _ = state
        before = {k: up for (up, _), k in numbers.items()}
        for b in beams:
            said, peaks, k, at = [], [], b.number, b.peaks
            while at is not None:
                said.append(symbols[k])
                peaks.append(at[1:])
                k, at = before[k], at[0]
            said, peaks = tuple(said[::-1]), peaks[::-1]
            for name, word in keywords.items():
                for i in range(len(said) - len(word) + 1):
                    if said[i : i + len(word)] == word:
                        own = peaks[i : i + len(word)]
                        return [(name, own[0][1], own[-1][1], math.sqrt(math.prod(p for p, _ in own)))]
        return [(None, None, None, None)]

    def start_step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        # what is in the state grows in place, so each session gets its own with its first frame
        return step(state or ([Prefix(0, blank, 1.0, 0.0, None)], {}, [blank], 0), row)

    return Machine(("chances",), "none array<int>", (), "keyword string, first long, last long, score double", start_step, lambda state: finish(state) if state else [(None, None, None, None)])
