"""The state machines of speech sessions. Each is a pure step; `machines` runs them over batches and streams."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from tidewater.streaming.machines import Machine, fold


class Rule(NamedTuple):
    """Frames of quiet that end an utterance, and the least and most frames of one."""

    silence: int
    shortest: int
    longest: int


class Utterance(NamedTuple):
    """Where the utterance began (-1 outside of one), the quiet frames at its end, the next frame's number."""

    start: int = -1
    quiet: int = 0
    pos: int = 0


def endpoint_step(s: Utterance, voiced: bool, rule: Rule) -> tuple[Utterance, tuple | None]:
    """The state after a frame, and the event (kind, start, stop, reason) that the frame causes, if any."""
    after = Utterance(s.pos if voiced else -1, 0, s.pos + 1)
    if s.start < 0:
        return after, None
    spoken = s.pos - s.start - s.quiet
    quiet = 0 if voiced else s.quiet + 1
    ended = quiet >= rule.silence
    if voiced:
        reason = "max_utt" if spoken >= rule.longest else ""
    elif ended and spoken >= rule.shortest:
        reason = "endpoint"
    elif spoken >= rule.longest:
        reason = "max_utt_after_silence"
    else:
        reason = "noise_gate" if ended else ""
    if not reason:
        return Utterance(s.start, quiet, s.pos + 1), None
    # the frame that closes one utterance may open the next
    return after, ("drop_short" if reason == "noise_gate" else "finalize", s.start, s.pos - quiet, reason)


def endpointing(rule: Rule) -> Machine:
    """Utterances of a stream of voiced frames."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        after, event = endpoint_step(Utterance(*state), bool(row[0]), rule)
        return tuple(after), [event] if event else []

    return Machine(("voiced",), "start long, quiet long, pos long", tuple(Utterance()), "kind string, start long, stop long, reason string", step)


def endpoints(frames: Iterable[bool], rule: Rule, state: Utterance = Utterance()) -> tuple[list[tuple], Utterance]:
    out, now = fold(endpointing(rule), ((f,) for f in frames), tuple(state))
    return out, Utterance(*now)


class Gate(NamedTuple):
    """Hysteresis over a window of frames: the frames that open and that still hold the gate."""

    width: int
    opens: int
    closes: int


def gating(gate: Gate) -> Machine:
    """(frame, change) where the count of voiced frames in the trailing window opens or closes the gate."""
    mask = (1 << gate.width) - 1

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        window, open_, pos = state
        window = (window << 1 | bool(row[0])) & mask
        total = window.bit_count()
        change = "open" if not open_ and total >= gate.opens else "close" if open_ and total <= gate.closes else ""
        return (window, open_ != bool(change), pos + 1), [(pos, change)] if change else []

    return Machine(("voiced",), "window long, open boolean, pos long", (0, False, 0), "frame long, change string", step)


def hysteresis(voiced: Iterable[bool], gate: Gate) -> list[tuple[int, str]]:
    return fold(gating(gate), ((v,) for v in voiced))[0]


class Detector(NamedTuple):
    """Frames of the window and how many of them must be voiced to start or end speech; frames added before and after; the most frames of a segment."""

    width: int
    to_speech: int
    to_silence: int
    back: int
    ahead: int
    longest: int


def detecting(rule: Detector) -> Machine:
    """Segments of speech: (start, stop, reason), each once its end is known.

    Speech starts where enough frames of the window are voiced, `back` frames before that window but never inside
    the segment before; it ends where too few are, `ahead` frames later, or at the longest length.
    """
    mask = (1 << rule.width) - 1

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        window, start, ended, pos = state
        window = (window << 1 | bool(row[0])) & mask
        total, out = window.bit_count(), []
        if start < 0 and total >= rule.to_speech:
            start = max(ended, pos + 1 - rule.width - rule.back, 0)
        elif start >= 0 and total <= rule.to_silence:
            ended = max(start + 1, min(pos + 1 - rule.width + total + rule.ahead, pos + 1))
            out, start = [(start, ended, "silence")], -1
        if start >= 0 and pos + 1 - start >= rule.longest:
            ended = pos + 1
            out, start = [*out, (start, ended, "longest")], ended
        return (window, start, ended, pos + 1), out

    def finish(state: tuple) -> list[tuple]:
        _, start, _, pos = state
        return [(start, pos, "end")] if 0 <= start < pos else []

    return Machine(("voiced",), "window long, start long, ended long, pos long", (0, -1, 0, 0), "start long, stop long, reason string", step, finish)


class Schedule(NamedTuple):
    """How far a level must stand above the noise floor, how fast the floor follows what is louder (one part in `follow`), and the
    quiet frames that end a segment: `quiet[k]` while no more than `limits[k]` frames have passed since the last cut, then `last`."""

    margin: int
    follow: int
    limits: tuple[int, ...]
    quiet: tuple[int, ...]
    last: int


def scheduled(rule: Schedule) -> Machine:
    """Segments of speech (start, stop, quiet frames that were asked for) whose end takes less quiet the longer it lets wait.

    The floor falls to a softer frame at once and rises slowly while there is no speech; levels and the floor are whole numbers.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        start, low, age, floor, pos = state
        level, out = row[0], []
        voiced = level > floor + rule.margin
        if not voiced:
            floor = level if level < floor else floor + (level - floor) // rule.follow
        age += 1
        if start < 0:
            start = pos if voiced else -1
        else:
            low = 0 if voiced else low + 1
            asked = next((q for limit, q in zip(rule.limits, rule.quiet) if age <= limit), rule.last)
            if low >= asked:
                out = [(start, pos + 1 - low, asked)]
                start, low, age = -1, 0, 0
        return (start, low, age, floor, pos + 1), out

    def finish(state: tuple) -> list[tuple]:
        start, low, _, _, pos = state
        return [(start, pos - low, 0)] if start >= 0 else []

    return Machine(("level",), "start long, low long, age long, floor long, pos long", (-1, 0, 0, 1 << 40, 0), "start long, stop long, asked long", step, finish)


def controlled() -> Machine:
    """A session that its client runs: rows are frames or commands (kind, argument), and each command says what it did.

    start begins anew and listens; stop hands on what is pending and listens no more; commit hands on what is pending, and is an error
    while nobody listens; language and hotwords change what goes with all that is handed on later. Frames count only while it listens.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        listens, begin, frames, language, hotwords = state
        kind, argument = row
        final = ("final", begin, frames, language, hotwords)
        if kind == "frame":
            return (listens, begin, frames + listens, language, hotwords), []
        if kind == "start":
            return (True, 0, 0, language, hotwords), [("started", 0, 0, language, hotwords)]
        if kind == "language":
            return (listens, begin, frames, argument, hotwords), [("language_set", begin, frames, argument, hotwords)]
        if kind == "hotwords":
            return (listens, begin, frames, language, argument), [("hotwords_set", begin, frames, language, argument)]
        if kind == "commit":
            return (listens, frames, frames, language, hotwords), [final if listens else ("error", begin, frames, language, hotwords)]
        rest = [final] if listens and frames > begin else []
        return (False, frames, frames, language, hotwords), [*rest, ("stopped", frames, frames, language, hotwords)]

    return Machine(("kind", "argument"), "listens boolean, begin long, frames long, language string, hotwords string", (False, 0, 0, None, None), "event string, begin long, stop long, language string, hotwords string", step)


def firing(threshold: float) -> Machine:
    """(frame, level, fired): a running sum that loses the threshold each time it reaches it; the level is the sum before the loss."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        level, pos = state
        level += row[0]
        fired = level >= threshold
        return (level - threshold if fired else level, pos + 1), [(pos, level, fired)]

    return Machine(("weight",), "level double, pos long", (0.0, 0), "frame long, level double, fired boolean", step)


def timing(threshold: float, shift: float = -1.5, longest: float = 12, ends: float = 5) -> Machine:
    """(token, begin, stop) in frames from the fires of a running sum; token is null for silence.

    A token lasts from its fire (moved by shift) to the next; what is over `longest` of it is silence. Silence also goes before
    the first fire, and after the middle between the last fire and the end, where that leaves more than `ends` frames. A session that
    never fires is all silence.
    """
    fires = firing(threshold)

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        level, pos, last, n, held = state
        (level, pos), ((_, _, fired),) = fires.step((level, pos), row)
        if not fired:
            return (level, pos, last, n, held), []
        now, out = pos - 1 + shift, []
        if last is None:
            # what was made last is held back, as the end of the session may move it
            return (level, pos, now, 0, [None, 0.0, now] if now > ends else None), []
        out = [tuple(held)] if held else []
        held = [float(n), last, now]
        if now - last > longest:
            out.append((n, last, last + longest))
            held = [None, last + longest, now]
        return (level, pos, now, n + 1, held), [(None if t is None else int(t), a, b) for t, a, b in out]

    def finish(state: tuple) -> list[tuple]:
        _, pos, last, _, held = state
        if last is None:
            return [(None, 0.0, float(pos))] if pos else []
        long = pos - last > ends
        middle = (pos + last) * 0.5
        out = [(held[0], held[1], middle if long else float(pos))] if held else []
        out += [(None, middle, float(pos))] if long else []
        return [(None if t is None else int(t), a, b) for t, a, b in out]

    return Machine(("weight",), "level double, pos long, last double, n long, held array<double>", (0.0, 0, None, 0, None), "token long, begin double, stop double", step, finish)


class Layout(NamedTuple):
    """Characters of a line, lines of a cue (None: a cue for each segment), the pause that breaks a cue, and whether each word is marked in turn."""

    width: int = 1000
    lines: int | None = None
    pause: int = 3000
    highlight: bool = False


def wrapping(layout: Layout) -> Machine:
    """Cues (begin, stop, text) of timed words. Rows: a word with the space before it, its begin and stop in ms, whether it begins a segment.

    With lines, words fill lines and lines fill cues, whatever segment they come from, and a pause ends a cue; without, a cue is a segment.
    """
    free = layout.lines is not None

    def cues(words: list[tuple]) -> list[tuple]:
        text = [w for w, _, _ in words]
        if not words:
            return []
        if not layout.highlight:
            return [(words[0][1], words[-1][2], "".join(text))]
        out, last = [], words[0][1]
        for k, (word, begin, stop) in enumerate(words):
            if begin != last:
                out.append((last, begin, "".join(text)))
            bare = word.lstrip()
            out.append((begin, stop, "".join([*text[:k], word[: len(word) - len(bare)], "<u>", bare, "</u>", *text[k + 1 :]])))
            last = stop
        return out

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        filled, lines, last, texts, begins, stops = state
        word, begin, stop, first = row
        words = list(zip(texts, begins, stops))
        waited = free and last is not None and begin - last > layout.pause
        parts = first and bool(words) and not free
        out = []
        if filled and filled + len(word) <= layout.width and not waited and not parts:
            filled += len(word)
        else:
            word = word.strip()
            if parts or (words and free and (waited or lines >= layout.lines)):
                out, words, lines = cues(words), [], 1
            elif filled:
                lines, word = lines + 1, "\n" + word
            filled = len(word.strip())
        words.append((word, begin, stop))
        return (filled, lines, begin, *[list(c) for c in zip(*words)]), out

    def finish(state: tuple) -> list[tuple]:
        return cues(list(zip(*state[3:])))

    kept = "filled long, lines long, last long, texts array<string>, begins array<long>, stops array<long>"
    return Machine(("word", "begin", "stop", "first"), kept, (0, 1, None, [], [], []), "begin long, stop long, text string", step, finish)


def taking() -> Machine:
    """Ids of the spans (id, a, b) that overlap no span taken before; the taken ones are disjoint, so neighbours tell."""
    from bisect import bisect_right

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begins, stops = state
        name, a, b = row
        k = bisect_right(begins, a)
        if (k and a < stops[k - 1] and begins[k - 1] < b) or (k < len(begins) and begins[k] < b):
            return state, []
        # an empty span goes before one that begins where it lies
        k -= a == b and k > 0 and begins[k - 1] == a and stops[k - 1] > a
        return ([*begins[:k], a, *begins[k:]], [*stops[:k], b, *stops[k:]]), [(name,)]

    return Machine(("id", "a", "b"), "begins array<long>, stops array<long>", ([], []), "id long", step)


class Threshold(NamedTuple):
    """Chances that start speech and that end it, the frames of quiet that must pass, the frames added at both ends."""

    start: float
    stop: float
    quiet: int
    pad: int


def thresholding(rule: Threshold) -> Machine:
    """Spans of speech: begun at a frame of chance start, ended where the chance stays below stop for long enough."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begin, low, pos = state
        p, out = row[0], []
        if p >= rule.start:
            begin, low = (pos if begin < 0 else begin), -1
        elif p < rule.stop and begin >= 0:
            low = pos if low < 0 else low
            if pos - low >= rule.quiet:
                out = [(max(0, begin - rule.pad), low + rule.pad)]
                begin = low = -1
        return (begin, low, pos + 1), out

    def finish(state: tuple) -> list[tuple]:
        begin, _, pos = state
        return [(max(0, begin - rule.pad), pos)] if begin >= 0 else []

    return Machine(("chance",), "begin long, low long, pos long", (-1, -1, 0), "begin long, stop long", step, finish)


def threshold_spans(chances: Iterable[float], rule: Threshold) -> list[tuple[int, int]]:
    machine = thresholding(rule)
    out, state = fold(machine, ((p,) for p in chances))
    return out + machine.finish(state)


def controlling(lookback: int, quiet: int) -> Machine:
    """What a voice-activity controller hands on: (begin, stop, final) chunks of frames.

    Speech begins with up to `lookback` frames from before it, none of which was handed on; while it lasts, every
    `lookback` frames are one chunk; after `quiet` quiet frames the last chunk is final.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        sent, speaking, low, pos = state
        voiced = bool(row[0])
        pos += 1
        if not speaking:
            if voiced:
                return (max(sent, pos - 1 - lookback), True, 0, pos), []
            return (sent, False, 0, pos), []
        low = 0 if voiced else low + 1
        if low >= quiet:
            return (pos, False, 0, pos), [(sent, pos, True)]
        if pos - sent >= lookback:
            return (pos, True, low, pos), [(sent, pos, False)]
        return (sent, True, low, pos), []

    def finish(state: tuple) -> list[tuple]:
        sent, speaking, _, pos = state
        return [(sent, pos, True)] if speaking and sent < pos else []

    return Machine(("voiced",), "sent long, speaking boolean, low long, pos long", (0, False, 0, 0), "begin long, stop long, final boolean", step, finish)


def committing(repeats: int = 2) -> Machine:
    """(partial, word) at which each word becomes final: once `repeats` partials in a row agree on it and all before it."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, done, last, seen = state
        words, out = list(row[0]), []
        seen = [s + 1 if k < len(last) and w == last[k] else 1 for k, (w, s) in enumerate(zip(words, [*seen, *[0] * len(words)]))]
        while done < len(words) and seen[done] >= repeats:
            out.append((n, words[done]))
            done += 1
        return (n + 1, done, words, seen), out

    return Machine(("words",), "n long, done long, last array<string>, seen array<long>", (0, 0, [], []), "partial long, word string", step)


def commit_stable(partials: Iterable[list[str]], repeats: int = 2) -> list[tuple[int, str]]:
    return fold(committing(repeats), ((p,) for p in partials))[0]


def confirming(most: int) -> Machine:
    """What two hypotheses in a row agree on is confirmed; (hypothesis, confirmed words, words trimmed) of each that confirms or trims.

    A hypothesis covers the words of the buffer, which drops its oldest confirmed ones beyond `most`.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, sure, last = state
        words, common = list(row[0]), sure
        while common < min(len(words), len(last)) and words[common] == last[common]:
            common += 1
        new = words[sure:common]
        cut = max(0, min(common, len(words) - most))
        return (n + 1, common - cut, words[cut:]), [(n, " ".join(new), cut)] if new or cut else []

    return Machine(("words",), "n long, sure long, last array<string>", (0, 0, []), "hypothesis long, confirmed string, trimmed long", step)


def two_tracks(repeats: int = 2) -> Machine:
    """(partial, track, text): after each partial what became final with it, and the rest as a draft that the next one replaces.

    A word is final once `repeats` partials in a row agree on it and all before it; a partial that is shorter than what is final, or
    differs there, takes nothing back. What is left when the session ends is final too.
    """
    commit = committing(repeats)

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, done, last, _ = state
        words = list(row[0])
        # what is final stands, whatever the partial says there
        words = [*last[:done], *words[done:]] if len(words) >= done else list(last[:done])
        state, sure = commit.step(state, (words,))
        rest = words[state[1] :]
        out = [(n, "final", " ".join(w for _, w in sure))] if sure else []
        return state, [*out, (n, "draft", " ".join(rest))] if rest else out

    def finish(state: tuple) -> list[tuple]:
        n, done, last, _ = state
        return [(n, "final", " ".join(last[done:]))] if last[done:] else []

    return Machine(commit.inputs, commit.state, commit.start, "partial long, track string, text string", step, finish)


def decoding(first: int, step_ms: int) -> Machine:
    """(at, new) of each decode: once `first` ms have come, then whenever `step_ms` more have; new is what came since the last one."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        total, last = state
        total += row[0]
        due = total - last >= step_ms if last else total >= first
        return (total, total if due else last), [(total, total - last)] if due else []

    return Machine(("ms",), "total long, last long", (0, 0), "at long, new long", step)


def evicting(most: int) -> Machine:
    """(held, segments, offset) after each segment of some tokens: the buffer gives up its oldest segments, but never the newest, while
    it holds over `most` tokens; offset counts all that it gave up."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        sizes, held, offset = state
        sizes, held = [*sizes, row[0]], held + row[0]
        gone = 0
        while held > most and gone < len(sizes) - 1:
            held, offset, gone = held - sizes[gone], offset + sizes[gone], gone + 1
        sizes = sizes[gone:]
        return (sizes, held, offset), [(held, len(sizes), offset)]

    return Machine(("tokens",), "sizes array<long>, held long, gone long", ([], 0, 0), "held long, segments long, offset long", step)


def commanded(longest: int) -> Machine:
    """Utterances that the client ends: (begin, stop, reason) at each command, or at the longest length."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begin, pos = state
        pos += 1
        reason = "command" if row[0] else "longest" if pos - begin >= longest else ""
        return (pos if reason else begin, pos), [(begin, pos, reason)] if reason else []

    def finish(state: tuple) -> list[tuple]:
        return [(*state, "end")] if state[0] < state[1] else []

    return Machine(("command",), "begin long, pos long", (0, 0), "begin long, stop long, reason string", step, finish)


def keeping(gap: int) -> Machine:
    """Marks that lie over `gap` after the last one kept."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begun, last = state
        if begun and row[0] - last <= gap:
            return state, []
        return (True, row[0]), [(row[0],)]

    return Machine(("at",), "begun boolean, last long", (False, 0), "mark long", step)


def tracking(least: float = 0.5, keep: float = 0.8, most: int = 16) -> Machine:
    """A speaker number for each vector as it comes: the most alike centre if it is alike enough, else a new one.

    Centres move by an exponential mean; once `most` are there, the most alike is taken whatever its likeness.
    """
    import numpy as np

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        centres, (name, vector) = list(state[0]), row
        v = np.asarray(vector, float)
        v = v / max(np.linalg.norm(v), 1e-12)
        likeness = [float(np.asarray(c) @ v) / max(float(np.linalg.norm(c)), 1e-12) for c in centres]
        k = int(np.argmax(likeness)) if likeness else -1
        if k < 0 or (likeness[k] < least and len(centres) < most):
            centres.append(v.tolist())
            k = len(centres) - 1
        else:
            centres[k] = (keep * np.asarray(centres[k]) + (1 - keep) * v).tolist()
        return (centres,), [(name, k)]

    return Machine(("name", "vector"), "centres array<array<double>>", ([],), "name long, speaker long", step)


def online_speakers(vectors: Iterable, least: float = 0.5, keep: float = 0.8, most: int = 16) -> list[int]:
    return [k for _, k in fold(tracking(least, keep, most), ((n, v) for n, v in enumerate(vectors)))[0]]
