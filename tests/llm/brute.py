"""Plain-Python versions of the training-data operators, written from their definitions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_rules(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def quality(rows, share=0.01, min_documents=10, min_words=20, min_left=0.3):
    """rows: (id, text, host). (base rules, failed, removed words, kept) by row number."""
    norm = lambda line: " ".join(words(line.lower()))
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        if text is not None:
            hosts[host].add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                holders[host, norm(line)].add(text)
    bad = {k for k, v in holders.items() if len(v) > min_documents and len(v) > share * len(hosts[k[0]])}
    out = []
    for _, text, host in rows:
        base = base_rules(text)
        gone = sum(len(words(line)) for line in (text or "").split("\n") if (host, norm(line)) in bad)
        failed = base[0] < min_words or base[4] * 100 > base[0] * 30
        left = base[0] - gone
        out.append((base, failed, gone, not failed and left >= base[0] * min_left))
    return out


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(texts, width, threshold=80):
    """texts: id to text. Smallest reachable id of each."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source to words. Water filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= over
    return out
