"""Plain versions of the operators, one document at a time."""

import re
import zlib
from collections import Counter

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = words((text or "").translate(UP))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def components(docs, size, percent):
    """doc_id -> smallest doc_id reachable over similar pairs of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def rules(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def dup_share(text, n):
    """Characters in words of n-grams that have occurred before, over all characters in words."""
    w = words(text)
    seen, hit = set(), set()
    for k in range(len(w) - n + 1):
        g = tuple(w[k : k + n])
        if g in seen:
            hit |= set(range(k, k + n))
        seen.add(g)
    return sum(len(w[k]) for k in hit) / max(1, sum(map(len, w)))


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (match if x == y else mismatch), row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, *row)
    return best
