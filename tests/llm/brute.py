"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np

BLANK = "\t\n\v\f\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


class Union:
    def __init__(self, nodes):
        self.of = {x: x for x in nodes}

    def root(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)


def jaccard(texts, width, percent):
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    groups, where = Union(sets), {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in sets.items():
        for other, shared in Counter(o for x in s for o in where[x] if o < k).items():
            if 100 * shared >= percent * (len(s) + len(sets[other]) - shared):
                groups.link(k, other)
    return {k: (len(s), groups.root(k)) for k, s in sets.items()}


def jaccard_links(texts, width, percent):
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    return {k: sum(o != k and bool(s) and 100 * len(s & t) >= percent * len(s | t) for o, t in sets.items()) for k, s in sets.items()}


def near(vectors, threshold):
    """vectors: id -> (label, list or None)."""
    good = {}
    for k, (label, v) in vectors.items():
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = (label, np.array(v, np.float64))
    groups, links = Union(vectors), dict.fromkeys(vectors, 0)
    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0]:
                x, y = good[a][1], good[b][1]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    groups.link(a, b)
    return {k: (links[k], groups.root(k), groups.root(k) == k) for k in vectors}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def repeated_chars(words, n):
    """Characters of words inside an n-gram that an earlier place has too."""
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            inside.update(range(i, i + n))
        seen.add(gram)
    return sum(len(words[j]) for j in inside)


def substring_pieces(text):
    """(words, first word) of each piece."""
    out, at = [], 0
    for line in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split("\n"):
        now = []
        for word in WORD.findall(line):
            now.append(word)
            if hashlib.md5(word.encode()).hexdigest()[0] in "012":
                out.append((tuple(now), at))
                at, now = at + len(now), []
        if now:
            out.append((tuple(now), at))
            at += len(now)
    return out


def substring_dedup(rows, min_words=25):
    """(id, text) rows with different ids -> id: (text left, spans of code points)."""
    pieces = {k: substring_pieces(t) for k, t in rows}
    first = {}
    units = {k: sorted([(i, i + 1) for i, p in enumerate(found) if len(p[0]) >= min_words] + [(i, i + 2) for i in range(len(found) - 1)]) for k, found in pieces.items()}
    for k in sorted(units):
        for a, b in units[k]:
            first.setdefault(tuple(p[0] for p in pieces[k][a:b]), (k, a))
    out = {}
    for k, text in rows:
        repeated = [(a, b) for a, b in units[k] if first[tuple(p[0] for p in pieces[k][a:b])] != (k, a)]
        runs = []
        for a, b in repeated:
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        spans, words = [], [m.span() for m in WORD.finditer(text or "")]
        for a, b in runs:
            if sum(len(w) for w in {p[0] for p in pieces[k][a:b]}) >= min_words:
                x, y = pieces[k][a][1], pieces[k][b - 1][1] + len(pieces[k][b - 1][0])
                start, end, after = words[x][0], words[y - 1][1], words[y][0] if y < len(words) else len(text)
                if not text[:start].rsplit("\n", 1)[-1].strip(BLANK) or "\n" not in text[end:after]:
                    end = after
                spans.append((start, end))
        left = text
        for start, end in reversed(spans):
            left = left[:start] + left[end:]
        out[k] = (left, spans)
    return out
