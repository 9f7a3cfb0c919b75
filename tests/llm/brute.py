"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

BLANK = " \t\n\v\f\r"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, width: int) -> frozenset:
    w = words(lowered(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(docs: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (size of its set, smallest id of its component), by all pairs."""
    sets = {k: shingles(v, width) for k, v in docs.items()}
    up = {k: k for k in docs}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


def repeated_bytes(texts: list[str | None], window: int) -> list[np.ndarray]:
    """For each text, which bytes lie in a string of ``window`` bytes that starts twice or more anywhere."""
    raw = [(x or "").encode() for x in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        m = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                m[i : i + window] = True
        out.append(m)
    return out


def line_dedup(docs: dict[int, str | None], least: int, long_line: int) -> dict[int, tuple[str | None, int, int]]:
    """id -> (text without later copies of runs, stretches that went, the longest run), by comparing suffixes one by one.

    A run reaches as far as a suffix agrees with the first of all that agree with it on its longest repeated power of two (or ``least``) of lines.
    """
    lines = {k: (v or "").split("\n") for k, v in docs.items() if v is not None}
    full = {k: [i for i, x in enumerate(v) if x.strip(BLANK)] for k, v in lines.items()}
    seq = {k: [lines[k][i] for i in at] for k, at in full.items()}
    depths, d = [], 1
    while d <= max(map(len, seq.values()), default=0):
        depths.append(d)
        d += min(d, least - d) if d < least else d
    first: dict[tuple, tuple] = {}
    for k in sorted(seq):
        for j in range(len(seq[k])):
            for d in depths:
                if j + d <= len(seq[k]):
                    first.setdefault(tuple(seq[k][j : j + d]), (k, j))
    out = {}
    for k, v in docs.items():
        gone, longest = set(), 0
        for j in range(len(seq.get(k, ()))):
            names = [first[tuple(seq[k][j : j + d])] for d in depths if j + d <= len(seq[k])]
            names = [x for x in names if x != (k, j)]
            if names:
                ok, oj = names[-1]
                size = 0
                while max(j, oj * (ok == k)) + size < len(seq[k]) and oj + size < len(seq[ok]) and seq[k][j + size] == seq[ok][oj + size]:
                    size += 1
                if size >= least or len(seq[k][j]) >= long_line:
                    gone.update(range(j, j + size))
                    longest = max(longest, size)
        n_runs = sum(j - 1 not in gone for j in gone)
        cut = {full[k][j] for j in gone}
        out[k] = (None if v is None else "\n".join(x for i, x in enumerate(lines[k]) if i not in cut), n_runs, longest)
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    w, t = words(text), text or ""
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if triples[x] > 1 for d in range(3)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.strip(BLANK):
            dup += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)
