"""Plain Python versions of the operators, on small lists of (id, text)."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(x, k) for d, x in docs}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def text_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def edit_distance(a, b, most=None):
    """Edits between a and b; with `most`, any number above it where there are more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        if most is not None and min(row) > most:
            return most + 1
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def without_repeats(docs, edits, min_chars, whole=0.8):
    """doc_id -> text without repeated lines; a copy of another document keeps what it has from there; emptied ones go."""
    texts, found, out = dict(docs), line_dedup(docs, edits, min_chars, sources=True), {}
    less = lambda d, gone: "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
    for d, t in texts.items():
        size = lambda d, gone: sum(len(x) for i, x in enumerate((texts[d] or "").split("\n")) if WORD.search(x) and i not in gone)
        left, others = less(d, found[d]), collections.Counter()
        for i, s in found[d].items():
            others[s] += len(texts[d].split("\n")[i]) * (s != d)
        others = +others
        if others:
            s = min(others, key=lambda x: (-others[x], x))
            copy = less(d, {i for i, x in found[d].items() if x != s})
            a, b = shingles(copy, 5), shingles(less(s, found[s]), 5)
            half = 2 * others[s] >= size(d, found[d]) + size(s, found[s])
            left = copy if half and a & b and len(a & b) >= whole * len(a | b) else left
        if WORD.search(left) or not WORD.search(t or ""):
            out[d] = left
    return out


def line_dedup(docs, edits, min_chars, sources=False):
    """doc_id -> (lines, dropped numbers, links); with sources, doc_id -> {dropped number: document of the earlier line}."""
    lines = [(d, i, x) for d, t in sorted(docs) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    kinds = list(first)
    near = {x: [] for x in kinds}
    by_size = collections.defaultdict(list)
    for x in kinds:
        if len(x) >= min_chars:
            by_size[len(x)].append(x)
    for x in kinds:
        for n in range(max(min_chars, len(x) - edits), len(x) + edits + 1) if len(x) >= min_chars else ():
            near[x] += [y for y in by_size[n] if y != x and edit_distance(x, y, edits) <= edits]
    out = {}
    own = collections.defaultdict(list)
    for d, i, x in lines:
        own[d].append((i, x))
    if sources:
        low = {x: min([first[x], *(first[y] for y in near[x])]) for x in kinds}
        return {d: {i: low[x][0] for i, x in own[d] if low[x] < (d, i)} for d, _ in docs}
    for d in sorted({d for d, _ in docs}):
        dropped = [i for i, x in own[d] if min([first[x], *(first[y] for y in near[x])]) < (d, i)]
        out[d] = (len(own[d]), dropped, sum(len(near[x]) for _, x in own[d]))
    return out


def luhn(digits):
    s = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    out = []
    for o, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), o, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def contaminated(docs, items, k, similarity):
    """(doc, item) pairs by every window of the item's length."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    texts = [(d, grams(words(x))) for d, x in docs]
    out = set()
    for i, t in items:
        a = collections.Counter(grams(words(t)))
        n = sum(a.values())
        for d, g in texts:
            if not n or not a.keys() & g:  # a run that shares nothing is not similar
                continue
            for s in range(max(1, len(g) - n + 1)):
                b = collections.Counter(g[s : s + n])
                if sum((a & b).values()) >= similarity * sum((a | b).values()) - 1e-12:
                    out.add((d, i))
                    break
    return out
