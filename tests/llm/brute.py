"""Plain restatements of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

DATA = "/root/testdata"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = set()
    for group in where.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                if (pair := (group[a], group[b])) not in seen:
                    seen.add(pair)
                    x, y = sets[pair[0]], sets[pair[1]]
                    common = len(x & y)
                    if 100 * common >= 80 * (len(x) + len(y) - common):
                        up[root(pair[0])] = root(pair[1])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def contamination(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = pattern.findall(lower(text))
        m = min(10, len(w))
        if m and item is not None:
            for i in range(len(w) - m + 1):
                windows[tuple(w[i : i + m])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w = pattern.findall(lower(text))
        hit, ids = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    ids |= windows[k]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def base_secrets(text: str | None):
    text = text or ""
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    found.sort()
    return [sum(k == i for _, k, _, _ in found) for i in range(3)], hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in found).encode()).hexdigest()


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits_allowed(length: int, threshold) -> int:
    steps = ((0, threshold),) if isinstance(threshold, int) else threshold
    return max((t for low, t in steps if length >= low), default=0)


def dropped_lines(rows, threshold=2, min_chars: int = 10, collapse: bool = True) -> dict[int, list[int]]:
    """Line numbers that go, per doc_id; white space inside a line is folded if `collapse`."""
    places = defaultdict(list)
    for doc, text in rows:
        if doc is not None and text is not None:
            for i, raw in enumerate(text.split("\n")):
                line = (re.sub(r"[ \t\x0B\f\r]+", " ", raw) if collapse else raw).strip(" ")
                if len(line) >= min_chars:
                    places[line].append((doc, i))
    lines = sorted(places, key=len)
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        most = edits_allowed(len(a), threshold)
        for b in lines[i + 1 :]:
            if len(b) - len(a) > most:
                break
            # a pair within the threshold has at most 2 * threshold signs more on one side than on the other
            if not sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 2 * most and edit_distance(a, b) <= most:
                up[root(a)] = root(b)
    classes = defaultdict(list)
    for x in lines:
        classes[root(x)] += places[x]
    out = defaultdict(set)
    for spots in classes.values():
        for doc, i in set(spots) - {min(spots)}:
            out[doc].add(i)
    return {d: sorted(x) for d, x in out.items()}
