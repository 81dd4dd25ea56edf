"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CASE = str.maketrans(UPPER, LOWER)


class Sets:
    """Disjoint sets named by their smallest member."""

    def __init__(self, items):
        self.above = {x: x for x in items}

    def root(self, x):
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)


def shingles(text, size):
    words = (text or "").encode().translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near_duplicates(rows, size, percent=80):
    sets = {d: shingles(t, size) for d, t in rows}
    groups, ids = Sets(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                groups.join(a, b)
    return {d: (len(sets[d]), groups.root(d)) for d in ids}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CASE))


def contamination(rows, items, length):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(length, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def repeated_bytes(rows, length):
    """(doc, bytes kept, removed spans) by looking at every window in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans, at = [], None
        for i, g in enumerate([*gone, 0]):
            if g and at is None:
                at = i
            elif not g and at is not None:
                spans.append((at, i))
                at = None
        out[doc] = (bytes(b for b, g in zip(data, gone) if not g), spans)
    return out


def kept_lines(rows, min_lines, min_chars):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [p for p, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        covered = set()
        for i, p in enumerate(full):
            one = lines[p]
            if one in seen and len(one) >= min_chars:
                covered.add(i)
            seen.add(one)
        out[doc] = (lines, full, covered)
    runs = set()
    for doc, (lines, full, covered) in out.items():
        for i in range(len(full) - min_lines + 1):
            key = tuple(lines[p] for p in full[i : i + min_lines])
            if key in runs:
                covered.update(range(i, i + min_lines))
            runs.add(key)
    kept = {}
    for doc, (lines, full, covered) in out.items():
        gone = {full[i] for i in covered}
        for i in covered:
            if i + 1 in covered:
                gone.update(range(full[i], full[i + 1]))
        kept[doc] = (len(full), len(covered), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return kept


def secrets(rows):
    """({doc: [(kind, start, end, value)]}, {value: owners}), found character by character."""
    alnum = UPPER + LOWER + "0123456789"
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]

    def run(text, at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def assign(text, at):
        """(end, value start) of an assignment that begins here, whatever the value's length."""
        for name in names:
            if text[at : at + len(name)].translate(CASE) == name:
                quotes = [1, 0] if text[at + len(name) : at + len(name) + 1] in ("'", '"') else [0]
                for quote in quotes:
                    k = run(text, at + len(name) + quote, " ")
                    if text[k : k + 1] not in (":", "=") or k >= len(text):
                        continue
                    k = run(text, k + 1, " ")
                    k += text[k : k + 1] in ("'", '"') and k < len(text)
                    end = run(text, k, alnum + "+/_.=-")
                    if end > k:
                        return end, k
        return None

    out, owners = {}, {}
    for doc, text, owner in rows:
        text, found, k = text or "", [], 0
        while k < len(text):
            hit = assign(text, k)
            if hit:
                if hit[0] - hit[1] >= 12:
                    found.append((k, 0, "assign", hit[0], text[hit[1] : hit[0]]))
                k = hit[0]
            else:
                k += 1
        for order, kind, head, allowed, least in ((1, "access", "AKIA", UPPER + "0123456789", 18), (2, "hex", "", "0123456789abcdef", 16)):
            k = 0
            while k < len(text):
                end = run(text, k + len(head), allowed) if text.startswith(head, k) else k
                if end > k + len(head):
                    if end - k >= least:
                        found.append((k, order, kind, end, text[k:end]))
                    k = end
                else:
                    k += 1
        out[doc] = [(kind, a, b, value) for a, _, kind, b, value in sorted(found)]
        for *_, value in out[doc]:
            owners.setdefault(value, set()).add(owner)
    return out, owners


def random_looking(value):
    counts = [value.count(c) for c in set(value)]
    bits = sum(c / len(value) * math.log2(len(value) / c) for c in counts)
    return any(c.isalpha() for c in value) and any(c.isdigit() for c in value) and bits >= 2.5
