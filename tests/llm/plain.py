"""Brute-force versions of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def groups(nodes, links) -> dict:
    """Least reachable node of each."""
    near = defaultdict(set)
    for u, v in links:
        near[u].add(v)
        near[v].add(u)
    least = {}
    for start in sorted(nodes):
        if start not in least:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in least:
                    least[x] = start
                    stack += near[x]
    return least


def shingles(text: str | None, size: int = 5) -> set:
    words = PLAIN.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(docs: list[tuple[int, str | None]], percent: int = 85) -> set:
    sets = [(i, shingles(t)) for i, t in docs]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    links = []
    for k, (i, s) in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < k:
                    both[j] += 1
        links += [(i, sets[j][0]) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j][1]) - n)]
    least = groups([i for i, _ in docs], links)
    return {(i, len(s), least[i], least[i] == i) for i, s in sets}


def repeated_lines(docs: list[tuple[int, str | None]], size: int = 3) -> dict:
    """(lines, removed, kept text) by id."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = (text or "").split("\n") if text else []
        full = [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for at in range(len(full) - size + 1):
            window = tuple(x for _, x in full[at : at + size])
            if window in seen:
                gone |= set(range(full[at][0], full[at + size - 1][0] + 1))
            seen.add(window)
        # Touching runs are one, blank lines between them stay.
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 10) -> set:
    cut = lambda text: TERM.findall((text or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        terms = cut(text)
        for k in range(max(1, len(terms) - size + 1) if terms else 0):
            windows[tuple(terms[k : k + size])].add("" if item is None else str(item))
    lengths, out = {len(w) for w in windows}, set()
    for i, text in docs:
        terms, hit, found = cut(text), set(), set()
        for n in lengths:
            for k in range(len(terms) - n + 1):
                if (w := tuple(terms[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        out.add((i, len(terms), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m)
    tests = (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, p, ok in tests for m in p.finditer(text) if ok(m[0])]


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, z) for a, _, kind, z in sorted(found)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def repeated_bytes(docs: list[tuple[int, str | None]], length: int = 400) -> set:
    texts, seen = [((i, (t or "").encode())) for i, t in docs], defaultdict(int)
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[hash(b[k : k + length])] += 1
    out = set()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len([1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1])])
        out.add((i, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out
