"""The contracts, word by word, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def repeated_bytes(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            h = b[p : p + length]
            if h in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(h)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_words(texts, length=50):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone, new = [0] * len(w), set()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = [1] * length
            new.add(k)
        seen |= new
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and 100 * len(x & y) >= 75 * len(x | y) and x:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(x), root(i)) for i, x in sets.items()}


def leaks(texts, items, window=10):
    patterns: dict[tuple, set[str]] = {}
    for item, t in items:
        w = TEST_WORD.findall(lower(t or ""))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = {}
    for i, t in texts:
        w = TEST_WORD.findall(lower(t or ""))
        hit, found = [0] * len(w), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if (got := patterns.get(tuple(w[k : k + m]))) is not None:
                    hit[k : k + m] = [1] * m
                    found |= got
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0)
    return out


def counts(texts):
    out = {}
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {x for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for x in (k, k + 1, k + 2)}
        seen, twice = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        out[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
    return out


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text = text or ""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, fine in kinds for m in re.finditer(p, text) if fine(m[0])]


def secrets(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), m.end(), 0) for m in re.finditer(rf"""(?:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]
