"""Personal data: four fixed patterns, and a linear-chain CRF over word-shape features.

The CRF is trained on the driver from a small labelled table (`labelled_table`,
a few dozen sentences) and labels tokens O, or B-/I- of phone (national
forms), ident (identity numbers) and email (spelled with [at] and [dot]).  It
is decoded by Viterbi in numpy batches, over the whole token sequence under one
constraint: a token further than `_BOUND` tokens from any with a digit, `@` or a
bracketed at/dot is O.  As such tokens have one label, the best path is that of
each stretch between them, with its true neighbours' features and the moves
from and to their O.

Spans that the CRF finds are added unless they overlap a span of the patterns;
the patterns' spans always stay.  Each text is handled alone and whole, with
nothing shuffled.

Defined results: a null or empty text has no spans; repeated rows and rows
without an id each get a row; other columns are ignored; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._text import arrow_batch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ident")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]|[\[(](?:at|AT|dot|DOT)[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the four patterns find, by kind, then start."""
    found = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) < 4 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# ---------------------------------------------------------------- the CRF

#: The labelled table: sentences with {kind text} marks. Fixed values.
LABELLED = (
    "please call me at {phone 555-123-4567} after noon",
    "phone : {phone (555) 987-6543} or write",
    "you can reach the office on {phone 212-555-0187} .",
    "tel {phone 030 1234567} heute",
    "her number is {phone 415.555.2671} and she answers",
    "fax {phone (020) 7946-0018}",
    "mobile {phone 07700 900123} for urgent matters",
    "contact {phone 06 12 34 56 78} le matin",
    "llame al {phone 91 123 45 67} por la tarde",
    "ring {phone 555 867 5309} tonight",
    "call {phone 800-555-0199} now",
    "his ssn is {ident 123-45-6789} on file",
    "social security number {ident 987-65-4321} was sent",
    "ssn : {ident 078-05-1120}",
    "id {ident 219-09-9999} of the applicant",
    "tax id {ident 12-3456789} for the company",
    "passport {ident X1234567} was issued",
    "passport number {ident C01X00T47} is valid",
    "write to {email jane.doe [at] mail [dot] com} today",
    "mail {email support (at) example (dot) org} for help",
    "contact {email k.brown [at] uni.example}",
    "email me : {email team [at] firm [dot] co}",
    "the year 1999 was better than 2004 for them",
    "it cost 12.50 and then 1,200 more",
    "page 825 of 1200 in volume 3",
    "from 10:30 to 11:45 on 2024-01-15 there",
    "version 2.10.3 was released with 45 fixes",
    "about 3 of 4 people and 75 % of 200",
    "chapter 12 , section 3-4 and 5-6",
    "the score was 21-14 in 1987",
    "ratio 16:9 with 1920x1080 pixels",
    "order 20240115 holds 18 items at 7.99",
    "between 1914-1918 and 1939-1945 there",
    "line 7 says 1000000 times 42 is large",
    "see table 4.2 and figure 10.11 of part 2",
    "in 12 days 300 men walked 25 km to the city",
    "code 7c72db563d7f 4304158793483661 follows",
    "she said ( at ) first and then left",
    "on 12/05/2021 and 2021-05-12 at 08:15:30 it ran",
    "2 + 2 = 4 and 10 - 3 = 7",
)
LABELS = ("O", "B-phone", "I-phone", "B-ident", "I-ident", "B-email", "I-email")
_CUES = frozenset("call phone tel fax mobile number reach ring contact llame office ssn social security id tax passport mail email write to at page year version chapter section score ratio order line table figure code".split())
_TOKEN = re.compile(r"\S+")
_BOUND = 8  #: tokens on each side of an interesting one that are decoded with it


def labelled_table() -> list[tuple[list[str], list[int]]]:
    out = []
    for sentence in LABELLED:
        tokens, labels = [], []
        for m in re.finditer(r"\{(\w+) ([^}]*)\}|(\S+)", sentence):
            if m[3]:
                tokens.append(m[3])
                labels.append(0)
            else:
                for k, t in enumerate(m[2].split()):
                    tokens.append(t)
                    labels.append(LABELS.index(("I-" if k else "B-") + m[1]))
        out.append((tokens, labels))
    return out


def shape(token: str) -> str:
    """The word's shape: digits d, runs of letters (with digits among them) x or X, other signs as they are."""
    s = re.sub(r"[0-9]", "d", token)
    return re.sub(r"[^\W\d_]+", lambda m: ("X" if m[0][0].isupper() else "x") if m[0].strip("d") else m[0], s)


class _Features:
    """Feature numbers of a token: its shape, length, cue word, and those of its neighbours."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.frozen = False
        self.own: dict[str, tuple[str, str]] = {}

    def of(self, tokens: list[str], before: str = "^", after: str = "$") -> list[list[int]]:
        seen = [before, *tokens, after]
        marks = []
        for t in seen:
            got = self.own.get(t)
            if got is None:
                low = t.lower().strip(".,:;")
                got = (shape(t.rstrip(".,;")), low if low in _CUES else "-")
                if len(self.own) < 50_000 and len(t) < 64:
                    self.own[t] = got
            marks.append(got)
        out = []
        for k in range(1, len(seen) - 1):
            (a, ca), (b, cb), (c, _) = marks[k - 1], marks[k], marks[k + 1]
            names = (f"s={b}", f"p={a}", f"n={c}", f"ps={a}|{b}", f"sn={b}|{c}", f"c={cb}", f"pc={ca}|{b[:6]}", f"d={b.count('d')}", "bias")
            if not self.frozen:
                for x in names:
                    self.known.setdefault(x, len(self.known))
            out.append([self.known[x] for x in names if x in self.known])
        return out


class ChainCrf:
    """Linear-chain CRF: emission weights by feature and label, and transition weights."""

    def __init__(self) -> None:
        self.features = _Features()
        self.emit = np.zeros((0, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))

    @staticmethod
    def _barred() -> np.ndarray:
        bar = np.zeros((len(LABELS), len(LABELS)))
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                for i, at in enumerate(LABELS):
                    if at[2:] != to[2:] or at == "O":
                        bar[i, j] = -1e4
        return bar

    def fit(self, table: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.3, ridge: float = 0.02) -> ChainCrf:
        """Maximum likelihood with a ridge penalty, by full-batch gradient steps (forward-backward in numpy over padded sentences)."""
        lists = [self.features.of(tokens) for tokens, _ in table]
        self.features.frozen = True
        n, f, k, t = len(table), len(self.features.known), len(LABELS), max(len(x) for x in lists)
        x = np.zeros((n, t, f))
        y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
        for s, (rows, (_, labels)) in enumerate(zip(lists, table, strict=True)):
            for p, row in enumerate(rows):
                x[s, p, row] = 1
            y[s, : len(labels)], mask[s, : len(labels)] = labels, True
        flat = x.reshape(n * t, f)
        gold = np.eye(k)[y] * mask[:, :, None]
        gold_moves = np.einsum("npi,npj->ij", gold[:, :-1], gold[:, 1:])
        self.emit, bar = np.zeros((f, k)), self._barred()
        g1, g2 = np.zeros((f, k)), np.zeros((k, k))
        for _ in range(rounds):
            e = (flat @ self.emit).reshape(n, t, k)
            move = self.move + bar
            a = np.full((n, t, k), 0.0)
            a[:, 0] = e[:, 0] + bar[0]
            for p in range(1, t):
                new = _lse(a[:, p - 1, :, None] + move, 1) + e[:, p]
                a[:, p] = np.where(mask[:, p, None], new, a[:, p - 1])
            b = np.zeros((n, t, k))
            for p in range(t - 2, -1, -1):
                new = _lse(move[None] + (e[:, p + 1] + b[:, p + 1])[:, None, :], 2)
                b[:, p] = np.where(mask[:, p + 1, None], new, 0)
            z = _lse(a[:, -1], 1)
            post = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            pair = a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
            moves = (np.exp(pair) * mask[:, 1:, None, None]).sum((0, 1))
            de = flat.T @ (gold - post).reshape(n * t, k) - ridge * self.emit
            dm = gold_moves - moves - ridge * self.move
            g1, g2 = g1 + de**2, g2 + dm**2
            self.emit += rate * de / np.sqrt(g1 + 1e-8)
            self.move += rate * dm / np.sqrt(g2 + 1e-8)
        return self

    def decode(self, sequences: list[list[str]], around: list[tuple[str | None, str | None]] | None = None) -> list[np.ndarray]:
        """The best labels of each sequence, by Viterbi over batches of sequences of about the same length.

        around: the tokens before and after each sequence, whose label is O; None where the text begins or ends.
        """
        around = around or [(None, None)] * len(sequences)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = [i for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])) if sequences[i]]
        k, move = len(LABELS), self.move + self._barred()
        while order:
            size = max(1, sum(len(sequences[order[-1 - x]]) * (x + 1) <= 200_000 for x in range(min(256, len(order)))))
            group, order = order[-size:], order[:-size]
            length = np.array([len(sequences[i]) for i in group])
            t = int(length.max())
            e = np.zeros((len(group), t, k))
            inside = np.zeros((len(group), 2), bool)
            for s, i in enumerate(group):
                before, after = around[i]
                inside[s] = before is not None, after is not None
                for p, row in enumerate(self.features.of(sequences[i], before or "^", after or "$")):
                    e[s, p] = self.emit[row].sum(0)
            best, back = e[:, 0] + np.where(inside[:, :1], move[0], self._barred()[0]), np.zeros((len(group), t, k), np.int8)
            for p in range(1, t):
                scores = best[:, :, None] + move
                on = p < length
                back[:, p] = np.where(on[:, None], scores.argmax(1), np.arange(k))
                best = np.where(on[:, None], scores.max(1) + e[:, p], best)
            label = (best + np.where(inside[:, 1:], move[:, 0], 0.0)).argmax(1)
            path = np.zeros((len(group), t), int)
            for p in range(t - 1, -1, -1):
                path[:, p] = label
                label = back[np.arange(len(group)), p, label]
            for s, i in enumerate(group):
                out[i] = path[s, : length[s]]
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def _stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], tuple[int, int] | None, tuple[int, int] | None]]:
    """The spans of tokens near one that could carry a label, as separate stretches, each with its neighbours'."""
    spots = [m.start() for m in _MAYBE.finditer(text)]
    held: list[tuple[int, int]] = []  # the stretch and what follows it, or the last tokens before one
    nth, last, spot = -1, None, 0  # last: the place in held of the last token with a spot

    def ended() -> tuple[list[tuple[int, int]], tuple[int, int] | None, tuple[int, int] | None]:
        first = 1 if nth >= 0 else 0  # held[0] is the neighbour before
        end = last + 1 + _BOUND
        return held[first:end], held[0] if first else None, held[end] if end < len(held) else None

    for m in _TOKEN.finditer(text):
        if last is None and spot == len(spots):
            break
        if last is not None and len(held) - last > 2 * _BOUND + 1:
            yield ended()
            held, last, nth = held[-_BOUND - 1 :], None, 0
            if spot == len(spots):
                return
        held.append(m.span())
        if spot < len(spots) and spots[spot] < m.end():
            last = len(held) - 1
            while spot < len(spots) and spots[spot] < m.end():
                spot += 1
        elif last is None and len(held) > _BOUND + 1:
            held, nth = held[1:], 0
    if last is not None:
        yield ended()


_TRIM = ".,;:!?"


def find_added(model: ChainCrf, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    where, sequences, around = [], [], []
    for d, text in enumerate(texts):
        for tokens, *beside in _stretches(text):
            where.append((d, tokens))
            sequences.append([text[a:b] for a, b in tokens])
            around.append(tuple(s and text[slice(*s)] for s in beside))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (d, tokens), path in zip(where, model.decode(sequences, around), strict=True):
        p = 0
        while p < len(path):
            if path[p] == 0:
                p += 1
                continue
            q = p + 1
            while q < len(path) and LABELS[path[q]][0] == "I":
                q += 1
            a, b = tokens[p][0], tokens[q - 1][1]
            while b > a and texts[d][b - 1] in _TRIM:
                b -= 1
            kind = LABELS[path[p]][2:]
            if b > a and _MAYBE.search(texts[d], a, b) and not any(x < b and a < y for _, x, y in base[d]):
                out[d].append((kind, a, b))
            p = q
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the patterns' spans), spans (all; kind:start:end by kind, then start)."""
    model = ChainCrf().fit(table or labelled_table())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t if t and _MAYBE.search(t) else "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) if t else [] for t in texts]
                more = find_added(model, texts, base)
                counts = [[sum(k == kind for k, _, _ in found) for found in base] for kind in BASE_KINDS]
                yield arrow_batch(_SCHEMA, part.column("doc_id"), *counts, [hashlib.sha256(_shown(b).encode()).hexdigest() for b in base], [_shown(b + m) for b, m in zip(base, more, strict=True)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
