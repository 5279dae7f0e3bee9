"""Secret scans: three fixed patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax (`name = "literal"`,
`"name": 'literal'`, `name := A + "b"`, `NAME=value`, and `name = value` or
`name: value` with an unquoted value up to the line's end, a comment or the next
pair) into name-literal pairs.  Unquoted calls, subscripts, paths of names
without a digit (`config.apiToken`) and what holds quoted strings are taken as
expressions; unquoted values of several words or lines are not read.
Names bound to literals are constants of the text; a later expression that
names them gets their values (`A = "x1"; api_secret = A + "y2"`).  A pair is
scored by how sensitive its target's name is and how much its value looks like
a credential; pairs at or above the threshold add their literals' spans
(kind `named`), unless a fixed pattern has found the same place.

Each text is handled alone and whole, with nothing shuffled, in time and memory
that grow in proportion to its length: each character is lexed once, and joined
values are kept as summaries with references to their parts, never as strings.

Defined results: a null or empty text has no spans; repeated rows and rows
without an id each get a row; other columns are ignored; offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._text import arrow_batch, slices

KINDS = ("assign", "access", "hex", "named")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: How sensitive a part of a name is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "auth": 0.6, "key": 0.5, "pass": 0.7}
#: Contents that stand for a secret but are none.
PLACEHOLDERS = ("changeme", "example", "placeholder", "your", "xxxx", "none", "null", "true", "false", "todo", "redacted", "****")

_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
_NAMED = re.compile(r"""(?<![\w$.-])[\w$.-]++["']?\s*+[=:]""", re.ASCII)
_LEX = re.compile(r"""\s*+(?:(?P<str>"(?:[^"\\\n]|\\.)*+(?:"|(?P<open>))|'(?:[^'\\\n]|\\.)*+(?:'|(?P<open2>)))|(?P<name>[A-Za-z_$][\w$.-]*+)|(?P<op>:=|=>|==|!=|<=|>=|=|:|\+)|(?P<end>[\n;,{}()\[\]])|(?P<other>\S))""", re.ASCII)
_LINE = re.compile(r"[^\S\n]*+")
_SHELL = re.compile(r"[^\s;,'\"]*")
_WORD = re.compile(r"""(?:(?![;,](?:\s|$|["']?[\w.-]++["']?\s*+[:=]))\S)*+""", re.ASCII)
_LAST = re.compile(r"[^\S\n]*+(?:\n|\Z|[#;])")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_EXPRESSION = re.compile(r"[&*!]?[A-Za-z_$][\w$.]*(?:\(.*\)|\[.*\]).*|[A-Za-z_$]+(?:(?:\.|->|::)[A-Za-z_$]+)+", re.ASCII)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the three patterns find, leftmost and without overlaps in each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def name_score(name: str) -> float:
    """How sensitive an assignment's target is, from 0 to 1: its most sensitive part, or two joined parts."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False))])


_EDGE = max(map(len, PLACEHOLDERS)) - 1
_CLASSES = tuple(re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


@dataclass
class Value:
    """What scoring needs of a value, and where it comes from: a span of the text, or two other values."""

    size: float
    shares: dict[int, float]  #: share of each code point modulo 128
    classes: int  #: bits of the character classes
    plain: bool  #: no blank and no placeholder
    head: str
    tail: str
    span: tuple[int, int] | None = None
    parts: tuple[Value, ...] = field(default=(), repr=False)

    @classmethod
    def of(cls, text: str, span: tuple[int, int]) -> Value:
        low, n = text.lower(), len(text)
        counts = Counter(text)
        shares: dict[int, float] = {}
        for c, k in counts.items():
            shares[ord(c) % 128] = shares.get(ord(c) % 128, 0.0) + k / n
        classes = sum(1 << k for k, p in enumerate(_CLASSES) if p.search(text))
        return cls(n, shares, classes, not re.search(r"\s", text) and not any(p in low for p in PLACEHOLDERS), low[: _EDGE + 1], low[-_EDGE:], span)

    def __add__(self, other: Value) -> Value:
        if not self.size or not other.size:
            empty, full = (self, other) if not self.size else (other, self)
            return Value(full.size, full.shares, full.classes, full.plain, full.head, full.tail, parts=(empty, full))
        size = min(self.size + other.size, 1e15)
        a = self.size / (self.size + other.size)
        shares = {c: a * self.shares.get(c, 0.0) + (1 - a) * other.shares.get(c, 0.0) for c in self.shares.keys() | other.shares.keys()}
        seam = self.tail + other.head[:_EDGE]
        plain = self.plain and other.plain and not any(p in seam for p in PLACEHOLDERS)
        return Value(size, shares, self.classes | other.classes, plain, (self.head + other.head)[: _EDGE + 1], (self.tail + other.tail)[-_EDGE:], parts=(self, other))

    def score(self) -> float:
        """How much a value looks like a credential, from 0 to 1: no blanks, long, of many different characters and classes."""
        if self.size < 6 or not self.plain or self.head.startswith(("$", "%", "<", "{")):
            return 0.0
        entropy = -sum(p * math.log2(p) for p in self.shares.values() if p > 0)
        return min(1.0, entropy / 4) * min(1.0, 0.4 + 0.3 * (self.classes.bit_count() - 1) + 0.2 * (self.size >= 16))


class _Bare:
    """Unquoted values of a text. What is known of a word holds for each place in it, so no word is read twice."""

    def __init__(self, text: str) -> None:
        self.text, self.end, self.last, self.quoted = text, 0, False, (0, 0)

    def at(self, start: int) -> tuple[tuple[int, int] | None, int]:
        """The span of the value that starts here, if it is one word and no expression, and where lexing goes on."""
        text = self.text
        if start >= self.end:
            self.end = end = _WORD.match(text, start).end()
            self.last = end < len(text) and text[end] in ";," or bool(_LAST.match(text, end))
            self.quoted = (0, 0)
        if not self.last or self.quoted[0] >= start and self.quoted[1]:
            return None, start
        if self.quoted != (-1, -1) and (m := _QUOTED.search(text, start, self.end)):
            self.quoted = m.span()
            return None, start
        self.quoted = (-1, -1)
        value = text[start : self.end].rstrip(";,")
        spare = {close: value.count(close) - value.count(opening) for close, opening in zip(")]}", "([{", strict=True)}
        size = len(value)
        while size and spare.get(value[size - 1], 0) > 0:
            spare[value[size - 1]] -= 1
            size -= 1
        if not size or _EXPRESSION.fullmatch(value, 0, size):
            return None, max(start, self.end)
        return (start, start + size), self.end


def _tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Kind, text and place of each token. A quote that its line doesn't close is a sign like others, as are all later ones of the line."""
    at, n = 0, len(text)
    open_until = {'"': 0, "'": 0}
    while (at := _LINE.match(text, at).end()) < n:
        c = text[at]
        if c in "\"'" and at < open_until[c]:
            yield "other", c, at, at + 1
            at += 1
            continue
        m = _LEX.match(text, at)
        if m is None:
            return
        kind = m.lastgroup
        if kind in ("open", "open2") or m["open"] is not None or m["open2"] is not None:
            start = m.start("str")
            open_until[text[start]] = m.end()
            yield "other", text[start], start, start + 1
            at = start + 1
            continue
        yield kind, m[kind], m.start(kind), m.end()
        at = m.end()


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """Target name and value of each assignment whose value is known."""
    constants: dict[str, Value] = {}
    tokens = list(_tokens(text))
    bare = _Bare(text)
    i, n = 0, len(tokens)
    while i + 2 < n:
        kind, target, _, name_end = tokens[i]
        sign = tokens[i + 1]
        if kind not in ("name", "str") or sign[0] != "op" or sign[1] not in ("=", ":", ":=", "=>"):
            i += 1
            continue
        name = target[1:-1] if kind == "str" else target
        j, value, known, go_on = i + 2, None, True, 0
        while j < n:
            kind, word, start, end = tokens[j]
            if kind == "str":
                part = Value.of(word[1:-1], (start + 1, end - 1)) if end - start > 2 else Value(0, {}, 0, True, "", "")
                value = part if value is None else value + part
            elif kind == "name" and word in constants:
                value = constants[word] if value is None else value + constants[word]
            elif kind in ("name", "other") and sign[1] == "=" and sign[3] == start and sign[2] == name_end:
                go_on = _SHELL.match(text, start).end()  # NAME=value of a shell or an env file
                value = Value.of(text[start:go_on], (start, go_on)) if go_on > start else None
            else:
                known = False
                if j == i + 2 and (kind in ("name", "other") or word == "+") and sign[1] != "=>" and name_score(name):
                    span, go_on = bare.at(start)
                    if span:
                        yield name, Value.of(text[slice(*span)], span)
                break
            if not go_on and j + 1 < n and tokens[j + 1][1] == "+":
                j += 2
                continue
            break
        if known and value is not None and value.size:
            if sign[1] in ("=", ":=", ":"):
                constants[name] = value
            yield name, value
        i = max(i + 2, j)
        while i < n and tokens[i][2] < go_on:
            i += 1


def find_secrets(text: str | None, threshold: float = 0.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and the spans that lexing adds."""
    text = text or ""
    base = base_spans(text)
    low = text.lower()
    if not any(h in low for h in _HINTS) or not any(any(h in m[0].lower() for h in _HINTS) for m in _NAMED.finditer(text)):
        return base, []
    starts, ends = [s for s, _, _ in base], []
    for _, e, _ in base:
        ends.append(max(e, ends[-1] if ends else 0))
    added: set[tuple[int, int]] = set()
    done: set[int] = set()
    kept: list[Value] = []  # so that numbers of values stay theirs
    for name, value in assignments(text):
        if name_score(name) * value.score() < threshold:
            continue
        todo = [value]
        while todo:
            v = todo.pop()
            if id(v) in done:
                continue
            done.add(id(v))
            kept.append(v)
            todo += v.parts
            if v.span:
                k = bisect_right(starts, v.span[1] - 1)
                if not k or ends[k - 1] <= v.span[0]:
                    added.add(v.span)
    return base, [(a, b, "named") for a, b in sorted(added)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all, kind:start:end by start)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = [find_secrets(t.as_py(), threshold) for t in batch.column("text")]
            counts = [Counter(k for *_, k in base) for base, _ in rows]
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), [c["assign"] for c in counts], [c["access"] for c in counts], [c["hex"] for c in counts], [hashlib.sha256(_shown(base).encode()).hexdigest() for base, _ in rows], [_shown(base + more) for base, more in rows])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each found span replaced by a mark; where a count of characters is kept, it follows the text."""
    fields = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            texts, changed = batch.column(text_col).to_pylist(), []
            for k, text in enumerate(texts):
                base, more = find_secrets(text, threshold)
                if base or more:
                    out, at = [], 0
                    for a, b, _ in sorted(base + more):
                        if b > at:
                            out += [text[at:a], mark] if a >= at else []
                            at = b
                    texts[k] = "".join([*out, text[at:]])
                    changed.append(k)
            if changed:
                at = batch.schema.get_field_index(text_col)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if count_col in batch.schema.names:
                    at = batch.schema.get_field_index(count_col)
                    counts = batch.column(at).to_pylist()
                    for k in changed:
                        counts[k] = len(texts[k])
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(scan, fields)
