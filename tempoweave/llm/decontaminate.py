"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of `window` consecutive words of a test item (a shorter item is
one window) is a pattern.  Patterns of equal length form one table:

* the *shift table* holds, for each two-word block of any pattern, the least
  distance from that block to a pattern's end.  A probe at every
  (length - 1)-th position decides whether any occurrence can lie around it;
  most probes hit a block that no pattern has and skip the whole stretch;
* positions whose block ends a pattern (shift 0) go to the *suffix bucket* of
  that block, in which the fingerprint of the whole window picks the pattern;
* what is picked is compared byte by byte.

The tables of at most `pass_bytes` of item texts at a time are sent to the
executors; larger benchmarks are searched in several passes over the documents,
whose hits are merged by a number of the row.  Nothing is shuffled in the usual
single pass.

Defined results: a null or empty text has no words and no hits; null or empty
items have no windows; every row gets a row, repeated ones and those without an
id as well; repeated items count once; the windows of items without an id are
hit like others, but such items are neither counted nor listed; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import written
from tempoweave.llm._text import FOLD, Ranges, arrow_batch, chunks, column_bytes, longs, mix, slices, word_codes, words

#: Bytes that no word of this contract has: all of ASCII but 0-9 and a-z (upper case is folded before).
ENDS_WORD = np.ones(256, bool)
ENDS_WORD[48:58] = ENDS_WORD[97:123] = False
ENDS_WORD[128:] = False

#: Bytes of item texts whose tables are sent to the executors together.
PASS_BYTES = 1 << 20


class _Table:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, patterns: list[bytes], owners: list[list[int]], length: int) -> None:
        self.length, self.block, self.owners = length, min(2, length), owners
        self.step = length - self.block + 1
        self.patterns = patterns
        text = b" ".join(patterns)
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), ENDS_WORD)
        codes = word_codes(data, starts, ends)
        whole = Ranges(codes).of(np.arange(len(patterns)) * length, np.arange(1, len(patterns) + 1) * length)
        codes = codes.reshape(len(patterns), length)
        blocks = np.stack([_blocks(codes[:, j : j + self.block]) for j in range(self.step)], 1)
        shifts = np.broadcast_to(np.arange(self.step)[::-1], blocks.shape)
        order = np.lexsort((shifts.ravel(), blocks.ravel()))
        keys = blocks.ravel()[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        self.keys, self.shifts = keys[first], shifts.ravel()[order][first]
        self.suffixes = np.unique(blocks[:, -1])
        entries = mix(blocks[:, -1] + mix(whole))  # a suffix bucket's patterns by their fingerprint
        self.by = np.argsort(entries, kind="stable")
        self.entries = entries[self.by]

    def shift(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        return np.where(self.keys[at] == blocks, self.shifts[at], self.step)

    def find(self, codes: np.ndarray, doc: np.ndarray, raw, ranges: Ranges | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of each occurrence; raw(i, j): the bytes of words i to j, joined by a space."""
        n, b = len(codes), self.block
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < self.length:
            return none
        probes = np.arange(b - 1, n, self.step)
        near = self.shift(_blocks(np.stack([codes[probes - b + 1 + j] for j in range(b)], 1)))
        some = near < self.step
        if not some.any():
            return none
        ends = (probes[some, None] + np.arange(self.step)[None, :])[np.arange(self.step)[None, :] >= near[some, None]]
        ends = ends[ends < n]
        ends = ends[ends >= self.length - 1]
        ends = ends[doc[ends] == doc[ends - self.length + 1]]
        if not len(ends):
            return none
        tails = _blocks(np.stack([codes[ends - b + 1 + j] for j in range(b)], 1))
        listed = self.suffixes[np.minimum(np.searchsorted(self.suffixes, tails), len(self.suffixes) - 1)] == tails
        ends, tails = ends[listed], tails[listed]
        if ranges is None:
            ranges = Ranges(codes)
        entry = mix(tails + mix(ranges.of(ends + 1 - self.length, ends + 1)))
        lo, hi = np.searchsorted(self.entries, entry, "left"), np.searchsorted(self.entries, entry, "right")
        found = [(e + 1 - self.length, int(p)) for e, i, j in zip(ends[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True) for p in self.by[i:j]]
        sure = [(i, p) for i, p in found if raw(i, i + self.length) == self.patterns[p]]
        return np.array([i for i, _ in sure], np.int64), np.array([p for _, p in sure], np.int64)


def _blocks(codes: np.ndarray) -> np.ndarray:
    out = codes[:, 0]
    for j in range(1, codes.shape[1]):
        out = mix(out * np.uint64(3) + codes[:, j])
    return out


def _tables(items: list[tuple[str | None, bytes]], window: int) -> list[_Table]:
    by_length: dict[int, dict[bytes, list[str | None]]] = {}
    keep = bytes(range(256)).translate(bytes(32 if e else i for i, e in enumerate(ENDS_WORD)))
    for item, text in items:
        parts = text.lower().translate(keep).split()
        m = min(window, len(parts))
        for i in range(len(parts) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(b" ".join(parts[i : i + m]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return [_Table(list(p), list(p.values()), m) for m, p in sorted(by_length.items())]


_SPANS = "array<struct<start:long,end:long>>"
_FOUND = pa.schema([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _occurrences(tables: list[_Table], column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, dict[int, tuple[list, list, set]]]]:
    """Ranges of texts, their numbers of words, and by text the first and last word of each occurrence and its items."""
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets):
        part, at = FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, firsts = words(part, at, ENDS_WORD)
        codes = word_codes(part, starts, ends)
        counts = np.diff(firsts)
        doc = np.repeat(np.arange(j - i), counts)
        found: dict[int, tuple[list, list, set]] = {}
        text = part.tobytes()
        raw = lambda a, b: b" ".join(text[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))  # noqa: B023, E731
        for table in tables:
            for w, p in zip(*(x.tolist() for x in table.find(codes, doc, raw)), strict=True):
                d = int(doc[w])
                a, b, items = found.setdefault(d, ([], [], set()))
                a.append(w - int(firsts[d]))
                b.append(w - int(firsts[d]) + table.length)
                items.update(x for x in table.owners[p] if x is not None)
        yield i, j, counts, found


def _scan(items: list[tuple[str | None, bytes]], window: int, hits_only: bool):
    """Texts to their occurrences, beside the column before `text`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(items, window)
        for batch in slices(batches):
            keys = batch.column(0)
            schema = pa.schema([pa.field(batch.schema.names[0], keys.type), *_FOUND])
            for i, j, counts, found in _occurrences(tables, batch.column("text")):
                rows = sorted(found) if hits_only else range(j - i)
                blank = ([], [], ())
                hits = [found.get(d, blank) for d in rows]
                yield arrow_batch(schema, keys.slice(i, j - i).take(pa.array(rows, pa.int64())), counts[list(rows)], [h[0] for h in hits], [h[1] for h in hits], [sorted(h[2]) for h in hits])

    return scan


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, pass_bytes: int) -> Iterator[tuple[list[tuple[str | None, bytes]], bool]]:
    """The items in lists of bounded size, one at a time, and whether that was the last one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(F.coalesce(F.col(item_text_col), F.lit("")), "UTF-8").alias("text"))
    now, size = [], 0
    for row in items.orderBy("item", "text").toLocalIterator():
        if now and size + len(row["text"]) > pass_bytes:
            yield now, False
            now, size = [], 0
        now.append((row["item"], bytes(row["text"])))
        size += len(row["text"])
    yield now, True


def find_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hits (array of start, end word of every occurring window), items (sorted item ids as strings)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    columns = "n_words long, starts array<long>, ends array<long>, items array<string>"
    spans = lambda start, end: F.arrays_zip(start.alias("start"), end.alias("end")).cast(_SPANS).alias("hits")
    rows, found = None, []
    for items, last in _passes(benchmark, item_col, item_text_col, pass_bytes):
        if last and rows is None:
            out = texts.mapInArrow(_scan(items, window, False), f"doc_id long, {columns}")
            return out.select("doc_id", "n_words", spans(F.col("starts"), F.col("ends")), "items")
        if rows is None:  # several passes: rows are numbered once, and written with their number
            rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "test-rows")
            words_of = rows.select("row", "text").mapInArrow(_scan([], window, False), f"row long, {columns}").select("row", F.col("n_words").alias("words"))
            words_of = written(rows.select("row", "doc_id").join(words_of, "row"), "test-words")
        found.append(written(rows.select("row", "text").mapInArrow(_scan(items, window, True), f"row long, {columns}"), "test-hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    every = lambda c: F.flatten(F.collect_list(c))
    hits = hits.groupBy("row").agg(every("starts").alias("starts"), every("ends").alias("ends"), F.array_sort(F.array_distinct(every("items"))).alias("items"))
    hits = hits.select("row", spans(F.col("starts"), F.col("ends")), "items")
    return words_of.join(hits, "row", "left").select("doc_id", F.col("words").alias("n_words"), F.coalesce("hits", F.array().cast(_SPANS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, with all columns, whose text has no window of an item."""
    schema = docs.schema
    for items, last in _passes(benchmark, item_col, item_text_col, pass_bytes):

        def scan(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            tables = _tables(items, window)
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for i, _, _, found in _occurrences(tables, batch.column(text_col)):
                    clean[[i + d for d in found]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, schema)
        docs = docs if last else written(docs, "test-clean")
    return docs


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        hit, sha = np.zeros(n, np.int64), [clean] * n
        items = batch.column("items").to_pylist()
        for k, spans in enumerate(batch.column("hits").to_pylist()):
            if spans:
                end = 0
                for s in sorted(spans, key=lambda x: x["start"]):
                    hit[k] += max(0, s["end"] - max(end, s["start"]))
                    end = max(end, s["end"])
                sha[k] = hashlib.sha256(",".join(items[k]).encode()).hexdigest()
        yield arrow_batch(_DIGEST, batch.column("doc_id"), longs(batch, "n_words"), hit, [len(x) for x in items], sha, hit > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated."""
    return find_items(docs, benchmark, **options).mapInArrow(_digests, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
