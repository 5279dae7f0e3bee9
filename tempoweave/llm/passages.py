"""Shared machinery of the two exact substring removers.

Both remove what lies in a window of `length` symbols (bytes or words) that
also occurs earlier.  Instead of all positions only *anchors* travel: in each
window the position whose `gram` has the least fingerprint, the leftmost of
equals.  Equal windows have equal anchors at equal distances, so

* a window can only repeat if its anchor's gram does (other anchors leave after
  the first sort), and
* anchors whose whole context (all windows they stand for) is equal repeat
  each other in every window, however long the copies are.

Only anchors with a common gram but different contexts - the ends of copied
passages - stay open, and their windows are compared one by one, in groups that
share half of the context as well.  Where more than `most` of them have one
gram, not their texts but two fingerprints of each window travel, so no task
has to hold a frequent passage's contexts.  Fingerprints are polynomials modulo 2**61 - 1; two windows
are taken as equal if those at two independent random bases agree.

A row counts once, however often it is repeated.  Of rows that share an id but
differ in their text, only the text of the least hash is judged.

Rows of a batch that repeat within the batch are settled there and are spread
over all tasks, so a passage in a third of all documents does not gather in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import written
from tempoweave.llm._text import Ranges, chunks, column_bytes, longs, mix, slices, word_codes, words

_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 20
#: Single windows that a task settles among themselves before it sends them on.
HELD = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Setup:
    length: int
    gram: int
    by_words: bool
    most: int

    @property
    def reach(self) -> int:
        """Windows that an anchor can stand for."""
        return self.length - self.gram + 1

    @property
    def half(self) -> int:
        return self.reach // 2


def symbols(data: np.ndarray, offsets: np.ndarray, by_words: bool) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Two codes of bytes or words, each document's first, and every symbol's start and end byte."""
    if not by_words:
        at = np.arange(len(data) + 1)
        return (data, data), offsets, at[:-1], at[1:]
    starts, ends, firsts = words(data, offsets)
    return (word_codes(data, starts, ends), word_codes(data, starts, ends, 1)), firsts, starts, ends


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    s = 1
    while s * 2 <= width:
        a = np.minimum(a[:-s], a[s:])
        s *= 2
    return np.minimum(a[: -(width - s)], a[width - s :]) if s < width else a


def anchors(codes: tuple[np.ndarray, np.ndarray], firsts: np.ndarray, setup: Setup) -> Iterator[tuple[np.ndarray, ...]]:
    """Gram, context, document, first window, last window and anchor, for each run of windows with one anchor."""
    length, reach = setup.length, setup.reach
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for at in range(0, len(codes[0]) - length + 1, _BLOCK):
        part, other = (x[at : at + _BLOCK + length - 1] for x in codes)
        grams, ranges = mix(Ranges(part).grams(setup.gram)), Ranges(other, 1)
        best = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), reach)
        anchor = (best & _PLACE).astype(np.int64)
        here = doc[at : at + len(part)]
        window = np.flatnonzero(here[: len(anchor)] == here[length - 1 :])
        if not len(window):
            continue
        anchor = anchor[window]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
        lo, hi, anchor = window[new], window[np.r_[new[1:], len(window)] - 1], anchor[new]
        context = mix(ranges.of(lo, hi + length) + mix(((anchor - lo) * 256 + (hi - lo)).astype(np.uint64)))
        yield grams[anchor], context, here[lo], lo + at, hi + at, anchor + at


def _after_first(new: np.ndarray, doc: np.ndarray, place: np.ndarray, by_words: bool) -> np.ndarray:
    """Rows of sorted groups that are not at the place of their group's first (by words: in a later document)."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return doc > doc[first] if by_words else (doc != doc[first]) | (place != place[first])


def _settled(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, lo: np.ndarray, by_words: bool) -> np.ndarray:
    """Rows that repeat an earlier one of the same gram and context."""
    order = np.lexsort((lo, doc, context, gram))
    g, c, d, at = gram[order], context[order], doc[order], lo[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
    late = _after_first(new, d, at, by_words)
    out = np.zeros(len(gram), bool)
    out[order[late]] = True
    return out


_FIRST = "gram long, context long, doc_id long, lo long, rest int"


def _scan(setup: Setup):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            data, offsets = column_bytes(batch.column("text"))
            ids = longs(batch, "doc_id")
            for i, j in chunks(offsets):
                codes, firsts, _, _ = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], setup.by_words)
                parts = list(anchors(codes, firsts, setup))
                if not parts:
                    continue
                gram, context, doc, lo, hi, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
                lo, hi, anchor = lo - firsts[doc], hi - firsts[doc], anchor - firsts[doc]
                doc = ids[i:j][doc]
                settled = _settled(gram, context, doc, lo, setup.by_words)
                spread = mix(doc.astype(np.uint64) * _SPREAD + lo.astype(np.uint64))
                gram, context = np.where(settled, spread, gram), np.where(settled, np.uint64(0), context)
                rest = ((hi - lo) | (anchor - lo) << 8 | settled.astype(np.int64) << 16).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), context.view(np.int64), doc, lo, rest)], names=["gram", "context", "doc_id", "lo", "rest"])

    return scan


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that never part the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = longs(batch, key)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held and (cut or k[0] != longs(held[-1], key)[-1]):
            yield _joined([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows; 64-bit offsets, as combine_chunks parts a binary column at 2 GiB."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches)
    wide = pa.schema([f.with_type(pa.large_binary()) if pa.types.is_binary(f.type) else f for f in table.schema])
    (whole,) = table.cast(wide).combine_chunks().to_batches()
    return whole


def _compare(setup: Setup):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "gram"):
            gram, context, doc, lo, rest = (longs(batch, n) for n in ("gram", "context", "doc_id", "lo", "rest"))
            settled = rest >> 16 & 1 == 1
            out, still = [(doc[settled], lo[settled], rest[settled] & 0xFFFF)], ~settled
            gram, context, doc, lo, rest = (x[still] for x in (gram, context, doc, lo, rest))
            if len(gram):
                new = np.r_[True, gram[1:] != gram[:-1]]
                kind = new | np.r_[True, context[1:] != context[:-1]]
                group, each = np.cumsum(new) - 1, np.cumsum(kind) - 1
                least = doc[np.flatnonzero(kind)]
                if setup.by_words:
                    late = doc > least[each]
                    heads = np.flatnonzero(kind)
                    low, high = np.minimum.reduceat(least, np.searchsorted(heads, np.flatnonzero(new))), np.maximum.reduceat(least, np.searchsorted(heads, np.flatnonzero(new)))
                    open_ = ~late & (low != high)[group]
                else:
                    late = _after_first(kind, doc, lo, False)
                    open_ = kind & (np.bincount(group, kind)[group] > 1)
                out.append((doc[late], lo[late], rest[late] & 0xFFFF))
                many = np.bincount(group[open_], minlength=group[-1] + 1)[group[open_]] > setup.most
                out.append((doc[open_], lo[open_], rest[open_] & 0xFFFF | 1 << 16 | many.astype(np.int64) << 17))
            doc, lo, rest = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(rest.astype(np.int32))], names=["doc_id", "lo", "rest"])

    return compare


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, for a join that has to move whole texts."""
    return docs.mapInArrow(_pack, "doc_id long, packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(x.as_py()) for x in column]


def lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a column of arrays of structs, flat, and each row's first entry (one more at the end)."""
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()
    return [f.to_numpy(zero_copy_only=False) for f in flat.flatten()], np.r_[0, np.cumsum(sizes)]


_OPEN = "key long, mate long, doc_id long, lo long, windows int, text binary"


def repeats(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray, by_words: bool) -> np.ndarray:
    """Windows, in order of two fingerprints, document and place, that repeat an earlier one."""
    return _after_first(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])], doc, place, by_words)


def expanded(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row `count` times, and the places from its first one on."""
    each = np.repeat(row, count)
    return each, np.repeat(first, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)


def sent(held: list[tuple[np.ndarray, ...]], by_words: bool) -> pa.RecordBatch:
    """Single windows under their rank, with a second one as mate; runs that repeat one of these go anywhere, with a negative number of windows."""
    rank, key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, doc, key, rank))
    rank, key, doc, place = rank[order], key[order], doc[order], place[order]
    late = repeats(rank, key, doc, place, by_words)
    d, at = doc[late], place[late]
    order = np.lexsort((at, d))
    d, at = d[order], at[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)][: len(d)])
    d, at, count = d[new], at[new], np.diff(np.r_[new, len(d)])
    anywhere = mix(d.astype(np.uint64) * _SPREAD + at.astype(np.uint64))
    columns = [np.r_[rank[~late], anywhere].view(np.int64), np.r_[key[~late].view(np.int64), np.zeros(len(d), np.int64)], np.r_[doc[~late], d], np.r_[place[~late], at], np.r_[np.zeros(np.sum(~late), np.int32), -count.astype(np.int32)]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.binary())], names=["key", "mate", "doc_id", "lo", "windows", "text"])


def _settled_windows(setup: Setup, settle: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Settles what _sent sends, and leaves the texts of other contexts to `settle`."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            has_text = batch.column("text").is_valid()
            if has_text.false_count:
                key, mate, doc, lo, count = (longs(batch.filter(pa.compute.invert(has_text)), n) for n in ("key", "mate", "doc_id", "lo", "windows"))
                done, single = count < 0, np.flatnonzero(count == 0)
                late = single[repeats(key[single], mate[single], doc[single], lo[single], setup.by_words)] if len(single) else single
                rest = np.r_[-1 - count[done], np.zeros(len(late), np.int64)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[doc[done], doc[late]]), pa.array(np.r_[lo[done], lo[late]]), pa.array(rest)], names=["doc_id", "lo", "rest"])
            if has_text.true_count:
                yield from settle(iter([batch.filter(has_text)]))

    return settled


def open_windows(part: pa.RecordBatch, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, first window, last window, anchor and frequency flag of a batch's open anchors, as places in all its symbols."""
    (lo, rest), at = lists(part.column("open"))
    doc = np.repeat(np.arange(part.num_rows), np.diff(at))
    lo = lo + firsts[doc]
    hi, anchor = lo + (rest & 255), lo + (rest >> 8 & 255)
    fits = hi + length <= firsts[doc + 1]  # else a row with another text under the same id
    return tuple(x[fits] for x in (doc, lo, hi, anchor, rest >> 17 & 1 == 1))


def _contexts(setup: Setup):
    """Of each open anchor the text under its left and its right windows, under a key of the half that these share."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in slices(batches, 200):
            texts = unpacked(part.column("packed"))
            for i, j in chunks(np.r_[0, np.cumsum([len(t) for t in texts])]):
                yield read(part.slice(i, j - i), texts[i:j], held)
                if sum(len(x[0]) for x in held) >= HELD:
                    yield sent(held, setup.by_words)
                    held.clear()
        if held:
            yield sent(held, setup.by_words)

    def read(part: pa.RecordBatch, texts: list[bytes], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        buffer = b"".join(texts)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
        codes, firsts, starts, ends = symbols(np.frombuffer(buffer, np.uint8), offsets, setup.by_words)
        doc, lo, hi, anchor, many = open_windows(part, firsts, setup.length)
        ranges, other = Ranges(codes[0]), Ranges(codes[1], 1)
        more = setup.length - setup.gram - setup.half + 1
        left, right = lo <= anchor - setup.half, hi > anchor - setup.half
        a = np.r_[lo[left], np.maximum(lo, anchor - setup.half + 1)[right]]
        b = np.r_[np.minimum(hi, anchor - setup.half)[left], hi[right]]
        key = np.r_[
            mix(other.of(anchor[left] - setup.half, anchor[left] + setup.gram) + np.uint64(1)),
            mix(other.of(anchor[right], anchor[right] + setup.gram + more) + np.uint64(2)),
        ]
        d = np.r_[doc[left], doc[right]]
        ids = longs(part, "doc_id")[d]
        many = np.r_[many[left], many[right]]
        if many.any():
            count = (b - a + 1)[many]
            row, start = expanded(np.flatnonzero(many), a[many], count)
            held.append((mix(ranges.of(start, start + setup.length)), mix(other.of(start, start + setup.length)), ids[row], start - firsts[d[row]]))
            key, ids, d, a, b = (x[~many] for x in (key, ids, d, a, b))
        under = [buffer[s:e] for s, e in zip(starts[a].tolist(), ends[b + setup.length - 1].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), np.int64)), pa.array(ids), pa.array(a - firsts[d]), pa.array((b - a + 1).astype(np.int32)), pa.array(under, pa.binary())], names=["key", "mate", "doc_id", "lo", "windows", "text"])

    return contexts


def settled_by_context(texts: DataFrame, setup: Setup, settle: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """doc_id, lo, rest of the repeated windows of open anchors.

    texts: doc_id, packed, open.  settle gets batches of open contexts, whole groups of a key in order of doc_id and place, and gives doc_id, lo, rest.
    """
    contexts = texts.mapInArrow(_contexts(setup), _OPEN)
    return contexts.repartition("key").sortWithinPartitions("key", "mate", "doc_id", "lo").mapInArrow(_settled_windows(setup, settle), "doc_id long, lo long, rest int")


def repeated_windows(docs: DataFrame, setup: Setup, settled: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Texts with their repeated windows: doc_id, packed, runs (array of lo, rest: first window and number of further ones).

    docs: doc_id, text.  settled turns doc_id, packed, open (array of lo, rest: an open anchor's first window, and its further windows and place) into doc_id, lo, rest.
    """
    code = F.xxhash64(F.coalesce("text", F.lit("")))
    clash = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(code).alias("least"), F.max(code).alias("most")).filter("least <> most").select("doc_id", "least")
    clash, rest = written(clash, f"{name}-clash"), None
    if clash.limit(1).count():
        docs = docs.join(clash, "doc_id", "left")
        docs, rest = (docs.filter(c).select("doc_id", "text") for c in (F.col("least").isNull() | (code == F.col("least")), code != F.col("least")))
    first = docs.mapInArrow(_scan(setup), _FIRST).repartition("gram").sortWithinPartitions("gram", "context", "doc_id", "lo")
    found = written(first.mapInArrow(_compare(setup), "doc_id long, lo long, rest int"), name)
    opened = found.filter("rest >= 65536").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "rest")).alias("open"))
    texts = packed_texts(docs)
    more = settled(texts.join(opened.hint("shuffle_hash"), "doc_id"))
    runs = found.filter("rest < 65536").select("doc_id", "lo", F.col("rest").bitwiseAND(255).alias("rest")).unionByName(more)
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "rest")).alias("runs"))
    out = texts.join(runs.hint("shuffle_hash"), "doc_id", "left")
    return out if rest is None else out.unionByName(packed_texts(rest).withColumn("runs", F.lit(None).cast(dict(out.dtypes)["runs"])))


def spans(lo: np.ndarray, rest: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
    """The maximal stretches that runs of windows cover."""
    out: list[tuple[int, int]] = []
    order = np.argsort(lo, kind="stable")
    for a, b in zip(lo[order].tolist(), (lo + rest + length)[order].tolist(), strict=True):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def runs_of(flags: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged neighbours in a row: the row, the first place and the number of further ones."""
    at = np.flatnonzero(flags)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    last = np.r_[new[1:], len(at)] - 1
    return row[at[new]], place[at[new]], last - new
