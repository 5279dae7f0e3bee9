"""Exact n-gram Jaccard join by partition of the universe and the pigeonhole principle.

A document is its set of word shingles.  Sets are handled in size bands; in a
band a hash cuts the universe of shingles into `m` segments.  Two sets of
Jaccard similarity `threshold` or more differ in at most H shingles, H being
(1 - threshold) / (1 + threshold) of the sum of their sizes, so if segments with
H + 1 units between them are compared, one of these must be alike:

* the subset of a segment is one unit: it is alike if nothing in it differs;
* a subset with its one-deletion neighbourhood (the subset, and each subset with
  one shingle less) is two units: it is alike if at most one shingle differs.
  A subset of one shingle has one unit, an empty one none.

`allocation` picks for each band the number of segments that costs least.  Few
segments make few and selective signatures, but leave more sets *short*: with
fewer filled segments than the H + 1 that they need.

* All sets index their subsets.  If one of two sets isn't short, they share a
  subset: it has H + 1 of them, and at most H differ.
* Short sets index one-deletion neighbourhoods as well, to meet each other.
* Sets whose neighbourhoods still have too few units are *bare*; they index
  their shingles one by one as well, to meet each other.

Of its signatures of a kind a set may leave out those beyond the number that it
needs, if all sets leave them out in one order: the least signature that two
sets share then stays in both.  The order is by how many sets hold a signature
(counted over all of them), so common lines are left out first and nearly every
signature that stays is rare.  Sets of a band join each other, and those of the
next band that are small enough.

Equal sets are represented by their least document.  Groups of equal signatures
with the same members are handled once.  In every group the first document is
compared with all others; linked documents are merged into components.  Groups
that then still hold several components give their remaining pairs, if there
are at most `SMALL` documents; larger ones are dealt out in blocks, in which
overlaps are counted in place and only links that join components come out.
Every link is verified on the words of its two texts, so none is wrong, no link
between different components is lost, and no group is expanded into its pairs.

Defined results: a null text or one without words has an empty set and is its
own component; a text with fewer words than a shingle has one shingle, the
whole sequence; rows that share an id are one document and give one row (if
their texts differ, the set of least size, then least fingerprint, counts); each
row without an id gives a row, linked with nothing, its component null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweave.llm._store import forget, written
from tempoweave.llm._text import FOLD, chunks, column_bytes, longs, mix, slices, word_codes, words
from tempoweave.llm.components import connected
from tempoweave.llm.passages import packed_texts, unpacked, whole_groups

WIDTH = 5
SIMILAR = (75, 100)
#: Documents of a group that are compared pair by pair.
SMALL = 32
#: Documents of a larger group that meet in one task.
BLOCK = 1024
#: The share of a usual text that unrelated texts hold as well (only `allocation` uses it, to price segments).
COMMON = 0.25
#: Kinds of signatures; a set visiting the next smaller band has three kinds of its own.
SUBSETS, NEIGHBOURS, SINGLES = range(3)


@dataclass(frozen=True)
class Band:
    """Sets of 2**number <= size < high, in so many segments."""

    number: int
    segments: int

    @property
    def high(self) -> int:
        return 2 << self.number


def _short(size: int, segments: int, need: int) -> float:
    """The share of sets of a size that fill fewer segments than they need (normal approximation)."""
    empty = math.exp(-size / segments)
    mean, spread = segments * (1 - empty), math.sqrt(max(1e-9, segments * (empty - (1 + size / segments) * empty**2)))
    return 0.5 * math.erfc((mean + 0.5 - need) / (spread * math.sqrt(2)))


@lru_cache
def allocation(number: int) -> Band:
    """The number of segments of least cost: subsets, the neighbourhoods of the sets that would be short, and candidates that come of it if too few subsets can be left out to leave out the common ones."""
    high = 2 << number
    sizes = sorted({max(1, round(high / 2 * (1 + k / 8))) for k in range(8)} | {high - 1})
    best = (math.inf, high)
    for load in (0.5, 0.7, 0.9, 1.1, 1.3, 1.5, 1.7, 1.9, 2.1, 2.3, 2.5):
        m = max(1, round(high / load))
        cost = 0.0
        for n in sizes:
            need, filled = n // 3 + 1, m * (1 - math.exp(-n / m))
            short = _short(n, m, need)
            spare = max(0.0, 1 - need / max(filled, 1e-9))
            cost += filled + short * 4 * (m + n) + need * 8 * max(0.0, COMMON - spare)
        best = min(best, (cost, m))
    return Band(number, best[1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and two independent fingerprints of each distinct shingle, in order of document and first fingerprint."""
    data = FOLD[data]
    starts, ends, firsts = words(data, offsets)
    counts = np.diff(firsts)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    both = []
    for base in range(2):
        codes = word_codes(data, starts, ends, base)
        full, less = np.full(len(whole), width, np.uint64), counts[short].astype(np.uint64)
        for k in range(width):
            full = mix(full * np.uint64(0x9E3779B97F4A7C15) + codes[whole + k])
            there = counts[short] > k
            less[there] = mix(less[there] * np.uint64(0x9E3779B97F4A7C15) + codes[firsts[short[there]] + k])
        both.append(np.r_[full, less])
    d, (h, g) = np.r_[doc[whole], short], both
    order = np.lexsort((h, d))
    d, h, g = d[order], h[order], g[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
    return d[new], h[new], g[new]


def _need(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Units that decide for sets of these sizes: one more than they may differ in."""
    a, b = SIMILAR
    return (size + other) * (b - a) // (a + b) + 1


def signatures(shingle: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slot (kind, and 3 more for visitors), set and signature; and the sets of this slot, with the number of signatures that each may leave out."""
    a, b = SIMILAR
    first = np.r_[0, np.cumsum(sizes)]
    own = np.frexp(np.maximum(sizes, 1))[1] - 1
    for number in np.unique(np.r_[own[sizes > 0], np.maximum(own[sizes > 1] - 1, 0)]).tolist():
        band = allocation(number)
        home = (own == number) & (sizes > 0)
        visit = (own == number + 1) & (sizes * a <= (band.high - 1) * b)
        for visiting, who in ((0, np.flatnonzero(home)), (3, np.flatnonzero(visit))):
            if not len(who):
                continue
            size = sizes[who]
            need = _need(size, np.full(len(who), band.high - 1) if visiting else size * b // a)
            index = np.repeat(first[who] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            d, h = np.repeat(np.arange(len(who)), size), shingle[index]
            salt = mix(np.array([number * 4 + 1], np.uint64))[0]
            segment = mix(h ^ salt) % np.uint64(band.segments)
            order = np.lexsort((segment, d))
            d, h, segment = d[order], h[order], segment[order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (segment[1:] != segment[:-1])])
            count = np.diff(np.r_[new, len(d)])
            total = np.add.reduceat(mix(h + salt), new)
            tag = mix(segment[new] + salt)
            holder = d[new]
            filled = np.bincount(holder, minlength=len(who))
            yield visiting + SUBSETS, who[holder], mix(total ^ tag), who, np.maximum(filled - need, 0)
            short = filled < need
            if not short.any():
                continue
            each = np.repeat(np.arange(len(new)), count)
            kept, less = short[holder], short[d] & (count > 1)[each]
            own_ = mix(mix(total[kept] ^ tag[kept]) + np.uint64(1))
            one_less = mix(mix((total[each[less]] - mix(h[less] + salt)) ^ tag[each[less]]) + np.uint64(1))
            yield visiting + NEIGHBOURS, who[np.r_[holder[kept], d[less]]], np.r_[own_, one_less], who[short], np.zeros(short.sum(), np.int64)
            bare = np.bincount(holder, np.minimum(count, 2), len(who)).astype(np.int64) < need
            if bare.any():
                at = bare[d]
                yield visiting + SINGLES, who[d[at]], mix(h[at] + salt + np.uint64(2)), who[bare], (size - need)[bare]


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Ids, document numbers, shingles, sizes and two fingerprints of each set."""
    for batch in slices(batches):
        data, offsets = column_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in chunks(offsets):
            doc, shingle, other = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = np.bincount(doc, minlength=j - i)
            sums = [np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)]
            if len(doc):
                new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                for k, x in enumerate((shingle, other)):
                    sums[k][doc[new]] = np.add.reduceat(mix(x), new)
            yield ids.slice(i, j - i), doc, shingle, sizes, sums


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, fingerprints, and for each slot the signatures that the set may leave out."""
    for ids, _, shingle, sizes, sums in _chunks(batches):
        spare = np.zeros((len(ids), 6), np.int32)
        for slot, _, _, who, more in signatures(shingle, sizes):
            spare[who, slot] = more
        spare = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * len(ids) + 1, 6, dtype=np.int32)), pa.array(spare.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), spare], names=["doc_id", "n", "f", "g", "spare"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        for ids, doc, shingle, sizes, sums in _chunks(iter([batch])):
            # equal sets of a task are indexed once
            live = sizes > 0
            for k, key in enumerate(zip(sums[0].tolist(), sums[1].tolist(), strict=True)):
                if live[k] and key in seen:
                    live[k] = False
                elif len(seen) < 1_000_000:
                    seen.add(key)
            ids = ids.to_numpy()
            for slot, who, signature, _, _ in signatures(shingle[live[doc]], np.where(live, sizes, 0)):
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(ids[who]), pa.array(np.full(len(who), slot, np.int8))], names=["signature", "doc_id", "slot"])


def _exact_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles, numbered by their words."""
    found = [t.translate(FOLD.tobytes()).split() for t in texts]
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for t in found for w in t), np.int64) + 1
    counts = np.array([len(t) for t in found])
    firsts = np.r_[0, np.cumsum(counts)]
    padded = np.r_[codes, np.zeros(width, np.int64)]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(codes))
    at = at[(at + width <= firsts[doc + 1]) | (at == firsts[doc])]
    name = np.zeros(len(at), np.int64)
    for k in range(width):  # names of one word more, until the whole shingle has one
        word = np.where(at + k < firsts[doc[at] + 1], padded[at + k], 0)
        name = np.unique(name << np.int64(32) | word, return_inverse=True)[1]
    pairs = np.unique(doc[at] << np.int64(32) | name)
    return np.split(pairs & np.int64(0xFFFFFFFF), np.searchsorted(pairs >> np.int64(32), np.arange(1, len(counts))))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, full = SIMILAR
    for batch in slices(batches, 200):
        # texts that pairs of a batch have in common are read once
        left, right = longs(batch, "a"), longs(batch, "b")
        linked = np.zeros(batch.num_rows, bool)
        sizes = np.cumsum([0, *pc.add(pc.binary_length(batch.column("left")), pc.binary_length(batch.column("right"))).to_pylist()])
        for i, j in chunks(sizes, 1 << 17):
            ids, first, each = np.unique(np.r_[left[i:j], right[i:j]], return_index=True, return_inverse=True)
            n = j - i
            sets = _exact_sets([unpacked(batch.column("left" if k < n else "right").slice(i + k % n, 1))[0] for k in first.tolist()])
            for k in range(n):
                x, y = sets[each[k]], sets[each[n + k]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i + k] = common > 0 and full * common >= low * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def _folded(shingle: np.ndarray, salt: int) -> np.ndarray:
    return np.unique((mix(shingle + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32))


def _folds(salt: int):
    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of each text as sorted 32-bit numbers, and how many of them those stand for."""
        for batch in slices(batches):
            texts = unpacked(batch.column("packed"))
            for i, j in chunks(np.cumsum([0, *map(len, texts)])):
                doc, shingle, _ = shingle_sets(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([0, *map(len, texts[i:j])]))
                sets = np.split(shingle, np.searchsorted(doc, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array([_folded(x, salt).tobytes() for x in sets], pa.binary())], names=["doc_id", "n", "folds"])

    return folds


def _joins(ids: np.ndarray, component: np.ndarray, size: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links by folded shingles that join the components of a block; overlaps are counted as products of 0/1 matrices."""
    low, full = SIMILAR
    n = len(ids)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    column = place[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):
        i, j = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((n, min(4096, len(shared) - at)), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        common += part @ part.T
    lost = size - np.array([len(x) for x in sets])  # shingles that share a number with another one of their set
    common = np.minimum(common + np.minimum(lost[:, None], lost[None]), np.minimum(size[:, None], size[None]))
    near = (full * common >= low * (size[:, None] + size[None] - common)) & (component[:, None] < component[None])
    out, root = [], {int(c): int(c) for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        x, y = top(int(component[i])), top(int(component[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, "block"):
        key, doc, component, size = (longs(batch, n) for n in ("block", "doc_id", "component", "n"))
        starts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        out: list[tuple[int, int]] = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("folds").slice(a, b - a)]
            out += _joins(doc[a:b], component[a:b], size[a:b], sets)
        yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose set has the wanted fingerprint, or that want none."""
    for batch in slices(batches):
        prints = np.concatenate([sums[0] for *_, sums in _chunks(iter([batch]))]).view(np.int64)
        fits = pc.fill_null(pc.equal(batch.column("f"), pa.array(prints)), True)
        yield batch.filter(fits).select(["doc_id", "text"])


def _one_set_each(texts: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One set for each id, and the texts that have it. Texts are only joined if some id has different ones."""
    least = every.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "f", "g", "spare")).alias("kept"), F.max(F.struct("n", "f", "g", "spare")).alias("other"))
    clash = least.filter("kept <> other").select("doc_id", "kept.f")
    if clash.limit(1).count():
        texts = texts.join(clash, "doc_id", "left").select("doc_id", "text", "f").mapInArrow(_with_set, "doc_id long, text string")
    return texts, written(least.select("doc_id", "kept.*"), "jaccard-documents")


_PAIRS = """filter(flatten(transform(docs, (x, i) -> transform(slice(docs, i + 2, size(docs)),
    y -> struct(x.doc_id AS a, y.doc_id AS b, x.component <> y.component AS apart)))), z -> z.apart)"""


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = written(texts.mapInArrow(_profile, "doc_id long, n long, f long, g long, spare array<int>"), "jaccard-sets")
    texts, sets = _one_set_each(texts, every)

    # equal sets, by two independent fingerprints of every shingle
    copies = sets.filter("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    classes = written(copies, "jaccard-classes")
    copied = written(sets.filter("n > 0").join(classes, ["n", "f", "g"]).filter("doc_id <> rep").select("doc_id", "rep"), "jaccard-copies")

    def represented(df: DataFrame) -> DataFrame:
        return df.join(copied, "doc_id", "left").withColumn("doc_id", F.coalesce("rep", "doc_id")).drop("rep")

    # signatures that several documents hold, rarest first, without those that a document may leave out
    indexed = texts.mapInArrow(_index, "signature long, doc_id long, slot byte").repartition("signature")
    several = indexed.withColumn("held", F.count(F.lit(1)).over(W.partitionBy("signature"))).filter("held > 1")
    spare = sets.select("doc_id", F.posexplode("spare").alias("slot", "spare")).filter("spare > 0").select("doc_id", F.col("slot").cast("byte").alias("slot"), "spare")
    common_first = W.partitionBy("doc_id", "slot").orderBy(F.desc("held"), F.desc("signature"))
    chosen = several.withColumn("place", F.row_number().over(common_first)).join(spare, ["doc_id", "slot"], "left").filter("place > coalesce(spare, 0)")
    keys = written(represented(chosen.select("signature", "doc_id")).distinct(), "jaccard-keys")
    groups = keys.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), *(F.sum(F.xxhash64("doc_id", F.lit(k)).cast("decimal(38,0)")).alias(f"print{k}") for k in range(2))).filter("size > 1")
    groups = groups.groupBy("size", "first", "print0", "print1").agg(F.min("signature").alias("signature")).select("signature", "first", "size")
    members = written(keys.join(groups, "signature"), "jaccard-groups")
    near = written(members.select("doc_id").distinct(), "jaccard-near")
    forget(classes, keys)
    packed = written(packed_texts(texts).join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "jaccard-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = pairs.join(packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("left")), "a")
        both = left.join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("right")), "b")
        return written(both.select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long, linked boolean"), name)

    def open_groups(merged: DataFrame) -> DataFrame:
        """Members of groups that still hold several components."""
        placed = members.join(merged.select(F.col("a").alias("doc_id"), F.col("b").alias("component")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        still = placed.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("signature")
        return placed.join(still, "signature")

    stars = verified(members.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "jaccard-stars")
    merged = connected(stars.filter("linked").select("a", "b"), "jaccard-components")

    def with_links(checked: DataFrame) -> DataFrame:
        return connected(merged.unionByName(checked.filter("linked").select("a", "b")), "jaccard-components")

    few = open_groups(merged).filter(F.col("size") <= SMALL).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("doc_id", "component"))).alias("docs"))
    pairs = few.select(F.inline(F.expr(_PAIRS))).select("a", "b").distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    pairs = written(pairs, "jaccard-pairs")
    if pairs.limit(1).count():
        merged = with_links(verified(pairs, "jaccard-more"))

    for salt in range(1, 1000):  # once more only if 32-bit numbers made a link up
        large = written(open_groups(merged).filter(F.col("size") > SMALL).select("signature", "doc_id", "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "jaccard-large")
        if not large.limit(1).count():
            break
        folds = packed.join(large.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_folds(salt), "doc_id long, n long, folds binary")
        block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        dealt = large.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select(F.xxhash64("signature", F.least("block", "other"), F.greatest("block", "other")).alias("block"), "doc_id", "component").join(folds, "doc_id")
        found = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks, "a long, b long").distinct()
        found = verified(written(found, "jaccard-joins"), "jaccard-joined")
        merged = with_links(found)
        if not found.filter("NOT linked").limit(1).count():
            break

    forget(near, members, packed, stars, pairs, large)
    out = represented(sets.select("doc_id", F.col("doc_id").alias("own"), "n")).join(merged.select(F.col("a").alias("doc_id"), F.col("b").alias("component")), "doc_id", "left")
    out = out.select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(every.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
