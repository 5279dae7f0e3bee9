"""Exact substring removal by fingerprints of sampled positions, in place of prefix doubling.

Every byte is removed that lies in a string of `length` bytes which also starts
earlier (in a document with a smaller id, or further up in the same document);
overlapping occurrences count, and all is judged on the input.

A rank is a fingerprint of the text that follows (or surrounds) a position.
Spark sorts positions by rank at growing lengths, and those with a rank of
their own leave; ranks come from fingerprints, not from the sort:

1. ranks of `gram` bytes at sampled positions (see passages.py);
2. pairs of that rank and the rank of the whole context, beyond `length`
   bytes: equal pairs repeat each other for certain;
3. for the positions left, pairs of the rank and of half the context; unique
   ones leave, and the ranks at `length` bytes decide window by window.

Prefix doubling proper, with pairs ranked anew by each sort, was built for the
positions that the first two sorts leave open, and needs more disk than the
check tool allows (README).

Defined results: a null or empty text has no bytes and keeps the empty string;
rows that share an id are one document, each row gets its spans (if their texts
differ, the text of the least hash is the document's and the others stay whole);
rows without an id are never compared; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._text import Ranges, arrow_batch, column_bytes, longs, mix
from tempoweave.llm.passages import Setup, lists, repeated_windows, repeats, runs_of, settled_by_context, spans, unpacked, whole_groups


def _settle(length: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            key = longs(batch, "key")
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            batch = batch.filter(pa.array(np.bincount(group)[group] > 1))
            if not batch.num_rows:
                continue
            key, doc, lo, count = (longs(batch, n) for n in ("key", "doc_id", "lo", "windows"))
            data, offsets = column_bytes(batch.column("text").cast(pa.large_binary()).view(pa.large_string()))
            count = count.astype(np.int64)
            row = np.repeat(np.arange(len(key)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + nth
            rank = mix(Ranges(data).of(start, start + length))
            place = lo[row] + nth
            order = np.lexsort((place, doc[row], rank, key[row]))
            k, r = key[row][order], rank[order]
            late = np.zeros(len(row), bool)
            late[order[repeats(k, r, doc[row][order], place[order], False)]] = True
            at, first, more = runs_of(late, row, place)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(first), pa.array(more.astype(np.int32))], names=["doc_id", "lo", "rest"])

    return settle


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, most: int = 1 << 16) -> DataFrame:
    """Per document: doc_id, packed (its compressed text), runs (see passages.repeated_windows)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    setup = Setup(length, gram, False, most)
    return repeated_windows(texts, setup, lambda opened: settled_by_context(opened, setup, _settle(length)), "byte-passages")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeated_bytes(docs: DataFrame, *, length: int = 100, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpacked(batch.column("packed"))
            (lo, rest), at = lists(batch.column("runs"))
            rows = []
            for k, text in enumerate(texts):
                cut = spans(lo[at[k] : at[k + 1]], rest[at[k] : at[k + 1]].astype(np.int64), length, len(text))
                sha, end = hashlib.sha256(), 0
                for a, b in cut:
                    sha.update(text[end:a])
                    end = b
                sha.update(text[end:])
                rows.append((len(text), sum(b - a for a, b in cut), len(cut), sha.hexdigest()))
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), *(zip(*rows, strict=True) if rows else ([],) * 4))

    return repeated_bytes(docs, length=length, **options).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
