"""Exact word-passage removal with suffix automata.

Every word is removed that lies in a window of `length` words whose sequence
also starts in a document with a smaller id; all is judged on the input.

Reference shards are what passages.py leaves open: contexts (at most
2 * length words) of different documents that share a gram and half a context.
Contexts that are equal as a whole are settled before by their fingerprints;
one of each is the reference of the others.  A shard is keyed by that shared
stretch, so it holds every place where a window with it can occur, and is
streamed in order of documents: each context runs through the automaton of the
earlier documents' contexts, and its matching statistics (the longest suffix
that the automaton holds, word by word) mark the windows at or above `length`;
then it is added, unless the automaton has it already.  A gram of more than
`most` open contexts has no automaton: its windows are compared by two
fingerprints each, dealt over all tasks (passages.py).

Sending the automata of the whole corpus to every task would make the work grow
with the square of the corpus, so shards travel to their key instead.

Defined results: a null or empty text has no words and keeps the empty string;
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

from tempoweave.llm._text import arrow_batch, longs
from tempoweave.llm.passages import Setup, lists, repeated_windows, runs_of, settled_by_context, spans, unpacked, whole_groups


class SuffixAutomaton:
    """Of a set of sequences, built one by one."""

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _copy(self, state: int, source: int, symbol) -> int:
        """A state for the sequences of `state` that go on from `source` (and shorter ones)."""
        new = len(self.moves)
        self.moves.append(dict(self.moves[state]))
        self.link.append(self.link[state])
        self.size.append(self.size[source] + 1)
        self.link[state] = new
        while source >= 0 and self.moves[source].get(symbol) == state:
            self.moves[source][symbol] = new
            source = self.link[source]
        return new

    def _extend(self, last: int, symbol) -> int:
        moves, link, size = self.moves, self.link, self.size
        held = moves[last].get(symbol)
        if held is not None:
            return held if size[held] == size[last] + 1 else self._copy(held, last, symbol)
        new = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            held = moves[at][symbol]
            link[new] = held if size[held] == size[at] + 1 else self._copy(held, at, symbol)
        return new

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def matching(self, sequence: list) -> list[int]:
        """For each place the length of the longest sequence ending there that the automaton holds."""
        moves, link, size = self.moves, self.link, self.size
        state, length, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                length = size[state]
            to = moves[state].get(symbol)
            if to is None:
                state, length = 0, 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out


def _settle(length: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            key, doc, lo = (longs(batch, n) for n in ("key", "doc_id", "lo"))
            starts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            flags, row, place = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if doc[a] == doc[b - 1]:
                    continue
                automaton, waiting = SuffixAutomaton(), []
                for k in range(a, b):
                    if waiting and doc[k] != doc[k - 1]:
                        for sequence in waiting:
                            automaton.add(sequence)
                        waiting = []
                    sequence = batch.column("text")[k].as_py().split()
                    if len(automaton.moves) > 1:
                        late = [m >= length for m in automaton.matching(sequence)[length - 1 :]]
                        flags += late
                        row += [k] * len(late)
                        place += range(int(lo[k]), int(lo[k]) + len(late))
                        if all(late):
                            continue
                    waiting.append(sequence)
            at, first, more = runs_of(np.array(flags, bool), np.array(row, np.int64), np.array(place, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(first), pa.array(more.astype(np.int32))], names=["doc_id", "lo", "rest"])

    return settle


def repeated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, most: int = 1 << 13) -> DataFrame:
    """Per document: doc_id, packed (its compressed text), runs (see passages.repeated_windows)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    setup = Setup(length, gram, True, most)
    return repeated_windows(texts, setup, lambda opened: settled_by_context(opened, setup, _settle(length)), "word-passages")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeated_words(docs: DataFrame, *, length: int = 50, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpacked(batch.column("packed"))
            (lo, rest), at = lists(batch.column("runs"))
            rows = []
            for k, text in enumerate(texts):
                found = text.split()
                cut = spans(lo[at[k] : at[k + 1]], rest[at[k] : at[k + 1]].astype(np.int64), length, len(found))
                kept, end = [], 0
                for a, b in cut:
                    kept += found[end:a]
                    end = b
                kept += found[end:]
                rows.append((len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), *(zip(*rows, strict=True) if rows else ([],) * 3))

    return repeated_words(docs, length=length, **options).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
