"""Language identification by a byte convolutional network, trained in numpy.

Windows of `WINDOW` bytes go through a byte embedding, filters of widths 2, 3
and 4, a rectifier, the maximum over the window, and a softmax over the
languages.  A whole text is cut into such windows (the last one padded); its
probabilities are the means over its windows, weighted by their bytes.

The network is fitted on the driver from a bounded sample: all windows of at
most `sample` labelled training documents, those with the least hash of their
id (rows without an id last), each document as likely as any other in a step.
Prediction is one pass over the texts in batches; the first layer is applied as
table lookups of byte pairs, which gives the same sums.

Defined results: a null text, or one without a letter, is `und` with score 0,
as is every text if no training document has a language; of languages with
equal probabilities the first by code point is predicted; repeated rows each get
a row; a null id is a training row and not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import least_hashed
from tempoweave.llm._text import arrow_batch, chunks, column_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
DEPTH = 8
FILTERS = 8


class ByteNetwork:
    """Embedding (256 x DEPTH), filters by width (width * DEPTH x FILTERS), output (widths * FILTERS x languages)."""

    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.3, (256, DEPTH)), "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * DEPTH), (w * DEPTH, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["e"][0] = 0

    def fit(self, windows: np.ndarray, doc: np.ndarray, labels: np.ndarray, rounds: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNetwork:
        """Adam over batches of random windows of random documents; doc: each window's document, in order; labels: by document."""
        rng = np.random.default_rng(seed)
        docs, firsts, counts = np.unique(doc, return_index=True, return_counts=True)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            k = rng.integers(0, len(docs), min(batch, len(windows)))
            pick = firsts[k] + (rng.random(len(k)) * counts[k]).astype(np.int64)
            grads = self._gradients(windows[pick], labels[docs[k]])
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.p["e"][0] = 0
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        kept, pooled = {}, []
        for w in WIDTHS:
            view = np.concatenate([e[:, o : WINDOW - w + 1 + o] for o in range(w)], 2)
            z = view @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            kept[w] = (view, at, top > 0)
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, 1)
        s = h @ p["out"] + p["bias"]
        s = np.exp(s - s.max(1, keepdims=True))
        d = s / s.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = d @ p["out"].T
        rows = np.arange(n)
        for k, w in enumerate(WIDTHS):
            view, at, on = kept[w]
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"b{w}"] = dz.sum(0)
            gw = np.zeros_like(p[f"w{w}"])
            for f in range(FILTERS):
                seen = view[rows, at[:, f]]
                gw[:, f] = seen.T @ dz[:, f]
                back = (dz[:, f, None] * p[f"w{w}"][None, :, f]).reshape(n, w, DEPTH)
                for o in range(w):
                    np.add.at(g["e"], x[rows, at[:, f] + o], back[:, o])
            g[f"w{w}"] = gw
        return g

    def tables(self) -> ByteNetwork:
        """Sets up the first layer as lookups by byte and byte pair."""
        p = self.p
        one = lambda w, o: (p["e"] @ p[f"w{w}"][o * DEPTH : (o + 1) * DEPTH]).astype(np.float32)
        two = lambda w, o: (one(w, o)[:, None] + one(w, o + 1)[None]).reshape(65536, FILTERS)
        self.lookups = {2: [(0, two(2, 0))], 3: [(0, two(3, 0)), (2, one(3, 2))], 4: [(0, two(4, 0)), (2, two(4, 2))]}
        return self

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.languages)))
        for at in range(0, len(windows), 256):
            x = windows[at : at + 256].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, parts in self.lookups.items():
                z = None
                for o, table in parts:
                    index = (pairs if len(table) == 65536 else x)[:, o : WINDOW - w + 1 + o]
                    got = np.take(table, index, axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
            s = np.concatenate(pooled, 1) @ self.p["out"] + self.p["bias"]
            s = np.exp(s - s.max(1, keepdims=True))
            out[at : at + 256] = s / s.sum(1, keepdims=True)
        return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts, padded with 0, with each one's text and number of bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[doc] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[doc + 1] - start) if len(doc) else np.zeros(0, np.int64)
    if not len(doc):
        return np.zeros((0, WINDOW), np.uint8), doc, length
    index = start[:, None] + np.arange(WINDOW)
    windows = data[np.minimum(index, len(data) - 1)]
    windows[np.arange(WINDOW)[None] >= length[:, None]] = 0
    return windows, doc, length


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def train_language_model(docs: DataFrame, *, sample: int = 3000) -> ByteNetwork | None:
    """Fits on rows of doc_id, text, lang: on all windows of the sampled texts that have a letter."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "doc_id")
    rows = sorted(least_hashed(rows, "doc_id", sample).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))
    rows = [r for r in rows if any(c.isalpha() for c in r["text"])]
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    texts = [r["text"].encode() for r in rows]
    windows, doc, _ = cut(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    return ByteNetwork(languages).fit(windows, doc, np.array([languages.index(r["lang"]) for r in rows])).tables()


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), held)
    model = train_language_model(known.filter(~F.col("held_out")), sample=sample)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data, offsets = column_bytes(batch.column("text"))
            names, scores = ["und"] * n, np.zeros(n)
            for i, j in chunks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters = np.r_[0, np.cumsum(_LETTER[part])]
                sure = letters[at[1:]] > letters[at[:-1]]
                sums = np.zeros((j - i, len(model.languages) if model else 1))
                if model:
                    for a in range(0, len(part), 1 << 22):
                        b = min(len(part), a + (1 << 22))  # a longer text in blocks of whole windows
                        here = np.clip(at, a, b) - a if len(part) > 1 << 22 else at
                        windows, doc, length = cut(part[a:b] if len(part) > 1 << 22 else part, here)
                        np.add.at(sums, doc, model.probabilities(windows) * length[:, None])
                        if len(part) <= 1 << 22:
                            break
                    for d in range(j - i):
                        if sure[d] or any(c.isalpha() for c in bytes(part[at[d] : at[d + 1]]).decode()):
                            best = int(sums[d].argmax())
                            names[i + d], scores[i + d] = model.languages[best], min(1.0, sums[d, best] / (at[d + 1] - at[d]))
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), batch.column("held_out"), names, scores)

    return known.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
