"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over `buckets` hashed word unigrams and bigrams are counted:
one over the trusted target (labelled good and not toxic), one over every
document.  A document's score is the mean, over its n-grams, of
log P(bucket | target) - log P(bucket | corpus); it is kept at `threshold` or
above if the fixed rules do not reject it.

Only DataFrame functions are used.  Counting ends in `buckets` rows (a fixed
number) that the driver turns into one literal array, so scoring is a
projection without joins.  The trusted target is a sample of at most `trusted`
labelled documents, those with the least hash of their id, which bounds the
broadcast list of their ids; the corpus counts cover all documents.

Defined results: a null or empty text has no words and fails the fixed rules;
repeated rows and rows without an id each get a row; without any trusted label every score is 0; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import least_hashed

BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _codes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _from(array: Column, k: int) -> Column:
    """The array from its k-th element on."""
    return F.slice(array, F.lit(k), F.greatest(F.size(array), F.lit(1)))


def _pairs(codes: Column) -> Column:
    """One code for each two neighbours."""
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), _from(codes, 2), lambda a, b: F.xxhash64(a, b))


def _once(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """The columns in `keep`, and new ones that later expressions may use many times but that are computed once for each row (a generator is not merged with a projection)."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def gram_weights(docs: DataFrame, labels: DataFrame, *, buckets: int = 8192, trusted: int = 20_000, smoothing: float = 1.0) -> list[float]:
    """The log-likelihood ratio of each bucket, from counts over every document and over the trusted ones."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = least_hashed(good, "doc_id", trusted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    flagged = texts.join(F.broadcast(good.withColumn("target", F.lit(1))), "doc_id", "left").select("text", "target")
    read = _once(flagged, ["target"], codes=_codes(_words(F.col("text"))))
    grams = read.select("target", F.explode(F.concat(F.col("codes"), _pairs(F.col("codes")))).alias("code"))
    counts = grams.groupBy(F.pmod(F.col("code"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("good")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["good"]
    if not sum(target):
        return [0.0] * buckets
    all_raw, all_good = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [math.log((g + smoothing) / all_good) - math.log((r + smoothing) / all_raw) for g, r in zip(target, raw, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, *, threshold: float = -0.06, buckets: int = 8192, trusted: int = 20_000, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score; with carry also `row`, a struct of all columns of docs."""
    # one literal, folded once, instead of an expression for each element
    weights = F.from_json(F.lit(str(gram_weights(docs, labels, buckets=buckets, trusted=trusted))), "array<double>")
    row = ["row"] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.struct("*").alias(c) for c in row))
    codes, pairs, triples, words = F.col("codes"), F.col("pairs"), F.col("triples"), F.col("words")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", *row]
    read = _once(texts, ["doc_id", "text", *row], words=_words(F.col("text")))
    read = _once(read, ["doc_id", *counts, *row], codes=_codes(words))
    read = _once(read, [*names, "codes"], pairs=_pairs(codes))
    weigh = lambda array: F.aggregate(array, F.lit(0.0), lambda s, h: s + F.get(weights, F.pmod(h, F.lit(buckets)).cast("int")))
    score = (weigh(codes) + weigh(pairs)) / F.greatest(F.lit(1), 2 * F.col("n_words") - 1)
    read = _once(read, [*names, score.alias("score")], triples=F.zip_with(F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))), _from(codes, 3), lambda a, b: F.xxhash64(a, b)))
    # only a text that has some window twice is sorted
    order = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    read = _once(read, [*names, "score"], windows=F.when(F.size(F.array_distinct(triples)) < F.size(triples), order).otherwise(none))
    twice = F.flatten(F.filter(F.zip_with(F.col("windows"), _from(F.col("windows"), 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))), lambda x: x.isNotNull()))
    read = _once(read, [*names, "score"], at=F.sort_array(F.array_distinct(twice)))
    # each repeated window covers three words, less those of the next one
    covered = F.aggregate(F.zip_with(F.col("at"), _from(F.col("at"), 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    out = read.select(*names, covered.cast("long").alias("n_repeat_words"), "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score", *row)
