"""URL verdicts by rules, and by a Bloom filter cascade over hosts.

Rules of (host, path) fit a host and its subdomains where the path starts with
the rule's; the longest fitting rule decides.  Pages without a rule are judged
by their host: a host is listed if a rule blocks any of its pages.

Membership in that list is answered without a join, by a cascade.  Level 1 is
a Bloom filter of the listed hosts; level 2 encodes the unlisted hosts that
level 1 lets through, level 3 the listed ones that level 2 lets through, and so
on until a level lets nothing wrong through.  As the levels are built against
every host of the corpus, the answer is exact for each of them: the first
level that does not hold a host decides by its parity.

Levels are built by the executors (words of bits, or-ed by word) and only their
bits reach the driver.  What is sent out at once stays within `shard_bytes`:
more hosts are parted by their hash into shards, each with a cascade of its own,
and the pages pass one shard's cascade after the other.

Defined results: a null url, or one without `://`, has an empty host and path,
no rule and the empty host's verdict; repeated pages and
pages without an id each get a row; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoweave.llm._store import written
from tempoweave.llm._text import longs

#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4
BITS_PER_KEY = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Cascade:
    """Bloom filters by level, each as 64-bit words."""

    def __init__(self, levels: list[np.ndarray] | None = None) -> None:
        self.levels = levels or []

    @staticmethod
    def places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
        steps = np.arange(level * HASHES, (level + 1) * HASHES, dtype=np.uint64)
        h = a[:, None] + steps[None, :] * (b[:, None] | np.uint64(1))
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> np.uint64(33))) % np.uint64(bits)

    def _holds(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        words = self.levels[level]
        at = self.places(a, b, level, len(words) * 64)
        return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for level in range(len(self.levels)):
            ok[ok] = self._holds(level, a[ok], b[ok])
        return ok

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built against."""
        out = np.full(len(a), len(self.levels) % 2 == 1)
        left = np.arange(len(a))
        for level in range(len(self.levels)):
            held = self._holds(level, a[left], b[left])
            out[left[~held]] = level % 2 == 1
            left = left[held]
        return out


def _keys(host: Column) -> tuple[Column, Column]:
    return F.xxhash64(host).alias("a"), F.xxhash64(host, F.lit("second")).alias("b")


def build_cascade(universe: DataFrame, *, max_levels: int = 60) -> Cascade:
    """The cascade of a table (a, b: two hashes of a key; listed: boolean) with a row for every key."""
    cascade = Cascade()
    for level in range(max_levels):
        now = Cascade(list(cascade.levels))
        side = universe.filter(F.col("listed") if level % 2 == 0 else ~F.col("listed")).select("a", "b")

        def left(batches: Iterator[pa.RecordBatch], now: Cascade = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = longs(batch, "a").view(np.uint64), longs(batch, "b").view(np.uint64)
                yield batch.filter(pa.array(now.passes(a, b)))

        keys = side.mapInArrow(left, "a long, b long") if level else side
        count = keys.count()
        if not count:
            return cascade
        size = max(64, -(-count * BITS_PER_KEY // 64) * 64)

        def marks(batches: Iterator[pa.RecordBatch], level: int = level, size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = Cascade.places(longs(batch, "a").view(np.uint64), longs(batch, "b").view(np.uint64), level, size).ravel()
                at = np.unique(at)
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        words = np.zeros(size // 64, np.uint64)
        held = keys.mapInArrow(marks, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
        words[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
        cascade.levels.append(words)
    raise ValueError("two keys of different classes have the same hashes")


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, shard_bytes: int = 16 << 20) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block)."""
    host, path = split_url(F.col("url"))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    read = read.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    universe = written(read.groupBy("host").agg(F.max(F.coalesce(F.col("fits.verdict") == "block", F.lit(False))).alias("listed")).select("host", *_keys(F.col("host")), "listed"), "url-hosts")
    # all levels of a shard have fewer than twice the bits of a filter of all its hosts
    shards = max(1, -(-universe.count() * BITS_PER_KEY // 4 // shard_bytes))
    asked = read.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.col("fits.verdict").alias("ruled"), *_keys(F.col("host")), F.lit(None).cast("boolean").alias("listed"))
    for shard in range(shards):
        cascade = build_cascade(universe.filter(F.pmod("b", F.lit(shards)) == shard))

        def ask(batches: Iterator[pa.RecordBatch], cascade: Cascade = cascade, shard: int = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = longs(batch, "a").view(np.uint64), longs(batch, "b").view(np.uint64)
                own = longs(batch, "b") % shards == shard
                listed = pc.if_else(pa.array(own), pa.array(cascade.listed(a, b)), batch.column("listed"))
                yield batch.set_column(batch.num_columns - 1, "listed", listed)

        asked = asked.mapInArrow(ask, asked.schema)
        if shard + 1 < shards:
            asked = written(asked, "url-asked")
    return asked.select("page_id", "host", "path", "rule", F.coalesce(F.col("ruled"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


ORACLE = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, '.' || host AS sub FROM h),
f AS (SELECT page_id, host, path, CASE
        WHEN ends_with(sub, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ends_with(sub, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ends_with(sub, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ends_with(sub, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ends_with(sub, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM r),
b AS (SELECT DISTINCT host FROM f WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
