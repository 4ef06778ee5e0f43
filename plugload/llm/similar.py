"""Texts with similar shingle sets: candidates by banded minima, screened by minima per bin, decided by the sets themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plugload.llm.common import as_bytes, released
from plugload.llm.components import components
from plugload.session import materialized

SEED = 42
#: Sets of similarity s meet in at least one band with 1 - (1 - s ** HEIGHT) ** BANDS: 0.997 at 0.8.
BANDS, HEIGHT = 32, 8
#: Bins that the hashes of a set fall into, and 64-bit words of one bit per bin.
BINS = 2_048
WORDS = BINS // 64
#: Standard deviations by which the estimate of a pair may fall short of the similarity.
DEVIATIONS = 4
#: Rows of a block of a large bucket; a task compares two blocks.
BLOCK_ROWS = 2_048
#: Candidates per row and pair of blocks that the first round after the hubs verifies; later ones take four times as many.
FIRST_NEAREST = 4
_CHUNK = 2_048
_CACHED = 256


def shingles(text: bytes, size: int) -> set[bytes]:
    """Runs of ``size`` words; a text of fewer words is one shingle, one of no words has none."""
    words = text.lower().split()
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(min(size, len(words)))))}


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, BANDS * HEIGHT, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * HEIGHT, np.uint64)


def sketch(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> tuple[list[int], list[int]]:
    """Signed words and signed band keys of a set of ascending hashes; an empty set has no keys.

    The words are two bits per bin: whether a hash fell into it, and one random bit of the least that did.
    """
    if not len(hashes):
        return [0] * (2 * WORDS), []
    least = np.full(BANDS * HEIGHT, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        some = hashes[start : start + _CHUNK]
        for k in range(0, len(factors), HEIGHT):
            values = some[:, None] * factors[k : k + HEIGHT]
            values ^= values >> np.uint64(32)
            values *= shifts[k : k + HEIGHT] | np.uint64(1)
            np.minimum(least[k : k + HEIGHT], values.min(axis=0), out=least[k : k + HEIGHT])
    keys = [xxhash.xxh64_intdigest(least[k : k + HEIGHT].tobytes(), k) for k in range(0, len(least), HEIGHT)]
    used, drawn = np.zeros(BINS, bool), np.zeros(BINS, bool)
    falling = hashes[::-1]  # of the hashes of a bin the last one written is the least
    place = (falling & np.uint64(BINS - 1)).astype(np.int64)
    used[place], drawn[place] = True, (falling >> np.uint64(20)) & np.uint64(1) > 0
    words = np.packbits(np.concatenate([used, drawn]), bitorder="little").view(np.int64)
    return words.tolist(), np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, digest, n, words, keys): digest names the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _constants()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = shingles(t.as_py(), size)
                hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found))
                hashes.sort()
                rows.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(found), *sketch(hashes, factors, shifts)))
            digest, n, words, keys = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()),
                pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc_id", "digest", "n", "words", "keys"])

    ids = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text)).mapInArrow(
        released(run), f"doc_id {ids}, digest binary, n int, words array<bigint>, keys array<bigint>"
    )


def may_be_similar(n: np.ndarray, words: np.ndarray, n2: np.ndarray, words2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of sets may be similar, by their sizes and words; all arguments have one row per pair.

    Of the bins that either set uses a share as large as the similarity holds the same least hash. Bins in which only
    one random bit agrees by chance are taken off again. The estimate has the variance of these bits and of drawing
    bins, which is small where most hashes have a bin of their own.
    """
    used, used2 = words[:, :WORDS], words2[:, :WORDS]
    count = lambda x: np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64)
    either, both = count(used | used2), count(used & used2)
    agree = count(used & used2 & ~(words[:, WORDS:] ^ words2[:, WORDS:]))
    same = 2 * agree - both
    union = (n + n2) / (1 + similarity)
    drawn = similarity * (1 - similarity) * either * np.clip(1 - either / np.maximum(union, 1), 0.02, 1)
    deviation = np.sqrt(np.maximum(both - same, 1) + drawn)
    sizes = np.minimum(n, n2) >= np.maximum(n, n2) * similarity - 1e-9
    return sizes & (same + DEVIATIONS * deviation >= similarity * either)


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts in docs (doc_id, text) have shingle sets of this Jaccard similarity or more."""
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    asked = pairs.join(side("a"), "a").join(side("b").join(pairs.select("b").distinct(), "b", "left_semi"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, set[bytes]] = {}

        def of(text: bytes) -> set[bytes]:
            key = xxhash.xxh3_128_digest(text)
            if key not in cache:
                if len(cache) >= _CACHED:
                    cache.pop(next(iter(cache)))
                cache[key] = shingles(text, size)
            return cache[key]

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = of(x.as_py()), of(y.as_py())
                both = len(x & y)
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return asked.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a bigint, b bigint").distinct()


def screened(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of reps that may be similar by facts (rep, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n, n2 = (np.asarray(batch.column(k)) for k in range(4))
                words = [np.asarray(batch.column(k).flatten()).reshape(-1, 2 * WORDS) for k in (4, 5)]
                good = may_be_similar(n, words[0], n2, words[1], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    side = lambda x: facts.toDF(x, f"n_{x}", f"words_{x}")
    sides = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "words_a", "words_b")
    return sides.mapInArrow(run, "a bigint, b bigint")


def hub_pairs(met: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every row of a bucket with the least one there, if they may be similar."""
    hubs = met.groupBy("key").agg(F.min("rep").alias("a"))
    pairs = met.join(hubs, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    return screened(pairs, facts, similarity)


def open_buckets(met: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """met with label, lo and hi: rows of the buckets that hold several components, dealt to pairs of bounded blocks.

    The rows of a bucket's largest component meet only the others, all others meet each other too. A pair of blocks is a
    group of its own, so no bucket is too large for a task and no pair of rows of two components is left out.
    """
    rows = met.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
    sizes = rows.groupBy("key", "label").count()
    most = F.max(F.struct("count", "label"))
    stats = sizes.groupBy("key").agg(most.getField("label").alias("_most"), most.getField("count").alias("_c"), F.sum("count").alias("_n"))
    stats = stats.where("_n > _c").select("key", "_most", F.ceil((F.col("_n") - F.col("_c")) / BLOCK_ROWS).alias("_few"), F.ceil(F.col("_c") / BLOCK_ROWS).alias("_many"))
    few, many, main = F.col("_few"), F.col("_many"), F.col("label") == F.col("_most")
    drawn = F.xxhash64("rep", F.lit(11))
    own = F.when(main, few + F.pmod(drawn, many)).otherwise(F.pmod(drawn, few))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(main, few - 1).otherwise(few + many - 1)))
    dealt = rows.join(stats, "key").withColumn("_own", own).select("key", "rep", "label", "_own", others.alias("_other"))
    return dealt.join(facts, "rep").select("key", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "_own", "rep", "label", "n", "words")


def nearest_pairs(dealt: DataFrame, similarity: float, nearest: int) -> DataFrame:
    """(key, a, b, more): for every row of a pair of blocks its nearest candidates of other components; more tells that
    some row of the two blocks has others."""

    def run(table: pa.Table) -> pa.Table:
        lo, own = table.column("lo")[0].as_py(), np.asarray(table.column("_own"))
        rep, label, n = (np.asarray(table.column(c)) for c in ("rep", "label", "n"))
        words = np.asarray(table.column("words").combine_chunks().flatten()).reshape(-1, 2 * WORDS)
        left = np.flatnonzero(own == lo)
        right = left if table.column("hi")[0].as_py() == lo else np.flatnonzero(own != lo)
        a, b, more = [], [], False
        for i, j in ((left, right), (right, left)) if right is not left else ((left, right),):
            for at in i:
                other = j[label[j] != label[at]]
                good = other[may_be_similar(n[[at]], words[[at]], n[other], words[other], similarity)]
                if len(good) > nearest:
                    more = True
                    apart = np.bitwise_count((words[[at]] ^ words[good]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    good = good[np.argpartition(apart, nearest - 1)[:nearest]]
                a.append(np.full(len(good), rep[at]))
                b.append(rep[good])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        key = np.full(len(a), table.column("key")[0].as_py())
        return pa.table({"key": key, "a": np.minimum(a, b), "b": np.maximum(a, b), "more": np.full(len(a), more)})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, "key bigint, a bigint, b bigint, more boolean")


def between_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components by labels (node, component)."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, component_id): groups of texts joined by links of this Jaccard similarity or more of their shingle sets.

    Equal sets are one row in the search. Rows that share a band are candidates, if sizes and minima per bin allow the
    similarity; of pairs at 0.8 at least 0.99 are. Texts are read for such pairs only. The sets of a candidate pair are compared exactly before it is a link.
    ``near`` may give pairs (a, b) for the texts of distinct sets (doc_id, text); these are compared before all others.
    Then each row is compared with the least one of its bucket. After that only buckets of several components are
    looked at, and in rounds each row with more and more of its nearest candidates of other components, until
    no such candidate was left out: no bucket is capped, and copies by the thousand do not make all their pairs.
    Other rules as for ``simhash.near_duplicates``; a text of no words is like no other text but another of no words.
    """
    prints = materialized(sketches(docs, doc_id, text, shingle))
    known = prints.where("doc_id is not null")
    sets = materialized(known.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words"), F.first("keys").alias("keys")))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"))
    facts = sets.select("rep", "n", "words")  # these travel with pairs and open buckets only
    rows = sets.select(F.explode("keys").alias("key"), "rep")
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    met = materialized(rows.join(shared, "key", "left_semi"))
    hubs = hub_pairs(met, facts, similarity)
    if near is None:
        tried = materialized(hubs)
        links = materialized(verified(tried, texts, similarity, shingle))
    else:
        distinct = texts.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        given = near(distinct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        tried = materialized(given)
        links = materialized(verified(tried, texts, similarity, shingle))
        fresh = between_components(hubs, materialized(components(links))).join(tried, ["a", "b"], "left_anti")
        fresh = materialized(fresh)
        tried = tried.union(fresh)
        links = links.union(materialized(verified(fresh, texts, similarity, shingle)))
    labels, nearest = materialized(components(links)), FIRST_NEAREST
    while True:
        asked = materialized(nearest_pairs(open_buckets(met, facts, labels), similarity, nearest))
        fresh = materialized(asked.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            tried = tried.union(fresh)
            links = links.union(materialized(verified(fresh, texts, similarity, shingle)))
            labels = materialized(components(links))
        left = materialized(asked.where("more").select("key").distinct())
        if left.isEmpty():
            break
        # The other buckets have shown all their candidates.
        met, nearest = materialized(met.join(left, "key", "left_semi")), 4 * nearest
    of = sets.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = prints.join(of, F.col("digest") == F.col("_digest"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
