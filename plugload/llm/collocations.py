"""Collocations by prefix-free parsing of the words of a corpus.

A window of ``longest - 1`` words whose hash is a multiple of ``spacing`` is a trigger. A chunk runs from one trigger to the
end of the next one, so neighbouring chunks overlap by exactly one window, and where a chunk begins and ends depends on
its words alone: copied passages give copied chunks. The dictionary holds the distinct chunks of a language, with the
number of times the parse has each. A phrase of at most ``longest`` words belongs to the chunk in which its first word comes
before the closing trigger; phrases are counted once per dictionary entry, weighted with its parse frequency.

Counting goes level by level: a phrase of m words can only be frequent if its first and its last m - 1 words are, so
level m passes over those that a bitmap of the frequent phrases of level m - 1 excludes. The bitmap has a fixed number of
bits and only rules out; whatever passes is counted by its words, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plugload.llm.common import as_bytes, gathered, slices
from plugload.session import materialized

LONGEST = 3
SPACING = 12
MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
#: Bits of the map of frequent phrases, as a power of two; 16 MB at most are sent to a task.
FILTER_BITS = 27
#: Parts that the phrases of a language are ranked in before they are ranked together.
PARTS = 64
#: Bytes of text or of chunks that a task looks at together.
SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK, _END = 10, 11  # between two pieces of a text, between two texts


def _table() -> bytes:
    """Lower-case A-Z, a blank for a tab, a line feed for whatever ends a piece."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    table[9] = 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = _BREAK
    return bytes(table)


_TABLE = _table()


def normalized(text: bytes) -> bytes:
    """Words with one blank between them, pieces with one line feed between them."""
    text = text.translate(_TABLE)
    for wide, narrow in ((b"  ", b" "), (b"\n ", b"\n"), (b" \n", b"\n"), (b"\n\n", b"\n")):
        while wide in text:
            text = text.replace(wide, narrow)
    return text.strip(b" \n")


class Words:
    """The words of normalized texts laid end to end: numbers, hashes and places."""

    def __init__(self, texts: list[bytes]):
        self.data = data = b"\x0b".join(texts)
        codes = np.frombuffer(data, np.uint8)
        gap = (codes == 32) | (codes == _BREAK) | (codes == _END)
        at = np.flatnonzero(gap)
        self.start, self.end = np.append(0, at + 1), np.append(at, len(codes))
        self.before = np.append(_END, codes[at])  # what stands before each word
        self.text = np.cumsum(self.before == _END) - 1
        self.piece = np.cumsum(self.before != 32)
        offsets = np.append(0, np.cumsum(self.end - self.start)).astype(np.int64)
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(codes[~gap])]
        ).dictionary_encode()
        self.number = packed.indices.to_numpy()
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in packed.dictionary.to_pylist()), np.uint64, len(packed.dictionary))

    def __len__(self) -> int:
        return len(self.start)

    def rolling(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; there are n - 1 fewer."""
        h = self.hashes[self.number]
        mixed = h[: max(len(h) - n + 1, 0)]
        for k in range(1, n):
            mixed = mixed * _ODD + h[k : len(h) - n + 1 + k]
        mixed = mixed ^ (mixed >> np.uint64(32))
        return mixed * np.uint64(0xD6E8FEB86659FD93)

    def within(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one id, one entry per start as in rolling."""
        return ids[: max(len(ids) - n + 1, 0)] == ids[n - 1 :]


def parse(texts: list[bytes], window: int, spacing: int) -> Iterator[tuple[int, bytes, int]]:
    """(text, chunk, own words) in order; the words of a chunk after its own ones are the trigger that closes it."""
    w = Words(texts)
    trigger = w.within(w.text, window) & ((w.rolling(window) >> np.uint64(20)) % np.uint64(spacing) == 0)
    opens = w.before == _END
    opens[: len(trigger)] |= trigger
    first = np.flatnonzero(opens)
    following = np.append(first[1:], len(w))
    closes = np.append(w.before[first[1:]] != _END, False)  # by a trigger, not by the end of the text
    last = np.where(closes, following + window, following) - 1
    places = zip(w.text[first].tolist(), w.start[first].tolist(), w.end[last].tolist(), (following - first).tolist())
    return ((text, w.data[a:b], own) for text, a, b, own in places)


def dictionary(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, spacing: int = SPACING
) -> DataFrame:
    """(lang, chunk, own, times): the distinct chunks of each language and how often the parse has them."""
    window = max(longest - 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(gathered(batches, "text", SLICE_BYTES), "text", SLICE_BYTES):
            texts = [normalized(t.as_py()) for t in batch.column(1)]
            some = [i for i, t in enumerate(texts) if t]
            if some:
                row, chunk, own = zip(*parse([texts[i] for i in some], window, spacing))
                rows = pa.array(np.array(some)[np.array(row)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(chunk, pa.binary()), pa.array(own, pa.int32())], ["lang", "chunk", "own"]
                )

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), as_bytes(text).alias("text"))
    parsed = rows.mapInArrow(run, "lang string, chunk binary, own int")
    return parsed.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


class Level:
    """Counts the phrases of ``size`` words in dictionary entries, where the bitmap of their parts lets them pass."""

    def __init__(self, size: int, bits: int, known=None):
        self.size, self.bits, self.known = size, bits, known

    def places(self, hashes: np.ndarray, langs: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ langs) * _ODD
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _passes(self, w: Words, langs: np.ndarray) -> np.ndarray:
        part = self.size - 1
        place = self.places(w.rolling(part), langs[: len(w) - part + 1])
        held = (self.known.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return held[:-1] & held[1:]

    def count(self, langs: list[str], chunks: list[bytes], own: np.ndarray, times: np.ndarray) -> tuple[list, list, list]:
        """(language, phrase, weighted count) of the distinct phrases in these chunks."""
        w, m = Words(chunks), self.size
        names = {name: i for i, name in enumerate(dict.fromkeys(langs))}
        lang = np.array([names[x] for x in langs])[w.text]
        place = np.arange(len(w)) - np.flatnonzero(w.before == _END)[w.text]
        good = w.within(w.piece, m) & (place < own[w.text])[: max(len(w) - m + 1, 0)]
        if m > 1 and len(good):
            seeds = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
            good &= self._passes(w, seeds[lang])
        at = np.flatnonzero(good)
        if not len(at):
            return [], [], []
        key, bound = lang[at], len(names)
        for k in range(m):
            if bound * len(w.hashes) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                bound = len(at)
            key, bound = key * len(w.hashes) + w.number[at + k], bound * len(w.hashes)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.add.reduceat(times[w.text[at[order]]], first)
        one, every = at[order[first]], list(names)
        phrases = [w.data[a:b] for a, b in zip(w.start[one].tolist(), w.end[one + m - 1].tolist())]
        return [every[i] for i in lang[one].tolist()], phrases, counts

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(gathered(batches, "chunk", SLICE_BYTES), "chunk", SLICE_BYTES):
            found = self.count(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k).to_numpy() for k in (2, 3)))
            kinds = (pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["lang", "phrase", "f"])


def _bitmap(frequent: DataFrame, level: Level) -> np.ndarray:
    """Packed bits of the frequent phrases; at most 2 ** bits / 64 pairs of numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase", 1 << 20):
            if batch.num_rows:
                w = Words(batch.column(1).to_pylist())
                first = np.flatnonzero(w.before == _END)
                seeds = np.fromiter((xxhash.xxh64_intdigest(x) for x in batch.column(0).to_pylist()), np.uint64)
                place = level.places(w.rolling(level.size)[first], seeds)
                yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

    places = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "place bigint")
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    packed = np.zeros(1 << max(level.bits - 6, 0), np.int64)
    packed[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return packed.view(np.uint8)


def frequencies(
    entries: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words that occur ``min_count`` times or more."""
    levels, known = [], None
    for size in range(1, longest + 1):
        level = Level(size, bits, known)
        counted = entries.mapInArrow(level.run, "lang string, phrase binary, f bigint")
        counted = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
        levels.append(materialized(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(size).alias("size"), "f")))
        if size < longest:
            known = entries.sparkSession.sparkContext.broadcast(_bitmap(levels[-1], level))
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    return every


def _part(words: str, first: int | str, length: int | str):
    return F.expr(f"array_join(slice({words}, {first}, {length}), ' ')")


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all frequent phrases of two words or more, by their lowest-scoring cut.

    Both parts of a frequent phrase are frequent, so the table of frequent phrases has all counts. Products are
    decimals of 38 digits: exact up to counts of 10^15.
    """
    cut = known.where("size > 1").select(
        "lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("lang", "phrase", "size", "a", "k", _part("w", 1, "k").alias("first"), _part("w", "k + 1", "size - k").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7, 0))) div ({wide('l')} * {wide('r')})")
    cuts = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "best.l", "best.r", "best.score"
    )


def uncovered(candidates: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Candidates without those that lie inside a longer candidate which has ``percent`` of their occurrences or more."""
    inner = candidates.where("size > 2").select(
        "lang", "a", "size", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(2, size - 1)")).alias("m")
    ).select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i"))
    inner = inner.groupBy("lang", _part("w", "i", "m").alias("phrase")).agg(F.max("a").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    covered = F.coalesce(wide("_longer") * 100 >= wide("a") * percent, F.lit(False))
    return candidates.join(inner, ["lang", "phrase"], "left").where(~covered).drop("_longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
    top: int = TOP, cover_percent: int = COVER_PERCENT, spacing: int = SPACING, bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces at blanks and tabs into words;
    phrases stay within a piece. a is the number of occurrences, l and r those of the parts of the lowest-scoring cut,
    n the number of words of the language, score floor(1000000 a^2 / (l r)). Ranks go by score, then a, both falling, then
    by the bytes of the phrase. Null texts are empty, rows of null lang are the language ``und``, repeated rows count each
    time, an empty table gives an empty result, other columns are not read. Ids play no part.
    """
    if longest < 2:
        raise ValueError("a collocation has two words at least")
    entries = materialized(dictionary(docs, text, lang, longest, spacing))
    totals = entries.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    candidates = materialized(scored(frequencies(entries, longest, min_count, bits)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = uncovered(candidates, cover_percent).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # First within parts of a language, so that the last task of a language gets top rows of each part only.
    for keys in (["lang", "_part"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
