"""Removal of long repeated substrings by prefix-free parsing.

A rolling hash picks triggers from the content alone: in every string of ``length`` bytes the smallest hash of its
``gram``-byte substrings, the leftmost of equal ones. The trigger of a string thus depends on nothing outside it, and
strings that start one after the other mostly share their trigger. A phrase is the text from the first to the last
string with the same trigger; phrases overlap by length - 1 bytes, so that every string lies in exactly one phrase.
The dictionary holds the distinct phrases, the parse is where they occur.

The dictionary's suffixes are put in order by prefix doubling (``suffix_order``) up to ``length`` bytes. A string of that
length lies in one phrase, so its place in the order of the corpus is that of its suffix in the dictionary, as often
as the parse has the phrase: neighbours that agree in ``length`` bytes, or a phrase that the parse has twice, are
repeats. The order of the parse would only tell apart strings that agree in ``length`` bytes; no byte depends on it, so
the parse is counted and not sorted. Equal strings have the same trigger, hence only phrases with a common trigger can
share them: a trigger that occurs once rules out all strings of its phrase, and the dictionary is sorted in parts that
hold whole triggers. Hashes only bring phrases together. A trigger with more phrases than one task should sort is the
exception: its strings are counted by hash through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plugload.llm.common import as_bytes, released, slices
from plugload.session import materialized

LENGTH = 200
GRAM = 40
#: Longer texts are parsed in overlapping pieces of so many starts, which bounds memory and changes no result.
PIECE = 1 << 19
#: Triggers with more distinct phrases are compared through a shuffle of string hashes instead of in one task.
GROUP_PHRASES = 8_000
#: A group with more than one of so many parts of all rows is not brought into one task.
LARGE_GROUPS = 1_000
#: Triggers are sorted together until their phrases hold so many bytes.
SORT_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


# -- parsing one block of bytes ---------------------------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over every run of ``width`` values, by running values within blocks from both sides."""
    n = len(values)
    blocks = np.zeros(-(-n // width) * width, values.dtype)
    blocks[:n] = values
    if ufunc is np.minimum:
        blocks[n:] = np.iinfo(values.dtype).max
    blocks = blocks.reshape(-1, width)
    after = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = ufunc.accumulate(blocks, axis=1).ravel()
    return ufunc(after[: n - width + 1], before[width - 1 : n])


class Parser:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.inverse[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.powers[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h | np.uint64(1)

    def phrases(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, trigger hash) of the phrases of texts laid end to end in data.

        The ranges of starts of a text's phrases are disjoint and cover all its starts of ``length`` bytes.
        """
        empty = np.empty(0, np.int64)
        if len(data) < self.length:
            return empty, empty, np.empty(0, np.uint64)
        h = self.gram_hashes(data)
        ends = np.cumsum(sizes)
        end_of = np.repeat(ends, sizes)
        n = len(data) - self.length + 1
        valid = end_of[:n] - np.arange(n) >= self.length
        least = np.where(valid, _sliding(h, self.width, np.minimum), np.uint64(0))
        rim = np.zeros(self.width - 1, np.uint64)
        at = np.flatnonzero(h == _sliding(np.concatenate([rim, least, rim]), self.width, np.maximum))
        key = h[at]
        left, right = at - self.width + 1, at.copy()
        before = np.arange(len(at)) - 1
        while len(more := np.flatnonzero((before >= 0) & (at - at[before] < self.width) & (key[before] > key))):
            before[more] -= 1
        near = (before >= 0) & (at - at[before] < self.width)
        left[near] = np.maximum(left[near], at[before[near]] + 1)
        after = np.arange(len(at)) + 1
        last = len(at) - 1
        while len(more := np.flatnonzero(
            (after <= last) & (at[np.minimum(after, last)] - at < self.width) & (key[np.minimum(after, last)] >= key)
        )):
            after[more] += 1
        near = (after <= last) & (at[np.minimum(after, last)] - at < self.width)
        right[near] = np.minimum(right[near], at[after[near]] - self.width)
        end = end_of[at]
        left = np.maximum(left, (ends - sizes)[np.searchsorted(ends, at, "right")])
        right = np.minimum(right, end - self.length)
        some = left <= right
        return left[some], right[some], key[some]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes): whole texts, or overlapping pieces of very long ones."""
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - length + 1, 0), PIECE):
            yield i, start, t[start : start + PIECE + length - 1]


# -- corpus -----------------------------------------------------------------------------------------------------------


def _text_key(doc_id: str, text: str) -> list[Column]:
    """Rows are told apart by id and text; equal rows have equal results, rows without id by their text alone."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("doc"), F.hash(F.col(text)).alias("mark")]


def parse(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, phrase, doc, mark, place): the parse of (doc, mark, text). key is the trigger's hash, phrase the hash of
    its bytes, place the first start and the number of starts, as start << 8 | number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for batch in slices(batches, "text", 1 << 19):
            cut = list(_pieces([t.as_py() for t in batch.column(2)], length))
            joined = b"".join(t for _, _, t in cut)
            sizes = np.array([len(t) for _, _, t in cut], np.int64)
            left, right, key = parser.phrases(np.frombuffer(joined, np.uint8), sizes)
            ends = np.cumsum(sizes)
            piece = np.searchsorted(ends, left, "right")
            view = memoryview(joined)
            digest = xxhash.xxh3_64_intdigest
            phrase = np.fromiter((digest(view[a : b + length]) for a, b in zip(left.tolist(), right.tolist())), np.uint64, len(left))
            row = np.array([i for i, _, _ in cut], np.int64)[piece] if len(cut) else piece
            start = left - (ends - sizes)[piece] + np.array([s for _, s, _ in cut], np.int64)[piece] if len(cut) else left
            place = (start << 8) | (right - left + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)),
                batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place),
            ], ["key", "phrase", "doc", "mark", "place"])

    if length - gram + 1 > 255:
        raise ValueError("a trigger may serve at most 255 starts")
    return texts.mapInArrow(released(run), "key bigint, phrase bigint, doc bigint, mark int, place bigint")


def _rims(rims: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(key, times, doc, mark, place, bytes) for dictionary entries: bytes of the phrases, cut from their texts."""
    lists = rims.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "times", "place")).alias("wanted"))
    joined = texts.join(lists, ["doc", "mark"])
    item = F.explode("wanted").alias("w")
    first = F.shiftright("w.place", 8)
    number = F.col("w.place").bitwiseAND(255)
    return joined.select("doc", "mark", "text", item).select(
        "w.key", "w.times", "doc", "mark", "w.place",
        F.substring("text", (first + 1).cast("int"), (number + length - 1).cast("int")).alias("bytes"),
    )


def _string_hashes(data: bytes, length: int) -> np.ndarray:
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[i : i + length]) for i in range(len(data) - length + 1)), np.uint64)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(starts) != 1)
    first = np.append(0, edge + 1)
    return starts[first], np.append(edge + 1, len(starts)) - first


_FOUND = "doc bigint, mark int, place bigint"


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): equal keys share a rank, ranks count from 1."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
    return order, rank


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes of data sorted by their first ``length`` bytes; equal ones share a rank from 1.

    Prefix doubling from words of seven bytes. The end of data counts as less than any byte.
    """
    n, width = len(data), min(7, length)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)])
    word = np.zeros(n, np.uint64)
    for k in range(width):
        word = word << np.uint64(9) | padded[k : k + n]
    order, rank = _ranks(word)
    while width < length and rank[order[-1]] < n:
        step = min(width, length - width)
        pair = rank * (n + 1)
        pair[: n - step] += rank[step:]
        order, rank = _ranks(pair)
        width += step
    return order, rank


def repeated_starts(phrases: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """Per phrase, which of its strings of ``length`` bytes the phrases hold more than once, each counted ``times`` times."""
    sizes = np.array([len(p) for p in phrases])
    first = np.cumsum(sizes) - sizes
    numbers = sizes - length + 1
    _, rank = suffix_order(np.frombuffer(b"".join(phrases), np.uint8), length)
    rank = rank[np.concatenate([np.arange(a, a + k) for a, k in zip(first, numbers)])]
    repeated = np.bincount(rank, np.repeat(times, numbers))[rank] > 1
    return np.split(repeated, np.cumsum(numbers)[:-1])


def _sorted_groups(rims: DataFrame, length: int) -> DataFrame:
    """Repeated starts of phrases whose trigger has few distinct phrases: their suffixes are sorted within the task."""

    def found(rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[2:5]: r for r in rows}.values())
        for r, hit in zip(rows, repeated_starts([r[5] for r in rows], [r[1] for r in rows], length)):
            if r[1] == 1 and hit.any():
                for s, n in zip(*_runs(np.flatnonzero(hit))):
                    yield r[2], r[3], (r[4] >> 8) + int(s) << 8 | int(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [dict(zip(("doc", "mark", "place"), x)) for x in found(held)], pa.schema([("doc", pa.int64()), ("mark", pa.int32()), ("place", pa.int64())])
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORT_BYTES and held[-1][0] != row[0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    columns = ["key", "times", "doc", "mark", "place", "bytes"]
    return rims.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(released(run), _FOUND)


def _shuffled_groups(rims: DataFrame, length: int) -> DataFrame:
    """The same for triggers with very many phrases: string hashes are counted with partial aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            hashes = [_string_hashes(b.as_py(), length) for b in batch.column(5)]
            n = [len(h) for h in hashes]
            row = pa.array(np.repeat(np.arange(len(n)), n))
            first = np.array([p >> 8 for p in batch.column(4).to_pylist()], np.int64)
            start = np.concatenate([f + np.arange(k) for f, k in zip(first, n)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(hashes).view(np.int64)), *(batch.column(k).take(row) for k in range(4)), pa.array(start << 8 | 1)
            ], ["string", "key", "times", "doc", "mark", "place"])

    columns = ["key", "times", "doc", "mark", "place", "bytes"]
    strings = rims.select(*columns).mapInArrow(run, f"string bigint, key bigint, times bigint, {_FOUND}")
    repeated = strings.groupBy("string", "key").agg(F.sum("times").alias("n")).where("n > 1").select("string", "key")
    return strings.where("times = 1").join(repeated, ["string", "key"], "left_semi").select("doc", "mark", "place")


def _semi(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose group is among groups (on, n), n being the group's rows of ``total``.

    Rows of groups that hold more than a thousandth of all rows, of which there are less than a thousand, stay where they
    are: those groups are broadcast. So no task gets a large group; the other rows meet their groups in a shuffle.
    """
    large = F.broadcast(groups.where(F.col("n") * LARGE_GROUPS > total).select(*on))
    small = groups.where(F.col("n") * LARGE_GROUPS <= total).select(*on)
    rest = rows.join(large, on, "left_anti")
    return rows.join(large, on, "left_semi").union(rest.join(small, on, "left_semi"))


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_phrases: int = GROUP_PHRASES) -> DataFrame:
    """(doc, mark, places): runs of starts whose string of ``length`` bytes starts anywhere else too."""
    parsed = materialized(parse(texts, length, gram))
    shared = materialized(parsed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    parsed = materialized(_semi(parsed, shared, ["key"], parsed.count()))
    # The dictionary of phrases with shared triggers, each with its number of occurrences and one of its places.
    entries = parsed.groupBy("key", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "place")).alias("one"))
    entries = materialized(entries)
    whole = _semi(parsed, entries.where("n > 1"), ["key", "phrase"], parsed.count()).select("doc", "mark", "place")
    varied = entries.groupBy("key").agg(F.count("*").alias("phrases")).where("phrases > 1")
    rims = entries.join(varied, "key").select("key", F.least("n", F.lit(2)).alias("times"), "one.*", "phrases")
    cut = materialized(_rims(rims.select("key", "times", "doc", "mark", "place"), texts, length))
    many = materialized(varied.where(F.col("phrases") > group_phrases).select("key"))
    found = _sorted_groups(cut.join(many, "key", "left_anti"), length)
    if not many.isEmpty():
        found = found.union(_shuffled_groups(cut.join(many, "key", "left_semi"), length))
    return whole.union(found).groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))


def _cut(data: bytes, places: list[int], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and what remains."""
    spans: list[list[int]] = []
    for start, end in sorted((p >> 8, (p >> 8) + (p & 255) - 1 + length) for p in places):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return [(a, b) for a, b in spans], b"".join(kept)


def remove_repeats(
    docs: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, gram: int = GRAM, group_phrases: int = GROUP_PHRASES, with_text: bool = False,
) -> DataFrame:
    """row (struct of the ``carry`` columns, all unless given), bytes, removed, spans, sha256 and, if asked for, kept.

    Removed is every byte covered by a string of ``length`` bytes that starts anywhere else, in the same or another
    row. Bytes are those of the UTF-8 text; a cut may fall inside a character, so kept is text without the bytes of
    incomplete characters. Null and empty texts lose nothing; of repeated rows of enough length nothing remains,
    because each repeats the other. An empty table stays empty. Ids are whole numbers or null. Columns of any name are
    carried. Phrases of equal trigger and hash (two of 64 bits) are taken for equal.
    """
    names = carry or docs.columns
    keyed = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"), *_text_key(doc_id, text), as_bytes(text))
    marked = repeats(keyed.select("doc", "mark", "text"), length, gram, group_phrases)
    rows = docs.select(*names).schema
    out = f"bytes bigint, removed bigint, spans bigint, sha256 string{', kept string' if with_text else ''}"
    joined = keyed.join(marked.withColumnsRenamed({"doc": "_d", "mark": "_m"}), (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, places in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                spans, kept = _cut(data, places.as_py() or [], length)
                line = (len(data), sum(b - a for a, b in spans), len(spans), sha256(kept).hexdigest())
                found.append((*line, kept.decode("utf-8", "ignore")) if with_text else line)
            columns = list(zip(*found)) if found else [[]] * (5 if with_text else 4)
            kinds = [pa.int64()] * 3 + [pa.string()] * (2 if with_text else 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["row", "bytes", "removed", "spans", "sha256", *(["kept"] if with_text else [])],
            )

    kind = rows.simpleString()
    return joined.select("row", "text", "places").mapInArrow(released(run), f"row {kind}, {out}")
