"""SimHash near-duplicates, found by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plugload.llm import similar
from plugload.llm.common import as_bytes
from plugload.llm.components import components
from plugload.session import materialized

BITS = 64
SEED = 42
#: Buckets above this size are divided further by bits outside their part.
BUCKET_ROWS = 20_000
#: Fingerprints from which distances are estimated; a fixed bound.
SAMPLE_ROWS = 4_096
#: Radii up to here have their large buckets divided.
WIDE = 6
_CHUNK = 4_096
_FLUSH_ROWS = 32_768


def fingerprint(text: bytes, shingle: int = 3, more: int = 0) -> list[int]:
    """Unsigned 64-bit SimHash of UTF-8 bytes: a bit is set if over half the shingle hashes have it.

    ``more`` further SimHashes follow, of hashes derived from the first ones.
    """
    words = text.lower().split()
    if not words:
        return [0] * (1 + more)
    parts = [words[i:] for i in range(min(shingle, len(words)))]
    digest, space = xxhash.xxh64_intdigest, b" "
    hashes = np.fromiter((digest(space.join(x), SEED) for x in zip(*parts)), np.uint64)
    found = []
    for k in range(1 + more):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashes ^= hashes >> np.uint64(31)
        counts = np.zeros(BITS, np.int64)
        for start in range(0, len(hashes), _CHUNK):
            some = hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little"))
    return found


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, more: int = 0) -> DataFrame:
    """(doc_id, fp, more): fp is the SimHash as a signed long, more an array of further ones. ASCII letters are
    lower-cased, words are cut at ASCII white space; a text of fewer words than a shingle is one shingle; an empty or
    null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle, more) for t in batch.column(1)], np.uint64).reshape(-1, 1 + more)
            values = values.view(np.int64)
            rest = pa.array(list(values[:, 1:]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[:, 0]), rest], ["doc_id", "fp", "more"])

    ids = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text)).mapInArrow(run, f"doc_id {ids}, fp bigint, more array<bigint>")


# -- plan: parts and thresholds --------------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of common bits, over all of them; 4,096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64)
            for start in range(0, len(values), _CHUNK):
                bits = _bits(values[start : start + _CHUNK]).astype(np.float32)
                both += bits.T @ bits
            n += len(values)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def parts_of_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m parts so that correlated bits share a part: bits that say the same narrow one part only."""
    share = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part: list[int] = []
        while len(part) < width:
            rest = sorted(free)
            score = corr[np.ix_(rest, part)].mean(axis=1) if part else corr[np.ix_(rest, rest)].max(axis=1)
            part.append(rest[int(np.argmax(score))])
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def reach(threshold: int) -> int:
    """Both sides try all values within this distance: two values at most ``threshold`` apart then meet."""
    return -(-threshold // 2)


def common(width: int, ball: int, d: int) -> int:
    """Values of ``width`` bits within ``ball`` of both of two values that are d apart."""
    return sum(
        comb(d, a) * comb(width - d, b) for a in range(d + 1) for b in range(width - d + 1) if a + b <= ball and d - a + b <= ball
    )


def candidate_costs(n: int, sample: np.ndarray, parts: list[list[int]], radius: int) -> np.ndarray:
    """cost[i, e + 1]: rows written and pairs met if part i is searched up to distance e; e = -1 leaves the part out.

    The share of pairs at a distance is the larger of what the sample shows and what independent bits would give.
    """
    cost = np.full((len(parts), radius + 2), np.inf)
    share = _bits(sample).mean(axis=0) if len(sample) else np.full(BITS, 0.5)
    apart = 2 * share * (1 - share)
    half = max(len(sample) // 2, 1)
    for i, bits in enumerate(parts):
        width, mask = len(bits), np.uint64(mask_of(bits))
        far = np.bitwise_count((sample[:half, None].view(np.uint64) ^ sample[None, half:].view(np.uint64)) & mask)
        seen = np.bincount(far.ravel(), minlength=width + 1) / max(far.size, 1)
        even = np.zeros(width + 1)
        even[0] = 1
        for b in bits:
            even[1:] = even[1:] * (1 - apart[b]) + even[:-1] * apart[b]
            even[0] *= 1 - apart[b]
        cost[i, 0] = 0
        for e in range(min(radius, width) + 1):
            ball = reach(e)
            if ball > 3:
                break
            rows = sum(comb(width, k) for k in range(ball + 1))
            met = sum(max(seen[d], even[d]) * common(width, ball, d) for d in range(min(2 * ball, width) + 1))
            cost[i, e + 1] = n * rows * 300.0 + n * float(n) / 2 * met
    return cost


def allocate(cost: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 and the least total cost, by dynamic programming.

    If every part differed by more than its threshold, the whole would differ by at least sum(t_i + 1) = radius + 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for k in range(radius + 2 - used):
                at = (total + row[k], [*chosen, k - 1])
                if used + k not in step or at[0] < step[used + k][0]:
                    step[used + k] = at
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts, for the cheapest number of parts from 2 to radius + 1."""
    n, both = bit_statistics(fps)
    every = max(1, n // SAMPLE_ROWS)
    drawn = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE_ROWS)
    sample = np.array([r[0] for r in drawn.collect()], np.int64)
    choices = []
    for m in range(2, radius + 2):
        parts = parts_of_bits(n, both, m)
        total, thresholds = allocate(candidate_costs(n, sample, parts, radius), radius)
        choices.append((total, [(mask_of(p), t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


# -- candidates and links --------------------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(fps: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    """(part, key, fp, rep, and other if there is one): a row for each value of the part within half its threshold."""
    carried = [c for c in ("fp", "rep", "other") if c in fps.columns]

    def flips(mask: int, threshold: int) -> np.ndarray:
        bits = [b for b in range(BITS) if mask >> b & 1]
        return np.array([_signed(mask_of(list(c))) for k in range(reach(threshold) + 1) for c in combinations(bits, k)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            fp = columns[0]
            for i, (mask, threshold) in enumerate(chosen):
                own, masks = fp & np.int64(_signed(mask)), flips(mask, threshold)
                for some in np.array_split(masks, -(-len(masks) // 64)):
                    keys = (own[:, None] ^ some[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), i, np.int32)), pa.array(keys),
                        *(pa.array(np.repeat(c, len(some))) for c in columns),
                    ], ["part", "key", *carried])

    return fps.select(*carried).mapInArrow(run, "part int, key bigint, " + ", ".join(f"{c} bigint" for c in carried))


def _refined(rows: DataFrame, chosen: list[tuple[int, int]], radius: int, limit: int) -> DataFrame:
    """Divide buckets of more than ``limit`` rows: of radius + 1 groups of the other bits one must agree completely."""
    done, masks = None, {i: ((1 << BITS) - 1) & ~mask for i, (mask, _) in enumerate(chosen)}
    while True:
        sizes = rows.groupBy("part", "key").count().where(F.col("count") > limit)
        hot = materialized(sizes.select("part", "key"))
        if hot.isEmpty():
            return rows if done is None else done.union(rows)
        small = rows.join(hot, ["part", "key"], "left_anti")
        large = materialized(rows.join(hot, ["part", "key"], "left_semi"))
        children: dict[int, list[tuple[int, int]]] = {}
        nxt: dict[int, int] = {}
        for p, rest in masks.items():
            bits = [b for b in range(BITS) if rest >> b & 1]
            if len(bits) <= radius:
                children[p] = []
                continue
            for j in range(radius + 1):
                group = mask_of(bits[j :: radius + 1])
                children.setdefault(p, []).append((p * (radius + 1) + j, group))
                nxt[p * (radius + 1) + j] = rest & ~group
        final = [p for p, c in children.items() if not c]
        small = small.union(large.where(F.col("part").isin(final))) if final else small
        # From here on the key is a hash of the old key and the newly agreeing bits.
        split = F.explode(F.element_at(
            F.create_map(*(x for p, c in children.items() if c for x in (
                F.lit(p), F.array(*(F.struct(F.lit(q).alias("part"), F.lit(_signed(g)).alias("mask")) for q, g in c))
            ))), F.col("part")
        ))
        deeper = large.where(~F.col("part").isin(final)).select("key", "fp", "rep", split.alias("c")).select(
            "c.part", F.xxhash64("key", F.col("fp").bitwiseAND(F.col("c.mask"))).alias("key"), "fp", "rep"
        )
        done = small if done is None else done.union(small)
        rows, masks = materialized(deeper), nxt


class _Bits:
    """Fingerprints of a bucket, with a second one or not, and the bounds of a link: of the first, and of both."""

    def __init__(self, columns: list[np.ndarray], radius: int, both: int | None):
        self.columns, self.radius, self.both = columns, radius, both

    def close(self, i, j) -> np.ndarray:
        apart = [np.bitwise_count((c[i] ^ c[j]).view(np.uint64)) for c in self.columns]
        near = apart[0] <= self.radius
        return near & (apart[0].astype(np.int16) + apart[1] <= self.both) if self.both is not None else near


def _bucket_links(bits: _Bits, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join each of a bucket's components: whoever is reached is never compared again with its kind."""
    a, b, left = [], [], rows
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = bits.close(left, np.array([at]))
            if near.any():
                met, left = left[near], left[~near]
                a.append(np.full(len(met), at))
                b.append(met)
                front.extend(met.tolist())
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(a), join(b)


def _links(rows: DataFrame, radius: int, both: int | None = None, short: int = 48, middle: int = 512) -> DataFrame:
    """Verified links (a, b) of all buckets. Buckets arrive sorted, so a task holds one batch and one bucket.

    Small buckets give all their links, others at most eight per row, or else only those that join their components.
    """

    def pairs(part, key, fp, rep, *other):
        bits = _Bits([fp, *other], radius, both)
        edge = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(fp))
        for s, e in zip(starts[ends - starts > short], ends[ends - starts > short]):
            run = np.arange(s, e)
            if e - s <= middle:
                a, b = np.nonzero(np.triu(bits.close(run[:, None], run[None, :]), 1))
                if len(a) <= 8 * (e - s):
                    yield rep[s + a], rep[s + b]
                    continue
            a, b = _bucket_links(bits, run)
            yield rep[a], rep[b]
        size = np.repeat(ends - starts, ends - starts)
        left = np.repeat(ends, ends - starts) - np.arange(len(fp)) - 1
        left[size > short] = 0
        for d in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= d)
            hit = i[bits.close(i, i + d)]
            yield rep[hit], rep[hit + d]

    def flush(columns):
        for a, b in pairs(*columns):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, _FLUSH_ROWS
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            n += batch.num_rows
            if n < enough:
                continue
            every = [np.concatenate(c) for c in zip(*held)]
            last = (every[0] == every[0][-1]) & (every[1] == every[1][-1])
            cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))  # the last bucket may go on
            yield from flush([c[:cut] for c in every]) if cut else ()
            held, n = [[c[cut:] for c in every]], n - cut
            enough = max(_FLUSH_ROWS, 2 * n)
        if n:
            yield from flush([np.concatenate(c) for c in zip(*held)])

    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_links(fps: DataFrame, radius: int, limit: int = BUCKET_ROWS, both: int | None = None) -> DataFrame:
    """Links (a, b) between the reps of distinct fingerprints, enough to join all within ``radius`` bits.

    With a second fingerprint, in a column ``other``, a link must also keep within ``both`` bits of the two together.

    Buckets that hold more than ``limit`` fingerprints are divided until they do not, so no bucket is too large for
    a task and none is cut off. Within a large bucket only links that join its components are given out. A radius above
    WIDE leaves too few agreeing bits to divide by: its buckets stay whole, and a task holds one of them.
    """
    chosen = plan(fps, radius)
    rows = _buckets(fps, chosen)
    return _links(_refined(rows, chosen, radius, limit) if radius <= WIDE else rows, radius, both).distinct()


def near_components(fps: DataFrame, radius: int = 3, limit: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component) for distinct fingerprints (fp, rep): the least rep that links of at most ``radius`` bits reach."""
    found = components(near_links(fps, radius, limit))
    joined = fps.join(found, fps["rep"] == found["node"], "left")
    return joined.select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, limit: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least doc_id that links reach.

    Equal fingerprints are taken together first, with partial aggregation, so thousands of copies are one row in
    the search. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated results; rows without doc_id take part in nothing and are their own null component. An empty table
    gives an empty result. Columns beyond the two named are ignored.
    """
    prints = materialized(fingerprints(docs, doc_id, text, shingle))
    known = prints.where("doc_id is not null")
    fps = materialized(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = near_components(fps, radius, limit).select(F.col("fp").alias("_fp"), F.col("component").alias("component_id"))
    joined = prints.join(found, F.col("fp") == F.col("_fp"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_pairs(docs: DataFrame, shingle: int = 3, radius: int = 3, limit: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, text) that join all whose fingerprints are linked: those of equal fingerprint with the
    least of them, and the links between these."""
    prints = materialized(fingerprints(docs, shingle=shingle).select("doc_id", "fp").distinct())
    fps = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    equal = prints.join(fps, "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return equal.union(near_links(fps, radius, limit))


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3
) -> DataFrame:
    """(doc_id, component_id): groups of texts joined by links of this similarity or more of their shingle sets.

    Fingerprints of the shingles give the first links, by parts and thresholds as for ``near_duplicates``, and the sets decide
    each of them. Similar texts may differ in more bits than any such search reaches (17 of 64 at similarity 0.83 in the
    given documents), so texts that are still in different groups go on to the bands and rounds of
    ``similar.similar_documents``, whose rules hold for the rest.
    """
    near = lambda texts: near_pairs(texts, shingle, radius)
    return similar.similar_documents(docs, doc_id, text, shingle, similarity, near)
