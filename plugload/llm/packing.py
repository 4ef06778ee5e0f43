"""Vector bin packing of examples into training sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plugload.llm.common import gathered, released, slices
from plugload.session import materialized

LENGTH = 2048
#: Items that one task packs together; each shard leaves a few sequences that are not full.
SHARD_ITEMS = 4_096
#: Words whose ids a task remembers in each of two generations.
CACHE_WORDS = 250_000
#: Bytes of text whose words are numbered together.
SLICE_BYTES = 12 << 20


_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Letters and the signs that follow them are encoded apart by a tokenizer that splits between the two.
_PARTS = re.compile(rf"({_LETTERS.pattern})([.,;:!?%&*#$]*)")


class WordIds:
    """Ids of texts, word by word.

    For tokenizers with word ends whose pieces never cross white space, nor from letters to signs: a text's ids are
    those of its words. The words of a batch are
    split and numbered by Arrow; only distinct words reach Python, and new ones the tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        # Spark runs a task per core; threads of the tokenizer's own would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode new parts. Words of letters only are one piece of text each, whose last id is a word end, so that
        many can be encoded in one go; if the ends do not come out even, and for other parts, one by one."""
        plain = [w for w in new if _LETTERS.fullmatch(w)]
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for line, coded in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.young.update((w, data[a:b]) for w, a, b in zip(line, cuts, cuts[1:]))
        rest = [w for w in new if w not in self.young]
        coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.young.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(rest, coded))

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as bytes. Of two generations of known parts the older one is forgotten in time."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        parts = [m.groups() if (m := _PARTS.fullmatch(w)) else (w, "") for w in words]
        distinct = {x for pair in parts for x in pair}
        young.update((x, old[x]) for x in distinct if x not in young and x in old)
        if new := [x for x in distinct if x not in young]:
            self._learn(new)
        return [young[a] + young[b] for a, b in parts]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        ids = self._look_up(numbered.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.cumsum(size) - size
        word = np.asarray(numbered.indices)
        ends = np.cumsum(size[word])
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(start[word] - (ends - size[word]), size[word]) + np.arange(total)
        flat = np.frombuffer(b"".join(ids), "<u4")[take]
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return np.split(flat, np.append(0, ends)[offsets[1:-1]])


def pieces(
    docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32): every document's ids and ``end_id``, cut every ``length`` ids.

    A null text is empty and gives the end id alone. The tokenizer file must lie at the same path on all machines.
    """
    ids = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {ids}, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordIds(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in slices(gathered(batches, "text", SLICE_BYTES), "text", SLICE_BYTES):
            rows = []
            for i, found in enumerate(encode(batch.column(1))):
                coded = found.tobytes() + end
                for start in range(0, len(coded), 4 * length):
                    cut = coded[start : start + 4 * length]
                    rows.append((i, len(coded) // 4, start // 4, len(cut) // 4, zlib.crc32(cut)))
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 5))],
                ["doc_id", "doc_tokens", "start", "length", "ids_crc32"],
            )

    texts = F.coalesce(F.col(text), F.lit("")).alias("text")
    return docs.select(F.col(doc_id).alias("doc_id"), texts).mapInArrow(released(run), schema)


def pack_shard(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, rank in the bin) of each item, demand[item, dimension], under limits[dimension].

    Bins are filled one after the other. The item put in next is the one that fits in all dimensions and whose
    demand has the largest dot product with what the bin has left, both as shares of the limits and weighted by how
    much of each dimension all items need; so a bin takes items of the shape of its remaining room. Items that
    exceed a limit alone get a bin of their own.
    """
    n = len(demand)
    share = demand / limits
    weight = share.sum(axis=0) / max(share.sum(), 1e-12)
    bins, ranks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-demand[:, 0], kind="stable")
    share, ids = share[order], order
    alive = np.ones(n, bool)
    current, rank, room, left = 0, 0, np.ones(demand.shape[1]), n
    slack = 1 + 1e-9
    while left:
        fits = alive & (share <= room * slack).all(axis=1)
        if not fits.any():
            if rank:
                current, rank, room = current + 1, 0, np.ones(demand.shape[1])
                continue
            fits = alive
        gain = np.where(fits, share @ (weight * room), -1.0)
        at = int(np.argmax(gain))
        alive[at] = False
        bins[ids[at]], ranks[ids[at]] = current, rank
        room, rank, left = room - share[at], rank + 1, left - 1
        if 2 * left < len(alive):
            share, ids, alive = share[alive], ids[alive], alive[alive]
    return bins, ranks


def pack(
    items: DataFrame, tokens: str = "length", loss: str | None = None, max_tokens: int = LENGTH, max_segments: int = 256,
    max_loss: int | None = None, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """All rows of items with sequence_id and offset; offsets within a sequence have no gap.

    A sequence holds at most ``max_tokens`` tokens, ``max_segments`` items and, if a ``loss`` column is given,
    ``max_loss`` loss-bearing tokens. Items that fill a sequence are not searched for partners. The rest is dealt
    into shards of about ``shard_items`` rows by row number, whatever their ids, so no key makes a shard large; a
    shard is packed by ``pack_shard`` in one task. Items must have 1 to max_tokens tokens; null counts as 0 and an
    item of 0 tokens takes up a segment. The items are written to the shared folder, which fixes their numbers.
    An empty table stays empty.
    """
    rows = materialized(items)
    n = rows.count()
    shards = max(1, -(-n // shard_items))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    limits = np.array([max_tokens, max_segments, *([max_loss or max_tokens] if loss else [])], float)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = table.column(tokens).fill_null(0).to_numpy().astype(np.int64)
        columns = [size, np.ones(len(size)), *([table.column(loss).fill_null(0).to_numpy()] if loss else [])]
        demand = np.stack(columns, axis=1).astype(float)
        full = size >= max_tokens
        bins, ranks = np.arange(len(size)), np.zeros(len(size), np.int64)
        part, part_ranks = pack_shard(demand[~full], limits)
        bins[full] = np.arange(full.sum())
        bins[~full], ranks[~full] = part + full.sum(), part_ranks
        order = np.lexsort((ranks, bins))
        upto = np.cumsum(size[order])
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        starts = np.maximum.accumulate(np.where(first, upto - size[order], 0))
        offset = np.empty(len(size), np.int64)
        offset[order] = upto - size[order] - starts
        ids = (np.int64(key[0].as_py()) << 32) + bins
        return table.drop_columns(["_shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Pieces of all documents with their places. A piece's first token has no context and so bears no loss.

    Repeated rows are packed once each; rows without id too. Columns beyond the two named are ignored.
    """
    cut = pieces(docs, tokenizer_file, limits.get("max_tokens", LENGTH), doc_id=doc_id, text=text)
    placed = pack(cut.withColumn("loss_tokens", F.col("length") - 1), loss="loss_tokens", **limits)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")
