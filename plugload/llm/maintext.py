"""Main text of web pages: markup first, and a host suffix array where markup does not tell."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plugload.llm.common import released, slices
from plugload.operators.blocks import running
from plugload.session import materialized
from plugload.settings import Settings

#: A substring of so many words that so many distinct pages of a host share is boilerplate.
MIN_WORDS = 8
MIN_PAGES = 3
#: Hosts of more suffixes than window_rows are sorted in blocks.
ARRAY = Settings(window_rows=1 << 20)
#: Words of one task of the count that finds what pages can share, and the bits of the map of what it found.
PACK_WORDS = 8 << 20
MIN_PACKS = 64
MAP_BITS = 27
CHUNK_BITS = 17

# Element names by their role in HTML, and words that name boilerplate in classes and ids.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas select button textarea menu dialog audio video math".split()
)
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())

# A part of a class or id that says something about the element's surroundings, not what the element is.
QUALIFIERS = frozenset("has have no not non with without is free less above below before after".split())

# An attribute may have stray quotes in its name, as browsers read them; a value that opens a quote must close it.
_NAME = r"[^\s/>][^\s/>=]*"
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*"
_PAIR = rf"{_NAME}(?:\s*=\s*(?:{_VALUE}))?"
_REST = rf"(?:[\s/]++|{_PAIR})*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?>"
    rf"|<(?P<raw>script|style|textarea|iframe|title|noembed|noframes)(?=[\s/>]){_REST}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_REST})(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*=\s*({_VALUE}))?")


def _attributes(rest: str) -> dict[str, str]:
    """Values by lower-case name; of an attribute that is given twice the first counts."""
    found: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(rest):
        found.setdefault(key.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def _names_boilerplate(value: str, whole: bool) -> bool:
    """Whether a class or id names boilerplate, by whole tokens or also by parts of tokens such as ``site-header``.

    A token with a qualifier, such as ``has-ads-below`` or ``no-sidebar``, speaks of something else.
    """
    for token in value.split():
        if token.lower() in BOILERPLATE:
            return True
        parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
        if not whole and parts & BOILERPLATE and not parts & QUALIFIERS:
            return True
    return False


def _unwanted(name: str, found: dict[str, str], in_main: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_main):
        return True
    if name in ("html", "body") or not found:
        return False
    if any(_names_boilerplate(found.get(key, ""), name in ("article", "main")) for key in ("class", "id")):
        return True
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def page_blocks(page: str) -> tuple[list[str], bool]:
    """Text blocks in page order, and whether an article or main element declares them, see ``page_parts``."""
    kept, _, declared = page_parts(page)
    return kept, declared


def page_parts(page: str) -> tuple[list[str], list[str], bool]:
    """Text blocks in page order, those outside of the element that declares the text, and whether there is one.

    Block elements part blocks, inline elements and line breaks do not. Menus, headers, footers, sidebars, notices,
    adverts, forms, comments, scripts, styles and hidden elements are left out by element, role, class or id. If the
    page has article or main elements, only blocks within them count. An article whose class or id is itself a
    boilerplate word, as that of a reader comment, is left out like any other element. Stray quotes in a tag belong to
    the tag, as in browsers.
    """
    blocks: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, within main
    parts: list[str] = []
    state = (False, False)
    declared = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((state[1], text))
            parts.clear()

    def pop(depth: int) -> None:
        nonlocal state
        del stack[depth:]
        state = stack[-1][1:] if stack else (False, False)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not state[0]:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop(depth)
                    break
            continue
        if name in BLOCKS:
            closes = ("p",) if name not in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p", name)
            while stack and (stack[-1][0] in closes or (stack[-1][0] not in BLOCKS and any(x[0] == "p" for x in stack[-3:]) and "p" in closes)):
                pop(len(stack) - 1)
        if name in VOID or m["rest"].endswith("/"):
            continue
        found = _attributes(m["rest"])
        main = state[1] or name in ("article", "main") or found.get("role", "").lower() == "main"
        dropped = state[0] or _unwanted(name, found, state[1])
        declared |= main and not dropped
        stack.append((name, dropped, main))
        state = (dropped, main)
    if at < len(page) and not state[0]:
        parts.append(page[at:])
    flush()
    return [t for main, t in blocks if main or not declared], [t for main, t in blocks if declared and not main], declared


# -- host suffix array ------------------------------------------------------------------------------------------------------


def suffix_heads(streams: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, position, head) of all suffixes of at least ``width`` words, in suffix order.

    The streams are laid end to end with a unique mark after each. Ranks of single words are doubled to ranks of 2, 4,
    ... words and, for the last step, of ``width`` words; sorting by rank is the suffix array up to that depth, and
    suffixes of equal rank are the ones that share ``width`` words or more. head is a hash of these words that tasks
    agree on.
    """
    words = [w for s in streams for w in s]
    sizes = np.array([len(s) for s in streams], np.int64)
    stream = np.repeat(np.arange(len(streams)), sizes)
    position = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero(position + width <= sizes[stream]) if len(words) else np.empty(0, np.int64)
    if not len(whole):
        return stream[:0], position[:0], np.empty(0, np.int64)
    rank = np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), return_inverse=True)[1]
    depth = 1
    while depth < width:
        step = min(depth, width - depth)
        after = np.append(rank, np.full(step, -1))[step : step + len(rank)]
        rank = np.unique(rank * np.int64(len(rank) + 2) + after + 1, return_inverse=True)[1]
        depth += step
    order = whole[np.argsort(rank[whole], kind="stable")]
    new = np.append(True, rank[order][1:] != rank[order][:-1])
    digest = xxhash.xxh3_64_intdigest
    named = np.array([digest(" ".join(words[i : i + width])) for i in order[new]], np.uint64).view(np.int64)
    return stream[order], position[order], named[np.cumsum(new) - 1]


def window_keys(words: list[str], host: str, width: int, part: int) -> np.ndarray:
    """A number per suffix of at least ``width`` words: equal for suffixes of a host that share their first ``width`` words.

    It is the least hash of ``part`` words in a row within them. Neighbours have it in common, so a page has fewer of
    them than of suffixes.
    """
    if len(words) < width:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    mixed = np.full(len(words) - part + 1, xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(part):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(33)
    return mixed if part == width else np.lib.stride_tricks.sliding_window_view(mixed, width - part + 1).min(axis=1)


def _streams(blocks: list[str] | None, outside: list[str] | None) -> tuple[list[str], list[str]]:
    return " ".join(blocks or []).split(), " ".join(outside or []).split()


def _parts(width: int) -> tuple[int, int]:
    """The lengths of what is hashed: two thirds of the words in the first count, all of them in the second."""
    return max(1, 2 * width // 3), width


def _picked(maps: list[dict[int, bytes]], width: int):
    """Function of words and host: which suffixes have their keys in all maps."""
    held = []
    for chunks in maps:
        held.append(np.zeros(1 << MAP_BITS - 3, np.uint8))
        for chunk, bits in chunks.items():
            held[-1][chunk << CHUNK_BITS - 3 : chunk + 1 << CHUNK_BITS - 3] = np.frombuffer(bits, np.uint8)

    def pick(words: list[str], host: str) -> np.ndarray:
        mask = np.ones(max(0, len(words) - width + 1), bool)
        for on, part in zip(held, _parts(width)):
            if mask.any():
                at = (window_keys(words, host, width, part) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                mask &= on[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
        return mask

    return pick


def _counted(pages: DataFrame, width: int, packs: int, subs: int, maps: list[dict[int, bytes]]) -> DataFrame:
    """(bucket, open, pages, counts, keys): the keys of all pages, packed; a host goes to ``subs`` buckets by key.

    In the second count these are the keys of what the first one left.
    """
    part, before = _parts(width)[len(maps)], pages.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = _picked(before.value, width)
        for batch in batches:
            found: dict[tuple[int, bool], tuple[list, list, list]] = {}
            for host, page, blocks, outside, declared in zip(*(c.to_pylist() for c in batch.columns)):
                pack = xxhash.xxh3_64_intdigest(host) % packs * subs
                for words in _streams(blocks, outside):
                    mask = pick(words, host)
                    if not mask.any():
                        continue
                    keys = np.unique(window_keys(words, host, width, part)[mask])
                    place = (keys >> np.uint64(48)).astype(np.int64) % subs
                    for sub in np.unique(place).tolist():
                        some = keys[place == sub]
                        lists = found.setdefault((pack + sub, not declared), ([], [], []))
                        for held, value in zip(lists, (page, len(some), some.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())):
                            held.append(value)
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in found], pa.int32()), pa.array([o for _, o in found], pa.bool_()),
                    pa.array([np.array(p, np.int64).tobytes() for p, _, _ in found.values()], pa.binary()),
                    pa.array([np.array(n, np.int32).tobytes() for _, n, _ in found.values()], pa.binary()),
                    pa.array([b"".join(k) for _, _, k in found.values()], pa.binary()),
                ], ["bucket", "open", "pages", "counts", "keys"])

    rows = pages.select("host", "page", "blocks", "outside", "declared")
    return rows.mapInArrow(released(run), "bucket int, open boolean, pages binary, counts binary, keys binary")


def _keys(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def _often(keys: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """The keys that so many distinct pages have, in order."""
    order = np.lexsort((pages, keys))
    keys, pages = keys[order], pages[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (pages[1:] != pages[:-1]))[: len(keys)]
    found, count = np.unique(keys[new], return_counts=True)
    return found[count >= least]


def removable_maps(pages: DataFrame, width: int, least: int) -> list[dict[int, bytes]]:
    """Bits by chunk, set for the keys of all suffixes that ``extract`` may remove; none without any.

    These are in the text of a page that does not declare it and on min_pages distinct pages of the host, of
    whatever kind. Keys are counted first for parts of the words, of which there are fewer, then for all the words. A bit
    may stand for several keys; the array then decides by the words.
    """
    words = sum((F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + F.length(b)) for c in ("blocks", "outside")), F.lit(0))
    sizes = pages.groupBy("host").agg((F.sum(words) / 6).cast("long").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    packs, subs = max(MIN_PACKS, -(-total // PACK_WORDS)), max(1, -(-largest // PACK_WORDS))
    slot, bit = np.int64((1 << MAP_BITS) - 1), CHUNK_BITS

    def shared(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c.as_py(), np.int32) for c in table.column("counts")]
        page = [np.repeat(np.frombuffer(p.as_py(), np.int64), n) for p, n in zip(table.column("pages"), counts)]
        keys = [_keys(k.as_py()) for k in table.column("keys")]
        often = _often(np.concatenate(keys), np.concatenate(page), least)
        opened = [k for k, o in zip(keys, table.column("open").to_pylist()) if o]
        at = np.unique(np.intersect1d(often, np.concatenate([np.empty(0, np.int64), *opened])) & slot)
        return pa.table({"chunk": pa.array(at >> bit, pa.int64()), "at": pa.array(at & ((1 << bit) - 1), pa.int64())})

    def bits(key: tuple, table: pa.Table) -> pa.Table:
        on = np.zeros(1 << bit, np.uint8)
        on[np.asarray(table.column("at"))] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    maps: list[dict[int, bytes]] = []
    for _ in _parts(width):
        found = _counted(pages, width, packs, subs, maps).groupBy("bucket").applyInArrow(shared, "chunk bigint, at bigint").distinct()
        chunks = found.groupBy("chunk").applyInArrow(bits, "chunk bigint, bits binary").collect()
        if not chunks:
            return []
        maps.append({r["chunk"]: bytes(r["bits"]) for r in chunks})
    return maps


def _suffixes(pages: DataFrame, width: int, maps: list[dict[int, bytes]] | None = None) -> DataFrame:
    """(host, page, position, suffix) of the word streams of all pages, sorted within a batch; blocks are part of one stream.

    suffix has the first ``width`` words, by which the array is sorted. The blocks outside of the declared text (outside,
    if there is such a column) are a stream of their own with positions -1, -2, ... With maps only suffixes in them count.
    """
    both = "outside" in pages.columns
    given = pages.sparkSession.sparkContext.broadcast(maps) if maps is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = _picked(given.value, width) if given is not None else None
        for batch in batches:
            streams, owner, is_outside, masks = [], [], [], []
            lists = [batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist() if both else [None] * batch.num_rows]
            for i, (host, blocks, outside) in enumerate(zip(*lists)):
                for k, words in enumerate(_streams(blocks, outside)):
                    if pick is not None:
                        mask = pick(words, host)
                        if not mask.any():
                            continue
                        masks.append(np.append(mask, np.zeros(len(words) - len(mask), bool)))
                    streams.append(words)
                    owner.append(i)
                    is_outside.append(k == 1)
            stream, position, head = suffix_heads(streams, width)
            if pick is not None and len(stream):
                wanted = np.concatenate(masks)[np.append(0, np.cumsum([len(w) for w in streams]))[stream] + position]
                stream, position, head = stream[wanted], position[wanted], head[wanted]
            new = np.append(True, head[1:] != head[:-1])[: len(head)]
            texts = [" ".join(streams[s][p : p + width]) for s, p in zip(stream[new], position[new])]
            rows = pa.array(np.array(owner, np.int64)[stream])
            suffix = pa.array(texts, pa.string()).take(pa.array(np.cumsum(new) - 1))
            position = np.where(np.array(is_outside, bool)[stream], -1 - position, position)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(position), suffix], ["host", "page", "position", "suffix"]
            )

    columns = ["host", "page", "blocks", *(["outside"] if both else [])]
    return pages.select(*columns).mapInArrow(run, "host string, page bigint, position bigint, suffix string")


def host_suffix_array(pages: DataFrame, width: int, s: Settings = ARRAY, maps: list[dict[int, bytes]] | None = None) -> DataFrame:
    """(host, page, position, run): the suffixes of all pages (host, page, blocks) of a host in the order of its suffix array.

    Suffixes of the host are sorted to a depth of ``width`` words, each meets the one before it, and a run goes on while
    both have ``width`` words in common; runs are numbered in order from 1. Hosts of more than ``window_rows`` suffixes are
    cut into blocks, so a host is not one task. With the maps of ``removable_maps`` the array is that of the suffixes in
    them, in which no run that counts is shorter; pages may then be repeated.
    """
    order = ["suffix", "page", "position"]
    rows = _suffixes(pages, width, maps)
    if maps is not None:
        rows = materialized(rows.dropDuplicates(["host", "page", "position"]))
    pairs = materialized(running(rows, ["host"], order, s, previous={"before": F.col("suffix")}))
    begins = F.when(F.col("before") == F.col("suffix"), 0).otherwise(1).cast("bigint")
    return running(pairs, ["host"], order, s, sums={"run": begins}).select("host", "page", "position", "run")


def keep_unique(blocks: list[str], starts: list[int], width: int) -> list[str]:
    """The blocks without the words that repeated substrings cover.

    Substrings may span blocks, as menus do. A block loses what is covered if that is all of it or a run of at least
    ``width`` words, but not the few words by which a substring reaches into it.
    """
    covered, at, kept = {p + k for p in starts for k in range(width)}, 0, []
    for block in blocks:
        words, left, run = block.split(" "), [], []
        for i, w in enumerate([*words, None], at):
            if w is not None and i in covered:
                run.append(w)
                continue
            if len(run) < min(width, len(words)):
                left += run
            run = []
            left += [w] if w is not None else []
        if left:
            kept.append(" ".join(left))
        at += len(words)
    return kept


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "html", min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(page_id, url, text): the main text of every page, its blocks joined by blank lines.

    Where an article or main element declares the text, markup decides; in the text of other pages the suffix array of the
    host does. It is that of all pages of the host, whether they declare their text or not, within and outside of what they
    declare: substrings of min_words or more words that min_pages distinct pages share are boilerplate, and only
    unique runs of the blocks stay. The suffixes of all pages are counted first by hashes of what they begin with; those that can
    be boilerplate are sorted in tasks and merged into the array of the host, whose runs of neighbours with min_words words in
    common are counted by distinct pages, with partial aggregation. A host with a third of all pages is cut into
    blocks. Pages of a host with equal html count once and have equal results. Null and empty html give an empty text; a null
    URL is a host of its own. Repeated rows stay, an empty table stays empty, further columns are ignored.
    """
    ids = pages.schema[page_id].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hosts, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            blocks, outside, declared = zip(*map(page_parts, texts)) if texts else ((), (), ())
            page = [xxhash.xxh3_64_intdigest(f"{h}\n{x}") - (1 << 63) for h, x in zip(hosts, texts)]
            some = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(page, pa.int64()), pa.array(blocks, some), pa.array(outside, some), pa.array(declared, pa.bool_())],
                ["page_id", "url", "host", "page", "blocks", "outside", "declared"],
            )

    schema = f"page_id {ids}, url string, host string, page bigint, blocks array<string>, outside array<string>, declared boolean"
    parsed = materialized(rows.mapInArrow(run, schema), compression="zstd")
    marked = F.array_join("blocks", "\n\n").alias("text")
    maps = removable_maps(parsed, min_words, min_pages)
    if not maps:
        return parsed.select("page_id", "url", marked)
    array = materialized(host_suffix_array(parsed.select("host", "page", "blocks", "outside"), min_words, maps=maps))
    shared = array.select("host", "run", "page").distinct().groupBy("host", "run").count().where(F.col("count") >= min_pages)
    covered = array.where("position >= 0").join(shared.select("host", "run"), ["host", "run"], "left_semi")
    # Written, so that its size is known and a small one does not make the texts travel.
    lists = materialized(covered.groupBy("page").agg(F.collect_set("position").alias("starts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(keep_unique(b, s, min_words)) for b, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = parsed.join(lists, "page", "left")
    clear = joined.where("declared or starts is null").select("page_id", "url", marked)
    left = joined.where("not declared and starts is not null").select("page_id", "url", "blocks", "starts")
    return clear.union(left.mapInArrow(cut, f"page_id {ids}, url string, text string"))
