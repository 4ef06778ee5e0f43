"""The pane tree against plain sums over panes."""

import random

import pytest

from plugload.schema import PLUG
from plugload.streaming import panes as T


def served(level, node, width, top):
    size, start = 1 << level, node << level
    inside = lambda a, b, e: e - width <= a and b <= e
    ends = range(start, start + 2 * width + 4 * size)
    if level == top:
        return [e for e in ends if inside(start, start + size, e)]
    a = start if node % 2 == 0 else start - size
    return [e for e in ends if inside(start, start + size, e) and not inside(a, a + 2 * size, e)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 24])
def test_windows_are_sums_of_panes(spark, width):
    """Panes come in batches of any size; every window equals the sum of its panes, from the folders that are named only."""
    rng, top = random.Random(width), T.top_level(width)
    counts = {q: {(plug, v): rng.randint(1, 3) for plug in range(2) for v in range(3) if rng.random() < 0.5} for q in range(100, 170)}
    rows = lambda qs: spark.createDataFrame(
        [(0, 0, plug, float(v), n, q) for q in qs for (plug, v), n in counts[q].items()],
        "house_id int, household_id int, plug_id int, value double, n bigint, pane bigint",
    )
    schema = "house_id int, household_id int, plug_id int, value double, n bigint, level int, node bigint"
    stored, kept, before, batch = {}, {}, 100, 0
    while before < 170:
        newest = min(before + rng.choice([1, 1, 2, 5, 20]), 170)
        wanted = T.left_of(before, newest, top)
        old = [tuple(r) for (b, level), some in stored.items() for r in some if (level, r[6]) in wanted]
        assert {(r[5], r[6]) for r in old} <= set(wanted)
        made = T.new_nodes(rows(range(before, newest)), spark.createDataFrame(old, schema), before, newest, top)
        for r in made.select(*PLUG, "value", "n", "level", "node").collect():
            stored.setdefault((batch, r["level"]), []).append(tuple(r))
        kept[batch] = (before, newest)
        first = before + 1
        some = [r for key in T.needed(kept, first, newest, width, top) for r in stored.get(key, [])]
        got = T.windows_of_nodes(spark.createDataFrame(some, schema), first, newest, width, top).collect()
        want = {}
        for e in range(first, newest + 1):
            for q in range(max(e - width, 100), e):
                for (plug, v), n in counts[q].items():
                    want[plug, e, float(v)] = want.get((plug, e, float(v)), 0) + n
        assert {(r["plug_id"], r["window"], r["value"]): r["n"] for r in got} == want
        kept = {b: x for b, x in kept.items() if x[1] > newest - width}
        before, batch = newest, batch + 1


def test_a_day_of_minutes_reads_few_folders():
    """24 h at 1 min, a micro-batch a minute: about 2 log2(1440) folders of 1,440, and they make up the window exactly."""
    width = 1440
    top = T.top_level(width)
    for last in range(5000, 5300, 7):
        kept = {q: (q - 1, q) for q in range(last - width, last + 1)}
        folders = T.needed(kept, last, last, width, top)
        assert len(folders) <= 2 * (top + 1)
        nodes = [(level, (batch >> level) - 1) for batch, level in folders]
        covered = sorted(q for level, node in nodes for q in range(node << level, (node + 1) << level))
        assert covered == list(range(last - width, last))
        assert len(T.left_of(last - 1, last, top)) <= top


def test_ranges_equal_the_definition(spark):
    width = 13
    top = T.top_level(width)
    nodes = [(0, 0, 0, 1.0, 1, level, node) for level in range(top + 1) for node in range(8, 16)]
    frame = spark.createDataFrame(nodes, "house_id int, household_id int, plug_id int, value double, n bigint, level int, node bigint")
    for level in range(top + 1):
        for node in range(8, 16):
            one = frame.where(f"level = {level} and node = {node}")
            got = sorted(r["window"] for r in T.windows_of_nodes(one, 0, 10_000, width, top).collect())
            assert got == served(level, node, width, top), (level, node)
