import random

import pytest

from plugload.plans import outliers as O
from plugload.settings import Settings
from plugload.sources.readings import load_only

HOUR = 3_600_000
PLANS = [Settings(), Settings(group_rows=1, window_rows=1, block_rows=16)]


def replay(rows, width):
    """One reading after the other with plain dictionaries; readings of one millisecond see each other."""
    rows = sorted((r for r in rows if len(r) < 7 or r[6] == 1), key=lambda r: (r[1], r[0]))
    houses, out = {}, []

    def middle(values):
        values = sorted(values)
        return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2

    for i, t, _, house, household, plug in (r[:6] for r in rows):
        seen = [r for r in rows if t - width < r[1] <= t]
        flag = middle([r[2] for r in seen if r[3:6] == (house, household, plug)]) > middle([r[2] for r in seen])
        flags = houses.setdefault(house, {})
        if flags.get((household, plug)) is not flag:
            flags[(household, plug)] = flag
            out.append((i, house, round(100.0 * sum(flags.values()) / len(flags), 9)))
    return out, houses


def random_rows(seed, n=250):
    rng = random.Random(seed)
    return [
        (i, 10 * HOUR + (7 if i % 9 == 0 else rng.randrange(5 * HOUR)), rng.randrange(50),
         0 if i % 3 == 0 else rng.randrange(3), rng.randrange(2), rng.randrange(2), 0 if i % 17 == 0 else 1)
        for i in range(n)
    ]


@pytest.mark.parametrize("s", PLANS)
def test_changes_against_replay(readings, s):
    rows = random_rows(4)
    got = [(r.id, r.house_id, round(r.percentage, 9)) for r in O.outliers(readings(rows), s).orderBy("ts_ms", "id").collect()]
    assert got == replay(rows, HOUR)[0]


def test_day_window(readings):
    rows = random_rows(5)
    got = [(r.id, r.house_id, round(r.percentage, 9)) for r in O.q2b(readings(rows), Settings()).orderBy("ts_ms", "id").collect()]
    assert got == replay(rows, 24 * HOUR)[0]


def test_first_unchanged_and_flip(readings):
    # Plug 0 alone equals the global median: not above. Plug 1 is above. Plug 0 again not above: no row. Then it flips.
    rows = [(1, 1000, 5, 0, 0, 0), (2, 2000, 9, 0, 0, 1), (3, 3000, 5, 0, 0, 0), (4, 4000, 90, 0, 0, 0), (5, 5000, 99, 0, 0, 0),
            (6, 6000, 99, 0, 0, 0)]
    got = {r.id: r.percentage for r in O.outliers(readings(rows), Settings()).collect()}
    assert got == {i: p for i, _, p in replay(rows, HOUR)[0]}
    assert got[1] == 0.0 and got[2] == 50.0 and 3 not in got


def test_time_frame_earlier_first(readings):
    row = O.outliers(readings([(1, 1378604640000, 5, 0, 0, 0)]), Settings()).first()
    assert row.time_frame == "08-Sep-2013 00:44:00 TO 08-Sep-2013 01:44:00"


def test_snapshot(readings):
    rows = random_rows(6)
    flags = O.plug_flags(readings(rows), Settings())
    got = {(r.house_id, r.household_id, r.plug_id): r.flag for r in O.flag_snapshot(flags).collect()}
    houses = replay(rows, HOUR)[1]
    assert got == {(h, *p): f for h, plugs in houses.items() for p, f in plugs.items()}
    shares = {r.house_id: r.percentage for r in O.snapshot_percentage(O.flag_snapshot(flags)).collect()}
    assert shares == {h: pytest.approx(100.0 * sum(p.values()) / len(p)) for h, p in houses.items()}


@pytest.mark.parametrize("s", PLANS)
def test_measure(readings, s):
    rows = random_rows(7)
    sizes = O.measure(load_only(readings(rows)), HOUR)
    load = [r for r in rows if r[6] == 1]

    def most(key):
        counts = {}
        for r in load:
            counts[key(r)] = counts.get(key(r), 0) + 1
        return max(counts.values())

    assert sizes == O.Sizes(
        len(load), most(lambda r: r[1] // HOUR), most(lambda r: (r[3:6], r[1] // (24 * HOUR))),
        most(lambda r: r[3:6]), most(lambda r: r[3]),
    )


@pytest.mark.parametrize("s", PLANS)
def test_grid(readings, s):
    rows = random_rows(8, 120)
    got = O.grid_outliers(readings(rows), HOUR // 2, s).collect()
    plain = O.grid_outliers(readings(rows), HOUR // 2, Settings()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
    assert all(0 <= r.above_count <= r.plug_count for r in got)


def test_no_readings(readings):
    assert O.outliers(readings([]), Settings()).count() == 0
