"""The panes of operator 12, held against a plain pass over the same clicks."""

import datetime
import math
import zlib

import pytest

from codegrain.llm import panes

EPOCH = datetime.datetime(1970, 1, 1)
DAY, HOUR = datetime.timedelta(days=1), datetime.timedelta(hours=1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, hour int"


def plain(rows, n_batches):
    """What the contract says, one batch after the other, rows (click_id, ts, arrived_at, kind, value) in memory."""
    once = {}
    for click_id, ts, came, kind, value in rows:
        if ts is not None:
            once[click_id] = min(once.get(click_id, (came or ts, ts, kind or "", value)), (came or ts, ts, kind or "", value), key=lambda x: (x[0], x[1], x[2]))
    batches = [[] for _ in range(n_batches)]
    for click_id, (came, ts, kind, value) in once.items():
        day = (came - EPOCH) // DAY
        start = day % n_batches
        batch = min(n_batches - 1, start + max(0, zlib.crc32(("" if click_id is None else str(click_id)).encode()) % 30 - 23))
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        batches[batch].append((click_id, ts - EPOCH - (day - start) * DAY, kind or "none", cents))
    clock, held, shown, out = None, {}, {}, []
    over = lambda hour, more: clock is not None and clock >= (hour + 1) * HOUR + more
    for b, batch in enumerate(batches):
        fed = set()
        for click_id, at, kind, cents in batch:
            hour = at // HOUR
            if over(hour, 2 * DAY):
                out.append((b, hour, click_id, 1, cents, "late", kind))
                continue
            n, total = held.get((kind, hour), (0, 0))
            held[kind, hour] = n + 1, total + cents
            fed.add((kind, hour))
        for pane, now in list(held.items()):
            kind, hour = pane
            if pane in shown and pane in fed:
                out += [(b, hour, -1, *shown[pane], "retract", kind), (b, hour, -1, *now, "replace", kind)]
                shown[pane] = now
            elif pane not in shown and over(hour, 12 * HOUR):
                out.append((b, hour, -1, *now, "emit", kind))
                shown[pane] = now
            if over(hour, 2 * DAY):
                del held[pane]
                shown.pop(pane, None)
        clock = max([x[1] for x in batch] + ([clock] if clock is not None else []), default=None)
    return out + [(n_batches - 1, hour, -1, *now, "final", kind) for (kind, hour), now in held.items() if (kind, hour) not in shown]


def found(frame, **options):
    return sorted(map(tuple, panes.revised(frame, **options).collect()), key=repr)


@pytest.fixture
def clicks(spark):
    def at(day, hour=0.0):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)

    rows = []
    for i in range(400):
        came = at(i % 23 % 9, i * 7 % 24)
        late = datetime.timedelta(hours=[0, 0, 1, 5, 30, 70, 300][i % 7], microseconds=i)
        rows.append((i, came - late, came, [None, "view", "view", "click"][i % 4], [None, 0.005, -1.5, float("nan"), 12.345, float("inf")][i % 6]))
    rows += rows[::50] + [(7000, None, at(1), "view", 1.0), (7001, at(2), None, "view", 1.0), (None, at(1), at(1), "view", 2.0), (None, at(1), at(1), "view", 2.0)]
    # a bound of the clock on the spot, and pages of a year before 1970
    rows += [(7002 + k, at(4, h), at(4, h), "edge", 1.0) for k, h in enumerate((0.0, 11.0, 12.0, 13.0))] + [(7100, datetime.datetime(1960, 5, 5, 5), datetime.datetime(1960, 5, 5, 6), "old", 3.0)]
    return rows


def test_panes_as_a_plain_pass(spark, clicks):
    frame = spark.createDataFrame([(*r, "x", 1) for r in clicks], SCHEMA).repartition(3)
    got, want = found(frame, n_batches=4), sorted(plain(clicks, 4), key=repr)
    assert got == want
    assert {r[5] for r in got} == {"emit", "final", "late", "replace", "retract"}


def test_empty_batches_and_empty_tables(spark):
    # arrivals of day 0 alone: the batches that follow have no click, but their panes fall due
    day = datetime.datetime(2024, 1, 1) - (datetime.datetime(2024, 1, 1) - EPOCH) % (3 * DAY)
    rows = [(i, day + datetime.timedelta(hours=h), day + datetime.timedelta(hours=h), "view", 1.0) for i, h in enumerate((1, 2, 20)) if zlib.crc32(str(i).encode()) % 30 <= 23]
    assert found(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), n_batches=3) == sorted(plain(rows, 3), key=repr)
    assert any(r[0] == 1 and r[5] == "emit" for r in plain(rows, 3))
    assert found(spark.createDataFrame([], SCHEMA), n_batches=2) == []
