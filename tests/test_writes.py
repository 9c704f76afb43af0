"""Upserts, inserts and replacements against dictionaries; the same batch again; nulls, ties, other columns."""

from __future__ import annotations

import random

from larkspur.sources import roles

T = "k bigint, v string, at bigint"


def test_writes_equal_dictionaries(spark):
    rng = random.Random(6)
    known, rows = {}, []
    for i in range(200):
        rows.append((rng.choice([None, *range(40)]), f"v{i}", i))
    old, new = rows[:120], rows[120:]
    for k, v, at in old:
        known[k] = (k, v, at)
    table = spark.createDataFrame(list(known.values()), T)
    # A batch may bring other columns, in another order.
    batch = spark.createDataFrame([(at, "clash", k, v) for k, v, at in new], "at bigint, more string, k bigint, v string")
    up = roles.upserted(table, batch, ["k"], "at")
    want = known | {r[0]: r for r in new}
    assert {tuple(r) for r in up.collect()} == set(want.values()) and up.count() == len(want) and up.columns == ["k", "v", "at"]
    again = roles.upserted(up, batch, ["k"], "at")
    assert sorted(map(str, again.collect())) == sorted(map(str, up.collect()))
    into = roles.inserted(table, batch, ["k"], "at")
    want = {r[0]: r for r in reversed(new)} | known
    assert {tuple(r) for r in into.collect()} == set(want.values()) and into.count() == len(want)
    assert sorted(map(str, roles.inserted(into, batch, ["k"], "at").collect())) == sorted(map(str, into.collect()))
    owned = spark.createDataFrame(old, T)
    over = roles.replaced(owned, batch, "k")
    owners = {r[0] for r in new}
    assert sorted(map(str, map(tuple, over.collect()))) == sorted(map(str, [r for r in old if r[0] not in owners] + new))


def test_empty_and_missing(spark):
    table, none = spark.createDataFrame([(1, "a", 1)], T), spark.createDataFrame([], T)
    for write in (lambda t, b: roles.upserted(t, b, ["k"], "at"), lambda t, b: roles.inserted(t, b, ["k"], "at"), lambda t, b: roles.replaced(t, b, "k")):
        assert [tuple(r) for r in write(table, none).collect()] == [tuple(r) for r in write(none, table).collect()] == [(1, "a", 1)]
    short = spark.createDataFrame([(2, 5)], "k bigint, at bigint")
    assert {tuple(r) for r in roles.upserted(table, short, ["k"], "at").collect()} == {(1, "a", 1), (2, None, 5)}
