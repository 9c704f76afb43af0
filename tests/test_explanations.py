"""Release in order over several blocks, contributions on hand-made lines."""

from __future__ import annotations

import datetime

from larkspur.plans import explanations

T = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in range(60)]


def test_release_waits_for_earlier_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(explanations, "BLOCK", 2)
    rows = [(0, T[5], 1), (1, T[2], 1), (2, T[3], 1), (5, T[9], 1), (5, T[30], 1), (6, T[4], 1), (3, T[1], None), (4, T[0], None), (7, None, 1), (None, T[1], 1)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.user_id, r.released, r.waited) for r in explanations.barrier_release(spark, str(tmp_path)).collect()}
    assert got == {0: (1, T[5], 0.0), 1: (1, T[5], 3.0), 2: (1, T[5], 2.0), 5: (1, T[9], 0.0), 6: (1, T[9], 5.0), 3: (None, T[1], 0.0), 4: (None, T[1], 1.0)}


def test_contributions_of_an_exact_model(spark, tmp_path):
    """price = 10 + 3 * quantity - 100 * discount, so contributions are known; a line with a null is left out."""
    points = [(1.0, 0.0), (2.0, 0.1), (4.0, 0.0), (5.0, 0.1), (None, 0.1)]
    rows = [(i, 1, "A", q, d, None if q is None else 10 + 3 * q - 100 * d) for i, (q, d) in enumerate(points)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: r for r in explanations.line_attributions(spark, str(tmp_path)).collect()}
    assert {k: (r.by_quantity, r.by_discount, r.driver, r.quantity_to_mean) for k, r in got.items()} == {0: (-6.0, 5.0, "quantity", 0.333), 1: (-3.0, -5.0, "discount", 2.667), 2: (3.0, 5.0, "discount", -2.667), 3: (6.0, -5.0, "quantity", -0.333)}
    (r,) = explanations.attribution_importance(spark, str(tmp_path)).collect()
    assert (r.n, r.of_quantity, r.of_discount, r.adds_up) == (4, 4.5, 5.0, True)
