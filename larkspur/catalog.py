"""The registered queries and their SQL."""

from __future__ import annotations

from larkspur.plans import books, decisions, explanations, features, ledgers, performance, relational, reversions, series, signals, states, studies, surfaces, valuation, writes

ALL = {**relational.QUERIES, **series.QUERIES, **performance.QUERIES, **valuation.QUERIES, **signals.QUERIES, **studies.QUERIES, **decisions.QUERIES, **explanations.QUERIES, **surfaces.QUERIES, **ledgers.QUERIES, **books.QUERIES, **features.QUERIES, **reversions.QUERIES, **writes.QUERIES, **states.QUERIES}
FLAGSHIP = relational.snapshot


def queries():
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
