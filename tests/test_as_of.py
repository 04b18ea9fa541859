"""As-of joins and evidence with asset history."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from plantpulse.operators import evidence as ev
from plantpulse.operators.series import as_of_join
from plantpulse.plans import queries

START = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cell", ["1 minute", "1 hour", "30 days"])
def test_as_of_join_equals_brute_force(spark, cell):
    rng = np.random.default_rng(6)
    key = lambda: (None, "hot", "hot", "hot", "cold")[rng.integers(5)]
    at = lambda: None if rng.random() < 0.02 else START + timedelta(minutes=int(rng.integers(0, 600)))
    left = [(key(), at(), f"a{i:04d}") for i in range(500)]
    right = [(key(), at(), f"w{i:04d}", None if i % 9 == 0 else int(i)) for i in range(300)] + [("late", START + timedelta(days=9), "w", 1)]
    a = spark.createDataFrame(left, "k string, at timestamp_ntz, id string").repartition(5)
    b = spark.createDataFrame(right, "k string, w_at timestamp_ntz, w string, n int").repartition(3)
    want = set()
    for k, t, i in left:
        rows = [(s, w, n) for rk, s, w, n in right if k is not None and rk == k and s is not None and t is not None and s <= t]
        want.add((k, t, i, max(rows, key=lambda r: r[:2]) if rows else None))
    got = {(r.k, r.at, r.id, tuple(r.found) if r.found else None) for r in as_of_join(a, b, ["k"], "at", "w_at", ["w"], "found", cell).collect()}
    assert got == want
    assert as_of_join(a, b.limit(0), ["k"], "at", "w_at", ["w"], "found", cell).filter("found IS NOT NULL").count() == 0
    assert as_of_join(a.limit(0), b, ["k"], "at", "w_at", ["w"], "found", cell).count() == 0


def test_evidence_text_is_canonical_json_with_context(spark):
    rows = ev.evidence_json(queries.evidence_in_context(spark, SF)).collect()
    assert rows and any(r.work_order_context for r in rows) and any(r.failure_mode_context for r in rows)
    for r in rows:
        doc = json.loads(r.evidence_json)
        assert list(doc) == sorted(doc) == sorted(c for c in r.asDict() if c != "evidence_json")
        text = r.evidence_json
        assert ": " not in text.replace(r.tenant_id, "") or json.loads(text) == doc
        assert json.dumps(doc, separators=(",", ":"), ensure_ascii=False) == text
        assert doc["work_order_context"] is None or doc["work_order_context"]["work_order_id"] == r.work_order_context.work_order_id


def test_recommendations_name_the_failure_mode(spark):
    got = queries.QUERIES["recommendations_in_context"](spark, SF).collect()
    assert any(r.related_failure_modes for r in got)
