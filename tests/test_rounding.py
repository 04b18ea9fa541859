"""Results that lie half-way between two roundings."""

from __future__ import annotations

import duckdb
from compare import difference

from plantpulse.plans.queries import QUERIES
from plantpulse.plans.twins import TWINS


def test_rules_apply_rounds_a_half_up_in_the_query_and_its_twin(spark, tmp_path):
    """A gap of 65.9206165 minutes: its double times 10^6 lies below the half, its text does not."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES
      (1::BIGINT, TIMESTAMP '2024-01-01 00:00:00', 3::BIGINT, 'view', 1.0::DOUBLE),
      (2, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 3955236990 MICROSECONDS, 3, 'view', 2.0))
      t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["rules_apply"](spark, str(tmp_path))
    assert [r.observed_value for r in got.collect()] == [65.920617]
    assert difference(got, con, TWINS["rules_apply"]) is None
