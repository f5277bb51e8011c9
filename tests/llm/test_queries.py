"""Every registered query of the subpackage runs and gives rows of the right shape."""

from __future__ import annotations

import pytest

from measura.llm import registry

QUERIES, _ = registry.collect()
COLUMNS = {"p1_found": "rec_kind rec_id field_name", "p2_found": "rec_kind rec_id field_name", "p3_found": "rec_kind rec_id issue language_code", "p5_found": "attempt_id first_cue_id last_cue_id", "p6_found": "song_id artist_id", "p7_ids": "doc_id ids", "p9_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    assert rows or name in ("p9_found", "p6_found")
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
