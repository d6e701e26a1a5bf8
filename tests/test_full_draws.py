"""The registered analyses draw as often as their operators do by default, over every family."""

from __future__ import annotations

from gridlens.operators import resample
from gridlens.plans import contrasts as C
from gridlens.plans import catalog_grid, catalog_ingest


def test_contrast_plan_is_whole(spark, data):
    rows = catalog_grid.contrast_plan_analysis(spark, data).collect()
    assert {r.family for r in rows} == {s.family for s in C.contrast_plan()} | {"key_secondary"}
    drawn = [r for r in rows if r.question_clusters > resample.EXACT_CLUSTERS and r.p_value is not None]
    steps = [r.p_value * 50_001 for r in drawn]
    assert drawn and all(abs(x - round(x)) < 1e-6 for x in steps)
    assert all(r.ci_low is not None for r in rows if r.question_clusters)


def test_correction_intervals_draw_by_default(spark, data, monkeypatch):
    given = []
    monkeypatch.setattr(resample, "clustered_bootstrap", lambda rows, keys, **options: given.append(options))
    catalog_ingest.correction_intervals(spark, data)
    assert given == [{"seed": 1730}]
