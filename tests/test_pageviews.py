"""The page-view source against landed files and a service that fails."""

from __future__ import annotations

import json

import pytest

from cardloom.sources import files, pageviews


def asked(folder):
    return {p.name.removeprefix("asked-"): int(p.read_text()) for p in folder.glob("asked-*")}


def test_landed_months_equal_the_file_reader(spark, tmp_path):
    for month, rows in {"2026-01": [("A_b", 3, 1), ("C", 2, 2)], "2026-02": [("A_b", 9, 1)]}.items():
        (tmp_path / f"month={month}").mkdir()
        (tmp_path / f"month={month}" / "top.json").write_text(json.dumps([{"article": a, "views": v, "rank": r} for a, v, r in rows]))
    views, failed = pageviews.monthly_views(spark, ["2026-01", "2026-02", "2026-01"], "cardloom.sources.pageviews:landed", folder=str(tmp_path))
    assert sorted(map(tuple, views.collect())) == sorted(map(tuple, files.monthly_views(spark, f"file://{tmp_path}").collect())) and failed.count() == 0
    assert views.rdd.getNumPartitions() == 2


def test_failures_are_tried_again_and_listed(spark, tmp_path):
    months = [f"2026-0{k}" for k in range(1, 5)]
    views, failed = pageviews.monthly_views(spark, months, "tests.fetchers:unsteady", skip_missing=True, folder=str(tmp_path), pause="0.01")
    assert sorted({r["month"] for r in views.collect()}) == ["2026-01", "2026-02"] and asked(tmp_path) == {"2026-01": 1, "2026-02": 3, "2026-03": 3, "2026-04": 1}
    assert sorted(map(tuple, failed.collect())) == [("2026-03", "HTTP 404", 3), ("2026-04", "HTTP 403", 1)]
    strict, _ = pageviews.monthly_views(spark, months[:3], "tests.fetchers:unsteady", folder=str(tmp_path), pause="0")
    with pytest.raises(Exception, match="failed to fetch 2026-03"):
        strict.collect()
    with pytest.raises(Exception, match="names no month"):
        pageviews.monthly_views(spark, [])[0].collect()
