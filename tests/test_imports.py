"""Shard imports that are stopped at every step, and tables that are published together."""

from __future__ import annotations

import datetime as dt
import json

import pytest
import zstandard

from cardloom.operators import state
from cardloom.plans import corpus
from cardloom.sources import versioned
from cardloom.streaming import imports

NOW = dt.datetime(2026, 1, 1, 12)


def shard(folder, n, ids, bad=()):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"page_id": i, "title": f"t{i}", "source_url": "u", "clean_text": f"x{n}"}) for i in ids] + ["", *bad]
    (folder / f"shard-{n:05d}.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))


def run(spark, where, **more):
    report: list = []
    query = imports.import_shards(spark, f"file://{where}/in", f"file://{where}/out", f"file://{where}/stream", now=lambda: NOW, files=1, report=report, **more)
    query.awaitTermination()
    return report


def pages(spark, where):
    return sorted((r["page_id"], r["clean_text"]) for r in imports.imported(spark, f"file://{where}/out").collect())


def plan(spark, where, now=NOW):
    return imports.import_plan(spark, f"file://{where}/in", f"file://{where}/out", now).first().asDict()


BAD = ('{"page_id": 7, "title"', "[1]", '{"title": "no id"}', '{"page_id": "x"}', "  plain text")


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    shard(tmp_path / "in" / "split-0", 0, [1, 2], BAD)
    assert plan(spark, tmp_path)["todo"] == plan(spark, tmp_path)["pending"] == 1
    report = run(spark, tmp_path)
    assert pages(spark, tmp_path) == [(1, "x0"), (2, "x0")]
    assert sorted(r["line"] for r in imports.quarantined(spark, f"file://{tmp_path}/out").collect()) == sorted(BAD)
    rate = imports.import_rate(report)
    assert (rate["documents"], rate["bad_lines"]) == (2, 5) and rate["documents_per_second"] > 0
    shard(tmp_path / "in" / "split-1", 1, [2, 3])
    run(spark, tmp_path)
    assert pages(spark, tmp_path) == [(1, "x0"), (2, "x1"), (3, "x1")]  # a later import of a page counts
    assert plan(spark, tmp_path) == {"shards": 2, "completed": 2, "failed": 0, "running": 0, "stale": 0, "pending": 0, "documents": 4, "bad_lines": 5, "todo": 0}


@pytest.mark.parametrize("stop", (1, 2, 4))
def test_a_run_that_is_killed_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stop):
    """The stop-th version is written to its folders, but the run dies before it is listed."""
    for n in range(2):
        shard(tmp_path / "in", n, [10 * n, 10 * n + 1], BAD[:1])
    create, count = versioned._Files.create, [0]

    def dying(self, name, text):
        count[0] += 1
        if count[0] >= stop:  # a dead process writes nothing more
            raise RuntimeError("killed")
        create(self, name, text)

    monkeypatch.setattr(versioned._Files, "create", dying)
    with pytest.raises(Exception):  # noqa: B017
        run(spark, tmp_path)
    monkeypatch.setattr(versioned._Files, "create", create)
    run(spark, tmp_path)
    rows = versioned.read(spark, f"file://{tmp_path}/out", "documents")
    assert sorted(r["page_id"] for r in rows.collect()) == [0, 1, 10, 11]
    assert imports.quarantined(spark, f"file://{tmp_path}/out").count() == 2 and plan(spark, tmp_path)["completed"] == 2


def test_a_batch_that_is_played_again_adds_nothing(spark, tmp_path):
    shard(tmp_path / "in", 0, [1, 2], BAD)
    run(spark, tmp_path)
    imports.import_shards(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/other-stream", now=lambda: NOW).awaitTermination()
    assert versioned.read(spark, f"file://{tmp_path}/out", "documents").count() == 2


def test_claims_of_other_workers(spark, tmp_path):
    shard(tmp_path / "in", 0, [1])
    root = f"file://{tmp_path}/out"
    name = imports.shards_in(spark, f"file://{tmp_path}/in").first()["shard"]
    lines = spark.createDataFrame([('{"page_id": 1}', name)], "value string, shard string")
    imports._publish(spark, root, {"shards": spark.createDataFrame([(name, "running", "other", NOW, None, None, None)], imports._STATES)})
    with pytest.raises(imports.ClaimedElsewhere):
        imports.import_batch(lines, root, "me", NOW + dt.timedelta(minutes=5))
    assert plan(spark, tmp_path, NOW + dt.timedelta(minutes=5))["running"] == 1
    later = NOW + dt.timedelta(hours=1)
    assert plan(spark, tmp_path, later)["stale"] == plan(spark, tmp_path, later)["todo"] == 1
    done = imports.retry(spark, f"file://{tmp_path}/in", root, "me", now=lambda: later)
    assert done["documents"] == 1 and imports.retry(spark, f"file://{tmp_path}/in", root, "me", now=lambda: later) is None


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/graph"
    edges = lambda *rows: spark.createDataFrame(rows, "node_a_id long, node_b_id long, strength double")
    state.replace_edges(edges((1, 2, 0.5)), root)
    create = versioned._Files.create
    monkeypatch.setattr(versioned._Files, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        state.replace_edges(edges((3, 4, 0.5), (4, 5, 0.5)), root)
    monkeypatch.setattr(versioned._Files, "create", create)
    both = lambda: (versioned.read(spark, root, "edges").count(), versioned.read(spark, root, "adjacency").count())
    assert both() == (1, 2)
    state.replace_edges(edges((3, 4, 0.5), (4, 5, 0.5)), root)
    assert both() == (2, 4) and versioned.current(spark, root).number == 1
    assert len(versioned.vacuum(spark, root)) == 5 and both() == (2, 4)  # a list, and two folders each of the first version and of the stopped one
    with pytest.raises(Exception, match="already exists"):
        versioned._Files(spark, root).create(f"{root}/_versions/{1:020d}.json", "{}")


def test_shards_of_a_query_grow_in_number_not_in_size(spark, monkeypatch, tmp_path):
    sf = "/root/testdata/sf0.001"
    before = sorted(map(str, corpus.shard_import(spark, sf).collect()))
    folders: list[str] = []
    own = versioned.own_folder
    monkeypatch.setattr(versioned, "own_folder", lambda spark, name: folders.append(own(spark, name)) or folders[-1])
    monkeypatch.setattr(corpus, "SHARD_CHARS", 50_000)
    assert sorted(map(str, corpus.shard_import(spark, sf).collect())) == before
    text = spark.read.text(f"{folders[0]}/shards").selectExpr("length(value) n", "input_file_name() f").groupBy("f").sum("n").collect()
    assert len(text) > 5 and max(r["sum(n)"] for r in text) < 200_000
