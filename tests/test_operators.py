"""Operators on small fixtures with results worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from cardloom.functions import layout as FL
from cardloom.functions import series
from cardloom.functions import text as T
from cardloom.functions import vectors as V
from cardloom.operators import corpus, graph, layout, search, taxonomy, usage, workflow
from cardloom.sources import embedding, files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("  Quantum   Mechanics  ", "Electronic computers. Computer science", "A%20b_c+d")], "t string, n string, u string")
    got = df.select(T.normalised(F.col("t")), T.slug(F.col("n")), T.slug(F.lit("Science (General)")), T.url_title(F.col("u")), T.url_title(F.lit("100%")), T.source_ref(F.lit(42))).first()
    assert tuple(got) == ("quantum mechanics", "electronic-computers-computer-science", "science-general", "A b c+d", "100%", "wikipedia:42")
    dots = spark.createDataFrame([(x,) for x in (-1.5, -1.0, 0.0, 0.6, 1.0, 1.5)], "d double").select(V.strength(F.col("d")))
    assert [r[0] for r in dots.collect()] == [0, 0, 0.5, 0.8, 1, 1]


def vectors(spark, values):
    return spark.createDataFrame([(i + 1, [float(x) for x in v]) for i, v in enumerate(values)], "node_id long, embedding array<float>")


def test_edge_planner(spark):
    near = vectors(spark, [(1, 0), (0.9, 0.1), (0.8, 0.2)])
    got = {(r[0], r[1]): round(r[2], 6) for r in graph.knn_edges(near, 1, 0.7).collect()}
    assert got == {(1, 2): 0.95, (1, 3): 0.9}
    assert len(rows(graph.knn_edges(vectors(spark, [(1, 0), (0.9, 0.1), (0, 1)]), 10, 0.7))) == 1
    with pytest.raises(ValueError):
        graph.knn_edges(near, 0)


def test_blocked_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    x = np.random.default_rng(1).normal(size=(40, 4)).round(1)
    x[5] = x[9] = x[20]
    df = vectors(spark, x).select(F.col("node_id").alias("id"), F.col("embedding").alias("v"))
    dots = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    got = {(r["src"], r["rank"]): r["dst"] for r in graph.blocked_topk(df, df, 3).collect()}
    for i in range(40):
        want = sorted(range(40), key=lambda j: (-dots[i, j], j))[:3]
        assert [got[(i + 1, k)] - 1 for k in (1, 2, 3)] == want


def test_neighbours_among_earlier_ids_by_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    rng = np.random.default_rng(3)
    ids = sorted(rng.choice(10_000, 40, replace=False).tolist())
    v = rng.normal(size=(40, 5))
    v[5] = v[6] = v[20]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, v array<double>").repartition(4)
    want = {(ids[a], k + 1, ids[b]) for a in range(40) for k, b in enumerate(sorted((b for b in range(a) if v[a] @ v[b] >= 0.1), key=lambda b: (-round(v[a] @ v[b], 9), b))[:3])}
    got = graph.blocked_topk(df, df, 3, earlier_only=True, least=0.1)
    assert {(r["src"], r["rank"], r["dst"]) for r in got.collect()} == want
    with pytest.raises(ValueError, match="themselves"):
        graph.blocked_topk(df, df.limit(3), 3, earlier_only=True)


def test_mentions_with_many_titles(spark, monkeypatch):
    contents = spark.createDataFrame([(1, "the red house and a red fox"), (2, "red"), (3, None), (4, "fox hunt")], "content_id long, content string")
    titles = spark.createDataFrame([(1, "Red house"), (2, "red"), (3, "fox"), (4, "fox hunting"), (5, "!")], "title_id long, title string")
    want = [(1, 1), (1, 2), (1, 3), (2, 2), (4, 3)]
    for most in (2000, 1):
        monkeypatch.setattr(graph, "LEADS", most)
        assert rows(graph.mentions(contents, titles)) == want


def test_mentions_need_the_whole_phrase(spark):
    contents = spark.createDataFrame([(9, "Quantum Mechanics is referenced directly. Mappings are not the target title."), (8, None), (7, "relativity")], "content_id long, content string")
    titles = spark.createDataFrame([(1, "Quantum Mechanics"), (2, "Map"), (3, "Relativity"), (4, "!!"), (5, None)], "title_id long, title string")
    assert rows(graph.mentions(contents, titles)) == [(7, 3), (9, 1)]


def test_subgraphs(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "node_a_id long, node_b_id long, strength double")
    nodes = spark.createDataFrame([(2,), (3,)], "node_id long")
    assert rows(graph.induced(edges, nodes)) == [(2, 3, 0.8)]
    assert len(rows(graph.touching(edges, nodes))) == 3
    assert dict(rows(graph.degree(edges))) == {1: 1, 2: 2, 3: 2, 4: 1}


def cards(spark):
    data = [(1, "Quantum Mechanics", "A concise title match.", [0.1, 0.9], "active"), (2, "Physics Notes", "Quantum mechanics appears in content only.", [0.9, 0.1], "active"), (3, "Mechanics and Quantum Notes", "Title contains both.", [0.1, 0.9], "active"), (4, "Quantum Mechanics", "archived", [1.0, 0.0], "archived")]
    return spark.createDataFrame(data, "node_id long, title string, content string, embedding array<float>, state string")


def test_hybrid_ranking(spark):
    queries = spark.createDataFrame([(1, " quantum  MECHANICS ", [1.0, 0.0]), (2, "nonexistentlexicalterm", [1.0, 0.0]), (3, " ", [0.0, 1.0])], "query_id long, query_text string, embedding array<float>")
    got = search.hybrid(queries, cards(spark), 3, 8)
    order = {q: [r["node_id"] for r in sorted(got.collect(), key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert order[1] == [1, 3, 2] and order[2][0] == 2 and set(order[3]) == {1, 2, 3} and 4 not in order[2]
    with pytest.raises(ValueError):
        search.hybrid(queries, cards(spark), 9, 3)


def test_connected_titles(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.8), (2, 3, 0.5)], "node_a_id long, node_b_id long, strength double")
    matched = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, node_id long")
    got = {(r["query_id"], r["position"]): r["title"] for r in search.connected_titles(matched, edges, cards(spark), 5).collect()}
    assert got == {(1, 1): "Physics Notes", (1, 2): "Mechanics and Quantum Notes", (2, 1): "Quantum Mechanics", (2, 2): "Mechanics and Quantum Notes"}


def test_lexical_search_passes_on_few_cards_a_query(spark):
    own = cards(spark).filter("state = 'active'")
    queries = spark.createDataFrame([(1, " quantum  MECHANICS "), (2, "mechanics-or -quantum"), (3, " "), (4, "QUANTUM quantum"), (5, None)], "query_id long, query_text string")
    got = search.lexical_topk(queries, own, 2)
    assert sorted((r["query_id"], r["lexical_rank"], r["node_id"], r["exact"], r["phrase"], r["all_tokens"], round(r["score"], 6)) for r in got.collect()) == [(1, 1, 1, 1, 1, 1, 2.0), (1, 2, 3, 0, 0, 1, 2.0), (4, 1, 1, 0, 0, 1, 1.0), (4, 2, 3, 0, 0, 1, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(array_distinct" not in plan  # no row for each pair of a query and a card


TREE = [(1, None, "Root", 0), (2, 1, "Branch 1", 1), (3, 1, "Branch 2", 1), (4, 2, "Leaf 1", 2), (5, 2, "Leaf 2", 2), (6, 3, "Leaf 3", 2)]


def test_taxonomy_counts_and_views(spark):
    tree = spark.createDataFrame(TREE, "id long, parent_id long, name string, depth long")
    own = spark.createDataFrame([(1, 4), (2, 4), (3, 5), (4, 2), (5, 1)], "node_id long, taxonomy_node_id long")
    assert dict(rows(taxonomy.descendant_counts(tree, own))) == {1: 3, 2: 3, 3: 0, 4: 2, 5: 1, 6: 0}
    assert rows(taxonomy.root_view(tree, own)) == [(1, 2, "Branch 1", 3, "branch")]
    views = {r["id"]: r["view"] for r in taxonomy.node_view(tree, own).collect()}
    assert views == {1: "branch", 2: "branch", 3: "branch", 4: "card_scope", 5: "card_scope", 6: "branch"}
    paths = {r["id"]: (r["route_path"], r["breadcrumb"]) for r in taxonomy.paths(tree).collect()}
    assert paths[1] == ("", "Root") and paths[4] == ("branch-1/leaf-1", "Root / Branch 1 / Leaf 1")
    assert sorted(r["route_path"] for r in taxonomy.precompute_targets(tree, own).collect()) == ["branch-1/leaf-1", "branch-1/leaf-2"]
    once = taxonomy.backfilled(spark.createDataFrame([(1,), (9,)], "node_id long"), own)
    assert once.count() == 6 and taxonomy.backfilled(spark.createDataFrame([(1,), (9,)], "node_id long"), once).count() == 6
    bad = spark.createDataFrame([*TREE, (7, 3, "!!!", 2), (8, 3, "Leaf-3", 2), (9, 3, "unclassified", 2), (10, None, "Other", 0)], "id long, parent_id long, name string, depth long")
    assert rows(taxonomy.violations(bad)) == [(10, "second root"), (6, "slug collision"), (7, "empty slug"), (8, "slug collision"), (9, "reserved name")]


def test_scope_projection_of_the_seed_graph(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (1, 8), (2, 6)]
    edges = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "node_a_id long, node_b_id long, strength double")
    scopes = spark.createDataFrame([(c, 10 + (c - 1) // 2) for c in range(1, 9)], "node_id long, scope_id long")
    got = taxonomy.scope_projection(scopes, graph.adjacency(edges))
    assert dict(rows(got.groupBy("scope_id").count())) == {10: 4, 11: 3, 12: 4, 13: 3}
    sides = rows(taxonomy.scope_graph(scopes, got).filter("scope_id = 10").select("node_id", "side"))
    assert sides == [(1, "inner"), (2, "inner"), (3, "outer"), (6, "outer"), (8, "outer")]


def test_yaml_taxonomy_and_batches():
    text = "Science:\n  Mathematics:\n    - General\n    - Algebra\n  Physics:\n"
    assert files.taxonomy_rows(text) == [(1, None, "Root", 0), (2, 1, "Science", 1), (3, 2, "Mathematics", 2), (4, 3, "General", 3), (5, 3, "Algebra", 3), (6, 2, "Physics", 2)]
    for bad in ("- a\n", "Unclassified:\n", "'':\n"):
        with pytest.raises(ValueError):
            files.taxonomy_rows(bad)
    assert files.batch_config("batches:\n  - {name: a, query: b c, limit: 3}\n") == [{"name": "a", "query": "b c", "limit": 3}]
    with pytest.raises(ValueError):
        files.batch_config("batches:\n  - {name: a, query: b}\n")


def test_shards_and_sinks(spark, tmp_path):
    folder = tmp_path / "split-00001"
    folder.mkdir()
    line = json.dumps({"page_id": 7, "title": "T", "source_url": "u", "clean_text": "x"})
    (folder / "shard-00000.jsonl.zst").write_bytes(zstandard.compress(f"{line}\n\n".encode()))
    got = files.shards(spark, str(tmp_path)).collect()
    assert [(r["page_id"], r["url"]) for r in got if r["page_id"] is not None] == [(7, "u")]
    files.write_selection(spark.createDataFrame([(1, "short")], "page_id long, reason string"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/summary.json").count() == 1
    month = tmp_path / "views" / "month=2026-01"
    month.mkdir(parents=True)
    (month / "a.json").write_text(json.dumps([{"article": "A_b", "views": 3, "rank": 1}]))
    assert rows(files.monthly_views(spark, f"file://{tmp_path}/views")) == [("2026-01", "A_b", 3, 1)]


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "node_id long, content string")
    got = {r["id"]: tuple(r["embedding"]) for r in embedding.embedded(df, "node_id", "content").collect()}
    assert got[1] == got[2] != got[3] and abs(sum(x * x for x in got[3]) - 1) < 1e-6


def test_corpus_search(spark):
    docs = spark.createDataFrame([(200, "Quantum mechanics", "x"), (201, "Other", "quantum mechanics here"), (202, "None", "nothing")], "page_id long, title string, clean_text string")
    done = spark.createDataFrame([(200,)], "page_id long")
    asked = spark.createDataFrame([(1, "quantum mechanics"), (2, " ")], "query_id long, query_text string")
    order = lambda df: [(r["query_id"], r["page_id"]) for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"]))]
    assert order(corpus.search(asked, docs, 2)) == [(1, 200), (1, 201), (2, 200), (2, 201)]
    assert order(corpus.search(asked, docs, 2, done)) == [(1, 201), (2, 201), (2, 202)]


def test_pageviews(spark):
    views = spark.createDataFrame([("m1", "A_b", 5, 1), ("m1", "A%20b", 9, 2), ("m2", "A_b", 1, 4), ("m2", "C", 7, 1)], "month string, article string, views long, rank long")
    totals = corpus.pageview_totals(views)
    assert rows(totals) == [("A b", 6, 2, 1, 200006), ("C", 7, 1, 1, 100007)]
    merged = corpus.canonical(totals, spark.createDataFrame([("C", "A b")], "redirect_title string, canonical_title string"))
    assert rows(merged) == [("A b", 13, 2, 1, 200013)]
    titles = spark.createDataFrame([(t,) for t in ("Main Page", ".hack", "Help:X", "Deaths in 2020", "Timeline of x", "2024 election", "Heat (1995 film)", "Physics", "Outline of x", "2019 election", "X season 3", "1999 in film", "Draft:X", "2025")], "t string")
    got = [r[0] for r in titles.select(corpus.title_reason(F.col("t"))).collect()]
    assert got == ["main_page", "low_signal_title", "namespace", "deaths", "list", "current_event_year", "entertainment", None, None, None, "entertainment", "entertainment", None, "current_event_year"]
    leads = spark.createDataFrame([(t, n) for t, n in (("She is an American former tennis player.", 9000), ("It was a 1990 tv series", 9000), ("An adult film studio", 9000), ("X is a village in Y", 4999), ("X is a village in Y", 5000), ("He is. An actor", 9000))], "t string, n int")
    assert [r[0] for r in leads.select(corpus.lead_reason(F.col("t"), F.col("n"))).collect()] == ["lead_biography_noise", "lead_entertainment_noise", "lead_adult_entertainment_noise", "lead_low_signal_locality", None, None]


def test_page_preparation(spark):
    html = "<html><style>p{}</style><!-- c --><p>Fish &amp; chips</p>\n<script>var a='<b>'</script> now</html>"
    wiki = "'''Bold''' [[Link|text]] and [[Plain]]{{Info|a={{b}}}}<ref>x</ref> [https://e.org site]\n\n\n\n== Head ==\n[[File:a.png]]end"
    got = spark.range(1).select(corpus.clean_html(F.lit(html)), corpus.clean_wikitext(F.lit(wiki))).first()
    assert tuple(got) == ("Fish & chips now", "Bold text and Plain site\n\nHead\nend")


def test_usage_summary_keeps_requested_keys(spark):
    events = spark.createDataFrame([(1, "success", "2026-04-28 10:00:00"), (1, "error", "2026-04-29 10:00:00")], "user_sub long, status string, created_at string")
    keys = spark.createDataFrame([(1,), (1,), (2,)], "user_sub long")
    assert rows(usage.summary(keys, events)) == [(1, 1, "2026-04-28 10:00:00"), (2, 0, None)]


def test_quota_windows(spark):
    policy = ((2, 86_400), (10, 604_800))
    state = [[0, 0.0], [0, 0.0]]
    assert [usage.quota_step(state, t, 1, policy)[0] for t in (0, 10, 20)] == [True, True, False]
    assert state[1][0] == 2 and usage.quota_step(state, 20, 1, policy) == (False, 86_380.0, [0, 8])
    assert usage.quota_step(state, 86_400, 1, policy) == (True, 0.0, [1, 7])
    rng = random.Random(4)
    calls = [(i, rng.randint(1, 5), rng.randint(0, 900_000), rng.randint(1, 3)) for i in range(400)]
    df = spark.createDataFrame(calls, "event_id long, user_sub long, s long, cost long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["allowed"] for r in usage.quota_replay(df.repartition(5), policy).collect()}
    states: dict = {}
    for i, user, at, cost in sorted(calls, key=lambda c: (c[1], c[2], c[0])):
        assert got[i] == usage.quota_step(states.setdefault(user, [[0, 0.0], [0, 0.0]]), at, cost, policy)[0]


def test_web_quota_counts_before_it_tests():
    state: dict = {}
    keys = [("burst", 1, 60), ("total", 5, 600)]
    assert [usage.web_quota_step(state, t, keys) for t in (0, 10)] == [(True, 0.0), (False, 50)]
    assert state == {"burst": (2, 60), "total": (1, 600)}


def test_fingerprints(spark):
    got = usage.with_fingerprints(spark.createDataFrame([(1, "token")], "position long, token string"), "secret").first()
    assert got["fingerprint"] == usage.fingerprinter("secret")("token") and got["fingerprint"].startswith("pat_")
    unknown = usage.token_rows(spark.createDataFrame([(1, "x")], "position long, fingerprint string"), None).first()
    assert unknown["searches"] is None


def test_idempotent_ingestion(spark):
    data = [(1, "k", "a"), (2, "k ", "a"), (3, "k", "b"), (4, None, "a"), (5, " ", "a")]
    got = rows(workflow.intake_outcomes(spark.createDataFrame(data, "request_id long, key string, payload_hash string")))
    assert got == [(1, "new", None), (2, "replay", 1), (3, "conflict", None), (4, "new", None), (5, "new", None)]
    import hashlib

    text = spark.range(1).select(workflow.payload_hash(F.lit('T"'), F.lit("C"))).first()[0]
    assert text == hashlib.sha256(b'{"content":"C","title":"T\\""}').hexdigest()


def test_proposals(spark):
    cards = spark.createDataFrame([(1, "A", 1, "active"), (2, "B", 3, "active")], "node_id long, title string, current_version long, state string")
    accepted = spark.createDataFrame([(1, "edit", "A2", 1), (1, "edit", "A3", 2), (2, "delete", None, 3), (5, "create", "N", 4)], "node_id long, proposal_type string, new string, reviewed_at long")
    assert rows(workflow.apply_proposals(cards, accepted)) == [(1, "A3", 3, "active"), (2, "B", 3, "archived"), (5, "N", 1, "active")]


def test_allocation_and_preflight(spark):
    waiting = spark.createDataFrame([(1, "b", 5), (2, "a", 4), (3, "c", 9)], "scope_id long, path string, waiting long")
    assert {r["scope_id"]: r["granted"] for r in workflow.allocate(waiting, 7).collect()} == {2: 4, 1: 3, 3: 0}


def test_card_pipeline(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit_id long")
    results = [("page:1", None, None, ["a", "b"]), ("page:2", "FAILED", None, None), ("review:1/0", None, True, None), ("review:1/1", None, False, None), ("repair:1/1", None, None, ["Card A", "Card B"]), ("review:1/1/0", None, True, None), ("review:1/1/1", "EXPIRED", None, None)]
    df = spark.createDataFrame(results, "job string, terminal_state string, passed boolean, cards array<string>")
    assert rows(workflow.pipeline_replay(units, df)) == [("1/0", 1, None, "handed off"), ("1/1", 1, None, "repaired"), ("1/1/0", 1, "1/1", "handed off"), ("1/1/1", 1, "1/1", "stopped")]


def test_card_pipeline_follows_every_repair(spark):
    names = ["1" + "/0" * k for k in range(1, 13)]
    results = [("page:1", None, ["a"]), *((f"review:{c}", False, None) for c in names), *((f"repair:{c}", None, ["b"]) for c in names)]
    df = spark.createDataFrame([(j, None, p, c) for j, p, c in results], "job string, terminal_state string, passed boolean, cards array<string>")
    units = spark.createDataFrame([(1,)], "unit_id long")
    got = {r["candidate"]: (r["parent"], r["state"]) for r in workflow.pipeline_replay(units, df).collect()}
    parents = dict(zip([*names, names[-1] + "/0"], [None, *names], strict=True))
    assert got == {c: (p, "repaired" if c in names else "in review") for c, p in parents.items()}
    assert workflow.pipeline_replay(units.limit(0), df).count() == 0


def test_continuation_work_drops_requests_and_counts_over_all_scopes(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    asked = [(1, 2, 10, None, day(1)), (2, 2, 11, None, day(2)), (3, 9, 12, None, day(3)), (4, 2, 13, None, day(4)), (5, 2, 14, 50, day(5)), (6, 3, 15, 60, day(6)), (7, 2, 16, None, day(7)), (8, 3, 17, None, day(8))]
    requests = spark.createDataFrame(asked, "request_id long, scope_id long, node_id long, next_job_id long, updated_at timestamp")
    assigned = spark.createDataFrame([(10, 2), (11, 3), (12, 9), (13, 2), (14, 2), (15, 3), (16, 2), (17, 3)], "node_id long, taxonomy_node_id long")
    children = spark.createDataFrame([(2, 20, "A"), (3, 30, "B"), (9, 90, "Unclassified")], "scope_id long, child_id long, name string")
    # 11 has moved, 9 has no regular children, 13 and 15 have another or a sent job; 14's job is its own, 10's has ended and 16's is processed.
    jobs = [(40, 2, 13, None, None, None), (50, 2, 14, None, None, None), (60, 3, 15, "r", None, None), (70, 2, 10, "s", "FAILED", None), (80, 2, 16, "t", None, "x")]
    jobs = spark.createDataFrame(jobs, "id long, scope_id long, node_id long, job_id string, terminal_state string, processed_at string")
    drain = lambda now, batch: sorted(r["request_id"] for r in workflow.continuation_work(requests, F.lit(now), batch, 86_400, assigned, children, jobs).collect())
    assert drain(day(9), 8) == drain(day(9), 99) == [1, 5, 7, 8]
    assert drain(day(8), 7) == [1, 5, 7] and drain(day(9), 7) == [1, 5, 7, 8]  # the newest waits for its age
    assert drain(day(1), 9) == []


def test_layout(spark):
    seed = spark.range(1).select(*FL.seed(F.lit(0)), *FL.seed(F.lit(0), 40.0, 10.0)).first()
    assert tuple(seed) == (176.0, 0.0, 50.0, 0.0)
    assert layout.simulate(np.array([5]), []).tolist() == [[176.0, 0.0]]
    ids = np.array([1, 2, 3])
    edges = layout.canonical_edges(ids, [(2, 1, 0.9), (1, 2, 0.1), (2, 3, 0.2), (3, 9, 0.5)])
    assert edges == [(0, 1, 0.9), (1, 2, 0.2)]
    places = layout.simulate(ids, edges)
    gap = lambda i, j: float(np.hypot(*(places[i] - places[j])))
    assert gap(0, 1) < gap(1, 2) and (places == layout.simulate(ids, edges)).all()
    nodes = spark.createDataFrame([(1, 1, "inner"), (1, 2, "inner"), (1, 3, "outer"), (2, 9, "inner")], "scope_id long, node_id long, side string")
    links = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.2)], "scope_id long, node_a_id long, node_b_id long, strength double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in layout.force_layout(nodes, links).collect()}
    assert got[(2, 9)] == (176.0, 0.0) and got[(1, 1)] == tuple(places[0])
    placed = layout.seeded(nodes)
    assert tuple(layout.bounds(placed.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        layout.sliced(placed, 1, 0, 0, 1)


def test_blocks_grow_so_that_vectors_travel_a_bounded_number_of_times(spark, monkeypatch):
    rows = [(i, [math.cos(i * i), math.sin(i * i)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    monkeypatch.setattr(graph, "BLOCK", 7)
    assert graph._blocks(df) == graph.SIDE  # of 43 blocks of 7
    assert graph._blocks(df.limit(20)) == 3 and graph._blocks(df.limit(0)) == 1
    monkeypatch.setattr(graph, "NUMBERS", 60)  # 30 vectors of two components
    assert graph._blocks(df) == 10
    got = {(r["src"], r["rank"]): r["dst"] for r in graph.blocked_topk(df, df, 2, earlier_only=True).collect()}
    vectors = np.array([v for _, v in rows], np.float32).astype(float)
    for i in range(300):
        order = sorted(range(i), key=lambda j: (-float(vectors[i] @ vectors[j]), j))[:2]
        assert [got.get((i, k + 1)) for k in range(2)] == [*order, None, None][:2]


def test_simulation_by_tiles_and_squares(monkeypatch):
    """Charges come tile by tile and collisions from the squares around a node, to the last bit as if all pairs were looked at."""
    ids, forces = np.arange(40) * 3 + 1, layout.Forces(radius=90.0)
    edges = [(i, j, 0.5) for i in range(40) for j in range(i + 1, 40) if (i * j) % 11 == 3]
    whole = layout.simulate(ids, edges, 12, forces)
    monkeypatch.setattr(layout, "TILE", (3, 7))
    assert (layout.simulate(ids, edges, 12, forces) == whole).all()
    ahead = np.random.default_rng(2).normal(0, 150, (60, 2))
    ahead[7] = ahead[5]
    ids, want = np.arange(60), ahead.copy()
    for i in range(59):
        for j in range(i + 1, 60):
            d = want[j] - want[i]
            length = float(np.hypot(*d))
            if float((d * d).sum()) < 180.0 * 180.0:
                d, length = (d, length) if length else (layout._unit(i, j, ids), 1.0)
                f = d * ((180.0 - length) / length * forces.collide * 0.7) / 2
                want[i] -= f
                want[j] += f
    assert (layout._apart(ids, ahead, 0.7, forces) == want).all()
    force = layout._charged(ids, ahead, -126.0)
    for i in range(60):
        d = np.delete(ahead, i, 0) - ahead[i]
        d[(d == 0).all(1)] = layout._unit(5, 7, ids) * (1 if i == 5 else -1)
        assert force[i] == pytest.approx((d * (-126.0 / np.maximum((d * d).sum(1), 1))[:, None]).sum(0), abs=1e-9)


def test_charges_of_many_nodes_meet_by_groups(monkeypatch):
    """Nodes in bunches, on a line, far out, nearer than 1 and in one place: charges as exact as sums over all pairs, of which few are formed."""
    rng = np.random.default_rng(3)
    pos = np.concatenate([rng.normal(0, 120, (2500, 2)), rng.normal(9000, 2000, (2500, 2)), np.stack([np.arange(996.0), np.zeros(996)], axis=1), [[1e7, -3.0]] * 3, [[2e7, 1e-3]]])
    pos[40], pos[41] = pos[3], pos[4] + [0.4, 0.3]
    n, pairs = len(pos), []
    ids, near = np.arange(n) * 5 + 2, series._near
    monkeypatch.setattr(series, "_near", lambda x, y, weight, a, b: pairs.append(len(a) * x.shape[1] ** 2) or near(x, y, weight, a, b))
    got, want = layout._charges(ids, pos, -180.0), layout._charged(ids, pos, -180.0)
    z = pos[:, 0] + 1j * pos[:, 1]
    share = 180 * sum((1 / np.maximum(np.abs(z[:, None] - z[k : k + 500]), 1)).sum(1) for k in range(0, n, 500))
    assert (np.abs(got - want).max(1) <= 1e-13 * share).all()
    assert sum(pairs) < n * n / 8
    for n in (1, 2, 3, series.LEAF, series.LEAF + 1, 4 * series.LEAF + 3, 1024):
        monkeypatch.setattr(layout, "PLAIN", n)
        want = layout._charges(ids[:n], pos[-n:], 3.0)
        monkeypatch.setattr(layout, "PLAIN", 0)
        assert layout._charges(ids[:n], pos[-n:], 3.0) == pytest.approx(want, abs=1e-9)


def test_collisions_look_only_at_nodes_that_come_near(monkeypatch):
    """A row of nodes that push each other on: those that nobody was near at first are looked at too; the far ones are not."""
    ids, forces = np.arange(400), layout.Forces(radius=16.0)
    ahead = np.stack([np.arange(400) * 33.0, np.zeros(400)], axis=1)
    ahead[:3, 0] = [20.0, 25.0, 60.0]
    ahead[200:] += 1e6
    ahead[300] = ahead[299]
    want = ahead.copy()
    for i in range(399):
        for j in range(i + 1, 400):
            d = want[j] - want[i]
            length = float(np.hypot(*d))
            if length < 32.0:
                d, length = (d, length) if length else (layout._unit(i, j, ids), 1.0)
                f = d * ((32.0 - length) / length * forces.collide * 1.9) / 2
                want[i] -= f
                want[j] += f
    moved = (want != ahead).any(1)
    assert moved[:8].all() and not moved[100:299].any()
    assert (layout._apart(ids, ahead, 1.9, forces) == want).all()
    monkeypatch.setattr(layout, "PAIRS", 3)
    assert (layout._apart(ids, ahead, 1.9, forces) == want).all()


def test_branch_layout_never_overlaps(spark):
    kids = spark.createDataFrame([(1, i, 10 * i * i) for i in range(2, 20)], "parent_id long, id long, descendants long")
    p = layout.branch_layout(kids).toPandas()
    for a in p.itertuples():
        for b in p.itertuples():
            assert a.id >= b.id or np.hypot(a.x - b.x, a.y - b.y) >= (a.diameter + b.diameter) / 2 - 1e-3


def test_packing(spark):
    items = spark.createDataFrame([("q", i, b) for i, b in enumerate([40, 40, 40, 200, 1])], "queue string, item_id long, bytes long")
    assert [r["batch"] for r in sorted(layout.packed_batches(items, 2, 100).collect(), key=lambda r: r["item_id"])] == [0, 0, 1, 2, 3]
    pd.testing.assert_frame_equal(pd.DataFrame({"r": [0, 1, 2, 2]}), spark.createDataFrame([(0,), (1,), (7,), (18,)], "i long").select(FL.ring_slot(F.col("i"))["ring"].alias("r")).toPandas(), check_dtype=False)


@pytest.mark.parametrize("limit, granted", [(0, [0, 0, 0, 0, 0]), (3, [0, 2, 1, 0, 0]), (7, [0, 2, 4, 1, 0]), (50, [0, 2, 4, 3, 0])])
def test_allocate_deals_a_shared_limit_in_path_order(spark, limit, granted):
    rows = [(9, "a", 0), (4, "b", 2), (5, "b", 4), (1, "c", 3), (2, "d", None)]
    waiting = spark.createDataFrame(rows, "scope_id long, path string, waiting long").repartition(3)
    got = {r["scope_id"]: (r["waiting"], r["granted"]) for r in workflow.allocate(waiting, limit).collect()}
    assert got == {i: (n, g) for (i, _, n), g in zip(rows, granted, strict=True)}
