"""Full-text search against worked examples and searches by definition, which share no code with it."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from cardloom.functions import english
from cardloom.operators import fulltext
from cardloom.operators.textindex import TextIndex


@pytest.mark.parametrize(
    ("word", "stem"),
    [("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"), ("consolidating", "consolid"), ("knackeries", "knackeri"), ("knightly", "knight"), ("generously", "generous"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("skies", "sky"), ("dying", "die"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("bluely", "blueli"), ("electricity", "electr"), ("hopefulness", "hope"), ("national", "nation"), ("controlling", "control"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("proceed", "proceed"), ("rate", "rate"), ("argument", "argument"), ("university", "univers"), ("connections", "connect"), ("agreed", "agre"), ("feed", "feed")],
)
def test_stems(word, stem):
    assert english.stem(word) == stem


def test_queries_are_parsed():
    assert fulltext.parsed('running "on the tables" or cats -dogs') == [[(False, [("run", 0)]), (False, [("tabl", 0)])], [(False, [("cat", 0)]), (True, [("dog", 0)])]]
    assert fulltext.parsed('"cats of dogs"') == [[(False, [("cat", 0), ("dog", 2)])]]
    assert fulltext.parsed("the of") == fulltext.parsed("") == [] and fulltext.parsed("-cats") == [[(True, [("cat", 0)])]]


def test_cover_density():
    one, two = fulltext.parsed("cat"), fulltext.parsed("cat dog")
    score = lambda hits, groups: fulltext.Answer(hits, groups).cover_density()
    assert score([(1, "cat", 1.0), (9, "cat", 0.4)], one) == pytest.approx(1.4)
    # Covers: title's cat to dog at 3 (one word between), dog to the next cat at 4.
    hits = [(1, "cat", 1.0), (3, "dog", 0.4), (4, "cat", 0.4)]
    assert score(hits, two) == pytest.approx(2 / (1 + 2.5) / 2 + 2 / 5)
    phrase = fulltext.parsed('"cat dog" bird')
    # dog bird cat dog: the phrase must lie inside whole.
    assert score([(1, "dog", 0.4), (2, "bird", 0.4), (3, "cat", 0.4), (4, "dog", 0.4)], phrase) == pytest.approx(0.4)


#: What the words of the plain search below become; stop words become nothing.
LEXEMES = {"cat": "cat", "cats": "cat", "dog": "dog", "running": "run", "runs": "run", "run": "run", "the": None, "of": None, "tree": "tree", "table": "tabl", "top": "top"}
#: Queries as alternatives of (excluded, words in a row).
ASKED = {
    "cat dog": [[(0, "cat"), (0, "dog")]],
    '"cat dog" or run': [[(0, "cat dog")], [(0, "run")]],
    "tree -dog": [[(0, "tree"), (1, "dog")]],
    "the": [],
    "": [],
    '"dog of cats"': [[(0, "dog of cats")]],
    "table-top cat": [[(0, "table top"), (0, "cat")]],
    "-dog": [[(1, "dog")]],
    'tree or -"cat the dog" -runs': [[(0, "tree")], [(1, "cat the dog"), (1, "runs")]],
    "cats running tree dog": [[(0, "cats"), (0, "running"), (0, "tree"), (0, "dog")]],
}


def by_definition(title, content, alternatives):
    """None, or (score, whether the title answers alone): every stretch of hits is looked at."""
    said = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    own = [(LEXEMES[w], 1.0) for w in said(title)] + [(LEXEMES[w], 0.4) for w in said(content)]
    phrases = lambda text: [LEXEMES[w] for w in text.split()]

    def stands(phrase, lo, hi):
        want = phrases(phrase)
        return any(all(x is None or (own[p + k][0] == x) for k, x in enumerate(want)) for p in range(lo, hi - len(want) + 2))

    def answers(lo, hi, with_excluded):
        return any(all(stands(p, lo, hi) != bool(out) for out, p in g if with_excluded or not out) for g in alternatives)

    last = len(own) - 1
    if not answers(0, last, True):
        return None
    used = {x for g in alternatives for _, p in g for x in phrases(p) if x}
    hits = [k for k, (x, _) in enumerate(own) if x in used]
    stretches = [(a, b) for a, b in itertools.combinations_with_replacement(hits, 2) if answers(a, b, False)]
    short = [(a, b) for a, b in stretches if not any((c, d) != (a, b) and a <= c and d <= b for c, d in stretches)]
    score = 0.0
    for a, b in short:
        inside = [k for k in hits if a <= k <= b]
        score += len(inside) / sum(1 / own[k][1] for k in inside) / (1 + (b - a + 1 - len(inside)))
    return round(score, 9), answers(0, len(said(title)) - 1, True)


def cards_of(seed, n=60):
    rng, vocabulary = random.Random(seed), ["cat", "cats", "dog", "running", "runs", "the", "of", "tree", "Table-top"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    return {i: (say(rng.randint(0, 3)), say(rng.randint(0, 12))) for i in rng.sample(range(3 * n), n)} | {900: (None, "cat dog"), 901: ("cat dog", None), 902: (None, None), 5000: ("tree", "tree " * 9 + "cat")}


def frame_of(spark, cards):
    return spark.createDataFrame([(i, *c) for i, c in cards.items()], "node_id long, title string, content string").repartition(3)


def queries_of(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query_text string")


def wanted(cards):
    return {(q, i): found for q, g in enumerate(ASKED.values()) for i, c in cards.items() if (found := by_definition(*c, g))}


def rows_of(found):
    return {(r["query_id"], r["node_id"]): (round(r["score"], 9), r["in_title"]) for r in found.collect()}


def test_search_against_the_definition(spark):
    cards = cards_of(1)
    want = wanted(cards)
    assert rows_of(fulltext.found(queries_of(spark), frame_of(spark, cards))) == want and {q for q, _ in want} == {0, 1, 2, 5, 6, 7, 8, 9}
    best = fulltext.topk(queries_of(spark), frame_of(spark, cards).fillna(""), 2).filter("query_id = 0").orderBy("lexical_rank").first()
    assert (best["node_id"], best["exact"], best["all_tokens"]) == (901, 1, 1)


@pytest.mark.parametrize("limit", [1, 3, 200])
def test_best_leaves_out_blocks_and_no_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(fulltext, "BLOCK", 4)
    monkeypatch.setattr(fulltext, "FIRST", 1)
    cards = cards_of(2)
    ranked = sorted((q, -score, i) for (q, i), (score, _) in wanted(cards).items() if i % 5)
    want = {q: [(i, round(-s, 9)) for _, s, i in rows][:limit] for q, rows in itertools.groupby(ranked, key=lambda r: r[0])}
    got: dict = {}
    found = fulltext.searcher(frame_of(spark, cards)).best(queries_of(spark), limit, lambda rows: rows.filter("node_id % 5 <> 0"))
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["node_id"], round(r["score"], 9)))
    assert got == want


def scanned(df) -> int:
    """Rows that the scans of postings gave when df was last run."""
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        plan = stack.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(plan.executedPlan())
        elif name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            stack.append(plan.plan())
        elif name == "FileSourceScanExec":
            total += plan.metrics().apply("numOutputRows").value()
        stack += [plan.children().apply(k) for k in range(plan.children().size())]
    return total


def test_stored_index_and_edits(spark, tmp_path):
    cards, changed = cards_of(3), {}
    index = TextIndex(spark, f"file://{tmp_path}/index").build(frame_of(spark, cards))
    assert rows_of(index.searcher().found(queries_of(spark))) == wanted(cards)
    rng = random.Random(5)
    for step in range(3):
        ids = rng.sample(sorted(cards), 12)
        changed = {i: ("cat tree", f"dog running step{'' if step else ' of'}".replace("step", "runs")) for i in ids[:8]} | {7000 + step: ("dog", "cat the dog")}
        before = set(index._postings().inputFiles())
        index.upsert(frame_of(spark, changed)).delete(spark.createDataFrame([(i,) for i in ids[8:]], "node_id long"))
        cards = {i: c for i, c in (cards | changed).items() if i not in ids[8:]}
        assert rows_of(index.searcher().found(queries_of(spark))) == wanted(cards)
        assert before < set(index._postings().inputFiles())  # nothing written before is touched
        own = index._postings().filter("segment = 2 * {0} + 1".format(step)).select("nodes").collect()
        assert {n for r in own for n in r["nodes"]} <= set(changed)  # an edit writes its own postings
    assert rows_of(index.merged().searcher().found(queries_of(spark))) == wanted(cards)
    assert index._postings().select("segment").distinct().count() == 1


def test_scan_reads_the_postings_of_the_query(spark, tmp_path):
    rng = random.Random(1)
    name = lambda: "".join(rng.choices("bcdfgklmnprt", k=7))
    rows = [(i, name(), " ".join(name() for _ in range(40)) + (" needle" if i % 100 == 0 else "")) for i in range(3000)]
    index = TextIndex(spark, f"file://{tmp_path}/big").build(spark.createDataFrame(rows, "node_id long, title string, content string"))
    search = index.searcher()
    named = search.blocks.filter("lexeme = 'needl'")
    total = search.blocks.count()
    assert named.collect() and scanned(named) * 4 < total
    asked = spark.createDataFrame([(1, "needle")], "query_id long, query_text string")
    assert sorted(r["node_id"] for r in search.best(asked, 100).collect()) == list(range(0, 3000, 100))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "node_id long, title string, content string")
    assert fulltext.found(queries_of(spark), none).count() == 0
    assert fulltext.found(queries_of(spark).limit(0), frame_of(spark, cards_of(1, 5))).count() == 0


def test_texts_are_analysed_in_portions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"title {i % 3}", None if i % 5 == 0 else "the words of it " * (i % 4)) for i in range(40)], "node_id long, title string, content string").coalesce(1)
    rows = lambda: sorted(tuple(map(str, r)) for r in fulltext.postings(docs, "simple").collect())
    whole = rows()
    monkeypatch.setattr(fulltext, "WORDS", 7)
    monkeypatch.setattr(fulltext, "KNOWN", 2)
    assert rows() == whole and len(whole) > 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_travel_once_for_all_queries(spark, monkeypatch):
    """Twenty times the queries add their own rows to what is shuffled, not the postings of their words."""
    monkeypatch.setattr(fulltext, "BLOCK", 8)
    search = fulltext.searcher(spark.createDataFrame([(i, f"the text {i % 7}", "the text of it " * 50) for i in range(64)], "node_id long, title string, content string"), "simple")
    queries = lambda n: spark.createDataFrame([(q, f"the text {q % 7}") for q in range(n)], "query_id long, query_text string")

    def joined(n):
        found = search.topk(queries(n), 2)
        assert found.count() == 2 * n
        plan = plan_of(found)
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and "query_text" not in "".join(x for x in plan.splitlines() if "Join" in x)
        return sorted((r["query_id"] % 7, r["lexical_rank"], r["node_id"], r["score"]) for r in found.collect())

    few, many = joined(7), joined(140)
    assert sorted(few * 20) == many and [(r[1], r[2]) for r in few] == [(k, q + 7 * (k - 1)) for q in range(7) for k in (1, 2)]


def test_excluding_queries_rank_the_blocks_once(spark):
    found = fulltext.found(queries_of(spark), frame_of(spark, cards_of(4)))
    plan = plan_of(found)
    assert plan.count("InArrow") - plan.count("MapInArrow") - plan.count("FlatMapCoGroupsInArrow") == 0 and plan.count("FlatMapCoGroupsInArrow") == 1 and "NestedLoop" not in plan


def test_large_blocks_have_several_rows_of_a_lexeme(spark, monkeypatch):
    cards = cards_of(6)
    whole = fulltext.postings(frame_of(spark, cards), "english").count()
    monkeypatch.setattr(fulltext, "HELD", 20)
    monkeypatch.setattr(fulltext, "WORDS", 20)
    search = fulltext.searcher(frame_of(spark, cards))
    assert search.blocks.count() > whole and rows_of(search.found(queries_of(spark))) == wanted(cards)
    best = {(r["query_id"], r["node_id"]): round(r["score"], 9) for r in search.best(queries_of(spark), 200).collect()}
    assert best == {k: score for k, (score, _) in wanted(cards).items()}
