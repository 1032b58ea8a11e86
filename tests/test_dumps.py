"""Dumps that are cut in every way give each page once."""

from __future__ import annotations

import bz2
import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import corpus
from cardloom.sources import dumps


def written(seed, n):
    rng = random.Random(seed)
    out, want = ["<mediawiki>\n<siteinfo><sitename>x</sitename></siteinfo>\n"], {}
    for i in range(1, n + 1):
        ns, text = rng.choice([0, 0, 0, 4]), "".join(rng.choices("abc &<é漢\n=[]{}'", k=rng.choice([0, 30, 2000, 9000])))
        title, moved = f"Page {i} & co", rng.random() < 0.1
        escaped = text.replace("&", "&amp;").replace("<", "&lt;")
        body = f'<text bytes="{len(text)}" xml:space="preserve">{escaped}</text>' if text else "<text />"
        out.append(f'  <page>\n    <title>Page {i} &amp; co</title>\n    <ns>{ns}</ns>\n    <id>{i}</id>\n{"    <redirect title=" + chr(34) + "A &amp; B" + chr(34) + " />" if moved else ""}\n    <revision><id>{10**6 + i}</id>{body}</revision>\n  </page>\n')
        want[i] = (ns, title, "A & B" if moved else None, text)
    return "".join([*out, "</mediawiki>\n"]).encode(), want


@pytest.fixture(scope="module", params=["one stream", "many streams"])
def dumped(request, tmp_path_factory):
    raw, want = written(3, 400)
    path = tmp_path_factory.mktemp("dump") / "pages.xml.bz2"
    if request.param == "one stream":
        packed = bz2.compress(raw, 1)
    else:
        rng, packed, at = random.Random(1), b"", 0
        while at < len(raw):  # streams end anywhere, in tags and in characters
            step = rng.choice([3, 700, 30_000, 150_000])
            packed, at = packed + bz2.compress(raw[at : at + step], rng.choice([1, 9])), at + step
    path.write_bytes(packed)
    return str(path), want, len(packed)


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 40, 333])
def test_each_page_comes_out_once(dumped, parts):
    path, want, size = dumped
    edges = [size * k // parts for k in range(parts + 1)]
    got = [p for lo, hi in zip(edges[:-1], edges[1:], strict=True) for p in dumps.pages(path, lo, hi)]
    assert [p[0] for p in got] == list(want) and {p[0]: p[1:] for p in got} == want


def test_dump_as_a_data_source_and_as_shards(spark, dumped, tmp_path):
    path, want, size = dumped
    rows = dumps.dump(spark, path, size // 5 + 1)
    assert rows.rdd.getNumPartitions() == 5 and {r["page_id"]: tuple(r)[1:] for r in rows.collect()} == want
    articles, counts = dumps.preprocessed(rows)
    kinds = {r["kind"]: r["n"] for r in counts.collect()}
    assert sum(kinds.values()) == len(want) and kinds["ignored"] == sum(ns != 0 for ns, *_ in want.values())
    assert kinds["redirect"] >= sum(ns == 0 and moved is not None for ns, _, moved, _ in want.values())
    dumps.write_shards(articles, f"file://{tmp_path}/shards", 50)
    back = spark.read.json(f"file://{tmp_path}/shards")
    assert back.count() == kinds["article"] and len(list((tmp_path / "shards").glob("part-*"))) >= kinds["article"] // 50
    one = back.filter("clean_text <> ''").first()
    assert one["clean_text"] == spark.createDataFrame([(want[one["page_id"]][3],)], "t string").select(corpus.clean_wikitext(F.col("t"))).first()[0]


def test_files_without_pages_and_broken_ones(tmp_path):
    (tmp_path / "none.bz2").write_bytes(bz2.compress(b"<mediawiki></mediawiki>"))
    (tmp_path / "empty.bz2").write_bytes(b"")
    (tmp_path / "open.bz2").write_bytes(bz2.compress(b"<page><id>1</id>"))
    for name in ("none.bz2", "empty.bz2"):
        assert list(dumps.pages(str(tmp_path / name), 0, 10_000)) == []
    with pytest.raises(ValueError, match="not closed"):
        list(dumps.pages(str(tmp_path / "open.bz2"), 0, 10_000))
    whole = bz2.compress(b"<page><id>1</id></page>" * 9)
    (tmp_path / "cut.bz2").write_bytes(whole[:-12])
    with pytest.raises(Exception):  # noqa: B017
        list(dumps.pages(str(tmp_path / "cut.bz2"), 0, 10_000))
