"""URL filters over a sorted digest array.

The filter list is kept as one sorted array of 64-bit xxHash keys beside the rules' full
strings.  Tasks memory-map both, form for each URL the strings a fitting rule could have (every
parent domain with every prefix length that occurs in the list), probe all of a batch's keys in one binary
search, and confirm each hit against the stored string, so equal digests cannot mislead.

A rule is a host and a path prefix, written together (`net/de/`).  It fits its host and all
subdomains if the URL's path starts with the prefix.  The longest fitting rule decides (of equally
long ones that with the longer host); without one the verdict is "allow".

The list travels to the executors as files, so `rules` must fit in memory (`MAX_LIST_BYTES`,
checked); a longer list is cut into parts and the parts' answers are compared by length, as `filter_urls` does itself.

Defined cases: a null URL or one without "://" has empty host and path and fits no rule; of a
rule given twice "block" wins; repeated rows are judged each; other columns are carried.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import lean
#: The list's strings are cut into parts of at most this many bytes.
MAX_LIST_BYTES = 256 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules of the production query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, ALPHABET, ALPHABET.lower())).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


class DigestArray:
    """Sorted keys, and for each the place of its string; read through memory maps of the files whose paths begin with `stem`."""

    FILES = ("keys.npy", "ends.npy", "blocks.npy", "prefixes.npy", "text.npy")

    def __init__(self, stem: str):
        self.keys = np.load(f"{stem}keys.npy", mmap_mode="r")
        self.ends = np.load(f"{stem}ends.npy", mmap_mode="r")
        self.blocks = np.load(f"{stem}blocks.npy", mmap_mode="r")
        self.prefixes = np.load(f"{stem}prefixes.npy").tolist()
        self.text = np.load(f"{stem}text.npy", mmap_mode="r")

    @staticmethod
    def write(rules: list[tuple[str, str]], stem: str) -> None:
        verdict: dict[bytes, bool] = {}
        for rule, what in rules:
            verdict[rule.encode()] = verdict.get(rule.encode(), False) or what == "block"
        own = sorted(verdict, key=lambda r: (xxhash.xxh64_intdigest(r), r))
        save = lambda name, x: np.save(f"{stem}{name}", x)
        save("keys.npy", np.array([xxhash.xxh64_intdigest(r) for r in own], np.uint64))
        save("ends.npy", np.cumsum([0, *map(len, own)]))
        save("blocks.npy", np.array([verdict[r] for r in own], bool))
        save("prefixes.npy", np.array(sorted({len(r) - r.index("/") for r, _ in rules if "/" in r} | {0 for r, _ in rules if "/" not in r}), np.int64))
        save("text.npy", np.frombuffer(b"".join(own), np.uint8))

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Index of each text in the list, -1 if absent."""
        keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        out = np.full(len(texts), -1, np.int64)
        for i in np.flatnonzero(hi > lo).tolist():
            for k in range(lo[i], hi[i]):
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == texts[i]:
                    out[i] = k
        return out


def candidates(host: str, path: str, prefixes: list[int]) -> list[str]:
    """Strings of the rules that could fit, the longest first."""
    if not host:
        return []
    labels = host.split(".")
    names = [".".join(labels[k:]) for k in range(len(labels))]
    found = [(len(n) + p, len(n), n + path[:p]) for n in names for p in prefixes if p <= len(path)]
    return [x[2] for x in sorted(found, key=lambda x: (-x[0], -x[1]))]


def _parts(rules: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    parts, size = [[]], 0
    for rule in sorted(rules):
        size += len(rule[0].encode())
        if size > MAX_LIST_BYTES:
            parts.append([])
            size = len(rule[0].encode())
        parts[-1].append(rule)
    return parts


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    context = pages.sparkSession.sparkContext
    names = []
    for part in _parts(list(rules)):
        name = f"{uuid.uuid4().hex}-"
        stem = os.path.join(tempfile.mkdtemp(prefix="url-digests-"), name)
        DigestArray.write(part, stem)
        for file in DigestArray.FILES:  # a cluster takes no folders from the driver's disk
            context.addFile(stem + file)
        names.append(name)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[f"`{c}`" for c in own], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    split = split.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    columns = split.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [DigestArray(SparkFiles.get(name)) for name in names]
        for batch in batches:
            n = batch.num_rows
            rule: list[str | None] = [None] * n
            block = [False] * n
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            for digests in lists:
                texts, row = [], []
                for i in range(n):
                    own = candidates(hosts[i], paths[i], digests.prefixes)
                    texts += own
                    row += [i] * len(own)
                at = digests.find([t.encode() for t in texts])
                for k in np.flatnonzero(at >= 0)[::-1].tolist():  # the longest comes last and stays
                    i = row[k]
                    if rule[i] is None or len(rule[i]) <= len(texts[k]):
                        rule[i], block[i] = texts[k], bool(digests.blocks[at[k]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(["block" if b else "allow" for b in block], pa.string())], names=[*columns, "rule", "verdict"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema], "rule string, verdict string"])
    return split.mapInArrow(lean(judge), schema)


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.page_id, p.host, p.path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
"""
