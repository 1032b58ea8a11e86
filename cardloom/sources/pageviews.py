"""Monthly page-view lists as a Spark data source: one partition a month, tries with growing pauses, months that fail listed.

    spark.dataSource.register(PageViews)
    rows = spark.read.format("pageviews").option("months", "2026-01,2026-02").option("fetch", "package.module:function").load()

`fetch` names a function (month, options) -> (status, articles) that executors import; status 200 brings a list of
{article, views, rank}.  `http` here asks a service by the `url` option, in which {project}, {access}, {year} and {month} are filled in; `landed`
reads what was saved below the `folder` option.  Statuses 404, 429 and 5xx are tried again, up to `tries` (3) times, with pauses of
`pause` (1) second times the tries so far; others fail at once.  A month that fails fails the read, or with `skipMissing` is a row with its `error`
and nothing else.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = frozenset((404, 429, 500, 502, 503, 504))
SCHEMA = "month string, article string, views long, rank long, error string, tries int"


def http(month: str, options: dict) -> tuple[int, list[dict]]:
    """The articles of a month from a service."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    year, number = month.split("-")
    url = options["url"].format(project=options.get("project", "en.wikipedia.org"), access=options.get("access", "all-access"), year=year, month=number)
    try:
        with urlopen(Request(url, headers={"Accept": "application/json", "User-Agent": options.get("useragent", "cardloom")}), timeout=30) as answer:
            return 200, json.loads(answer.read().decode("utf-8"))["items"][0]["articles"]
    except HTTPError as error:
        return error.code, []


def landed(month: str, options: dict) -> tuple[int, list[dict]]:
    """The articles saved in folder/month=YYYY-MM/*.json, a folder that executors can open."""
    from pathlib import Path

    files = sorted(Path(options["folder"], f"month={month}").glob("*.json"))
    return (200, [row for f in files for row in json.loads(f.read_text())]) if files else (404, [])


@dataclass
class Month(InputPartition):
    month: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._options = dict(options)
        module, _, name = self._options.get("fetch", f"{__name__}:http").partition(":")
        self._where = module, name
        self._months = [m.strip() for m in self._options.get("months", "").split(",") if m.strip()]
        if not self._months:
            raise ValueError("the option months names no month")

    def partitions(self) -> list[Month]:
        return [Month(m) for m in dict.fromkeys(self._months)]

    def read(self, partition: Month) -> Iterator[tuple]:
        fetch = getattr(importlib.import_module(self._where[0]), self._where[1])
        most, pause = int(self._options.get("tries", 3)), float(self._options.get("pause", 1))
        for tries in range(1, most + 1):
            status, articles = fetch(partition.month, self._options)
            if status == 200:
                for row in articles:
                    yield partition.month, row["article"], int(row["views"]), int(row["rank"]), None, tries
                return
            if status not in AGAIN or tries == most:
                break
            time.sleep(pause * tries)
        if self._options.get("skipmissing", "false").lower() != "true":
            raise RuntimeError(f"failed to fetch {partition.month}: HTTP {status}")
        yield partition.month, None, None, None, f"HTTP {status}", tries


class PageViews(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pageviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def monthly_views(spark: SparkSession, months: list[str], fetch: str = f"{__name__}:http", skip_missing: bool = False, **options: str) -> tuple[DataFrame, DataFrame]:
    """(month, article, views, rank) of the months, and those (month, error, tries) that failed; to read the former alone is to fail if all months do."""
    spark.dataSource.register(PageViews)
    rows = spark.read.format("pageviews").options(months=",".join(months), fetch=fetch, skipMissing=str(skip_missing).lower(), **options).load()
    return rows.filter("error IS NULL").select("month", "article", "views", "rank"), rows.filter("error IS NOT NULL").select("month", "error", "tries")
