"""Page dumps, XML in bzip2, read in stretches side by side.

A bzip2 file is a row of blocks that stand at any bit; each begins with a mark of 48 bits and can be unpacked by itself once it is
put between a header and an end.  A stretch of bytes owns the blocks whose marks begin in it, and the pages whose opening tags
begin in their text: it skips what precedes its first page and reads on into later blocks until its last page is closed.  So
every page comes out once, however the file is cut, of files of one stream and of many.

Files are opened through pyarrow's file systems, so a path is one they know (local or shared folders, HDFS, S3) on every executor.

Defined cases: a file without pages gives none; an empty page text is an empty string; a page that the file does not close is an error; a file
whose blocks cannot be unpacked is an error.
"""

from __future__ import annotations

import bz2
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cardloom.operators import corpus

#: The marks of a block and of a stream's end.
BLOCK, END = 0x314159265359, 0x177245385090
STRETCH = 64 << 20
#: Most bytes between two marks: an incompressible block of 900,000 bytes and its tables.
LONGEST = 1_200_000
SCHEMA = "page_id long, ns int, title string, redirect string, text string"
_OPEN, _CLOSE = b"<page>", b"</page>"


def marks(data: bytes, mark: int) -> list[int]:
    """Bit offsets of a mark in the data."""
    found = []
    for shift in range(8):
        # The five bytes that the mark fills whole when it begins `shift` bits into a byte.
        needle = (mark >> shift & (1 << 40) - 1).to_bytes(5, "big")
        at = data.find(needle)
        while at >= 0:
            bit = 8 * (at - 1) + shift
            if bit >= 0 and bit + 48 <= 8 * len(data):
                first = bit >> 3
                if int.from_bytes(data[first : first + 7].ljust(7, b"\0"), "big") >> (8 - (bit & 7)) & (1 << 48) - 1 == mark:
                    found.append(bit)
            at = data.find(needle, at + 1)
    return sorted(set(found))


def unpacked(data: bytes, first: int, last: int) -> bytes:
    """The text of the block in the bits [first, last)."""
    bits = np.unpackbits(np.frombuffer(data[first >> 3 : -(-last // 8)], np.uint8))[first & 7 :][: last - first]
    check = bits[48:80]  # of one block, the stream's check is its own
    end = np.unpackbits(np.frombuffer(END.to_bytes(6, "big"), np.uint8))
    return bz2.decompress(b"BZh9" + np.packbits(np.concatenate((bits, end, check))).tobytes())


class Blocks:
    """Texts of a file's blocks from an offset on."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._file = system.open_input_file(name)
        self.size = self._file.size()

    def of(self, lo: int) -> Iterator[tuple[int, bytes]]:
        """(byte of its mark, text) of each block whose mark begins at lo or later."""
        base = lo
        while base < self.size:
            data = self._file.read_at(min(4 * LONGEST, self.size - base), base)
            whole = base + len(data) >= self.size
            starts = marks(data, BLOCK)
            if not starts:
                if whole:
                    return
                base += len(data) - 8
                continue
            edges = sorted([*starts, *marks(data, END)])
            done = False
            for first in starts:
                after = next((e for e in edges if e > first), None)
                if after is None:
                    if first == starts[0] and (whole or len(data) >= 2 * LONGEST):
                        raise ValueError(f"a block at byte {base + (first >> 3)} has no end")
                    base, done = base + (first >> 3), True
                    break
                yield base + (first >> 3), unpacked(data, first, after)
                last = first
            if not done:
                if whole:
                    return
                base += (last >> 3) + 6  # past the last mark that was taken


def _text(raw: str, tag: str) -> str | None:
    found = re.search(rf"<{tag}(?:\s[^>]*)?(?:/>|>(.*?)</{tag}>)", raw, re.S)
    return None if found is None else html.unescape(found.group(1) or "")


def page(raw: bytes) -> tuple:
    """A page's columns from its XML."""
    text = raw.decode("utf-8")
    redirect = re.search(r'<redirect\s+title="([^"]*)"', text)
    return int(_text(text, "id")), int(_text(text, "ns") or 0), _text(text, "title"), html.unescape(redirect.group(1)) if redirect else None, _text(text, "text") or ""


def pages(path: str, lo: int, hi: int) -> Iterator[tuple]:
    """The pages that the stretch [lo, hi) of a file owns."""
    text, at, owned = b"", 0, 0  # the text from `at` on is not yet done with; tags that begin before `owned` are ours
    for mark, more in Blocks(path).of(lo):
        if mark >= hi and text.find(_OPEN, at, owned + len(_OPEN) - 1) < 0 and not any(text.endswith(_OPEN[:k]) and len(text) - k < owned for k in range(1, len(_OPEN))):
            return  # no page of ours is open, and no tag has begun
        text, at, owned = text[at:] + more, 0, owned - at + (len(more) if mark < hi else 0)
        while True:
            start = text.find(_OPEN, at)
            if start < 0 or start >= owned:
                at = max(at, min(owned, len(text)) - len(_OPEN) + 1) if start < 0 else at
                break
            end = text.find(_CLOSE, start)
            if end < 0:
                at = start
                break
            yield page(text[start:end])
            at = end + len(_CLOSE)
    if 0 <= text.find(_OPEN, at) < owned:
        raise ValueError(f"{path}: a page is not closed")


@dataclass
class Stretch(InputPartition):
    path: str
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._path, self._stretch = options["path"], int(options.get("stretch", STRETCH))

    def partitions(self) -> list[Stretch]:
        size = Blocks(self._path).size
        return [Stretch(self._path, lo, min(lo + self._stretch, size)) for lo in range(0, size, self._stretch)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        yield from pages(partition.path, partition.lo, partition.hi)


class PageDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagedump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def dump(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """(page_id, ns, title, redirect, text) of a dump, in no order."""
    spark.dataSource.register(PageDump)
    return spark.read.format("pagedump").option("stretch", stretch).load(path)


def preprocessed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles (page_id, title, source_url, clean_text) of a dump's pages, and the counts (kind, n) of all of them."""
    own = rows.withColumn("kind", F.when(F.col("redirect").isNotNull() & (F.col("ns") == 0), "redirect").otherwise(corpus.page_kind(F.col("ns"), F.col("title"), F.col("text"))))
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_")))
    articles = own.filter("kind = 'article'").select("page_id", "title", url.alias("source_url"), corpus.clean_wikitext(F.col("text")).alias("clean_text"))
    return articles, own.groupBy("kind").agg(F.count("*").alias("n"))


def write_shards(articles: DataFrame, folder: str, rows: int = 10_000) -> None:
    """Articles as JSON lines, at most `rows` a file."""
    articles.write.option("maxRecordsPerFile", rows).option("ignoreNullFields", "false").json(folder)
