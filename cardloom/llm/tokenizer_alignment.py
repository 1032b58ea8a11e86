"""Alignment of two tokenizers' tokens over the bytes of each text, and counts of aligned id pairs over the corpus.

Each text, with a blank before it, is encoded by a byte-level BPE (A) and by a SentencePiece BPE model (B); their tokens
are intervals of its bytes.  Offsets where tokens of both end cut the tokens into groups, and an A and a B token whose
intervals overlap are linked.

Documents are gathered into chunks inside a task, and a chunk's texts are cut before blanks that no token of either tokenizer crosses
(between a character that is no blank and one that is no white space), so each distinct unit of a chunk is encoded and
aligned once.  DuckDB aligns them: tables of token intervals, two ASOF joins with range conditions (the B token in which an A token
begins, and the A token inside which a B token begins: each overlap is found by exactly one of them), and window sums over the
shared ends for the groups.  Units are told apart by their bytes.

A chunk gives its documents' distinct pairs and, for each pair, how many of its documents hold it linked.  Spark adds up these partial
counts by pair, marks the highest of each A id, joins them back to the pairs that chunks hold, and each chunk's documents read
their sums from its own pairs.  A frequent pair is one row a chunk, so no key is hot; nothing is broadcast or collected.

Defined cases: null and empty texts, and texts whose tokens' bytes do not give back the blank and the text (U+2581 in it, for one),
have no tokens and zeros; special tokens in texts are plain text; rows that repeat or share a doc_id count and are reported each, a null doc_id as null; ties for
the highest count are all best; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean, stored
from .textview import column, distinct, ranges

#: Text bytes of a chunk.
CHUNK_BYTES = 5 << 20
#: Units that go to a tokenizer at once.
UNITS = 20_000

_BLANK, _FEW = 32, (9, 10, 11, 12, 13)
#: First bytes of characters that are surely no white space.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xE4:0xF5] = True


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units of all rows, and the rows' offsets among them; every row begins with a blank."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:-1] = (data[1:-1] == _BLANK) & (data[:-2] != _BLANK) & _SOLID[data[2:]]
    cut[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, off)


def _texts(cut: np.ndarray, texts: pa.Array, mark: str) -> pa.Array:
    """The texts of each [cut, next cut) with the mark between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(cut, texts), pa.scalar(mark, pa.large_string()))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


class ByteLevel:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True
        rules = json.loads(self._own.to_str())
        if rules["pre_tokenizer"]["type"] != "ByteLevel" or rules["pre_tokenizer"]["add_prefix_space"] or rules["normalizer"]:
            raise ValueError("only byte-level tokenizers that keep texts as they are can be aligned")
        # A byte is shown as itself where that is a visible character, else as the next character from 256 on.
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        entries = {i: bytes(byte[c] for c in t) if i not in self._own.get_added_tokens_decoder() else t.encode() for t, i in self._own.get_vocab().items()}
        self.bytes = _joined([entries.get(i, b"") for i in range(max(entries) + 1)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._own.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models that keep texts as they are, after a first blank, can be aligned")
        if any("▁" in p.piece[1:] and p.piece.strip("▁") for p in model.pieces):
            raise ValueError("a piece with a blank after its first character could cross units")
        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = _joined([bytes([int(p.piece[3:-1], 16)]) if self._own.is_byte(i) else p.piece.replace("▁", " ").encode() for i, p in enumerate(model.pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode([t[1:] for t in texts], num_threads=1)


@cache
def _encoders(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    """One pair a worker process."""
    return ByteLevel(byte_level), Pieces(pieces)


def _tokens(encoder: ByteLevel | Pieces, texts: list[str], data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all units in turn, each unit's number of them, and whether their bytes are the unit's."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(texts), UNITS):
        got = encoder.encode(texts[lo : lo + UNITS])
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter((i for x in got for i in x), np.int32, int(sizes[-1].sum())))
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    flat, at = encoder.bytes
    length = np.diff(at)[ids]
    total = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))]
    good = np.diff(total) == np.diff(off)
    own = np.repeat(good, sizes)
    spelt = flat[ranges(at[:-1][ids[own]], length[own])]
    kept = np.repeat(good, np.diff(off))
    wrong = np.flatnonzero(spelt != data[kept])
    good[np.searchsorted(off, np.flatnonzero(kept)[wrong], side="right") - 1] = False
    return ids, sizes, good


_LINKS = """
SELECT a.pos AS a, b.pos AS b, a.unit AS unit FROM a ASOF JOIN b ON a.lo >= b.lo WHERE b.hi > a.lo
UNION ALL
SELECT a.pos, b.pos, a.unit FROM b ASOF JOIN a ON b.lo > a.lo WHERE a.hi > b.lo
ORDER BY 1, 2
"""
_GROUPS = """
WITH ends AS (SELECT a.hi FROM a JOIN b USING (hi)),
ended AS (SELECT t.pos, t.unit, CAST(e.hi IS NOT NULL AS INT) AS shared FROM {side} t LEFT JOIN ends e USING (hi))
SELECT CAST(coalesce(sum(shared) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM ended ORDER BY pos
"""


class Aligned:
    """The distinct units of one chunk with their tokens, groups and links."""

    def __init__(self, spans: pa.Array, byte_level: str, pieces: str):
        raw = spans.cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        texts = spans.cast(pa.large_string()).to_pylist()
        a, b = (_tokens(e, texts, data, off) for e in _encoders(byte_level, pieces))
        self.good = a[2] & b[2]
        tables, bytes_of = {}, [e.bytes for e in _encoders(byte_level, pieces)]
        for name, (ids, sizes, _), (_, at) in zip("ab", (a, b), bytes_of, strict=True):
            unit = np.repeat(np.arange(len(sizes)), sizes)
            own = self.good[unit]
            length = np.diff(at)[ids]
            hi = np.cumsum(length) if len(ids) else np.zeros(0, np.int64)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            hi = hi - np.repeat(np.concatenate(([0], hi))[begin[:-1]], sizes) + off[:-1][unit]  # bytes of the unit's place, whatever came before
            tables[name] = pa.table({"pos": np.arange(int(own.sum())), "id": ids[own], "unit": unit[own], "lo": (hi - length)[own], "hi": hi[own]})
        db = duckdb.connect(":memory:", config={"threads": "1", "temp_directory": ""})
        try:
            for name, table in tables.items():
                db.register(f"{name}_arrow", table)
                db.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
            links = db.execute(_LINKS).to_arrow_table()
            group = {name: db.execute(_GROUPS.format(side=name)).to_arrow_table()["g"].to_numpy() for name in tables}
        finally:
            db.close()
        ids = {name: tables[name]["id"].to_numpy() for name in tables}
        edges = np.arange(len(spans) + 1)
        bounds = {name: np.searchsorted(tables[name]["unit"].to_numpy(), edges) for name in tables}
        self.n_a, self.n_b = (np.diff(bounds[name]) for name in tables)
        unit = links["unit"].to_numpy()
        self.link_bounds = np.searchsorted(unit, edges)
        codes = ids["a"][links["a"].to_numpy()].astype(np.int64) << 32 | ids["b"][links["b"].to_numpy()]
        self.pairs, self.links = np.unique(codes, return_inverse=True)
        # Texts of groups, then of units: all tokens tile their unit, so every group has tokens of both kinds.
        count = int(group["a"][-1]) + 1 if len(group["a"]) else 0
        sides = []
        for name in tables:
            cut = np.searchsorted(group[name], np.arange(count + 1))
            sides.append(_texts(cut, pa.array(ids[name]).cast(pa.large_string()), ","))
        texts = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        cut = np.searchsorted(tables["a"]["unit"].to_numpy()[np.searchsorted(group["a"], np.arange(count))], edges)
        self.n_groups = np.diff(cut)
        self.groups = _texts(cut, texts, ";")


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(number, doc_ids, bytes, offsets) of runs of documents of some `limit` bytes, each text that is not empty after a blank."""
    part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        length = np.concatenate([x[1] for x in held])
        text = np.concatenate([x[2] for x in held])
        off = np.concatenate(([0], np.cumsum(length + (length > 0))))
        out = np.full(int(off[-1]), _BLANK, np.uint8)
        out[ranges(off[1:] - length, length)] = text
        return part << 24 | at, pa.concat_arrays([x[0] for x in held]), out, off

    for batch in batches:
        data, off = column(batch, "text")
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit - size, side="right")) - 1))
            held.append((batch.column("doc_id").slice(lo, hi - lo), np.diff(off[lo : hi + 1]), data[off[lo] : off[hi]]))
            size += int(off[hi] - off[lo])
            lo = hi
            if size >= limit or lo < batch.num_rows:
                yield close()
                at, held, size = at + 1, [], 0
    if held:
        yield close()


class _Chunk:
    """One chunk's units and which rows have tokens."""

    def __init__(self, data: np.ndarray, off: np.ndarray, byte_level: str, pieces: str):
        starts, bounds = units(data, off)
        which, spans = distinct(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
        self.own = Aligned(spans, byte_level, pieces)
        bad = np.concatenate(([0], np.cumsum(~self.own.good[which])))
        self.good = np.diff(bad[bounds]) == 0
        n = np.where(self.good, np.diff(bounds), 0)  # a row without tokens has no units from here on
        self.units = which[ranges(bounds[:-1], n)]
        self.bounds = np.concatenate(([0], np.cumsum(n)))

    def total(self, per_unit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(per_unit[self.units])))[self.bounds])

    def groups(self) -> pa.Array:
        """Each row's groups as text."""
        return _texts(self.bounds, self.own.groups.take(pa.array(self.units)), ";")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each row by row and pair: the pair, its links in the row, and each row's offsets."""
        n = np.diff(self.own.link_bounds)[self.units]
        row = np.repeat(np.repeat(np.arange(len(self.good)), np.diff(self.bounds)), n)
        kinds = max(len(self.own.pairs), 1)
        keys = np.sort(row * kinds + self.own.links[ranges(self.own.link_bounds[:-1][self.units], n)])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return (keys[first] % kinds).astype("<i4"), np.diff(first, append=len(keys)).astype("<i4"), np.searchsorted(keys[first] // kinds, np.arange(len(self.good) + 1))


def token_groups(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, groups): every group's A and B ids as `a1,a2|b1;a3|b2,b3`."""
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, data, off in _chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([ids, _Chunk(data, off, byte_level, pieces).groups().cast(pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(write), "doc_id long, groups string")


_CHUNK = "chunk long, ids array<long>, sizes binary, shas array<string>, bounds binary, pair binary, times binary, a array<int>, b array<int>, held array<long>"


def chunk_table(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row a chunk, written to the shared folder: its documents' own counts and digests, their distinct pairs, and the chunk's pairs with how many of its documents hold each."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, data, off in _chunks(batches, CHUNK_BYTES):
            own = _Chunk(data, off, byte_level, pieces)
            pair, times, bounds = own.pairs()
            shas = [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(own.groups(), np.diff(own.bounds).tolist(), strict=True)]
            sizes = np.stack([own.total(x) for x in (own.own.n_a, own.own.n_b, own.own.n_groups, np.diff(own.own.link_bounds))])
            held = np.bincount(pair, minlength=len(own.own.pairs))
            used = np.flatnonzero(held)  # units of rows without tokens may have others
            again = np.zeros(len(held), "<i4")
            again[used] = np.arange(len(used))
            packed = [zstandard.compress(x.tobytes(), 1) for x in (sizes.astype("<i8"), bounds.astype("<i8"), again[pair], times)]
            listed = [pa.array([x], pa.list_(t)) for x, t in (((own.own.pairs[used] >> 32).astype(np.int32), pa.int32()), ((own.own.pairs[used] & 0xFFFFFFFF).astype(np.int32), pa.int32()), (held[used], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([packed[0]], pa.binary()), pa.array([shas]), *(pa.array([x], pa.binary()) for x in packed[1:]), *listed], names=[c.split()[0] for c in _CHUNK.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(lean(work), _CHUNK), "alignment-chunks")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold each id pair linked, and whether no pair of that A id is in more."""
    partial = chunks.select(F.explode(F.arrays_zip("a", "b", "held")).alias("p")).select("p.*")
    total = partial.groupBy("a", "b").agg(F.sum("held").alias("n"))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs: DataFrame, byte_level: str, pieces: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row each, and the corpus's pairs (a, b, n, best)."""
    chunks = chunk_table(docs, byte_level, pieces)
    pairs = stored(pair_counts(chunks), "alignment-pairs")
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("asker", "at", "p.a", "p.b")
    answers = asked.join(pairs, ["a", "b"]).select("asker", "at", "n", "best")

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right["at"].to_numpy())
        n, best = right["n"].to_numpy()[at], right["best"].to_numpy()[at]
        out = []
        for row in left.to_pylist():
            sizes, bounds, pair, times = (np.frombuffer(zstandard.decompress(row[c]), t) for c, t in (("sizes", "<i8"), ("bounds", "<i8"), ("pair", "<i4"), ("times", "<i4")))
            sums = [np.diff(np.concatenate(([0], np.cumsum(times * x)))[bounds]) for x in (best[pair].astype(np.int64), n[pair])]
            columns = [pa.array(row["ids"], pa.int64()), *map(pa.array, sizes.reshape(4, -1)), *map(pa.array, sums), pa.array(row["shas"], pa.string())]
            out.append(pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    own = chunks.drop("a", "b", "held")
    documents = own.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(lean(read), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return documents, pairs


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents, _ = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return documents
