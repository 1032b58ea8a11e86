"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units that no piece crosses: white-space-separated words, cut wherever two characters
meet that no piece holds side by side, a word keeping the one blank before it as its first
character.  The distinct units of the whole corpus are encoded once: their substrings up to the length of the
longest piece are exploded and equi-joined to the piece table, the edges so found are grouped by unit, and one
higher-order aggregate folds them into the unit's segmentation.  Substrings whose hash no piece has
are left out before they become rows, as a Bloom filter would; the join decides about the rest.

The fold depends on the kind of model.  For a unigram model it is Viterbi: edges by their end, each
position keeping the best sum of scores and the edge that gave it.  A BPE model (as `piece_bpe_32k`
is) does not define its encoding by a best sum: pieces are merges, applied from the best score down and
from left to right.  For it the same fold runs over the edges in that order, with the set of boundaries that
still stand as its state: an edge applies if both its ends stand and one boundary stands between.
tests/llm hold the result against the sentencepiece library.  `encode` is for BPE models whose words begin with a
blank and refuses others; `lattice` folds both kinds.

Documents are gathered into chunks (a bucketed table, so it need not be shuffled again).  A chunk asks
buckets of the units' hashes for its distinct units, sending the units themselves, so that equal hashes cannot
mislead, and gets their ids in the order of its request.

Defined cases: null or empty text has no pieces; characters without a piece become
byte pieces; units of more than MAX_UNIT characters are merged in Python, one at a time; repeated
rows are encoded each; U+2581 in a text is the blank's mark and decodes as a blank; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import bounded_batches, lean, text_bytes
from .lm_scoring import _bucket, _planes, _unplanes, chunks
from .textview import BLOCK_BYTES, between, byte_prefix, ranges, words

MARK = "▁"
#: Boundaries are bits of one long.
MAX_UNIT = 61
#: Text bytes of a chunk.
CHUNK_BYTES = 14 << 20
#: Text bytes for each bucket of distinct units, and units that a task groups in memory before it falls back to sorting.
UNIT_BYTES = 4 << 20
GROUPED = 60_000
_SEED = 71
_FIRST_BYTE = 3  # id of <0x00>
_FILTER_LOG2 = 22

#: No piece has these beside anything else; a carriage return may stand in a piece with marks.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 32]] = True


def checked(model: str) -> None:
    """Refuse models that `encode` would encode otherwise than they do."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as file:
        m.ParseFromString(file.read())
    rules = m.normalizer_spec
    if m.trainer_spec.model_type != m.trainer_spec.BPE or not m.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte pieces can be encoded")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
        raise ValueError("only models that keep texts as they are, after a first blank, can be encoded")


def piece_rows(model: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of a model's ordinary pieces, at most some ten thousand; runs of blanks are not among them."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    ordinary = (i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), i, m.get_score(i)) for i in ordinary if m.id_to_piece(i).strip(MARK) or m.id_to_piece(i) == MARK]


def blank_rows(model: str) -> dict[int, int]:
    """length -> id of the pieces that are runs of blanks."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    longest = max(len(m.id_to_piece(i)) for i in range(m.get_piece_size()))
    return {n: i for n in range(1, longest + 1) if (i := m.piece_to_id(MARK * n)) != m.unk_id()}


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """BPE by a queue: best score first, then leftmost."""
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    text: list[str | None] = list(symbols)
    queue: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (both := text[i] + text[j]) in score:
            heapq.heappush(queue, (-score[both], i, j, both))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, both = heapq.heappop(queue)
        if text[i] is None or text[j] is None or after[i] != j or text[i] + text[j] != both:
            continue
        text[i], text[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [t for t in text if t is not None]


class Pieces:
    """What tasks know of the pieces: which characters meet in one, which hashes they have, and the ids of single characters."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        self.longest = max(len(p) for p, _, _ in rows)
        self.score = {p: s for p, _, s in rows}
        self.number = {p: i for p, i, _ in rows}
        self.meet = np.zeros(1 << 16, dtype=bool)  # last byte of a character, first byte of the next
        for p in self.number:
            own = p.replace(MARK, " ")
            for a, b in zip(own[:-1], own[1:], strict=True):
                self.meet[a.encode()[-1] << 8 | b.encode()[0]] = True
        raw = [p.replace(MARK, " ").encode() for p in self.number if len(p) > 1]
        ends = np.cumsum([len(x) for x in raw])
        hashes = between(byte_prefix(np.frombuffer(b"".join(raw), np.uint8), _SEED), ends - [len(x) for x in raw], ends)
        self.known = np.zeros(1 << _FILTER_LOG2, dtype=bool)
        self.known[(hashes >> np.uint64(64 - _FILTER_LOG2)).astype(np.int64)] = True
        single = sorted((ord(p), i) for p, i in self.number.items() if len(p) == 1)
        self.points, self.point_ids = np.array([x[0] for x in single]), np.array([x[1] for x in single])

    def spans(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, start, length in characters) of the substrings of two characters or more that may be pieces, by unit."""
        first = np.flatnonzero((flat & 0xC0) != 0x80)
        bounds = np.searchsorted(first, off)
        unit = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
        left = bounds[1:][unit] - np.arange(len(first))  # characters from here to the unit's end
        sums, edge = byte_prefix(flat, _SEED), np.append(first, len(flat))
        at, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.arange(len(first))
        for n in range(2, self.longest + 1):
            here = here[left[here] >= n]
            found = here[self.known[(between(sums, edge[here], edge[here + n]) >> np.uint64(64 - _FILTER_LOG2)).astype(np.int64)]]
            at.append(found)
            size.append(np.full(len(found), n))
        at, size = np.concatenate(at), np.concatenate(size)
        order = np.argsort(at, kind="stable")
        at, size = at[order], size[order]
        return unit[at], at - bounds[:-1][unit[at]], size

    def ids_of(self, unit: str) -> list[int]:
        """A unit's ids by merging alone."""
        out: list[int] = []
        for p in merged(list(unit), self.score):
            out += [self.number[p]] if p in self.number else [_FIRST_BYTE + b for b in p.encode()]
        return out


def lattice(units: DataFrame, pieces: DataFrame, kind: str = "bpe", longest: int = 16) -> DataFrame:
    """(key, unit, cuts, starts, ids): segmentations of units (key, unit) of at most MAX_UNIT characters.

    `cuts` has a bit for each boundary that stands; `starts` and `ids` name the pieces.  For a BPE model a
    character that stands alone is no edge and is not named; for a unigram model id -1 marks one without a piece.
    pieces are (piece, id, score) and broadcast: they come from a model file of bounded size.  units may bring `spans`,
    the substrings worth joining as 32 * start + length; else all up to `longest` are.
    """
    one, shortest = F.lit(1).cast("long"), 2 if kind == "bpe" else 1
    bit = lambda n: F.call_function("shiftleft", one, n)
    own = units.select("key", "unit", F.length("unit").alias("n"), *(["spans"] if "spans" in units.columns else []))
    if "spans" not in units.columns:
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - s)), lambda k: 32 * s + k)))
        own = own.withColumn("spans", F.filter(every, lambda x: x % 32 >= shortest))
    rows = own.select("key", "unit", "n", F.explode(F.concat(F.array(F.lit(0)), F.col("spans"))).alias("x"))  # 0: a unit without spans keeps a row
    rows = rows.select("key", "unit", "n", F.shiftright("x", 5).alias("s"), (F.col("x") % 32).alias("len"))
    rows = rows.select("key", "unit", "n", "s", "len", (F.col("s") + F.col("len")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("len")).alias("piece"))
    edges = rows.join(F.broadcast(pieces), "piece", "left")
    ends = bit(F.col("s")).bitwiseOR(bit(F.col("e")))
    inside = bit(F.col("e")) - bit(F.col("s") + 1)
    score = F.coalesce(F.col("score"), F.lit(-100.0))
    first = -score if kind == "bpe" else F.col("e").cast("double")
    fields = [first.alias("first"), F.col("s"), ends.alias("ends"), inside.alias("inside"), F.coalesce("id", F.lit(-1)).alias("id")]
    edge = F.struct(*fields, *([] if kind == "bpe" else [F.col("e"), score.alias("score")]))
    is_edge = (F.col("len") >= shortest) & (F.col("id").isNotNull() | (F.col("len") == 1))
    grouped = edges.groupBy("key", "unit").agg(F.sort_array(F.collect_list(F.when(is_edge, edge))).alias("edges"), F.first("n").alias("n"))
    if kind == "bpe":
        start = bit(F.col("n") + 1) - 1
        standing = F.aggregate("edges", start, lambda cut, x: F.when((cut.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cut.bitwiseAND(x["inside"])) == 1), cut.bitwiseAND(F.bitwise_not(x["inside"]))).otherwise(cut))
    else:
        # best[i]: score and boundaries of the best way to position i.
        none = F.struct(F.lit(-1e300).alias("score"), F.lit(0).cast("long").alias("cuts"))
        best = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), one.alias("cuts"))), F.array_repeat(none, F.col("n")))

        def step(found, x):
            new = F.struct((found[x["s"]]["score"] + x["score"]).alias("score"), found[x["s"]]["cuts"].bitwiseOR(bit(x["e"])).alias("cuts"))
            better = new["score"] > found[x["e"]]["score"]
            return F.when(better, F.transform(found, lambda v, i: F.when(i == x["e"], new).otherwise(v))).otherwise(found)

        standing = F.element_at(F.aggregate("edges", best, step), -1)["cuts"]
    folded = grouped.select("key", "unit", "edges", standing.alias("cuts"))
    kept = F.filter("edges", lambda x: (F.col("cuts").bitwiseAND(x["ends"]) == x["ends"]) & (F.col("cuts").bitwiseAND(x["inside"]) == 0))
    path = F.sort_array(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    return folded.select("key", "unit", "cuts", path.alias("path")).select("key", "unit", "cuts", F.col("path")["s"].alias("starts"), F.col("path")["id"].alias("ids"))


def named(known: pa.Table, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the units of a BPE `lattice`, the characters that stand alone put in."""
    text = pc.binary_join(pa.chunked_array([pa.array([known.column("unit").cast(pa.string()).to_pylist()], pa.list_(pa.string()))]), "").to_pylist()[0] if len(known) else ""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    n = pc.utf8_length(known.column("unit").cast(pa.string())).to_numpy().astype(np.int64)
    base = np.cumsum(n) - n
    bits = np.unpackbits(known.column("cuts").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    unit, at = np.nonzero(bits)
    unit, at = unit[at < n[unit]], at[at < n[unit]]
    ids = np.full(len(unit), -1, np.int64)
    many = pc.list_value_length(known.column("ids")).to_numpy().astype(np.int64)
    starts, own = (pc.list_flatten(known.column(c)).to_numpy().astype(np.int64) for c in ("starts", "ids"))
    ids[np.searchsorted(unit * 64 + at, np.repeat(np.arange(len(n)), many) * 64 + starts)] = own
    alone = np.flatnonzero(ids < 0)
    point = points[base[unit[alone]] + at[alone]]
    place = np.minimum(np.searchsorted(pieces.points, point), len(pieces.points) - 1)
    have = pieces.points[place] == point
    ids[alone[have]] = pieces.point_ids[place[have]]
    odd, size = alone[~have], np.ones(len(ids), np.int64)
    spelled = [chr(c).encode() for c in point[~have].tolist()]
    size[odd] = [len(b) for b in spelled]
    total = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(ids, size)
    if len(odd):
        out[ranges(total[odd], size[odd])] = _FIRST_BYTE + np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    return total[np.searchsorted(unit, np.arange(len(n) + 1))], out


class Stream:
    """Units and blanks of some texts, each text with its leading blank."""

    def __init__(self, text: bytes, sizes: np.ndarray, meet: np.ndarray):
        off = np.concatenate(([0], np.cumsum(sizes)))
        if MARK.encode() in text:  # the mark in a text is a blank
            own = [text[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            text, sizes = b"".join(own), np.array([len(x) for x in own], np.int64)
            off = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(text, np.uint8)
        self.off = off + np.concatenate(([0], np.cumsum(sizes > 0)))
        data = np.full(int(self.off[-1]), 32, np.uint8)
        some = sizes > 0
        data[ranges(self.off[:-1][some] + 1, sizes[some])] = raw
        starts, ends, _ = words(data, self.off, _WHITE)
        if len(data) > 1:
            cut = np.zeros(len(data), dtype=bool)
            cut[1:] = ~meet[data[:-1].astype(np.int32) << 8 | data[1:]] & ((data[1:] & 0xC0) != 0x80) & ~_WHITE[data[1:]]
            cut[starts] = False
            cut = np.flatnonzero(cut)
            starts, ends = np.sort(np.concatenate((starts, cut)), kind="stable"), np.sort(np.concatenate((ends, cut)), kind="stable")
        self.data, self.starts, self.ends = data, starts.astype(np.int32), ends.astype(np.int32)
        begin = starts - (data[starts - 1] == 32)  # a text starts with a blank, so there is a byte before
        size = ends - begin
        bounds = np.concatenate(([0], np.cumsum(size)))
        flat = data[ranges(begin, size)]
        found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        #: Distinct units, a blank before those that follow one, and each unit's index among them.
        self.units, self.at = found.dictionary, found.indices.to_numpy()

    def encode(self, own: np.ndarray, bounds: np.ndarray, ids: np.ndarray, blanks: dict[int, int], controls: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's offsets in them; distinct unit u has ids[bounds[own[u]]:bounds[own[u] + 1]], the white-space character c controls[c]."""
        size = np.diff(bounds)[own]
        ids = ids[ranges(bounds[own], size)]  # of this stream's units, in its order
        bounds = np.concatenate(([0], np.cumsum(size)))
        data, white = self.data, self.data == 32
        edge = np.diff(white.astype(np.int8), prepend=0, append=0)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = self.off[1:][np.searchsorted(self.off[1:], lo, side="right")] if len(lo) else lo
        crossing = hi > row  # a text may end in blanks, and the next begins with one
        while crossing.any():
            lo, hi = np.concatenate((lo, row[crossing])), np.concatenate((np.where(crossing, row, hi), hi[crossing]))
            order = np.argsort(lo)
            lo, hi = lo[order], hi[order]
            row = self.off[1:][np.searchsorted(self.off[1:], lo, side="right")]
            crossing = hi > row
        unit = np.searchsorted(self.starts, hi)
        follows = (unit < len(self.starts)) & (hi < row)
        follows[follows] = self.starts[unit[follows]] == hi[follows]
        start, size = bounds[self.at], np.diff(bounds)[self.at]
        lone = np.zeros(len(lo), dtype=bool)
        lone[follows] = ids[start[unit[follows]]] == blanks[1]
        whole = follows & lone & (hi - lo > 1)
        left = np.where(follows & ~whole, hi - lo - 1, hi - lo)
        start, size = start.copy(), size.copy()
        start[unit[whole]] += 1
        size[unit[whole]] -= 1
        more = left > 0
        other = np.flatnonzero((data >= 9) & (data <= 12))
        lengths = np.unique(left[more])
        runs = [blank_run(int(n), tuple(sorted(blanks.items()))) for n in lengths]
        store = np.concatenate([ids, np.array(controls, ids.dtype), *[np.array(r, ids.dtype) for r in runs]])
        run_at = len(ids) + 16 + np.cumsum([0, *map(len, runs)])
        k = np.searchsorted(lengths, left[more])
        place = np.concatenate((self.starts, lo[more], other))
        begin = np.concatenate((start, run_at[k], len(ids) + data[other].astype(np.int64)))
        count = np.concatenate((size, np.diff(run_at)[k], np.ones(len(other), np.int64)))
        order = np.argsort(place, kind="stable")
        total = np.concatenate(([0], np.cumsum(count[order])))
        return store[ranges(begin[order], count[order])], total[np.searchsorted(place[order], self.off)]


def streams(row: dict, meet: np.ndarray) -> Iterator[Stream]:
    """A chunk's texts in streams of some BLOCK_BYTES, so that no task holds arrays many times a chunk's size."""
    text, sizes = zstandard.decompress(row["text"]), np.frombuffer(row["sizes"], np.int64)
    off, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, side="right")) - 1)
        yield Stream(text[off[lo] : off[hi]], sizes[lo:hi], meet)
        lo = hi


def flat_units(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of binary values."""
    _, offsets, data = units.buffers()
    off = np.frombuffer(offsets, np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def distinct_units(parts: list[pa.Array], buckets: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """A chunk's distinct units by bucket, their buckets, and for each part the places of its units among them."""
    every = pa.concat_arrays(parts).dictionary_encode()
    flat, off = flat_units(every.dictionary)
    bucket = _bucket(between(byte_prefix(flat, _SEED), off[:-1], off[1:]), buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places, cuts = rank[every.indices.to_numpy()], np.cumsum([len(p) for p in parts])
    return every.dictionary.take(pa.array(order)), bucket[order], np.split(places, cuts[:-1])


def packed_units(units: pa.Array) -> bytes:
    flat, off = flat_units(units)
    return zstandard.compress(np.int64(len(units)).tobytes() + np.diff(off).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + flat.tobytes(), 3)


def unpacked_units(packed: bytes) -> pa.Array:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, -1).T).view("<u4").ravel()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(raw[8 + 4 * n :])])


@cache
def blank_run(n: int, blanks: tuple[tuple[int, int], ...]) -> list[int]:
    """Ids of n blanks in a row: all their pieces score alike, so the leftmost merge comes first."""
    known = dict(blanks)
    return [known[len(x)] for x in merged([MARK] * n, {MARK * k: 0.0 for k in known})]


class Speller:
    """Bytes of ids: pieces joined, marks as blanks, byte pieces as bytes, without the leading blank."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        spelled = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.size = np.array([len(x) for x in spelled])
        self.flat, self.first = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.size) - self.size

    def text(self, ids: np.ndarray) -> str:
        return self.flat[ranges(self.first[ids], self.size[ids])].tobytes()[1:].decode()


def encode(docs: DataFrame, model: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids): ids as little-endian uint32; `with_text` adds `text`, what the ids decode to, in the same pass."""
    checked(model)
    spark = docs.sparkSession
    bounded_batches(spark)
    size = text_bytes(docs)
    buckets = int(max(16, size // UNIT_BYTES))
    rows = piece_rows(model)
    table = spark.createDataFrame(rows, "piece string, id int, score double")
    pieces, blanks = Pieces(rows), blank_rows(model)
    controls = [pieces.number.get(chr(c), _FIRST_BYTE + c) for c in range(16)]
    speller = Speller(model) if with_text else None
    narrow = "<u2" if max(pieces.number.values()) < 1 << 16 else "<u4"
    gathered = _bucketed(spark, chunks(docs.select("doc_id", "text"), CHUNK_BYTES).drop("held"), int(max(1, size // (2 * CHUNK_BYTES))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units, bucket, _ = distinct_units([s.units for s in streams(row, pieces.meet)], buckets)
                at = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(at)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]]), pa.array([packed_units(units.slice(at[b], at[b + 1] - at[b]))], pa.binary())], names=["bucket", "chunk", "units"])

    def spread(asked: pa.Table) -> pa.Table:
        units = pa.concat_arrays([unpacked_units(x) for x in asked.column("units").to_pylist()]).dictionary_encode().dictionary
        flat, off = flat_units(units)
        first = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
        units = units.take(pa.array(np.flatnonzero(first[off[1:]] - first[off[:-1]] <= MAX_UNIT)))
        unit, start, length = pieces.spans(*flat_units(units))
        cuts = np.searchsorted(unit, np.arange(len(units) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(cuts), pa.array((32 * start + length).astype(np.int32)))
        return pa.table({"key": pa.array(np.full(len(units), asked.column("bucket")[0].as_py(), np.int64)), "unit": pc.replace_substring(units.cast(pa.string()), " ", MARK, max_replacements=1), "spans": spans})

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        bounds, ids = named(known, pieces)
        have = pc.replace_substring(known.column("unit").cast(pa.string()), MARK, " ", max_replacements=1).cast(pa.binary())
        extra, more = {}, []
        out = []
        for row in asked.to_pylist():
            units = unpacked_units(row["units"])
            at = pc.index_in(units, have)
            want = at.fill_null(-1).to_numpy().astype(np.int64)
            for k in np.flatnonzero(want < 0).tolist():  # over MAX_UNIT characters
                unit = units[k].as_py()
                if unit not in extra:
                    extra[unit] = len(have) + len(more)
                    more.append(np.array(pieces.ids_of(unit.decode().replace(" ", MARK)), np.int64))
                want[k] = extra[unit]
            edge = np.concatenate((bounds, bounds[-1] + np.cumsum([len(x) for x in more], dtype=np.int64)))
            store = np.concatenate((ids, *more)) if more else ids
            sizes = np.diff(edge)[want]
            out.append({"chunk": row["chunk"], "bucket": row["bucket"], "sizes": _planes(sizes.astype("<u4")), "ids": _planes(store[ranges(edge[want], sizes)].astype(narrow))})
        return pa.Table.from_pylist(out, schema=_answers)

    _answers = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        empty = np.zeros(0, np.int64)
        bounds = np.cumsum(np.concatenate([[0], *[_unplanes(r["sizes"], "<u4") for r in got]]), dtype=np.int64)
        ids = np.concatenate([empty, *[_unplanes(r["ids"], narrow) for r in got]]).astype("<u4")
        out = []
        for row in left.to_pylist():
            parts, done = list(streams(row, pieces.meet)), 0
            places = distinct_units([s.units for s in parts], buckets)[2]
            while parts:
                found, cut = parts.pop(0).encode(places.pop(0), bounds, ids, blanks, controls)
                raw, at, n = found.tobytes(), (4 * cut).tolist(), len(cut) - 1
                columns = {"doc_id": pa.array(row["ids"][done : done + n], pa.int64()), "n_pieces": pa.array(np.diff(cut)), "ids": pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())}
                if speller:
                    columns["text"] = pa.array([speller.text(found[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
                out.append(pa.table(columns))
                done += n
        return pa.concat_tables(out)

    # A unit's edges come from one row, so grouping them by hash needs no sort while a task's units fit.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED))
    asked = gathered.mapInArrow(lean(ask), "bucket int, chunk long, units binary").repartition(buckets, "bucket")  # once for both uses
    units = asked.groupBy("bucket").applyInArrow(lean(spread), "key long, unit string, spans array<int>").repartition(buckets, "key")
    answers = lattice(units, table).groupBy("key").cogroup(asked.groupBy("bucket")).applyInArrow(lean(answer), "chunk long, bucket int, sizes binary, ids binary")
    return gathered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(walk), "doc_id long, n_pieces long, ids binary" + ", text string" * with_text)


def _bucketed(spark: SparkSession, df: DataFrame, buckets: int) -> DataFrame:
    """df written to the warehouse in buckets of `chunk`: later groupings by chunk read it in place."""
    name = f"pieces_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids) with `text`, what the ids spell."""
    speller = Speller(model)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [speller.text(np.frombuffer(raw, "<u4")) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "text string"])
    return encoded.mapInArrow(lean(run), schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, with_text=True)
    return found.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
