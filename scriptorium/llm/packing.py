"""Packing documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

#: Ids of a full sequence, and the id that ends a document.
SIZE, END = 2048, 1
#: Pieces are cut to fill sequences only if uncut ones would leave more than this share of padding; gaps shorter than CUT stay.
SLACK, CUT = 0.01, 64
#: Units of text that a worker remembers, and all their ids; full memories start anew.
UNITS, UNIT_IDS = 1_000_000, 8_000_000
#: Bytes of text encoded at a time (or one longer text), and pieces of a length that are ranked together.
SLICE, RANKED = 8 << 20, 512

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
STOP = np.isin(np.arange(256), [44, 46])
#: Units of these bytes alone are lower-cased before they are remembered; the tokenizer's added tokens hold a "<".
PLAIN = (np.arange(256) < 128) & (np.arange(256) != ord("<"))


def by_words(spec: dict) -> bool:
    """Whether texts may be cut at ASCII white space, before a full stop or comma that ends a word, and lower-cased if plain:
    the tokenizer drops white space, lower-cases, and parts letters from other characters. Others get whole texts."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [n.get("type") for n in norm.get("normalizers", [norm])]
    first = pre.get("pretokenizers", [pre])[0]
    # fixed value: the pattern of this tokenizer family
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed"
            and first.get("invert") is True and first.get("pattern") == {"Regex": pattern} and not spec.get("post_processor")
            and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
            and all("<" in t["content"] and t["content"][-1] == ">" for t in spec.get("added_tokens", [])))


def units(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of texts laid end to end in ``data``, without white space, and how many each text has."""
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    first[0] = True
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    begin = before | first[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, space[1:]
    stop = STOP[data] & (after | first[1:]) & ~begin
    stop[1:] &= LETTER[data[:-1]]
    begin = (begin | stop) & ~space
    count = np.concatenate([[0], np.cumsum(begin)])
    n = np.diff(count[np.concatenate([[0], ends])])
    kept = data[~space]
    starts = np.flatnonzero(begin[~space])
    if len(starts):
        plain = np.logical_and.reduceat(PLAIN[kept], starts)
        kept = np.where(np.repeat(plain, np.diff(np.append(starts, len(kept)))), LOWER[kept], kept)
    offsets = np.append(starts, len(kept)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))), n


class Ids:
    """Token ids of many texts at once; the ids of a unit of text are remembered."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores
        from tokenizers import Tokenizer

        self.tok, self.by_words = Tokenizer.from_str(spec), by_words(json.loads(spec))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, texts: list[str]) -> None:
        got, n = self.encode(texts), len(self.place)
        more = np.fromiter((i for x in got for i in x), np.int32)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        if n + len(got) > len(self.start):
            room = 2 * (n + len(got))
            self.start, self.size = (np.concatenate([a, np.zeros(room - len(a), np.int64)]) for a in (self.start, self.size))
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * (self.used + len(more)) - len(self.flat), np.int32)])
        self.size[n:n + len(got)], self.start[n:n + len(got)] = sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(more)] = more
        self.used += len(more)
        self.place.update(zip(texts, range(n, n + len(got))))

    def known(self, texts: list[str]) -> np.ndarray:
        if self.used > UNIT_IDS or len(self.place) + len(texts) > UNITS:
            self.forget()
        at = np.fromiter((self.place.get(t, -1) for t in texts), np.int64, len(texts))
        new = np.flatnonzero(at < 0)
        if len(new):
            n = len(self.place)
            self.learn([texts[i] for i in new.tolist()])
            at[new] = np.arange(n, n + len(new))
        return at

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, end to end, and the number of each."""
        if not self.by_words:
            got = self.encode(texts.to_pylist())
            return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        words, n = units(data, offsets[1:] - offsets[0])
        coded = words.dictionary_encode()
        at = self.known(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.size[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], sizes) + np.arange(total[-1])]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[upto])


_IDS: dict[str, Ids] = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def tokenized(batches: Iterator[pa.RecordBatch], spec, name: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` to pieces of at most ``size`` ids; ``row`` numbers them within the whole table."""
    made = _IDS.get(name) or _IDS.setdefault(name, Ids(spec.value))
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for b in batches:
        texts = b.column(1).fill_null("")
        lengths = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(lengths, lengths[at] + SLICE, side="right")) - 1)
            ids, n = made.batch(texts.slice(at, stop - at))
            ends = np.cumsum(n + 1)
            whole = np.full(len(ids) + len(n), end, np.int32)
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            pieces = -(-(n + 1) // size)
            doc = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = no * size
            length = np.minimum(size, (n + 1)[doc] - begin)
            bounds = np.concatenate([ends[doc] - (n + 1)[doc] + begin, [len(whole)]])
            crcs = [crc(whole[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            out = [pa.array(row + np.arange(len(doc))), b.column(0).slice(at, stop - at).take(pa.array(doc)), pa.array(begin), pa.array(length),
                   pa.array(crcs, pa.int64()), pa.array((n + 1)[doc]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(whole))]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            row, at = row + len(doc), stop


@dataclass(frozen=True)
class Pack:
    """Packs alike: how many, and their parts in order, ``(length, ids taken)``; a part that takes fewer ids than its length is cut."""

    count: int
    parts: tuple[tuple[int, int], ...]


def shortest_first(histogram: dict[int, int], size: int, cut: int | None) -> list[Pack]:
    """Lengths go longest first, each into the shortest pack that has room; counts of alike packs move together.

    A length that fits nowhere opens packs. With ``cut``, a piece that fits nowhere instead fills the shortest pack whose gap
    is at least ``cut``, and its rest is placed when its own, smaller length comes. Every step either uses up a length or a
    class of packs, or splits one class, so there are at most a few classes for each length, however many documents.
    """
    left, room, top = dict(histogram), [[] for _ in range(size + 1)], 0

    def put(count: int, parts: tuple[tuple[int, int], ...], space: int) -> None:
        nonlocal top
        if count:
            room[space].append(Pack(count, parts))
            top = max(top, space)

    for length in range(size, 0, -1):
        n = left.get(length, 0)
        while n:
            while top and not room[top]:
                top -= 1
            take = length if top >= length else top if cut and top >= cut else 0
            if take:
                pack = room[top].pop()
                k = min(pack.count, n)
                put(pack.count - k, pack.parts, top)
                put(k, (*pack.parts, (length, take)), top - take)
                if take < length:
                    left[length - take] = left.get(length - take, 0) + k
                n -= k
                continue
            per = size // length
            # with cuts, each pack will take one more piece in part
            full = -(-n // (per + 1)) if cut and size - per * length >= cut and n >= per else n // per
            full = min(full, n // per)
            put(full, ((length, length),) * per, size - per * length)
            n -= full * per
            if n and not (cut and full and size - per * length >= cut):
                put(1, ((length, length),) * n, size - n * length)
                n = 0
    return [p for packs in reversed(room) for p in packs]


@dataclass
class Plan:
    """Where ranks of a length go. Entry columns by rising (length, first rank): see ``place``."""

    lengths: np.ndarray
    firsts: np.ndarray
    fields: dict[str, np.ndarray]
    padding: float


def plan(histogram: dict[int, int], size: int, slack: float = SLACK, cut: int = CUT) -> Plan:
    """Packs for a histogram of lengths, as ranges of ranks: with cuts only where packs without them are too loose."""
    packs = shortest_first(histogram, size, None)

    def padding(found: list[Pack]) -> float:
        gaps = [(p.count, sum(t for _, t in p.parts)) for p in found]
        gap = sum(c * (size - n) for c, n in gaps if n & (n - 1))
        return gap / max(1, sum(c * n for c, n in gaps) + gap)

    if padding(packs) > slack:
        cutting = shortest_first(histogram, size, cut)
        packs = min(packs, cutting, key=padding)
    uses: dict[int, list[tuple[int, ...]]] = defaultdict(list)  # length: (packs, copies in each, ids taken, sequence, offset)
    sequence = 0
    for p in packs:
        offset = 0
        for part in dict.fromkeys(p.parts):
            copies = p.parts.count(part)
            uses[part[0]].append((p.count, copies, part[1], sequence, offset))
            offset += copies * part[1]
        sequence += p.count
    rows, came = [], dict(histogram)  # rests of cut pieces rank after the pieces that have their length anyway
    for length in sorted(uses, reverse=True):
        first = 0
        for count, copies, take, seq, offset in uses[length]:
            rest = came.get(length - take, 0)
            rows.append((length, first, copies, take, seq, offset, rest))
            if take < length:
                came[length - take] = rest + count * copies
            first += count * copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 7).T
    return Plan(cols[0], cols[1], dict(zip(("copies", "take", "sequence", "offset", "rest"), cols[2:])), padding(packs))


def place(batches: Iterator[pa.RecordBatch], plan_) -> Iterator[pa.RecordBatch]:
    """Pieces with their rank among those of their length to ``sequence_id, offset``; a cut piece becomes several."""
    p: Plan = plan_.value
    entry = p.lengths << 44 | p.firsts
    for b in batches:
        at = np.arange(b.num_rows)
        start, length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("start", "length", "rank"))
        while len(at):
            e = np.searchsorted(entry, length << 44 | rank, side="right") - 1
            f = {k: v[e] for k, v in p.fields.items()}
            turn, copy = np.divmod(rank - p.firsts[e], f["copies"])
            some = b.take(pa.array(at)).select(["row", "doc_id", "ids_crc32", "doc_tokens"])
            cols = {"piece": start, "start": start, "length": f["take"], "sequence_id": f["sequence"] + turn, "offset": f["offset"] + copy * f["take"],
                    "cut": (f["take"] < length) | (start != b.column(b.schema.get_field_index("start")).to_numpy()[at])}
            cols["piece"] = b.column(b.schema.get_field_index("start")).to_numpy()[at]
            yield pa.RecordBatch.from_arrays([*some.columns, *map(pa.array, cols.values())], [*some.schema.names, *cols])
            more = f["take"] < length
            at, start, length, rank = at[more], (start + f["take"])[more], (length - f["take"])[more], (f["rest"] + rank - p.firsts[e])[more]


def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a cut piece, from those of the whole one."""
    for b in batches:
        t = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names) if c in ("ids", "piece", "start", "length")}
        ids = [x[s - p:s - p + n] for x, p, s, n in zip(t["ids"], t["piece"], t["start"], t["length"])]
        cols = {c: b.column(i) for i, c in enumerate(b.schema.names)} | {
            "ids": pa.array(ids, pa.list_(pa.int32())), "ids_crc32": pa.array([crc(np.array(x, np.int64)) for x in ids], pa.int64())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


@dataclass
class Packed:
    """``pieces``: one row per piece, ``row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; ``tokens``: the ids of
    pieces before any further cut; ``plan``: the packs."""

    pieces: DataFrame
    tokens: DataFrame
    plan: Plan


COLUMNS = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_KINDS = {"sequence_id": "long", "offset": "long", "piece": "long", "cut": "boolean"}


def pack(docs: DataFrame, vocabulary: str, scratch: Scratch, size: int = SIZE, end: int = END, id_col: str = "doc_id",
         text_col: str = "text", slack: float = SLACK) -> Packed:
    """Pack all documents into sequences of at most ``size`` ids.

    A document is its ids and ``end``; one longer than ``size`` is cut at multiples of it. The histogram of piece lengths, at
    most ``size`` rows, is packed shortest pack first on the driver; each class of alike packs becomes a range of sequences,
    and a piece finds its place by its rank among the pieces of its length. A length may be that of a third of all pieces, so ranks are
    counted within parts of about ``RANKED`` pieces. If the packs would be padded by more than ``slack``, pieces are cut to fill them.

    A null text counts as empty and has the id ``end`` alone. Repeated rows and null ids are rows like others; an empty table
    gives no rows; other columns are not read. The vocabulary is read by the driver and broadcast: its size is fixed.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec = spark.sparkContext.broadcast(text)
    kind = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = kind.mapInArrow(partial(tokenized, spec=spec, name=f"{vocabulary} {zlib.crc32(text.encode())}", size=size, end=end),
                           "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")
    tokens = scratch.keep(made)
    pieces = tokens.drop("ids")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = plan(histogram, size, slack)
    parts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, parts int")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("row")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("own") + F.col("base")).cast("long").alias("rank"))
    kinds = dict(pieces.dtypes) | _KINDS
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("row", "doc_id", "ids_crc32", "doc_tokens", "piece", "start", "length", "sequence_id", "offset", "cut"))
    placed = ranked.mapInArrow(partial(place, plan_=spark.sparkContext.broadcast(planned)), schema)
    if (planned.fields["take"] < planned.lengths).any():
        placed = scratch.keep(placed)
        cut = placed.where("cut").join(tokens.select("row", "ids"), "row")
        again = cut.mapInArrow(recut, cut.schema)
        placed = placed.where("not cut").select(*COLUMNS).union(again.select(*COLUMNS))
    return Packed(placed.select(*COLUMNS), tokens, planned)


def sequences(packed: Packed, size: int = SIZE, pad: int = 0) -> DataFrame:
    """The training sequences: ``sequence_id, ids, doc_ids, starts``, padded to ``size`` unless their length is a power of two."""
    whole = packed.tokens.select("row", F.col("start").alias("piece"), "ids")
    joined = packed.pieces.join(whole, "row")
    ids = F.slice("ids", (F.col("start") - F.col("piece") + 1).cast("int"), F.col("length").cast("int"))
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", ids.alias("ids")))).alias("p"))
    flat = F.flatten(F.col("p.ids"))
    n = F.size("ids")
    parts = parts.select("sequence_id", flat.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))
    padded = F.concat("ids", F.array_repeat(F.lit(pad), F.lit(size) - n))
    return parts.withColumn("ids", F.when(F.bit_count(n.cast("long")) == 1, F.col("ids")).otherwise(padded))
