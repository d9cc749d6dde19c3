"""Byte-level BPE by backtracking over longest matches."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker remembers: units of text, pieces, and adjacent tokens with their verdict. Full memories start anew.
UNITS, PIECES, PAIRS = 800_000, 200_000, 1_000_000
#: In patterns of this family a single space between other characters begins a match, and a run of letters with the space before
#: it is one match; so texts may be cut at such spaces.
UNIT = re.compile(r" (?<=\S )(?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Exact BPE of a rank table, in time linear in the text.

    Bytes are mapped to Latin-1, and one Aho-Corasick pass finds the tokens that start at each byte. The longest is tried
    first and shortened while it does not fit the token before it; a position from which nothing fits is closed
    and left backwards. Verdicts on adjacent tokens, and the ids of words, are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes, self.cut = ranks, {i: b for b, i in ranks.items()}, regex.compile(pattern)
        self.size = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes, default=-1) + 1)]
        self.shorter = [next((ranks[self.bytes[i][:k]] for k in range(n - 1, 0, -1) if self.bytes[i][:k] in ranks), -1) for i, n in enumerate(self.size)]
        self.find = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.find.add_word(b.decode("latin-1"), i)
        self.find.make_automaton()
        self.fit: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joined; None for a single byte, (-1, -1) if merges never make it."""
        if token not in self.made:
            data = self.bytes[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.made[token] = None if len(data) == 1 else tuple(self.ranks[p] for p in parts) if len(parts) == 2 else (-1, -1)
        return self.made[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a`` (-1: nothing). It may not if merges never make ``b``, or if a merge across
        the border would have come before the merges that made the two: these are undone from the latest on."""
        if len(self.fit) >= PAIRS:
            self.fit.clear()
        left, right, before = a, b, 1 << 60
        known = self.halves(b) != (-1, -1)
        while known and a >= 0:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < before:
                known = False
                break
            x, y = self.halves(left), self.halves(right)
            if x is None and y is None:
                break
            if y is None or (x is not None and left > right):
                before, left = left, x[1]
            else:  # of equal merges the left one comes first
                before, right = right + 1, y[0]
        self.fit[a << 32 | b] = known
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(data), self.size, self.shorter, self.fit.get
        longest = [-1] * n
        for end, token in self.find.iter(data.decode("latin-1")):
            longest[end - size[token] + 1] = token
        closed: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                if at + size[token] not in closed:
                    ok = known(last << 32 | token)
                    if ok or (ok is None and self.fits(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last, token = token, longest[at] if at < n else -1
            elif out:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                last, token = out[-1] if out else -1, shorter[token]
            else:
                raise ValueError("the rank table lacks single bytes")
        return out

    def encode_piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", self.encode_bytes(piece.encode())).tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode_unit(self, word: str) -> bytes:
        """Ids of a space and a word as little-endian 32-bit integers."""
        if word.isalpha():
            ids = array("I", self.encode_bytes((" " + word).encode())).tobytes()
        else:
            ids = b"".join(map(self.encode_piece, self.cut.findall(" " + word)))
        if len(word) <= 64:
            if len(self.units) >= UNITS:
                self.units.clear()
            self.units[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *rest = UNIT.split(text)
        known, new = self.units.get, self.encode_unit
        return b"".join([*map(self.encode_piece, self.cut.findall(first)), *[known(w) or new(w) for w in rest]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoded(batches: Iterator[pa.RecordBatch], ranks, name: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` to the digest columns; the encoder of a worker process lives as long as the process."""
    enc = _ENCODERS.get(name)
    if enc is None:
        enc = _ENCODERS[name] = Encoder(ranks.value, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            some = b.slice(at, 1000)
            n, sha, back = [], [], []
            for t in some.column(1):
                ids = enc.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null text counts as empty and has no tokens. Repeated rows and null ids are rows like others; an empty table gives no
    rows; other columns are not read. The rank file is read once by the driver and broadcast: its size is fixed.
    """
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(encoded, ranks=ranks, name=f"{vocabulary} {pattern}", pattern=pattern),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(texts, ranks: dict[bytes, int], pattern: str) -> list[list[int]]:
    """Token ids of texts, for use inside tasks and in tests; null counts as empty."""
    enc = Encoder(ranks, pattern)
    return [np.frombuffer(enc.encode(t or ""), "<u4").tolist() for t in texts]
