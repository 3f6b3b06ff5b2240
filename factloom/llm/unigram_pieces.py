"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The model file's pieces and log scores are read from its protocol buffer; models whose normalizer
rewrites characters or drops white space are refused, as their ids would differ. Text is escaped the
SentencePiece way (a marker in front and for every space), and the best-scoring segmentation is
found by Viterbi over the trie. Characters without a piece become their UTF-8 bytes' pieces, or the
unknown piece in models without byte fallback.

No piece has a marker after another character, and none spans a line feed, so the best path of a
text is the best paths of its marker-led units in turn. Workers keep units they have met, at most
``CACHE_UNITS``, then start afresh; the trie is built once on the driver, its size is the
vocabulary's. Models that break the assumption are taken whole, text by text.

Defined cases: a null or empty text has no pieces; a text that holds the marker itself decodes with
a space in its place; repeated rows get repeated results; an empty table gives an empty result; only
the id and the text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import table

MARKER = "▁"
CACHE_UNITS = 400_000
UNKNOWN_PENALTY = 10.0
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """Pieces, scores and types of a model, with a double-array trie over the pieces' bytes."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    add_prefix: bool = True
    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, scores, types, prefix = [], [], [], True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                pieces.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0])
                types.append(piece[3])
            elif number == 3:
                settings = dict(_fields(value))
                if settings.get(2) or settings.get(4, 1) or not settings.get(5, 1):
                    raise ValueError("models that rewrite characters or white space before they segment are not supported")
                prefix = bool(settings.get(3, 1))
        return cls(pieces, scores, types, prefix).build()

    def build(self) -> PieceModel:
        """Lay the trie out in two arrays: child c of state s is base[s] + c, owned if check says s."""
        root: dict = {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types, strict=True)):
            if kind in (NORMAL, USER_DEFINED) and piece:
                node = root
                for b in piece.encode("utf-8"):
                    node = node.setdefault(b + 1, {})
                node[0] = i
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], first, queue = 0, 1, [(0, root)]
        for state, node in queue:
            value[state] = node.get(0, -1)
            codes = sorted(c for c in node if c)
            if not codes:
                continue
            slot, taken = max(first, codes[0]), 0
            while True:
                if slot + 258 > size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                start = slot - codes[0]
                if check[slot] >= 0:
                    taken += 1
                elif start > 0 and all(check[start + c] < 0 for c in codes):
                    break
                slot += 1
            if taken >= 0.9 * (slot - max(first, codes[0]) + 1):
                first = slot  # what lies before is as good as full: don't look there again
            base[state] = start
            for c in codes:
                check[start + c] = state
                queue.append((start + c, node[c]))
        self.base, self.check, self.value = base, check, value
        return self


class PieceCoder:
    """Encodes and decodes with one model; keeps units it has met."""

    def __init__(self, model: PieceModel, cache_units: int = CACHE_UNITS):
        self.model, self.cache_units = model, cache_units
        self.cache: dict[str, bytes] = {}
        usable = [i for i, t in enumerate(model.types) if t in (NORMAL, USER_DEFINED)]
        normal = [model.scores[i] for i in usable if model.types[i] == NORMAL] or [0.0]
        self.low, high = min(normal) - UNKNOWN_PENALTY, max(normal)
        # A piece the user defined must win over its parts.
        self.score = [len(p.encode("utf-8")) * high - 0.1 if t == USER_DEFINED else s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True)]
        by_byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        inner = any(MARKER in p.lstrip(MARKER) for p in (model.pieces[i] for i in usable))
        lines = any("\n" in model.pieces[i] for i in usable)
        self.units = None if inner else re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+" if lines else f"\n|{MARKER}+[^{MARKER}\n]*|[^{MARKER}\n]+")
        surface = [p.replace(MARKER, " ").encode("utf-8") for p in model.pieces]
        for i, t in enumerate(model.types):
            surface[i] = bytes([int(model.pieces[i][3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else surface[i]
        self.surface = surface

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal paths, the one whose last piece starts first."""
        data = text.encode("utf-8")
        n, base, check, value, score = len(data), self.model.base, self.model.check, self.model.value, self.score
        limit = len(check)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, to, alone = best[at], 0, at, False
            while to < n:
                child = base[state] + data[to] + 1
                if child >= limit or check[child] != state:
                    break
                state = child
                to += 1
                piece = value[state]
                if piece >= 0:
                    total = here + score[piece]
                    if best[to] is None or total > best[to]:
                        best[to], back[to] = total, (at, piece)
                    alone = alone or to == at + width
            if not alone:
                to = at + width
                total = here + self.low
                if best[to] is None or total > best[to]:
                    best[to], back[to] = total, (at, -1)
            at += width
        out: list[int] = []
        while n > 0:
            at, piece = back[n]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(data[at:n])]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown)
            n = at
        return out[::-1]

    def escape(self, text: str) -> str:
        return (MARKER if self.model.add_prefix else "") + text.replace(" ", MARKER)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        escaped, known = self.escape(text), self.cache
        if self.units is None or not self.bytes:
            return np.array(self.viterbi(escaped), dtype="<u4").tobytes()
        units = self.units.findall(escaped)
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            new = {u for u in units if u not in known}
        if len(known) + len(new) > self.cache_units:
            known.clear()
            new = set(units)
        for u in new:
            known[u] = np.array(self.viterbi(u), dtype="<u4").tobytes()
        return b"".join([known[u] for u in units])

    def decode(self, ids) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.add_prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model: str | PieceModel, *, text: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, ids_crc32 and round_trip of every row.

    ``round_trip`` says that decoding the ids gives back the whole text (see the module for the
    marker character).
    """
    model = PieceModel.load(model) if isinstance(model, str) else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    kind = dict(docs.dtypes)["doc_id"]
    is_byte = np.array([t == BYTE for t in model.types])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = [coder.encode(t) for t in texts]
                arrays = [np.frombuffer(c, dtype="<u4") for c in coded]
                ends = np.zeros(len(arrays) + 1, dtype=np.int32)
                np.cumsum([len(a) for a in arrays], out=ends[1:])
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([int(is_byte[a].sum()) for a in arrays], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                        pa.array([coder.decode(a.tolist()) == t.replace(MARKER, " ") for a, t in zip(arrays, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"],
                )

    schema = f"doc_id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", text).mapInArrow(work, schema)


def decode_pieces(coded: DataFrame, model: str | PieceModel, *, ids: str = "ids") -> DataFrame:
    """doc_id and text decoded from a column of ids; null ids give an empty text."""
    model = PieceModel.load(model) if isinstance(model, str) else model
    shared = coded.sparkSession.sparkContext.broadcast(model)
    kind = dict(coded.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            texts = [coder.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", ids).mapInArrow(work, f"doc_id {kind}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_unigram_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_model())
