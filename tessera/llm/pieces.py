"""Operator 1: SentencePiece encoding and decoding, by Unigram Viterbi.

The pieces of a model stand in a double-array trie over their UTF-8 bytes. For a text the
best segmentation maximises the sum of the pieces' log scores; a character that no
piece covers costs a penalty and falls back to byte pieces. White space is written as a
marker (U+2581), one is put before the text, and decoding turns markers back.

No piece of a model trained with white space splitting holds a marker after another
character, so the best path passes every place where a marker follows a character, and
the stretches between are solved on their own and remembered (within a bound). For a
model with other pieces a text is solved in one stretch.

A model of BPE type stores merge ranks instead of log scores. Its pieces get the log
score of Zipf's law for their rank, -ln(rank + ZIPF); a Unigram model keeps its own.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, ship, text_of, without

MARK = "▁"
#: Cost of a character without a piece, below the lowest score.
UNKNOWN_PENALTY = 10.0
ZIPF = 2.7
#: Stretches that a worker remembers.
MOST_KNOWN = 400_000

#: Characters of an entry of a character map at most; published maps stay below ten.
LONGEST = 64

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = data[at : at + n]
            at += n
        yield key >> 3, kind, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool
    squeeze: bool
    char_map: bytes = b""


def read_model(data: bytes) -> Model:
    """The parts of a model file that coding needs."""
    pieces, scores, kinds, char_map = [], [], [], b""
    model_type, dummy, squeeze = UNIGRAM, True, True
    for number, _, value in _fields(data):
        if number == 1:
            f = {n: v for n, _, v in _fields(value)}
            pieces.append(f.get(1, b"").decode("utf-8"))
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            model_type = {n: v for n, _, v in _fields(value)}.get(3, UNIGRAM)
        elif number == 3:
            f = {n: v for n, _, v in _fields(value)}
            char_map = f.get(2) or b""
            dummy, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
    if model_type != UNIGRAM:
        scores = [-math.log(ZIPF - s) if k == NORMAL else s for s, k in zip(scores, kinds, strict=True)]
    return Model(pieces, scores, kinds, dummy, squeeze, char_map)


class CharMap:
    """A normalizer's map: a compiled double array over the bytes of what is replaced, and the
    texts that replace it, each ended by a zero. At each place the longest entry counts; what
    no entry fits stays.

    A unit of the array holds, from its lowest bit: the label's 8, one that says whether an
    entry ends here, one that shifts the offset by 8, and the offset's 22.
    """

    def __init__(self, data: bytes):
        (size,) = struct.unpack_from("<I", data)
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist()
        self.texts = data[4 + size :]
        #: Characters that no longer entry starts with, and what they become.
        self.alone: dict[str, str] = {}
        self.starts: set[str] = set()  # and those that longer entries start with

    def _below(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int:
        """The node that a byte leads to from a node's base, or -1."""
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def _text(self, node: int) -> str:
        start = self.units[self._below(node)] & 0x7FFFFFFF
        return self.texts[start : self.texts.index(b"\0", start)].decode("utf-8")

    def longest(self, data: bytes) -> tuple[int, str | None]:
        """(bytes, replacement) of the longest entry that data starts with; 0, None if there is none."""
        base, end, found = self._below(0), 0, -1
        for i, byte in enumerate(data):
            node = self._step(base, byte)
            if node < 0:
                break
            base = self._below(node)
            if self.units[node] >> 8 & 1:
                end, found = i + 1, node
        return end, self._text(found) if end else None

    def _goes_on(self, char: bytes) -> bool:
        """Does an entry start with a character and more?"""
        base = self._below(0)
        for byte in char:
            node = self._step(base, byte)
            if node < 0:
                return False
            base = self._below(node)
        return any(self._step(base, byte) >= 0 for byte in range(1, 256))

    def apply(self, text: str) -> str:
        out: list[str] = []
        i = 0
        while i < len(text):
            c = text[i]
            known = self.alone.get(c)
            if known is None and c not in self.starts:
                own = c.encode("utf-8", "surrogatepass")
                if self._goes_on(own):
                    self.starts.add(c)
                else:
                    n, new = self.longest(own)
                    self.alone[c] = known = new if n else c
            if known is not None:
                out.append(known)
                i += 1
                continue
            data = text[i : i + LONGEST].encode("utf-8", "surrogatepass")
            n, new = self.longest(data)
            out.append(new if n else c)
            i += len(data[:n].decode("utf-8", "surrogatepass")) if n else 1
        return "".join(out)




class DoubleArray:
    """Trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if
    check[t] == s. value[t] is the id of the key that ends at t, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        self.base, self.check, self.value = [0], [-1], [-1]
        self._grow(1 << 16)
        free_from = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                self.value[node] = keys[lo][1]
                lo += 1
            groups: list[tuple[int, int, int]] = []
            while lo < hi:
                c, start = keys[lo][0][depth], lo
                while lo < hi and keys[lo][0][depth] == c:
                    lo += 1
                groups.append((c, start, lo))
            if not groups:
                continue
            # First fit from the first free slot; a stretch that is nearly full is left behind.
            first, taken, at = groups[0][0], 0, free_from
            while True:
                self._grow(at + 600)
                if self.check[at] != -1:
                    taken += 1
                elif at > first and all(self.check[at - first + c] == -1 for c, _, _ in groups):
                    break
                at += 1
            if taken >= 0.9 * (at - free_from + 1):
                free_from = at
            base = at - first - 1
            self.base[node] = base
            for c, start, end in groups:
                t = base + c + 1
                self.check[t] = node
                todo.append((t, start, end, depth + 1))

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size - len(self.base), len(self.base) // 2)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more

    def prefixes(self, data: bytes, at: int = 0) -> list[tuple[int, int]]:
        """(end, id) of the keys that start at a place of data."""
        node, out = 0, []
        for i in range(at, len(data)):
            t = self.base[node] + data[i] + 1
            if self.check[t] != node:
                break
            node = t
            if self.value[t] >= 0:
                out.append((i + 1, self.value[t]))
        return out


class Coder:
    def __init__(self, model: Model):
        self.model = model
        m = model
        normal = [s for s, k in zip(m.scores, m.kinds, strict=True) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = low - UNKNOWN_PENALTY
        self.scores = [len(p) * high - 0.1 if k == USER else s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True)]
        keys = [(p.encode("utf-8"), i) for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (NORMAL, USER)]
        self.trie = DoubleArray(keys)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        own = [m.pieces[i] for _, i in keys]
        if any(MARK in p.lstrip(MARK) for p in own):
            self.stretch = re.compile(r"(?s).+")
        elif any("\n" in p for p in own):
            self.stretch = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:  # no piece holds a line end, so it is a stretch of its own
            self.stretch = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.known: dict[str, tuple[int, ...]] = {}
        self.char_map = CharMap(m.char_map) if m.char_map else None
        users = sorted((p for p, k in zip(m.pieces, m.kinds, strict=True) if k == USER and p), key=len, reverse=True)
        self.users = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users and m.char_map else None
        #: What an id stands for on its own; None for bytes that are part of a character.
        self.surface: list[str | None] = [
            (chr(self.bytes_of[i]) if self.bytes_of[i] < 0x80 else None) if k == BYTE else {UNKNOWN: " ⁇ ", CONTROL: ""}.get(k, p.replace(MARK, " "))
            for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True))
        ]

    def normalize(self, text: str) -> str:
        if self.char_map:  # pieces that a user defined are never replaced
            parts = self.users.split(text) if self.users else [text]
            text = "".join(p if i % 2 else self.char_map.apply(p) for i, p in enumerate(parts))
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def solve(self, stretch: str) -> tuple[int, ...]:
        """Viterbi. Of equal scores the path with the earlier last start stays."""
        data = stretch.encode("utf-8", "surrogatepass")
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best = [-math.inf] * (n + 1)
        start = [-1] * (n + 1)
        ids = [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            so_far, node, i, single = best[at], 0, at, False
            while i < n:
                t = base[node] + data[i] + 1
                if check[t] != node:
                    break
                node = t
                i += 1
                v = value[t]
                if v >= 0:
                    s = so_far + scores[v]
                    if start[i] < 0 or s > best[i]:
                        best[i], start[i], ids[i] = s, at, v
                    if i - at == width:
                        single = True
            if not single:
                i = at + width
                s = so_far + self.unknown
                if start[i] < 0 or s > best[i]:
                    best[i], start[i], ids[i] = s, at, -1
            at += width
        out: list[int] = []
        at = n
        while at > 0:
            if ids[at] >= 0:
                out.append(ids[at])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(data[start[at] : at]))
            else:
                out.append(self.unk)
            at = start[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for s in self.stretch.findall(self.normalize(text)):
            ids = known.get(s)
            if ids is None:
                ids = self.solve(s)
                if len(s) <= 64:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[s] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        try:
            text = "".join([surface[i] for i in ids])
        except TypeError:  # some bytes make characters together
            text = self._decode_bytes(ids)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _decode_bytes(self, ids: list[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            if (s := self.surface[i]) is None:
                held.append(self.bytes_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(s)
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)


_coders: dict[int, Coder] = {}


def coder(data: bytes) -> Coder:
    """The coder of a model, compiled once in a worker."""
    key = hash(data)
    if key not in _coders:
        _coders[key] = Coder(read_model(data))
    return _coders[key]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs plus piece_ids (array<int>), n_pieces, n_byte_pieces, decoded and round_trip.

    model: path of a .model file on the driver; its content is sent to the workers.
    decoded is what the ids give back; round_trip tells whether that is the text. It is
    for any text without U+2581, which decodes as a space. A null text counts as empty;
    an empty text has no ids. Repeated rows stay; an empty table gives an empty result;
    columns of docs named like the results give way to them.
    """
    with open(model, "rb") as f:
        data = f.read()
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(data)
    docs = without(docs, ["piece_ids", "n_pieces", "n_byte_pieces", "decoded", "round_trip"])
    docs = docs.withColumn("__pieces_text", text_of(text))
    kept = [f for f in docs.schema.fields if f.name != "__pieces_text"]
    added = "piece_ids array<int>, n_pieces long, n_byte_pieces long, decoded string, round_trip boolean"
    schema = T.StructType(kept + T.StructType.fromDDL(added).fields)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(sent.value)
        low, high = (min(c.bytes_of), max(c.bytes_of)) if c.bytes_of else (0, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # ids and texts of a slice at a time
                part = batch.slice(at, 500)
                texts = part.column("__pieces_text").to_pylist()
                ids = [c.encode(t) for t in texts]
                back = [c.decode(i) for i in ids]
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                at_ = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(at_[-1]))
                bytes_before = np.concatenate([[0], np.cumsum((flat >= low) & (flat <= high))])
                columns = [part.column(f.name) for f in kept] + [
                    pa.ListArray.from_arrays(pa.array(at_), pa.array(flat)), pa.array(sizes), pa.array(bytes_before[at_[1:]] - bytes_before[at_[:-1]]),
                    pa.array(back, pa.string()), pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(coded, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "piece_ids", "n_pieces", "n_byte_pieces", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
