"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled character map while the
source byte of every normalised byte is recorded.  The pieces tile the normalised text, so each
piece projects to a span of original bytes.  Ids come from the sentencepiece library.

The library works text by text in tasks; the model is a bounded file that travels with the task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

META = "▁"
#: Texts of one output batch.
BATCH = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer message."""
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
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double-array trie over bytes, then its strings."""

    def __init__(self, compiled: bytes):
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.strings = compiled[4 + size :]
        else:
            self.units, self.strings = [], b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``at``, and what replaces it."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node, found = step(self.units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units) or (self.units[node] & 0x800000FF) != data[k]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normaliser:
    """Normalisation as a model states it: character map, space handling and the space in front."""

    def __init__(self, spec: dict[int, int | bytes], suffix: bool = False):
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.suffix = suffix

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for their end the original byte it comes from."""
        raw, meta = text.encode(), META.encode()
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        if not (self.map.units or self.squeeze or self.suffix) and self.escape:
            widths = (np.frombuffer(raw, np.uint8) == 32) * np.int8(2) + np.int8(1)  # a space becomes three bytes
            align = np.repeat(np.arange(len(raw), dtype=np.int32), widths)
            head = self.dummy_prefix * len(meta)
            out = np.full(head + len(align) + 1, len(raw), dtype=np.int32)
            out[:head] = 0
            out[head:-1] = align
            return meta * self.dummy_prefix + raw.replace(b" ", meta), out
        space = meta if self.escape else b" "
        out, align, at, last_space = bytearray(), [], 0, self.squeeze
        pending: list[tuple[bytes, int]] = []
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                size, made = hit
            else:
                size = next(k for k in range(1, 5) if at + k >= len(raw) or raw[at + k] & 0xC0 != 0x80)
                made = raw[at : at + size]
            for byte in made:
                pending.append((space if byte == 32 else bytes([byte]), at))
            at += size
        if self.squeeze:
            while pending and pending[-1][0] == space:
                at = pending.pop()[1]
        if pending and self.dummy_prefix and not self.suffix:
            first = next((where for made, where in pending if not (self.squeeze and made == space)), 0)
            out += space
            align += [first] * len(space)
            last_space = self.squeeze
        for made, where in pending:
            if made == space and last_space and self.squeeze:
                continue
            last_space = made == space
            out += made
            align += [where] * len(made)
        if pending and self.dummy_prefix and self.suffix:
            out += space
            align += [at] * len(space)
        return bytes(out), np.array([*align, at], dtype=np.int64)

class Codec:
    """A model and its normaliser."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = {number: dict(_fields(value)) for number, value in _fields(model) if number in (2, 3)}
        self.normaliser = Normaliser(parts.get(3, {}), bool(parts.get(2, {}).get(24, 0)))
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.widths = np.array([1 if self.processor.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], dtype=np.int64)
        self.decimal = [str(i) for i in range(len(pieces))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and their decimal form joined by commas."""
        name = self.decimal.__getitem__
        return [(ids, ",".join(map(name, ids))) for ids in self.processor.encode(texts, num_threads=1)]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte in the original text of every piece."""
        normal, align = self.normaliser.normalise(text)
        widths = self.widths[np.fromiter(ids, np.int32, len(ids))]
        if widths.sum() != len(normal):  # unknown pieces stand for texts of any width
            pieces = zip(ids, self.processor.encode(text, out_type=str), strict=True)
            widths = np.array([1 if self.processor.is_byte(i) else len(p.encode()) for i, p in pieces], dtype=np.int64)
        ends = np.cumsum(widths)
        return align[ends - widths], align[ends]


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _texts(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            yield batch, [t or "" for t in batch.column(field).to_pylist()]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` with ``n_tokens``, ``ids``, ``begins``, ``ends`` (arrays; original bytes, end exclusive) and ``decoded``.

    A null text counts as the empty text, which has no ids.  Each repeated row is encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch, texts in _texts(batches, "text"):
            coded = made.encode(texts)
            spans = [made.spans(t, ids) for t, (ids, _) in zip(texts, coded, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([ids for ids, _ in coded], pa.list_(pa.int32())),
                    pa.array([b for b, _ in spans], pa.list_(pa.int32())),
                    pa.array([e for _, e in spans], pa.list_(pa.int32())),
                    pa.array([made.processor.decode(ids) for ids, _ in coded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """The contract's columns, made where the ids are; ``tiled`` says that the spans cover the text without gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch, texts in _texts(batches, "text"):
            coded = made.encode(texts)
            tiled = []
            for text, (ids, _) in zip(texts, coded, strict=True):
                begins, ends = made.spans(text, ids)
                size = len(text) if text.isascii() else len(text.encode())
                tiled.append(bool(not size or (begins[0] == 0 and ends[-1] == size and (begins[1:] == ends[:-1]).all())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([sha(joined) for _, joined in coded], pa.string()),
                    pa.array([sha(made.processor.decode(ids)) for ids, _ in coded], pa.string()),
                    pa.array(tiled, pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "tiled"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, tiled boolean")
