"""Fill-in-the-middle: texts cut at token borders into prefix, middle and suffix, and put together in another order.

Tokens are longest runs of ASCII letters and single other code points.  The UTF-8 bytes of many texts are
viewed as 64-bit words; arithmetic on whole words marks the last byte of every token, ``bitwise_count`` gives
the tokens of each word, and the end of the k-th token is found by a search of the summed counts and a
selection inside one word.  Forms and cuts come from a digest of the document's id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are marked at a time.
PIECE = 1 << 22

HIGH, LOW = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
#: Added to seven bits of each byte, these carry into the high bit from ``a`` on, and beyond ``z``.
FROM_A, BEYOND_Z, LOWER = np.uint64(0x1F1F1F1F1F1F1F1F), np.uint64(0x0505050505050505), np.uint64(0x2020202020202020)
ONE, SEVEN, EIGHT, LAST = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


class Marks:
    """One bit for some bytes of a word array: ranks and selections over it."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, byte: np.ndarray) -> np.ndarray:
        """Marks before each byte."""
        word = byte >> 3
        below = (ONE << (EIGHT * (byte & 7).astype(np.uint64))) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th mark (from 1)."""
        word = np.searchsorted(self.before[1:], k)
        left, bits = k - self.before[word] - 1, self.words[word]
        for _ in range(7):
            bits, left = np.where(left > 0, bits & (bits - ONE), bits), left - 1
        lowest = np.bitwise_count((bits & (~bits + ONE)) - ONE).astype(np.int64)
        return word * 8 + (lowest >> 3) + 1


def marked(data: bytes, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Last bytes of tokens and first bytes of code points in texts that lie behind each other and end before the bytes ``ends``."""
    words = np.zeros(len(data) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(data)] = np.frombuffer(data, np.uint8)
    seven = (words | LOWER) & LOW
    letter = (seven + FROM_A) & ~(seven + BEYOND_Z) & ~words & HIGH
    inner = words & ~(words << ONE) & HIGH  # bytes of a code point after its first
    following = lambda mark: (mark >> EIGHT) | (np.append(mark[1:], np.uint64(0)) << LAST)
    last = (letter & ~following(letter)) | (~letter & ~following(inner) & HIGH)
    single = last.view(np.uint8)
    single[ends[ends > 0] - 1] = 0x80  # a text's last byte ends a token, whatever the next text starts with
    single[len(data) :] = 0
    return Marks(last), Marks(~inner & HIGH)


def _digits(df_id: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the seeded digest of an id, as a number; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum([len(t) for t in batch.column("__text").cast(pa.binary()).to_pylist()], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, base + PIECE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``doc_id`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``.

    ``plain`` keeps the text, ``psm`` puts prefix, suffix, middle behind their marks, ``spm`` suffix, prefix,
    middle.  Texts that hold a mark, empty and null texts (which count as empty) are plain; ``plain_percent``
    of the others are, and ``spm_percent`` of the rest are spm.  Each repeated row is transformed; equal ids are
    cut by the same numbers.  Only ``doc_id`` and ``text`` are read.  A task holds the marks of about ``PIECE``
    bytes, or of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            tokens, points = marked(b"".join(texts), ends)
            before = tokens.rank(starts)
            n = tokens.rank(ends) - before
            one, two = [batch.column(c).to_numpy() % (n + 1) for c in ("__h1", "__h2")]
            cuts = []
            for units in (np.minimum(one, two), np.maximum(one, two)):
                cuts.append(np.where(units > 0, tokens.select(np.maximum(before + units, 1)), starts))
            chars = [points.rank(b) - points.rank(a) for a, b in ((starts, cuts[0]), (cuts[0], cuts[1]))]
            forms, made = batch.column("form").to_pylist(), []
            for text, form, p, m in zip(texts, forms, (cuts[0] - starts).tolist(), (cuts[1] - starts).tolist(), strict=True):
                if form == "psm":
                    made.append(b"".join((b"<P>", text[:p], b"<S>", text[m:], b"<M>", text[p:m])))
                elif form == "spm":
                    made.append(b"".join((b"<S>", text[m:], b"<P>", text[:p], b"<M>", text[p:m])))
                else:
                    made.append(text)
            plain = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), *[pa.array(c, pa.int64(), mask=plain) for c in chars], pa.array(made, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    text, h = F.coalesce("text", F.lit("")), [_digits(F.col("doc_id"), seed, k) for k in (1, 2, 3, 4)]
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", text.alias("__text"), form.alias("form"), h[0].alias("__h1"), h[1].alias("__h2"))
    return asked.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that was cut, from the output and its form alone."""
    body, length = F.substring(output, 4, 2147483647), F.length(output)
    part = lambda start, size: F.substr(body, start, size)
    first = F.instr(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX))
    middle = F.instr(body, MIDDLE)
    one, two, three = part(F.lit(1), first - 1), part(first + 3, middle - first - 3), part(middle + 3, length)
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns: the output and the text rebuilt from it as digests."""
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
