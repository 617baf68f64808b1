"""SentencePiece pair-merge encoding and decoding, token by token from a prefix table.

Merging pairs by score gives every prefix of a text one last token. A piece that ends
there is that token exactly if it can follow the last token of the prefix in front of it,
that is, if merging the two pieces' joint text gives back these two. So one pass of an
automaton over the text fills a table of last tokens, and the ids are read off it from
the end. Nothing is merged but the joint text of two pieces, once per pair of pieces.

A text falls into segments, cut in front of every run of spaces, as no piece goes on from
another character to a space, and around characters that no longer piece has; equal
segments have equal ids.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the model format: the mark for a space, what an unknown id decodes to.
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Fixed values of the model format: kinds of pieces, and the merging kind of model.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PAIR_MERGES = 2

MODEL_BYTES = 1 << 26  # of a model file at most: it goes to every executor
SEGMENTS = 1 << 18  # whose ids a worker remembers at most; more are worked out again
PAIRS = 1 << 20  # of pieces whose test a worker remembers at most
LONG_SEGMENT = 64  # characters from which a segment is not remembered
_NEVER = -float("inf")
GROUP = 1 << 20  # characters or ids turned into Python objects at once


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a message in the protocol-buffer wire format."""
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
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """Pieces, scores and kinds by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @classmethod
    def read(cls, path: str) -> Model:
        """The model in a file that the driver can read.

        Refused are models that this method does not cover: other kinds than pair merges,
        character maps, trimmed or unmarked white space, no byte pieces, own symbols.
        """
        with open(path, "rb") as file:
            data = file.read(MODEL_BYTES + 1)
        if len(data) > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # Field numbers and defaults are those of the public format.
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3, 1) != PAIR_MERGES or not trainer.get(35, 0) or trainer.get(24, 0) or not plain:
            raise ValueError(f"{path} is no pair-merge model with byte pieces and plain white space")
        model = cls(
            tuple(p.get(1, b"").decode() for p in pieces),
            tuple(struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces),
            tuple(p.get(3, NORMAL) for p in pieces),
        )
        normal = [p for p, kind in zip(model.pieces, model.kinds, strict=True) if kind == NORMAL]
        known = set(normal)
        if set(model.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or model.kinds.count(BYTE) != 256:
            raise ValueError(f"{path} has symbols of its own or lacks byte pieces")
        if any(c not in known for p in normal for c in p):
            raise ValueError(f"{path} has pieces of characters that are no pieces")
        return model

    @cached_property
    def encoder(self) -> Encoder:
        """Made once in every worker process that has the model."""
        return Encoder(self)

    @cached_property
    def decoder(self) -> Decoder:
        return Decoder(self)


class Encoder:
    """Ids of texts; remembers segments and pairs of pieces within fixed bounds."""

    def __init__(self, model: Model):
        self.pieces = model.pieces
        normal = [(i, p) for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL]
        self.scores = {p: model.scores[i] for i, p in normal}
        self.sizes = [len(p) for p in model.pieces]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.automaton = ahocorasick.Automaton()
        # With each piece go the pieces known to fit or not to fit in front of it (None: nothing).
        self.befores = {i: {} for i, _ in normal}
        self.tested = 0
        for i, p in normal:
            self.automaton.add_word(p, (i, len(p), self.befores[i]))
        self.automaton.make_automaton()
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", p) for _, p in normal)
        joined = "".join(sorted({c for _, p in normal if len(p) > 1 for c in p} - {SPACE}))
        some = f"[{re.escape(joined)}]" if joined else "(?!)"
        cut = ".+" if crossed else f" +{some}*|{some}+|[^ ]"
        self.segments = re.compile(cut, re.DOTALL).findall
        self.histories: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.known = _Remembered(self)

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about: scores of its merges, its first and last part before each.

        The pair of highest score is joined, the first of equals. None if it ends otherwise.
        """
        if piece not in self.histories:
            text = self.pieces[piece]
            parts, scores, firsts, lasts = list(text), [], [], []
            while True:
                firsts.append(parts[0])
                lasts.append(parts[-1])
                joined = [self.scores.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                best = max(joined, default=_NEVER)
                scores.append(best)
                if best == _NEVER:
                    break
                at = joined.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.histories[piece] = (scores, firsts, lasts) if parts == [text] else None
        return self.histories[piece]

    def _fits(self, left: int | None, right: int) -> bool:
        """Whether merging the joint text of two pieces gives back the two.

        Merges of either side take place in their own order, the better next one first,
        until one across the border beats both.
        """
        two = self.history(right)
        if left is None or two is None:
            return two is not None
        one, two_firsts, joint = self.history(left), two[1], self.scores.get
        i = j = 0
        while True:
            a, b = one[0][i], two[0][j]
            across = joint(one[2][i] + two_firsts[j])
            if across is not None and across > a and across >= b:
                return False
            if a == b == _NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def follows(self, left: int | None, right: int) -> bool:
        """Whether one piece may stand behind another, or at the beginning."""
        if self.tested >= PAIRS:
            for known in self.befores.values():
                known.clear()
            self.tested = 0
        self.tested += 1
        fits = self.befores[right][left] = self._fits(left, right)
        return fits

    def segment(self, text: str) -> bytes:
        """Ids of one segment, its spaces still plain, four bytes each."""
        text = text.replace(" ", SPACE)
        # Last token by place; none at a character that no piece has, and in front of all.
        last: list[int | None] = [None] * (len(text) + 1)
        for end, (piece, size, known) in self.automaton.iter(text):
            if last[end] is None:
                left = last[end - size]  # the list's end stands for its beginning
                fits = known.get(left)
                if fits or fits is None and self.follows(left, piece):
                    last[end] = piece
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                ids += [self.bytes[b] for b in reversed(text[at].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                ids.append(piece)
                at -= self.sizes[piece]
        ids.reverse()
        return struct.pack(f"={len(ids)}i", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, which counts as beginning with a space unless it is empty."""
        if not text:
            return np.empty(0, np.int32)
        words = self.segments(" " + text.replace(SPACE, " "))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)


class _Remembered(dict):
    """Ids by segment, within the bound: what one generation has not met, the next forgets."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.encoder.segment(text)
        if len(text) < LONG_SEGMENT:
            if len(self) >= SEGMENTS // 2:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Decoder:
    """Texts of ids: pieces side by side, the first space of a text left out."""

    def __init__(self, model: Model):
        texts = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:
                texts.append(bytes([int(piece[1:-1], 16)]))
            else:
                shown = {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, piece.replace(SPACE, " "))
                texts.append(shown.encode())
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.is_byte = np.array(model.kinds) == BYTE
        self.is_normal = np.array(model.kinds) == NORMAL

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids; bytes that are no UTF-8 become U+FFFD, one for each."""
        shown = ids[self.sizes[ids] > 0]  # control ids show nothing
        data = self._bytes(shown)
        if len(shown) and self.is_normal[shown[0]] and data.startswith(b" "):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _mended(data)


def _mended(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[: error.start].decode() + "�")
            data = data[error.start + 1 :]
    return "".join(out)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``GROUP`` in all, one row at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def encoder(spark: SparkSession, model: Model):
    """A function of a text column: ``array<int>``, its ids (none for null or empty text)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = shared.value.encoder
        for batch in batches:
            sizes = _lengths(batch)
            parts = []
            for a, b in _groups(sizes):
                found = [work.encode(t) for t in batch.slice(a, b - a).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return lambda text: encode(text.cast("string") if isinstance(text, Column) else F.col(text).cast("string"))


def _lengths(batch: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    kind = pc.list_value_length if pa.types.is_list(batch.type) else pc.binary_length
    return pc.fill_null(kind(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def decoder(spark: SparkSession, model: Model):
    """A function of a column of ids: their text (null ids: null). Unknown ids fail."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = shared.value.decoder
        for batch in batches:
            sizes = _lengths(batch)
            parts = []
            for a, b in _groups(sizes):
                part = batch.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes[a:b])
                rows = [work.decode(flat[e - s : e]) for e, s in zip(ends, sizes[a:b], strict=True)]
                parts.append(pa.array(rows, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return lambda ids: decode(ids)


def piece_report(docs, model: Model):
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``docs (doc_id, text)``.

    Null and empty texts have no ids and decode to the empty text. Repeated rows give a
    row each; ids null or repeated are passed on; other columns are left out.
    """
    spark = docs.sparkSession
    encode, decode = encoder(spark, model), decoder(spark, model)
    encoded = docs.select("doc_id", encode(F.col("text")).alias("ids"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
