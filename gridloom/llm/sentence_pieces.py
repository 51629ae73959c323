"""SentencePiece encoding of merge type by backtracking over longest matches, and decoding."""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrays import slices, utf8
from gridloom.llm.packing import Memo

SPACE = "▁"  # stands for a space within pieces
CACHED_SEGMENTS = 200_000  # of two generations, per worker
LONG_SEGMENT = 64  # characters; longer ones are encoded each time
# Numbers of the model file's fields and kinds of pieces.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MODEL_TYPE, _BPE, _BYTE_FALLBACK, _SUFFIX = 3, 2, 35, 24
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE = 2, 3, 4, 5

codecs.register_error(
    "gridloom.each_byte", lambda e: ("�" * (e.end - e.start), e.end) if isinstance(e, UnicodeDecodeError) else ("?", e.end)
)


def message_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield field, raw[at : at + size]
            at += size


class PieceModel:
    """A merge-type (BPE) model with byte fallback, its encoder and its decoder.

    ``encode`` gives what repeated merging gives: of all neighbours whose union is a piece the
    pair with the highest score merges first, the leftmost one of equals.  A sequence of pieces
    is that result if and only if each two neighbours, merged anew by themselves, come out as
    they are.  So the encoder walks the text with the longest matching piece that fits the
    piece before it, shorter ones next; a place from which no piece goes on is marked and not
    entered again.  Texts fall apart where no piece holds both neighbouring characters; parts
    are remembered, as are the answers for pairs.
    """

    def __init__(self, path: str, cached: int = CACHED_SEGMENTS):
        with open(path, "rb") as file:
            fields = list(message_fields(file.read()))
        pieces = [dict(message_fields(v)) for f, v in fields if f == _PIECE]
        trainer, normalizer = ({k: v for f, m in fields if f == part for k, v in message_fields(m)} for part in (_TRAINER, _NORMALIZER))
        kinds = [p.get(_KIND, _NORMAL) for p in pieces]
        if (
            trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX) or normalizer.get(_CHARSMAP)
            or normalizer.get(_REMOVE_SPACES, 1) or not normalizer.get(_ESCAPE, 1) or not {*kinds} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        ):
            raise ValueError("only merge-type models with byte fallback, without text rewriting and user-defined pieces")
        self.prefix = SPACE if normalizer.get(_DUMMY_PREFIX, 1) else ""
        self.texts = [p[_TEXT].decode() for p in pieces]
        self.scores = [struct.unpack("<f", p.get(_SCORE, b"\0\0\0\0"))[0] for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == _NORMAL}
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == _BYTE}
        self.surface = [
            bytes([int(t[1:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN
            else t.replace(SPACE, " ").encode()
            for t, k in zip(self.texts, kinds)
        ]
        self.matches = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.matches.add_word(text, i)
        self.matches.make_automaton()
        self.shorter = [-1] * len(pieces)  # the longest piece that begins a piece
        for text, i in self.ids.items():
            self.shorter[i] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
        self.sizes = list(map(len, self.texts))
        self.scored = [k == _NORMAL for k in kinds]
        self.joints = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        first = {a for a, b in self.joints if b == SPACE and a != SPACE}
        breaks = "".join(c for c in "\n\r\t" if not any(c in j for j in self.joints))
        # a segment: spaces with what follows them; whole texts where pieces hold a space after something else
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|[{breaks or SPACE}]" if not first else "(?s).+").findall
        self.fits = Memo(self._fits, cached)
        self.part = Memo(self._part, cached)
        self.segment = Memo(self._segment, cached)

    def merged(self, text: str) -> list[int]:
        """Ids of a text of known characters by merging step by step."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two pieces (or one alone, after -1) come out of merging as they are."""
        left, right = pair
        ids = [right] if left < 0 else [left, right]
        text = "".join(self.texts[i] for i in ids)
        return all(c in self.ids for c in text) and self.merged(text) == ids

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text by longest matches, checks of neighbours and a bit for each failed place."""
        n, sizes, shorter, fits = len(text), self.sizes, self.shorter, self.fits
        longest = [-1] * n
        for end, piece in self.matches.iter(text):
            longest[end - sizes[piece] + 1] = piece  # later matches from one place are longer
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and fits[last, piece]:
                    out.append(piece)
                    at, last = end, piece
                    break
                piece = shorter[piece]
            else:
                if longest[at] < 0:  # no piece: the character's bytes, next to which nothing merges
                    out.extend(self.bytes[b] for b in text[at].encode())
                    at, last = at + 1, -1
                else:  # back to the piece before, of which a shorter one is tried
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= sizes[piece]
                    last = out[-1] if out and self.scored[out[-1]] else -1
                    piece = shorter[piece]
                    continue
            if at == n:
                return out
            piece = longest[at]

    def _part(self, part: str) -> bytes:
        return array("i", self.backtrack(part)).tobytes()

    def _segment(self, segment: str) -> bytes:
        if len(segment) <= LONG_SEGMENT:
            return self._part(segment)
        ends = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.joints]
        parts = [segment[a:b] for a, b in zip([0, *ends], [*ends, len(segment)])]
        return b"".join([self.part[p] if len(p) <= LONG_SEGMENT else self._part(p) for p in parts])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (native 32-bit integers); none for the empty text."""
        if not text:
            return np.zeros(0, np.int32)
        found = self.segments(self.prefix + text.replace(" ", SPACE))
        return np.frombuffer(b"".join([self.segment[s] if len(s) <= LONG_SEGMENT else self._segment(s) for s in found]), np.int32)

    def decode(self, ids) -> str:
        """The text of ids: bytes that are no character give one U+FFFD each; the space in front goes."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "gridloom.each_byte")
        first = next((i for i in ids if self.surface[i]), -1)
        return text[1:] if self.prefix and first >= 0 and self.scored[first] and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x.decode("utf-8", "replace") for x in utf8(batch.column(column))]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``piece_ids`` (array<int>), without begin or end ids.

    The model file must be readable on every executor.  Null and the empty text have no ids;
    bytes that are no UTF-8 count as U+FFFD; repeated rows and null ids stay as they are.  Each
    text is encoded whole; memory of a task follows its longest text.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode = model(model_path).encode
        for batch in slices(batches, "text"):
            ids = [encode(t) for t in _texts(batch, "text")]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], names=["id", "ids"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, ids array<int>").select(
        F.col("id").alias(id_col), F.col("ids").alias("piece_ids")
    )


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids; id and ids stay.  A null list and the empty one give the
    empty text, null entries of a list are passed over; ids beyond the model raise an error."""
    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        decode = model(model_path).decode
        for batch in batches:
            column = batch.column("ids")
            texts = []
            for i in range(batch.num_rows):
                value = column[i]
                ids = [] if not value.is_valid else value.values.drop_null().to_numpy(zero_copy_only=False).tolist()
                if ids and not 0 <= min(ids) <= max(ids) < len(model(model_path).texts):
                    raise ValueError("a piece id beyond the model")
                texts.append(decode(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").select(
        F.col("id").alias(id_col), F.col("ids").alias("piece_ids"), "decoded"
    )
