"""Sequence packing along a space-filling curve over projected document vectors."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.llm.arrays import slices, utf8
from gridloom.session import stored

BUCKETS, DIMS, BITS = 512, 3, 16
CACHED_WORDS = 250_000  # of two generations, per worker: about 100 MB
# The settings under which words of Latin letters fall into letter runs, single
# digits and runs of signs, and the characters for which that holds.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LETTERS = [chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]  # beyond a-z, lower case
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch  # no apostrophe
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: Random axes; a document's coordinate on each is that of its unit vector of hashed word counts.
_AXES = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def project(documents: list[np.ndarray]) -> np.ndarray:
    """Coordinates in [-1, 1] of token id arrays: square-rooted hashed counts, unit length, on random axes."""
    n = len(documents)
    ids = np.concatenate([*documents, np.zeros(0, np.uint16)]).astype(np.uint32)
    hashed = (ids * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    cells = np.repeat(np.arange(n) * BUCKETS, [len(d) for d in documents]) + hashed
    counts = np.sqrt(np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS), dtype=np.float32)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.tanh((counts / np.maximum(length, 1e-9)) @ _AXES)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point of [-1, 1]^d on the Hilbert curve with ``bits`` bits an axis.

    Works from the highest bit down: each axis in turn either inverts the first axis' lower
    bits or swaps them with its own; the Gray code of the result is the key.
    """
    top = (1 << bits) - 1
    x = np.clip(((points + 1) / 2 * top).round(), 0, top).astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for axis in range(len(x)):
            high = (x[axis] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        high = (x[-1] >> np.uint64(level)) & one == one
        turn ^= np.where(high, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Memo(dict):
    """Makes what it does not hold; of two generations of ``limit`` entries the older one goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Token ids of texts, word by word; frequent words are looked up instead of encoded.

    For tokenizers that drop white space no token crosses it, so a text's ids are its words'
    ids in order.  An unknown word of Latin letters, digits and signs falls into the pieces
    that the tokenizer's own pattern makes, after lower-casing; pieces are looked up or go
    straight to its merges.  Any other word takes the whole tokenizer.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_pieces = settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER
        self.merge = self.tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): as_bytes(c)[0][0] for c in _LETTERS}
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.words = Memo(self._word, cached_words)
        self.pieces = Memo(self._piece, max(1, cached_words * 2 // 5))

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self.spelled)
        return array(self.code, [t.id for t in self.merge(piece)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.by_pieces:
            if word.isalpha():  # ASCII letters only
                return self.pieces[word.lower().decode()]
            text = word.decode("utf-8", "replace")
            if _PLAIN(text) and "<|" not in text:
                return b"".join(map(self.pieces.__getitem__, _PIECES(text.lower())))
        found = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
        return array(self.code, found.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, in the smallest of 16 and 32 bits that holds the vocabulary."""
        ids = self.words.__getitem__
        return [np.frombuffer(b"".join(map(ids, t.split())), self.kind) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    return WordEncoder(path, cached_words)


def cut_into_sequences(documents, length: int, first_id: int):
    """Fill sequences of ``length`` ids in order; yields (document, start, ids, sequence, offset).

    ``documents`` gives (document, ids array).  The last, short sequence is dealt into
    sequences of a power of two each, so nothing is padded.
    """
    sequence, open_pieces, filled = first_id, [], 0
    for document, ids in documents:
        start = 0
        while start < len(ids):
            stop = min(len(ids), start + length - filled)
            open_pieces.append((document, start, ids[start:stop], filled))
            filled += stop - start
            start = stop
            if filled == length:
                yield from ((d, s, part, sequence, at) for d, s, part, at in open_pieces)
                sequence, open_pieces, filled = sequence + 1, [], 0
    sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
    room, offset = (sizes.pop(0) if sizes else 0), 0
    for document, start, part, _ in open_pieces:
        while len(part):
            taken = part[:room]
            yield document, start, taken, sequence, offset
            start, part, room, offset = start + len(taken), part[len(taken):], room - len(taken), offset + len(taken)
            if not room and sizes:
                sequence, room, offset = sequence + 1, sizes.pop(0), 0


def pack_along_curve(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: id, ``start``, ``length``, ``token_ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``, ``curve_key``.

    A document's vector is its hashed token counts, projected to three dimensions; documents
    are range-partitioned and sorted by their Hilbert key (ties by id and a hash of the ids,
    so copies spread over partitions), and each partition fills sequences in that order.
    Token ids and keys are made once and stored.  Sequence ids are unique, not gapless.  A
    null or empty text is the end id alone.  The tokenizer file must be readable on every
    executor and drop white space.  ``cached_words`` trades memory of the Python workers, which
    they keep after the job, for time; results do not depend on it.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def tokenize(batches):
        encode = encoder(tokenizer_path, cached_words).encode
        for batch in slices(batches, "text"):
            gc.disable()  # nothing in here makes cycles, and the word tables are costly to walk
            ids = encode(utf8(batch.column("text")))
            gc.enable()
            keys = hilbert_keys(project(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(keys)],
                names=["id", "tokens", "key"],
            )

    def pack(batches):
        wide, end = encoder(tokenizer_path, cached_words).kind, np.array([end_id], "<u4")
        base = TaskContext.get().partitionId() << 40
        columns = [[] for _ in out]

        def documents():
            for batch in batches:
                for doc, part, key in zip(*(batch.column(c).to_pylist() for c in ("id", "tokens", "key"))):
                    tokens = np.concatenate([np.frombuffer(part, wide), end], dtype="<u4")
                    yield (doc, key, len(tokens)), tokens

        def flush():
            made = [pa.array(c, f.type) for c, f in zip(columns, out)]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(made, schema=out)

        for (doc, key, n), start, ids, sequence, offset in cut_into_sequences(documents(), length, base):
            for c, v in zip(columns, (doc, start, len(ids), ids.tobytes(), n, sequence, offset, key)):
                c.append(v)
            if len(columns[0]) >= 2000:
                yield flush()
        if columns[0]:
            yield flush()

    schema = StructType.fromDDL(
        f"id {kind}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, key long"
    )
    out = to_arrow_schema(schema)
    tokens = stored(picked.mapInArrow(tokenize, f"id {kind}, tokens binary, key long"), "tokens")
    order = ["key", "id", F.xxhash64("tokens")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, schema)
    return pieces.withColumnsRenamed({"id": id_col, "key": "curve_key"})
