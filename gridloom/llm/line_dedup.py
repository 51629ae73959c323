"""Near-equal lines by MinHash bands, exact Jaccard checks and distributed union-find."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.arrays import mix64, slices
from gridloom.llm.components import components, forest
from gridloom.session import ROWS_PER_FILE, stored

SHINGLE = 5
MIN_WORDS = 1  # every line but blank ones
SIMILARITY = 0.8
BANDS, BAND_ROWS = 17, 5
CELLS = 1 << 15  # hashes turned at a time
ROWS_PER_TASK = 500_000  # rows of 20 bytes
REMEMBERED = 100_000  # keys of lines that a task has signed lately
MOST_OFF = 18  # bits in which sketches of similar lines differ at most
PAIRED = 8  # lines of a bucket whose pairs are all looked at
MOST_SPLIT = 4_096  # lines of a bucket that is split by sketches
SMALL_BUCKET = 128
FEW_PAIRS = 24  # cells with more near pairs a line are compared by matrix products
MOST_MARKS = 8_192
PIVOT_ROUNDS = 3
MOST_CHARACTERS = 1 << 22  # of a cell whose lines' shingles are all held
COLUMNS = 4_096  # shingles compared at a time
PAGE, MOST_PAGES = 32_768, 4_096  # bits of a page of marks, and pages at most
_BAND = np.dtype([("bucket", "<u4"), ("k1", "<i8"), ("sketch", "<u8")])
_ODD_SPACE = ("  ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_TIMES = np.random.default_rng(4).integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_FIRST = np.ones(1, bool)
_BITS = np.random.default_rng(8).integers(0, 1 << 32, (64, 1), dtype=np.uint32) | np.uint32(1)
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def normal(line: str) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join(line.lower().split())


def _odd_spaces(text: str) -> bool:
    """Whether any line has white space but single spaces."""
    return any(x in text for x in _ODD_SPACE)


def judged_lines(text: str, least_words: int = MIN_WORDS) -> list[tuple[int, str]]:
    """Number and normal form of each line with at least ``least_words`` words, and one at least."""
    text = text.lower()
    if _odd_spaces(text):
        lines = [" ".join(x.split()) for x in text.split("\n")]
    else:
        lines = [x.strip(" ") for x in text.split("\n")]
    if least_words <= 1:
        return [(i, x) for i, x in enumerate(lines) if x]
    return [(i, x) for i, x in enumerate(lines) if x and x.count(" ") >= least_words - 1]


def line_key(line: str) -> bytes:
    """128-bit hash: lines with equal keys count as equal."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _halves(keys: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the runs of five characters of all lines, and where each line's begin and end.

    A line has five characters at least; hashes between an end and the next begin are of no line.
    """
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    out = np.empty(len(codes) - SHINGLE + 1, np.uint32)
    for at in range(0, len(out), CELLS):
        n = min(CELLS, len(out) - at)
        part = codes[at : at + n + SHINGLE - 1].astype(np.uint64)
        grams = part[:n] * _PLACES[0]
        for i in range(1, SHINGLE):
            grams += part[i : i + n] * _PLACES[i]
        out[at : at + n] = mix64(grams) >> np.uint64(32)
    return out, starts, starts + lengths - SHINGLE + 1


def _least(lines: list[str]) -> np.ndarray:
    """The MinHash values of each line (a column).  Shingles are runs of five characters; a line has one at least."""
    hashed, starts, ends = _hashes(lines)
    # what lies between two lines repeats the first one's last hash, so that only begins bound them
    between = ends[:-1, None] + np.arange(SHINGLE)
    hashed[between] = hashed[ends[:-1, None] - 1]
    least = np.empty((BANDS * BAND_ROWS, len(lines)), np.uint32)
    at = 0
    while at < len(lines):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CELLS, "right")))
        held = hashed[starts[at] : ends[stop - 1]]
        bounds = starts[at:stop] - starts[at]
        turned = np.empty_like(held)
        for i, times in enumerate(_TIMES):
            np.multiply(held, times, out=turned)
            np.minimum.reduceat(turned, bounds, out=least[i, at:stop])
        at = stop
    return least


def signatures(lines: list[str]) -> np.ndarray:
    """One 64-bit value per line and band: the hash of the band's five MinHash values."""
    return _bands(_least(lines))


def sketches(lines: list[str]) -> np.ndarray:
    """64 bits a line, one of each of its first 64 MinHash values, see ``_near``."""
    return _sketches(_least(lines))


def _sketches(least: np.ndarray) -> np.ndarray:
    bits = ((least[:64] * _BITS) >> np.uint32(31)).astype(bool)
    return np.packbits(bits, axis=0, bitorder="little").T.copy().view("<u8").reshape(-1)


def _near(a: np.ndarray, b: np.ndarray, most_off: int = MOST_OFF) -> np.ndarray:
    """Whether lines with these sketches may be similar.

    A bit differs with probability (1 - s) / 2 at Jaccard similarity s.  More than 18 of 64
    differ with probability 0.00001 at 0.8, and 0.999 at 0.03.
    """
    return np.bitwise_count(a ^ b) <= most_off


def _bands(least: np.ndarray) -> np.ndarray:
    n = least.shape[1]
    out = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(n, b + 1, np.uint64)
        for row in least[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + row)
        out[:, b] = value
    return out


def prints(lines: list[str]) -> list[bytes]:
    """Per line a bit for each remainder of its shingles' hashes by a power of two, 64 or at least as
    many as it has characters but four.

    Two lines differ in at least as many shingles as their prints differ in bits, see ``far``.
    """
    hashed, starts, ends = _hashes(lines)
    counts = ends - starts
    bits = 1 << np.maximum(6, np.ceil(np.log2(counts)).astype(np.int64))
    base = np.cumsum(bits) - bits
    spot = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    marks = np.zeros(int(bits.sum()), np.uint8)
    marks[np.repeat(base, counts) + (hashed[spot] & np.repeat(bits - 1, counts))] = 1
    packed = np.packbits(marks).tobytes()
    return [packed[a : a + n] for a, n in zip((base >> 3).tolist(), (bits >> 3).tolist())]


def far(n: int, first: bytes, m: int, second: bytes) -> bool:
    """Whether two lines with so many runs and these prints must be less similar than ``SIMILARITY``.

    Of sizes a and b, similar lines differ in (1 - s) / (1 + s) * (a + b) shingles at most.
    """
    a, b = int.from_bytes(first), int.from_bytes(second)
    for _ in range((len(first) // len(second)).bit_length() - 1):
        half = 4 * len(first)
        a, first = (a >> half) | (a & ((1 << half) - 1)), first[: len(first) // 2]
    for _ in range((len(second) // len(first)).bit_length() - 1):
        half = 4 * len(second)
        b, second = (b >> half) | (b & ((1 << half) - 1)), second[: len(second) // 2]
    return (a ^ b).bit_count() > (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + 1e-6


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str], least: float = SIMILARITY) -> bool:
    """Jaccard similarity of at least ``least``, exactly."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def near_pairs(lines: list[str]) -> np.ndarray:
    """Places (two columns) of the pairs of lines that may be similar, by the bits of their hashed shingles as in ``far``."""
    hashed, starts, ends = _hashes(lines)
    counts = ends - starts
    bits = min(MOST_MARKS, 1 << max(6, int(counts.max() - 1).bit_length()))
    spot = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    marks = np.zeros((len(lines), bits), np.float32)
    marks[np.repeat(np.arange(len(lines)), counts), hashed[spot] & np.uint32(bits - 1)] = 1
    held = marks.sum(axis=1)
    differ = held[:, None] + held[None, :] - 2 * (marks @ marks.T)
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * (counts[:, None] + counts[None, :])
    return np.argwhere(np.triu(differ <= most + 1e-3, 1))


def similar_pairs(lines: list[str], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of lines with a Jaccard similarity of at least ``least``, exactly.

    Counts the shingles that two lines share by products of 0-1 matrices, some thousand
    shingles at a time; shingles of one line only are left out of them.  Lines have five characters at least.
    """
    if len(lines) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = _runs(lines)
    sizes = np.array([len(h) for h in held])
    line, number = np.repeat(np.arange(len(lines)), sizes), np.unique(np.concatenate(held), return_inverse=True)[1]
    shared = np.bincount(number)[number] > 1
    line, place = line[shared], np.unique(number[shared], return_inverse=True)[1]
    both = np.zeros((len(lines), len(lines)), np.float32)
    order = np.argsort(place, kind="stable")
    line, place = line[order], place[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, z = np.searchsorted(place, [start, start + COLUMNS])
        ones = np.zeros((len(lines), min(COLUMNS, int(place[-1]) + 1 - start)), np.float32)
        ones[line[a:z], place[a:z] - start] = 1
        both += ones @ ones.T
    whole = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu(both >= least * whole - 1e-4, 1))


def _line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """Of each document (id, text): line number and key (two longs) of its judged lines, and a row
    without ``k1`` that has the number of its lines and, as ``k2``, of its judged ones.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            ids, numbers, keys, breaks, judged = [], [], [], [], []
            docs_of = batch.column("id")
            for doc, text in zip(docs_of.to_pylist(), batch.column("text").to_pylist()):
                breaks.append((text or "").count("\n") + 1)
                judged.append(len(keys))
                for i, line in judged_lines(text or "", least_words):
                    ids.append(doc)
                    numbers.append(i)
                    keys.append(line_key(line))
                judged[-1] = len(keys) - judged[-1]
            none = pa.nulls(len(breaks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [docs_of, pa.array(breaks, pa.int64()), none, pa.array(judged, pa.int64())], names=["id", "line", "k1", "k2"]
            )
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), *_halves(keys)], names=["id", "line", "k1", "k2"]
                )

    return docs.mapInArrow(run, "id long, line long, k1 long, k2 long")


def _band_table(docs: DataFrame, least_words: int, parts: int) -> DataFrame:
    """``part`` and ``rows``: a part's rows (bucket, k1, sketch), packed; one for each band of a line,
    from each task about once.

    Lines shorter than a shingle have no bands: they are similar to equal ones only.
    """

    def packed(bands, keys, drawn):
        values = np.concatenate(bands).reshape(-1)
        part = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        rows = np.empty(len(values), _BAND)
        rows["bucket"] = (values & np.uint64(0xFFFFFFFF))[order]
        line = order // BANDS
        rows["k1"] = np.concatenate(keys)[line]
        rows["sketch"] = np.concatenate(drawn)[line]
        some, starts = np.unique(part[order], return_index=True)
        bounds = np.append(starts, len(rows)).astype(np.int32) * _BAND.itemsize
        sent = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), sent], names=["part", "rows"])

    def run(batches):
        seen: set[bytes] = set()
        bands, keys, drawn, n = [], [], [], 0
        for batch in slices(batches, "text"):
            fresh = {}
            for line in {x for text in batch.column("text").to_pylist() for _, x in judged_lines(text or "", least_words)}:
                if len(line) >= SHINGLE and (key := line_key(line)) not in seen:
                    fresh[key] = line
            if not fresh:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(fresh)
            least = _least(list(fresh.values()))
            bands.append(_bands(least))
            drawn.append(_sketches(least))
            keys.append(_halves(list(fresh))[0].to_numpy())
            n += BANDS * len(fresh)
            if n >= ROWS_PER_TASK:
                yield packed(bands, keys, drawn)
                bands, keys, drawn, n = [], [], [], 0
        if n:
            yield packed(bands, keys, drawn)

    return docs.select("text").mapInArrow(run, "part int, rows binary")


def _parted(sketch: np.ndarray, most_off: int) -> list[np.ndarray]:
    """Places of the lines of a bucket, those apart that no chain of near sketches connects; none of lines alone."""
    rest, out = np.arange(len(sketch)), []
    while len(rest):
        group, rest = [rest[:1]], rest[1:]
        for found in group:
            for at in range(0, len(found), SMALL_BUCKET):
                if not len(rest):
                    break
                met = _near(sketch[found[at : at + SMALL_BUCKET], None], sketch[rest], most_off).any(axis=0)
                if met.any():
                    group.append(rest[met])
                    rest = rest[~met]
        if len(group) > 1:
            out.append(np.sort(np.concatenate(group)))
    return out


def _meet(batches, most_off: int = 64):
    """Pairs (a, b) of lines that share a bucket of the part and whose sketches differ in at most
    ``most_off`` of 64 bits: all of up to ``PAIRED`` lines.  Larger buckets are parted by sketches,
    and of a part of more lines each line is put with the first one, and ``bucket`` (a hash of its
    lines) and ``n``, its size.
    """
    rows = np.frombuffer(b"".join(x for batch in batches for x in batch.column("rows").to_pylist()), _BAND)
    order = np.argsort(rows["bucket"])
    bucket = rows["bucket"][order]
    same = bucket[1:] == bucket[:-1]
    met = np.append(same, False) | np.insert(same, 0, False) if len(rows) else np.zeros(0, bool)
    bucket, k1, sketch = bucket[met], rows["k1"][order[met]], rows["sketch"][order[met]]
    order = np.lexsort((k1, bucket))
    bucket, k1, sketch = bucket[order], k1[order], sketch[order]
    fresh = np.ones(len(k1), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (k1[1:] != k1[:-1])
    bucket, k1, sketch = bucket[fresh], k1[fresh], sketch[fresh]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k1) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k1)))
    few = np.repeat(sizes <= PAIRED, sizes)

    def made(a, b, bucket=None, n=None):
        none = pa.nulls(len(a), pa.int64())
        given = [none, none] if n is None else [pa.array(bucket), pa.array(n)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *given], names=["a", "b", "bucket", "n"])

    for d in range(1, PAIRED):
        at = np.flatnonzero(few[d:] & (bucket[d:] == bucket[:-d]))
        at = at[_near(sketch[at], sketch[at + d], most_off)]
        if len(at):
            yield made(k1[at], k1[at + d])
    pairs, stars, held = [], [], 0
    larger = np.flatnonzero(sizes > PAIRED)
    for at, start, n in zip(larger.tolist(), starts[larger].tolist(), sizes[larger].tolist()):
        drawn = sketch[start : start + n]
        for part in _parted(drawn, most_off) if n <= MOST_SPLIT else [np.arange(n)]:
            lines = k1[start + part]
            if len(lines) <= PAIRED:
                i, j = np.triu_indices(len(lines), 1)
                near = _near(drawn[part[i]], drawn[part[j]], most_off)
                pairs.append((lines[i[near]], lines[j[near]]))
            else:
                name = xxhash.xxh3_64_intdigest(lines.tobytes()) - (1 << 63)
                stars.append(tuple(np.full(len(lines) - 1, x, np.int64) for x in (lines[0], name, len(lines))) + (lines[1:],))
            held += len(lines)
        if held >= ROWS_PER_TASK or at == larger[-1]:
            if pairs:
                yield made(*map(np.concatenate, zip(*pairs)))
            if stars:
                a, name, size, b = map(np.concatenate, zip(*stars))
                yield made(a, b, name, size)
            pairs, stars, held = [], [], 0


def _marks(keys: DataFrame) -> np.ndarray:
    """A bit for each remainder of ``k1`` among ``keys``, about 32 bits a key, at most 16 MB."""
    bits = PAGE * min(MOST_PAGES, max(1, -(-32 * keys.count() // PAGE)))
    place = F.pmod("k1", F.lit(bits))
    pages = keys.groupBy(F.floor(place / PAGE).alias("page")).agg(F.bitmap_construct_agg((place % PAGE).cast("long")).alias("bits"))
    marks = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for page, found in pages.collect():
        marks[page] = np.frombuffer(found, np.uint8)
    return marks.reshape(-1)


def _marked_lines(docs: DataFrame, wanted: DataFrame, least_words: int, made, schema: str) -> DataFrame:
    """``made`` of the lines whose ``k1`` is wanted, and of some others, from their keys and normal forms.

    Lines without a mark stay where they are, so the documents are not shuffled; where the
    marks are full, more lines are sent and a join leaves the rest out.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches):
        held, seen = marks.value, set()
        for batch in slices(batches, "text"):
            lines = list({x for text in batch.column("text").to_pylist() for _, x in judged_lines(text or "", least_words) if len(x) >= SHINGLE})
            if not lines:
                continue
            keys = list(map(line_key, lines))
            place = _halves(keys)[0].to_numpy() % (8 * len(held))
            marked = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist()
            if chosen := [i for i in marked if keys[i] not in seen]:
                yield made([keys[i] for i in chosen], [lines[i] for i in chosen])
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(keys[i] for i in chosen)

    return docs.select("text").mapInArrow(run, schema).join(wanted.select("k1").distinct().hint("merge"), "k1", "left_semi")


def _line_texts(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """Key and normal form of the lines whose ``k1`` is wanted, once each."""

    def made(keys, lines):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *_halves(keys), pa.array(lines, pa.string())], names=["key", "k1", "k2", "line_text"]
        )

    sent = _marked_lines(docs, wanted, least_words, made, "key binary, k1 long, k2 long, line_text string")
    return sent.groupBy("key", "k1", "k2", "line_text").agg(F.count(F.lit(1)).alias("n")).drop("n")


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _runs(lines: list[str]) -> list[np.ndarray]:
    """Of each line (five characters at least) its distinct shingles as sorted numbers, equal ones for equal shingles."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max() >= 4096:
        letters, codes = np.unique(codes, return_inverse=True)
        if len(letters) > 4096:
            numbers: dict[str, int] = {}
            return [np.sort([numbers.setdefault(x, len(numbers)) for x in shingles(line)]).astype(np.uint64) for line in lines]
    one = codes.astype(np.uint64)
    two = (one[:-1] << np.uint64(12)) | one[1:]
    five = (((two[:-2] << np.uint64(24)) | two[2:])[:-1] << np.uint64(12)) | one[4:]
    out, start = [], 0
    for line in lines:
        held = five[start : start + len(line) - SHINGLE + 1]
        held.sort()
        out.append(held[np.concatenate([_FIRST, held[1:] != held[:-1]])])
        start += len(line)
    return out


def _similar_runs(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    met = np.concatenate([a, b])
    met.sort()
    both = int(np.count_nonzero(met[1:] == met[:-1]))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def similar_texts(first: str, second: str) -> bool:
    """``similar`` of the shingles of two lines of five characters at least."""
    return _similar_runs(*_runs([first, second]))


def _linked(batches):
    """The pairs whose lines are similar, or connected by similar pairs of the same batch."""
    for batch in slices(batches, "text_a"):
        parent: dict[bytes, bytes] = {}
        sides = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
        texts = list(dict.fromkeys(sides[0] + sides[1]))
        runs = dict(zip(texts, _runs(texts)))

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        keep = []
        for a, b, first, second in zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b")), *sides):
            a, b = root(a), root(b)
            keep.append(a == b or _similar_runs(runs[first], runs[second]))
            if keep[-1]:
                parent[max(a, b)] = min(a, b)
        yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array(keep, pa.bool_()))


def _link_to_pivot(batches):
    """Whether each row's line is similar to the first line that it is compared with."""
    for batch in batches:
        held, wanted, out = None, set(), []
        for text, pivot in zip(batch.column("line_text").to_pylist(), batch.column("pivot_text").to_pylist()):
            if pivot != held:
                held, wanted = pivot, shingles(pivot)
            most = max(1, len(text) - SHINGLE + 1)  # shingles that it can have
            out.append(text == pivot or (most >= SIMILARITY * len(wanted) and similar(shingles(text), wanted)))
        kept = [c for c in batch.schema.names if c != "pivot_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.bool_())], names=[*kept, "linked"])


def _compare_cells(batches):
    """Edges among the rows of each cell: those marked ``left`` against all, until connected.

    Rows arrive sorted by cell; a cell has at most about twice ``SMALL_BUCKET`` rows.  Lines of
    one label are connected already, and pairs that other pairs connect are not compared.
    """

    def finish(rows):
        texts, label, left = {}, {}, set()
        for key, text, name, is_left in rows:
            texts[key], label[key] = text, name
            if is_left:
                left.add(key)
        parent = {name: name for name in label.values()}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        keys, found = sorted(texts), []
        if len(keys) < 2:
            return found
        lefts = np.array([k in left for k in keys])
        labels = np.unique(np.array([label[k] for k in keys], object), return_inverse=True)[1]

        def asked(pairs):
            a, b = pairs.T
            return pairs[(lefts[a] | lefts[b]) & (labels[a] != labels[b])]

        pairs = asked(near_pairs([texts[k] for k in keys]))
        exact = len(pairs) > FEW_PAIRS * len(keys)
        if exact:
            pairs = asked(np.stack(similar_pairs([texts[k] for k in keys]), 1))
        runs = {}
        if len(pairs) and not exact and sum(map(len, texts.values())) <= MOST_CHARACTERS:
            some = np.unique(pairs).tolist()
            runs = dict(zip(some, _runs([texts[keys[i]] for i in some])))
        for i, j in pairs.tolist():
            a, b = keys[i], keys[j]
            ra, rb = root(label[a]), root(label[b])
            if ra != rb and (exact or (_similar_runs(runs[i], runs[j]) if runs else similar_texts(texts[a], texts[b]))):
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
        return found

    cell, rows, out = None, [], []
    for batch in batches:
        for *now, key, text, label, left in zip(
            *(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "key", "line_text", "label", "left"))
        ):
            if now != cell:
                out += finish(rows)
                cell, rows = now, []
            rows.append((key, text, label, left))
        if out:
            yield _edges(out)
            out = []
    if out := finish(rows):
        yield _edges(out)


def _cell_number(n: Column) -> Column:
    return F.ceil(n / SMALL_BUCKET).cast("int")


def _tasks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similar_lines(docs: DataFrame, n_lines: int, least_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """Edges (a, b) between keys of similar lines, enough to connect what all similar pairs
    that share a band would connect; the compared lines' ``key``, ``k1``, ``k2``; and a bound
    of the number of edges.

    Of a band bucket of up to eight lines all pairs are looked at, of a larger one each line
    with the first one; buckets share most of these pairs, and each pair is looked at once.
    Sketches that travel with the bands rule out chance pairs in their bucket and part larger
    buckets, the texts of the others are compared.  Of larger buckets, lines similar to the first one are connected and take its label, and those with
    other lines besides are looked at again, without their first line: in those of more than
    128 lines the others go through two more such rounds, then every line outside the first
    label is compared with all lines of the bucket that have another label, within cells of
    about 128.
    """
    parts = max(_tasks(docs), BANDS * n_lines // ROWS_PER_TASK)
    dealt = _band_table(docs, least_words, parts).repartitionById(parts, "part")
    met = stored(dealt.mapInArrow(partial(_meet, most_off=MOST_OFF), "a long, b long, bucket long, n long"), "met")
    pairs = stored(met.select("a", "b").distinct(), "pairs")
    several = stored(met.where("bucket IS NOT NULL").distinct(), "several")
    n_shared = several.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    texts = stored(_line_texts(docs, stored(wanted, "wanted"), least_words), "line_texts")
    sides = [texts.select(F.col("k1").alias(x), F.col("key").alias(f"key_{x}"), F.col("line_text").alias(f"text_{x}")).hint("merge") for x in "ab"]
    paired = stored(
        pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_linked, "a long, b long, key_a binary, key_b binary"), "paired"
    )
    keys_of = paired.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).coalesce(max(1, -(-paired.count() // ROWS_PER_FILE)))
    spokes = stored(keys_of.mapInArrow(forest, "u binary, v binary").toDF("a", "b"), "spokes")
    first = several.join(paired.select("a", "b", F.col("key_a").alias("pivot_key")).distinct().hint("merge"), ["a", "b"], "left")
    mixed = stored(first.where("pivot_key IS NULL").select("bucket").distinct(), "mixed", n_shared)
    members = stored(
        first.join(mixed.hint("merge"), "bucket").join(texts.select(F.col("k1").alias("b"), "key", "line_text").hint("merge"), "b")
        .select("bucket", "n", "key", "line_text", "pivot_key", F.col("pivot_key").isNotNull().alias("linked")),
        "members",
    )
    label = F.when(F.col("linked"), F.col("pivot_key")).otherwise(F.col("key")).alias("label")
    small = members.where(F.col("n") <= SMALL_BUCKET).select(
        "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "line_text", label, (~F.col("linked")).alias("left")
    )
    large = members.where(F.col("n") > SMALL_BUCKET)
    labelled = large.where("linked").select("bucket", "n", "key", "line_text", label, F.lit(False).alias("left"))
    unlinked = large.where("NOT linked").select("bucket", "n", "key", "line_text")
    for _ in range(1, PIVOT_ROUNDS):
        first = unlinked.groupBy("bucket").agg(F.min(F.struct("key", "line_text")).alias("p"))
        checked = stored(
            unlinked.join(first.hint("merge"), "bucket")
            .select("bucket", "n", "key", "line_text", F.col("p.key").alias("pivot_key"), F.col("p.line_text").alias("pivot_text"))
            .mapInArrow(_link_to_pivot, "bucket long, n long, key binary, line_text string, pivot_key binary, linked boolean"),
            "checked",
        )
        near = checked.where("linked").select(
            "bucket", "n", "key", "line_text", F.col("pivot_key").alias("label"), F.lit(True).alias("left")
        )
        labelled = labelled.unionByName(near)
        spokes = spokes.unionByName(near.where("key <> label").select(F.col("label").alias("a"), F.col("key").alias("b")))
        unlinked = checked.where("NOT linked").select("bucket", "n", "key", "line_text")
    labelled = labelled.unionByName(unlinked.select("*", F.col("key").alias("label"), F.lit(True).alias("left")))
    others = labelled.where("left").groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    open_rows = labelled.join(others, "bucket")
    deal = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    rights, lefts = _cell_number(F.col("n")), _cell_number(F.col("m"))
    as_right = open_rows.withColumns({"j": (deal % rights).cast("int"), "i": F.explode(F.sequence(F.lit(0), lefts - 1))})
    as_left = open_rows.where("left").withColumns(
        {"i": (deal % lefts).cast("int"), "j": F.explode(F.sequence(F.lit(0), rights - 1))}
    )
    cells = small.unionByName(
        as_right.select("bucket", "i", "j", "key", "line_text", "label", F.lit(False).alias("left"))
    ).unionByName(as_left.select("bucket", "i", "j", "key", "line_text", "label", F.lit(True).alias("left")))
    in_cells = cells.repartition(max(_tasks(docs), n_shared // ROWS_PER_TASK), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(in_cells.mapInArrow(_compare_cells, "a binary, b binary"), "found")
    return found.union(spokes), texts.drop("line_text"), found.count() + spokes.count()


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_WORDS
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_judged``, ``dropped`` (line numbers from 0).

    Lines with at least ``least_words`` words (default: every line but blank ones) are compared in normal form (lower case, single spaces) by
    the Jaccard similarity of their five-character shingles; those at 0.8 or more are linked.
    Of each component the first line (by id, then line number; a null id comes last) stays,
    the others are dropped.  Lines with fewer words stay; lines under five characters must be equal.  Seventeen bands of five MinHash values miss a
    pair at 0.8 with probability 0.0012, a pair at 0.9 with 0.0000003; sketches with 0.00001 at 0.8.  Null and empty texts
    have one empty line and lose nothing.  Rows that repeat an id lose the same lines.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = stored(_line_table(picked, least_words), "lines")
    lines = table.where("k1 IS NOT NULL")
    n_lines = lines.count()
    edges, keys, most = similar_lines(picked, n_lines, least_words)
    roots = components(edges, "a", "b", most)
    top = keys.select(F.col("key").alias("root"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    linked = keys.join(roots.withColumnRenamed("node", "key"), "key").join(top, "root").select("k1", "k2", "r1", "r2")
    # lines that occur once and resemble none stay; only the others go on
    copies = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = copies.join(linked.hint("merge"), ["k1", "k2"], "left_anti").select(
        "k1", "k2", F.col("k1").alias("r1"), F.col("k2").alias("r2")
    )
    groups = stored(linked.unionByName(alone), "groups", n_lines)
    spots = stored(lines.select("k1", "k2", "id", "line").join(groups.hint("merge"), ["k1", "k2"]), "spots", n_lines)
    spot = F.struct(F.col("id").isNull().alias("last"), "id", "line")
    first = stored(spots.groupBy("r1", "r2").agg(F.min(spot).alias("first")), "first", n_lines)
    dropped = (
        spots.join(first.hint("merge"), ["r1", "r2"])
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line"))))
        .groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    )
    counted = table.where("k1 IS NULL").select("id", F.col("line").alias("n_lines"), F.col("k2").alias("n_judged"))
    per_id = counted.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("n_judged").alias("n_judged"))
    repeated = stored(per_id.where("copies > 1").select(F.col("id").alias("_id")), "repeated")
    of_repeated = lines.join(repeated, lines["id"].eqNullSafe(repeated["_id"]), "left_semi")
    judged = per_id.where("copies = 1").select("id", "n_judged").unionByName(
        of_repeated.groupBy("id").agg(F.countDistinct("line").alias("n_judged"))
    )
    found = (
        judged.withColumn("dropped", F.lit(None).cast("array<long>"))
        .unionByName(dropped.withColumn("n_judged", F.lit(None).cast("long")))
        .groupBy(F.col("id").alias("_id"))
        .agg(F.max("n_judged").alias("n_judged"), F.first("dropped", ignorenulls=True).alias("dropped"))
    )
    counted = counted.select("id", "n_lines")
    return counted.join(found, counted["id"].eqNullSafe(found["_id"]), "left").select(
        F.col("id").alias(id_col), "n_lines", F.coalesce("n_judged", F.lit(0).cast("long")).alias("n_judged"),
        F.coalesce("dropped", F.array().cast("array<long>")).alias("dropped"),
    )


def drop_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``line_dedup`` dropped; other columns as they are."""
    lost = verdicts.where(F.size("dropped") > 0).select(F.col(id_col).alias("_id"), F.col("dropped").alias("_dropped")).distinct()
    kept = F.array_join(
        F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_dropped", i.cast("long"))), "\n"
    )
    joined = docs.join(lost, docs[id_col].eqNullSafe(lost["_id"]), "left")
    return joined.select(*(
        F.when(F.col("_dropped").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns
    ))
