import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import packing as pk
from gridloom.llm.queries import tokenizer_path
from tests.llm.fixtures import documents, frame


def test_hilbert_keys_visit_neighbouring_cells():
    bits, dims = 3, 3
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = pk.hilbert_keys(cells / ((1 << bits) - 1) * 2 - 1, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_word_encoder_gives_the_tokenizers_ids():
    encoder = pk.WordEncoder(tokenizer_path(), cached_words=40)
    texts = [
        "", "  ", "a\x0bb c\x0cd\x85e f\x1cg", "<|endoftext|>x y<|startoftext|>", "é ́z don't 's 're Σ ΑΣ İstanbul ﬁ",
        "ﷺ ǆ ẞ ΐ ͅ 한국 𝒳 ‍\U0001f469‍\U0001f469​ ́ x", *[" ".join(f"w{i}q{j}" for i in range(30)) for j in range(9)],
        "Élan Ünder ÀÖØ ßtraße ÿ×÷ don't It's a''b <|x <| |> a<|endoftext|>b 12ab,,c3 A&B µªº \x1c\x7f\x01 é.è,É!! œ Œ ﬀ",
    ]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [[], [1], [7, 9, 1], [100, 3, 64, 64, 2], [13] * 40])
def test_sequences_are_filled_or_powers_of_two(sizes):
    documents = [(i, np.arange(n)) for i, n in enumerate(sizes)]
    seen, lengths = defaultdict(list), defaultdict(int)
    for doc, start, ids, sequence, offset in pk.cut_into_sequences(documents, 16, 5):
        assert offset == lengths[sequence] and len(ids)
        lengths[sequence] += len(ids)
        assert start == len(seen[doc]) and ids[0] == start
        seen[doc] += ids.tolist()
    assert {d: len(s) for d, s in seen.items()} == {d: n for d, n in enumerate(sizes) if n}
    assert all(n == 16 or n & (n - 1) == 0 for n in lengths.values())


@pytest.mark.parametrize("clash", [False, True])
def test_pieces_cover_every_id_once(spark, clash):
    rows = documents(5, 60)
    got = pk.pack_along_curve(frame(spark, rows, clash), tokenizer_path(), length=256).collect()
    encoder = pk.encoder(tokenizer_path())
    want = defaultdict(list)
    for r in rows:
        ids = encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0]].append(ids)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["token_ids"]) == 4 * r["length"] > 0
    for doc, copies in want.items():
        mine = sorted(pieces[doc], key=lambda r: (r["start"], r["sequence_id"]))
        assert sum(r["length"] for r in mine) == sum(map(len, copies))
        assert {r["doc_tokens"] for r in mine} == {len(c) for c in copies}
        for r in mine:
            ids = np.array(copies[0][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(ids.tobytes()) == zlib.crc32(bytes(r["token_ids"]))
    for spans in filled.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert set(pieces) == set(want)


def test_similar_documents_lie_side_by_side(spark):
    rows = [(i, (("red apple tree " if i % 2 else "blue ocean wave ") + f"n{i} ") * 20, "", "", 0) for i in range(200)]
    got = pk.pack_along_curve(frame(spark, rows), tokenizer_path()).select("doc_id", "curve_key").distinct().collect()
    order = [r["doc_id"] % 2 for r in sorted(got, key=lambda r: r["curve_key"])]
    assert sum(a != b for a, b in zip(order, order[1:])) < 60  # about 100 in random order


def test_empty_table(spark):
    assert pk.pack_along_curve(frame(spark, []), tokenizer_path()).count() == 0
