import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import sentence_pieces as sp
from gridloom.llm.queries import QUERIES, tokenizer_path
from tests.llm.fixtures import documents, frame

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sp.PieceModel(PATH, cached=500)
HARD = [
    "", " ", "  ", "\n", " \n\t\r ", " " * 100, " " * 31 + "a", "▁", "▁▁ x▁", "a▁b", "x" * 3000, "ab" * 700 + " " + "é" * 500, "\0", "\0a\0",
    "<s> </s> <unk> <0x0A>", "café ﬁ ﷽ ｆｕｌｌ", "漢字かな交じり文。" * 40, "😀👩‍👩‍👧" * 3, "�", "नमस्ते दुनिया", "​﻿", "\x7f\x80\xa0",
]


def same(text):
    ids = MODEL.encode(text).tolist()
    assert ids == LIBRARY.encode(text) and MODEL.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_hard_texts_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinrst ▁\n"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library(text):
    same(text)


def test_strings_of_pieces_as_the_library():
    draw = random.Random(5)
    pool = list(MODEL.ids)
    for _ in range(3000):
        same("".join(draw.choice(pool).replace("▁", " ") for _ in range(draw.randrange(1, 9))))


def test_backtracking_equals_merging_step_by_step():
    draw = random.Random(6)
    letters = [c for c in "abcdeinorst▁" if c in MODEL.ids]
    for _ in range(2000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 25)))
        assert MODEL.backtrack(text) == MODEL.merged(text)


def test_longest_match_alone_is_not_the_encoding():
    """Some texts need the neighbour check: greedy longest matches differ from merging."""
    greedy_differs = 0
    for text in LIBRARY.decode([[i] for i in range(300, 3000)]):
        word = "▁" + text + "ingly"
        at, greedy = 0, []
        while at < len(word):
            size = next(n for n in range(min(16, len(word) - at), 0, -1) if word[at : at + n] in MODEL.ids or n == 1)
            greedy.append(MODEL.ids.get(word[at : at + size], -1))
            at += size
        greedy_differs += greedy != MODEL.backtrack(word)
    assert greedy_differs > 100


def test_decoding_of_any_ids_as_the_library():
    draw = random.Random(7)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259)]) for _ in range(draw.randrange(9))]
        assert MODEL.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("clash", [False, True])
def test_encode_and_decode_rows(spark, clash):
    rows = documents(n=40)
    coded = sp.encode_pieces(frame(spark, rows, clash), PATH)
    assert coded.columns == ["doc_id", "piece_ids"]
    got = sp.decode_pieces(coded, PATH).collect()
    want = [(r[0], LIBRARY.encode(r[1] or ""), LIBRARY.decode(LIBRARY.encode(r[1] or ""))) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bytes_that_are_no_text_and_null_lists(spark):
    broken = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text union all select null, null")
    got = {r["doc_id"]: r["piece_ids"] for r in sp.encode_pieces(broken, PATH).collect()}
    assert got == {1: LIBRARY.encode("a�b"), None: []}
    lists = spark.createDataFrame([(1, None), (2, []), (3, [264, None, 13])], "doc_id long, piece_ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in sp.decode_pieces(lists, PATH).collect()} == {1: "", 2: "", 3: LIBRARY.decode([264, 13])}


def test_empty_table(spark):
    empty = sp.encode_pieces(frame(spark, documents(n=5)).where("false"), PATH)
    assert sp.decode_pieces(empty, PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    raw = open(PATH, "rb").read()
    path = tmp_path / "unigram.model"
    path.write_bytes(raw + b"\x12\x02\x18\x01")  # a second trainer part: model type 1
    with pytest.raises(ValueError):
        sp.PieceModel(str(path))


def test_query_by_brute_force(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_piece_coding"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids)))
        assert got.pop(r["doc_id"]) == (len(ids), *digests)
    assert not got
