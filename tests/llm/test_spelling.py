import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from gridloom.llm import spelling as sp
from gridloom.llm.queries import QUERIES
from tests.llm.fixtures import documents, frame

LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))


def straight_counts(rows, every=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def neighbours(word):
    """All strings at one edit."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in LETTERS}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}) - {word}


def straight(rows, length=5, least=3, times=2, every=97):
    words = {w: n for w, n in straight_counts(rows, every).items() if len(w) >= length and n >= least}
    return from_words(words, times)


def from_words(words, times=2):
    near = {}
    if sum(map(len, words)) < 300_000:
        for w in words:
            near[w] = [v for v in neighbours(w) if v in words]
    else:
        raise AssertionError("too much for the straight way")
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def result(df):
    rows = df.collect()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(got) == len(rows)
    return got


def typed(seed, words, n):
    """Texts of some words with random edits, runs of equal letters among them."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        out = []
        for _ in range(60):
            word = draw.choice(words)
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                at = draw.randrange(len(word))
                letter = draw.choice([word[at], draw.choice("aeléñ"), ""])
                word = word[:at] + letter + word[at + draw.randrange(2) :]
            out.append(draw.choice([word, word.upper(), word.title()]))
        rows.append((draw.choice([i, i, None]), draw.choice([" ", ", ", "1", "漢", "\n"]).join(out), None, None, None))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("per_task", [3, 50, 20_000])
def test_against_all_edits(spark, monkeypatch, seed, per_task):
    monkeypatch.setattr(sp, "WORDS_PER_TASK", per_task)
    rows = typed(seed, ["aabbaa", "balloon", "baloon", "letter", "latter", "señora", "übergroß", "aaaaa"], 120)
    got = result(sp.variant_groups(frame(spark, rows, clash=seed == 1)))
    assert got == straight([r[:2] for r in rows]) and len(got) > 60


def test_dense_neighbourhoods_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(sp, "WORDS_PER_TASK", 100)
    words = {a + b + "xxx" + c: 3 + (ord(a) + ord(b)) % 5 for a in LETTERS for b in "abc" for c in ("", "x", "é")}
    words |= {"chain" + "o" * i: 3 * 2**i for i in range(20)}
    words |= {"ties" + c: 10 for c in "azé"} | {"tiess": 20, "tiesa": 20}
    docs = [(i, " ".join([w] * n), None, None, None) for i, (w, n) in enumerate(words.items()) if n < 200]
    docs += [(10_000 + i, " ".join([w] * n), None, None, None) for i, (w, n) in enumerate(words.items()) if n >= 200]
    got = result(sp.variant_groups(frame(spark, docs)))
    assert got == straight([d[:2] for d in docs])
    assert max(v[1] for v in got.values()) > 85


def test_awkward_documents(spark):
    rows = documents()
    rows += [(9000 + i, "y" * 20_000 + " " + "y" * 19_999 + " " + "z" * 700, None, None, None) for i in range(4)]
    got = result(sp.variant_groups(frame(spark, rows, clash=True)))
    counts = {w: n for w, n in straight_counts([r[:2] for r in rows]).items() if len(w) >= 5 and n >= 3}
    assert {w: v[0] for w, v in got.items()} == counts
    short = from_words({w: n for w, n in counts.items() if len(w) < 500})
    assert {w: v for w, v in got.items() if len(w) < 500} == short
    huge = {w for w in counts if len(w) >= 19_000}
    assert all(got[w][1] == sum(abs(len(v) - len(w)) == 1 for v in huge) for w in huge) and len(huge) >= 2


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, " 12 漢 ", None, None, None)], [(2, "abcde abcdf", None, None, None)]])
def test_no_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sp.variant_groups(docs).collect() == []


def test_limits_are_parameters(spark):
    rows = typed(9, ["cat", "cart", "chart", "art"], 60)
    got = result(sp.variant_groups(frame(spark, rows), least_length=2, least_count=2, times=3, every=7))
    assert got == straight([r[:2] for r in rows], 2, 2, 3, 7)
    with pytest.raises(ValueError):
        sp.variant_groups(frame(spark, rows), times=1)


def test_nodes_are_those_of_one_trie(spark, monkeypatch):
    """Words share a node if and only if they share the prefix, wherever tasks begin."""
    monkeypatch.setattr(sp, "WORDS_PER_TASK", 4)
    draw = random.Random(1)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 12))) for _ in range(300)} | {"a" * i for i in range(1, 60)}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    rows = sp.numbered_paths(table, "word", ["word"], len(words)).collect()
    prefixes, nodes = defaultdict(set), defaultdict(set)
    for r in rows:
        for i, node in enumerate(r["nodes"]):
            prefixes[r["word"][:i]].add(node)
            nodes[node].add(r["word"][:i])
    assert all(len(v) == 1 for v in prefixes.values()) and all(len(v) == 1 for v in nodes.values())
    assert [r["word"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(words)


def test_query_by_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op11_spelling_variants"](spark, sf)) == straight(docs)
