"""Masking and search against plain Python on whole texts and on made-up messages."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import masking as M
from gridloom.operators import retrieval as R
from gridloom.sources.tables import table


def mask_in_order(texts):
    """The expected result by hand: one store for a session, texts in order."""
    store, out = {}, []

    def placeholder(value, kind):
        if value not in store:
            store[value] = f"[REDACTED_{kind}_{len(store)}]"
        return store[value]

    for text in texts:
        done, low, found = text, text.lower(), {}
        for m in re.finditer(M.ENTITY, text):
            value = m.group(0)
            if len(value) < 3 or value in found:
                continue
            kind = next((k for n, k in M.KNOWN_NAMES if n.lower() in value.lower() or value.lower() in n.lower()), None)
            context = low[max(0, m.start() - 30) : m.end() + 30]
            if kind is None and any(i in context for i in M.INDICATORS):
                kind = "FACILITY" if any(x in value.lower() for x in M.FACILITY_MARKS) else "EQUIPMENT"
            if kind:
                found[value] = kind
        for value in sorted(found, key=lambda v: (-len(v), text.index(v))):
            done = done.replace(value, placeholder(value, found[value]))
        for kind, pattern in M.PATTERNS:
            for value in dict.fromkeys(re.findall(pattern, done)):
                done = done.replace(value, placeholder(value, kind))
        out.append(done)
    return out, store


MESSAGES = [
    "Check temperature sensor logs for Boiler X99 at London Facility (IP: 10.0.0.45) on 2026-06-06 20:00:00.",
    "Draw of Furnace 12 and Boiler X99 at the Cambridge site; mail ops@site.example.com or a.b@c.org",
    "nothing to hide here", "", "É10.1.2.3 and 10.1.2.3, Turbine 4X near Turbine 4X", "Steel Plant #4 again: Steel Plant",
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [("s1", i, t) for i, t in enumerate(MESSAGES)] + [("s2", i, t) for i, t in enumerate(reversed(MESSAGES))]
    return spark.createDataFrame(rows, "session string, turn int, text string").repartition(5)


def test_mask_equals_loop_and_restores(messages):
    masked, mapping = M.mask_messages(messages, "session", "turn", ["session", "turn"])
    for session, texts in (("s1", MESSAGES), ("s2", MESSAGES[::-1])):
        want, store = mask_in_order(texts)
        got = [r.masked for r in masked.filter(F.col("session") == session).orderBy("turn").collect()]
        assert got == want
        assert {r.value: r.placeholder for r in mapping.filter(F.col("session") == session).collect()} == store
    back = M.unmask(masked, mapping, "session", ["session", "turn"])
    assert back.filter("restored <> text").count() == 0


def test_numbering_over_chunks(messages, monkeypatch):
    """Small chunks give the same numbers as one run over the session."""
    from gridloom.operators import series

    found = M.find_sensitive(messages)
    whole = {tuple(r) for r in M.assign_placeholders(found, "session", "turn").collect()}
    monkeypatch.setattr(M, "with_position", lambda *a, **k: series.with_position(*a, **{**k, "target": 2}))
    assert {tuple(r) for r in M.assign_placeholders(found, "session", "turn", slot_width=1).collect()} == whole


def test_documents_equal_loop(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    masked, _ = M.mask_messages(docs, "source", "doc_id", ["doc_id"])
    got = {r.doc_id: r.masked for r in masked.select("doc_id", "masked").collect()}
    rows = docs.orderBy("doc_id").collect()
    want = {}
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        want |= dict(zip([r.doc_id for r in mine], mask_in_order([r.text for r in mine])[0]))
    assert got == want


def test_nested_payload(spark):
    df = spark.createDataFrame(
        [(1, ([120.3, 88.25], {"host": "10.0.0.7 up"}, 5))],
        "id int, p struct<loads:array<double>,tags:map<string,string>,n:int>",
    )
    out = df.select(M.mask_nested(F.col("p"), df.schema["p"].dataType, M.hide_patterns).alias("p")).first().p
    assert out.loads == [120.5, 88.0] and out.tags == {"host": "[REDACTED_IP] up"} and out.n == 5


@pytest.mark.parametrize("value,want", [(0.25, 0.0), (0.75, 1.0), (1.25, 1.0), (-0.75, -1.0), (120.3, 120.5)])
def test_coarsen_half_even(spark, value, want):
    assert spark.range(1).select(M.coarsen(F.lit(value))).first()[0] == want


DOCS = [
    (0, "Norms for Iron & Steel", "threshold for steel plants is strict", "Steel"),
    (1, "Cement kilns", "energy of cement", "Cement"),
    (2, "MSEDCL tariff", "peak tariff applies", "Tariff"),
    (3, "UGVCL tariffs", "night rebate", "Tariff"),
    (4, "Solar rules", "open access power", "Solar"),
]
QUERIES = [
    (0, "tariff", "tariff"), (1, "steel energy", None), (2, "zzz", None), (3, "zzz", "Solar"), (4, "e", None),
    (5, "Steel TARIFF cement rules", "Cement"), (6, "ebat ower", None),
]


def search_loop(queries, docs, k):
    out = []
    for qid, text, category in queries:
        terms, scored = set(text.lower().split()), []
        for doc, title, body, cat in docs:
            score = 8 if category and cat.lower() == category.lower() else 0
            score += 4 * len(terms & set(title.lower().split())) + 2 * len(terms & set(body.lower().split()))
            score += 3 * any(t in title.lower() or t in body.lower() for t in terms)
            if score:
                scored.append((-score, doc))
        best = [(qid, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:k])]
        out += best or [(qid, docs[0][0], 0, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_search_equals_loop(spark, k):
    q = spark.createDataFrame(QUERIES, "query_id int, text string, category string")
    d = spark.createDataFrame(DOCS, "doc_id int, title string, body string, category string")
    got = sorted(tuple(r) for r in R.keyword_search(q, d, k).select("query_id", "doc_id", "score", "rank").collect())
    assert got == search_loop(QUERIES, DOCS, k)


def test_few_pairs_are_scored(spark, monkeypatch):
    """Passages against all documents: the early stop leaves most pairs that share a word unscored."""
    from gridloom.plans.queries_text import _queries_docs

    asked, docs = _queries_docs(spark, "/root/testdata/sf0.01")
    counts, plain = [], R.pair_scores

    def counted(pairs, index, terms):
        counts.append(pairs.count())
        return plain(pairs, index, terms)

    monkeypatch.setattr(R, "pair_scores", counted)
    index = R.word_index(docs)
    got = sorted(tuple(r) for r in R.best_by_words(asked, index, 3).select("query_id", "doc_id", "score", "rank").collect())
    n = asked.count() * docs.count()
    assert sum(counts) < 0.25 * n
    pairs = asked.select("query_id").crossJoin(docs.select("doc_id"))
    terms = asked.select("query_id", R.words(F.col("text")).alias("terms"), F.lower("category").alias("_qc"))
    want = R._ranked(plain(pairs, index, terms).where("score > 11"), 3)
    assert got == sorted(tuple(r) for r in want.select("query_id", "doc_id", "score", "rank").collect())


def test_search_on_documents(spark, sf):
    """Short and odd words, so that queries without enough whole-word matches occur."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("body"), F.col("source").alias("category")
    )
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    asked = [(0, "xq qzx", None), (1, "hean", "src3"), (2, "the and", None), (3, "license", "SRC7"), (4, "@", None), (5, "nosuchword", "src1")]
    q = spark.createDataFrame(asked, "query_id int, text string, category string")
    got = sorted(tuple(r) for r in R.keyword_search(q, docs, 4).select("query_id", "doc_id", "score", "rank").collect())
    assert got == search_loop(asked, rows, 4)


def straight_entities(text):
    """Value, kind and first place that counts, by a loop."""
    low, found = text.lower(), {}
    for m in re.finditer(M.ENTITY, text):
        value = m.group(0)
        if len(value) < 3 or value in found:
            continue
        kind = next((k for n, k in M.KNOWN_NAMES if n.lower() in value.lower() or value.lower() in n.lower()), None)
        context = low[max(0, m.start() - 30) : m.end() + 30]
        if kind is None and any(i in context for i in M.INDICATORS):
            kind = "FACILITY" if any(x in value.lower() for x in M.FACILITY_MARKS) else "EQUIPMENT"
        if kind:
            found[value] = (value, kind, m.start())
    return sorted(found.values(), key=lambda e: (-len(e[0]), e[2]))


def test_entities_equal_loop_at_word_ends_contexts_and_lengths(spark):
    import random

    draw = random.Random(7)
    pieces = ["Alpha", "Beta 4X", "Éclair", "Straße", "Foo_bar", "Caf\u00e9 Zed", "meter", "plant", "Pump\u00a0Two", "x" * 29, "x" * 30,
              "x" * 31, "漢字", "\U0001f600", "Cafe\u0301", "Co.", "steel", "Steel", "A", "Ab", "12", "\n", ".", "Site"]
    texts = ["".join(draw.choice(pieces) + draw.choice([" ", "  ", "", ", "]) for _ in range(draw.randint(1, 25))) for _ in range(300)]
    texts += MESSAGES + ["Gamma " + "x" * 24 + "meter", "Gamma " + "x" * 25 + "meter", "meter" + "x" * 24 + " Gamma", "meter" + "x" * 26 + " Gamma"]
    texts += ["Word " * 20_000, " ".join(f"Pump{i % 5000} of meter," for i in range(20_000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    got = {}
    for r in M.extract_entities(df).collect():
        got.setdefault(r.i, []).append((r.value, r.kind, r.start))
    for i, text in enumerate(texts):
        assert got.get(i, []) == straight_entities(text or ""), (text or "")[:200]
