import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gridloom.llm import exact_dedup as ex
from gridloom.llm import line_dedup as ld
from gridloom.llm import simhash as sh
from gridloom.llm.components import components
from tests.llm.fixtures import documents, frame, prose


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components_match_a_straight_union_find(spark, shape):
    draw = random.Random(4)
    nodes = list(range(300))
    draw.shuffle(nodes)
    edges = {
        "path": list(zip(nodes, nodes[1:])), "star": [(nodes[0], n) for n in nodes[1:]],
        "random": [(draw.randrange(300), draw.randrange(300)) for _ in range(200)], "none": [],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    want = roots_of(range(300), edges)
    assert {r["node"]: r["root"] for r in got} == {n: want[n] for n in touched}
    assert len(got) == len(touched)


@pytest.mark.parametrize("n", [0, 1, 2, 70, 5000])
def test_perfect_hash_is_minimal_and_rejects_strangers(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    levels, slots = ex.build_slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert (ex.find_slots(levels, keys) == slots).all()
    strangers = np.frombuffer(b"".join(hashlib.sha256(b"?%d" % i).digest() for i in range(50)), np.uint8).reshape(-1, 32)
    found = ex.find_slots(levels, strangers)
    held = keys[np.argsort(slots)]
    assert not any(s >= 0 and (held[s] == k).all() for s, k in zip(found, strangers))


@pytest.mark.parametrize("split", [None, -100, 150, 10_000])
@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup(spark, split, clash):
    rows = documents()
    got = ex.exact_dedup(frame(spark, rows, clash), split=split).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_members_are_found_by_the_look_up_alone(spark, monkeypatch):
    """A look-up that finds nothing leaves members of the history as groups of their own."""
    rows = documents()

    def blind(part, table):
        return part[["digest", "locator", "copies"]].assign(known=None).astype({"known": "Int64"})

    right = ex.exact_dedup(frame(spark, rows), split=150).where("kept").count()
    monkeypatch.setattr(ex, "_look_up", blind)
    assert ex.exact_dedup(frame(spark, rows), split=150).where("kept").count() > right


def test_exact_dedup_of_many_tables(spark, monkeypatch):
    monkeypatch.setattr(ex, "DIGESTS_PER_TABLE", 16)
    rows = [(i, f"text {i % 700}", None, None, None) for i in range(2000)]
    got = ex.exact_dedup(frame(spark, rows)).collect()
    assert all(r["keep_id"] == r["doc_id"] % 700 for r in got) and sum(r["kept"] for r in got) == 700


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert ex.exact_dedup(empty).count() == sh.simhash_dedup(empty).count() == ld.line_dedup(empty).count() == 0


def straight_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("clash", [False, True])
def test_simhash_dedup(spark, clash):
    rows = documents(2, 90)
    prints = {i: straight_fingerprint(r[1]) for i, r in enumerate(rows)}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = roots_of(prints, links)
    least = defaultdict(list)
    for i, root in roots.items():
        least[root].append(rows[i][0])
    want = [
        (r[0], f"{prints[i]:016x}", min((x for x in least[roots[i]] if x is not None), default=None))
        for i, r in enumerate(rows)
    ]
    got = sh.simhash_dedup(frame(spark, rows, clash)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    words = ["", "a", "some words here", "é漢\U0001f600" * 9]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@pytest.mark.parametrize("small", [64, 2])
def test_close_pairs_keep_all_links_in_hot_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(sh, "SMALL_BUCKET", small)
    draw = random.Random(9)
    base, prints = draw.getrandbits(64), set()
    for _ in range(250):
        x = base if draw.random() < 0.6 else draw.getrandbits(64)
        for _ in range(draw.randrange(4)):
            x ^= 1 << draw.randrange(64)
        prints.add(x - (1 << 64) if x >> 63 else x)
    links = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    pairs, most = sh.close_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert pairs.count() <= most
    got = components(pairs, "a", "b", most).collect()
    want = roots_of(prints, links)
    assert {r["node"]: r["root"] for r in got} == {n: want[n] for n in {x for p in links for x in p}}


def straight_lines(rows, least_words):
    spots = []
    for doc, text, *_ in rows:
        spots += [(doc, i, x) for i, x in ld.judged_lines(text or "", least_words)]
    forms = sorted({x for _, _, x in spots})
    sets = {x: ld.shingles(x) for x in forms}
    links = [(a, b) for a in forms for b in forms if a < b and ld.similar(sets[a], sets[b])]
    roots = roots_of(forms, links)
    first = {}
    for doc, i, x in spots:
        spot = (doc is None, doc if doc is not None else 0, i)
        first[roots[x]] = min(first.get(roots[x], spot), spot)
    lost = defaultdict(set)
    for doc, i, x in spots:
        if first[roots[x]] != (doc is None, doc if doc is not None else 0, i):
            lost[doc].add(i)
    return lost


@pytest.mark.parametrize("small", [128, 3])
@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup(spark, monkeypatch, small, clash):
    monkeypatch.setattr(ld, "SMALL_BUCKET", small)
    rows = [r for r in documents(3, 60) if r[0] != 1005]
    stem = "the common passage about rivers and their long slow bends number"
    rows += [(2000 + i, f"{stem} {i}\nshort one\n{prose(random.Random(i), 12)}", "en", "s0", 0) for i in range(40)]
    lost = straight_lines(rows, 5)
    got = ld.line_dedup(frame(spark, rows, clash), least_words=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r["dropped"]) == lost.get(r["doc_id"], set()), r
    assert {r["doc_id"]: r["n_lines"] for r in got}[1002] == 1
    cleaned = {r["doc_id"]: r["text"] for r in ld.drop_lines(frame(spark, rows), ld.line_dedup(frame(spark, rows), least_words=5)).collect()}
    assert cleaned[2003].startswith("short one\n") and cleaned[1001] is None and cleaned[1003] == " \t\n "


def test_minhash_agreement_follows_jaccard():
    draw = random.Random(5)
    lines = [" ".join(draw.choice("abcdefghijklmnop") * 3 + str(draw.randrange(99)) for _ in range(60)) for _ in range(60)]
    pairs = [(x, x[:-3] + "zzz") for x in lines]
    first, second = ld.signatures([a for a, _ in pairs]), ld.signatures([b for _, b in pairs])
    assert ((first == second).any(axis=1)).all()
    assert (first[1:] != first[:-1]).all()


def test_similar_pairs_are_exact(monkeypatch):
    monkeypatch.setattr(ld, "COLUMNS", 7)
    draw = random.Random(6)
    lines = [prose(draw, 9).replace("\n", " ") for _ in range(20)]
    lines += [x + "!" * draw.randrange(1, 9) for x in lines] + lines[:3] + ["short", "a b c d e"]
    sets = [ld.shingles(x) for x in lines]
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if ld.similar(sets[a], sets[b])}
    assert set(zip(*map(list, ld.similar_pairs(lines)))) == want and len(want) > 20


def test_lines_with_one_changed_character_are_linked(spark):
    draw = random.Random(21)
    rows = []
    for i in range(60):
        line = prose(draw, 30).replace("\n", " ")[: 52 + i % 26].strip()
        place = 10 + i % 30
        other = line[:place] + "#" + line[place + 1 :]
        a, b = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (line, other))
        assert len(a & b) >= 0.8 * len(a | b)  # own shingle length, not the operator's
        rows += [(2 * i, line, "en", "s", 0), (2 * i + 1, other, "en", "s", 0)]
    got = {r["doc_id"]: r["dropped"] for r in ld.line_dedup(frame(spark, rows)).collect()}
    assert [i for i in range(60) if got[2 * i + 1] != [0]] == []


def test_short_lines_and_lines_without_spaces_are_judged(spark):
    from gridloom.llm.queries import QUERIES

    chinese = "".join(map(chr, range(0x4E00, 0x4E3C)))
    rows = [
        (1, "Home\nok\n\nabout  us\n" + chinese, "en", "s", 0), (2, "HOME\nno\n\nAbout us", "en", "s", 0),
        (3, "ok\n \n" + chinese[:30] + "龍" + chinese[31:], "zh", "s", 0), (4, "a b c d e f g h", "en", "s", 0),
    ]
    got = {r["doc_id"]: (r["n_judged"], r["dropped"]) for r in ld.line_dedup(frame(spark, rows), least_words=1).collect()}
    assert got == {1: (4, []), 2: (3, [0, 3]), 3: (2, [0, 2]), 4: (1, [])}
    found = QUERIES["op7_fuzzy_line_dedup"](spark, "/root/testdata/sf0.001").agg({"n_judged": "sum"}).first()[0]
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert found == sum(bool(x.strip()) for r in texts for x in (r["text"] or "").split("\n"))


def test_similar_lines_of_the_corpus_share_a_band():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = sorted({x for t in texts for _, x in ld.judged_lines(t or "") if len(x) >= ld.SHINGLE})
    signed, sets = ld.signatures(lines), [ld.shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if ld.similar(sets[i], sets[j])]
    met = sum(bool((signed[i] == signed[j]).any()) for i, j in links)
    assert len(links) >= 5 and met >= 0.9 * len(links)


def test_a_pair_of_lines_is_checked_once_for_all_its_buckets(spark):
    """Edges follow the lines, not the buckets that the lines share."""
    draw = random.Random(33)
    rows = []
    for i in range(8):
        stem = prose(draw, 40).replace("\n", " ")
        rows += [(100 * i + j, stem + " no " + "abcdefghij"[j] * (j + 1), "en", "s", 0) for j in range(10)]
    docs = frame(spark, rows).selectExpr("doc_id AS id", "text")
    lines = [ld.normal(r[1]) for r in rows]
    edges, keys, most = ld.similar_lines(docs, len(lines))
    found = [(bytes(a), bytes(b)) for a, b in edges.collect()]
    sets, named = [ld.shingles(x) for x in lines], [ld.line_key(x) for x in lines]
    links = [(named[a], named[b]) for a in range(80) for b in range(a) if ld.similar(sets[a], sets[b])]
    assert roots_of(named, found) == roots_of(named, links) and len(links) > 300
    assert len(found) <= most <= 2 * len(lines)


def test_prints_leave_out_no_similar_pair():
    draw = random.Random(8)
    lines = [prose(draw, n).replace("\n", " ") for n in (1, 2, 9, 40, 90, 300)] + ["漢字かな交じり文" * 9, "aaaaa", "ab " * 50]
    lines += [x[:i] + "#é" + x[i + j :] for x in lines for i in (1, len(x) // 3) for j in (0, 2, len(x) // 9, len(x) // 4)]
    lines = [x for x in lines if len(x) >= ld.SHINGLE]
    marks, sets, runs = ld.prints(lines), [ld.shingles(x) for x in lines], [len(x) - ld.SHINGLE + 1 for x in lines]
    seen = set()
    for i in range(len(lines)):
        for j in range(len(lines)):
            same = ld.similar(sets[i], sets[j])
            assert same == ld.similar_texts(lines[i], lines[j])
            seen.add((same, ld.far(runs[i], marks[i], runs[j], marks[j])))
    assert seen == {(True, False), (False, False), (False, True)}


def test_bands_are_sent_by_part_and_meet_there(spark):
    """A task sends one packed row a part, not one a band; chance pairs and buckets of any size come out."""
    draw = random.Random(12)
    stem = prose(draw, 60).replace("\n", " ")
    rows = [(i, stem + " " + "abcdefghijklmnopqrst"[i] * 3, "en", "s", 0) for i in range(20)]
    rows += [(100 + i, prose(draw, 30).replace("\n", " "), "en", "s", 0) for i in range(30)]
    docs = frame(spark, rows).selectExpr("doc_id AS id", "text")
    sent = ld._band_table(docs, 1, 4)
    assert sent.count() <= 4 * docs.rdd.getNumPartitions()
    met = sent.repartitionById(4, "part").mapInArrow(ld._meet, "a long, b long, bucket long, n long").collect()
    lines = [ld.normal(r[1]) for r in rows]
    keys = ld._halves([ld.line_key(x) for x in lines])[0].to_pylist()
    signed = ld.signatures(lines)
    shared = {tuple(sorted((keys[i], keys[j]))) for i in range(50) for j in range(i) if (signed[i] == signed[j]).any()}
    got = roots_of(keys, [(r["a"], r["b"]) for r in met])
    assert got == roots_of(keys, shared) and len(shared) >= 190
    assert {r["n"] for r in met if r["bucket"] is not None} and all(r["a"] < r["b"] for r in met)


@pytest.mark.parametrize("paired, small", [(2, 4)])
def test_larger_buckets_lose_no_link(spark, monkeypatch, paired, small):
    monkeypatch.setattr(ld, "PAIRED", paired)
    monkeypatch.setattr(ld, "SMALL_BUCKET", small)
    draw, rows = random.Random(14), []
    for i in range(6):
        stem = prose(draw, 14).replace("\n", " ")
        for j in range(12):
            at = draw.randrange(len(stem))
            rows.append((100 * i + j, stem[:at] + draw.choice("#%&") * draw.randrange(1, 9) + stem[at:], "en", "s", 0))
    lost = straight_lines(rows, 1)
    got = {r["doc_id"]: r["dropped"] for r in ld.line_dedup(frame(spark, rows)).collect()}
    assert {i: set(x) for i, x in got.items() if x} == lost and len(lost) > 20


def test_chance_pairs_end_in_their_bucket(spark):
    """Of the pairs that share a band, similar ones leave their bucket and chance ones do not, whatever its size."""
    import pyarrow as pa

    draw = random.Random(17)
    lines = [prose(draw, 40).replace("\n", " ") for _ in range(400)]
    lines += [x[:i] + "#" + x[i + 1 :] for x in lines for i in (20, 90)]
    lines = sorted({ld.normal(x) for x in lines if len(x) > 60})
    keys = ld._halves([ld.line_key(x) for x in lines])[0].to_pylist()
    drawn, sets = ld.sketches(lines), [ld.shingles(x) for x in lines]
    of = dict(zip(keys, sets))
    assert len({*drawn.tolist()}) > len(lines) / 3
    for size in (2, 8, 9, 300):  # lines of a bucket, most of them there by chance
        rows = np.zeros(len(lines), ld._BAND)
        rows["bucket"], rows["k1"], rows["sketch"] = np.arange(len(lines)) // size, keys, drawn
        part = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows.tobytes()])], names=["part", "rows"])
        inside = [(i, j) for i in range(len(lines)) for j in range(i) if i // size == j // size]
        links = [(keys[i], keys[j]) for i, j in inside if ld.similar(sets[i], sets[j])]
        near = [p for b in ld._meet(iter([part]), ld.MOST_OFF) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
        roots = roots_of(keys, near)
        assert all(roots[a] == roots[b] for a, b in links) and len(links) > 50
        assert sum(not ld.similar(of[a], of[b], 0.5) for a, b in near) <= 0.05 * (len(inside) - len(links))


def test_runs_of_many_lines_are_those_of_each():
    draw = random.Random(18)
    lines = [prose(draw, n).replace("\n", " ") for n in (2, 9, 40)] + ["aaaaa", "ab " * 50, "née à Zürich"]
    for some in (lines, [*lines, "漢字かな交じり文" * 9], [*lines, "".join(map(chr, range(0x4E00, 0x5F00)))]):
        runs, sets = ld._runs(some), [ld.shingles(x) for x in some]
        assert [len(r) for r in runs] == [len(s) for s in sets]
        both = [len(np.intersect1d(a, b)) for a in runs for b in runs]
        assert both == [len(a & b) for a in sets for b in sets]
