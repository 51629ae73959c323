"""The pipeline, stage by stage, against straight loops over its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, documents, prose
from tests.llm.test_dedup import roots_of, straight_fingerprint
from tests.llm.test_sources import straight_targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    draw = random.Random(21)
    rows = documents(11, 150)
    rows += [(5000 + i, " ".join(w + "***" for w in prose(draw, 120).split()), "en", "s2", 0) for i in range(60)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    marks = [(r[0], int(r[0] < 5000), 0) for r in rows if r[0] is not None and r[1] and len(r[1]) > 100]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows into and out of each stage."""
    at, rows = folder
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, at).cache()
        out[name] = (docs, made)
        docs = made
    return {k: ([tuple(r) for r in a.collect()], a.columns, [tuple(r) for r in b.collect()], b.columns) for k, (a, b) in out.items()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    for name in list(stages)[:-1]:
        assert stages[name][1] == stages[name][3]


def test_quality_stage_drops_junk_and_changes_no_row(stages):
    before, _, after, _ = stages["quality_classifier"]
    assert not Counter(after) - Counter(before)
    kept = {r[0] for r in after}
    assert not any(i >= 5000 for i in kept if i is not None)
    good = [r for r in before if r[1] and len(r[1]) > 400 and r[0] is not None and r[0] < 1000]
    assert all(r[0] in kept for r in good)


def one_of_each(before, after, group_of):
    """Whether ``after`` has one row of each group of rows, one with the group's smallest id."""
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[group_of[i]].append(r)
    assert not Counter(after) - Counter(before)
    first = Counter(min((r[0] for r in rows if r[0] is not None), default=None) for rows in groups.values())
    assert Counter(r[0] for r in after) == first
    found = Counter(g for g, rows in groups.items() for r in set(rows) & set(after))
    assert found == Counter(list(groups))


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_stage(stages):
    before, _, after, _ = stages["exact_dedup"]
    one_of_each(before, after, [normal(r[1]) for r in before])


def test_simhash_stage(stages):
    before, _, after, _ = stages["simhash_dedup"]
    prints = {i: straight_fingerprint(r[1]) for i, r in enumerate(before)}
    roots = roots_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    one_of_each(before, after, [roots[i] for i in range(len(before))])


def test_rows_that_share_an_id_are_judged_one_by_one(spark, folder):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "x y"), (2, "a b"), (3, "z"), (None, "z"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], normal(r["text"])) for r in corpus_pipeline.keep_first_copies(spark, docs, folder[0]).collect()]
    assert Counter(got) == Counter([(1, "a b"), (2, "x y"), (3, "z"), (None, "q")])
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(7, words), (7, "other text altogether here"), (8, words), (8, words), (None, words)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_similar(spark, docs, folder[0]).collect()]
    assert Counter(got) == Counter([(7, words), (7, "other text altogether here")])


def test_mixing_stage(stages):
    before, columns, after, _ = stages["block_mixing"]
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += size(r[1])
    for r in after:
        taken[r[3]] += size(r[1])
    for source, target in straight_targets(sizes).items():
        assert abs(taken[source] - target) <= 128
    texts = defaultdict(set)
    for r in before:
        texts[r[0]].add(r[1])
    for r in after:
        assert r[1] in texts[r[0]] or any(r[1] in " ".join((t or "").split()) for t in texts[r[0]])


def test_packing_stage_and_whole_run(spark, folder, stages):
    before, _, after, columns = stages["hilbert_packing"]
    at = {c: i for i, c in enumerate(columns)}
    assert {r[at["doc_id"]] for r in after} == {r[0] for r in before}
    filled = Counter()
    for r in after:
        filled[r[at["sequence_id"]]] += r[at["length"]]
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    run = [tuple(r) for r in corpus_pipeline.run(spark, folder[0]).drop("sequence_id", "offset").collect()]
    assert sum(r[2] for r in run) == sum(r[at["length"]] for r in after)
    assert Counter(r[0] for r in run).keys() == Counter(r[at["doc_id"]] for r in after).keys()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
