import random
from collections import Counter, defaultdict

import pytest

from gridloom.llm import license_scan as ls
from gridloom.llm import mixing as mx
from gridloom.llm import url_filters as uf
from tests.llm.fixtures import documents, frame

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("block", "a.example.net", "/en/x"), ("allow", "example.com", ""), ("block", "example.com", "")]
URLS = [
    "http://example.net/en/1", "http://EXAMPLE.net/de/1?x=/en/", "https://a.example.net/en/xyz", "https://b.a.example.net/en/x/y#q",
    "ftp://foo.org/fr/", "foo.org/fr/", "http://foo.org", "http://net/", "http://net", "http://planet/", "http://example.com/de/",
    "http://example.com/de", "http://www.example.com?de/", "", None, "http://", "x://y://net/z", "http://example.net:80/en/", "http://é.NET/É/",
]


def straight_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [
        (len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filter(spark, limit):
    rows = [(i, u) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "2 AS id")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = uf.filter_urls(pages, rules, max_broadcast_bytes=limit).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: straight_verdict(u, RULES) for i, u in rows}
    assert uf.filter_urls(pages.limit(0), rules, max_broadcast_bytes=limit).count() == 0
    none = uf.filter_urls(pages, rules.limit(0), max_broadcast_bytes=limit).collect()
    assert len(none) == len(rows) and {r["verdict"] for r in none} == {"allow"}


def test_trie_against_all_rules():
    draw = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "b", "xa"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/x/yz/"]
    for _ in range(300):
        rules = [(draw.choice(["allow", "block"]), draw.choice(hosts), draw.choice(paths)) for _ in range(6)]
        trie = uf.build_trie(rules)
        for host in hosts:
            for path in paths:
                found = uf.longest_rule(trie, host, path)
                want = straight_verdict(f"http://{host}{path}", rules)
                assert (found[3] if found else None, found[2] if found else "allow") == want[2:]


def straight_targets(sizes):
    keys = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1 for i, k in enumerate(keys)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        open_ = [k for k in keys if k not in full]
        target = {k: 3.0 * sizes[k] for k in full} | {k: left * weight[k] / sum(weight[o] for o in open_) for k in open_}
        over = {k for k in open_ if target[k] > 3 * sizes[k]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("clash", [False, True])
def test_mix(spark, monkeypatch, clash):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 17)
    monkeypatch.setattr(mx, "CHUNK_SLOTS", 50)
    rows = documents(9, 200)
    docs = frame(spark, rows, clash)
    size = lambda t: len((t or "").replace("\x0b", " ").split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = straight_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    got = mx.mix_counts(docs, block_words=16).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    taken = Counter()
    for r in got:
        key = source[r["doc_id"]]
        taken[key] += r["taken"]
        assert r["source_size"] == sizes[key] and r["target"] == pytest.approx(target[key])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for k in sizes:
        assert abs(taken[k] - target[k]) <= 32, k
    again = mx.mix_counts(docs.repartition(3), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))

    mixed = mx.mix_documents(docs, block_words=16)
    assert mixed.schema.names == docs.schema.names
    out = mixed.collect()
    words = Counter()
    by_doc = defaultdict(int)
    original = {r[0]: r[1] for r in rows}
    for r in out:
        words[r["source"]] += size(r["text"])
        by_doc[r["doc_id"]] += size(r["text"])
        if r["text"] != original[r["doc_id"]]:
            assert r["text"] in " ".join(original[r["doc_id"]].split()) and r["n_chars"] == len(r["text"])
    assert words == +taken
    want = defaultdict(int)
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in by_doc.items() if v} == {k: v for k, v in want.items() if v}


def test_shards_hold_multinomial_counts_near_the_shares(spark, monkeypatch):
    """Counts per shard vary like draws, follow the sources' shares, and steer which blocks a shard gets."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mx, "SHARD_SLOTS", 1000)
    plan = spark.createDataFrame([(1, 2000, 2, 500), (2, 9000, 0, 4500), (3, 50, 3, 0)], "source_rank long, blocks long, passes long, rest long")
    counts = [tuple(r) for r in mx.shard_counts(plan, 4).select("source_rank", "shard", "n").collect()]
    totals, shards = {1: 4500, 2: 4500, 3: 150}, 10
    assert {s for _, s, _ in counts} == set(range(shards))
    for source, total in totals.items():
        mine = [n for r, _, n in counts if r == source]
        assert sum(mine) == total
        assert all(abs(n - total / shards) < 5 * (total / shards) ** 0.5 for n in mine) and len(set(mine)) > 3
    listed = mx.slots(plan, 4)
    times = {(r["source_rank"], r["block"]): r["n"] for r in listed.groupBy("source_rank", "block").agg(F.count("*").alias("n")).collect()}
    assert sum(times.values()) == 9150 and all(times[3, b] == 3 for b in range(50)) and all(times[1, b] in (2, 3) for b in range(2000))
    assert sorted((r["source_rank"], r["shard"], r["n"]) for r in listed.groupBy("source_rank", "shard").agg(F.count("*").alias("n")).collect()) == sorted(counts)
    before = {(r["source_rank"], r["block"], r["pass"]): r["shard"] for r in listed.collect()}
    monkeypatch.setattr(mx, "shard_counts", lambda plan, parts: plan.select("source_rank", F.lit(0).cast("long").alias("shard"), (F.col("passes") * F.col("blocks") + F.col("rest")).alias("n"), F.lit(0).cast("long").alias("first")))
    assert {r["shard"] for r in mx.slots(plan, 4).collect()} == {0}
    assert len({before[1, b, 0] for b in range(2000)}) > 3


def test_permutation_is_a_bijection_without_a_pattern(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        seeds = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: mx.scrambled(r.cast("long") * 104729 + 12345))
        got = [r[0] for r in spark.range(n).select(mx.permuted(F.col("id"), F.lit(n).cast("long"), seeds)).collect()]
        assert sorted(got) == list(range(n))
    low = sum(x < 500 for x in got[:500])
    steps = Counter(b - a for a, b in zip(got, got[1:]))
    assert 200 < low < 300 and max(steps.values()) < 20


def test_mix_edges(spark):
    assert mx.mix_counts(frame(spark, [])).count() == 0 == mx.mix_documents(frame(spark, [])).count()
    blank = frame(spark, [(1, None, None, None, 0), (2, "", None, "a", 0)])
    assert [(r["size"], r["target"], r["taken"]) for r in mx.mix_counts(blank).collect()] == [(0, 0.0, 0)] * 2


def test_licenses(spark):
    rows = [
        (1, "code\nReleased under the MIT License.", "a/b/x"), (2, "nothing here", "a/b/c/y"), (3, "plain", "a/z"),
        (4, "Licensed under CC BY-NC 4.0.", "a/LICENSE"), (5, None, None), (6, "", "a/b/"), (7, "released the dogs", "q/r"),
        (8, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "a/b/LICENSE.txt"), (8, "other row", "a/b/other"),
    ] + [(100 + i, "the work is under way, this is the version of it", f"w/{i}") for i in range(50)]
    files = spark.createDataFrame(rows, "doc_id long, text string, path string").selectExpr("*", "'x' AS id", "'y' AS line", "1 AS term")
    got = {(r["doc_id"], r["path"]): r for r in ls.license_scan(files).collect()}
    assert len(got) == len(rows)
    own = {k[0]: r["own_license"] for k, r in got.items()}
    assert own[1] == "MIT" and own[4] == "CC-BY-NC-4.0" and own[8] == "Apache-2.0"
    assert all(own[i] is None for i in (2, 3, 5, 6, 7, 100, 149))
    final = {k[0]: (r["license"], r["inherited_from"]) for k, r in got.items()}
    assert final[1] == ("MIT", "a/b") and final[2] == ("Apache-2.0", "a/b") and final[3] == ("CC-BY-NC-4.0", "a")
    assert final[6] == ("Apache-2.0", "a/b") and final[5] == (None, None) and final[7] == (None, None)
    assert ls.license_scan(files.limit(0)).count() == 0


def test_license_verdicts_do_not_change_with_the_size_of_the_corpus(spark):
    from pyspark.sql import functions as F

    header = "Released under the MIT License, 2021 by Example Labs and others."
    got = []
    for n in (1_000, 100_000):
        share = F.col("id") % 100
        text = (
            F.when(share == 0, F.lit(header)).when(share < 60, F.lit("one of us and some others by the sea in 2021"))
            .when(share < 63, F.lit("a word of example labs")).otherwise(F.lit("plain words only"))
        )
        files = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a/b").alias("path"))
        found = ls.license_scan(files).groupBy("own_license").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
        got.append({r["own_license"]: (r["n"] / n, r["score"]) for r in found.collect()})
    assert got[0]["MIT"][0] == got[1]["MIT"][0] == 0.01
    assert abs(got[0]["MIT"][1] - got[1]["MIT"][1]) < 0.02


def test_wrapped_notices_and_licence_texts_are_found(spark):
    import textwrap

    full = {name: text for name, text in ls.TEMPLATES if len(text) > 900}
    cut = {name: "\n".join(textwrap.wrap(text, 72)) for name, text in full.items()}
    rows = [
        (1, "# Licensed under the Apache\n# License, Version\n# 2.0.\nimport os\nprint(os.sep)", "Apache-2.0"),
        (2, "We made it over many years and with many hands, and it is released under the MIT License. It has run since then on "
            "several large machines of the plant, as the others do.", "MIT"),
        (3, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may copy.", "GPL-3.0"),
        (4, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Everyone may copy.", "GPL-2.0"),
        (5, "MIT License\n\nCopyright (c) 2021 Example Labs\n\n" + cut["MIT"], "MIT"),
        (6, "Copyright (c) 2021, Example Labs\nAll rights reserved.\n\n" + cut["BSD-3-Clause"], "BSD-3-Clause"),
        (7, "Copyright (c) 2021, Example Labs\nAll rights reserved.\n\n" + cut["BSD-2-Clause"], "BSD-2-Clause"),
        (8, "/*\n * " + cut["BSD-3-Clause"].replace("\n", "\n * ") + "\n */\nint main() { return 0; }", "BSD-3-Clause"),
        (9, "the permission of the author was granted to use the software and to copy it", None),
    ] + [(100 + i, "the work of this year and the use of it in a form of the house is one of many", None) for i in range(60)]
    files = spark.createDataFrame([(i, t, "p") for i, t, _ in rows], "doc_id long, text string, path string")
    got = {r["doc_id"]: r["own_license"] for r in ls.license_scan(files, license_file=None).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: want for i, _, want in rows}


def straight_licenses(texts, least=ls.LEAST_COSINE):
    """Best (license, score) of each text by a loop over its lines and runs of words."""
    import math
    import re
    from collections import Counter

    def words(text):
        return re.findall(ls.TERM, "".join(c.lower() if c.isascii() else c for c in text))

    df = Counter(w for t in texts for w in set(words(t)))

    def vector(held):
        return {w: n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in Counter(held).items()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    templates, seeds = [], {}
    for name, text in ls.TEMPLATES:
        held = words(text)
        v = vector(held)
        templates.append((name, v, norm(v)))
        light, telling = 0.0, set()
        for _, w in sorted((math.log((len(texts) + 1) / (df[w] + 1)) + 1, w) for w in v):
            light += v[w] * v[w]
            if math.sqrt(light) >= (least - 1e-9) * norm(v):
                telling.add(w)
        step = len(held) // 8 if len(held) > 16 else 1
        for place, w in enumerate(held):
            if w in telling:
                seeds.setdefault(w, set()).add((place, step, len(held) + step - 1))
    known = set(seeds)
    out = []
    for text in texts:
        held = words(text)
        runs = {
            tuple(held[max(0, i - place) // step * step :][:size])
            for i, w in enumerate(held) for place, step, size in seeds.get(w, ())
        }
        runs |= {tuple(x) for x in map(words, text.split("\n")) if known & set(x)}
        best = (0.0, 0, None)
        for run in runs:
            v = vector(run)
            for number, (name, unit, length) in enumerate(templates):
                score = round(sum(x * unit.get(w, 0.0) for w, x in v.items()) / (norm(v) * length), 6)
                if score >= least:
                    best = max(best, (score, -number, name))
        out.append((best[2], best[0]))
    return out


def test_license_scores_equal_a_loop(spark):
    import random

    draw = random.Random(3)
    plain = "the of a work under version public code file see dogs year house released free software as is terms".split()
    texts = []
    for i in range(120):
        around = [" ".join(draw.choice(plain) for _ in range(draw.randint(0, 30))) for _ in range(2)]
        notice = draw.choice(ls.TEMPLATES[:19])[1] if i % 2 else ""
        cut = notice.split(" ")
        if i % 4 == 3 and len(cut) > 4:
            cut[draw.randrange(len(cut))] = draw.choice(plain)
        texts.append(draw.choice([" ", "\n"]).join([around[0], draw.choice([" ", "\n"]).join(cut), around[1]]))
    texts += ["", "Released under the MIT License. and", "one of the works released under the MIT License and others " * 60]
    files = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["own_license"], r["score"] or 0.0) for r in ls.license_scan(files).collect()}
    want = straight_licenses(texts)
    assert sum(name is not None for name, _ in want) > 40
    for i, (name, score) in enumerate(want):
        assert abs(got[i][1] - score) < 2e-6 and (got[i][0] == name), (texts[i][:200], got[i], want[i])
