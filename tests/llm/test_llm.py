"""The corpus operators against brute force, held-out accuracy and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, mixing, quality, substring_dedup
from larkspur.llm import queries as q
from larkspur.llm.common import fold

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, grp string, `__id` int"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None if t is None else len(t), 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [None, "", "   \n\t ", "one", "one", "two words", "Ünïcode ß É 漢字 words here", "a " * 3000, "line\nline\nline\nline", "12345 !!", "x" * 50_000]


@pytest.fixture(scope="module")
def texts():
    """Originals, exact copies, near copies at many distances, shared passages, a large family."""
    rng = random.Random(3)
    out = [" ".join(words(rng, rng.randrange(4, 200))) for _ in range(60)]
    passage = " ".join(words(rng, 70))
    base = words(rng, 150)
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    out += [" ".join(words(rng, 20)) + " " + passage + " " + " ".join(words(rng, 20)) for _ in range(20)]
    out += [out[0], out[0], out[1].upper()] + AWKWARD
    rng.shuffle(out)
    return out


def shingles(text, n):
    ascii_lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = ascii_lower.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(sets))] == want
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in range(len(sets)))


@pytest.mark.parametrize("depth", [2, 4])
def test_large_nodes_of_families_equal_brute_force(spark, monkeypatch, depth):
    """Every node is large, families hold chains, families within families and members just below the threshold; any depth ends right."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 2)
    monkeypatch.setattr(minhash_dedup, "MAX_DEPTH", depth)
    rng = random.Random(depth)
    own = []
    for _ in range(4):
        base = words(rng, 120, 10**6)
        for _ in range(40):
            copy = list(rng.choice([base, *own[-3:]])) if rng.random() < 0.8 else base[: rng.randrange(80, 120)]
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice([f"n{rng.randrange(10**6)}", "same"])
            own.append(copy)
    sets = [shingles(" ".join(t), 4) for t in own]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(spark, [" ".join(t) for t in own])).collect()}
    assert [got[i] for i in range(len(own))] == components(len(own), links)


def rows_of_joins(spark, run):
    """The result of run, and the most rows that one join made in it."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        every = store.executionsList()
        return {every.apply(i).executionId() for i in range(every.size())}

    before, result, most = executions(), run(), 0
    for at in executions() - before:
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return result, most


def test_family_in_parts_meets_at_rare_differences(spark):
    """Members of a family have one part or the other or both, and words of their own: no member is near to most, and many
    share all that a whole part brings. They meet few times, and what is linked is found."""
    rng = random.Random(11)
    parts, own = (words(rng, 100, 10**6), words(rng, 60, 10**6)), []
    for _ in range(400):
        copy = [w for part in rng.choice([parts[:1], parts, parts]) for w in part]
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        own.append(copy)
    sets = [shingles(" ".join(t), 4) for t in own]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got, most = rows_of_joins(spark, lambda: minhash_dedup.near_duplicates(docs_of(spark, [" ".join(t) for t in own])).collect())
    assert [r.component_id for r in sorted(got)] == components(len(own), links)
    assert most < 40_000, most


def shuffles(spark, run):
    """The result of run, and how many shuffles its executions have."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        every = store.executionsList()
        return {every.apply(i).executionId() for i in range(every.size())}

    before, result, n = executions(), run(), 0
    for at in executions() - before:
        nodes = store.planGraph(at).allNodes()
        n += sum(nodes.apply(i).name() == "Exchange" for i in range(nodes.size()))
    return result, n


def test_large_nodes_of_all_levels_share_their_shuffles(spark, monkeypatch):
    """A level whose large nodes are few doesn't shuffle their members to meet them, and dense nodes of all levels are taken together."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 2)
    rng = random.Random(7)
    own = []
    for family in range(6):
        base = words(rng, 100, 10**6)
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(0, 4 + 4 * family)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            own.append(copy)
    sets = [shingles(" ".join(t), 4) for t in own]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got, n = shuffles(spark, lambda: minhash_dedup.near_duplicates(docs_of(spark, [" ".join(t) for t in own])).collect())
    assert [r.component_id for r in sorted(got)] == components(len(own), links)
    assert n < 75, n


def test_documents_that_share_a_doc_id(spark):
    rng = random.Random(2)
    one, two, near = (words(rng, 60) for _ in range(3))
    rows = [(1, " ".join(one))] * 3 + [(1, " ".join(two)), (2, " ".join(one)), (3, " ".join([*two, "more"])), (None, " ".join(one)), (4, " ".join(near))]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 57, 0), (1, 57, 1), (1, 57, 1), (1, 57, 1), (1, 57, 1), (2, 57, 1), (3, 58, 1), (4, 57, 4)]


def removed(texts, window):
    w = [(t or "").encode().split() for t in texts]
    first = {}
    for i, own in enumerate(w):
        for k in range(len(own) - window + 1):
            first.setdefault(tuple(own[k : k + window]), i)
    out = []
    for i, own in enumerate(w):
        keep = [True] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out.append((len(own), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(own, keep, strict=True) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10**9, 0])
def test_substring_dedup_equals_brute_force(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 50)


def test_repeated_words_under_hot_minimisers(spark, monkeypatch):
    """Windows of a period overlap and are one row each."""
    monkeypatch.setattr(substring_dedup, "HOT", 0)
    rng = random.Random(12)
    passage = " ".join(words(rng, 60))
    own = ["a b " * 200, "x y " + "a b " * 90, f"{passage} " + " ".join(words(rng, 70)) + f" {passage}", f"{passage} {passage} end"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, own)).collect()}
    assert [got[i] for i in range(len(own))] == removed(own, 50)


def test_windows_around_a_common_line_do_not_meet():
    """A line with different words around it: under its minimisers only equal windows share a key."""
    rng = random.Random(6)
    line = words(rng, 30, 10**6)
    texts = [" ".join(words(rng, 40, 10**6) + line + words(rng, 40, 10**6)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    light = next(iter(substring_dedup._light(50, 20)([batch]))).column(0).to_pylist()
    hot = [m for m in set(light) if light.count(m) > 20]
    assert hot
    asked = pa.RecordBatch.from_arrays([*batch.columns, pa.array([[]] * 40, pa.list_(pa.int64())), pa.array([hot] * 40, pa.list_(pa.int64()))], names=["doc_id", "text", "cold", "hot"])
    met: dict = {}
    for out in substring_dedup._pack(50, 20)([asked]):
        for r in out.to_pylist():
            met.setdefault((r["key"], r.get("d1"), r.get("d2")), set()).add(r["packed"])
    assert met and max(map(len, met.values())) == 1


def test_decontamination_equals_brute_force(spark, texts, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 13, 14, 5, 1, 2])] + [(6, None), (7, "!!"), (None, "w1 w2"), (8, "漢字 words")]
    mixed = [t if t is None or rng.random() < 0.6 else f"{t} {rng.choice(items)[1] or ''} END" for t in texts]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def split(t):
        return [x for x in __import__("re").split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}).encode()) if x]

    for chars in (8_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs_of(spark, mixed), bench).collect()}
        for i, t in enumerate(mixed):
            w, hit, found = split(t), set(), set()
            for item, text in items:
                p = split(text)
                n = min(13, len(p))
                for k in range(len(p) - n + 1) if n and item is not None else ():
                    for j in range(len(w) - n + 1):
                        if w[j : j + n] == p[k : k + n]:
                            hit.update(range(j, j + n))
                            found.add(str(item))
            assert got[i] == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), i


@pytest.mark.parametrize("chars", [8_000_000, 150])
def test_decontamination_keeps_rows(spark, monkeypatch, chars):
    """Repeated and null doc_ids at any benchmark size, one item longer than a block."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    long = words(rng, 120, 10**6)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(words(rng, 20, 10**6)))], "item_id bigint, text string")
    clean = [" ".join(words(rng, 30)) for _ in range(2)]
    # A passage of the long item at each place, so that some lie across the cuts.
    hits = [" ".join(long[k : k + 13]) for k in range(108)]
    rows = [(None, clean[0]), (None, clean[0]), (None, " ".join(long[50:80])), (5, clean[0]), (5, clean[0]), (5, " ".join(long[:30])), *((6, t) for t in hits)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()]
    no, yes = (30, 0, (), False), (30, 30, ("1",), True)
    want = [(None, *no)] * 2 + [(None, *yes)] + [(5, *no)] * 2 + [(5, *yes)] + [(6, 13, 13, ("1",), True)] * 108
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_of_the_benchmark_are_bounded():
    rows = [type("Row", (), {"item_id": str(i), "text": "x" * n})() for i, n in enumerate([40, 70, 20, 90, 5])]
    assert [[len(t) for _, t in b] for b in decontaminate._blocks(rows, 100)] == [[40], [70, 20], [90, 5]]


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    v = [base[i % 6] + rng.standard_normal(16) * rng.choice([0.01, 0.08, 0.3]) for i in range(120)]
    rows = [(i, [float(x) for x in e], i % 2) for i, e in enumerate(v)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [1.0, None], 0), (207, [], 0), (208, [float("inf")] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    ok = [r for r in rows if r[0] < 202]
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and np.dot(a[1], b[1]) / np.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.98]
    root = components(210, links)
    for r in rows:
        assert (got[r[0]].n_links, got[r[0]].component_id) == (sum(r[0] in p for p in links), root[r[0]]), r[0]


def test_embedding_labels_of_text_and_more_bits(spark, monkeypatch):
    """Labels may be text; with more bits there are more tables, and links stay found; repeats and null ids."""
    monkeypatch.setattr(embedding_dedup, "BITS", 22)
    assert embedding_dedup.shape(100, 0.98)[0] > 24 and embedding_dedup.shape(1 << 30, 0.98)[1] == 26
    rng = np.random.default_rng(5)
    base = rng.standard_normal((5, 32))
    v = [[float(x) for x in base[i % 5] + rng.standard_normal(32) * 0.09] for i in range(100)]
    rows = [(i, e, "ab"[i % 2]) for i, e in enumerate(v)] + [(3, v[3], "b"), (None, v[3], "b"), (None, v[3], "b")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    links = [(a, b) for a, b in itertools.combinations(range(100), 2) if a % 2 == b % 2 and np.dot(v[a], v[b]) / np.sqrt(np.dot(v[a], v[a]) * np.dot(v[b], v[b])) >= 0.98]
    assert links and {r.vec_id: r.component_id for r in got if r.vec_id is not None} == dict(enumerate(components(100, links)))
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(d, language_id.fit(d, fold("doc_id", 4) != 2)).withColumn("held", language_id.held_out()).join(d.select("doc_id", "lang"), "doc_id").where("held").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_rare_language_is_learned(spark):
    """A language with few of many documents is drawn and held back by itself, whatever the bound."""
    rng = random.Random(8)
    kinds = {"aa": "abcdef", "bb": "ghijkl", "rr": "mnopqr"}
    lang = ["rr" if i % 100 == 7 else "aa" if i % 2 else "bb" for i in range(3000)]
    rows = [(i, " ".join("".join(rng.choices(kinds[v], k=5)) for _ in range(12)), v) for i, v in enumerate(lang)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, F.lit(True), max_fit_rows=40)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert model["langs"] == ["aa", "bb", "rr"]
    assert [got[i] for i, v in enumerate(lang) if v == "rr"] == ["rr"] * 30
    # Few rows at the places of the held-back fifth are trained on all the same.
    x = [(np.array([v]), np.ones(1)) for v in (0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]
    w, _ = language_id.train(x, np.array([0, 0, 0, 0, 1, 0, 0, 0, 0, 1]), 2)
    assert w[1, 1] > 0


def test_language_without_letters(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(d, fold("doc_id", 4) != 2)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs_of(spark, AWKWARD), model).collect()}
    assert {i for i, v in got.items() if v == "und"} == {0, 1, 2, 9}
    empty = docs_of(spark, []).where("false")
    assert language_id.fit(empty, F.lit(True)) is None
    assert language_id.identify(docs_of(spark, ["abc"]), None).first().lang_pred == "und"


def test_quality_held_out_accuracy(spark):
    out = q.op1_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9
    assert out.score.between(0, 1).all()


def test_quality_of_awkward_texts(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(d, lab, fold("doc_id", 5) != 0)
    assert quality.score(docs_of(spark, AWKWARD), model).where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.fit(d, lab.where("false"), F.lit(True)) is None


def test_line_dedup_removes_later_chunks_only(spark):
    rng = random.Random(5)
    shared = [f"shared line {i} of words" for i in range(12)]
    texts = ["\n".join([*(f"own {d} {k} {rng.random()}" for k in range(6)), *shared, *(f"tail {d} {k} {rng.random()}" for k in range(6))]) for d in range(8)] + AWKWARD + ["single repeated", "single repeated"]
    out = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(docs_of(spark, texts)).collect()}
    assert list(line_dedup.remove_repeated_chunks(docs_of(spark, texts)).columns) == docs_of(spark, texts).columns
    seen = set()
    for i, t in enumerate(texts):
        kept = []
        for a, n in line_dedup.chunks(t) if t else ():
            chunk = tuple(t.split("\n")[a : a + n])
            if n == 1 or chunk not in seen:
                kept += chunk
            if n > 1:
                seen.add(chunk)
        assert out[i].text == (t if t is None or t == "" else "\n".join(kept)), i
    assert sum(len(out[i].text) < len(texts[i]) for i in range(1, 8)) == 7


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    """Each is judged by its own text; rows that are equal share their fate."""
    one = "\n".join(f"line {k}" for k in range(12))
    docs = spark.createDataFrame([(1, one), (1, one), (1, "zz\nyy\nxx"), (2, one), (None, one)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.remove_repeated_chunks(docs).collect())
    left = "\n".join(x for a, n in line_dedup.chunks(one) if n == 1 for x in one.split("\n")[a : a + n])
    assert got == sorted([(0, one), (1, one), (1, one), (1, "zz\nyy\nxx"), (2, left)])


def test_mixing_keeps_budgets(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(500)] + [t for t in AWKWARD if len(t or "") < 1000]
    d = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "src0").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    out = mixing.mix(d, 0.5, 2, weights={"source": {"src1": 5.0, "src2": 0.0}}).toPandas()
    total = sum(len((t or "").split()) for t in texts)
    assert (out.n_tokens * out.copies).sum() <= total / 2
    assert (out.n_tokens * out.copies).sum() > 0.45 * total
    assert not (out.source == "src2").any() and out.copies.max() <= 2
    assert set(d.columns) < set(out.columns)


def test_mixing_of_repeats_and_null_ids(spark):
    """Rows that share a doc_id are picked one by one; rows without one have no budget."""
    row = "ten tokens " * 5
    repeats = spark.createDataFrame([(7, row, "en", "src1")] * 50 + [(100 + i, row, "en", "src1") for i in range(50)], "doc_id bigint, text string, lang string, source string")
    out = mixing.mix(repeats, 0.5, 1).collect()
    assert sum(r.n_tokens * r.copies for r in out) == 500
    some = spark.createDataFrame([(None if i % 2 else i, row, "en", "src1") for i in range(200)], "doc_id bigint, text string, lang string, source string")
    out = mixing.mix(some, 0.5, 1).collect()
    assert sum(r.n_tokens * r.copies for r in out) == 500 and all(r.doc_id is not None for r in out)


def test_water_filling(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 1, 10), ("a", "en", "y", 1, 100), ("a", "de", "x", 1, 5), ("b", "en", "x", 1, 1000)], "domain string, lang string, source string, docs bigint, tokens bigint")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, 200, 1, {}).collect()}
    # a and b get 100 each; in a, de can take 5, so en gets 95; there x takes 10 and y the rest.
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 85, ("a", "de", "x"): 5, ("b", "en", "x"): 100}
    short = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, 800, 1, {}).collect()}
    assert short == {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "de", "x"): 5, ("b", "en", "x"): 685}


PAGE = """<html><head><title>T</title><script>var x="</p><p>no";</script></head><body><nav><ul><li><a href=/a>Menu</a></li><li>More</li></ul></nav>
<div class="cookie-notice">We use cookies and many words to say so, again and again and again.</div>
<article><h1>Head &amp; line</h1><p>First   paragraph<br>goes on.<p>Second <b>bold</b> &lt;tag&gt; with several words in it.
<aside>Not this.</aside><form><label>Mail</label><input></form><p>Third one ends here.</p></article>
<section id="comments"><p>A reader says a lot of things that are not part of the article.</p></section><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html_extract.extract(PAGE, weights) == "Head & line\n\nFirst paragraph goes on.\n\nSecond bold <tag> with several words in it.\n\nThird one ends here."
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain words only"), (None, "u", PAGE)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_text(pages, weights).collect()}
    assert got[1] == got[2] == got[3] == ("", 0) and got[4] == ("plain words only", 16)


TEXT = "The text has a good many words in every one of its paragraphs, and it goes on."
LINKS = "".join(f"<a href=/{w}>{w} of the site</a> " for w in ("news", "sport", "weather", "letters", "archive", "culture"))
#: Pages and their main texts: what the scan decides, what names decide, broken markup.
PAGES = {
    "links around, nothing marked": (f"<body><div>{LINKS}</div><div><p>{TEXT}</p><p>{TEXT}</p></div><div>{LINKS}</div></body>", f"{TEXT}\n\n{TEXT}"),
    "a link ends the text": (f"<body><div>{LINKS}</div><div><p>{TEXT}</p><p>{TEXT} <a href=x>More here</a></p></div><ul><li>{LINKS}</ul></body>", f"{TEXT}\n\n{TEXT} More here"),
    "text after the article": (f"<body><article><h1>Head</h1><p>{TEXT}</p></article><div><p>{TEXT}</p></div></body>", f"Head\n\n{TEXT}"),
    "header of the article": (f'<article><div class="article-header"><h1>Head</h1></div><p>{TEXT}</p></article>', f"Head\n\n{TEXT}"),
    "header without an article": (f'<body><div class="site-header">Site</div><div class="post-header"><h1>Head</h1></div><p>{TEXT}</p></body>', f"Head\n\n{TEXT}"),
    "a name that begins like one of boilerplate": (f'<article><p class="notice-period">{TEXT}</p><div class="cookie-notice">Cookies</div><div class="comment-list"><p>{TEXT}</p></div></article>', TEXT),
    "an unclosed quote": (f'<article><p>{TEXT}</p><p><a title="foo>bar</a> {TEXT}</p></article>', f"{TEXT}\n\nbar {TEXT}"),
    "notices inside": (f"<main><p>{TEXT}</p><aside>{TEXT * 9}</aside><form>{TEXT * 9}</form><p>Short end.</p></main>", f"{TEXT}\n\nShort end."),
    "a table inside": ("<article><p>Values:</p><table><tr><td>1<td>2<tr><td>3<td>4</table></article>", "Values:\n\n1\n\n2\n\n3\n\n4"),
    "hidden": (f'<article><p hidden>no</p><p style="display: none">no</p><p>{TEXT}</p></article>', TEXT),
}


def test_html_pages(spark):
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert {k: html_extract.extract(page, weights) for k, (page, _) in PAGES.items()} == {k: text for k, (_, text) in PAGES.items()}


def test_html_text_depends_on_the_scan(spark, monkeypatch):
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    monkeypatch.setattr(html_extract, "best_run", lambda values: (0, len(values)))
    same = {k for k, (page, text) in PAGES.items() if html_extract.extract(page, weights) == text}
    assert not same & {"links around, nothing marked", "a link ends the text", "text after the article"}


def test_html_of_given_pages_is_the_article(spark):
    """The given pages hold their text in an article element without boilerplate in it."""
    for r in html_extract.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.text.split() == html_extract.html.unescape(__import__("re").sub("<(/?)(?=[a-z/])[^>]*>", lambda m: " ", inner)).split()


def test_html_of_deep_and_long_pages():
    """Unclosed elements, one in the other; time and memory are in proportion."""
    import time

    for page in ("<div><b>" * 1_200_000 + TEXT, '<a title="' * 300_000, "<p>" + "word " * 2_000_000):
        began = time.time()
        html_extract.extract(page, {})
        assert time.time() - began < 60


def test_html_scan_finds_the_best_run():
    rng = random.Random(4)
    for _ in range(200):
        values = [float(rng.randrange(1, 5)) if rng.random() < 0.5 else -2.5 for _ in range(12)]
        a, b = html_extract.best_run(values)
        assert sum(values[a:b]) == max([0, *(sum(values[i:j]) for i in range(13) for j in range(i, 13))])


def cheapest(roles):
    """The least cost of a repair, by the rules written out: system? (user assistant)*, merge 1, relabel 2, insert 3."""
    after = {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
    spelled = {"system": "system", "user": "user", "assistant": "assistant", "human": "user", "gpt": "assistant"}
    costs = {"": 0}
    for role in roles:
        now = {}
        for state, cost in costs.items():
            for to in ("system", "user", "assistant"):
                base = cost + (0 if to == spelled.get(role) else 2)
                ways = [base + 1] if to == state else []
                ways += [base] if to in after[state] else []
                ways += [base + 3 for between in after[state] if to in after[between]]
                if ways:
                    now[to] = min([*ways, now.get(to, 10**9)])
        costs = now
    return min(c + {"": 0, "assistant": 0, "user": 3, "system": 6}[state] for state, c in costs.items())


def test_chat_repair_is_legal_and_cheapest(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "STRETCH", 4)
    rng = random.Random(6)
    rows, roles = [], {}
    for c in range(30):
        roles[c] = [rng.choice(["user", "assistant", "system", "human", "gpt", "tool", None]) for _ in range(rng.randrange(1, 15))]
        rows += [(c, t, r, None if rng.random() < 0.1 else f"text {t}") for t, r in enumerate(roles[c])]
    rows += [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "gpt", "ho"), (99, None, "user", "hi"), (99, None, "user", "hi")]
    rows += [(98, 5, "assistant" if k % 2 else "user", f"{k}") for k in range(30)]
    given = chat_format.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seg int")).collect()
    out = {r.conv_id: r for r in given if r.conv_id is not None}
    alone = sorted((r.n_in, r.cost, r.rendered) for r in given if r.conv_id is None)
    # A lone user turn gets an answer; a lone answer is cheaper as a user's turn that gets one, or after an inserted one.
    assert [(n, c, r.count("hi")) for n, c, r in alone if "hi" in r] == [(1, 3, 1)] * 2 and [(n, c) for n, c, r in alone if "ho" in r] == [(1, cheapest(["gpt"]))]
    assert out[98].n_in == 30 and out[98].cost == cheapest(["assistant"] * 15 + ["user"] * 15)
    for c, own in roles.items():
        r = out[c]
        assert r.cost == cheapest(own) == r.n_merged + 2 * r.n_relabelled + 3 * r.n_inserted
        names = [x.split("|>")[0] for x in r.rendered.split("<|")[1:] if not x.startswith("end")]
        body = names[1:] if names[0] == "system" else names
        assert body == ["user", "assistant"] * (len(body) // 2) and len(names) == r.n_out and r.rendered.count("<|end|>") == r.n_out
    assert out[99].n_in == 2 and out[99].cost == 2


def test_intermediates_are_deleted(spark, tmp_path):
    import os

    from larkspur.llm import common

    since = common.mark()
    at = [common.written(spark.range(3)).inputFiles()[0].removeprefix("file:") for _ in range(2)]
    assert all(map(os.path.exists, at))
    common.release(since)
    assert not any(map(os.path.exists, at)) and common.mark() == since
    with pytest.raises(ValueError, match="share"):
        conf = type("Conf", (), {"get": lambda self, key, default: default})()
        common.scratch_dir(type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": "spark://host"})()})())


def test_empty_tables(spark):
    d = docs_of(spark, []).where("false")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert minhash_dedup.near_duplicates(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert decontaminate.contamination(d, bench).count() == 0
    assert decontaminate.contamination(docs_of(spark, ["a b"]), bench).first().n_hit == 0
    assert line_dedup.remove_repeated_chunks(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0
    assert html_extract.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_pipeline_stages_take_awkward_documents(spark, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d = d.withColumns({"node": F.lit(1), "__copies": F.lit("x"), "gone": F.lit(None).cast("string")})
    extra = docs_of(spark, AWKWARD, [10_000 + i for i in range(len(AWKWARD))]).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars", "node", F.lit("y").alias("__copies"), F.lit(None).cast("string").alias("gone"))
    now = d.unionByName(extra).unionByName(d.limit(5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == d.columns
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, now, SF).count() <= now.count()


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cur = con.execute(q.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).toLocalIterator())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, r, strict=True))})" for r in cur.fetchall())
