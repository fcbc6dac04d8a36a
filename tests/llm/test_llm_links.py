"""Operators on links against brute force: components, shingle join, spans, vectors."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from engagement.llm import shingle_join, span_dedup, vector_forest
from engagement.llm.graph import components
from engagement.llm.shingle_join import distinct_documents, search, similar_documents
from engagement.llm.span_dedup import dedup_spans
from engagement.llm.vector_forest import near_vectors

DOCS = "doc_id long, text string, n int, h string, component string"


def docs_of(spark, texts, ids=None):
    """With columns that have names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in zip(ids, texts)], DOCS)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def parts_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def corpus(seed, rows):
    """Copies, near copies, a line and a passage that many share, and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "ß.", "THE", "the", "of", "of", "of"]
    line, passage = "Licensed under the same Licence as ever", " ".join(r.choices(vocabulary, k=30))
    texts = []
    for _ in range(rows):
        kind = r.random()
        if texts and kind < 0.45:
            words = (r.choice(texts[: rows // 6]) or "x").split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 19, 20, 21, 60, 120])))
        if kind > 0.7:
            text = f"{line}\n{text}\t{passage if kind > 0.85 else ''}"
        texts.append(text)
    return texts + [None, "", " \n", "a " * 50, "a " * 50, texts[0], texts[0].upper()]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == parts_of({n for link in real for n in link}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar(texts, ids, k, percent):
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    sets = []
    for words in map(words_of, lowered):
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    links = [
        (ids[a], ids[b])
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return [len(s) for s in sets], parts_of(ids, links)


@pytest.mark.parametrize("k, percent, short, block", [(3, 90, 32, 1 << 20), (5, 80, 2, 400)])
def test_shingle_join(spark, monkeypatch, k, percent, short, block):
    # Small limits take the ways of hot lists and of groups larger than a block.
    monkeypatch.setattr(shingle_join, "SHORT", short)
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", block)
    texts = corpus(k, 160)
    found = similar_documents(docs_of(spark, texts), k, percent, counters=1 << 12).collect()
    sizes, parts = similar(texts, list(range(len(texts))), k, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == {
        i: (sizes[i], parts[i]) for i in range(len(texts))
    }
    assert len(set(parts.values())) < len(parts) - 10


def test_shingle_join_odd_rows(spark):
    ids = [4, 4, None, None, 9, 2, 2]
    texts = ["a b c d", "e f g h", "a b c d", None, "e f g h", "x", "x"]
    found = similar_documents(docs_of(spark, texts, ids), 3, 90).collect()
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in found)
    assert got == sorted([("4", 2, "4"), ("4", 2, "4"), ("None", 2, "None"), ("None", 0, "None"), ("9", 2, "4"), ("2", 1, "2"), ("2", 1, "2")])
    assert similar_documents(docs_of(spark, []), 3, 90).count() == 0


def measured(monkeypatch, name, target):
    """Column names and row counts of what goes through a method or function from now on."""
    seen, old = [], getattr(target, name)

    def method(df, *args):
        out = old(df, *args)
        seen.append((df.columns, df.count()))
        return out

    monkeypatch.setattr(target, name, method)
    return seen


def test_shingle_join_of_a_large_group(spark, monkeypatch):
    # 100 near copies fill some 14 blocks; each went to all of them.
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 400)
    words = [f"w{i}" for i in range(62)]
    texts = [" ".join([*words[: i % 60], f"x{i}", *words[i % 60 + 1 :]]) for i in range(100)]
    docs = docs_of(spark, texts)
    turns = measured(monkeypatch, "repartition", type(docs))
    found = similar_documents(docs, 3, 80, counters=1 << 12).collect()
    assert {x["component_id"] for x in found} == {0}
    assert sum(n for columns, n in turns if "doc_id" in columns) <= 3 * len(texts)


def test_shingle_join_posts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SLICE_ROWS", 50, raising=False)
    texts = corpus(9, 40)
    sizes, parts = similar(texts * 12, list(range(12 * len(texts))), 3, 90)
    docs = docs_of(spark, texts * 12)
    tables = measured(monkeypatch, "stored", shingle_join)
    found = similar_documents(docs, 3, 90, counters=1 << 12).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == {i: (sizes[i], parts[i]) for i in parts}
    posted = [n for columns, n in tables if columns == ["h", "doc_id", "n"]]
    assert len(posted) == 1 and posted[0] <= sum(sizes) // 12


def test_distinct_documents_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 400)
    words = [f"w{i}" for i in range(62)]
    texts = [" ".join([*words[: i % 60], f"x{i}", *words[i % 60 + 1 :]]) for i in range(100)] + ["else", None]
    docs = docs_of(spark, texts)
    turns = measured(monkeypatch, "repartition", type(docs))
    kept = distinct_documents(docs, 3, 80).collect()
    assert sorted(x["doc_id"] for x in kept) == [0, 100, 101]
    assert sum(n for columns, n in turns if "doc_id" in columns) <= 3 * len(texts)


def test_sketch():
    r = np.random.default_rng(5)
    cells = np.sort(np.concatenate((r.integers(0, 1 << 12, 300), np.full(50, 700), [0, 0, 4095])))
    counts = np.zeros(1 << 12, dtype=np.int64)
    for block, gaps in shingle_join._gaps(cells, 1 << 10):
        counts[block << 10 : (block + 1) << 10] += shingle_join._count_gaps(gaps, 1 << 10)
    assert (counts == np.bincount(cells, minlength=1 << 12)).all()
    for mean in (0, 0.3, 7, 400):
        levels = shingle_join._levels(np.arange(100_000), mean)
        assert (np.diff(levels.astype(int)) >= 0).all() and set(levels) <= set(range(16)) and levels[-1] == 15
    # One shingle of 40 documents still stands out among 90 others on the same counter.
    rare, common = shingle_join._levels(np.array([90, 130]), 90)
    assert rare < common


def test_search_probes_long_lists():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((r.choice(base, 190, replace=False), r.integers(0, 1 << 60, r.integers(0, 25), dtype=np.uint64)))) for _ in range(60)]
    every = np.ones(len(sets), dtype=bool)
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))]
    assert links and parts_of(range(60), list(search(sets, every, every, 90))) == parts_of(range(60), links)


def removed(rows, window):
    """Expected (n_words, n_removed, digest) by position of the row."""
    seen, out = {}, {}
    for n, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        words, gone = words_of(text), set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.setdefault(key, n)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[n] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window, k", [(20, 6), (7, 7), (5, 1)])
def test_spans(spark, window, k):
    texts = corpus(window, 120) + ["b c " * 400]
    found = dedup_spans(docs_of(spark, texts), window, k, keep=("h",)).collect()
    expected = removed(list(enumerate(texts)), window)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found} == expected
    assert {hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"] for x in found} == {True}
    assert {x["h"] for x in found} == {"x"}


def test_paths_are_compacted(spark):
    """A chain of 100 nodes, a fork, a node that ends a text, and single nodes."""
    kind = "id long, h long, around long, n long, next struct<h: long, around: long>, before struct<h: long, around: long>, step int"
    node = lambda i: (i, -i)
    chain = [(i, *node(i), 2, node(i + 1) if i < 100 else None, node(i - 1) if i > 1 else None, 3) for i in range(1, 101)]
    # 200 goes to 201 only, but 201 has another one before it; 203 is met from 202 only.
    fork = [(200, *node(200), 2, node(201), None, 1), (201, *node(201), 4, node(202), None, 1), (202, *node(202), 4, node(203), node(201), 5), (203, *node(203), 4, None, node(202), 2)]
    single = [(300, *node(300), 1, node(301), None, 1), (301, *node(301), 1, None, node(300), 1)]
    found = span_dedup.compact_paths(spark.createDataFrame(chain + fork + single, kind))
    got = {r["id"]: (r["head"], r["words"]) for r in found.collect()}
    expected = {i: (1, 3 * (i - 1)) for i in range(1, 101)} | {200: (200, 0), 201: (201, 0), 202: (201, 1), 203: (201, 6), 300: (300, 0), 301: (301, 0)}
    assert got == expected
    assert span_dedup.compact_paths(spark.createDataFrame([], kind)).count() == 0


def test_shared_passages_become_few_spans(spark):
    r = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in r.integers(0, 10**6, 700))
    texts = [" ".join(f"w{i}" for i in r.integers(0, 10**6, 60)) + f" {passage} " + "end " * (i % 4) for i in range(12)]
    rows = docs_of(spark, texts).selectExpr("doc_id", "hash(text) as mark", "text")
    spans = span_dedup.repeated_windows(rows).collect()
    # Eleven later occurrences, each a path and the windows at its ends.
    long = [s for s in spans if s["last"] - s["first"] > 500]
    assert len(long) == 11
    found = dedup_spans(docs_of(spark, texts)).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found} == removed(list(enumerate(texts)), 20)


def test_spans_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(7, passage), (7, passage), (None, passage), (8, None), (9, ""), (10, f"x {passage} y")]
    found = dedup_spans(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    got = collections.Counter((x["doc_id"], x["n_words"], x["n_removed"]) for x in found)
    # A null doc_id is the smallest; equal rows of one doc_id are not earlier than each other.
    assert got == collections.Counter([(7, 25, 25), (7, 25, 25), (None, 25, 0), (8, 0, 0), (9, 0, 0), (10, 27, 25)])
    alone = dedup_spans(docs_of(spark, [passage, passage], [7, 7])).collect()
    assert [x["n_removed"] for x in alone] == [0, 0]
    assert dedup_spans(docs_of(spark, [])).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, node int")


@pytest.mark.parametrize("block_bytes", [8 << 20, 32 * 4 * 50])
def test_vectors_recall(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vector_forest, "BLOCK_BYTES", block_bytes)
    r = np.random.default_rng(5)
    base = r.standard_normal((500, 32))
    near = [base[i] + (e := r.standard_normal(32)) / np.linalg.norm(e) * np.linalg.norm(base[i]) * r.uniform(0.1, 0.4) for i in range(200)]
    center = r.standard_normal(32)
    dense = [center + r.standard_normal(32) * 0.1 for _ in range(200)]
    x = np.array([*base, *near, *dense, *base[:40], *(base[:5] * 2)], dtype=np.float32)
    found = near_vectors(vectors_of(spark, list(enumerate(x))), leaf_rows=64).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    got = {v["vec_id"]: v for v in found}
    counted = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (counted <= links.sum(1)).all() and counted.sum() >= 0.97 * links.sum()
    whole = near_vectors(vectors_of(spark, list(enumerate(x))), leaf_rows=10_000).collect()
    parts = parts_of(range(len(x)), np.argwhere(links).tolist())
    assert {v["vec_id"]: (v["n_links"], v["component_id"], v["kept"]) for v in whole} == {
        i: (links[i].sum(), parts[i], parts[i] == i) for i in range(len(x))
    }


def planted(n, dim, seed=8):
    """Random vectors, a third of them near copies of some others, and one dense cluster."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 2, dim))
    e = r.standard_normal((n // 3, dim))
    own = base[r.integers(0, len(base), n // 3)]
    near = own + e / np.linalg.norm(e, axis=1, keepdims=True) * np.linalg.norm(own, axis=1, keepdims=True) * r.uniform(0.05, 0.3, (n // 3, 1))
    center = r.standard_normal(dim)
    dense = center + r.standard_normal((n - len(base) - len(near), dim)) * 0.05
    return np.concatenate((base, near, dense)).astype(np.float32)


def test_leaves_of_a_larger_table_are_parted_again(spark, monkeypatch):
    """Trees from 500 of 12,000 vectors: recall of the ids divisible by 50 against all rows."""
    monkeypatch.setattr(vector_forest, "LARGE", 2)
    monkeypatch.setattr(vector_forest, "LEAF_SAMPLE", 400)
    sizes = []
    bounded = vector_forest._bounded_leaves

    def kept(*given):
        out = bounded(*given)
        sizes.extend(r["count"] for r in out.selectExpr("explode(leaves) as leaf").groupBy("leaf").count().collect())
        return out

    monkeypatch.setattr(vector_forest, "_bounded_leaves", kept)
    x = planted(12_000, 24)
    found = {v["vec_id"]: v for v in near_vectors(vectors_of(spark, list(enumerate(x.tolist()))), leaf_rows=64, sample=500).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    asked = np.arange(0, len(x), 50)
    links = (unit[asked] @ unit.T >= 0.95).sum(axis=1) - 1
    got = np.array([found[i]["n_links"] for i in asked])
    assert (got <= links).all() and got.sum() >= 0.97 * links.sum()
    alone = asked < 10_000
    assert got[alone].sum() >= 0.95 * links[alone].sum()
    # Only leaves around the dense cluster's 2000 vectors stay larger than wanted: no
    # projection parts them. Spill puts the cluster into several leaves of a tree.
    large = [n for n in sizes if n > 2 * 64]
    assert max(large) <= 2 * 2000 and len(large) <= 8 * 6 and len(sizes) > 8 * 60


@pytest.mark.parametrize("seed", range(3))
def test_blocks_count_each_link_once(seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((40, 4)).astype(np.float32)
    copies = r.integers(1, 4, 40)
    leaves = [sorted({int(z) for z in r.integers(0, 6, 3)} | {7}) for _ in range(40)]
    rows = [(i, -i, i, int(copies[i]), x[i].tobytes(), leaves[i]) for i in range(40)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.6
    total, links = np.zeros(40, dtype=int), []

    def block(rows):
        return vector_forest.Block.of(pa.table(dict(zip(("fa", "fb", "node", "copies", "vec", "leaves"), map(list, zip(*rows))))))

    for cuts in ((0, 40), (0, 13, 25, 40)):
        total[:], links = 0, []
        for leaf in range(8):
            blocks = [[r for r in rows[a:b] if leaf in r[5]] for a, b in zip(cuts, cuts[1:])]
            for i, one in enumerate(blocks):
                for j in range(i, len(blocks)):
                    if one and blocks[j]:
                        other = None if i == j else block(blocks[j])
                        for fa, _, n, a, b in vector_forest.compared(block(one), other, 4, leaf, 0.6):
                            total[fa] += n
                            links.append((a, b))
        assert total.tolist() == [sum(copies[j] for j in range(40) if j != i and near[i, j]) for i in range(40)]
        assert parts_of(range(40), links) == parts_of(range(40), np.argwhere(near).tolist())


def test_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, None), (4, []), (5, [0, 0]), (6, [None, 1]), (7, [nan, 1]), (None, [1, 0]), (8, [1, 0, 0]), (9, [-1, 0]), (10, [float("inf"), 0])]
    found = near_vectors(vectors_of(spark, rows)).collect()
    got = collections.Counter((v["vec_id"], v["n_links"], v["component_id"], v["kept"]) for v in found)
    single = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == collections.Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), *single])
    assert near_vectors(vectors_of(spark, [])).count() == 0
