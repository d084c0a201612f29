"""op4, op5 and op9 against all pairs, over whole small tables and on odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest

from fairground.llm import decontam, embed_dedup, near_dedup
from fairground.llm.common import shingle_hashes
from fairground.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_near(rows, found):
    sets = {i: shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and 100 * min(n, m) >= 75 * max(n, m) and 100 * (both := len(sets[a] & sets[b])) >= 75 * (n + m - both):
                links.append((a, b))
    want = components(ids, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    return links


def test_minhash_on_a_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_near(rows, {r.doc_id: r for r in QUERIES["op9_minhash_dedup"](spark, SF).collect()})


def test_minhash_on_odd_rows(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [None, "", " \n", "one two", "ONE\ttwo", "one two three", " ".join(base), " ".join(base[:38]), " ".join(base[2:]), "\x1c".join(base), " ".join(base * 300), " ".join(base * 300) + " x", "é É", "é é"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, n int, h1 int")
    check_near(dict(enumerate(rows)), {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    left = near_dedup.deduplicated(docs.union(docs).union(docs.selectExpr("CAST(NULL AS long)", "text", "n", "h1")))
    assert left.columns == docs.columns and left.where("doc_id IS NULL").count() == len(rows)
    assert {r.doc_id for r in left.collect()} - {None} == {i for i, r in ((r.doc_id, r) for r in near_dedup.near_duplicates(docs).collect()) if r.kept}
    assert left.where("doc_id IS NOT NULL").count() == len({r.doc_id for r in left.collect()}) - 1


def test_minhash_on_repeated_ids(spark):
    """One id with several texts, one of them null, joins their groups; each text is judged by itself."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 0), (1, None, 0), (2, b, 0), (2, a + " x", 0), (3, None, 0), (3, c, 0), (4, c + " y", 0), (5, "alone here", 0), (5, b + " z", 0), (None, a, 0), (6, "", 0), (6, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows int")
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {
        (1, 36): (1, True), (1, 0): (1, True), (2, 36): (1, False), (2, 37): (1, False), (3, 0): (3, True), (3, 36): (3, True),
        (4, 37): (3, False), (5, 1): (1, False), (5, 37): (1, False), (None, 36): (None, True), (6, 0): (6, True),
    }
    left = sorted((str(r.doc_id), r.text) for r in near_dedup.deduplicated(docs).collect() if r.text)
    assert left == sorted([("1", a), ("2", b), ("3", c), ("5", "alone here"), ("None", a)])


def test_hashes_of_words():
    """No two different word sequences of like structure share a hash: Thue-Morse words and complements,
    texts cut elsewhere, words in another order."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "ab c d e f", "a bc d e f", "a b c d e", "b a c d e", "a a a a a", "a a a a", "", None, " a\t b ", "a b"]
    shingles, words, bounds = shingle_hashes(pa.array(texts, pa.string()), 5)
    assert [len(x) for x in shingles] == [1] * 8 + [0, 0, 1, 1] and len({int(x[0]) for x in shingles[:8]}) == 8
    assert shingles[10] == shingles[11] and (np.diff(bounds) == [len((t or "").split()) for t in texts]).all()
    cut = shingle_hashes(pa.array(["x y", *texts], pa.string())[1:], 5)[0]
    assert all((a == b).all() for a, b in zip(shingles, cut, strict=True))


@pytest.mark.parametrize("limit", ["LEAF", "LEAF_SHINGLES"])
def test_recall_of_small_leaves(spark, monkeypatch, limit):
    """All links of the whole table, however few rows or shingles meet in a task."""
    monkeypatch.setattr(near_dedup, limit, 6 if limit == "LEAF" else 3000)
    test_minhash_on_a_whole_table(spark)


def test_large_nodes_branch(spark, monkeypatch):
    """Nodes over the size of a leaf give the same groups."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    common = [f"c{i}" for i in range(60)]
    rows = {i: " ".join(common[: 50 + i % 10] + [f"u{i}"]) for i in range(40)} | {100 + i: " ".join(f"z{i}.{j}" for j in range(30)) for i in range(10)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check_near(rows, {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()})


def test_single_links_in_deep_nodes(spark, monkeypatch):
    """A passage alone, and documents that share it: each has one link of 0.77, to the passage, in nodes
    of many times the size of a leaf."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    passage = [f"c{i}" for i in range(200)]
    rows = {0: " ".join(passage)} | {i: " ".join(passage + [f"u{i}.{j}" for j in range(57)]) for i in range(1, 161)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert len(check_near(rows, {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()})) == 160


def test_miss_bound():
    for depth in range(near_dedup.LEVELS + 1):
        assert near_dedup._missed(depth, near_dedup._replicas(depth, 0.75), 0.75) <= near_dedup.MISS


def check_vectors(rows, found):
    good = {i: np.array(v) for i, v in rows.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    ids = sorted(unit)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want, n = components(rows, links), dict.fromkeys(rows, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (n[i], want[i], want[i] == i) for i in rows}


def test_embeddings_on_a_whole_table(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_vectors(rows, {r.vec_id: r for r in QUERIES["op5_embedding_dedup"](spark, SF).collect()})


@pytest.mark.parametrize("cell", [8192, 16])
def test_embeddings_on_odd_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1e-300] * 16, [1e300] * 16, [1.0] * 16, [1.0] * 8, [2.0] * 8]
    rows += [(centre + 0.2 * rng.standard_normal(16)).tolist() for _ in range(80)] + [rng.standard_normal(16).tolist() for _ in range(60)] + [[3.0] * 16] * 5
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, rep int")
    check_vectors(dict(enumerate(rows)), {r.vec_id: r for r in embed_dedup.near_duplicates(table).collect()})
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_recall(spark, monkeypatch):
    """Over many cells: no wrong link, and all but one in a thousand of the right ones."""
    monkeypatch.setattr(embed_dedup, "CELL", 400)
    rng = np.random.default_rng(9)
    held = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    x = np.array([v for v in held if v and all(c is not None and np.isfinite(c) for c in v) and any(v)], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # a partner of each at a cosine just over the least
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.97, (len(x), 1))
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * noise])
    links = (x @ x.T >= 0.95).sum(1) - 1
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(table).collect()}
    got = np.array([found[i] for i in range(len(x))])
    assert (got <= links).all() and got.sum() >= 0.999 * links.sum() > 0 and len(found) == len(x)


def test_collinear_vectors_are_split(spark, monkeypatch):
    """Vectors of one direction share every projection: parts of their cell meet, and all are linked."""
    monkeypatch.setattr(embed_dedup, "CELL", 50)
    rows = {i: [(i + 1) * x for x in (1.0, -2.0, 3.0, 0.5)] for i in range(300)}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = embed_dedup.near_duplicates(table).collect()
    assert all((r.n_links, r.component_id) == (299, 0) for r in found) and len(found) == 300
    parts, first, near, far = embed_dedup._units(np.zeros(0), {0: 300}, 1.0)
    assert (parts.tolist(), near.tolist(), far.tolist()) == ([6], [0], [5])


def grams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_leaks_on_a_whole_table(spark):
    docs = {r.doc_id: grams(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i, len(a & b), len(b)) for d, a in docs.items() for i, b in items.items() if b and len(a & b) >= 0.75 * len(b)}
    assert want and {(r.doc_id, r.item_id, r.n_shared, r.item_shingles) for r in QUERIES["op4_decontamination"](spark, SF).collect()} == want


def test_leaks_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    long = " ".join(f"q{i}" for i in range(900))
    items = [(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "two words"), (5, " ".join(f"q{i}" for i in range(300, 520)))]
    rows = [None, "", "two words", "has two words inside", "x " * 5000 + "A, b; c d e f g h i j k l m n" + " y" * 5000, long, " ".join(f"q{i}" for i in range(300, 460))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(2, 4), (4, 1), (5, 5)}
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, bench).collect()) == [0, 1, 3, 6]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
