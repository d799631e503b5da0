"""Near-duplicates, components, vector search and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import components, decontamination, pii, simhash, topk

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\x0b \x1c", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def cluster_values(rng, n, bits):
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for b in rng.sample(range(64), rng.randrange(1, bits)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("radius", [4, 20])
def test_trees_find_all_pairs(seed, radius):
    rng = random.Random(seed)
    v = np.array(cluster_values(rng, 300, 8) * 2, np.uint64).reshape(-1, 1)  # equal ones, too
    if radius > 4:
        v = np.concatenate([v, np.roll(v, 1)], 1)
    rng.shuffle(tree := [i % 3 for i in range(len(v))])
    tree = np.array(tree)
    roots = np.array([int(np.flatnonzero(tree == k)[0]) for k in range(3)])
    forest = simhash.BKForest(v, roots[tree])
    got = [(int(a), int(b)) for q, n in forest.search(v, roots[tree], radius) for a, b in zip(q, n, strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(v)) for j in range(len(v)) if tree[i] == tree[j] and sum(int(a ^ b).bit_count() for a, b in zip(v[i], v[j], strict=True)) <= radius}


@pytest.mark.parametrize("seed", range(4))
def test_links_of_runs(seed):
    rng = random.Random(seed)
    v = np.array(cluster_values(rng, 240, 8), np.uint64)
    rng.shuffle(order := list(range(len(v))))
    v, run, is_node = v[order], np.repeat([0, 1, 2, 3], 60), np.zeros(240, bool)
    is_node[70:100] = is_node[179] = True  # two runs of a tree and its queries
    u, w = simhash.run_links(run, v.reshape(-1, 1), is_node, (2, 4))
    pairs = set(zip(u.tolist(), w.tolist(), strict=True))

    def near(i, j):
        meet = run[i] == run[j] and (run[i] in (0, 3) or is_node[i] != is_node[j])
        return meet and int(v[i] ^ v[j]).bit_count() <= 4

    assert all(near(a, b) for a, b in pairs) and len(pairs) < len(v)
    assert plain_components(range(len(v)), lambda a, b: (a, b) in pairs or (b, a) in pairs) == plain_components(range(len(v)), near)


@pytest.mark.parametrize(("tree", "per_shard"), [(1_024, 256), (20, 256), (1_024, 1e-3)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, tree, per_shard):
    rng = random.Random(7)
    values = cluster_values(rng, 400, 9)
    values += sorted({values[0] ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)} - set(values))
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "PER_SHARD", per_shard)
    assert simhash.bands_for(len(values), 4) == (5 if per_shard > 1 else 6)
    links = simhash.bit_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3))
    got = {r.node: r.component for r in components.components(links).collect()}
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    named = {}
    for x, c in zip(signed, want, strict=True):
        named[c] = min(named.get(c, x), x)
    assert [got.get(x, x) for x in signed] == [named[c] for c in want]


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_shards_hold_all_pairs(radius):
    rng = random.Random(radius)
    for bands in (radius + 1, radius + 3):
        x = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
        y = np.array([int(v) ^ sum(1 << b for b in rng.sample(range(64), radius)) for v in x.tolist()], np.uint64)
        assert (simhash.shard_keys(x, radius, bands) == simhash.shard_keys(y, radius, bands)).any(1).all()


def test_every_link_of_a_table_is_one_that_a_tree_gave(monkeypatch):
    """Over all fingerprints of a test table: what shards link is what all pairs link, and each link came from a search."""
    import pyarrow.parquet as pq

    fp = np.unique(np.array([simhash.fingerprint(t or "") for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()], np.uint64))
    keys = simhash.shard_keys(fp, 4, simhash.bands_for(len(fp), 4))
    shard, of = keys.ravel(), np.repeat(np.arange(len(fp)), keys.shape[1])
    order = np.argsort(shard, kind="stable")
    _, run = np.unique(shard[order], return_inverse=True)
    given, search = set(), simhash.BKForest.search

    def counted(self, queries, root, radius):
        for q, n in search(self, queries, root, radius):
            given.update(zip(queries[q, 0].tolist(), self.values[n, 0].tolist(), strict=True))
            yield q, n

    monkeypatch.setattr(simhash.BKForest, "search", counted)
    values = fp[of[order]]
    u, v = simhash.run_links(run, values.reshape(-1, 1), np.zeros(len(run), bool), (4,))
    pairs = set(zip(values[u].tolist(), values[v].tolist(), strict=True))
    assert pairs and pairs <= given
    index = {x: i for i, x in enumerate(fp.tolist())}
    linked = {(index[a], index[b]) for a, b in pairs} | {(index[b], index[a]) for a, b in pairs}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    assert plain_components(range(len(fp)), lambda a, b: (a, b) in linked) == plain_components(range(len(fp)), lambda a, b: near[a, b])


def sets_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("tree", [1_024, 8])
def test_similar_groups_against_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = random.Random(11)
    texts = []
    for n in (3, 6, 12, 40, 150, 400):
        for _ in range(4):
            base = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(6):
                own = list(base)
                for _ in range(rng.randrange(1 + n // 20)):
                    own[rng.randrange(n)] = "x" * rng.randrange(1, 9)
                texts.append(" ".join(own) + rng.choice(["", " more", "\n"]))
    texts += [None, "", " \t", "One two", "one  TWO", "x y " * 3000, "x y " * 3000 + "z"]
    rows = [(i * 3 + 1, t, "clash", "clash") for i, t in enumerate(texts)] + [(1, texts[0], "c", "c"), (None, texts[2], "c", "c"), (4000, texts[1], "c", "c")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, node string")
    mine = [(i, sets_of(t)) for i, t, *_ in rows if i is not None]
    want = plain_components([s for _, s in mine], lambda a, b: jaccard(a, b) >= 0.8)
    least = {}
    for (i, _), c in zip(mine, want, strict=True):
        least[c] = min(least.get(c, i), i)
    expected = {i: least[c] for (i, _), c in zip(mine, want, strict=True)}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert all(expected[i] == c for i, c in got.items()) and all(i in got for i, c in expected.items() if i != c)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or expected[i] == i)
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_similar_groups_recall(spark):
    """Of all pairs at 0.8 or more in a test table at least 0.99 share a group, and no group holds anything else than such pairs join."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    ids, sets = [r.doc_id for r in rows], [sets_of(r.text) for r in rows]
    by, pairs = {}, set()
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    common = Counter(p for ks in by.values() if len(ks) < 200 for i, a in enumerate(ks) for p in ((a, b) for b in ks[i + 1 :]))
    pairs = {p for p in common if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(table).collect()}
    together = sum(ids[a] in group and group[ids[a]] == group.get(ids[b]) for a, b in pairs)
    assert len(pairs) > 50 and together >= 0.99 * len(pairs)
    joined = {}
    for a, b in pairs:
        joined.setdefault(ids[a], set()).add(ids[b])
        joined.setdefault(ids[b], set()).add(ids[a])
    assert all(i == c or i in joined for i, c in group.items() if len(sets[ids.index(i)]))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (2000, 2001), (2001, 2000), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(200)) for _ in range(6)]
    texts = [*base, base[0], base[0] + " z", base[1].upper(), None, "", " \t", "one two", "One  two", "x y " * 2000]
    rows = [(i * 3 + 1, t, "clash", "clash") for i, t in enumerate(texts)] + [(1, base[0], "c", "c"), (None, base[2], "c", "c"), (None, "alone alone", "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = simhash.groups(df).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, *_), c in zip(rows, want, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    expected = Counter((i, p - (1 << 64) if p >> 63 else p, least.get(c)) for (i, *_), p, c in zip(rows, prints, want, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == expected
    assert simhash.groups(df.limit(0)).count() == 0


def test_op7(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, c in zip(rows, want, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert {tuple(r) for r in simhash.op7_simhash(spark, SF).collect()} == {(r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, want, strict=True)}


def plain_top(vectors, queries, k):
    out = []
    for key, q in queries:
        found = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != key))[:k]
        out += [(key, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread", "block"), [(0, 1, 8_192), (1, 50, 8_192), (2, 1000, 8_192), (1, 50, 64)])
def test_top_k(spark, monkeypatch, seed, spread, block):
    monkeypatch.setattr(topk, "DATA_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(block // 64, 2))
    monkeypatch.setattr(topk, "SEEDS", 100)
    rng = random.Random(seed)
    vectors = [(i, [rng.randrange(-9, 10) * rng.randrange(1, spread + 1) for _ in range(6)]) for i in range(900)]
    vectors += [(2000 + i, vectors[i][1]) for i in range(40)] + [(3000, [0] * 6), (3001, [5, 5]), (-100, [1] * 6), (3002, []), (3003, vectors[3][1]), (3003, vectors[3][1])]
    df = spark.createDataFrame([*vectors, (None, [1] * 6), (5000, None)], "vec_id long, v array<long>").repartition(3)
    vectors += [(200, [7] * 6), (200, vectors[200][1])]  # queries that share an id
    df = df.unionByName(spark.createDataFrame(vectors[-2:], df.schema))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect())
    assert got == plain_top(vectors, [(i, v) for i, v in vectors if i % 100 == 0], 10)
    few = df.where("vec_id < 5 AND vec_id >= 0")
    assert sorted(tuple(r) for r in topk.top_k(few, few, 10).collect()) == plain_top(vectors[:5], vectors[:5], 10)


@pytest.mark.parametrize("sign", [-1, 1])
def test_search_of_clusters_about_an_axis(sign):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 60, (2048, 16))
    x[:, 7] += sign * 1000
    x[::3] = rng.normal(0, 300, (683, 16))  # longer ones at a low cosine fill the first buckets
    x[::3, 7] += sign * 600
    x[::3] *= 1200 / np.linalg.norm(x[::3], axis=1)[:, None]
    x = x.astype(np.int64)
    ids = np.arange(len(x))
    asked = np.flatnonzero(ids % 3)[:60]
    want = []
    for i in asked.tolist():
        score = x @ x[i]
        want += [(len(want) // 10, int(j), int(score[j])) for j in np.lexsort((ids, -score)) if j != i][:10]
    assert topk.search(ids, x, ids[asked], x[asked], 10) == want


def test_top_k_of_few_and_odd_vectors(spark):
    rows = [(0, [0.5, -0.25], 1), (100, [1.0, None], 1), (1, [float("nan"), 1.0], 1), (2, [float("inf"), 1.0], 1), (3, None, 1), (4, [-0.0001, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    v = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    assert sorted(tuple(r) for r in v.collect()) == [(0, [512, -256]), (4, [-1, 0])]
    assert [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).collect()] == [(0, 1, 4, -512)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize(("group", "block"), [(7, 64), (131_072, 2_048)])
def test_top_k_broadcasts_nothing_and_answers_in_groups(spark, monkeypatch, group, block):
    """Spark estimates exploded query packs as unexploded ones: a join with them was one by broadcast, and the driver held a pack for every block."""
    monkeypatch.setattr(topk, "QUERY_GROUP", group)
    monkeypatch.setattr(topk, "DATA_BLOCK", block)
    monkeypatch.setattr(topk, "SEEDS", 50)
    rng = random.Random(12)
    vectors = [(i, [rng.randrange(-9, 10) * (1 + i % 7 * 100) for _ in range(5)]) for i in range(800)]
    vectors += [(1000 + i, vectors[10][1]) for i in range(300)]  # many ties
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(5)
    found = topk.top_k(df, df.where("vec_id % 20 = 0"), 10)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.collect()) == plain_top(vectors, [(i, v) for i, v in vectors if i % 20 == 0], 10)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("high", [3, 1_000, 10**5, 10**8, 2**30])
@pytest.mark.parametrize("shape", ["spread", "near", "ties"])
def test_asked_over_many_blocks(monkeypatch, high, shape):
    """Products in floats of either width, longs and Python's integers, over several blocks, against sums of Python's integers."""
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(high)
    x = rng.integers(-high, high + 1, (600, 6))
    if shape == "near":  # high cosines: a coordinate prunes
        x = rng.integers(-high, high + 1, (8, 6))[np.arange(600) % 8] + rng.integers(-high // 50, high // 50 + 1, (600, 6))
    elif shape == "ties":
        x[::2] = x[0]
    ids = rng.permutation(600) // 2 * 2  # each twice
    own = np.concatenate([ids[:40], [10_000]])
    q = np.concatenate([x[:40], np.zeros((1, 6), np.int64)])
    asked = topk.Asked(own, q, 10)
    for lo in range(0, 600, 150):
        asked.meet(ids[lo : lo + 150], x[lo : lo + 150])
    number, found, score = (a.tolist() for a in asked.found())
    got = list(zip(number, found, score, strict=True))
    want = []
    for n, (key, v) in enumerate(zip(own.tolist(), q.tolist(), strict=True)):
        want += [(n, i, -s) for s, i in sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in zip(ids.tolist(), x.tolist(), strict=True) if i != key)[:10]]
    assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept, texts = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        rows = {r.doc_id: r for r in docs.collect()}
        old = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= kept[-1]
        if name == "near-dedup":
            ids = sorted(old)
            want = plain_components([sets_of(old[i].text) for i in ids], lambda a, b: jaccard(a, b) >= 0.8)
            assert set(rows) == {ids[c] for c in want}
        elif name == "decontamination":
            hit = {r.doc_id for r in decontamination.find(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
            assert hit and set(rows) == set(old) - hit
        elif name == "pii":
            assert set(rows) == set(old) and not any(pii.base_spans(r.text) for r in rows.values())
            assert all(r.n_chars == len(r.text) for r in rows.values()) and all(rows[i].text == old[i].text for i in old if not pii.base_spans(old[i].text))
        kept.append(set(rows))
        texts = {i: r.text for i, r in rows.items()}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert Counter(r.sequence_id for r in got) and max(sum(r.length for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in got)
