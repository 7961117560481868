"""SimHash groups, centroid clusters and lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from marketloom.llm import centroids, golay, lexical_search, queries, simhash


# --- 11 ---

def plain_fingerprint(text: str | None) -> int:
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    size = min(3, len(words))
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> list[int]:
    above = list(range(len(prints)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_golay_code_is_perfect_and_near_words_share_a_key():
    words = np.arange(1 << 23, dtype=np.int64)
    index, syndrome = golay.nearest(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()
    assert np.bitwise_count(golay.ERROR).max() == 3 and set(golay.COUNT.tolist()) == {0, 5}
    some = np.random.default_rng(1).integers(0, 1 << 23, 400)
    near = np.concatenate([some, *(some ^ (1 << b) for b in range(23))])
    at, key = golay.fuzzy_keys(near)
    keys = [set() for _ in near]
    for i, k in zip(at.tolist(), key.tolist(), strict=True):
        keys[i].add(k)
    for b in range(23):
        assert all(keys[i] & keys[400 * (b + 1) + i] for i in range(400))


def test_prints_within_two_bits_share_a_key():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << b
        at, key = simhash.bucket_keys(np.array([x, y], dtype=np.uint64))
        assert set(key[at == 0]) & set(key[at == 1])


def test_simhash_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    prints = [plain_fingerprint(t) for t in docs["text"]]
    want = [(int(d), f"{p:016x}", int(docs["doc_id"].iloc[r])) for d, p, r in zip(docs["doc_id"], prints, plain_components(prints), strict=True)]
    assert sorted(map(tuple, queries.op11_simhash_near_dedup(spark, sf_dir).collect())) == want


@pytest.mark.parametrize("most", [2, 8, 64])
def test_links_of_crowded_buckets(spark, most):
    rng = random.Random(most)
    middle = rng.getrandbits(64)
    prints = {middle}
    while len(prints) < 250:  # a cloud around one print, chains away from it, and strangers
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 9])):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints, key=lambda x: x - (x >> 63 << 64))
    signed = [x - (x >> 63 << 64) for x in prints]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 2 for a, b in links)
    above = list(range(len(prints)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in links:
        x, y = top(at[a]), top(at[b])
        above[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(prints))] == plain_components(prints)


def test_simhash_of_nulls_and_odd_names(spark):
    rows = [(None, None, "x", 1), (5, "", "y", 2), (3, " \t\n", "z", 3), (9, "one TWO three four", None, 4), (8, "One two three four", "q", 5),
            (8, "One two three four", "q", 5), (7, "long " * 200_000, "r", 6)]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, Fingerprint string, `a b` int")
    got = simhash.simhash_duplicates(docs, id_col="doc.id")
    assert got.columns == ["doc.id", "text", "a b", "fingerprint", "component_id"]
    assert {r["a b"]: r["component_id"] for r in got.collect()} == {1: 3, 2: 3, 3: 3, 4: 8, 5: 8, 6: 7}
    assert got.count() == 7 and simhash.simhash_duplicates(docs.limit(0), id_col="doc.id").count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=5000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text.encode()) == want


# --- 12 ---

def plain_clusters(rows, k, rounds):
    """rows: (id, integer components)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(r[1]) for r in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        where = [nearest(x)[1] for _, x in rows]
        for j in range(len(centres)):
            own = [x for (_, x), w in zip(rows, where, strict=True) if w == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [nearest(x) for _, x in rows]
    sums = Counter()
    for d, j in last:
        sums[j] += d
    return sorted((-1 if i is None else i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(rows, last, strict=True))


def test_cluster_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_centroid_clusters(spark, sf_dir).collect())) == plain_clusters(rows, 40, 5)


def test_clusters_with_ties_odd_vectors_and_names(spark):
    rng = random.Random(5)
    good = [(i, [rng.randrange(-3, 4) / 2 for _ in range(4)]) for i in range(120)] + [(7, [0.5] * 4)] * 5 + [(None, [1.0] * 4)]
    bad = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [1e30] * 4)]
    df = spark.createDataFrame([(i, v, "c") for i, v in good + bad], "`vec.id` long, v array<double>, Cluster string")
    got = centroids.centroid_clusters(df, id_col="vec.id", vector_col="v", clusters=9, rounds=6, dims=4, carry=["vec.id", "Cluster"])
    assert got.columns == ["vec.id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain_clusters([(i, [math.floor(256 * x) for x in v]) for i, v in good], 9, 6)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    few = centroids.centroid_clusters(df.where("`vec.id` < 3"), id_col="vec.id", vector_col="v", dims=4)
    assert {r["distance"] for r in few.collect()} == {0}
    assert centroids.centroid_clusters(df.limit(0), id_col="vec.id", vector_col="v", dims=4).count() == 0


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 100, (3000, 8)).astype(np.int64) + rng.integers(0, 6, (3000, 1)) * 900
    history = vectors[None, :12].copy()
    state, taken = centroids.first_assignment(vectors, history[0]), 0
    for _ in range(7):
        now = history[-1].copy()
        for j in range(12):
            if (state["cluster"] == j).any():
                now[j] = vectors[state["cluster"] == j].sum(axis=0) // (state["cluster"] == j).sum()
        history = np.concatenate([history, now[None]])
        taken += centroids.reassign(vectors, state, history)
        full = centroids.squared_distances(vectors, now)
        assert (state["cluster"] == full.argmin(axis=1)).all()
    assert 0 < taken < 7 * 3000 * 12 / 3


def test_large_components_are_exact():
    v = np.array([[1 << 27, -(1 << 27)], [3, 4]], dtype=np.int64)
    assert centroids.squared_distances(v, -v).tolist() == [[1 << 57, ((1 << 27) + 3) ** 2 + ((1 << 27) - 4) ** 2], [((1 << 27) + 3) ** 2 + ((1 << 27) - 4) ** 2, 100]]


# --- 13 ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [Counter(TERM.findall((t or "").translate(lower))) for _, t in docs]
    n_docs, length = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(lower)), []
        for (doc, _), bag in zip(docs, bags, strict=True):
            if bag:
                m = 75 + 25 * sum(bag.values()) * n_docs // length
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in asked if bag[t])
                if score > 0:
                    scored.append((-score, doc))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_search_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_lexical_search(spark, sf_dir).collect())) == plain_search(docs, items, 20)


def test_search_with_ties_nulls_and_blocks_of_items(spark):
    rng = random.Random(8)
    words = ["Äpfel", "b", "c2", "d", "ß", "f", "g"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(150)]
    docs += [(1000 + i, "b c2, b") for i in range(40)] + [(2000, None), (2001, ""), (2002, "?! ..."), (2003, "b-" * 50_000), (4, docs[4][1])]
    items = [(i, " ".join(rng.choices(words, k=4))) for i in range(12)] + [(50, None), (51, "..."), (52, "zzz"), (53, "B b B")]
    d = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, `doc id` long, score int")
    q = spark.createDataFrame(items, "item_id long, text string")
    for item_bytes in (1 << 20, 40):
        got = lexical_search.lexical_search(d, q, top=7, id_col="doc id", item_bytes=item_bytes)
        assert got.columns == ["item_id", "rank", "doc id", "score"]
        assert sorted(map(tuple, got.collect())) == plain_search(docs, items, 7)
    assert lexical_search.lexical_search(d.limit(0), q, id_col="doc id").count() == 0
    assert lexical_search.lexical_search(d, q.limit(0), id_col="doc id").count() == 0


def test_both_trees_prune_whole_batches_exactly():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        topic = rng.integers(0, 10)
        rows.append(np.unique(rng.integers(topic * 20, topic * 20 + 20, 8)))
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    docs = lexical_search.Sparse(at, np.concatenate(rows), rng.integers(1, 1000, at[-1]))
    items = [{int(t): int(c) for t, c in zip(rng.integers(20 * (i % 10), 20 * (i % 10) + 20, 5), rng.integers(1, 4, 5), strict=True)} for i in range(30)]
    found = lexical_search.Search(lexical_search.item_tree(items, np.ones(200, dtype=np.int64)), 30, 200, 5)
    for a in range(0, 3000, 1000):
        part = lexical_search.Sparse(at[a:a + 1001] - at[a], docs.column[at[a]:at[a + 1000]], docs.value[at[a]:at[a + 1000]])
        found.add(np.arange(a, a + 1000), part)
    for i, item in enumerate(items):
        scores = [(-sum(int(v) * item.get(int(t), 0) for t, v in zip(docs.column[at[k]:at[k + 1]], docs.value[at[k]:at[k + 1]], strict=True)), k) for k in range(3000)]
        assert [(-int(s), int(d)) for s, d in zip(*found.best[i], strict=True)] == [x for x in sorted(scores)[:5] if x[0] < 0]
    assert found.scored < 30 * 3000 / 20
