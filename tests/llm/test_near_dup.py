import random
import re

import numpy as np
import pyarrow as pa

from marketloom.llm import near_dup
from marketloom.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, size):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = near_duplicates(docs, shingle_words=4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert got == brute_force(rows, 4)
    small = near_duplicates(docs, shingle_words=4, block_rows=2)  # buckets of several blocks
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in small.collect()} == got
    assert any(i != c for i, (_, c, _) in got.items())


def test_edge_cases(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one TWO", None),
            (6, "two one", "x"), (7, words, "x"), (7, words, "x"), (8, words + " tail", "x"), (None, words, "x"),
            (9, "Über ÜBER", "x"), (10, "über über", "x"), (11, "k " * 200000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = near_duplicates(docs, shingle_words=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(rows)
    assert [by[i][0].n_shingles for i in (1, 2, 3, 4, 11)] == [0, 0, 0, 1, 1]
    assert [by[i][0].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 2, 3, 4, 4, 6, 7, 7, 9, 10]
    assert by[None][0].component_id == 7 and not by[None][0].kept
    assert sum(r.representative for r in out if r.component_id == 7) == 1
    empty = near_duplicates(docs.limit(0), shingle_words=4)
    assert empty.count() == 0


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        t = list(base)
        for k in range(i):
            t[k * 13] = f"x{k}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle_words=4).collect()}
    assert got == brute_force(rows, 4)


def test_a_bucket_of_many_open_classes_in_several_blocks(spark, monkeypatch):
    """Clusters that share bands but aren't alike: pairs meet across the blocks of a bucket."""
    rng = random.Random(2)
    rows = []
    for c in range(12):
        base = [f"w{i}" for i in range(150)] + [f"c{c}x{i}" for i in range(60)]
        for k in range(12):
            t = list(base)
            for j in rng.sample(range(150), 3):
                t[j] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows, 4)
    for blocks in (3, 8, 1024):
        out = near_duplicates(docs, shingle_words=4, block_rows=blocks).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == want
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 700)  # blocks of about three texts
    out = near_duplicates(docs, shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == want


def test_only_rows_with_a_surviving_pair_get_their_texts():
    """Rows 1 and 2 are alike, 3 has another signature, 4 is as row 1 but of its component,
    5 is too long, 6 shares an earlier band with row 1 and 2."""
    one, other = bytes(252), bytes([1]) * 252
    bands = [np.arange(42) + 100 * k for k in range(7)]
    for k in (1, 2, 6):
        bands[k][3] = 7
    bands[6][0], bands[1][0], bands[2][0] = 5, 5, 6
    bands[6][1], bands[2][1] = 8, 8
    rows = pa.table({
        "h": pa.array([9] * 6, pa.int64()), "bi": pa.array([0] * 6, pa.int64()), "bj": pa.array([0] * 6, pa.int64()),
        "block": pa.array([0] * 6, pa.int64()), "t": pa.array([3] * 6, pa.int32()),
        "p": pa.array([1, 2, 3, 4, 5, 6], pa.int64()), "root": pa.array([1, 2, 3, 1, 5, 6], pa.int64()),
        "n": pa.array([100, 100, 100, 400, 400, 100], pa.int64()),
        "sig": pa.array([one, one, other, one, other, one], pa.binary()),
        "keys": pa.array([bands[k].astype(np.int64).tobytes() for k in range(1, 7)], pa.binary())})
    assert near_dup._sift(173, 80, 100)(rows).column("p").to_pylist() == [1, 2]
