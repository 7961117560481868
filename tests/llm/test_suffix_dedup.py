import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import suffix_dedup
from marketloom.llm.suffix_array import suffix_array
from marketloom.llm.suffix_dedup import CORE, LENGTH, SIDE, find_runs, parts, repeated_bytes


def brute_force(rows):
    docs = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for (i, b), (raw, _) in zip(docs, rows, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[raw, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df, **options):
    rows = repeated_bytes(df, with_text=True, **options).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute_force(rows)
    assert got(docs) == want
    assert got(docs.repartition(7), max_group=2) == want


def test_matches_brute_force_on_cut_and_joined_texts(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(300)) for _ in range(4)] + ["x" * 180, "xy" * 90]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(base)
            a = rng.randrange(len(t))
            parts.append(t[a:a + rng.randrange(20, 120)])
        rows.append((rng.randrange(200), "".join(parts)))
    rows += [(None, base[0]), (None, base[0]), (3, None), (4, ""), (5, base[1][:30]), (-7, base[0][10:70])]
    rows += [(900 + i, t) for i, t in enumerate([base[1][:80], "", None, base[1][:80], base[1][:80], ""])]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, spans string, id int")
    for most in (1, 3, 2000):
        assert got(df, max_group=most) == brute_force(rows)
    assert repeated_bytes(df.limit(0)).count() == 0


def test_runs_hold_each_window_once():
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcd", k=rng.choice([0, 3, 49, 50, 51, 400, 70000]))) for _ in range(40)] + [b"z" * 300]
    data, ends = np.frombuffer(b"".join(texts) + bytes(64), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    runs, seen = find_runs(data, ends), []
    chosen: dict[bytes, int] = {}
    for _ in range(4):
        for at, low, high, part in zip(runs.at.tolist(), runs.low.tolist(), runs.high.tolist(), runs.part.tolist(), strict=True):
            first, last = parts(runs.level)[part]
            assert first <= low <= high <= last <= SIDE
            seen += [at - k for k in range(low, high + 1)]
            for k in range(low, high + 1):
                window = data[at - k:at - k + LENGTH].tobytes()
                assert chosen.setdefault(window, k) == k  # equal windows, equal places of the core
        starts = [e - len(t) for e, t in zip(ends, texts, strict=True)]
        assert sorted(seen) == [s + k for s, t in zip(starts, texts, strict=True) for k in range(len(t) - LENGTH + 1)]
        seen = []
        assert (runs.core()[1] >= CORE).all()
        runs = runs.split()[0] if runs.level < 3 else runs


def test_windows_of_earlier_documents_whatever_the_hashes(monkeypatch):
    """Equality is decided on bytes: the same bits if hashes are few or all equal."""
    rng = random.Random(5)
    base = "".join(rng.choices("ab", k=400)).encode()
    texts = []
    for _ in range(60):
        t = bytearray(base[(a := rng.randrange(300)):a + rng.randrange(60, 100)])
        for k in rng.sample(range(len(t)), rng.choice([0, 0, 1, 2])):
            t[k] ^= 3
        texts.append(bytes(t))
    data, ends = np.frombuffer(b"".join(texts) + bytes(64), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    runs = find_runs(data, ends)
    ids = np.array([rng.randrange(40) for _ in texts])[np.searchsorted(ends, runs.at, side="right")]
    first: dict[bytes, int] = {}
    rows = [(i, [data[a + j:a + j + LENGTH].tobytes() for j in range(n - LENGTH + 1)])
            for a, n, i in zip(runs.start.tolist(), runs.size.tolist(), ids.tolist(), strict=True)]
    for i, windows in rows:
        for w in windows:
            first[w] = min(first.get(w, i), i)
    want = [sum((first[w] < i) << j for j, w in enumerate(windows)) for i, windows in rows]
    assert any(want) and suffix_dedup.earlier(data, runs, ids).tolist() == want
    for few in (1, 3):
        monkeypatch.setattr(suffix_dedup, "_hash", lambda data, at, size, few=few: data[at].astype(np.uint64) % np.uint64(few))
        assert suffix_dedup.earlier(data, runs, ids).tolist() == want


def test_a_passage_that_thousands_continue_differently(spark):
    """One core with over 5,000 distinct runs: it grows, with the same result."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=70))
    rows = [(i, "".join(rng.choices("xyzw", k=30)) + passage[rng.randrange(3):] + "".join(rng.choices("xyzw", k=45))) for i in range(5500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert got(df.repartition(5), max_group=2000) == want
    assert got(df, max_group=10**6) == want


def test_passages_beyond_16_mib_of_a_text(spark):
    long = "".join(random.Random(8).choices("abcdefghijklmnop", k=(1 << 24) + 90_000))
    at, passage = (1 << 24) + 50_000, "".join(random.Random(9).choices("abcdefghijklmnop", k=300))
    long = long[:at] + "C" + passage + "D" + long[at:]
    rows = spark.createDataFrame([(1, "A" + passage + "B"), (2, long), (3, long[:400])], "doc_id long, text string")
    out = {r.doc_id: r for r in repeated_bytes(rows).collect()}
    assert [(s.start, s.end) for s in out[2].spans] == [(at + 1, at + 301)]
    assert (out[1].n_removed, out[3].n_removed) == (0, 400)


def test_texts_that_repeat_themselves(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 16)))
            parts.append((unit * 400)[rng.randrange(20):][:rng.choice([40, 130, 300, 1500])])
            parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 30, 200]))))
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 5000), (101, "a" * 49), (102, "a" * 50), (103, "a" * 131), (104, "b" + "a" * 700 + "b"), (105, "ab" * 900), (99, "ab" * 70), (106, " " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert got(df) == want
    assert got(df.repartition(5), max_group=2) == want


def test_stretches_and_memory_of_one_long_repetition():
    text = b"q" * 200 + b"xyz" * 100_000 + b"\0" * (4 << 20) + b"end" + b"z" * 300
    data, ends = np.frombuffer(text + bytes(64), dtype=np.uint8), np.array([len(text) - 300, len(text)])
    start, stop, period = suffix_dedup.repeats(data, ends)
    assert list(zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)) == [
        (0, 200, 1), (200, 300_200, 3), (300_200, 300_200 + (4 << 20), 1), (len(text) - 300, len(text), 1)]
    runs = find_runs(data, ends, (start + period, stop - LENGTH + 1))
    assert len(runs.at) < 1000
    whole = find_runs(data, ends)
    skip = np.zeros(len(text), dtype=bool)
    for a, b, p in zip(start, stop, period, strict=True):
        skip[a + p:b - LENGTH + 1] = True
    windows = lambda r: {(int(a - w), int(a)) for a, lo, hi in zip(r.at, r.low, r.high, strict=True) for w in range(lo, hi + 1)}
    assert windows(runs) == {w for w in windows(whole) if not skip[w[0]]}
