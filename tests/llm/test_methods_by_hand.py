"""The learning and threshold steps of operators 3, 5 and 7 against plain Python."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketloom.llm import language_id, quality_model, quality_rules, queries
from marketloom.llm._bytes import Words

from .test_row_operators import WORD, base_of


def test_follow_the_regularised_leader_by_hand():
    """Each step on dictionaries of single numbers."""
    rng = np.random.default_rng(0)
    model = quality_model.Ftrl(buckets=6)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(60):
        at = np.append(rng.choice(6, rng.integers(1, 5), replace=False), 6)
        value, label = np.append(rng.random(len(at) - 1) * 3, 1.0), int(rng.integers(2))
        model.learn(at, value, label)
        own = {i: weight(i) for i in at.tolist()}
        p = 1 / (1 + math.exp(-sum(own[i] * v for i, v in zip(at.tolist(), value.tolist(), strict=True))))
        for i, v in zip(at.tolist(), value.tolist(), strict=True):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * own[i]
            n[i] += g * g
        assert model.weights().tolist() == pytest.approx([weight(i) for i in range(7)], abs=1e-12)


def test_scores_are_sparse_dot_products(spark):
    texts = ["a b a", "", None, "One TWO three 3 4!", "x " * 3000]
    weights = np.random.default_rng(1).normal(size=101).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality_model.score(df, weights).collect():
        found, _ = quality_model.features([(r.text or "").encode()], 100)
        total = float(weights[-1]) + sum(quality_model.SCALE * k / max(len(found), 1) * float(weights[i]) for i, k in Counter(found.tolist()).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_out_of_place_distances_by_hand():
    profiles = {"aa": [5, 7, 9, 11], "bb": [9, 5, 100], "cc": []}
    model = language_id.Profiles({k: np.array(v, dtype=np.int64) for k, v in profiles.items()})
    for grams in ([9, 5, 42, 7], [100], [11, 9, 7, 5, 1, 2], []):
        got = model.distances(np.array(grams, dtype=np.int64))
        for lang, d in zip(model.langs, got.tolist(), strict=True):
            own = profiles[lang]
            want = sum(abs(own.index(g) - i) if g in own else language_id.PROFILE for i, g in enumerate(grams))
            assert d == pytest.approx(want / max(language_id.PROFILE * len(grams), 1))


def metrics_of(text):
    n_words, chars, symbols, dup_lines, repeats, _ = base_of(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    upper, marks = (len(re.findall(p, text or "")) for p in ("[A-Z]", "[!?]"))
    share = lambda a, b, scale=1000: scale * a // b if b else 0
    return dict(zip(quality_rules.METRICS, (share(symbols, chars), share(upper, chars), share(marks, chars), share(dup_lines, len(lines)),
                                            share(repeats, n_words), share(chars, n_words, 100)), strict=True))


def test_quality_verdicts_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = quality_rules.judge_quality(docs).collect()
    bin_of = lambda v: v >> d << d if (d := max(v.bit_length() - quality_rules.BIN_BITS, 0)) else v
    values, held = {}, defaultdict(list)
    for r in rows:
        values[r.doc_id] = {m: bin_of(v) for m, v in metrics_of(r.text).items()}
        if not base_of(r.text)[-1]:
            held[r.lang, r.source].append(values[r.doc_id])
    top = {}
    for key, own in held.items():
        for m in quality_rules.METRICS:
            bins = sorted(v[m] for v in own)
            q50, q75 = bins[-(-len(bins) // 2) - 1], bins[-(-3 * len(bins) // 4) - 1]
            top[key, m] = q50 + quality_rules.FENCE * max(q75 - q50, quality_rules.STEP[m])
    verdicts = Counter()
    for r in rows:
        fits = all(values[r.doc_id][m] <= top.get(((r.lang, r.source), m), 2**40) for m in quality_rules.METRICS)
        assert r.kept == (fits and not base_of(r.text)[-1])
        verdicts[r.base_failed, r.kept] += 1
    assert verdicts[False, True] and verdicts[False, False] and verdicts[True, False]


# --- the whole queries of operators 3 and 5, in plain Python ---

def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_grams(text):
    """1- to 3-grams of letters, with one blank for whatever stands between them."""
    symbols = []
    for c in text.lower() + " ":
        c = ord(c) if c.isalpha() else 32
        if c != 32 or not symbols or symbols[-1] != 32:
            symbols.append(c)
    found = Counter()
    for i, c in enumerate(symbols):
        if c != 32:
            found[c, 0, 0] += 1
        if i + 1 < len(symbols):
            found[c, symbols[i + 1], 0] += 1
        if i + 2 < len(symbols) and symbols[i + 1] != 32:
            found[c, symbols[i + 1], symbols[i + 2]] += 1
    return found


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:language_id.PROFILE]]


def test_language_query_against_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = defaultdict(Counter)
    for r in rows:
        if not held_out(r.doc_id) and r.lang is not None and r.text is not None:
            learned[r.lang] += plain_grams(r.text)
    assert max(Counter(r.lang for r in rows).values()) <= language_id.MAX_DOCS_PER_LANG
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in learned.items()}
    want = {}
    for r in rows:
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            want[r.doc_id] = (held_out(r.doc_id), "und", 0.0)
            continue
        own = ranked(plain_grams(text))
        far = sorted((sum(abs(p[g] - k) if g in p else language_id.PROFILE for k, g in enumerate(own)) / (language_id.PROFILE * len(own)), lang) for lang, p in profiles.items())
        want[r.doc_id] = (held_out(r.doc_id), far[0][1], pytest.approx((far[1][0] - far[0][0]) / far[1][0], abs=2e-6))
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert got == want


LOW64 = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & LOW64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & LOW64
    return x ^ x >> 31


def plain_features(text, buckets):
    """Bucket -> count of the n-grams of a text, word after word; a word's hash is taken from the library."""
    def kind(b):
        return 3 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b < 33 or b > 127 else b

    def gram(parts, salt):
        h = salt
        for x in parts:
            h = plain_mix(((h ^ x) * 0x9E3779B97F4A7C15) & LOW64)
        return h % buckets

    found, past = Counter(), [(0, 0, 0)] * 2  # (letters, shape, again) of the words before
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text):
        low = int(Words([word.lower()]).hash[0])
        runs = [k for k, g in itertools.groupby(kind(b) for b in word)]
        shape = sum(plain_mix((k << 8) + min(i, 7)) for i, k in enumerate(runs)) & LOW64
        again = int(past[1][0] == low) + 2 * int(past[0][0] == low)
        found.update([gram([low], 1), gram([low, past[1][0]], 2), gram([shape], 3), gram([shape, past[1][1]], 4),
                      gram([shape, past[1][1], past[0][1]], 5), gram([again, past[1][2]], 6)])
        past = [past[1], (low, shape, again)]
    return found


def test_quality_query_against_plain_python(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if not held_out(r.doc_id)}
    b = quality_model.BUCKETS
    found = {i: plain_features(t, b) for i, t in docs.items()}
    value = lambda c: {**{k: quality_model.SCALE * n / max(sum(c.values()), 1) for k, n in c.items()}, b: 1.0}
    own = quality_model.Ftrl(b)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= own.l1 else -(z[i] - math.copysign(own.l1, z[i])) / ((own.beta + math.sqrt(n[i])) / own.alpha + own.l2)

    learn, order = sorted(i for i in labels if i in docs), np.random.default_rng(7)
    for _ in range(quality_model.EPOCHS):
        for k in order.permutation(len(learn)):
            x = value(found[learn[k]])
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - labels[learn[k]]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / own.alpha * w[i]
                n[i] += g * g
    rows = queries.op3_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        total = sum(weight(i) * v for i, v in value(found[r.doc_id]).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5) and r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.3)
