"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as cp
from marketloom.llm import mixing, secret_scan
from marketloom.llm import sentencepiece_tokens as sp

from .test_near_dup import brute_force
from .test_row_operators import base_of


def shared_out(sizes, weights, cap):
    """Targets of sources by rounds: whoever is above ``cap`` times its size stops there, the rest share again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in fixed}
        left, heavy = total - sum(fixed.values()), sum(rest.values())
        over = {s: cap * sizes[s] for s, w in rest.items() if left * w > cap * sizes[s] * heavy}
        if not over:
            return {**{s: float(t) for s, t in fixed.items()}, **{s: left * w / heavy for s, w in rest.items()}}
        fixed |= over


def copies_of(docs, cap=3):
    """How often each of the (id, text, source) is taken, and the words and the target of each source."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    members = defaultdict(list)
    for i, _, source in docs:
        members[source].append(i)
    order = sorted(members, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size[i] for i in members[s]) for s in order}
    targets = shared_out(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, cap)
    times, taken = {}, {}
    for s in order:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        whole, edge = int(rate), int((rate - int(rate)) * 2**32)
        digits = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in members[s]}
        plans = [{i: whole + (int(d[k:k + 8], 16) < edge) for i, d in digits.items()} for k in range(mixing.SEEDS)]
        best = min(plans, key=lambda plan: abs(sum(n * size[i] for i, n in plan.items()) - targets[s]))
        times |= best
        taken[s] = sum(n * size[i] for i, n in best.items())
    return times, taken, targets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    assert len(cp.STAGES) == 5
    for name, stage in cp.STAGES:
        before, docs = docs, cp.materialize(stage(spark, docs, sf_dir))
        seen[name] = (before.collect(), docs.collect())
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    (n1, _), (n2, _), (n3, _), (n4, _), (n5, _) = cp.STAGES
    before, after = seen[n1]
    kept = {r.doc_id for r in after}
    assert kept and not any(base_of(r.text)[-1] for r in after) and kept <= {r.doc_id for r in before}
    before, after = seen[n2]
    groups = brute_force([(r.doc_id, r.text) for r in before], 5)
    assert {r.doc_id for r in after} == {i for i, (_, c, _) in groups.items() if i == c}
    before, after = seen[n3]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    text = {r.doc_id: r.text for r in before}
    for r in after:
        assert r.text == secret_scan.redact(text[r.doc_id], secret_scan.find_secrets(text[r.doc_id])) and r.n_chars == len(r.text)
    before, after = seen[n4]
    times = Counter(r.doc_id for r in after)
    want, taken, targets = copies_of([(r.doc_id, r.text, r.source) for r in before])
    assert times == {i: n for i, n in want.items() if n} and max(times.values()) <= 3
    assert sum(targets.values()) == pytest.approx(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before))
    for source, words in taken.items():
        largest = max(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before if r.source == source)
        assert abs(words - targets[source]) <= max(0.05 * targets[source], largest), Counter(r.source for r in before)[source]
    rows = {r.doc_id: r for r in before}
    assert all(r == rows[r.doc_id] for r in after)
    before, after = seen[n5]
    assert Counter(r.doc_id for r in after) == times and all(r.round_trip for r in after)
    text = {r.doc_id: r.text for r in before}
    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    coded = {i: library.encode(t) for i, t in text.items()}
    for r in after:
        assert r.ids == coded[r.doc_id] and r.n_tokens == len(r.ids) and r.source == rows[r.doc_id].source
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()


def test_nulls_and_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for rows in (docs.limit(0), odd, docs.limit(40).unionByName(odd)):
        for _, stage in cp.STAGES[:4]:
            assert stage(spark, rows, sf_dir).columns == docs.columns
            stage(spark, rows, sf_dir).count()
        cp.STAGES[4][1](spark, rows, sf_dir).count()
