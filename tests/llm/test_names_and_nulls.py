"""Every operator: inputs of any name, clashing and dotted columns, nulls, no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketloom.llm import (
    flac, language_id, mixing, near_dup, quality_model, quality_rules, secret_scan, sentencepiece_tokens, suffix_dedup, url_rules,
)

TEXT = "One two three four five six seven eight nine ten\n" * 8
ROWS = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT + "tail", None, None), (None, None, "fr", "a"), (3, "", "fr", None)]


def operators(spark, i="doc_id", t="text", lang="lang", s="source"):
    weights = quality_model.np.zeros(17, dtype="float32")
    profiles = language_id.Profiles({"en": quality_model.np.array([1, 2, 3])})
    rules = url_rules.base_rules(spark)
    return {
        "near_dup": (lambda d: near_dup.near_duplicates(d, i, t), {"n_shingles", "component_id", "kept", "representative"}),
        "url_rules": (lambda d: url_rules.judge_urls(d, rules, t), {"host", "path", "rule", "verdict"}),
        "quality_model": (lambda d: quality_model.score(d, weights, t), {"score", "predicted"}),
        "language_id": (lambda d: language_id.identify(d, profiles, t), {"lang_pred", "score"}),
        "quality_rules": (lambda d: quality_rules.judge_quality(d, t, (lang, s)), {"n_words", "kept"}),
        "secret_scan": (lambda d: secret_scan.scan_secrets(d, t), {"spans"}),
        "mixing": (lambda d: mixing.plan_mix(d, i, t, s), {"size", "target", "copies", "taken"}),
        "sentencepiece": (lambda d: sentencepiece_tokens.encode_tokens(d, t), {"ids", "n_tokens", "round_trip"}),
        "flac": (lambda d: flac.store_and_read(d, t), {"media_bytes", "feature"}),
        "media": (lambda d: flac.encode_flac(d, t), {"media"}),
        "suffix_dedup": (lambda d: suffix_dedup.repeated_bytes(d, i, t), {"n_removed", "spans"}),
    }


NAMES = ["near_dup", "url_rules", "quality_model", "language_id", "quality_rules", "secret_scan", "mixing", "sentencepiece",
         "flac", "media", "suffix_dedup"]
#: Only these give back other columns than their inputs.
ALONE = {"suffix_dedup"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", NAMES)
def test_any_names(spark, rows, name):
    plain, added = operators(spark)[name]
    odd = rows.toDF("_id", "meta.`text`", "_lang", "_Source").withColumns({
        "meta.x": F.lit(7), "_n": F.lit("n"), "C0": F.lit(0), "Block_No": F.lit(1), "COPY": F.lit(2), "_row": F.lit(3)})
    for c in sorted(added):
        odd = odd.withColumn(c.upper(), F.lit("clash"))
    other, _ = operators(spark, "_id", "meta.`text`", "_lang", "_Source")[name]
    want, got = plain(rows), other(odd)
    assert added <= set(got.columns) and not {c.upper() for c in added} & set(got.columns) - added
    if name not in ALONE:
        assert {"meta.x", "_n", "C0", "_row", "_id"} <= set(got.columns)
    columns = [c for c in want.columns if c not in ("doc_id", "text", "lang", "source")]
    first, second = ([str(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()] for df in (want, got))
    assert len(first) == len(ROWS) and Counter(first) == Counter(second)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, rows, name):
    assert operators(spark)[name][0](rows.limit(0)).count() == 0


def test_copies_and_blocks_with_clashing_names(spark, rows):
    mixed = mixing.mix(rows.withColumn("Copy", F.lit("x")))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "copy"]
    assert mixed.count() == sum(r.copies for r in mixing.plan_mix(rows).collect())
    stored = flac.encode_flac(rows).withColumn("Block_No", F.lit("x"))
    assert flac.decode_flac(stored).columns.count("block_no") == 1 and "Block_No" not in flac.decode_flac(stored).columns
    coded = sentencepiece_tokens.encode_tokens(rows).withColumnRenamed("ids", "a.b")
    back = sentencepiece_tokens.decode_tokens(coded, "a.b", "decoded.text").collect()
    assert Counter(r["decoded.text"] for r in back) == Counter(r.text for r in back)


def test_null_ids_are_held_out(spark, rows):
    from marketloom.llm.queries import _held_out

    assert [r[0] for r in rows.where("doc_id is null").select(_held_out()).collect()] == [True]
