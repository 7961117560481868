"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import ranges, text_sizes
from ._names import Named
from ._scratch import materialize

#: N-grams of a profile, labelled documents used at most a language.
PROFILE, MAX_DOCS_PER_LANG = 300, 500
#: Ids of a sample (under 10 MB) that are broadcast.
BROADCAST_IDS = 200_000
UNDETERMINED = "und"
#: Symbols of the coded text besides letters, which are their code points; 0 ends a shorter n-gram.
_OTHER, _BLANK = 1, 32
POINT_BITS, POINTS = 21, 0x110000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a blank after each, and its owner."""
    low = [t.lower() for t in texts]
    points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])


@functools.cache
def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(POINTS)), dtype=bool, count=POINTS)


def count_grams(texts: list[str], letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, code, count) of every 1- to 3-gram of each text, by number and code.

    Whatever is no letter is a blank, blanks are joined.  A code is the n-gram's code
    points of ``POINT_BITS`` each.  With ``letters``, all others are one symbol.
    """
    points, owner = _codes(texts)
    is_letter = _is_letter()[points]
    symbol = np.where(is_letter, points, np.uint32(_BLANK))
    if letters is not None:
        symbol[is_letter & ~np.isin(points, letters)] = _OTHER
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != _BLANK) | (symbol[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    symbol, owner = symbol[keep], owner[keep]
    # Sorted by short codes, the ranks of these texts' own symbols, in the same order.
    seen = np.zeros(POINTS, dtype=bool)
    seen[symbol] = True
    kinds = np.append(0, np.flatnonzero(seen))
    bits = np.uint64((len(kinds) - 1).bit_length())
    if 3 * int(bits) + len(texts).bit_length() > 64 and len(texts) > 1:
        half = len(texts) // 2
        one, two = count_grams(texts[:half], letters), count_grams(texts[half:], letters)
        return np.concatenate((one[0], two[0] + half)), np.concatenate((one[1], two[1])), np.concatenate((one[2], two[2]))
    rank = np.zeros(POINTS, dtype=np.uint32)
    rank[kinds] = np.arange(len(kinds))
    letter, symbol = symbol != _BLANK, rank[symbol].astype(np.uint64)
    one = (owner.astype(np.uint64) << bits | symbol) << bits + bits
    two = one[:-1] | symbol[1:] << bits
    three = two[:-1] | symbol[2:]
    every = np.sort(np.concatenate([
        one[letter], two[owner[1:] == owner[:-1]], three[(owner[2:] == owner[:-2]) & letter[1:-1]]]))
    first = np.flatnonzero(np.concatenate((np.ones(min(len(every), 1), dtype=bool), every[1:] != every[:-1])))
    count, every = np.diff(np.append(first, len(every))), every[first]
    gram, mask = np.zeros(len(every), dtype=np.int64), (np.uint64(1) << bits) - np.uint64(1)
    for shift in (bits + bits, bits, np.uint64(0)):
        gram = gram << POINT_BITS | kinds[(every >> shift & mask).astype(np.int64)]
    return (every >> np.uint64(3) * bits).astype(np.int64), gram, count


def top_grams(texts: list[str], letters: np.ndarray | None = None, size: int = PROFILE) -> list[np.ndarray]:
    """The most frequent n-grams of each text, best first (of equals the least code)."""
    whose, gram, count = count_grams(texts, letters)
    top = int(count.max(initial=0))
    gram = gram[np.argsort(whose * (top + 1) + (top - count), kind="stable")]
    bounds = np.searchsorted(whose, np.arange(len(texts) + 1))
    return [gram[bounds[i]:min(bounds[i] + size, bounds[i + 1])] for i in range(len(texts))]


class Profiles:
    """Rank of each n-gram in each language; out-of-place distance of documents."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.grams, self.langs = grams, sorted(grams)
        self.known = np.unique(np.concatenate([np.asarray(g, dtype=np.int64) for g in grams.values()] or [np.empty(0, np.int64)]))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.known, grams[lang])] = np.arange(len(grams[lang]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Sum over the document's n-grams of how far each is out of place, per language;
        an n-gram that a profile lacks counts PROFILE.  Divided by the most possible."""
        at = np.searchsorted(self.known, grams)
        inside = at < len(self.known)
        at = np.where(inside, at, 0)
        hit = inside & (self.known[at] == grams)
        rank = np.where(hit, self.rank[:, at], -1)
        out = np.where(rank >= 0, np.abs(rank - np.arange(len(grams))), PROFILE)
        return out.sum(axis=1) / max(PROFILE * len(grams), 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS_PER_LANG) -> Profiles:
    """Profiles from at most ``max_docs`` documents of each language, those with the
    least id hashes; null texts and languages are left out.

    Each task keeps no more than ``max_docs`` rows of a language before the shuffle
    (a row-number filter, which Spark pushes below it); n-grams of the sample, by code
    points without an alphabet, are counted by Spark.  One row per language comes back.
    """
    order = Window.partitionBy("lang").orderBy("h", "i")
    ids = (labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
           .select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(lang_col).alias("lang"))
           .withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_docs)
           .select(F.col("i").alias(id_col), F.col("lang").alias(lang_col)).distinct())
    ids = materialize(ids)
    few = ids.count() <= BROADCAST_IDS  # max_docs a language; with very many languages, a shuffled join
    sample = labelled.join(F.broadcast(ids) if few else ids, [id_col, lang_col], "left_semi").where(F.col(text_col).isNotNull())
    sample = materialize(sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column(1)), 500_000):
                langs, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()
                whose, gram, count = count_grams(texts)
                yield pa.RecordBatch.from_arrays(
                    [langs.cast(pa.string()).take(pa.array(whose)), pa.array(gram), pa.array(count, pa.int64())],
                    names=["lang", "gram", "n"])

    grams = sample.mapInArrow(grams_of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PROFILE)
    found: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "k").collect():  # PROFILE rows a language
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({lang: np.array(g, dtype=np.int64) for lang, g in found.items()})


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs``.

    The language with the least out-of-place distance, of equals the first by code
    point; ``score`` is the margin to the next one, from 0 to 1 (1 if there is no other).
    ``und`` with score 0 if the text is null or has no letter, or no language was
    learned.  Texts are read whole.  Repeated rows get equal values.  Columns may have
    any names; those with the names of added ones are replaced.
    """
    named = Named(docs, ["lang_pred", "score"])
    text_col, columns = named.plain(text_col), named.kept
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            first = 0
            while first < len(texts):
                last, total = first, 0
                while last < len(texts) and (last == first or total + len(texts[last]) < 500_000):
                    total += len(texts[last])
                    last += 1
                for i, grams in enumerate(top_grams(texts[first:last]), first):
                    if model.langs and has_letter(texts[i]):
                        d = model.distances(grams)
                        order = np.argsort(d, kind="stable")
                        names[i] = model.langs[order[0]]
                        gap = d[order[1]] - d[order[0]] if len(order) > 1 else 1.0
                        scores[i] = round(float(gap / max(d[order[1]], 1e-9)), 6) if len(order) > 1 else 1.0
                first = last
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*columns, "lang_pred", "score"])

    schema = T.StructType(named.fields() + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return named.back(named.df.mapInArrow(apply, schema), "lang_pred", "score")
