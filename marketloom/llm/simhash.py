"""Near-duplicates by SimHash: fingerprints that differ in few bits, found by Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import ranges, text_sizes
from ._names import Named
from ._scratch import materialize
from .components import connected_components
from .golay import fuzzy_keys

#: Fingerprints of a bucket that are compared with each other; larger buckets take midpoints.
MOST_PAIRED = 64
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
_U = np.uint64
_ONES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the XXH64 of its shingles.

    Words are runs of bytes other than white space, A-Z lower-cased; shingles, with
    repeats, are ``shingle_words`` words joined by one blank (all of them, if fewer).
    Without words it is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - size + 1
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, total, PIECE):
        cut = map(slice, starts[k:min(k + PIECE, total)].tolist(), ends[k + size - 1:min(k + PIECE, total) + size - 1].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(seed)), dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(_ONES[2 * set_bits > total].sum(dtype=np.uint64))


def _prints(text_col: str, columns: list[str], size: int, seed: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column(text_col))):
                piece = batch.slice(a, b - a)
                texts = piece.column(text_col).cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t or b"", size, seed) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in columns), pa.array(found.view(np.int64))], names=[*columns, "fp"])
    return prints


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): keys of 64-bit fingerprints, of which two that differ in at most
    two bits share one.

    The bits are cut into segments A and B (23 each) and C (18).  If C has no error, A
    or B has at most one: the key is C as it is and a codeword near A, or near B.  If C
    has errors, A and B have at most one together: the key is one of them as it is and a
    codeword near the other.
    """
    first, second, third = (prints >> _U(at) & _U((1 << bits) - 1) for at, bits in ((0, 23), (23, 23), (46, 18)))
    near = [fuzzy_keys(s.astype(np.int64)) for s in (first, second)]
    position, key = [], []
    for family, (same, by) in enumerate(((third, 0), (third, 1), (second, 0), (first, 1))):
        at, index = near[by]
        position.append(at)
        key.append(family << 35 | same.astype(np.int64)[at] << 12 | index)
    return np.concatenate(position), np.concatenate(key)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        at, key = bucket_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"])


def _linked(bits: int):
    """Pairs within each bucket (a list of at most MOST_PAIRED fingerprints) that differ in few bits."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for k in np.unique(sizes):
                rows = flat[begin[sizes == k][:, None] + np.arange(k)]
                for i in range(0, len(rows), max(1, (1 << 18) // (k * k))):
                    part = rows[i:i + max(1, (1 << 18) // (k * k))]
                    differ = np.bitwise_count((part[:, :, None] ^ part[:, None, :]).view(np.uint64))
                    which, x, y = np.nonzero((differ <= bits) & np.tri(k, k=-1, dtype=bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[which, x]), pa.array(part[which, y])], names=["a", "b"])
    return linked


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint, as it is and with one bit changed."""
    flips = np.concatenate((np.zeros(1, dtype=np.uint64), _ONES))
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 1 << 12):
            part = fp[i:i + (1 << 12)]
            mid = (part.view(np.uint64)[:, None] ^ flips).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, len(flips)))], names=["mid", "fp"])


def link_fingerprints(prints: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, long) that differ in at
    most two bits, enough for their components.

    Fingerprints that share a key are candidates.  A bucket of up to ``most_paired`` is
    compared pair by pair.  The fingerprints of larger buckets are filed under all words
    within one bit instead: two within two bits share such a midpoint, at most 65 share
    one and all of them are linked, so no bucket is ever compared as a whole and no link
    is left out.
    """
    keyed = materialize(prints.select("fp").mapInArrow(_keyed, "key long, fp long"))
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = (keyed.join(counts.where(F.col("n") <= most_paired), "key").groupBy("key").agg(F.collect_list("fp").alias("fps")))
    links = buckets.select("fps").mapInArrow(_linked(2), "a long, b long")
    crowded = counts.where(F.col("n") > most_paired)
    if crowded.isEmpty():
        return links.distinct()
    open_ = keyed.join(crowded.select("key"), "key", "left_semi").select("fp").distinct()
    around = open_.mapInArrow(_midpoints, "mid long, fp long").groupBy("mid").agg(F.collect_list("fp").alias("fps"))
    starred = (around.where(F.size("fps") > 1).select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
               .where("a <> b").select("a", "b"))
    return links.unionByName(starred).distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       seed: int = 42, carry: Sequence[str] | None = None, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most two bits.

    Adds ``fingerprint`` (16 lower-case hex digits) and ``component_id``, the smallest id
    reachable over links.  ``carry`` names the columns to keep, all by default.

    Equal fingerprints are one node, so groups of exact copies cost one row.  Nodes are
    linked through Golay-code keys (``bucket_keys``, ``link_fingerprints``).

    Null, empty and wordless texts have fingerprint zero and are linked like any other.
    A null id is no group's smallest; a group of null ids only has a null component.
    Repeated rows are documents of their own with the same result.  An empty table gives
    an empty result.  Columns may have any names; those with the names of the two new
    ones are replaced.  Very long texts are worked on in pieces.
    """
    named = Named(docs, ["fingerprint", "component_id"], carry)
    id_col, text_col = named.plain(id_col), named.plain(text_col)
    columns = list(dict.fromkeys([*named.kept, id_col]))
    schema = T.StructType([*[T.StructField(c, named.df.schema[c].dataType, True) for c in columns], T.StructField("fp", T.LongType())])
    read = named.df.select(*dict.fromkeys([*columns, text_col]))
    rows = materialize(read.mapInArrow(_prints(text_col, columns, shingle_words, seed), schema))
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(link_fingerprints(nodes, most_paired)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = roots.select("root").distinct()
    grouped = placed.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    whole = placed.join(grouped, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(whole, "fp")
    return named.back(out, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
