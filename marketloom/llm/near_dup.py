"""Near-duplicate documents: SuperMinHash, banding, verification, union-find."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import GOLDEN, Words, mix64, ranges, shingles, slices, text_sizes
from ._names import Named
from ._scratch import materialize
from .components import connected_components

#: Signature length and rows of a band.  Two sets of similarity 0.8 share no band of 42
#: with probability (1 - 0.8**6)**42 = 3e-6, and those of similarity 0.85 with 2e-9.
SLOTS, BAND_ROWS = 252, 6
#: Further classes of a bucket that others are compared with; rows of a bucket's block.
PICKS, BLOCK_ROWS = 8, 1024
#: Shingles of a bucket's block, which bounds it where texts are long.
BLOCK_SHINGLES = 1 << 22
#: Where a row is in the blocks of a bucket.
PLACE = ["h", "bi", "bj", "block", "t", "p", "root", "n"]
#: Elements whose permutations are held at once (504 bytes each).
CHUNK = 1 << 15
_EMPTY = np.iinfo(np.uint64).max


def _signatures(items: np.ndarray, owner: np.ndarray, count: int, slots: int) -> np.ndarray:
    """Signatures of ``count`` sets together; ``owner`` says whose an element is."""
    out = np.full((count, slots), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    low, perm, rows = np.uint64(0xFFFFFFFF), None, None
    for rank in range(slots):
        draw = mix64(items + np.array(rank + 1, dtype=np.uint64) * GOLDEN)
        pick = (rank + (((draw & low) * np.uint64(slots - rank)) >> np.uint64(32))).astype(np.int64)
        slot = pick if rank == 0 else perm[rows, pick].astype(np.int64)
        np.minimum.at(flat, owner * slots + slot, (draw >> np.uint64(32)) | np.uint64(rank << 32))
        stay = (out == _EMPTY).any(axis=1)[owner]
        if not stay.any():
            break
        if rank == 0:
            pick, perm = pick[stay], np.tile(np.arange(slots, dtype=np.int16), (int(stay.sum()), 1))
            perm[np.arange(len(pick)), pick] = 0
        else:
            perm[rows, pick] = perm[:, rank]
            perm = perm[stay]
        items, owner = items[stay], owner[stay]
        rows = np.arange(len(items))
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, one row per set.

    Each element ranks the slots by its own random permutation and offers
    ``rank + fraction`` to each; a slot keeps the least offer.  Rank ``j`` is offered by
    all elements of some sets at once.  A later rank can't beat an earlier one, so a set
    leaves as soon as its slots are filled.  The value is ``rank << 32 | fraction``.

    ``CHUNK`` elements at most are worked on at once, as each has a permutation; the
    signature of a larger set is the least of those of its parts.
    """
    out = np.full((len(sets), slots), _EMPTY, dtype=np.uint64)
    pieces = [(i, s[k:k + CHUNK]) for i, s in enumerate(sets) for k in range(0, len(s), CHUNK)]
    for a, b in ranges([len(p) for _, p in pieces], CHUNK):
        which = np.array([i for i, _ in pieces[a:b]])
        items = np.concatenate([p for _, p in pieces[a:b]])
        owner = np.repeat(np.arange(b - a), [len(p) for _, p in pieces[a:b]])
        np.minimum.at(out, which, _signatures(items, owner, b - a, slots))
    return out


def _bands(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    n = signatures.shape[1] // rows
    out = np.empty((len(signatures), n), dtype=np.uint64)
    for band in range(n):
        h = np.full(len(signatures), band, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            h = mix64(h * GOLDEN ^ signatures[:, k])
        out[:, band] = h
    return out.view(np.int64)


def text_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    out = []
    for a, b in slices(texts):
        found, at = shingles(Words([t.lower() for t in texts[a:b]]), size)
        out += [np.unique(found[at[i]:at[i + 1]]) for i in range(b - a)]
    return out


def _sketch(text_col: str, size: int, columns: list[str]):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column(text_col))):
                piece = batch.slice(a, b - a)
                sets = text_sets([t or b"" for t in piece.column(text_col).cast(pa.binary()).to_pylist()], size)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = super_minhash([sets[i] for i in full])
                bands, small = _bands(signed).tolist(), (signed & np.uint64(0xFF)).astype(np.uint8)
                prints: list = [None] * len(sets)
                rows: list = [None] * len(sets)
                brief: list = [None] * len(sets)
                for k, i in enumerate(full):
                    prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    rows[i], brief[i] = bands[k], small[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in columns]
                    + [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
                       pa.array(rows, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                    names=[*columns, "_n", "_print", "_bands", "_sig"])
    return sketch


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the one shuffle that moves them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        body = [pack(t.as_buffer() or b"") for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], names=["p", "body"])


def _alike(least: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8)
                        .reshape(batch.num_rows, -1) for c in ("_sig_a", "_sig_b"))
                keep = (a == b).sum(axis=1) >= least
                yield batch.filter(pa.array(keep)).select(["a", "b"])
    return alike


def _confirm(size: int, num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            a, b = ([open_(x) for x in batch.column(c).to_pylist()] for c in ("body_a", "body_b"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(text_sets(a, size), text_sets(b, size), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.filter(pa.array(keep)).select(["a", "b"])
    return confirm


def _survivors(rows: pa.Table, least: float, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of one bucket (or of two of its blocks) that full sets decide.

    They are in different components, of like size and signature, and share no earlier
    band (else another bucket has them).
    """
    block, p, root, n = (rows.column(c).to_numpy() for c in ("block", "p", "root", "n"))
    band, first, last = rows.column("t")[0].as_py(), rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
    sig, keys = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=d).reshape(len(p), -1)
                 for c, d in (("sig", np.uint8), ("keys", np.int64)))
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == last)
    for k in range(0, len(left), 256):
        i = left[k:k + 256]
        near = root[i][:, None] != root[right][None, :]
        near &= den * np.minimum(n[i][:, None], n[right][None, :]) >= num * np.maximum(n[i][:, None], n[right][None, :])
        if first == last:
            near &= p[i][:, None] > p[right][None, :]
        at, to = np.nonzero(near)
        for c in range(0, len(at), 1 << 14):
            x, y = i[at[c:c + (1 << 14)]], right[to[c:c + (1 << 14)]]
            good = (sig[x] == sig[y]).sum(axis=1) >= least
            x, y = x[good], y[good]
            new = ~(keys[x, :band] == keys[y, :band]).any(axis=1)
            yield x[new], y[new]


def _sift(least: float, num: int, den: int):
    """Rows of a group that are in any surviving pair, without signatures and keys."""
    def sift(rows: pa.Table) -> pa.Table:
        wanted = np.zeros(rows.num_rows, dtype=bool)
        for x, y in _survivors(rows, least, num, den):
            wanted[x] = wanted[y] = True
        return rows.filter(pa.array(wanted)).select(PLACE)
    return sift


def _link(least: float, size: int, num: int, den: int):
    """Links between the components of a group: its surviving pairs confirmed on full sets.

    A link joins its components at once, so that of the links found none closes a circle.
    """
    def link(rows: pa.Table) -> pa.Table:
        p, root, n = (rows.column(c).to_numpy() for c in ("p", "root", "n"))
        body, open_ = rows.column("body"), zstandard.ZstdDecompressor().decompress
        sets: dict[int, np.ndarray] = {}
        above: dict[int, int] = {}
        found = []

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = text_sets([open_(body[i].as_py())], size)[0]
            return sets[i]

        def top(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        for x, y in _survivors(rows, least, num, den):
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                r, q = top(int(root[u])), top(int(root[v]))
                if r != q:
                    both = len(np.intersect1d(set_of(u), set_of(v), assume_unique=True))
                    if den * both >= num * (int(n[u]) + int(n[v]) - both):
                        above[max(r, q)] = min(r, q)
                        found.append((int(max(p[u], p[v])), int(min(p[u], p[v]))))
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate("ab")})
    return link


def _each_group(work):
    """``work`` on each group of partitions sorted by bucket and blocks: a group is
    complete when the next begins."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table) -> list[int]:
            h, i, j = (table.column(c).to_numpy() for c in ("h", "bi", "bj"))
            new = (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            return [0, *(np.flatnonzero(new) + 1).tolist(), len(h)]

        def results(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            for x, y in zip(bounds, bounds[1:], strict=False):
                if y > x + 1:
                    yield from work(table.slice(x, y - x)).to_batches()

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
                bounds = groups(table)
                yield from results(table, bounds[:-1])
                held = table.slice(bounds[-2])
        if held is not None:
            yield from results(held, groups(held))
    return each


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 5, threshold: tuple[int, int] = (80, 100), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Group documents whose shingle sets are alike; adds four columns to ``docs``.

    ``n_shingles`` (size of the set), ``component_id`` (smallest id reachable over links),
    ``kept`` (id = component_id) and ``representative`` (true in exactly one row of each
    group, also where ids repeat).  Two documents are linked if
    ``den * |A & B| >= num * |A | B|`` for their sets of distinct ``shingle_words``-word
    shingles, ``threshold = (num, den)``; shorter texts have one shingle, all their words.

    Steps: texts with equal sets are one class.  Classes that share a band are
    candidates.  In each bucket they are first compared with the class that shares the
    most buckets with others, then those of other components with a few more.  What is
    left, the pairs of a bucket whose components still differ, is compared inside tasks,
    block by block (of ``block_rows``): first by signature alone, then by the texts of
    those rows that are in a surviving pair, and only links that join components leave
    the tasks.  So a large group never makes all its pairs, and no candidate is left out.
    Links are confirmed on full sets.

    Null or wordless texts have an empty set: linked with nothing, their own id as
    component.  A null id is no group's smallest id unless the group has no other.
    Repeated rows are members of one class.  An empty table gives an empty result.
    Columns may have any names; those with the names of the four new ones are replaced.
    """
    num, den = threshold
    added = ["n_shingles", "component_id", "kept", "representative"]
    named = Named(docs, added)
    id_col, text_col = named.plain(id_col), named.plain(text_col)
    columns = list(dict.fromkeys([*named.kept, id_col, text_col]))
    schema = T.StructType([
        *[T.StructField(c, named.df.schema[c].dataType, True) for c in columns],
        T.StructField("_n", T.LongType()), T.StructField("_print", T.BinaryType()),
        T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_sig", T.BinaryType()),
    ])
    rows = materialize(
        named.df.mapInArrow(_sketch(text_col, shingle_words, columns), schema)
        .withColumn("_row", F.monotonically_increasing_id())  # stable, as it is written here
    )
    sketched = rows.where("_print is not null")
    first = sketched.groupBy("_print").agg(F.min("_row").alias("_row"))
    classes = materialize(
        sketched.select(F.col("_row").alias("p"), F.col("_n").alias("n"), "_sig", "_bands")
        .join(first.select(F.col("_row").alias("p")), "p", "left_semi"))
    bands = classes.select("p", F.posexplode("_bands").alias("t", "h"))
    counts = bands.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialize(bands.join(counts, "h"))  # buckets of two classes or more
    degrees = shared.groupBy("p").agg(F.sum("k").alias("deg"))
    packed = rows.select("_row", text_col).mapInArrow(_pack, "p long, body binary")
    nodes = materialize(packed.join(classes.join(degrees, "p"), "p"))
    buckets = materialize(shared.join(nodes.select("p", "n", "deg"), "p").select("h", "t", "p", "n", "deg"))
    like = (F.col("n") * den >= num * F.col("n_b")) & (F.col("n_b") * den >= num * F.col("n"))
    least = SLOTS * num / den - 4.5 * math.sqrt(SLOTS * (num / den) * (1 - num / den))

    def side(name: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("p").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a", "_sig"), "a").join(side("b", "_sig"), "b")
        return both.select("a", "b", "_sig_a", "_sig_b").mapInArrow(_alike(least), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a", "body"), "a").join(side("b", "body"), "b")
        return materialize(both.select("a", "b", "body_a", "body_b").mapInArrow(
            _confirm(shingle_words, num, den), "a long, b long"))

    def still_open(roots: DataFrame) -> DataFrame:
        named = (buckets.join(roots.withColumnRenamed("node", "p"), "p", "left")
                 .withColumn("root", F.coalesce("root", "p")))
        mixed = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k"), F.sum("n").alias("in_all"))
        return materialize(named.join(mixed.where("x <> y").select("h", "k", "in_all"), "h"))

    def with_more(links: DataFrame, roots: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and roots with further links; where there are none, all stays as it is."""
        if new.isEmpty():
            return links, roots
        return links.unionByName(new), connected_components(links.unionByName(new))

    hubs = buckets.groupBy("h").agg(F.min(F.struct((-F.col("deg")).alias("d"), "p", "n")).alias("m"))
    stars = materialize(
        buckets.join(hubs.select("h", F.col("m.p").alias("b"), F.col("m.n").alias("n_b")), "h")
        .where((F.col("p") != F.col("b")) & like).select(F.col("p").alias("a"), "b").distinct())
    links = confirmed(alike(stars))
    roots = connected_components(links)

    rest = still_open(roots)
    picks = rest.groupBy("h").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("p", F.lit(k)).alias("r"), "p", "n", "root"))
        .getField("p").alias(f"p{k}") for k in range(PICKS)])).alias("picks"))
    picked = (picks.select("h", F.explode("picks").alias("b"))
              .join(rest.select("h", F.col("p").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b")), ["h", "b"]))
    tries = (rest.join(picked, "h").where((F.col("root") != F.col("root_b")) & like)
             .select(F.greatest("p", "b").alias("a"), F.least("p", "b").alias("b")).distinct())
    links, roots = with_more(links, roots, confirmed(alike(tries)))

    parts = F.ceil(F.greatest(F.col("k") / F.lit(block_rows), F.col("in_all") / F.lit(BLOCK_SHINGLES)))
    rest = still_open(roots).withColumn("nb", parts.cast("long")).withColumn("block", F.pmod(F.xxhash64("p"), "nb"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select(
        "h", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "t", "p", "root", "n")
    keyed = nodes.select("p", F.col("_sig").alias("sig"), F.unhex(F.expr(
        "array_join(transform(_bands, x -> lpad(hex(x), 16, '0')), '')")).alias("keys"), "body")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj")

    places = ", ".join(f"{c} {'int' if c == 't' else 'long'}" for c in PLACE)
    sifted = grouped(rest.join(keyed.drop("body"), "p").select(*PLACE, "sig", "keys")).mapInArrow(
        _each_group(_sift(least, num, den)), places)
    found = materialize(grouped(sifted.join(keyed, "p").select(*PLACE, "sig", "keys", "body")).mapInArrow(
        _each_group(_link(least, shingle_words, num, den)), "a long, b long"))
    links, roots = with_more(links, roots, found)

    brief_rows = rows.select("_row", "_print", F.col(id_col).alias("_id"))
    classed = first.select("_print", F.col("_row").alias("p")).join(
        roots.withColumnRenamed("node", "p"), "p", "left").select("_print", F.coalesce("root", "p").alias("_group"))
    brief_rows = brief_rows.join(classed, "_print", "left")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = brief_rows.where("_group is not null").groupBy("_group").agg(F.min(rank).alias("_first"))
    alone = F.col("_group").isNull()
    decided = brief_rows.join(groups, "_group", "left").select(
        "_row", alone.alias("_alone"), F.col("_first.id").alias("_first_id"),
        (alone | (F.col("_row") == F.col("_first.row"))).alias("representative"))
    whole = rows.select("_row", F.col("_n").alias("n_shingles"), *columns)
    out = whole.join(decided, "_row")
    component = F.when(F.col("_alone"), F.col(id_col)).otherwise(F.col("_first_id"))
    return named.back(out, "n_shingles", component.alias("component_id"),
                      F.col(id_col).eqNullSafe(component).alias("kept"), "representative")
