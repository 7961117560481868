"""Ranked lexical search: the best documents of each item, by dual-tree search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import ranges, text_sizes
from ._names import Named
from ._scratch import materialize, small

#: Documents of a tree; its nodes hold at most so many, from the leaves up.
BLOCK, NODES = 4096, (1, 8, 64, 512)
#: Bytes of items that are searched for in one pass.
ITEM_BYTES = 8 << 20
_LEAST = np.iinfo(np.int64).min


def _table() -> bytes:
    """Bytes of terms with A-Z lower-cased; all others are blanks."""
    term = [c >= 0x80 or chr(c).isalnum() for c in range(256)]
    return bytes(ord(chr(c).lower()) if c < 0x80 and term[c] else c if term[c] else 0x20 for c in range(256))


TABLE = _table()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(TABLE).split()


@dataclass
class Sparse:
    """Rows of (column, value) entries, one after the other; ``at`` is where each begins."""

    at: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of some rows: position in ``which``, column, value."""
        sizes = self.at[which + 1] - self.at[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        take = np.arange(len(owner)) + np.repeat(self.at[which] - (np.cumsum(sizes) - sizes), sizes)
        return owner, self.column[take], self.value[take]

    def maxima(self, node: np.ndarray, count: int) -> Sparse:
        """Coordinate maxima of rows that are put into nodes."""
        owner = node[np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))]
        order = np.lexsort((-self.value, self.column, owner))
        owner, column, value = owner[order], self.column[order], self.value[order]
        first = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(column) != 0)))[:len(owner)]
        owner, column, value = owner[first], column[first], value[first]
        return Sparse(np.searchsorted(owner, np.arange(count + 1)), column, value)


@dataclass
class ItemNode:
    """A node over items: coordinate maxima of the counts of their terms."""

    items: np.ndarray
    column: np.ndarray
    count: np.ndarray
    children: list[ItemNode] = field(default_factory=list)


def item_tree(counts: list[dict[int, int]], weight: np.ndarray) -> ItemNode | None:
    """Binary tree over items (term -> count): each half gathers the items that share
    more weight with the one of two distant items that heads it."""
    def shared(head: dict[int, int], items: np.ndarray) -> np.ndarray:
        return np.array([sum(int(weight[t]) for t in counts[i] if t in head) for i in items])

    def node(items: np.ndarray) -> ItemNode:
        most: dict[int, int] = {}
        for i in items:
            for t, c in counts[i].items():
                most[t] = max(most.get(t, 0), c)
        column = np.fromiter(sorted(most), dtype=np.int64, count=len(most))
        out = ItemNode(items, column, np.array([most[t] for t in column.tolist()], dtype=np.int64))
        if len(items) > 1:
            one = items[shared(counts[items[0]], items).argmin()]
            to_one = shared(counts[one], items)
            other = items[to_one.argmin()]
            lead = to_one - shared(counts[other], items)
            order = np.argsort(-lead, kind="stable")
            cut = min(max(int((lead > 0).sum()), len(items) // 4, 1), len(items) - max(len(items) // 4, 1))
            out.children = [node(items[np.sort(order[:cut])]), node(items[np.sort(order[cut:])])]
        return out

    full = np.array([i for i, c in enumerate(counts) if c], dtype=np.int64)
    return node(full) if len(full) else None


class Search:
    """The best ``top`` documents of each item so far, over blocks of documents."""

    def __init__(self, tree: ItemNode | None, items: int, terms: int, top: int):
        self.tree, self.top = tree, top
        self.best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # the score a document needs at least
        self.query = np.zeros(terms, dtype=np.int64)
        self.scored = 0

    def add(self, ids: np.ndarray, docs: Sparse) -> None:
        """Search a block: documents with like leading terms go into the same nodes."""
        if self.tree is None or not len(ids):
            return
        owner = np.repeat(np.arange(len(ids)), np.diff(docs.at))
        order = np.lexsort((docs.column, -docs.value, owner))
        lead = np.full((len(ids), 3), -1, dtype=np.int64)
        sizes = np.diff(docs.at)
        for k in range(3):
            has = sizes > k
            lead[has, k] = docs.column[order[docs.at[:-1][has] + k]]
        place = np.empty(len(ids), dtype=np.int64)
        place[np.lexsort((lead[:, 2], lead[:, 1], lead[:, 0]))] = np.arange(len(ids))
        self.ids = np.empty_like(ids)
        self.ids[place] = ids
        self.levels = [docs.maxima(place // size, (len(ids) - 1) // size + 1) for size in NODES]
        self._visit(self.tree, len(NODES) - 1, np.arange(len(self.levels[-1].at) - 1))

    def _visit(self, node: ItemNode, level: int, nodes: np.ndarray) -> None:
        """Compare a node of items with nodes of documents.  No score of a pair below
        them is above the product of their maxima; if that is less than the weakest kth
        score of these items, all their pairs go at once."""
        owner, column, value = self.levels[level].rows(nodes)
        self.query[node.column] = node.count
        bounds = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(bounds, owner, value * self.query[column])
        self.query[node.column] = 0
        alive = bounds >= self.least[node.items].min()
        nodes, bounds = nodes[alive], bounds[alive]
        if not len(nodes):
            return
        if level == 0 and not node.children:  # one item, single documents: the bound is the score
            self.scored += len(nodes)
            self._keep(int(node.items[0]), bounds, self.ids[nodes])
            return
        if level:
            step = NODES[level] // NODES[level - 1]
            nodes = (nodes[:, None] * step + np.arange(step)).reshape(-1)
            nodes = nodes[nodes < len(self.levels[level - 1].at) - 1]
            level -= 1
        for child in node.children or [node]:
            self._visit(child, level, nodes)

    def _keep(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[item][0], scores]), np.concatenate([self.best[item][1], ids])
        order = np.lexsort((ids, -scores))[:self.top]
        self.best[item] = scores[order], ids[order]
        if len(order) == self.top:
            self.least[item] = scores[order[-1]]


def _vectors(text_col: str, id_col: str, vocabulary: dict[bytes, int]):
    """(id, number of terms, ids of the items' terms in the text, how often each occurs)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column(text_col))):
                piece = batch.slice(a, b - a)
                n, found = [], []
                for text in piece.column(text_col).cast(pa.binary()).to_pylist():
                    words = terms_of(text or b"")
                    n.append(len(words))
                    known = [k for k in map(vocabulary.get, words) if k is not None]
                    found.append(np.unique(np.array(known, dtype=np.int32), return_counts=True))
                offsets = pa.array(np.cumsum([0, *(len(t) for t, _ in found)]), pa.int32())
                terms, tf = (pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tf)],
                    schema=schema)
    return vectors


def impacts(n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to the score of a document, in integers."""
    factor = 100 - 25 + (25 * n * docs) // max(length, 1)
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(factor, np.diff(at))))


def _search(tree: ItemNode | None, items: int, weight: np.ndarray, docs: int, length: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(tree, items, len(weight), top)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(i, BLOCK)
                sizes = piece.column("terms").value_lengths().to_numpy()
                at = np.concatenate(([0], np.cumsum(sizes)))
                term, tf = (piece.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                value = impacts(piece.column("n").to_numpy(), at, term, tf, weight, docs, length)
                found.add(piece.column("id").fill_null(_LEAST).to_numpy(), Sparse(at, term, value))
        sizes = [len(s) for s, _ in found.best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(items), sizes), pa.int64()), *(pa.array(np.concatenate([b[k] for b in found.best]), pa.int64()) for k in (1, 0))],
                names=["item", "doc_id", "score"])
    return search


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``top`` documents of each item by BM25 in integers: item, rank, doc_id, score.

    With N documents that have terms, L terms in all, n terms in a document, df documents
    that hold a term and tf its occurrences in the document, a term weighs
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; with ``m = 75 + (25 n N) div L`` a
    document's score is the sum of ``w * ((10**9 tf) div (1000 tf + 12 m))`` over the
    item's terms, repeats included.  Documents with a score above 0 are ranked by it,
    then by id.

    Each pass over the documents searches for a block of items of about ``item_bytes``,
    which goes to all tasks as a tree; the number of passes grows with the items only.
    Texts are read once a pass: (terms of the items, occurrences) of each document are
    stored, the statistics are aggregates of them.  In a task, ``BLOCK`` documents at a
    time form a tree, and both trees are descended together (``Search``).  A task
    returns ``top`` documents an item, so the ranking reads few rows whatever the texts.

    Null and empty texts have no terms and are never found; items without terms have no
    rows.  A null id of a document counts as the smallest and stays null; ids of
    documents are integers.  Each row of either table is one of its own, so repeated
    items repeat their result under their id, and repeated documents are ranked one after the
    other.  Empty tables give an empty result.  Further columns of any name are ignored.
    """
    d, q = Named(docs, [], [id_col, text_col]), Named(items, [], [item_col, item_text_col])
    id_col, text_col = d.plain(id_col), d.plain(text_col)
    asked = materialize(q.df.select(F.col(q.plain(item_col)).alias("name"), F.col(q.plain(item_text_col)).alias("text"))
                        .withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    spark = docs.sparkSession
    results = []
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").orderBy("row").collect()  # about item_bytes
        vocabulary: dict[bytes, int] = {}
        counts: list[dict[int, int]] = []
        for r in chosen:
            own: dict[int, int] = {}
            for t in terms_of((r["text"] or "").encode()):
                k = vocabulary.setdefault(t, len(vocabulary))
                own[k] = own.get(k, 0) + 1
            counts.append(own)
        read = d.df.select(id_col, text_col)
        vectors = materialize(read.mapInArrow(_vectors(text_col, id_col, vocabulary), "id long, n long, terms array<int>, tf array<int>"))
        size = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a term of the block
            df[r["t"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * k + 1))) for k in df.tolist()], dtype=np.int64)
        tree = spark.sparkContext.broadcast(item_tree(counts, weight))
        task = _broadcast_search(tree, len(chosen), weight, size["docs"], size["length"], top)
        found = vectors.where(F.size("terms") > 0).mapInArrow(task, "item long, doc_id long, score long")
        number = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(chosen)], "item long, row long")
        results.append(materialize(_best(found, top).join(F.broadcast(number), "item").drop("item")))  # as many rows as items of the block
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    doc = F.when(F.col("doc_id") != _LEAST, F.col("doc_id"))
    return out.join(small(asked.select("row", "name")), "row").select(
        F.col("name").alias(q.own(q.plain(item_col))), "rank", doc.alias(d.own(id_col)), "score")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _broadcast_search(tree, items: int, weight: np.ndarray, docs: int, length: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(tree.value, items, weight, docs, length, top)(batches)
    return search
