"""Repeated byte strings across documents, by suffix arrays over shared runs of windows."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import GOLDEN, mix64
from ._names import Named
from ._scratch import materialize
from .suffix_array import suffix_array

#: Length of a repeated string (a window) and of the core that windows are filed under.
LENGTH, CORE = 50, 24
#: Bytes of a window beside its core, and how often a core can grow: 24, 42, 48, 50 bytes.
SIDE, LEVELS = LENGTH - CORE, 3
#: Least and most bytes of a block of documents and of a bucket of cores.
LEAST_PART, MOST_PART = 4 << 20, 256 << 20
#: Distinct runs (counted per block) up to which a core has one group; beyond, it grows.
MAX_GROUP = 2000
#: Symbols that are sorted in one suffix array.
BATCH = 1 << 16
#: Greatest period and least length of a stretch that repeats itself.
MOST_PERIOD, LEAST_REPEAT = 13, 128
#: Windows whose places are looked for at once, and the bits of a place.
SPAN, PLACE = 1 << 15, 16
_U, _LAST = np.uint64, np.iinfo(np.int64).max
_PAD = bytes(64)


# --- runs of windows -------------------------------------------------------------------

def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]


def _hash(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes (eight at least) from each place."""
    h = size.astype(np.uint64) * GOLDEN
    for k in range(0, int(size.max(initial=0)), 8):
        go = slice(None) if k < size.min() else k < size
        h[go] = mix64(h[go] * GOLDEN ^ _words(data, at[go] + np.minimum(k, size[go] - 8)))
    return h


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the strings of ``size`` bytes from the places ``a`` and ``b`` equal?"""
    same = np.ones(len(a), dtype=bool)
    for k in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(k, size - 8)
        same &= _words(data, a + step) == _words(data, b + step)
    return same


class Runs:
    """Neighbouring windows of one text around the same core.

    The core of a window is chosen by its bytes alone: of its 27 places for a 24-byte
    string, the one with the least hash of eight bytes, the first of equals.  So equal
    windows have equal cores at equal places.  ``at`` is where the core stands in the
    texts put together; a window is named by how far it begins before that place, and a
    run has the windows from ``low`` to ``high``, ``part`` those of its range in
    ``parts(level)``.  All windows of a range have the bytes from ``at - first`` to
    ``at + 50 - last`` in common: the longer core of a deeper level.
    """

    def __init__(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, level: int):
        self.at, self.low, self.high, self.part, self.level = at, low, high, part, level
        first, last = np.array(parts(level)).T
        self.before, self.last = first[part], last[part]

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.at[which], self.low[which], self.high[which], self.part[which], self.level)

    @property
    def start(self) -> np.ndarray:
        return self.at - self.high

    @property
    def size(self) -> np.ndarray:
        return self.high - self.low + LENGTH

    def core(self) -> tuple[np.ndarray, np.ndarray]:
        return self.at - self.before, LENGTH + self.before - self.last

    def split(self) -> tuple[Runs, np.ndarray]:
        """The same windows around longer cores: each range falls into three."""
        some, level = [], self.level + 1
        first, last = np.array(parts(level)).T
        for third in range(3):
            part = 3 * self.part + third
            low, high = np.maximum(self.low, first[part]), np.minimum(self.high, last[part])
            has = low <= high
            some.append((self.at[has], low[has], high[has], part[has], np.flatnonzero(has)))
        *more, origin = (np.concatenate(c) for c in zip(*some, strict=True))
        return Runs(*more, level), origin


def parts(level: int) -> list[tuple[int, int]]:
    """Ranges of windows at a level: all 27, then thirds, down to single windows."""
    size = (SIDE + 1) // 3**level
    return [(k, k + size - 1) for k in range(0, SIDE + 1, size)]


def repeats(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period): stretches of one text in which every byte equals the one
    ``period`` bytes before, with the least period, of at most MOST_PERIOD.

    In a stretch each window but the first ``period`` ones equals an earlier one of its
    document, so it has its fate and needs no run.  (Otherwise a text of one byte would
    have a run for every byte.)  Long stretches are seen at every 64th place.
    """
    n, begins = (int(ends[-1]) if len(ends) else 0), np.append(0, ends[:-1])
    places, found = np.arange(0, max(n - 16 - MOST_PERIOD, 0), 64), []
    for period in range(1, MOST_PERIOD + 1):
        hit = places[(_words(data, places) == _words(data, places + period)) & (_words(data, places + 8) == _words(data, places + period + 8))]
        cut = np.flatnonzero(np.diff(hit) > 64) + 1
        for area in np.split(hit, cut) if len(hit) else []:
            low, high = max(int(area[0]) - 64, 0), min(int(area[-1]) + 128, n)
            same = np.concatenate(([False], data[low:high - period] == data[low + period:high], [False]))
            edge = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edge[::2] + low, edge[1::2] + low + period, strict=True):
                first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right")
                for k in range(first, last + 1) if b - a >= LEAST_REPEAT else ():
                    start, stop = max(a, begins[k]), min(b, ends[k])
                    if stop - start >= LEAST_REPEAT:
                        found.append((start, stop, period))
        if found:  # a stretch has the multiples of its period too
            start, stop = np.array(sorted(f[:2] for f in found)).T
            at = np.searchsorted(start, places, side="right") - 1
            places = places[(at < 0) | (places + 17 + period > stop[at])]
    return tuple(np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T)


def find_runs(data: np.ndarray, ends: np.ndarray, skip: tuple[np.ndarray, np.ndarray] | None = None) -> Runs:
    """Runs of the texts that stand in ``data`` one after another (and 64 bytes more),
    without the windows in the ranges ``skip``."""
    skip_from, skip_to = (np.empty(0, dtype=np.int64),) * 2 if skip is None else skip

    def skipped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is a window in a range, and where does this end?"""
        if not len(skip_from):
            return np.zeros(len(at), dtype=bool), at
        k = np.searchsorted(skip_from, at, side="right") - 1
        return (k >= 0) & (at < skip_to[k]), skip_to[k]

    n, width = (int(ends[-1]) if len(ends) else 0) - LENGTH + 1, SIDE + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return Runs(none, none, none, none, 0)
    low, index = np.uint32((1 << PLACE) - 1), np.arange(SPAN + width, dtype=np.uint32)
    changes, places, now = [], [], -1
    for begin in range(0, n, SPAN):
        some, size = min(SPAN, n - begin), 1
        within, until = skipped(np.array([begin]))
        if within[0] and until[0] >= begin + some:
            now = -1
            continue
        near = np.ndarray((some + width - 1,), "<u8", data, offset=begin, strides=(1,)) * GOLDEN
        least = ((near >> _U(32)).astype(np.uint32) & ~low) | index[:len(near)]
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        at = (np.minimum(least[:some], least[width - size:width - size + some]) & low).astype(np.int64) + begin
        new = np.flatnonzero(at[1:] != at[:-1]) + 1
        new = new if at[0] == now else np.append(0, new)
        within, until = skipped(new + begin)
        drop = within & (np.append(new[1:], some) + begin <= until)  # what follows is skipped as well
        changes.append(new[~drop] + begin)
        places.append(at[new[~drop]])
        now = -1 if len(drop) and drop[-1] else at[-1]
    first, at = np.concatenate(changes), np.concatenate(places)
    begins = np.append(0, ends[:-1])
    stops = np.maximum(ends - LENGTH + 1, begins)  # the first window that leaves its text
    cut = np.sort(np.concatenate((begins, stops, skip_from, skip_to)))
    cut = cut[np.append(True, cut[1:] != cut[:-1]) & (cut < n)]
    to = np.searchsorted(first, cut, side="right")
    new = first[to - 1] != cut
    first, at = np.insert(first, to[new], cut[new]), np.insert(at, to[new], at[to[new] - 1])
    last = np.append(first[1:], n) - 1
    inside = (first < stops[_owners(first, ends)]) & ~skipped(first)[0]
    first, last, at = first[inside], last[inside], at[inside]
    return Runs(at, at - last, at - first, np.zeros(len(at), dtype=np.int64), 0)


def _owners(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some places, in order, are."""
    return np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(places, ends), prepend=0))


# --- blocks and packed rows ------------------------------------------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = struct.unpack_from("<q", body, at)[0]
        out.append(np.frombuffer(body, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at + 8))
        at += 8 + size
    return out


_PACKED = "bucket int, block long, data binary"


def _packed(bucket: np.ndarray, block: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([block] * len(bucket), pa.int64()), pa.array(data, pa.binary())],
        names=["bucket", "block", "data"])


def _edges(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted bucket numbers: those that occur, and where each begins (and the end)."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, dtype=np.int64)
    return bucket[first].astype(np.int64), np.append(first, len(bucket))


def _to_blocks(most: int):
    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([body], pa.binary())], names=["ids", "sizes", "body"])

        ids, texts, total = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                t = text.as_py() or b""
                if ids and total + len(t) > most:
                    yield block(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(t)
                total += len(t)
        if ids:
            yield block(ids, texts)
    return to_blocks


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each holds a block."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Block:
    """A block's runs at a level: from its texts at the first one, later from a ``state``.

    ``key`` has hashes of the cores, ``owner`` ids of the documents (null ids become the
    greatest number: they are nobody's smaller id), ``place`` where a run starts in the block.
    """

    def __init__(self, row: dict, level: int, bits: int):
        self.number, self.bits = row["block"], bits
        if level:
            self.place, self.owner, *bounds, data = _unpack(row["state"], np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.uint8)
            low, high, part = (x.astype(np.int64) for x in bounds)
            self.data = np.frombuffer(data.tobytes() + _PAD, dtype=np.uint8)
            size = high - low + LENGTH
            self.runs = Runs(np.cumsum(size) - size + high, low, high, part, level)
        else:
            self.body = zstandard.ZstdDecompressor().decompress(row["body"])
            self.data, self.ends = np.frombuffer(self.body + _PAD, dtype=np.uint8), np.cumsum(row["sizes"], dtype=np.int64)
            self.repeats = repeats(self.data, self.ends)
            start, stop, period = self.repeats
            self.runs = find_runs(self.data, self.ends, (start + period, stop - LENGTH + 1))
            ids = np.array([_LAST if i is None else i for i in row["ids"]], dtype=np.int64)
            self.place = self.runs.start
            self.owner = ids[_owners(self.place, self.ends)]
        self.key = _hash(self.data, *self.runs.core()) ^ mix64(self.runs.part.astype(np.uint64))

    def bytes_of(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some runs together, and where each begins there (and the end)."""
        edge = np.append(0, np.cumsum(runs.size))
        return self.data[np.repeat(runs.start - edge[:-1], runs.size) + np.arange(edge[-1])], edge

    def state(self, which: np.ndarray) -> bytes:
        """Some runs around longer cores, as the next level gets them."""
        chosen = self.runs.take(which)
        more, origin = chosen.split()
        return _pack(self.place[which][origin] + more.start - chosen.start[origin], self.owner[which][origin],
                     *(x.astype(np.uint8) for x in (more.low, more.high, more.part)), self.bytes_of(more)[0])

    def collapse(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some runs in the order of (key, content), and which of these differ from the one
        before: equal hashes are confirmed on the bytes."""
        some = self.runs.take(which)
        order = np.lexsort((_hash(self.data, some.start, some.size) + some.low.astype(np.uint64), self.key[which]))
        some, which = some.take(order), which[order]
        new = np.ones(len(which), dtype=bool)
        if len(which) > 1:
            size = np.minimum(some.size[1:], some.size[:-1])
            new[1:] = ((self.key[which][1:] != self.key[which][:-1]) | (some.size[1:] != some.size[:-1])
                       | (some.low[1:] != some.low[:-1]) | (some.part[1:] != some.part[:-1])
                       | ~_equal(self.data, some.start[1:], some.start[:-1], size))
        return which, new

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the keys as they are listed (the bucket's bits and 32 more), these
        keys in it, and where each begins."""
        short = self.key >> _U(32 - self.bits)
        order = np.argsort(short)
        short = short[order]
        return order, short, np.flatnonzero(np.append(True, short[1:] != short[:-1])[:len(short)])

    def buckets(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _edges(key >> _U(64 - self.bits))

    def marks(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose cores other documents have: those of a group, and those whose cores grow."""
        order, short, first = self.listed()
        seeds = short[first]
        shared, many = np.zeros((2, len(seeds)), dtype=bool)
        known = {m["bucket"]: m["data"] for m in row["marks"] or []}
        bucket, edge = _edges(seeds >> _U(32))
        for k, b in enumerate(bucket.tolist()):
            if b in known:
                shared[edge[k]:edge[k + 1]], many[edge[k]:edge[k + 1]] = (
                    np.unpackbits(x, count=edge[k + 1] - edge[k]) for x in _unpack(known[b], np.uint8, np.uint8))
        count = np.diff(np.append(first, len(short)))
        return order[np.repeat(shared & ~many, count)], order[np.repeat(many, count)]


# --- steps -----------------------------------------------------------------------------

def _list_cores(level: int, bits: int):
    """Per block and bucket: its cores, which of them two of its documents have, and how
    many distinct runs each has (65,535 at most)."""
    def list_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, level, bits)
                order, s, first = b.listed()
                if not len(s):
                    continue
                count = np.diff(np.append(first, len(s)))
                owner = b.owner[order]
                twice = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                number = np.ones(len(first), dtype=np.int64)
                several = np.flatnonzero(np.repeat(count > 1, count))
                if len(several):  # only these can have equal runs
                    which, new = b.collapse(order[several])
                    at = np.searchsorted(s[first], b.key[which] >> _U(32 - bits))
                    number = np.where(count > 1, np.bincount(at, weights=new, minlength=len(first)).astype(np.int64), 1)
                number = np.minimum(number, 65535).astype(np.uint16)
                s = s[first]
                bucket, edge = _edges(s >> _U(32))
                yield _packed(bucket, b.number, [
                    _pack(np.diff(s[x:y].astype(np.uint32), prepend=np.uint32(0)), np.packbits(twice[x:y]), number[x:y])
                    for x, y in zip(edge, edge[1:], strict=False)])
    return list_cores


def _shared_cores(most: int | None):
    """Of one bucket: for each block, two bits per core: does another document have it, and
    has it more than ``most`` runs?  (None at the last level, where they are all equal.)"""
    def shared_cores(rows: pa.Table) -> pa.Table:
        lists = []
        for data in rows.column("data").to_pylist():
            step, twice, number = _unpack(data, np.uint32, np.uint8, np.uint16)
            lists.append((np.cumsum(step, dtype=np.uint32), np.unpackbits(twice, count=len(step)).astype(bool), number))
        every = np.concatenate([v for v, *_ in lists])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        shared = (np.diff(np.append(first, len(every))) > 1) | np.logical_or.reduceat(np.concatenate([t for _, t, _ in lists])[order], first)
        many = np.add.reduceat(np.concatenate([n for *_, n in lists])[order].astype(np.int64), first) > (np.inf if most is None else most)
        cores, out, grows = every[order][first], [], []
        for v, *_ in lists:
            at = np.searchsorted(cores, v)
            out.append(_pack(np.packbits(shared[at]), np.packbits(many[at] & shared[at])))
            grows.append(bool((many[at] & shared[at]).any()))
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "data": pa.array(out, pa.binary()),
                         "grows": pa.array(grows, pa.bool_())})
    return shared_cores


def _grow(level: int, bits: int):
    """Per block: the runs whose cores grow, around the longer cores of the next level."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, level, bits)
                _, many = b.marks(row)
                if len(many):
                    yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int64()), pa.array([b.state(many)], pa.binary())],
                                                     names=["block", "state"])
    return grow


def _send_runs(level: int, bits: int):
    """Per block and bucket: its distinct shared runs, each with its least id and bytes."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, level, bits)
                which, new = b.collapse(b.marks(row)[0])
                if not len(which):
                    continue
                first = np.flatnonzero(new)
                least = np.minimum.reduceat(b.owner[which], first)
                r, key = b.runs.take(which[first]), b.key[which[first]]
                data, at = b.bytes_of(r)
                bucket, edge = b.buckets(key)
                yield _packed(bucket, b.number, [
                    _pack(np.diff(key[x:y], prepend=_U(0)), least[x:y], *(c[x:y].astype(np.uint8) for c in (r.low, r.high, r.part)),
                          data[at[x]:at[y]]) for x, y in zip(edge, edge[1:], strict=False)])
    return send


def earlier_windows(data: np.ndarray, runs: Runs, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which windows of each run stand in a run of its group with a smaller id, as bits
    from its first window on.

    Runs of one group (numbered from 0 on) have one core, which is a single symbol here,
    so a window is that symbol and those beside it.  In the suffix array of all runs
    equal windows are neighbours; the least id of each such stretch decides.
    """
    core, size = runs.core()
    left = core - runs.start
    n = runs.size - size + 2  # with a symbol behind each run
    ends = np.cumsum(n)
    begin, groups = ends - n, int(group.max()) + 1
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(ends[-1]) - begin[owner]
    source = np.repeat(runs.start, n) + place + np.where(place > left[owner], (size - 1)[owner], 0)
    s = data[source].astype(np.int64) + groups + 1
    s[begin + left] = group + 1
    s[ends - 1] = groups + 257 + np.arange(len(n))  # between runs, each its own
    order = np.array(suffix_array([*s.tolist(), 0]))[1:]
    width = LENGTH - size + 1
    order = order[place[order] + width[owner[order]] < n[owner[order]]]
    a, b = order[:-1], order[1:]
    wide = width[owner[a]]
    same = wide == width[owner[b]]
    for t in range(int(wide.max(initial=0))):
        same &= (t >= wide) | (s[np.minimum(a + t, len(s) - 1)] == s[np.minimum(b + t, len(s) - 1)])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.empty(0, dtype=np.int64)
    masks = np.zeros(len(n), dtype=np.uint32)
    if len(first):
        own = least[owner[order]]
        low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(order))))
        hit = order[low < own]
        np.bitwise_or.at(masks, owner[hit], (np.uint32(1) << place[hit].astype(np.uint32)))
    return masks


def earlier(data: np.ndarray, runs: Runs, least: np.ndarray) -> np.ndarray:
    """Which windows of each run stand in a run with a smaller id, as bits from its first
    window on.

    Runs with equal bytes become one with its least id.  Groups of one core that still
    have several runs fall into those of the three longer cores that these have, which
    leaves few; what differs around these is compared by suffix arrays.
    """
    core, length = runs.core()
    key = _hash(data, core, length) ^ mix64(runs.part.astype(np.uint64))
    order = np.lexsort((least, _hash(data, runs.start, runs.size) + runs.low.astype(np.uint64), key))
    r, k, core, length, ids = runs.take(order), key[order], core[order], length[order], least[order]
    new_core = np.append(True, (k[1:] != k[:-1]) | (r.part[1:] != r.part[:-1])
                         | ~_equal(data, core[1:], core[:-1], np.minimum(length[1:], length[:-1])))[:len(k)]
    new = new_core | np.append(True, (r.size[1:] != r.size[:-1]) | (r.low[1:] != r.low[:-1])
                               | ~_equal(data, r.start[1:], r.start[:-1], np.minimum(r.size[1:], r.size[:-1])))[:len(k)]
    first, masks = np.flatnonzero(new), np.zeros(len(k), dtype=np.uint32)
    one, low, group = r.take(first), ids[first], np.cumsum(new_core)[first] - 1
    if new_core.sum() != (np.append(True, k[1:] != k[:-1])[:len(k)]).sum():  # cores of one hash: by their bytes
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault((int(p), data[x:x + y].tobytes()), len(names))
                          for p, x, y in zip(one.part, core[first].tolist(), length[first].tolist(), strict=True)])
    number = np.bincount(group)
    lows, highs = np.full(len(number), _LAST), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(lows, group, low)
    np.maximum.at(highs, group, low)
    chosen = np.flatnonzero(((number > 1) & (lows < highs))[group])
    found = np.zeros(len(first), dtype=np.uint32)
    if runs.level == 0 and len(chosen):
        some = one.take(chosen)
        more, origin = some.split()
        bits = earlier(data, more, low[chosen][origin]) << (more.start - some.start[origin]).astype(np.uint32)
        np.bitwise_or.at(found, chosen[origin], bits)
    elif len(chosen):
        chosen = chosen[np.argsort(group[chosen], kind="stable")]
        begins, edge = 0, _edges(group[chosen])[1]
        symbols = np.append(0, np.cumsum((one.size - one.core()[1])[chosen] + 2))
        for x in range(1, len(edge)):  # whole groups, as many as a suffix array should have
            if x == len(edge) - 1 or symbols[edge[x + 1]] - symbols[begins] > BATCH:
                some = chosen[begins:edge[x]]
                begins = edge[x]
                found[some] = earlier_windows(data, one.take(some), np.cumsum(np.diff(group[some], prepend=-1) != 0) - 1, low[some])
    at = np.cumsum(new) - 1
    every = ((_U(1) << (r.high - r.low + 1).astype(np.uint64)) - _U(1)).astype(np.uint32)
    masks[order] = np.where(ids > low[at], every, found[at])
    return masks


def _solve(level: int):
    """Of one bucket: for each run sent, which of its windows stand in an earlier document."""
    def solve(rows: pa.Table) -> pa.Table:
        sent = [_unpack(d, np.uint64, np.int64, np.uint8, np.uint8, np.uint8, np.uint8) for d in rows.column("data").to_pylist()]
        least, low, high, part = (np.concatenate([x[c] for x in sent]).astype(np.int64) for c in (1, 2, 3, 4))
        data = np.frombuffer(b"".join(x[5].tobytes() for x in sent) + _PAD, dtype=np.uint8)
        size = high - low + LENGTH
        masks = earlier(data, Runs(np.cumsum(size) - size + high, low, high, part, level), least)
        edge = np.cumsum([0, *(len(x[0]) for x in sent)])
        out = [_pack(masks[x:y]) for x, y in zip(edge, edge[1:], strict=False)]
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "data": pa.array(out, pa.binary())})
    return solve


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that some intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > end[:-1]) if len(start) else np.empty(0, dtype=bool)
    return start[first], end[np.append(first[1:], True)] if len(start) else end


def _covered(b: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block that the answers to its runs take from it, as ranges of their places."""
    which, new = b.collapse(b.marks(row)[0])
    if not len(which):
        return np.empty((2, 0), dtype=np.int64)
    key, group = b.key[which[new]], np.cumsum(new) - 1
    masks = np.empty(len(key), dtype=np.uint32)
    answers = {a["bucket"]: a["data"] for a in row["answers"] or []}
    bucket, edge = b.buckets(key)
    for k, number in enumerate(bucket.tolist()):
        masks[edge[k]:edge[k + 1]] = _unpack(answers[number], np.uint32)[0]
    place, size, owner = b.place[which], b.runs.take(which).size, b.owner[which]
    whole = np.minimum.reduceat(owner, np.flatnonzero(new))[group] < owner  # the least id of the block's has sent it
    start, end = [place[whole]], [(place + size)[whole] - LENGTH + 1]
    part = np.flatnonzero(~whole & (masks[group] > 0))
    for j in range(SIDE + 1):
        hit = place[part[(masks[group[part]] >> np.uint32(j)) & 1 > 0]] + j
        start.append(hit)
        end.append(hit + 1)
    return _merge(np.concatenate(start), np.concatenate(end))


def _bytes_of(start: np.ndarray, end: np.ndarray, stretches: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ranges of windows cover, those of the windows that equal one of them in
    a stretch that repeats itself included."""
    more = []
    for begin, stop, period in zip(*(x.tolist() for x in stretches), strict=True):
        for k in range(np.searchsorted(end, begin, side="right"), np.searchsorted(start, begin + period)):
            for place in range(max(int(start[k]), begin), min(int(end[k]), begin + period)):
                more.append((place, place + (stop - LENGTH - place) // period * period + LENGTH))
    extra = np.array(more, dtype=np.int64).reshape(-1, 2).T
    return _merge(np.concatenate([start, extra[0]]), np.concatenate([end + LENGTH - 1, extra[1]]))


def _spans(level: int, bits: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, level, bits)
                start, end = _covered(b, row)
                if len(start):
                    yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int64()), pa.array([_pack(start, end)], pa.binary())],
                                                     names=["block", "gone"])
    return spans


_NAMES = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


def _remove(bits: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, 0, bits)
                found = [_covered(b, row), *(_unpack(x, np.int64, np.int64) for x in row["gone"] or [])]
                start, end = _bytes_of(*_merge(*(np.concatenate(c) for c in zip(*found, strict=True))), b.repeats)
                # what touches at the bound of two texts is two stretches
                cut = np.unique(b.ends[:-1])
                at = np.searchsorted(start, cut) - 1
                cut = cut[(at >= 0) & (np.append(end, 0)[at] > cut)]
                start, end = np.sort(np.append(start, cut)), np.sort(np.append(end, cut))
                of = np.searchsorted(start, np.append(0, b.ends))
                rows = []
                for k, (i, begin, stop) in enumerate(zip(row["ids"], np.append(0, b.ends[:-1]).tolist(), b.ends.tolist(), strict=True)):
                    x, y = start[of[k]:of[k + 1]].tolist(), end[of[k]:of[k + 1]].tolist()
                    kept = b"".join(b.body[p:q] for p, q in zip([begin, *y], [*x, stop], strict=True))
                    spans = [{"start": p - begin, "end": q - begin} for p, q in zip(x, y, strict=True)]
                    rows.append((i, stop - begin, stop - begin - len(kept), len(x), hashlib.sha256(kept).hexdigest(), spans, kept))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64()] * 4 + [pa.string(), span] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                                 names=_NAMES + ["kept"] * with_text)
    return remove


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """Remove bytes that an earlier document has: one row per row of ``docs``.

    A byte goes if a 50-byte string that covers it also starts in a document with a
    smaller id; strings are judged on the input.  Columns: the id, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (removed runs in bytes, end
    exclusive) and, ``with_text``, ``kept`` (remaining bytes).

    Texts are cut into runs, neighbouring 50-byte windows around one core.  Cores that
    one document only has are dropped first, by lists of hashes.  Runs with equal bytes
    collapse to one with its least id, in each block of documents and then in the bucket
    of their core; documents with larger ids lose them whole.  What differs around a
    common core is compared by the suffix array of that core's runs.  A core with more
    than ``max_group`` distinct runs (a passage that very many documents continue
    differently) grows by the bytes next to it, and its runs are dealt out anew under the
    longer cores, as often as needed: all windows of a core of 50 bytes are equal.  So
    groups are bounded, and every window goes the same way.  Hashes only bring candidates
    together; equality is decided on bytes.

    Null text counts as empty.  A null id is larger than any other.  Rows with equal ids
    (repeated rows too) take nothing from each other.  Documents shorter than 50 bytes
    stay whole; a text may be of any length; an empty table gives an empty result; further
    columns are ignored.
    """
    named = Named(docs, [])
    plain = named.df.select(F.col(named.plain(id_col)).cast("long").alias("id"), F.col(named.plain(text_col)).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a row of a block and a bucket shall have some hundred cores at any size
    part = min(max(LEAST_PART, int((5600 * total) ** 0.5)), MOST_PART)
    bits = max(3, (total // part).bit_length())
    blocks = materialize(plain.mapInArrow(_to_blocks(part), "ids array<long>, sizes array<long>, body binary")
                         .withColumn("block", F.monotonically_increasing_id()))  # stable, as it is written here

    def by_block(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(name))

    now, first, gone = blocks, None, None
    for level in range(LEVELS + 1):
        listed = now.mapInArrow(_list_cores(level, bits), _PACKED)
        shared = _shared_cores(max_group if level < LEVELS else None)
        marks = materialize(listed.groupBy("bucket").applyInArrow(shared, _PACKED + ", grows boolean"))
        marked = now.join(by_block(marks, "marks"), "block", "left")
        sent = marked.mapInArrow(_send_runs(level, bits), _PACKED)
        answers = materialize(sent.groupBy("bucket").applyInArrow(_solve(level), _PACKED))
        answered = marked.join(by_block(answers, "answers"), "block", "left")
        if level:
            spans = materialize(answered.mapInArrow(_spans(level, bits), "block long, gone binary"))
            gone = spans if gone is None else gone.unionByName(spans)
        else:
            first = answered
        growing = marks.where("grows").select("block").distinct()
        if growing.isEmpty():
            break
        some = marked.join(growing, "block", "left_semi")
        now = materialize(some.mapInArrow(_grow(level, bits), "block long, state binary"))
    if gone is None:
        out = first.withColumn("gone", F.lit(None).cast("array<binary>"))
    else:
        out = first.join(gone.groupBy("block").agg(F.collect_list("gone").alias("gone")), "block", "left")
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return out.mapInArrow(_remove(bits, with_text), kind + ", kept binary" * with_text).withColumnRenamed("id", id_col)
