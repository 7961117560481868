"""SentencePiece models on the tokenizers library: encode and decode token columns."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import ranges, text_sizes
from ._names import Named

#: Where the public model files are; a parameter of every function that reads them.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL_FILE = "piece_bpe_32k.model"
# Fixed values of the model format: marker for a blank, model types, piece types.
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                out.charsmap = f.get(2, b"")
                out.dummy_prefix, out.squeeze, out.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best scores first."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, score, kind in self.pieces:
            if kind in (NORMAL, USER):
                for k in range(1, len(piece)):
                    if piece[:k] in rank and piece[k:] in rank:
                        found.append((-score, rank[piece], rank[piece[:k]], rank[piece[k:]], piece[:k], piece[k:]))
        return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, model.merges(), fuse_unk=True,
                          unk_token=model.pieces[model.unknown][0], byte_fallback=model.byte_fallback)
    else:
        raise ValueError("neither a unigram nor a BPE model")
    out = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if model.escape and not any(MARK in p.lstrip(MARK) for p, *_ in model.pieces):
        # no piece goes on after a word's end, so words can be split off and cached
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [p for p, _, kind in model.pieces if kind == USER]
    if user:
        out.add_tokens([AddedToken(p, normalized=True, special=False) for p in user])
    last: list = [decoders.Replace(MARK, " ")] if model.escape else []
    last += [decoders.ByteFallback()] if model.byte_fallback else []
    last.append(decoders.Fuse())
    if model.dummy_prefix:
        last.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(last)
    return out


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Mismatch(RuntimeError):
    """The rebuilt tokenizer and the original library disagree."""


class Coder:
    """Encodes and decodes batches with the rebuilt tokenizer.

    Where no piece goes on after a word's end, the ids of a text are those of its words
    in turn, and so is the text that they decode to.  So a batch's new distinct words are
    encoded, and decoded again, by the library as one multithreaded batch, compared with
    the original library's ids, and kept (``MOST_WORDS`` at most).  Texts with anything
    else (several markers in a row, NUL) are compared, and decoded, whole as well.  A
    model without that property, or one that normalises, codes and compares whole texts.
    """

    MOST_WORDS = 240_000

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.most_words = most_words
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.tokenizer, self.library = build(self.model), _library(path)
        self.normalizer = self.tokenizer.normalizer
        self.by_word = self.model.escape and not any(MARK in p.lstrip(MARK) for p, *_ in self.model.pieces)
        if self.by_word:  # words come normalised
            from tokenizers import normalizers

            self.tokenizer.normalizer = normalizers.Sequence([])
        self.plain = self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def _keys(self, text: str) -> list[str]:
        """Words of the normalised text without their marker; others begin with NUL."""
        if self.plain:
            norm = MARK + text.replace(" ", MARK) if text else ""
        else:
            norm = self.normalizer.normalize_str(text)
        if not norm:
            return []
        if norm[0] == MARK and MARK * 2 not in norm and "\0" not in norm:
            return norm[1:].split(MARK)
        return [w[1:] if w[0] == MARK and w[1:2] not in (MARK, "\0") else "\0" + w for w in _WORDS.findall(norm)]

    def _learn(self, keys: set[str]) -> None:
        if len(self.known) + len(keys) > self.most_words // 2:
            self.old, self.known = self.known, {}  # words still in use come back below
            self.lossy.intersection_update(self.old)
        missing = keys.difference(self.known)
        again = missing.intersection(self.old)
        self.known.update((k, self.old[k]) for k in again)
        new = list(missing.difference(again))
        words = [k[1:] if k[:1] == "\0" else MARK + k for k in new]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.known.update(zip(new, (array("i", x).tobytes() for x in ids), strict=True))
        if self.plain:
            same = [k for k, key in enumerate(new) if key and key[:1] != "\0"]
            self._compare([new[k] for k in same], [ids[k] for k in same])
            if "" in missing and same:  # a blank at the end, behind any other word
                self._compare([new[same[0]] + " "], [ids[same[0]] + np.frombuffer(self.known[""], dtype="<i4").tolist()])
        for key, word, text in zip(new, words, self.decode(ids), strict=True):
            if text != key and text != word.replace(MARK, " ").removeprefix(" " * self.model.dummy_prefix):
                self.lossy.add(key)

    def _compare(self, texts: list[str], ids: list[list[int]]) -> None:
        """Parity with the original library, whose normaliser puts the marker first."""
        for text, own, other in zip(texts, ids, self.library.encode(texts, num_threads=1), strict=True):
            if own != other:
                raise Mismatch(f"ids of a text of {len(text)} characters")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as 32-bit numbers, and whether decoding gives the text."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._compare(texts, ids)
            back = self.decode(ids)
            return ([np.array(x, dtype="<i4").tobytes() for x in ids], [t == u for t, u in zip(texts, back, strict=True)])
        keys = [self._keys(t) for t in texts]
        self._learn(set().union(*keys))
        ids = [b"".join(map(self.known.__getitem__, k)) for k in keys]
        fine = [MARK not in t and not (self.lossy and not self.lossy.isdisjoint(k)) for t, k in zip(texts, keys, strict=True)]
        whole = [i for i, k in enumerate(keys) if i == 0 or not self.plain or any(w[:1] == "\0" for w in k)]
        lists = [np.frombuffer(ids[i], dtype="<i4").tolist() for i in whole]
        self._compare([texts[i] for i in whole], lists)
        for i, text in zip(whole, self.decode(lists), strict=True):
            fine[i] = texts[i] == text
        return ids, fine

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def coder(path: str, most_words: int = Coder.MOST_WORDS) -> Coder:
    return Coder(path, most_words)


def model_path(directory: str | None = None, name: str = MODEL_FILE) -> str:
    return os.path.join(directory or TOKENIZER_DIR, name)


def encode_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = True,
                  most_words: int = Coder.MOST_WORDS) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the ids as 32-bit little-endian numbers), round_trip
    and, ``with_ids``, ``ids`` to ``docs``.

    Texts are encoded whole, in batches of about 1 MB.  ``round_trip`` says whether
    decoding the ids gives the text back; a model that normalises or lacks byte fallback
    need not do that, nor does a text that holds the blank's marker itself.  Ids are
    compared with the sentencepiece library's: those of every distinct word and of the
    first text of each batch, or of every text, see ``Coder``; a difference raises ``Mismatch``.

    Null text gives null ids, 0 tokens and the digest of nothing.  The model file is
    read by each executor from ``path`` (installed with the tokenizers); a worker keeps
    ``most_words`` coded words at most, which changes no result.  Rows are
    independent; repeated rows get equal values.  Columns may have any names; those with
    the names of added ones are replaced.
    """
    path = path or model_path()
    added = ["n_tokens", "ids_sha256", "round_trip"] + ["ids"] * with_ids
    named = Named(docs, ["n_tokens", "ids_sha256", "round_trip", "ids"])
    text_col, columns = named.plain(text_col), named.kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column(text_col))):
                piece = batch.slice(a, b - a)
                raw = piece.column(text_col).to_pylist()
                texts = [t or "" for t in raw]
                ids, fine = coder(path, most_words).encode(texts)
                arrays = [*(piece.column(c) for c in columns), pa.array([len(x) // 4 for x in ids], pa.int64()),
                          pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(fine, pa.bool_())]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                    empty = pa.array([t is None for t in raw], pa.bool_())
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat, mask=empty))
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *added])

    kinds = [T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType(named.fields() + [T.StructField(c, t) for c, t in zip(added, kinds, strict=False)])
    return named.back(named.df.mapInArrow(apply, schema), *added)


def decode_tokens(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Replaces or adds ``text_col`` by the decoded ``ids_col``; null ids give null."""
    path = path or model_path()
    named = Named(docs, [text_col])
    ids_col, columns = named.plain(ids_col), named.kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            texts = coder(path).decode([x or [] for x in ids])
            out = [None if x is None else t for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "decoded"])

    decoded = named.df.mapInArrow(apply, T.StructType([*named.fields(), T.StructField("decoded", T.StringType())]))
    return named.back(decoded, F.col("decoded").alias(text_col))
