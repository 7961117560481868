"""Secret scans: keyword automaton, anchored patterns near its hits, checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._bytes import ranges, text_sizes
from ._names import Named

# The base kinds, in their order.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(width, "0")


def has_crc32_tail(found: str) -> bool:
    """The last six characters are the CRC-32 of what stands between prefix and them."""
    body = found.rsplit("_", 1)[1]
    return _base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def luhn(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return total % 10 == 0 and len(set(digits)) > 1


def iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


#: Kinds that the method adds: keywords (as they are written, lower case), the pattern
#: anchored at the keyword, and the check of an embedded checksum, if there is one.
ADDED: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[str], bool] | None]] = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), has_crc32_tail),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), has_crc32_tail),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9A-Za-z-]{10,}"), None),
    "google": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), None),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), None),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----"), None),
    "card": (("card: ", "card number: ", "card="), re.compile(r"(?:card: |card number: |card=)[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", re.I | re.A), luhn),
    "iban": (("iban: ", "iban="), re.compile(r"(?:IBAN: |IBAN=)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), lambda s: iban(s[5:].strip())),
}
#: A segment of a web token: whatever fails at its start, fails at every later place in it.
SEGMENT = re.compile(r"[A-Za-z0-9_-]*")
KINDS = (*BASE_KINDS, *ADDED)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    words: dict[str, list[str]] = {}
    for word in ASSIGN_WORDS:
        words.setdefault(word, []).append("assign")
    words.setdefault("akia", []).append("access")
    for kind, (keys, _, _) in ADDED.items():
        for word in keys:
            words.setdefault(word, []).append(kind)
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, (len(word), tuple(kinds)))
    out.make_automaton()
    return out


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, by start, then kind.

    One pass of the automaton over the text, A-Z lower-cased, finds keywords; a kind's
    pattern is only tried where one of its keywords starts, from the end of its last
    match on; where a token failed, not again inside its first segment, which would
    fail alike.  So the work grows with the text only.  Runs of hex digits have no keyword and are searched as such.
    """
    if not text:
        return []
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for last, (length, kinds) in _automaton().iter(lower):
        for kind in kinds:
            hits.setdefault(kind, []).append(last - length + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        pattern, check = {"assign": (ASSIGN, None), "access": (ACCESS, None)}.get(kind) or ADDED[kind][1:]
        end = 0
        for start in sorted(set(starts)):
            if start >= end and (m := pattern.match(text, start)):
                end = m.end()
                if kind == "assign" and len(m[2]) < 6 or kind == "access" and end - start < 20:
                    continue
                if check is None or check(m[0]):
                    found.append((start, end, kind))
            elif start >= end and kind == "jwt":
                end = SEGMENT.match(text, start).end()
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every covered stretch replaced by ``[kind]`` of its first span."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_col: str = "text", replace: bool = False,
                 carry: Sequence[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans to ``docs`` (or to its
    columns ``carry`` only); a row needs no other row.

    ``spans`` has ``kind:start:end`` (code points, end exclusive) of all kinds by start,
    comma-joined; ``base_sha256`` is the SHA-256 of the same over the base kinds.  With
    ``replace`` the text is given back with its secrets replaced.  Null text counts as
    empty and stays null: no spans, the digest of the empty string.  Texts are scanned
    whole, whatever their length; repeated rows get equal values.  Columns may
    have any names; those with the names of added ones are replaced.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    named = Named(docs, added, carry)
    text_col, columns = named.plain(text_col), named.kept

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(x, y - x) for b in batches for x, y in ranges(text_sizes(b.column(text_col)))):
            texts = batch.column(text_col).to_pylist()
            counts: list[list[int]] = [[], [], []]
            digests, spans, clean = [], [], []
            for text in texts:
                found = find_secrets(text or "")
                base = [x for x in found if x[2] in BASE_KINDS]
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
                clean.append(redact(text, found) if replace and text and found else text)
            arrays = [pa.array(clean, pa.string()) if replace and c == text_col else batch.column(c) for c in columns]
            arrays += [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *added])

    schema = T.StructType(named.fields() + [T.StructField(c, T.LongType()) for c in added[:3]]
                          + [T.StructField(c, T.StringType()) for c in added[3:]])
    return named.back(named.df.select(*dict.fromkeys([*columns, text_col])).mapInArrow(scan, schema), *added)
