"""Secret scans with structural confirmation.

Base patterns report by their look.  Base64 (either alphabet, padded or not) and
hex runs are besides decoded and reported only when the bytes parse: a DER key
(nested tag lengths that fill their parents exactly, with a key's version, counts
and algorithm), an OpenSSH private key or a public-key blob (length-prefixed
fields), or a signed or encrypted token (JSON header with an algorithm).  A run
may go on over line ends of any width, written out, escaped or between quoted
parts; its first symbols (two of DER, four else) stand together.  A structure's
own lengths say where it ends, so text on the lines around it does no harm.

Defined results: a null text counts as empty; whole texts are scanned; repeated
rows and null ids are returned as they come; no finding gives zero counts, the
digest of the empty string and an empty span list; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, text_column

#: The kinds of base findings, in their order.
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that structural confirmation adds, in their order.
MORE_KINDS = ("der", "ssh", "token")
_RANK = {k: i for i, k in enumerate((*BASE_KINDS, *MORE_KINDS))}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
#: A hex run that can hold 32 characters; runs are maximal, so the start is known.
_LONG_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")
_HINT = re.compile("passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
#: Parts of a compact signed (three) or encrypted (five) token; the header is a JSON object.
_SIGNED = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))(?:eyJ|eyA|ew[0ok])[A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]*+){2,4}")
#: A run may go on after a line end, written out or escaped, an indent, and the quotes of a continued string.
_BREAK = re.compile(r"""(?:\r?\n|(?:\\r)?\\n(?:["'][ \t]*[+\\]?[ \t]*\r?\n[ \t]*["'])?|["'][ \t]*[+\\]?[ \t]*\r?\n[ \t]*["'])[ \t]*""")
#: The first symbols of a DER sequence, of a length-prefixed name and of the OpenSSH magic, in base64 and in hex.
_HEADS = re.compile("M[A-I]|AAAA|b3Bl")
_HEX_HEADS = re.compile("30[0-8]|0000|6[fF]70")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_RUNS = (re.compile("[A-Za-z0-9+/]+"), re.compile("[A-Za-z0-9_-]+"))
_BASE64, _HEX_SYMBOLS = frozenset(_LETTERS + "+/"), frozenset("0123456789abcdefABCDEF")
_HEX_RUN = re.compile("[0-9A-Fa-f]+")
_DEEP = 16
LEAST_BYTES = 24
_MAGIC = b"openssh-key-v1\0"
#: Length-prefixed fields of each public-key type.
SSH_FIELDS = {
    "ssh-rsa": 3, "ssh-dss": 5, "ssh-ed25519": 2, "ssh-ed448": 2, "ecdsa-sha2-nistp256": 3, "ecdsa-sha2-nistp384": 3, "ecdsa-sha2-nistp521": 3,
    "sk-ssh-ed25519@openssh.com": 3, "sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
#: Object identifiers (DER content) under which private keys are encrypted: PKCS#5 and PKCS#12.
_SEALED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns, leftmost and non-overlapping within a kind."""
    found = []
    if _HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


def _element(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """``(tag, start, end)`` of the content of the DER element at ``at``, if it lies before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if tag & 31 == 31 or size == 128:
        return None
    if size > 128:
        count = size - 128
        if count > 4 or at + count > end or raw[at] == 0:
            return None
        size, at = int.from_bytes(raw[at : at + count], "big"), at + count
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _elements(raw: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``raw[at:end]`` exactly, checked down through constructed ones."""
    out = []
    while at < end:
        e = _element(raw, at, end)
        if e is None or depth > _DEEP or (e[0] & 32 and _elements(raw, e[1], e[2], depth + 1) is None):
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(raw: bytes) -> bool:
    """A private or public key structure that fills ``raw``: PKCS#1, DSA, PKCS#8 (plain or sealed), SEC 1, PKCS#12, public-key info.

    Version numbers, element counts and algorithm identifiers must be those of the
    structure, so that signatures, digests and certificates are none.
    """
    top = _elements(raw, 0, len(raw))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _elements(raw, top[0][1], top[0][2]) or []
    tags, body = [e[0] for e in inner], [raw[e[1] : e[2]] for e in inner]

    def algorithm(i: int) -> bytes:
        first = _element(raw, inner[i][1], inner[i][2])
        return raw[first[1] : first[2]] if first is not None and first[0] == 6 else b""

    if set(tags) == {2}:
        if len(tags) == 2:  # a signature has two long integers, an RSA public key a short one
            return len(body[0]) >= 64 and len(body[1]) <= 5
        return len(tags) in (6, 9) and body[0] == b"\0" and len(body[1]) >= 64
    if tags == [2] * 9 + [0x30]:  # RSA of more than two primes
        return body[0] == b"\1" and len(body[1]) >= 64
    if tags[:3] == [2, 0x30, 4]:
        return body[0] in (b"\0", b"\1") and algorithm(1) != b"" and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags[:2] == [2, 4]:
        return body[0] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}
    if tags in ([2, 0x30], [2, 0x30, 0x30]):
        return body[0] == b"\3" and algorithm(1) != b""
    if tags == [0x30, 4]:
        return algorithm(0).startswith(_SEALED)
    return tags == [0x30, 3] and algorithm(0) != b"" and body[1][:1] == b"\0"


def _after_fields(peek: Callable[[int], bytes], at: int, count: int) -> int | None:
    """The place after ``count`` length-prefixed fields; ``peek(n)`` gives the first n bytes, or fewer if there are no more."""
    for _ in range(count):
        head = peek(at + 4)
        if len(head) < at + 4:
            return None
        at += 4 + int.from_bytes(head[at : at + 4], "big")
    return at


def _key_size(peek: Callable[[int], bytes]) -> int | None:
    """The bytes that a key structure takes by its own lengths, or None if none begins here."""
    head = peek(8)
    if head[:1] == b"0":
        wide = head[1] - 128 if len(head) > 1 and head[1] > 128 else 0
        if wide > 4 or len(head) < 3 + wide or head[2 + wide] not in (2, 0x30):
            return None
        return 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
    if head == _MAGIC[:8] and peek(len(_MAGIC)) == _MAGIC:
        at = _after_fields(peek, len(_MAGIC), 3)  # cipher, key derivation and its options
        if at is None or len(head := peek(at + 4)) < at + 4:
            return None
        keys = int.from_bytes(head[at : at + 4], "big")
        return _after_fields(peek, at + 4, keys + 1) if 1 <= keys <= 16 else None
    if head[:3] == b"\0\0\0" and len(head) > 4:
        name = peek(4 + head[3])[4:].decode("latin-1")
        return _after_fields(peek, 0, SSH_FIELDS[name]) if name in SSH_FIELDS else None
    return None


def key_kind(raw: bytes) -> str | None:
    """``der`` or ``ssh`` if a key structure fills ``raw``."""
    if len(raw) < LEAST_BYTES or _key_size(lambda n: raw[:n]) != len(raw):
        return None
    if raw[0] != 0x30:
        return "ssh"
    return "der" if is_der_key(raw) else None


def _unpadded(text: str) -> bytes | None:
    """The bytes of URL-safe base64 without padding."""
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    try:
        found = json.loads(_unpadded(text) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_end(text: str) -> int | None:
    """Where the signed or encrypted token that ``text`` begins with ends; None if its header or parts do not hold.

    Signed: a JSON header that names an algorithm, JSON claims and a signature
    (empty for ``none``).  Encrypted: five parts, the header naming an encryption too.
    """
    parts = text.split(".")
    head = _object(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return None
    if isinstance(head.get("enc"), str):
        good = len(parts) == 5 and all(parts[2:]) and all(_unpadded(p) is not None for p in parts[1:])
        return len(text) if good else None
    signed = bool(parts[2]) or head["alg"].lower() == "none"
    if not signed or _unpadded(parts[2]) is None or _object(parts[1]) is None:
        return None
    return sum(map(len, parts[:3])) + 2


def _opens(text: str, at: int, symbols: frozenset) -> bool:
    """Whether a run may start at ``at``: after no symbol, or after the letter of an escape."""
    return at == 0 or text[at - 1] not in symbols or (at > 1 and text[at - 1] in "nrt" and text[at - 2] == "\\")


_STANDARD = str.maketrans("-_", "+/")


def _gather(text: str, at: int, run: re.Pattern, need: int) -> tuple[str, int]:
    """The first ``need`` symbols from ``at`` on, over line ends, and the place after them; fewer if the run ends before."""
    parts, have, end = [], 0, at
    while m := run.match(text, at):
        take = min(need - have, m.end() - at)
        parts.append(text[at : at + take])
        have, end = have + take, at + take
        if have == need or not (b := _BREAK.match(text, end)):
            break
        at = b.end()
    return "".join(parts), end


def _key_at(text: str, at: int, run: re.Pattern, closing: frozenset, bits: int) -> tuple[str, int] | None:
    """The kind and end of the key that a run of ``bits``-bit symbols starts with."""

    def decoded(symbols: str) -> bytes:
        if bits == 4:
            return bytes.fromhex(symbols[: len(symbols) // 2 * 2])
        raw = base64.b64decode(symbols.translate(_STANDARD) + "A" * (-len(symbols) % 4))
        return raw[: len(symbols) * 6 // 8]

    def peek(n: int) -> bytes:
        return decoded(_gather(text, at, run, min(-(-n * 8 // bits), len(text)))[0])[:n]

    size = _key_size(peek)
    if size is None or size < LEAST_BYTES or size * 8 > (len(text) - at) * bits:
        return None
    need = -(-size * 8 // bits)
    symbols, end = _gather(text, at, run, need)
    if len(symbols) < need or text[end : end + 1] in closing or not (kind := key_kind(decoded(symbols)[:size])):
        return None
    for _ in range(-need % 4 if bits == 6 else 0):  # padding, perhaps on the next line
        b = _BREAK.match(text, end)
        place = b.end() if b else end
        end = place + 1 if text[place : place + 1] == "=" else end
    return kind, end


def _keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 and hex runs, from the left, none overlapping another of its alphabet."""
    found = []
    for heads, symbols, runs, bits in ((_HEADS, _BASE64, _RUNS, 6), (_HEX_HEADS, _HEX_SYMBOLS, (_HEX_RUN,), 4)):
        done = at = 0
        while m := heads.search(text, at):
            at = m.start() + 1
            if m.start() < done or not _opens(text, m.start(), symbols):
                continue
            for run in runs:
                closing = symbols if run is not _RUNS[1] else symbols | {"_"}
                if got := _key_at(text, m.start(), run, closing, bits):
                    found.append((got[0], m.start(), got[1]))
                    done = got[1]
                    break
    return found


def confirmed_findings(text: str) -> list[tuple[str, int, int]]:
    """Decoded candidates whose structure holds."""
    found, at = [], 0
    while m := _SIGNED.search(text, at):
        size = token_end(m.group())
        if size:
            found.append(("token", m.start(), m.start() + size))
        at = m.start() + (size or 1)
    return found + _keys(text)


def findings(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings and all findings, each by start, then kind."""
    text = text or ""
    order = lambda f: (f[1], _RANK[f[0]], f[2])
    base = sorted(base_findings(text), key=order)
    return base, sorted(base + confirmed_findings(text), key=order)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping findings replaced by its first kind in brackets."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (arrays of kind, start and end in code points) and, if asked for, ``redacted``."""
    names = list(keep)
    text, text_at = text_column(names, text_col)
    source = docs.select(*names, *text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, clean = [], [], []
            for value in batch.column(text_at):
                text = value.as_py()
                b, s = findings(text)
                base.append([dict(zip(("kind", "start", "end"), f)) for f in b])
                spans.append([dict(zip(("kind", "start", "end"), f)) for f in s])
                if redacted:
                    clean.append(redact(text, s))
            columns = [*(batch.column(i) for i in range(len(names))), pa.array(base, kind), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * redacted, [*names, "base", "spans", *["redacted"] * redacted])

    fields = [*source.schema.fields[: len(names)], T.StructField("base", SPANS), T.StructField("spans", SPANS)]
    return map_arrow(source, run, T.StructType(fields + [T.StructField("redacted", T.StringType())] * redacted))


def joined(spans) -> object:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and text of the findings of :func:`scan`."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
