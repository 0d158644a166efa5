"""Secrets in texts: assignments, access keys and long hexadecimal words, and what decoding confirms.

Three base patterns report what looks like a secret. Beyond them a run of base64 or hexadecimal digits is only
reported where its bytes have a secret's structure: a DER key whose nested lengths fit into each other (PKCS#1,
PKCS#8, encrypted PKCS#8, EC, DSA), an OpenSSH private key whose strings fit, or a signed token whose header names a
known algorithm, whose payload is a JSON object and whose signature has that algorithm's length. Public keys and
certificates have such structure too, but are no secrets.

A text is searched as UTF-8 bytes: all patterns are ASCII, and so are the borders of matches, whose places are then
counted in code points. Base patterns take time in proportion to a text's length and memory of a few times its size;
keys' lengths decide how much of a run is decoded. Null and empty texts have no spans. Rows keep their key, null or
repeated, as it is; further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The kinds in order: those of the base patterns, then those that decoding confirms.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "signed_token")

#: The base patterns, and the least length of group 2 or of the match.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: What every match of ASSIGN holds, in lower case.
WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Every match of ACCESS and HEX that is long enough, every key and every token's header is in or begins such a run.
LONG = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
#: Key encodings begin a line of digits, also where a line break is written as \n.
KEY_START = re.compile(rb"(?:(?<![A-Za-z0-9+/])|(?<=\\n))(?:M[C-I]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]")
DIGITS = re.compile(rb"[A-Za-z0-9+/]+")
LINE_BREAK = re.compile(rb"(?:\\r)?\\n|\r?\n")
HEX_RUN = re.compile(rb"[0-9A-Fa-f]{64,}")
HEADER_START = re.compile(rb"(?<![A-Za-z0-9])e[yw]")
SIGNED = re.compile(rb"([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
OPENSSH = b"openssh-key-v1\x00"
#: Lengths of signatures in bytes by the algorithm that a token's header names; RSA keys have at least 128.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "Ed25519": 64}
RSA_SIGNED, LEAST_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), 128
#: DER tags.
INTEGER, BITS, OCTETS, NULL, OBJECT, SEQUENCE, FIRST, SECOND = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0xA0, 0xA1
#: A header or payload of more digits than this is no token's.
MOST_JSON = 1 << 16


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at `at`, which must fit in before `end`."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size > 0x80:
        width = size - 0x80
        if width > 4 or at + width > end or not data[at]:
            return None
        size = int.from_bytes(data[at : at + width], "big")
        if size < 0x80:
            return None
        at += width
    elif size == 0x80:
        return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill at to end without a gap; None if they don't."""
    out = []
    while at < end:
        own = element(data, at, end)
        if own is None or len(out) == 64:
            return None
        out.append(own)
        at = own[2]
    return out


def algorithm(data: bytes, own: tuple[int, int, int]) -> bool:
    """Whether the element is an algorithm's identifier: a sequence that begins with an object identifier."""
    inner = elements(data, own[1], own[2]) if own[0] == SEQUENCE else None
    return bool(inner) and inner[0][0] == OBJECT and inner[0][2] > inner[0][1]


def private_key(data: bytes, depth: int = 0) -> bool:
    """Whether the bytes are one DER element with a private key's nested structure."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    own = elements(data, outer[1], outer[2])
    if not own or len(own) < 2:
        return False
    tags = [t for t, _, _ in own]
    content = lambda i: data[own[i][1] : own[i][2]]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        return algorithm(data, own[0]) and len(content(1)) >= 16
    if tags[0] != INTEGER or content(0) not in (b"\x00", b"\x01"):
        return False
    if all(t == INTEGER for t in tags):  # PKCS#1, DSA
        return len(tags) in (6, 9) and content(0) == b"\x00" and all(own[i][2] > own[i][1] for i in range(len(own))) and len(content(1)) >= 32
    if tags[1] == OCTETS:  # EC
        return content(0) == b"\x01" and len(content(1)) >= 16 and all(t in (FIRST, SECOND) and elements(data, x, y) is not None for t, x, y in own[2:])
    if tags[1] == SEQUENCE and len(tags) > 2 and tags[2] == OCTETS:  # PKCS#8
        inner = content(2)
        plain = element(inner, 0, len(inner))
        fits = plain is not None and plain[2] == len(inner) and (plain[0] in (OCTETS, INTEGER) or plain[0] == SEQUENCE and depth < 2 and private_key(inner, depth + 1))
        return algorithm(data, own[1]) and fits and all(t in (FIRST, SECOND, 0x81) for t in tags[3:])
    return False


def openssh_length(data: bytes) -> int | None:
    """How many bytes an OpenSSH private key at the beginning of data has, if its strings fit."""
    if not data.startswith(OPENSSH):
        return None
    at, names = len(OPENSSH), []
    for _ in range(3):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        names.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at + 4 > len(data) or not names[0].isascii() or not names[1].isascii() or not names[0] or int.from_bytes(data[at : at + 4], "big") != 1:
        return None
    at += 4
    for _ in range(2):  # the public key, then the private one
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if not size:
            return None
        at += 4 + size
    return at if at <= len(data) else None


def decoded(digits: bytes) -> bytes | None:
    """Base64 digits, of either alphabet and without padding, as bytes."""
    if len(digits) % 4 == 1:
        return None
    try:
        return base64.b64decode(digits.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-len(digits) % 4), validate=True)
    except binascii.Error:
        return None


def der_length(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins so, if they are fewer than 64 KB (no private key has more)."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return None
    size = head[1]
    if size < 0x80:
        return 2 + size
    width = size - 0x80
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big") if 0 < width <= 2 else None


def digits_from(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """The runs of base64 digits from `at` on that line breaks alone part, each with its end."""
    while own := DIGITS.match(raw, at):
        yield own.group(), own.end()
        gap = LINE_BREAK.match(raw, own.end())
        if not gap:
            return
        at = gap.end()


def base64_key(raw: bytes, at: int) -> int | None:
    """Where a private key whose base64 digits begin at `at` ends (padding included); None if there is none."""
    held, places, need = [], [], None
    n = 0
    for own, end in digits_from(raw, at):
        held.append(own)
        places.append((n, end - len(own)))
        n += len(own)
        if need is None and n >= 8:
            head = b"".join(held)[:24]
            if head.startswith(b"b3BlbnNzaC1rZXktdjEA"):
                need = 1 << 17
            else:
                size = der_length(decoded(head[:8]) or b"")
                if size is None or size < 32:
                    return None
                need = -(-size * 4 // 3)
        if need is not None and n >= need:
            break
    if need is None:
        return None
    digits = b"".join(held)
    if need == 1 << 17:
        size = openssh_length(decoded(digits[: len(digits) // 4 * 4]) or b"")
        if size is None and len(digits) % 4:
            size = openssh_length(decoded(digits) or b"")
        if size is None:
            return None
        need = -(-size * 4 // 3)
    elif n < need or not private_key(decoded(digits[:need])[:size] if decoded(digits[:need]) else b""):
        return None
    if need > n:
        return None
    last, begin = next((x, y) for x, y in reversed(places) if x < need)
    end = begin + need - last
    pad = -need % 4
    return end + pad if pad and raw[end : end + pad] == b"=" * pad else end


def json_object(digits: bytes) -> dict | None:
    data = decoded(digits) if len(digits) <= MOST_JSON else None
    if not data or not data.lstrip().startswith(b"{"):
        return None
    try:
        own = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return own if isinstance(own, dict) else None


def signed_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    """Whether three base64url parts are a signed token."""
    head = json_object(header)
    name = head.get("alg") if head else None
    if not isinstance(name, str) or json_object(payload) is None:
        return False
    if name == "none":
        return not signature
    own = decoded(signature)
    if own is None:
        return False
    return len(own) >= LEAST_RSA if name in RSA_SIGNED else len(own) == SIGNATURES.get(name)


def base_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(begin, kind, end) in bytes of the base patterns' matches; runs: LONG's."""
    found = []
    lower = raw.lower()
    if any(word in lower for word in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    del lower
    # Whole runs of these patterns' characters are in whole runs of LONG's.
    for a, b in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw, a, b) if m.end() - m.start() >= LEAST_HEX]
    return found


def confirmed_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(begin, kind, end) in bytes of what decoding confirms: keys in base64 or hexadecimal digits, signed tokens."""
    found = []
    key_end = token_end = hex_end = 0
    for a, b in runs:
        # A token's header ends a run: what begins like a JSON object and goes on up to the run's end.
        for start in HEADER_START.finditer(raw, a, b) if raw[b : b + 1] == b"." else ():
            if start.start() >= token_end and (own := SIGNED.match(raw, start.start())) and own.end(1) == b and signed_token(*own.groups()):
                found.append((own.start(), KINDS.index("signed_token"), own.end()))
                token_end = own.end()
        for own in HEX_RUN.finditer(raw, a, b):
            digits = own.group()[: len(own.group()) // 2 * 2]
            size = der_length(binascii.unhexlify(digits[:16]))
            if own.start() >= hex_end and size and 2 * size <= len(digits) and private_key(binascii.unhexlify(digits[: 2 * size])):
                found.append((own.start(), KINDS.index("private_key"), own.start() + 2 * size))
                hex_end = own.start() + 2 * size
        for own in KEY_START.finditer(raw, a, b):
            if own.start() >= key_end and (end := base64_key(raw, own.start())):
                found.append((own.start(), KINDS.index("private_key"), end))
                key_end = end
    return found


def spans_of(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of all spans of a text, by start and then kind."""
    runs = [m.span() for m in LONG.finditer(raw)]
    found = sorted(base_spans(raw, runs) + confirmed_spans(raw, runs))
    if not found or raw.isascii():
        return [(KINDS[k], a, b) for a, k, b in found]
    places = {}
    at = points = 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        points += len(raw[at:place].decode())
        places[place] = points
        at = place
    return [(KINDS[k], places[a], places[b]) for a, k, b in found]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and spans of every document: an array of (kind, start, end), by start and then kind; end is exclusive."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch, texts in text_slices(batches):
            found = [spans_of(t) if t else [] for t in texts]
            flat = [s for own in found for s in own]
            bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            values = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], kind.type) for i, kind in enumerate(span)], fields=list(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, values)], names=["key", "spans"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, spans array<struct<kind string, start bigint, end bigint>>").withColumnRenamed("key", key)


def written_out(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
