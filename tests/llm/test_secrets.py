"""op11: base spans against plain patterns on text, and structures made and broken by hand."""

import base64
import hashlib
import json
import random
import re

import pytest

from strandflow.llm.queries import op11_secret_scan
from strandflow.llm.secret_scan import scan, spans_of

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 12),
    ("access", re.compile(r"(AKIA)([A-Z0-9]+)"), 14),
    ("hex", re.compile(r"()([0-9a-f]+)"), 16),
]


def plain(text):
    found = [(m.start(), i, m.end()) for i, (_, pattern, least) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if len(m.group(2)) >= least]
    return [(PATTERNS[i][0], a, b) for a, i, b in sorted(found)]


def der(tag, *contents):
    body = b"".join(contents)
    size = len(body)
    head = bytes([size]) if size < 128 else (lambda b: bytes([0x80 + len(b)]) + b)(size.to_bytes((size.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


def number(n, size=None):
    size = size or max(1, (n.bit_length() + 8) // 8)
    return der(2, n.to_bytes(size, "big"))


random.seed(5)
OID = der(6, bytes.fromhex("2a864886f70d010101"))
BIG = [random.getrandbits(1024) | 1 << 1023 for _ in range(8)]
RSA = der(0x30, number(0), number(BIG[0]), number(65537), *(number(n) for n in BIG[1:7]))
PKCS8 = der(0x30, number(0), der(0x30, OID, der(5)), der(4, RSA))
ED25519 = der(0x30, number(0), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, random.randbytes(32))))
EC = der(0x30, number(1), der(4, random.randbytes(32)), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))), der(0xA1, der(3, b"\0\4" + random.randbytes(64))))
LOCKED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, random.randbytes(96)))
PUBLIC = der(0x30, der(0x30, OID, der(5)), der(3, b"\0" + der(0x30, number(BIG[0]), number(65537))))
string = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(random.randbytes(51)) + string(random.randbytes(136))


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token(head, payload, signature):
    return ".".join((url64(json.dumps(head).encode()), url64(json.dumps(payload).encode()), url64(signature)))


def lines(data, gap="\n"):
    whole = base64.b64encode(data).decode()
    return gap.join(whole[i : i + 64] for i in range(0, len(whole), 64))


def added(text):
    return [s for s in spans_of(text.encode()) if s[0] in ("private_key", "signed_token")]


@pytest.mark.parametrize("data", [RSA, PKCS8, ED25519, EC, LOCKED, OPENSSH], ids=["pkcs1", "pkcs8", "ed25519", "ec", "encrypted", "openssh"])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", ""])
def test_keys_in_base64(data, gap):
    body = lines(data, gap)
    for before, after in (("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----"), ('é key="', '"'), ("x\\n", " words behind it"), ("", "\nplain words on the next line")):
        assert added(before + body + after) == [("private_key", len(before), len(before) + len(body))]


@pytest.mark.parametrize("data", [RSA, PKCS8, ED25519, EC, LOCKED])
def test_keys_in_hexadecimal_digits(data):
    for digits in (data.hex(), data.hex().upper()):
        assert added(f"key: {digits} end") == [("private_key", 5, 5 + len(digits))]


def test_other_structures_are_no_secrets():
    for data in (PUBLIC, der(0x30, PUBLIC, der(0x30, OID, der(5)), der(3, b"\0" + random.randbytes(256))), random.randbytes(300), RSA[:-5], RSA[:8] + b"\x7f" + RSA[9:], OPENSSH[:-3], b"openssh-key-v1\0" + random.randbytes(200)):
        assert added(lines(data)) == added(data.hex()) == added(f'"{lines(data, "")}"') == []
    assert added("MII" + "A" * 100_000 + " " + "MIIB" * 20_000 + "\nMIIC" * 20_000) == []


def test_signed_tokens():
    own = token({"alg": "HS256", "typ": "JWT"}, {"sub": "1"}, b"s" * 32)
    for before in ("", "Bearer ", "https://a.b/c/", "é=", "x-", '"'):
        assert added(f"{before}{own} x") == [("signed_token", len(before), len(before) + len(own))]
    assert [s[0] for s in added(token({"alg": "RS256"}, {}, b"s" * 256))] == ["signed_token"]
    assert [s[0] for s in added(token({"alg": "none"}, {"a": [1]}, b""))] == ["signed_token"]
    for bad in (token({"alg": "HS256"}, {"sub": "1"}, b"s" * 31), token({"alg": "XX"}, {}, b"s" * 32), token({"a": 1}, {}, b"s" * 32), token({"alg": "HS256"}, ["x"], b"s" * 32), own.replace(".", ". "), own + "x", "eyJ" * 10 + ".abc.def", "eyJ" + "[" * 99 + ".e30.x"):
        assert added(bad) == []


def test_base_spans_equal_the_plain_patterns():
    parts = ["token", "TOKEN", "api_key", "ApiKey", "paſſword", "toKen", "secret", "passwd", "password", "=", ":", " ", '"', "'", "abc", "deadbeef", "AKIA", "AKIAAKIA", "ABCDEF0123", "0123456789abcdef", "é", "日", "\n", ".", "-", "_", "/", "+", "x", "  "]
    pick = random.Random(3)
    for _ in range(4000):
        text = "".join(pick.choices(parts, k=pick.randint(1, 25)))
        assert [s for s in spans_of(text.encode()) if s[0] in ("assign", "access", "hex")] == plain(text), text


def test_query_equals_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op11_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(docs)
    for doc in docs:
        base, row = plain(doc.text), found[doc.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.spans == text  # the table holds no keys or tokens besides


def test_rows_of_odd_documents(spark, odd_docs, no_docs):
    found = scan(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(r.spans == [] for r in found)
    assert scan(no_docs).collect() == []
    text = "é " * 2_000_000 + "token = abcdef0123456789 " + lines(PKCS8)
    rows = scan(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).collect()
    assert [[s.kind for s in r.spans] for r in rows] == [["assign", "hex", "private_key"]] * 2
    assert rows[0].spans[0].start == 4_000_000
