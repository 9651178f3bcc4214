import base64
import hashlib
import json
import re
import time

from strataglyph.llm import secrets as S

from ..conftest import SMALL


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)
    return bytes([tag]) + size + content


PKCS1 = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 40) for k in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + b"\x05\x00") + der(4, PKCS1))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(len(x).to_bytes(4) + x for x in (b"p" * 30, b"s" * 60))
b64 = lambda b: base64.b64encode(b).decode()
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'x'})}.c2lnbmF0dXJl"


def kinds(text):
    return [S.KINDS[k] for _, k, _ in sorted(S.base_spans(text) + S.confirmed_spans(text))]


def test_structures():
    assert S.is_key(PKCS1) and S.is_key(PKCS8) and S.is_key(SSH)
    assert not S.is_key(PKCS1[:-1]) and not S.is_key(PKCS1 + b"x") and not S.is_key(SSH + b"x") and not S.is_key(b"") and not S.is_key(None)
    assert not S.is_key(der(0x30, der(2, b"\0")))
    assert kinds(f"a {b64(PKCS8)} b") == ["key"]
    assert kinds(f"a {b64(SSH)} b") == ["key"]
    assert "key" in kinds(PKCS1.hex())
    assert kinds(f"x {JWT} y") == ["jwt"]
    assert kinds("x eyJhbGciOjF9.eyJhIjoxfQ.c y") == []  # alg is no string
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64(PKCS1)}\n-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nbm90IGEga2V5\n-----END RSA PRIVATE KEY-----") == []
    assert kinds("just words " + "QUJD" * 30) == []


def test_encodings_and_inner_values():
    def wrapped(data, width, end="\n"):
        text = b64(data)
        return end.join(text[k : k + width] for k in range(0, len(text), width))

    armour = "-----BEGIN {0}-----\n{1}\n-----END {0}-----\n".format
    for end in ("\n", "\r\n", "\\n", "\\r\\n"):
        text = f"key {wrapped(PKCS1, 64, end)}{end}and more words"
        (span,) = S.confirmed_spans(text)
        assert S.unbase64(text[span[0] : span[2]].replace("\\r", "").replace("\\n", "")) == PKCS1
        assert kinds(armour("RSA PRIVATE KEY", wrapped(PKCS1, 64)).replace("\n", end)) == ["pem"]
    assert kinds(f"x {wrapped(SSH, 70)} y") == ["key"]
    assert kinds(b64(armour("PRIVATE KEY", wrapped(PKCS8, 64)).encode())) == ["key"]
    assert kinds(b64(armour("PRIVATE KEY", "bm90IGEga2V5").encode())) == []
    pkcs8 = lambda inner: der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, inner))
    assert S.is_key(pkcs8(der(4, b"s" * 32))) and S.is_key(pkcs8(der(2, b"x" * 20)))
    assert S.is_key(pkcs8(der(0x30, der(2, b"\1") + der(4, b"k" * 32))))
    assert not S.is_key(pkcs8(b"s" * 34)) and not S.is_key(pkcs8(der(0x30, der(2, b"\1") * 3)))
    assert not S.is_key(der(0x30, der(0x30, der(6, b"\x2a")) + der(4, b"c" * 64)))  # no parameters of the cipher
    assert S.is_key(der(0x30, der(0x30, der(6, b"\x2a") + der(0x30, der(4, b"salt"))) + der(4, b"c" * 64)))
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899aabbccddeeff\n\n"
    assert kinds(armour("RSA PRIVATE KEY", sealed + wrapped(b"c" * 64, 64))) == ["pem", "hex"]  # the initial vector is one
    assert kinds(armour("RSA PRIVATE KEY", sealed + wrapped(b"c" * 65, 64))) == ["hex"]
    assert kinds(armour("RSA PRIVATE KEY", "not a key ENCRYPTED at all")) == []
    assert kinds(f"{JWT.rpartition('.')[0]}. x") == []
    assert kinds(f"{url({'alg': 'none'})}.{url({'a': 1})}.c2ln") == []


def test_time_is_linear():
    for text in ("-----BEGIN RSA PRIVATE KEY-----\n" * 330_000, "-----BEGIN " + "A" * 10_000_000, "A" * 10_000_000, "eyJ" * 3_000_000, ("A" * 64 + "\n") * 150_000, "token" + " " * 10_000_000):
        began = time.process_time()
        S.confirmed_spans(text)
        S.base_spans(text)
        assert time.process_time() - began < 4
    lines = "-----BEGIN RSA PRIVATE KEY-----\n" * 330_000
    began = time.process_time()
    assert S.armoured(lines) == []
    assert time.process_time() - began < 1


def test_query_against_the_patterns_as_given(spark):
    """Every whole text of documents by the patterns of the contract, one after the other."""
    patterns = ((r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))
    want = {}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = [(m.start(), k, m.end()) for k, (p, n, g) in enumerate(patterns) for m in re.finditer(p, d.text or "") if len(m[g]) >= n]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want[d.doc_id] = (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(told.encode()).hexdigest(), set(told.split(",")) - {""})
    rows = S.op9_secret_scan(spark, SMALL).collect()
    assert len(rows) == len(want) and any(w[4] for w in want.values())
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id][:4]
        assert want[r.doc_id][4] <= set(r.spans.split(","))


def test_base_patterns():
    text = "é Token = 'abcdefghijkl' passwd:short AKIAABCDEFGHIJKLMN deadbeefdeadbeef AKIA1 api-key=zzzzzzzzzzzzzz api_key:\"0123456789abcdef0\""
    want = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            want.append((m.start(), 0, m.end()))
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert S.base_spans(text) == sorted(want)
    assert len(want) == 5


def test_scan_and_redact(spark):
    rows = [(1, "token=abcdefghijklmnop", 5, "x"), (2, None, None, None), (None, "", 0, None), (4, f"hi {JWT}", 9, "s"), (4, f"hi {JWT}", 9, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.spans) for r in S.scan(df).collect()}
    assert got == {(1, "assign:0:22"), (2, ""), (None, ""), (4, f"jwt:3:{3 + len(JWT)}")}
    assert S.scan(df).count() == 5
    masked = S.redact(df)
    assert masked.columns == df.columns and masked.schema == df.schema
    assert {r.text for r in masked.collect()} == {"[assign]", None, "", "hi [jwt]"}
    assert {(r.text, r.n_chars) for r in masked.filter("doc_id = 1").collect()} == {("[assign]", 8)}
    assert S.scan(df.limit(0)).count() == 0 and S.redact(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(S.told([]).encode()).hexdigest()
