"""Secret scans with structural confirmation.

Three base patterns report their matches as they are. Beyond them, base64 and
hex candidates are decoded and reported only where the bytes have the build of
a key: DER whose nested lengths close exactly, OpenSSH key blobs whose fields
fill them, PEM armour around either or around ciphertext of whole blocks, and
signed tokens whose header is JSON that names an algorithm. Base64 may be
wrapped, with line ends or with their escapes, and may hold a whole PEM block.
Every pattern is searched in time linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import turn_to
from .workspace import table

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
_ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\[nr])*")
_HEADERS = re.compile(r"\s*Proc-Type: *4, *ENCRYPTED\s+DEK-Info: *[A-Z0-9-]+, *([0-9A-Fa-f]{16,64})\s")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
#: Long enough for the smallest private keys; shorter strings decode by chance.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:={1,2}|((?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)+={0,2}))?")
_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n")
#: How base64 of DER sequences, of the OpenSSH magic and of PEM armour begins.
_OPENINGS = ("MI", "MC", "MD", "ME", "MF", "MG", "MH", "b3BlbnNza", "LS0tLS1CRUdJTi")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_SSH = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER values that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + width]), at + width
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _is_rsa(tags: list[int]) -> bool:
    return len(tags) >= 9 and set(tags[:9]) == {0x02}


def _is_ec(items: list[tuple[int, bytes]]) -> bool:
    return len(items) >= 2 and items[0] == (0x02, b"\x01") and items[1][0] == 0x04 and len(items[1][1]) >= 20 and all(tag in (0xA0, 0xA1) for tag, _ in items[2:])


def _is_inner_key(data: bytes) -> bool:
    """What PKCS#8 wraps: a PKCS#1 or SEC1 sequence, a number (DSA) or a string of bytes (Edwards and Montgomery curves)."""
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    tag, content = outer[0]
    if tag in (0x02, 0x04):
        return len(content) >= 16
    items = der_items(content) if tag == 0x30 else None
    return bool(items) and (_is_rsa([t for t, _ in items]) or _is_ec(items))


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA private keys, told by the types of their nested values."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _ in inner]
    if tags[0] == 0x02 and len(inner[0][1]) == 1:
        if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
            algorithm = der_items(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06 and _is_inner_key(inner[2][1])
        return _is_rsa(tags) or _is_ec(inner) or (len(tags) == 6 and set(tags) == {0x02})
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: whole blocks of ciphertext
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[1][0] == 0x30 and len(inner[1][1]) >= 32 and len(inner[1][1]) % 8 == 0
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: length-prefixed fields that fill the blob."""
    if not data.startswith(_SSH):
        return False
    at, fields = len(_SSH), []
    while len(fields) < 3:
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4])
        at += 4 + size
        if at > len(data):
            return False
        fields.append(size)
    count = int.from_bytes(data[at : at + 4])
    at += 4
    for _ in range(count + 1 if 1 <= count <= 16 else 0):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    return 1 <= count <= 16 and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head = json.loads(unbase64(header) or b"")
        body = json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and isinstance(body, dict) and bool(unbase64(signature))


def is_armoured_key(body: str) -> bool:
    """Whether what stands between PEM's two lines is a key, or ciphertext in whole blocks under the headers that name its cipher."""
    if not _ARMOURED.fullmatch(body):
        return False
    body = body.replace("\\r", "").replace("\\n", "\n")
    if headers := _HEADERS.match(body):
        data, block = unbase64(body[headers.end() :]), len(headers[1]) // 2
        return bool(data) and len(data) >= 32 and len(data) % block == 0
    return is_key(unbase64(body))


def armoured(text: str) -> list[tuple[int, int]]:
    """(start, end) of keys in PEM armour: each END line with the BEGIN line nearest before it, so that no byte is read twice."""
    out, begin = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and is_armoured_key(text[begin.end() : m.start()]):
                out.append((begin.start(), m.end()))
            begin = None
    return out


def _key_length(text: str) -> int | None:
    """How many characters of base64 a DER sequence takes that begins so; None if none begins so."""
    data = unbase64(text[:12])
    if not data or data[0] != 0x30:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + width + (int.from_bytes(data[2 : 2 + width]) if width else data[1])
    return -(-4 * size // 3)


def encoded_key(m: re.Match) -> int | None:
    """Where the key ends that a run of base64 lines begins with, or None."""
    first = m[0]
    if not first.startswith(_OPENINGS):
        return None
    if first.startswith("LS0tLS1CRUdJTi"):
        data = unbase64(_BREAK.sub("", first))
        return m.end() if data and armoured(data.decode("utf-8", "replace")) else None
    if m[1] is None:
        return m.end() if is_key(unbase64(first)) else None
    # a wrapped key ends with a line; what follows may be lines of other text
    breaks = [(0, 0), *(b.span() for b in _BREAK.finditer(first)), (len(first), len(first))]
    lines = [first[a[1] : b[0]] for a, b in zip(breaks, breaks[1:], strict=False)]
    wanted, taken = _key_length(first), 0
    if wanted is None:
        return m.end() if is_key(unbase64("".join(lines))) else None
    for k, line in enumerate(lines):
        taken += len(line.rstrip("="))
        if taken >= wanted:
            return m.start() + breaks[k + 1][0] if taken == wanted and is_key(unbase64("".join(lines[: k + 1]))) else None
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """What decoding confirms. Candidates inside PEM armour are reported once, as the armour."""
    armour = [(a, 3, b) for a, b in armoured(text)] if "-----BEGIN " in text else []
    out = []
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    for m in _BASE64.finditer(text):
        if (end := encoded_key(m)) is not None:
            out.append((m.start(), 5, end))
    for m in _HEX_KEY.finditer(text):
        if m[0][:2] == "30" or m[0][:8].lower() == "6f70656e":
            if is_key(bytes.fromhex(m[0])):
                out.append((m.start(), 5, m.end()))
    starts = [a for a, _, _ in armour]

    def inside(span: tuple[int, int, int]) -> bool:
        k = bisect.bisect_right(starts, span[0]) - 1
        return k >= 0 and span[2] <= armour[k][2]

    return sorted(armour + [s for s in out if not inside(s)])


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and its spans, in code points, end exclusive.

    Null and empty texts have none; rows that repeat are scanned alike; a null
    doc_id stays null; texts of any length are scanned whole, in linear time;
    spans that start together are in the order of their kinds. An empty table
    gives no rows. Other columns play no part, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("n", pa.list_(pa.int64())), ("spans", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + confirmed_spans(text))
                kinds = [kind for _, kind, _ in base]
                for column, v in zip(rows, (doc_id.as_py(), told(base), [kinds.count(k) for k in range(3)], told(spans)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, base string, n array<long>, spans string")


def redact_text(text: str) -> str:
    """The text with every reported span replaced by a mark of its kind; spans that overlap become one."""
    spans = sorted(base_spans(text) + confirmed_spans(text))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, in their order, with secrets masked in ``text``; n_chars, where there is one, follows. Null texts stay null."""

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        turn_to(None)
        return texts.map(lambda t: None if t is None else redact_text(t))

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col("n")[k].alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2("base", 256).alias("base_sha256"), "spans")
