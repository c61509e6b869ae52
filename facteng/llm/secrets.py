"""Secret scans with structural confirmation.

Three plain patterns always report (assign, access, hex). Further candidates are reported only when their
structure holds: base64 or hex is decoded and must parse as a key (DER with nested lengths that add up
exactly, or an SSH wire format whose length-prefixed fields use up all bytes), a signed token must have
a JSON header that names its algorithm and a JSON payload.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The kinds in order of report, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more, as the leftmost run of [0-9a-f]+ is
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_BREAK = r"(?:\s|\\[nr])"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----{_BREAK}*((?:[A-Z][A-Za-z0-9-]{{0,40}}:\x20?[^\s\\]{{1,200}}{_BREAK}+)*)([A-Za-z0-9+/=\s\\]{{16,}}?)-----END \1-----")
_ENCRYPTED = re.compile(rf"Proc-Type:\x20?4,ENCRYPTED{_BREAK}+DEK-Info:\x20?[A-Z0-9-]+,([0-9A-Fa-f]{{16}}|[0-9A-Fa-f]{{32}}){_BREAK}")
_DECODED_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Algorithm names of SSH public keys.
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_FILE = b"openssh-key-v1\0"


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it isn't any."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def read_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, place after it) of a DER length in its shortest form."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (size, at + 1 + n) if size >= 0x80 and size >> 8 * (n - 1) else None


def der_items(data: bytes | memoryview) -> list[tuple[int, memoryview]] | None:
    """(tag, content) of a run of DER values that use up data exactly; contents are views, so deep nesting copies nothing."""
    out, at, data = [], 0, memoryview(data)
    while at < len(data):
        tag, got = data[at], read_length(data, at + 1)
        if got is None or got[1] + got[0] > len(data):
            return None
        out.append((tag, data[got[1] : got[1] + got[0]]))
        at = got[1] + got[0]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all of data whose nested values all parse, laid out like a private key (a version,
    then key numbers, an algorithm or an octet string), an encrypted one (an algorithm, then an octet string) or a public key (an
    algorithm, then a bit string)."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if top is None or len(top) != 1:
        return False
    items = der_items(top[0][1])
    if not items or len(items) < 2:
        return False
    waiting = [c for t, c in items if t & 0x20]
    while waiting:  # every constructed value must parse to its end
        inner = der_items(waiting.pop())
        if inner is None:
            return False
        waiting += [c for t, c in inner if t & 0x20]
    tags = [t for t, _ in items]
    if tags[0] == 0x02 and len(items[0][1]) == 1 and items[0][1][0] <= 2:
        return (tags[1] == 0x02 and all(t == 0x02 for t in tags[:9]) and len(tags) >= 6) or (tags[1] == 0x30 and 0x04 in tags) or tags[1] == 0x04
    if tags in ([0x30, 0x03], [0x30, 0x04]):  # the latter is an encrypted private key
        algorithm = der_items(items[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that use up all bytes and begin with a known algorithm name; or a private key file."""
    if data.startswith(SSH_FILE):
        return is_ssh_file(data[len(SSH_FILE) :])
    fields = ssh_fields(data)
    return fields is not None and len(fields) >= 2 and fields[0] in SSH_NAMES


def ssh_field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(field, place after it) of a length-prefixed field."""
    n = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that use up data exactly."""
    out, at = [], 0
    while at < len(data):
        got = ssh_field(data, at)
        if got is None:
            return None
        out.append(got[0])
        at = got[1]
    return out


def is_ssh_file(data: bytes) -> bool:
    """What follows the magic of a private key file: cipher, derivation, its options, number of keys, that many public keys
    (fields of their own) and the private part in blocks of eight bytes; authenticated ciphers add a tag of 16 bytes."""
    head, at = [], 0
    for _ in range(3):
        got = ssh_field(data, at)
        if got is None:
            return False
        head.append(got[0])
        at = got[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not head[0] or not head[1] or not 1 <= keys <= len(data):
        return False
    for k in range(keys + 1):
        got = ssh_field(data, at)
        if got is None:
            return False
        part, at = got
        if k < keys and len(ssh_fields(part) or []) < 2:
            return False
    if not part or len(part) % 8 or head[0] == b"none" and part[:4] != part[4:8]:
        return False
    return len(data) - at == (16 if b"gcm" in head[0] or b"poly1305" in head[0] else 0)


def key_kinds(data: bytes) -> list[str]:
    return ["der"] if is_der_key(data) else ["ssh"] if is_ssh_key(data) else []


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    try:
        header, payload = (json.loads(decode_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed. Base kinds are found by
    pattern alone, the others are confirmed by structure; spans of different kinds may overlap."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    for m in HEX.finditer(text):
        found.append(("hex", *m.span()))
    # Runs of lower-case digits alone and those of any case, which may be longer.
    for start, end in {m.span() for pattern in (HEX, _DECODED_HEX) for m in pattern.finditer(text)}:
        if end - start >= 64 and (end - start) % 2 == 0:
            found += [(kind, start, end) for kind in key_kinds(bytes.fromhex(text[start:end]))]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            data = decode_base64(re.sub(r"\\[nr]|\s", "", m[3]))
            sealed = _ENCRYPTED.search(m[2])  # such a body is cipher text in blocks of the size of the initial vector
            if data and (key_kinds(data) or (sealed and len(data) % (len(sealed[1]) // 2) == 0)):
                found.append(("pem", *m.span()))
    for m in _B64.finditer(text):
        skip = 1 if m[0][0] in "nrt" and text[m.start() - 1 : m.start()] == "\\" else 0  # rest of an escaped line break
        plain = m[0][skip:].lstrip("/")
        if plain[:1] in ("M", "A", "b"):  # base64 of 0x30 begins with M, of a short length prefix with AAAA, of a key file with b3
            data = decode_base64(plain)
            found += [(kind, m.end() - len(plain), m.end()) for kind in key_kinds(data or b"")]
    if "." in text and ("ey" in text or "ew" in text):
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>): one row per row of docs, in whole texts.

    Null and empty texts have no spans; repeated rows give repeated rows; a null doc_id stays null. Only doc_id and
    text are read, so further columns of any name do no harm. No rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined; an empty text for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null and empty texts have no spans, whose digest is that of nothing; repeated rows and
    null ids stay as they are."""
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
