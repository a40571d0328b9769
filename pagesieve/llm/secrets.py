"""Secret scans with structural confirmation.

Three base patterns (assignments, access ids, hex runs) report spans as they
match. Further kinds are reported only if their content parses:

* ``pem_key``: an armoured private key whose body decodes and parses;
* ``der_key``: a bare base64 or hex run that decodes to a DER private key
  (PKCS#1, SEC 1, PKCS#8 or its encrypted form, DSA), all nested lengths filling
  their parents exactly;
* ``ssh_key``: a bare run that decodes to the length-prefixed OpenSSH key format;
* ``coded_key``: a bare run that decodes to an armoured private key or a signed token;
* ``signed_token``: three base64url parts, the first a JSON header with a signing
  algorithm, the second a JSON object, the third a signature of that algorithm's size.

Spans are code points, end exclusive. A null text counts as empty; an empty text
has no span. Overlapping spans of different kinds are all reported. Work is
linear in the text but for keys nested in each other: candidates are maximal runs
of lines; a key starts with a line and ends with one, where its own lengths say.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .tables import load

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
# A class repeated at least n times matches the same maximal runs as the class repeated, short ones dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "pem_key", "der_key", "ssh_key", "coded_key", "signed_token"]

_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_END = re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
# Lines of a wrapped run; the last one may have any length.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*"
                  r"(?:\r?\n[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
_LINE = re.compile(r"[^\r\n=]+")
FIRST_LINE = 40
_HEXRUN = re.compile(r"(?:[0-9a-fA-F]{2})+")
# Maximal parts, so a full stop may follow the last one, but no further part.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)(?!\.[A-Za-z0-9_-])")
_SIGNED_START = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.")
SIGNATURE_BYTES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96),
                   "ES512": (132, 132), "ES256K": (64, 64), "EdDSA": (64, 114)}
SIGNATURE_BYTES |= {f"{f}{n}": (128, 2048) for f in ("RS", "PS") for n in (256, 384, 512)}
# Object identifiers' first bytes: PKCS#5 and PKCS#12 encryption schemes.
ENCRYPTION_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at:at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins with ``head``, by its own length; None if it is none."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + n
    return 2 + n + int.from_bytes(head[2:2 + n], "big") if 1 <= n <= 4 else None


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one of the DER private key forms."""
    top = der_items(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    items = der_items(top[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags in ([2] * 9, [2] * 6):                       # RSA, DSA: version 0 or 1 and numbers
        return items[0][1] in (b"\0", b"\1") and all(len(v) > 0 for _, v in items) and len(items[1][1]) >= 32
    if tags[:2] == [2, 4] and set(tags[2:]) <= {0xA0, 0xA1}:   # SEC 1
        return items[0][1] == b"\1" and 16 <= len(items[1][1]) <= 80
    if tags[:3] == [2, 0x30, 4] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:   # PKCS#8
        inner = der_items(items[1][1])
        return items[0][1] in (b"\0", b"\1") and bool(inner) and inner[0][0] == 6 and len(items[2][1]) >= 16
    if tags == [0x30, 4]:                                # encrypted PKCS#8
        inner = der_items(items[0][1])
        return (bool(inner) and inner[0][0] == 6 and inner[0][1].startswith(ENCRYPTION_OIDS)
                and len(items[1][1]) >= 16)
    return False


SSH_MAGIC = b"openssh-key-v1\0"


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is the OpenSSH private key format, every length prefix fitting."""
    return ssh_size(data) == len(data) > 0


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with, by its length prefixes; None if it is none."""
    if not data.startswith(SSH_MAGIC):
        return None
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        got = data[at + 4:at + 4 + size]
        at += 4 + size
        return got
    if any(field() is None for _ in range(3)):           # cipher, key derivation, its options
        return None
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return None
    for _ in range(keys):
        public = field()
        if public is None or not 4 <= int.from_bytes(public[:4], "big") <= len(public) - 4:
            return None
    return at if field() else None


def from_base64(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run (white space and padding are free), or None."""
    s = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str):
    data = from_base64(part)
    try:
        return json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None


def is_signed(head: str, body: str, signature: str) -> bool:
    header = _json(head)
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return False
    low, high = SIGNATURE_BYTES.get(header["alg"], (0, -1))
    data = from_base64(signature)
    return data is not None and low <= len(data) <= high and isinstance(_json(body), dict)


def is_armoured(body: str) -> bool:
    """Whether what stands between the armour lines is a private key."""
    body = body.replace("\\n", "\n").replace("\\r", "")
    lines = [x for x in body.split("\n") if ":" not in x]      # header fields such as Proc-Type
    encrypted = "ENCRYPTED" in body
    data = from_base64("".join(lines))
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or (encrypted and len(data) >= 64 and len(data) % 8 == 0))


def pem_spans(text: str) -> list[tuple[int, int]]:
    if "-----BEGIN " not in text:
        return []
    ends: dict[str, list] = {}
    for m in _PEM_END.finditer(text):
        ends.setdefault(m[1], []).append(m.span())
    out, done = [], 0
    for m in _PEM_BEGIN.finditer(text):
        tails = ends.get(m[1], [])
        k = bisect_left(tails, (m.end(), 0))
        if m.start() < done or k == len(tails):
            continue
        nxt = text.find("-----BEGIN ", m.end(), tails[k][0])
        if nxt < 0 and is_armoured(text[m.end():tails[k][0]]):
            out.append((m.start(), tails[k][1]))
            done = tails[k][1]
    return out


def _unhex(chars: str) -> bytes | None:
    m = _HEXRUN.match(chars)
    return bytes.fromhex(m[0]) if m else None


def _unbase64(chars: str) -> bytes | None:
    return from_base64(chars[:-1] if len(chars) % 4 == 1 else chars)


def _coded_end(inner: str, ends: list[int], bits: int) -> int | None:
    """Of ``ends``, numbers of characters of ``bits`` each, the one that ends the coded secret of ``inner``, if any."""
    found = pem_spans(inner)
    if found:
        return ends[min(bisect_left(ends, -(-found[-1][1] * 8 // bits)), len(ends) - 1)]
    m = _SIGNED_START.match(inner)
    if m:
        # the longest signature has 2,048 bytes, that is 2,731 characters
        low, high = bisect_left(ends, m.end() * 8 // bits), bisect_left(ends, (m.end() + 2740) * 8 // bits)
        for end in reversed(ends[low:high]):
            last = _SIGNED.match(inner[:end * bits // 8])
            if last and is_signed(*last.groups()):
                return ends[bisect_left(ends, -(-last.end() * 8 // bits))]
    return ends[-1] if any(is_signed(*x.groups()) for x in _SIGNED.finditer(inner)) else None


def _key_at(flat: str, at: int, ends: list[int]) -> tuple[str, int] | None:
    """What starts at ``at`` in a run without line breaks, and the line end (of ``ends``) where it ends."""
    for decode, bits in ((_unhex, 4), (_unbase64, 6)):
        head = decode(flat[at:at + 32]) or b""
        size = der_size(head)
        if size:
            end = at - (-size * 8 // bits)
            k = bisect_left(ends, end)
            if k < len(ends) and ends[k] == end and is_der_key(decode(flat[at:end]) or b""):
                return "der_key", end
        elif head.startswith(SSH_MAGIC):
            size = ssh_size(decode(flat[at:]))
            end = at - (-size * 8 // bits) if size else -1
            if end in ends:
                return "ssh_key", end
        elif head[:11] == b"-----BEGIN " or head[:3] == b"eyJ":
            later = [e - at for e in ends[bisect_left(ends, at + 1):]]
            end = _coded_end(decode(flat[at:]).decode("latin-1"), later, bits)
            if end:
                return "coded_key", at + end
    return None


def run_keys(run: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the lines of a bare base64 or hex run hold."""
    lines = [m.span() for m in _LINE.finditer(run)]
    flat = "".join(run[a:b] for a, b in lines)
    ends, n = [], 0
    for a, b in lines:
        n += b - a
        ends.append(n)
    out, done = [], 0
    for i, (a, b) in enumerate(lines):
        at = ends[i] - (b - a)
        if at < done or b - a < FIRST_LINE or run[a] not in "MLbZ0123456789abcdefABCDEF":
            continue
        found = _key_at(flat, at, ends)
        if found:
            kind, done = found
            k = bisect_left(ends, done)
            out.append((a, kind, len(run) if k == len(lines) - 1 else lines[k][1]))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what parses."""
    armoured = pem_spans(text)
    found = [(a, KINDS.index("pem_key"), b) for a, b in armoured]
    for m in _RUN.finditer(text):
        if "\n" in m[0] or m[0][0] in "MLbZ0123456789abcdefABCDEF":
            found += [(m.start() + a, KINDS.index(kind), m.start() + b) for a, kind, b in run_keys(m[0])
                      if not any(x <= m.start() + a < y for x, y in armoured)]
    if "eyJ" in text:
        found += [(m.start(), KINDS.index("signed_token"), m.end()) for m in _SIGNED.finditer(text)
                  if is_signed(*m.groups())]
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for b in vec.blocks(batches):
        cols: list[list] = [[] for _ in range(5)]
        for text in vec.strings(b.column("text")).to_pylist():
            base = base_spans(text)
            for k in range(3):
                cols[k].append(sum(s[1] == k for s in base))
            cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols[4].append(_joined(sorted(base + confirmed_spans(text))))
        yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]),
                               pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                              ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` by start, then kind. Repeated rows each get
    a row, null ids stay null, an empty table gives no row; other columns are left
    out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, "
                                  "base_sha256 string, spans string")


MASK = "[SECRET]"


def redact(text: str) -> str:
    """The text with every reported span (overlapping ones together) replaced by a mark."""
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(batches):
    for b in vec.blocks(batches):
        texts = pa.array([None if t is None else redact(t) for t in b.column("text").to_pylist()], pa.string())
        yield b.set_column(b.schema.get_field_index("text"), "text", texts)


@llm_query("op3_secret_scans")
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(load(spark, sf_dir, "documents"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents stay; found secrets are replaced, n_chars is counted anew.

    A null text stays null with its n_chars; empty and long texts are read whole;
    repeated rows are masked alike; ids and further columns, whatever their names,
    come back as they are; an empty table stays empty.
    """
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)
