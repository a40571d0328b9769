import base64
import hashlib
import json
import os
import re
import struct

import pytest

from pagesieve.llm import secrets


def der(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + content


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0) + b"".join(number(int.from_bytes(hashlib.sha512(bytes([i])).digest() * k, "big"))
                                     for i, k in enumerate((2, 1, 2, 1, 1, 1, 1, 1))))
P8 = der(0x30, number(0) + der(0x30, der(6, bytes.fromhex("2a864886f70d010101")) + der(5, b"")) + der(4, RSA))


def field(b):
    return struct.pack(">I", len(b)) + b


SSH = (b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1)
       + field(field(b"ssh-ed25519") + field(b"k" * 32)) + field(b"p" * 64))


def b64(b):
    return base64.b64encode(b).decode()


def url64(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def jwt(alg="HS256", size=32, body=b'{"sub":"1"}'):
    return ".".join(map(url64, (json.dumps({"alg": alg, "typ": "JWT"}).replace(" ", "").encode(), body, b"s" * size)))


def armour(label, data):
    lines = "\n".join(b64(data)[i:i + 64] for i in range(0, len(b64(data)), 64))
    return f"-----BEGIN {label}-----\n{lines}\n-----END {label}-----"


def kinds(text):
    return [secrets.KINDS[k] for _, k, _ in secrets.confirmed_spans(text)]


@pytest.mark.parametrize("text,want", [
    (armour("RSA PRIVATE KEY", RSA), ["pem_key"]),
    (armour("OPENSSH PRIVATE KEY", SSH), ["pem_key"]),
    (armour("PRIVATE KEY", b"not a key, just bytes of some length"), []),
    (armour("PRIVATE KEY", P8[:-1]), []),
    (armour("PRIVATE KEY", P8).replace("END", "END OF"), ["der_key"]),
    ("key " + b64(P8) + " end", ["der_key"]), ("key " + P8.hex() + " end", ["der_key"]),
    ("key " + P8.hex().upper(), ["der_key"]), ("x " + b64(SSH), ["ssh_key"]),
    ("x " + b64(armour("PRIVATE KEY", P8).encode()), ["coded_key"]), (b64(os.urandom(0) + b"M" * 90), []),
    ("t " + jwt() + " e", ["signed_token"]), (jwt(size=31), []), (jwt("none", 32), []), (jwt(body=b"[1]"), []),
    (jwt("RS256", 256), ["signed_token"]), ("", []), ("eyJ.eyJ.eyJ", []), ("A" * 5000, []), ("0" * 5000, []),
])
def test_structure(text, want):
    assert kinds(text) == want


def test_nested_lengths_must_fill():
    bad = bytearray(P8)
    bad[5] ^= 1
    assert not secrets.is_der_key(bytes(bad)) and not secrets.is_der_key(RSA + b"\0") and secrets.is_der_key(RSA)
    assert not secrets.is_ssh_key(SSH + b"x") and not secrets.is_ssh_key(SSH[:-1])


def plain_base(text):
    """The three patterns as stated, short matches dropped afterwards."""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        "(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


TEXTS = ["token=secret\"=\"abcdefghijkl1234", "PassWord : 'abcdefghijklmnop'", "api_key=short", "tokeN=" + "a" * 12,
         "ſecret=abcdefghijklmn", "toKen=abcdefghijklmn", "AKIAAKIA" + "B" * 12, "AKIA" + "C" * 13, "ä" * 9 + "AKIA" + "D" * 14,
         "0123456789abcdef", "g0123456789abcde g", "token = token = abcdefghijklmnop", "secret:" + " " * 9 + "x" * 20,
         "a" * 40_000, None, "", "password=\n" + "e" * 30]


def test_base_and_rows(make_docs):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "token=abcdefghijklmnop", None)] * 2
    got = {r.doc_id: r for r in secrets.scan_secrets(make_docs(rows)).collect()}
    for i, t in enumerate(TEXTS):
        base = plain_base(t or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[None].n_assign == 1
    assert secrets.scan_secrets(make_docs([])).collect() == []


def test_stage_masks(spark, make_docs):
    text = "ä token=abcdefghijklmnop und " + armour("RSA PRIVATE KEY", RSA) + " Ende"
    docs = make_docs([(1, text, "de"), (2, "clean", "en"), (3, None, None)])
    out = secrets.redact_stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("ä [SECRET] und [SECRET] Ende", 28) and got[2] == ("clean", 5) and got[3] == (None, None)


P256 = der(0x30, number(1) + der(4, b"k" * 32) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107")))
           + der(0xA1, der(3, b"\0\4" + b"x" * 64)))


def wrapped(s, width, end="\n"):
    return end.join(s[i:i + width] for i in range(0, len(s), width))


@pytest.mark.parametrize("after", [".", ". Next", ".\nNext", "...", ",", ""])
def test_signed_token_before_a_full_stop(after):
    assert secrets.confirmed_spans("use " + jwt() + after) == [(4, secrets.KINDS.index("signed_token"), 4 + len(jwt()))]


def test_signed_token_has_three_parts():
    assert kinds(jwt() + ".abc") == [] and kinds(jwt() + "x") == []


@pytest.mark.parametrize("body,kind", [
    (wrapped(b64(P256), 76), "der_key"), (wrapped(b64(P256), 64, "\r\n"), "der_key"),
    (wrapped(b64(P8).rstrip("="), 76), "der_key"), (wrapped(P256.hex(), 64), "der_key"),
    (wrapped(P8.hex().upper(), 76), "der_key"), (wrapped(b64(SSH), 70), "ssh_key"),
    (wrapped(b64(SSH).rstrip("="), 70), "ssh_key"), (wrapped(b64(armour("PRIVATE KEY", P8).encode()).rstrip("="), 76), "coded_key"),
    (wrapped(b64(jwt().encode()).rstrip("="), 76), "coded_key"), (wrapped(jwt().encode().hex(), 76), "coded_key"),
    (b64(P256).rstrip("="), "der_key")])
@pytest.mark.parametrize("after", ["", " end", "\nEnd of it", "\n" + "averylongword" * 3 + "\nand more",
                                   "\n" + "averylongword" * 3 + "\nsecond0line0of0words\nx"])
def test_wrapped_keys(body, kind, after):
    assert secrets.confirmed_spans("key:\n" + body + after) == [(5, secrets.KINDS.index(kind), 5 + len(body))]


def test_keys_line_after_line():
    one, two = wrapped(b64(P256).rstrip("="), 76), wrapped(b64(SSH).rstrip("="), 70)
    text = "0f" * 32 + "\n" + b64(P8).rstrip("=") + "\n" + two
    assert kinds(text) == ["der_key", "ssh_key"]
    assert len(one.split("\n")[-1]) == len(b64(P256).rstrip("=")) % 76
    assert kinds(wrapped("M" * 5000, 64)) == [] and kinds(wrapped("30" * 5000, 64)) == []
