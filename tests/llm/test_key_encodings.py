import base64
import struct

import pytest

from facteng.llm import secrets

from .test_chat_mix_secrets import RSA, der


def field(x):
    return struct.pack(">I", len(x)) + x


SEALED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, b"")) + der(4, b"\x9c" * 64))
PUBLIC = field(b"ssh-ed25519") + field(b"k" * 32)
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(PUBLIC) + field(b"\1\2\3\4" * 2 + b"p" * 64)


def pem(name, body, headers=""):
    return f"-----BEGIN {name}-----\n{headers}{base64.b64encode(body).decode()}\n-----END {name}-----"


def kinds(text):
    return [k for k, _, _ in secrets.find_spans(text)]


def test_encrypted_keys():
    assert "pem" in kinds(pem("ENCRYPTED PRIVATE KEY", SEALED)) and kinds(base64.b64encode(SEALED).decode()) == ["der"]
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    text = pem("RSA PRIVATE KEY", b"\x9c" * 64, headers)
    assert ("pem", 0, len(text)) in secrets.find_spans(text)
    assert ("pem", 0, len(text) + 5) in secrets.find_spans(text.replace("\n", "\\n"))
    assert kinds(pem("RSA PRIVATE KEY", b"\x9c" * 65, headers)) == []  # no whole number of blocks
    assert kinds(pem("RSA PRIVATE KEY", b"\x9c" * 64)) == []


@pytest.mark.parametrize("body, kind", [(RSA, "der"), (PUBLIC, "ssh"), (OPENSSH, "ssh")])
def test_hex_of_any_case(body, kind):
    low = body.hex()
    assert kinds(low) == ["hex", kind]
    up = low.upper()
    assert kind in kinds(up) and kind in kinds(up[:20] + low[20:]) and kind in kinds("fx" + up)


@pytest.mark.parametrize("before", ["\\n", "/", "\\r", "//"])
def test_base64_after_an_escape_or_a_slash(before):
    b64 = base64.b64encode(RSA).decode()
    assert secrets.find_spans(f"a {before}{b64} b") == [("der", 2 + len(before), 2 + len(before) + len(b64))]


def test_key_files_parse_to_their_end():
    assert secrets.is_ssh_key(OPENSSH) and kinds(base64.b64encode(OPENSSH).decode()) == ["ssh"]
    for bad in (OPENSSH[:-8], OPENSSH + b"\0" * 8, b"openssh-key-v1\0" + b"x" * 80, OPENSSH.replace(b"\1\2\3\4\1", b"\1\2\3\4\2")):
        assert not secrets.is_ssh_key(bad)
    sealed = OPENSSH.replace(field(b"none"), field(b"aes256-gcm@openssh.com"), 1)
    assert secrets.is_ssh_key(sealed + b"t" * 16) and not secrets.is_ssh_key(sealed)


def test_deep_nesting_is_read_in_linear_time():
    import time

    body = b"\x05\x00"
    for _ in range(60_000):
        n = len(body)
        body = bytes([0x30]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body
    began = time.process_time()
    assert not secrets.is_der_key(bytes([0x30]) + body[1:])
    assert time.process_time() - began < 2
