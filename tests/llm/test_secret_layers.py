"""Packed and coded layers of the secret scan, read to the end."""

from __future__ import annotations

import base64
import bz2
import gzip
import random
import time
import zlib

import pytest

from tillwork.llm import secret_scan
from tillwork.llm.secret_scan import all_spans, without_secrets

SECRET = b"password = hunter2hunter2"
FILL = b"".join(b"line %d, " % k for k in range(400))


def deflated(data: bytes) -> bytes:
    machine = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    return machine.compress(data) + machine.flush()


PACKED = {
    "second gzip member": gzip.compress(FILL, mtime=0) + gzip.compress(SECRET, mtime=0),
    "third bzip2 stream": bz2.compress(FILL) + bz2.compress(FILL) + bz2.compress(SECRET),
    "gzip of zlib": gzip.compress(zlib.compress(SECRET), mtime=0),
    "gzip of gzip": gzip.compress(gzip.compress(SECRET, mtime=0), mtime=0),
    "bzip2 of deflate of members": bz2.compress(deflated(zlib.compress(FILL) + gzip.compress(SECRET, mtime=0))),
    "bare deflate": deflated(FILL + SECRET),
    "behind a member": gzip.compress(FILL, mtime=0) + b", " + SECRET,
    "damaged behind": zlib.compress(FILL * 20 + SECRET + random.Random(1).randbytes(20_000))[:-3000],
    "control bytes": gzip.compress(b"\0\x1b\xff" + SECRET + b"\0", mtime=0),
}


@pytest.mark.parametrize("name", PACKED)
@pytest.mark.parametrize("wrap", [base64.b64encode, base64.urlsafe_b64encode, base64.encodebytes])
def test_packed_to_the_end(name, wrap):
    code = wrap(PACKED[name]).decode().strip()
    text = f"before: {code} (after)"
    start = len("before: ")
    spans = all_spans(text)[1]
    assert (start, start + len(code), 0) in spans
    assert "[SECRET]" in without_secrets(text)


def test_bytes_of_no_character():
    """They stay in their places; spans behind them are right."""
    for odd in (b"\0", b"\x1b", b"\xff", b"\xc3", b"\xed\xa0\x80", "é€😀".encode() + b"\x80"):
        data = odd + b" abc " + SECRET + odd
        code = base64.b64encode(data).decode()
        text = f"x {code} y"
        begin = data.index(SECRET)
        end = begin + len(SECRET)
        # The characters that carry the first and the last byte of it.
        want = (2 + begin // 3 * 4 + begin % 3, 2 + (end - 1) // 3 * 4 + (end - 1) % 3 + 2, 0)
        assert want in all_spans(text)[1], odd
        assert all_spans(without_secrets(text))[1] == []


def test_layers_of_many_chunks(monkeypatch):
    """Data larger than a chunk are read whole, wherever the parts fall, packed ones inside them too."""
    monkeypatch.setattr(secret_scan, "CHUNK", 1000)
    inner = base64.b64encode(gzip.compress(FILL * 3 + b"AKIA" + b"B7" * 9, mtime=0))
    for shift in range(0, 60, 7):
        data = b"," * shift + FILL * 5 + b"token: " + b"q" * 3000 + FILL + b"\n" + inner + b"\n" + FILL + b"0123456789abcdef" * 2
        for packed in (gzip.compress(data, mtime=0), bz2.compress(data), deflated(data), gzip.compress(bz2.compress(data), mtime=0)):
            code = base64.b64encode(packed).decode().rstrip("=")
            assert {kind for *_, kind in all_spans(f"({code})")[1]} == {0, 1, 2}


def test_runs_longer_than_are_kept_together(monkeypatch):
    monkeypatch.setattr(secret_scan, "CHUNK", 1000)
    monkeypatch.setattr(secret_scan, "LONGEST_RUN", 5000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1000)
    for shift in range(900, 1100, 17):
        data = b"z" * (4000 + shift) + SECRET.replace(b" ", b"") + b"z" * 9000
        code = base64.b64encode(zlib.compress(data)).decode().rstrip("=")
        assert all_spans(f"({code})")[1]


def test_layers_that_lead_back_end():
    """A member that unpacks to what was there before ends the work."""
    again = base64.b64encode(base64.b64encode(SECRET)).decode()
    text = again + " " + again
    assert len(all_spans(text)[1]) == 2


@pytest.mark.parametrize("chain", ["%" + "25" * 40_000 + "3D", "\\" + "u005c" * 16_000 + "u003d",
                                   "\\" + "x5c" * 20_000 + "x3d", "&" + "#38;" * 20_000 + "#61;"])
def test_codings_of_codings(chain):
    """The work grows with the length of a chain, not with its square."""
    text = f"password{chain}hunter2hunter2 and"
    began = time.monotonic()
    assert (0, len(text) - 4, 0) in all_spans(text)[1]
    assert time.monotonic() - began < 2
    assert without_secrets(text) == "[SECRET] and"


def test_short_chains_keep_all_layers():
    for depth in range(1, 12):
        text = "token%" + "25" * depth + "3Dabcdefgh12"
        assert all_spans(text)[1] == [(0, len(text), 0)]


def test_words_are_no_layers():
    text = "internationalization of 9f86d081884c7d65 and uncharacteristically/longpathnames/everywhere"
    assert all_spans(text) == ([], [])
