import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

import zstandard

from siltstone.llm.secret_scan import scan, secret_scan
from tests.llm.cases import ODD, clashing, empty, frame, rows_of, sample

_PATTERNS = [
    ("assign", re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def brute(text):
    found = []
    for k, (kind, p, group, least) in enumerate(_PATTERNS):
        found += [(m.start(), k, m.end(), kind) for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_against_brute_force(spark):
    docs = sample(spark, "0.01")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = secret_scan(docs).collect()
    assert len(got) == len(texts)
    total = 0
    for r in got:
        base = brute(texts[r.doc_id])
        total += len(base)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k + ":") for x in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r.spans.split(","))
    assert total > 0


SECRET = "password=hunter2hunter2"


def inner(text):
    base, every = scan(text)
    return [s for s in every if s not in base]


def test_layers():
    b64 = base64.b64encode(SECRET.encode()).decode()
    twice = base64.b64encode(b64.encode()).decode()
    cases = [
        b64,
        twice,
        urllib.parse.quote(SECRET, safe="").replace("p", "%70", 1),
        "".join(f"%{x:02x}" for x in SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(SECRET.encode())).decode(),
        base64.b64encode(bz2.compress(SECRET.encode())).decode(),
        base64.b64encode(zstandard.compress(SECRET.encode())).decode(),
        base64.b64encode("".join(f"%{x:02x}" for x in b64.encode()).encode()).decode(),
        base64.urlsafe_b64encode(SECRET.encode()).decode().rstrip("="),
    ]
    for coded in cases:
        text = "xx é " + coded + " after"
        found = inner(text)
        assert [k for k, _, _ in found] == ["assign"], coded
        assert all(5 <= a < b <= 5 + len(coded) for _, a, b in found), coded


def test_spans_are_mapped():
    coded = base64.b64encode(("abc " + SECRET + " zz").encode()).decode()
    ((_, a, b),) = inner(coded)
    # characters 4 to 27 of the layer come from base64 characters 5 to 36
    assert (a, b) == (4 * 8 // 6, (26 * 8 + 7) // 6 + 1)
    text = "key: " + SECRET.replace("r", "%72")
    every = scan(text)[1]
    assert ("assign", 5, len(text)) in every


def test_ends():
    loop = base64.b64encode(b"A" * 48).decode()
    for _ in range(6):
        loop = base64.b64encode(loop.encode()).decode()
    scan(loop * 3 + "%25" * 500)
    scan("%2525252525" * 200)


def test_odd_rows(spark):
    want = sorted((i for i, _ in ODD), key=lambda x: (x is not None, x))
    for docs in (frame(spark), clashing(spark)):
        got = secret_scan(docs)
        assert [r[0] for r in rows_of(got, "doc_id")] == want
        none = hashlib.sha256(b"").hexdigest()
        assert got.where("text is null" if "text" in got.columns else "n_assign = 0").where(f"base_sha256 <> '{none}'").count() == 0
    assert secret_scan(empty(spark)).count() == 0


def test_other_characters_do_not_hide_a_layer():
    late = "x" * 70 + " " + SECRET + " café"
    assert inner(base64.b64encode(late.encode()).decode()), "non-ASCII late in the layer"
    assert inner(base64.b64encode(late.encode("latin-1")).decode()), "not UTF-8"
    for c in "\u00a0\u3000\ufeff\f\0\x1b":
        text = f"nom {c}: café\n{SECRET}\n"
        for data in (text.encode(), gzip.compress(text.encode())):
            assert [k for k, _, _ in inner("é " + base64.b64encode(data).decode() + " z")] == ["assign"], (c, data)
        assert inner("".join(f"%{x:02x}" for x in text.encode())), c


def test_payloads_inside_runs():
    b64 = base64.b64encode(SECRET.encode()).decode()
    for before in ("example.com/path/", "data_", "x-", "a", "ab", "abc", "abcd/"):
        for after in ("", "/more", " z"):
            text = "é " + before + b64 + after
            assert any(k == "assign" and 2 + len(before) <= a <= 5 + len(before) for k, a, _ in inner(text)), text
    zipped = "path/" + base64.b64encode(gzip.compress(SECRET.encode())).decode()
    assert [k for k, _, _ in inner(zipped)] == ["assign"]


def test_wrapped_payloads():
    for pad in range(76):
        text = "key:\n" + base64.encodebytes(("x" * pad + " " + SECRET + " z" * 60).encode()).decode() + "end"
        lone = inner(base64.b64encode(("x" * pad + " " + SECRET + " z" * 60).encode()).decode())
        # the place in one line, with the line ends before it
        places = {(a + 5 + a // 76, b + 5 + (b - 1) // 76) for _, a, b in lone}
        assert places and places <= {(a, b) for _, a, b in inner(text)}, pad
    noise = " ".join(hashlib.md5(bytes([i])).hexdigest()[:20] for i in range(30))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        lines = base64.encodebytes(pack(f"{noise} {SECRET}".encode())).decode()
        for text in (lines, lines.replace("\n", "\r\n"), "  " + lines.replace("\n", "\n  ")):
            assert {k for k, _, _ in inner("é\n" + text + "\nz")} == {"assign"}, pack


def test_all_members():
    filler = "".join(hashlib.md5(bytes([i])).hexdigest()[:20] + " " for i in range(30))
    access = "AKIA" + "ABCD" * 4
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        members = b"".join(pack(x.encode()) for x in (filler, SECRET[:12], SECRET[12:], "", filler + access))
        assert {k for k, _, _ in inner("é " + base64.b64encode(members).decode() + " z")} == {"access", "assign"}, pack


def test_long_layers(monkeypatch):
    from siltstone.llm import secret_scan as own

    b64 = base64.b64encode(("é" * 3 + SECRET).encode()).decode()
    assert inner(base64.b64encode(gzip.compress(bytes(17 << 20) + SECRET.encode())).decode())
    monkeypatch.setattr(own, "CHUNK", 5000)
    monkeypatch.setattr(own, "OVERLAP", 500)
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        for late in (SECRET, b64):
            data = pack(b"some words, " * 2500 + late.encode())
            assert {k for k, _, _ in inner(base64.b64encode(data).decode() + " z")} == {"assign"}, pack
    # compressed data that crosses chunks of unpacked data
    noise = "".join(hashlib.sha256(i.to_bytes(2)).hexdigest()[:30] + " " for i in range(1000))
    data = gzip.compress(b"some words, " * 50 + gzip.compress((noise + SECRET).encode()))
    assert {k for k, _, _ in inner(base64.b64encode(data).decode())} == {"assign"}


def test_all_zlib_windows():
    for bits in range(9, 16):
        for level in (1, 6, 9):
            z = zlib.compressobj(level, wbits=bits)
            data = z.compress(f"é some filler {SECRET}".encode()) + z.flush()
            assert {k for k, _, _ in inner("x " + base64.b64encode(data).decode() + " y")} == {"assign"}, (bits, level)


def test_utf16():
    for codec in ("utf-16-le", "utf-16-be", "utf-16"):
        data = f"é {SECRET} ü".encode(codec)
        text = "x " + base64.b64encode(data).decode() + " y"
        assert {k for k, _, _ in inner(text)} == {"assign"}, codec
        nested = base64.b64encode(gzip.compress(f"some {base64.b64encode(data).decode()} more".encode())).decode()
        assert {k for k, _, _ in inner(nested)} == {"assign"}, codec
    # each character is where its two bytes were
    raw = "".join(c + "\0" for c in "words " + SECRET)
    (kind, a, b), = inner("é" + raw)
    assert kind == "assign" and raw.replace("\0", "")[(a - 1) // 2 : (b - 1) // 2] == SECRET


def test_long_binary_payload():
    """32 MB of base64 of random bytes, with a secret and a packed one inside: linear time, and a few copies of the text at a time."""
    import random
    import time
    import tracemalloc

    rng = random.Random(1)
    half = rng.randbytes(12 << 20)
    data = half + b"\0" + SECRET.encode() + b"\0" + half[: 6 << 20] + gzip.compress(f"{'x ' * 50}{SECRET}".encode()) + half[: 6 << 20]
    text = "picture: " + base64.b64encode(data).decode() + " end"
    took = []
    for part in (text[: 8 << 20], text):
        began = time.process_time()
        found = inner(part)
        took.append(time.process_time() - began)
    assert len(found) == 2 and all(k == "assign" for k, _, _ in found)
    assert took[1] < 60 and took[1] < 10 * took[0], took
    tracemalloc.start()
    inner(text[: 8 << 20])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * (8 << 20), peak
