"""Secrets in texts and in what is encoded inside them.

A worklist holds layers: the text, then whatever URL escapes, Unicode escapes, base64 and compressed data in a
layer decode to. Each new layer is searched and unwrapped in turn until nothing new turns up. A layer that came
up before at the same place isn't followed again, so rounds of encoding that lead back to themselves end. Unpacked
data of any length is read as a stream of layers.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order that breaks ties (fixed by the contract of the query, as are the patterns).
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Runs that only a line end and indentation part, as in base64 that is wrapped. It starts where a run does, so it takes linear time.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: The two bytes that zlib data starts with: method 8 with a window of up to 32 KB, no preset dictionary, a multiple of 31 together.
_ZLIB = b"|".join(re.escape(bytes((m, f))) for m in range(0x08, 0x80, 0x10) for f in range(256) if (m << 8 | f) % 31 == 0 and not f & 0x20)
_MAGIC = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|" + _ZLIB)
#: Printable ASCII and blanks: what escapes are written in.
_PRINTED = "\t\n\r" + "".join(map(chr, range(0x20, 0x7F)))
#: Bytes as p (printed), 0 (zero) or x, and what any match of _WIDE looks like then.
_KIND_OF = bytes(0x70 if chr(c) in _PRINTED else 0x30 if c == 0 else 0x78 for c in range(256))
_WIDE_MARK = b"p0" * 13
#: Characters that alternate with zero bytes, as ASCII ones do in UTF-16 of either byte order.
_WIDE = re.compile("(?:[\t\n\r\x20-\x7e]\0){14,}|(?:\0[\t\n\r\x20-\x7e]){14,}")
#: What decoded bytes must hold for a secret to come out of them: the shortest secret has 14 ASCII characters, and
#: coded ones are longer; or the start of compressed data, or an escape.
_WORTH = re.compile(rb"[\t\n\r\x20-\x7e]{14}|(?:[\t\n\r\x20-\x7e]\0){13}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|" + _MAGIC.pattern)
#: Unpacked data goes through in chunks of about so many bytes, cut where nothing encoded can be going on, that share OVERLAP.
CHUNK, OVERLAP = 16 << 20, 64 << 10
#: Bytes that can stand in something encoded, or in the blanks between its lines.
_CODED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=%\\{}&#;- \t\r\n"

Span = tuple[str, int, int]


def find_secrets(text: str) -> list[Span]:
    """(kind, start, end) by start, then kind: leftmost non-overlapping matches of each kind that are long enough."""
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(word in low for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class _Input:
    """Bytes to unpack, a few at a time; taken: how many have been read."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.back, self.taken = (p[i : i + 4096] for p in pieces for i in range(0, len(p), 4096)), b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.back) < n and (more := next(self.pieces, None)) is not None:
            self.back += more
        return self.back[:n]

    def read(self, n: int = 4096) -> bytes:
        out = self.peek(1) and self.back[:n]
        self.back = self.back[len(out) :]
        self.taken += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self.back = data + self.back
        self.taken -= len(data)


def _member(source: _Input) -> Iterator[bytes]:
    """What the gzip, zlib, bzip2, xz or zstd data at the front of source holds, in pieces; raises where it is unsound or ends early."""
    head = source.peek(6)
    if head[:2] == b"\x1f\x8b" or (head[0] & 0x8F == 0x08 and head[:4] != b"\x28\xb5\x2f\xfd"):
        d = zlib.decompressobj(47)
        while not d.eof:
            data = d.unconsumed_tail or source.read()
            out = d.decompress(data, 1 << 20)
            if not data and not out:
                raise EOFError
            yield out
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        d = zstandard.ZstdDecompressor().decompressobj()
        while not d.eof:
            data = source.read(64)  # a few bytes can stand for a block of 128 KB
            if not data:
                raise EOFError
            yield d.decompress(data)
    else:
        d = bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()
        while not d.eof:
            data = source.read() if d.needs_input else b""
            out = d.decompress(data, 1 << 20)
            if d.needs_input and not data and not out:
                raise EOFError
            yield out
    source.unread(d.unused_data)


def _unpacked(pieces: Iterable[bytes], taken: list[int]) -> Iterator[bytes]:
    """What all members at the front of pieces hold, up to where they are unsound. taken gets the length of each sound one's end."""
    source = _Input(pieces)
    try:
        while _MAGIC.match(source.peek(6)):
            yield from _member(source)
            taken.append(source.taken)
            while source.peek(1) == b"\0":  # padding between members
                source.unread(source.read().lstrip(b"\0"))
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return
    except Exception as e:  # zstandard has an error class of its own
        if type(e).__name__ != "ZstdError":
            raise


def _chunks(stream: Iterator[bytes]) -> Iterator[tuple[bytes, int | None]]:
    """The stream in overlapping chunks, each with where it ends in the stream; None for the last."""
    parts, held, base = [], 0, 0
    for piece in stream:
        parts.append(piece)
        held += len(piece)
        if held > CHUNK + OVERLAP:
            data = b"".join(parts)
            cut = len(data.rstrip(_CODED))
            cut = cut if cut > 2 * OVERLAP else len(data)
            yield data[:cut], base + cut
            parts, base = [data[cut - OVERLAP :]], base + cut - OVERLAP
            held = len(parts[0])
    yield b"".join(parts), None


def _after(stream: Iterator[bytes], n: int) -> Iterator[bytes]:
    """The stream without its first n bytes."""
    for piece in stream:
        if n < len(piece):
            yield piece[n:]
        n = max(0, n - len(piece))


class Layer:
    """A decoded text, and where in the layer around it each of its characters comes from.

    Stretches of the text map evenly: what starts at character child[i] starts at parent[i] there, and each of its characters takes
    width[i] of those. In base64 width is None: four characters make three bytes, from parent[0] on, and
    lines are the stretches of the encoded characters, if line ends part them. place: the one original place of all characters, in unpacked data.
    rest gives the bytes that follow a chunk of unpacked data.
    """

    def __init__(self, text: str, around: Layer | None = None, place: tuple[int, int] | None = None, rest: Callable[[], Iterator[bytes]] | None = None):
        self.text, self.around, self.rest = text, around, rest
        self.place = place or (around.place if around else None)
        self.child = self.parent = self.width = None

    def evenly(self, child: list[int], parent: list[int], width: list[int]) -> Layer:
        if not self.place:
            self.child, self.parent, self.width = (np.array(x, np.int64) for x in (child, parent, width))
        return self

    def from_base64(self, child: np.ndarray, parent: np.ndarray) -> Layer:
        if not self.place:
            self.child, self.parent = child, parent
        return self

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The original place of characters a to b."""
        layer = self
        while not layer.place and layer.around is not None:
            if layer.width is None:  # encoded characters a to b, then where these are
                a, b = a * 8 // 6, ((b - 1) * 8 + 7) // 6 + 1
            i, j = np.searchsorted(layer.child, (a, b - 1), side="right") - 1
            w = (1, 1) if layer.width is None else (int(layer.width[i]), int(layer.width[j]))
            a, b = int(layer.parent[i]) + (a - int(layer.child[i])) * w[0], int(layer.parent[j]) + (b - int(layer.child[j])) * w[1]
            layer = layer.around
        return layer.place or (a, b)


def _bytes_layer(data: bytes, around: Layer) -> Layer:
    """A layer of data.

    Each byte is a character of its own: all patterns are of ASCII characters, which are the same bytes in UTF-8 and
    in most other encodings. So what else the data holds, text or not, doesn't hide a secret.
    """
    return Layer(data.decode("latin-1"), around)


def _replaced(layer: Layer, matches: list[tuple[int, int, str, int]]) -> Layer:
    """The layer with each (a, b, text, width) put in place of its characters a to b; each new character comes from width of them."""
    text, child, parent, widths, at, n = [], [], [], [], 0, 0
    for a, b, new, width in matches:
        for part, start, w in ((layer.text[at:a], at, 1), (new, a, width)):
            if part:
                text.append(part)
                child.append(n)
                parent.append(start)
                widths.append(w)
                n += len(part)
        at = b
    if at < len(layer.text):
        text.append(layer.text[at:])
        child.append(n)
        parent.append(at)
        widths.append(1)
    return Layer("".join(text), layer).evenly(child, parent, widths)


def _in_print(text: str, a: int, b: int) -> bool:
    """Whether a to b lies in 14 printed characters or more, as all of an escaped secret or payload does; in binary data an escape comes up by chance."""
    before, after = text[max(0, a - 14) : a], text[b : b + 14]
    return b - a + len(before) - len(before.rstrip(_PRINTED)) + len(after) - len(after.lstrip(_PRINTED)) >= 14


def _percent(layer: Layer) -> Iterator[Layer]:
    found = (m for m in _PERCENT.finditer(layer.text) if _in_print(layer.text, m.start(), m.end()))
    inside = [(m.start(), m.end(), bytes.fromhex(m.group().replace("%", "")).decode("latin-1"), 3) for m in found]
    if inside:
        yield _replaced(layer, inside)


def _escapes(layer: Layer) -> Iterator[Layer]:
    inside = []
    for m in _ESCAPE.finditer(layer.text):
        n = int(m.group(m.lastindex), 10 if m.lastindex == 6 else 16)
        if n < 0x110000 and not 0xD800 <= n < 0xE000 and _in_print(layer.text, m.start(), m.end()):
            inside.append((m.start(), m.end(), chr(n), m.end() - m.start()))
    if inside:
        yield _replaced(layer, inside)


def _wide(layer: Layer) -> Iterator[Layer]:
    if "\0" not in layer.text or _WIDE_MARK not in layer.text.encode("latin-1", "replace").translate(_KIND_OF):
        return
    inside = [(m.start(), m.end(), m.group().replace("\0", ""), 2) for m in _WIDE.finditer(layer.text)]
    if inside:
        yield _replaced(layer, inside)


def _base64(layer: Layer) -> Iterator[Layer]:
    """What runs of base64's characters decode to, each run alone and joined with those on the next lines.

    Where in a run the payload starts isn't known (a path or a name may stand before it), so the run is decoded
    from each of its first four characters: one of these is in step with the payload.
    """
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            raw = m.group().encode()
            body = raw.translate(_STANDARD, b" \t\r\n")
            if len(body) < 16:
                continue
            # where the lines of encoded characters start, in the body and in the layer
            lines = [(0, 0)]
            if len(raw) > len(body):
                taken = 0
                lines = []
                for line in re.finditer(rb"[^ \t\r\n]+", raw):
                    lines.append((taken, line.start()))
                    taken += len(line.group())
            child, parent = (np.array(x, np.int64) for x in zip(*lines, strict=True))
            del raw
            for a in range(4):
                part = memoryview(body)[a : len(body) - ((len(body) - a) % 4 == 1)]
                data = binascii.a2b_base64(part if len(part) % 4 == 0 else bytes(part) + b"=" * (-len(part) % 4))
                inside = _bytes_layer(data, layer) if _WORTH.search(data) else None
                del part, data
                if inside:
                    # the first line is entered at its character a
                    yield inside.from_base64(np.maximum(child - a, 0), m.start() + parent + np.maximum(a - child, 0))


def _compressed(layer: Layer) -> Iterator[Layer]:
    """What compressed data in a decoded layer, wherever it starts, unpacks to, chunk by chunk; all of it comes from the one place.

    The layer's own characters are blanked where sound compressed data is: they are no text.
    """
    data, at, sound = layer.text.encode("latin-1", "replace"), 0, []
    whole = memoryview(data)
    while m := _MAGIC.search(data, at):
        a = m.start()

        def opened(taken: list[int], a: int = a) -> Iterator[bytes]:
            return _unpacked((p for part in ((whole[a:],), layer.rest() if layer.rest else ()) for p in part), taken)

        ends: list[int] = []
        some = any([bool(piece) for piece in opened(ends)]) if not layer.place else next((True for piece in opened(ends) if piece), False)
        if some:
            place = layer.place or layer.span(a, a + ends[-1] if ends else len(data))
            ends = []
            for chunk, end in _chunks(opened(ends)):
                yield Layer(chunk.decode("latin-1"), layer, place, None if end is None else lambda opened=opened, end=end: _after(opened([]), end))
        at = a + 1
        if ends:
            at = min(len(data), a + ends[-1])
            sound.append((a, at))
    if sound:
        parts, last = [], 0
        for a, b in sound:
            parts += [layer.text[last:a], "\0" * (b - a)]
            last = b
        layer.text = "".join([*parts, layer.text[last:]])


def _inner(layer: Layer, first: bool) -> Iterator[Layer]:
    """The layers right inside a layer; what is compressed comes first, and is blanked then."""
    if not first:
        yield from _compressed(layer)
    for unwrap in (_percent, _escapes, _wide, _base64):
        yield from unwrap(layer)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Secrets of the text itself, and all of them with those of its inner layers, at the places they come from."""
    text = text or ""
    base = find_secrets(text)
    coded = "%" in text or "\\" in text or "&#" in text or "\0" in text
    if not coded and not _BASE64.search(text) and not _WRAPPED.search(text):
        return base, base
    found = set(base)
    first = Layer(text)
    # Depth first, so that of unpacked data only one chunk of each level is held.
    work = [(first, _inner(first, True))]
    seen = {(0, len(text), hashlib.sha256(text.encode("utf-8", "replace")).digest())}
    while work:
        layer, inside = work[-1]
        new = None if layer.place and all((k, *layer.place) in found for k in KINDS) else next(inside, None)
        if new is None:
            # here what is compressed in the layer is blanked
            work.pop()
            if layer is not first:
                found.update((kind, *layer.span(a, b)) for kind, a, b in find_secrets(layer.text))
            continue
        if not new.text:
            continue
        key = (*new.span(0, len(new.text)), hashlib.sha256(new.text.encode("utf-8", "replace")).digest())
        if new.rest or key not in seen:
            seen.add(key)
            work.append((new, _inner(new, False)))
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
     ("base_sha256", pa.string()), ("spans", pa.string()), ("n_inner", pa.int64())]
)


def _scanner(batches):
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part, rows = b.slice(i, 1000), []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                base, every = scan(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(set(base))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types, strict=True)], schema=_OUT)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_inner: a row for each row of docs.

    The counts and the digest are of the text's own secrets; spans (kind:start:end in code points, by start, then
    kind) adds those in inner layers, n_inner of them, each at the place that its characters were decoded from.
    Null counts as empty: no spans. Repeated rows and null ids are kept as they are; other columns are
    ignored; long texts are searched whole, in time that grows with their length, and in memory of about a dozen times that
    of the longest payload.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inner long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner, schema)
