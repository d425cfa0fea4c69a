"""Secret scan with a recursive decoding worklist.

A text is layer 0. Every layer is scanned for secrets, then unwrapped: percent escapes and Unicode escapes over the whole
layer, base64 tokens one by one, base64 in lines as one token. The bytes that come out go to every opener: they are read as
UTF-8, as UTF-16 or byte by byte, and inflated as zlib, gzip, bzip2, xz or bare deflate. Each outcome is a new layer; the
worklist runs until no layer yields a new one. A set of seen (content, place) pairs stops cycles. Every layer keeps the span
of layer 0 that its characters came from, so findings at any depth are given as spans of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_texts

# The kinds, in their listed order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")

#: Stretches of single bytes and of two-byte characters that may hold a secret or a further layer: none is shorter.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
_WIDE = (("utf-16-le", re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16}")), ("utf-16-be", re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){16}")))

#: Inflated data are read in pieces of this many bytes, each with the end of the one before: memory has a bound, size has none.
#: A layer inside that is longer than the overlap and lies across the edge of two pieces is opened in part.
PIECE, OVERLAP = 1 << 22, 1 << 18

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def plain_spans(text: str) -> list[Span]:
    """The base findings of one layer in code points, leftmost and without overlaps per kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and where it came from in layer 0: the first and the end position of each character, or one span for all of them
    (`whole`), or neither where the text is layer 0."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def part(self, a: int, b: int) -> Layer:
        if self.whole:
            return Layer(self.text[a:b], whole=self.whole)
        if self.starts is None:
            return Layer(self.text[a:b], array("q", range(a, b)), array("q", range(a + 1, b + 1)))
        return Layer(self.text[a:b], self.starts[a:b], self.ends[a:b])

    def rewritten(self, pieces: list[tuple[int, int, str, bool]]) -> Layer:
        """A layer in which each (start, end, new text, even) replaces a stretch. `even`: the new characters share the stretch
        in proportion; otherwise each of them stands for all of it."""
        if self.whole:
            cuts = [0, *(x for a, b, *_ in pieces for x in (a, b)), len(self.text)]
            kept = [self.text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            news = [*(new for _, _, new, _ in pieces), ""]
            return Layer("".join(x for pair in zip(kept, news, strict=True) for x in pair), whole=self.whole)
        parts, starts, ends, at = [], array("q"), array("q"), 0

        def keep(a: int, b: int) -> None:
            parts.append(self.text[a:b])
            starts.extend(range(a, b) if self.starts is None else self.starts[a:b])
            ends.extend(range(a + 1, b + 1) if self.ends is None else self.ends[a:b])

        for a, b, new, even in pieces:
            keep(at, a)
            n = len(new)
            parts.append(new)
            for i in range(n):
                x, y = (a + (b - a) * i // n, a + -(-(b - a) * (i + 1) // n)) if even else (a, b)
                x, y = self.place(x, max(y, x + 1))
                starts.append(x)
                ends.append(y)
            at = b
        keep(at, len(self.text))
        return Layer("".join(parts), starts, ends)


def readable(data: bytes) -> str | None:
    """Bytes as text where they are text: valid UTF-8 without control characters other than white space."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(c < " " and c not in "\t\n\r\f\v" or c == "\x7f" for c in text) else text


def inflated(data: bytes) -> Iterator[bytes]:
    """Contents of a compressed stream in overlapping pieces; nothing where `data` isn't one, what there is where it breaks off.

    The first bytes tell the kind; bare deflate has no mark, is tried on all others, and counts only if it ends with the data.
    """
    bare = False
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        stream = zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        stream = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\0":
        stream = lzma.LZMADecompressor()
    else:
        stream, bare = zlib.decompressobj(-15), True
    tail, rest, got = b"", data, 0
    while True:
        try:
            out = stream.decompress(rest, PIECE)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        rest = getattr(stream, "unconsumed_tail", b"")
        got += len(out)
        if bare and stream.eof and stream.unused_data:
            return
        if out and (not bare or stream.eof or got >= PIECE):
            yield tail + out
            tail = (tail + out)[-OVERLAP:]
        if stream.eof or not out:
            return


def contents(data: bytes) -> Iterator[tuple[str, bool]]:
    """(text, straight) of everything that the bytes can be read as; `straight`: its characters follow the bytes one by one.
    Streams inside streams are opened until nothing new comes out."""
    seen, work = set(), deque([(data, True)])
    while work:
        data, straight = work.popleft()
        if not data or (key := hashlib.blake2b(data, digest_size=16).digest()) in seen:
            continue
        seen.add(key)
        text = readable(data)
        if text is not None:
            yield text, straight and text.isascii()
            continue
        for code, pattern in _WIDE:
            if m := pattern.search(data):
                yield data[m.start() % 2 :].decode(code, "replace"), straight
        if _STRETCH.search(data):
            yield data.decode("latin-1"), straight
        work.extend((piece, False) for piece in inflated(data))


def unescaped(layer: Layer) -> Iterator[Layer]:
    """The layer without its percent escapes, and without its Unicode escapes; streams in escaped bytes are layers of their own."""
    if "%" in layer.text:
        pieces = []
        for m in _PERCENT.finditer(layer.text):
            data = unquote_to_bytes(m[0])
            new = readable(data)
            if new is None:
                yield from packed(layer, m.start(), m.end(), data)
                new = data.decode("latin-1")
            pieces.append((m.start(), m.end(), new, True))
        if pieces:
            yield layer.rewritten(pieces)
    if "\\" in layer.text:
        pieces = [(m.start(), m.end(), chr(code), False) for m in _UNICODE.finditer(layer.text) if (code := int(m[0][2:], 16)) < 0x110000]
        if pieces:
            yield layer.rewritten(pieces)
        for m in _BYTES.finditer(layer.text):
            data = bytes.fromhex(m[0].replace("\\x", ""))
            if readable(data) is None:
                yield from packed(layer, m.start(), m.end(), data)


def packed(layer: Layer, a: int, b: int, data: bytes) -> Iterator[Layer]:
    """A layer for everything that the bytes behind a stretch of a layer can be read as."""
    for new, straight in contents(data):
        if not new:
            continue
        if straight:
            yield layer.part(a, b).rewritten([(0, b - a, new, True)])
        else:
            yield Layer(new, whole=layer.place(a, b))


def unpacked(layer: Layer) -> Iterator[Layer]:
    """Layers for each base64 token, and one without line breaks for each token that is written in lines."""
    for m in _BASE64.finditer(layer.text):
        token = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if len(token) % 4 == 1:
            continue
        try:
            data = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        yield from packed(layer, m.start(), m.end(), data)
    for m in _WRAPPED.finditer(layer.text):
        breaks = [(x.start(), x.end(), "", False) for x in _BREAK.finditer(m[0])]
        yield layer.part(m.start(), m.end()).rewritten(breaks)


def all_spans(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, spans of all layers in layer 0's positions, and the number of layers."""
    base = plain_spans(text)
    found, work, layers = set(base), deque(), 1
    seen = {(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), (0, len(text)))}
    work.append(Layer(text))
    while work:
        layer = work.popleft()
        for child in (*unescaped(layer), *unpacked(layer)):
            if not child.text:
                continue
            key = (hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), child.place(0, len(child.text)))
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            for start, kind, end in plain_spans(child.text):
                a, b = child.place(start, end)
                found.add((a, kind, b))
            work.append(child)
    return base, sorted(found), layers


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Find secrets in every text of `docs` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex (base findings), base_sha256, spans (base findings and those of inner layers) and
    n_layers. Null and empty texts have no spans and one layer; repeated rows give repeated results; an empty table gives no
    rows; other columns are ignored. Ids may be null or large. One pass over the rows, no shuffle; memory follows the longest text,
not the size of what is inflated.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base, every, layers = all_spans(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return map_texts(docs, scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int")
