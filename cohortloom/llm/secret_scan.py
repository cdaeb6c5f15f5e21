"""Secret scans with a worklist of decoded layers.

The first layer of a document is its text. Each layer is scanned for assignments of a password, secret, token or key, for access key names and for long
hexadecimal strings; then each decoder makes one more layer of it where it finds something to unwrap: URL escapes, Unicode escapes (\\u0041, \\x41, &#65; and
their kin), and base64 (standard or URL-safe, padded or not, also over several lines). What they give is decompressed first where it is gzip, zlib, bzip2,
xz or zstandard, layer by layer. Decoded pieces take the place of their source, so that a name before an encoded value stays before it. The
list ends when no layer has a new successor; a layer that was seen before isn't read again, so cycles end too.

Every byte of a layer knows the part of the text that it came from: decoded bytes their own escape or base64 characters, decompressed ones the whole piece. Spans
are told in code points of the text, the end exclusive. The spans of the first layer (`via` empty) stay as they are, whatever further layers add.

A piece that would grow above `most` bytes when decompressed isn't opened, as memory is bounded; n_unopened counts such pieces, none is left out silently.
Pieces that aren't text after decoding stay as they are. A null text is an empty one. Very long texts are scanned whole. Equal spans of one kind count once;
rows that repeat a doc_id are scanned one by one. Other columns are carried through whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._text import adding, packed, slices

#: Bytes that one piece, or all pieces of one layer, may have when decompressed.
MOST = 64 << 20

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAME = re.compile(rb"password|passwd|secret|token|api_?key")
#: Runs of these characters are taken whole, so a least length drops the same runs as a look at each match would.
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]{12,}"), re.compile(rb"[0-9a-f]{32,}")
_LEAST = 8


def matches(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) in bytes, leftmost and without overlaps for each kind."""
    out, at, low = [], 0, data.lower()
    while name := _NAME.search(low, at):
        found = _ASSIGN.match(data, name.start())
        at = found.end() if found else name.start() + 1
        if found and len(found[2]) >= _LEAST:
            out.append((found.start(), found.end(), 0))
    return out + [(m.start(), m.end(), 1) for m in _ACCESS.finditer(data)] + [(m.start(), m.end(), 2) for m in _HEX.finditer(data)]


class TooLarge(Exception):
    """A piece that would grow above the bound."""


def _stream(make, raw: bytes, most: int) -> bytes | None:
    """What a decompressor makes of raw, member by member, as far as it is whole."""
    out = b""
    while raw:
        member = make()
        try:
            part = member.decompress(raw, most + 1 - len(out))
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            break
        out += part
        if len(out) > most:
            raise TooLarge
        if not member.eof:
            break
        raw = member.unused_data
    return out or None


def _zstd(raw: bytes, most: int) -> bytes | None:
    try:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw) as reader:
            out = reader.read(most + 1)
    except zstandard.ZstdError:
        return None
    if len(out) > most:
        raise TooLarge
    return out or None


#: First bytes of compressed data, and how to open it.
OPENERS = [
    (b"\x1f\x8b", "gzip", lambda raw, most: _stream(lambda: zlib.decompressobj(31), raw, most)),
    (b"\x78", "zlib", lambda raw, most: _stream(zlib.decompressobj, raw, most) if len(raw) > 2 and int.from_bytes(raw[:2]) % 31 == 0 else None),
    (b"BZh", "bzip2", lambda raw, most: _stream(bz2.BZ2Decompressor, raw, most)),
    (b"\xfd7zXZ\x00", "xz", lambda raw, most: _stream(lambda: lzma.LZMADecompressor(memlimit=1 << 28), raw, most)),
    (b"\x28\xb5\x2f\xfd", "zstd", _zstd),
]
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


def opened(raw: bytes, most: int) -> tuple[bytes, tuple[str, ...]] | None:
    """The text in raw, and the compressions that were taken off; None if it isn't text or comes back to itself."""
    taken, seen = [], {raw}
    while True:
        for magic, name, open_ in OPENERS:
            if raw.startswith(magic) and (inner := open_(raw, most)) is not None:
                if inner in seen:
                    return None
                seen.add(inner)
                taken.append(name)
                raw = inner
                break
        else:
            break
    try:
        raw.decode()
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(raw) else (raw, tuple(taken))


# A decoder finds pieces of a layer: (start, end, raw bytes, for each raw byte where its source starts and ends).
Piece = tuple[int, int, bytes, np.ndarray, np.ndarray]
_PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_ALPHABET = rb"A-Za-z0-9+/_-"
#: A line of 16 characters or more, or several and then what is left of the last one.
_BASE64 = re.compile(rb"(?<![%b])([%b]{16,}(?:\r?\n[%b]{16,})*={0,2})(?:(?<!=)\r?\n[%b]{1,15}={0,2})?" % ((_ALPHABET,) * 4))
_PART = re.compile(rb"[A-Za-z0-9]{16,}={0,2}")


def url_pieces(data: bytes) -> list[Piece]:
    out = []
    for m in _PERCENT.finditer(data):
        raw = binascii.unhexlify(m[0].replace(b"%", b""))
        low = m.start() + 3 * np.arange(len(raw))
        out.append((m.start(), m.end(), raw, low, low + 3))
    return out


def _escaped(run: list[re.Match]) -> Piece | None:
    """A run of escapes as bytes: code points, with surrogates in pairs; \\x41 alone can be bytes of any encoding."""
    units = [(int(next(x for x in m.groups() if x), 10 if m[6] else 16), m.start(), m.end()) for m in run]
    if all(m[4] for m in run):
        raw = bytes(v for v, _, _ in units)
        if _telling(raw):
            return run[0].start(), run[-1].end(), raw, np.array([a for _, a, _ in units]), np.array([b for _, _, b in units])
    out, low, high, i = [], [], [], 0
    while i < len(units):
        v, a, b = units[i]
        if 0xD800 <= v < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            v, b, i = 0x10000 + ((v - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        if 0xD800 <= v < 0xE000 or v > 0x10FFFF:
            return None
        own = chr(v).encode()
        out.append(own)
        low += [a] * len(own)
        high += [b] * len(own)
        i += 1
    return run[0].start(), run[-1].end(), b"".join(out), np.array(low), np.array(high)


def unicode_pieces(data: bytes) -> list[Piece]:
    if b"\\" not in data and b"&#" not in data:
        return []
    out, run = [], []
    for m in [*_ESCAPE.finditer(data), None]:
        if run and (m is None or m.start() != run[-1].end()):
            whole = _escaped(run)
            out += [whole] if whole else [x for x in (_escaped([y]) for y in run) if x]  # what isn't a character stays
            run = []
        run.append(m)
    return out


_STANDARD = bytes.maketrans(b"-_", b"+/")


def _decoded(data: bytes, start: int, end: int) -> Piece | None:
    at = np.frombuffer(data, np.uint8)[start:end]
    at = start + np.flatnonzero((at != 10) & (at != 13) & (at != 61))
    clean = data[start:end].translate(_STANDARD, b"\r\n=")
    if len(clean) % 4 == 1:
        return None
    raw = binascii.a2b_base64(clean + b"=" * (-len(clean) % 4))
    k = 8 * np.arange(len(raw))
    return start, end, raw, at[k // 6], at[(k + 7) // 6] + 1


def base64_pieces(data: bytes, most: int = MOST) -> list[Piece]:
    """Whole tokens; where one isn't text or compressed, its parts between the characters that are no letters or digits."""
    out = []
    for m in _BASE64.finditer(data):
        spans = dict.fromkeys((m.span(), m.span(1)))
        if whole := next((x for span in spans if (x := _decoded(data, *span)) and _telling(x[2])), None):
            out.append(whole)
        else:
            out += [x for p in _PART.finditer(data, *m.span()) if p.span() not in spans and (x := _decoded(data, *p.span())) and _telling(x[2])]
    return out


def _telling(raw: bytes) -> bool:
    """Whether raw starts like compressed data or is text."""
    return raw.startswith(tuple(x[0] for x in OPENERS)) or opened(raw, 0) is not None


DECODERS = {"url": url_pieces, "unicode": unicode_pieces, "base64": base64_pieces}


class Layer:
    """Bytes, how they came about, and for each where its source in the text starts and ends (None: it is the text)."""

    def __init__(self, data: bytes, low: np.ndarray | None = None, high: np.ndarray | None = None, via: tuple[str, ...] = ()):
        self.data, self.low, self.high, self.via = data, low, high, via

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start]), int(self.high[end - 1]))

    def unwrapped(self, name: str, pieces: list[Piece], most: int) -> tuple[Layer | None, set[bytes]]:
        """The layer with all pieces that are text in their place, and digests of those that were too large."""
        parts, low, high, taken, at, large = [], [], [], set(), 0, set()
        own_low = np.arange(len(self.data)) if self.low is None else self.low
        own_high = own_low + 1 if self.high is None else self.high
        for start, end, raw, first, last in pieces:
            try:
                text = opened(raw, most)
            except TooLarge:
                large.add(blake2b(raw).digest())
                continue
            if text is None:
                continue
            inner, packs = text
            parts += [self.data[at:start], inner]
            low += [own_low[at:start], np.full(len(inner), own_low[start]) if packs else own_low[first]]
            high += [own_high[at:start], np.full(len(inner), own_high[end - 1]) if packs else own_high[last - 1]]
            taken |= set(packs)
            most -= len(inner) if packs else 0
            at = end
        if not parts:
            return None, large
        step = "+".join((name, *sorted(taken)))
        return Layer(b"".join([*parts, self.data[at:]]), np.concatenate([*low, own_low[at:]]), np.concatenate([*high, own_high[at:]]), (*self.via, step)), large


def scan(text: bytes, most: int = MOST, decoders=None) -> tuple[dict[tuple[int, int, int], str], int, int]:
    """({(start, kind, end): via}, layers, pieces that weren't opened), in bytes of text."""
    todo, seen, spans, unopened = deque([Layer(text)]), {blake2b(text).digest()}, {}, set()
    while todo:
        layer = todo.popleft()
        for start, end, kind in matches(layer.data):
            start, end = layer.source(start, end)
            spans.setdefault((start, kind, end), ">".join(layer.via))
        for name, pieces in (decoders or DECODERS).items():
            if found := pieces(layer.data):
                new, large = layer.unwrapped(name, found, most)
                unopened |= large
                if new is not None and (key := blake2b(new.data).digest()) not in seen:
                    seen.add(key)
                    todo.append(new)
    return spans, len(seen), len(unopened)


def _redacted(text: bytes, spans) -> str:
    """The text with each span, or stretch of overlapping spans, as the name of its first kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]".encode()]
        at = max(at, end)
    return b"".join([*out, text[at:]]).decode()


def _scanned(most: int):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())])

    def run(batches):
        for batch in batches:
            for rows, data, at in slices(batch):
                raw, told, layers, unopened, clean = data.tobytes(), [], [], [], []
                for a, b in pairwise(at.tolist()):
                    text = raw[a:b]
                    spans, n, large = scan(text, most)
                    place = None if text.isascii() or not spans else np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                    points = (lambda i: i) if place is None else (lambda i: int(place[i]))  # noqa: B023
                    told.append([{"kind": KINDS[k], "start": points(s), "end": points(e), "via": via} for (s, k, e), via in sorted(spans.items())])
                    layers.append(n)
                    unopened.append(large)
                    clean.append(_redacted(text, spans) if spans else None)
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("text"), pa.array(told, pa.list_(span)), pa.array(layers, pa.int64()), pa.array(unopened, pa.int64()), pa.array(clean, pa.string())], ["row", "text", "spans", "n_layers", "n_unopened", "redacted_text"])

    return run


def find_secrets(docs: DataFrame, most: int = MOST) -> DataFrame:
    """row (a struct of docs' other columns) and text with spans (array of kind, start, end, via, by start, then kind as listed, then end), n_layers, n_unopened
    and redacted_text: the text with each span as the name of its kind in brackets, null where there is none."""
    rows = packed(docs).drop("k")
    added = "spans array<struct<kind: string, start: long, `end`: long, via: string>>, n_layers long, n_unopened long, redacted_text string"
    return rows.mapInArrow(_scanned(most), adding(rows, added))
