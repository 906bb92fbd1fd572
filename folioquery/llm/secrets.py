"""Secret scans through nested encodings.

Each text is scanned by three patterns. Then a worklist unwraps what the text
carries: percent-encoding, backslash escapes, base64 and compressed bytes. Each
layer is scanned with the same patterns and searched for further layers until
nothing new appears; a layer whose content was already seen is not opened again
(cycle detection). A secret found in a layer is mapped to the span, in the
original text, of the outermost encoded run that holds it; for percent and
backslash layers the span is narrowed through the layer's character map while
that map is known.

Defined results: null is an empty text; empty texts have no spans (empty
strings, zero counts); repeated rows give repeated results; whole texts of any
length are scanned; an empty table gives no rows; other columns are ignored.
Base64 and hex may be wrapped in lines or stand behind or before separators of
a path. Bytes are a layer if they are valid UTF-8 or compressed (gzip, zlib, bz2, xz, all
their members, or raw deflate that ends with its data); a stream that breaks off gives what
came before, and one that begins like a stream it came from is not opened again. Layers
beyond MAX_LAYER are scanned as a stream in pieces; a piece ends only where no pattern and
no encoded run can go on (SAFE), so nothing is lost at its edges; where no such place comes, the
piece grows until one does. Time is linear in a text's length: runs are tried from
their first character, and bytes are decoded as far as they make sense.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioquery.llm.common import read

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

PERCENT = re.compile(r"(?<![^\s%])[^\s%]*%[0-9A-Fa-f]{2}(?:[^\s%]|%[0-9A-Fa-f]{2})*")
PERCENT_UNIT = re.compile(r"((?:%[0-9A-Fa-f]{2})+)")
ESCAPE = re.compile(r"(?<!\S)\S*\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})\S*")
ESCAPE_UNIT = re.compile(r"((?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_LAYER = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
SEPARATOR = re.compile(r"[/_-]")
HEX_RUN = re.compile(r"(?:[0-9A-Fa-f]{2})+")
MIN_RUN = 16
MAX_LAYER = 1 << 26
SAFE = re.compile(r"[.,;!?()<>\[\]{}|]\s")
PIECE = 1 << 20       # bytes that a decompressor gives at once
STEP = 1 << 8         # characters of a run that are first decoded; each further step is twice as long


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and non-overlapping per kind."""
    found = []
    if NAMES.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def _mapped(run: str, unit: re.Pattern, decode) -> tuple[str, list[int]] | None:
    """Decoded run, and for each of its characters (and the end) the place in the run."""
    out, places, last = [], [], 0
    for m in unit.finditer(run):
        out.append(run[last:m.start()])
        places.extend(range(last, m.start()))
        try:
            plain, ends = decode(m[0])
        except (UnicodeDecodeError, ValueError):
            plain, ends = m[0], list(range(len(m[0])))
        out.append(plain)
        places.extend(m.start() + e for e in ends)
        last = m.end()
    out.append(run[last:])
    places.extend(range(last, len(run) + 1))
    return "".join(out), places


def _percent(units: str) -> tuple[str, list[int]]:
    text = bytes.fromhex(units.replace("%", "")).decode("utf-8")
    at, places = 0, []
    for c in text:
        places.append(at)
        at += 3 * len(c.encode("utf-8"))
    return text, places


def _escaped(units: str) -> tuple[str, list[int]]:
    codes, places, at = [], [], 0
    while at < len(units):
        wide = 6 if units[at + 1] == "u" else 4
        codes.append(int(units[at + 2: at + wide], 16))
        places.append(at)
        at += wide
    out, kept, k = [], [], 0
    while k < len(codes):
        pair = 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000
        out.append(chr(0x10000 + ((codes[k] - 0xD800) << 10) + codes[k + 1] - 0xDC00) if pair else chr(codes[k]))
        kept.append(places[k])
        k += 2 if pair else 1
    return "".join(out), kept


def _engine(head: bytes):
    """Maker of the decompressor for data that begin so, or None."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor
    if len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return lambda: zlib.decompressobj(15)
    return None


def _pumped(engine, data: bytes) -> Iterator[bytes]:
    while not engine.eof:
        out = engine.decompress(data, PIECE)
        if out:
            yield out
        data = getattr(engine, "unconsumed_tail", b"")
        if not data and len(out) < PIECE and getattr(engine, "needs_input", True):
            break


def _members(chunks: Iterator[bytes], make) -> Iterator[bytes]:
    """All members of a compressed stream; what breaks off gives what came before."""
    engine = make()
    try:
        for chunk in chunks:
            while chunk:
                if engine.eof:
                    make = _engine(chunk)
                    if make is None:
                        return
                    engine = make()
                yield from _pumped(engine, chunk)
                chunk = engine.unused_data if engine.eof else b""
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return


def _deflated(chunks: Iterator[bytes]) -> bool:
    """Whether all of the data are one raw deflate stream."""
    engine, size = zlib.decompressobj(-15), 0
    try:
        for chunk in chunks:
            if engine.eof:
                return False
            size += sum(map(len, _pumped(engine, chunk)))
    except zlib.error:
        return False
    return size > 0 and engine.eof and not engine.unused_data


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """A stream as text: one piece, or several beyond MAX_LAYER, cut at safe places; nothing more where it is no UTF-8."""
    decoder, held, size = codecs.getincrementaldecoder("utf-8")(), [], 0
    try:
        for chunk in chunks:
            held.append(decoder.decode(chunk))
            size += len(held[-1])
            if size > MAX_LAYER:
                *_, cut = itertools.chain([None], SAFE.finditer(held[-1]))
                if cut:
                    yield "".join(held[:-1]) + held[-1][:cut.end()]
                    held = [held[-1][cut.end():]]
                    size = len(held[0])
        held.append(decoder.decode(b"", True))
    except UnicodeDecodeError:
        return
    if text := "".join(held):
        yield text


def _utf8_up_to(chunks: Iterator[bytes]) -> int | None:
    """How many bytes are valid UTF-8 if not all are, else None."""
    decoder, done, held = codecs.getincrementaldecoder("utf-8")(), 0, b""
    try:
        for chunk in chunks:
            held = decoder.getstate()[0]
            decoder.decode(chunk)
            done += len(chunk)
        held = decoder.getstate()[0]
        decoder.decode(b"", True)
    except UnicodeDecodeError as e:
        return done - len(held) + e.start
    return None


def _plain(read) -> Iterator[str]:
    """Bytes as text, if they are compressed or are text. ``read()`` gives their chunks from the start, the first of at least 6 bytes where there are as many."""
    chunks = read()
    head, opened, seen = next(chunks, b""), False, set()
    while make := _engine(head):  # compressed again and again, until it no longer is
        digest = hashlib.blake2b(head, digest_size=16).digest()
        if digest in seen:
            return
        seen.add(digest)
        inner = _members(itertools.chain([head], chunks), make)
        first = next(inner, b"")
        if not first:
            break
        second = next(inner, None)  # a short layer needs its stream no more, so streams stand in each other only while they are long
        head, opened, chunks = first, True, iter(()) if second is None else itertools.chain([second], inner)
    if opened:
        yield from _texts(itertools.chain([head], chunks))
    elif _utf8_up_to(read()) is None:
        yield from _texts(read())
    elif _deflated(read()):
        engine = zlib.decompressobj(-15)
        yield from _texts(out for chunk in read() for out in _pumped(engine, chunk))


def _whole(data: bytes):
    return lambda: iter([data])


def _bytes(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:  # the last character has no byte
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _likely(head: str) -> bool:
    """Whether a run that begins so can be text, up to a separator at least, or compressed: what most starts are not is seen at once."""
    data = _bytes(head)
    if _engine(data):
        return True
    try:
        codecs.utf_8_decode(data[:12], "strict", False)
        return True
    except UnicodeDecodeError:
        pass
    try:
        zlib.decompressobj(-15).decompress(data, PIECE)
        return True
    except zlib.error:
        return False


def _steps(run: str, start: int, end: int) -> Iterator[bytes]:
    """A run's bytes in steps of growing length, so that a start that makes no sense costs little."""
    step = STEP
    while start < end:
        stop = min(start + step, end)
        if data := _bytes(run[start:stop]):
            yield data
        start, step = stop, 2 * step


def _base64(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded) in a run: of all of it, or of what stands between its separators."""
    separators = [m.end() for m in SEPARATOR.finditer(run)]
    done = 0
    for start in [0, *separators]:
        if start < done or len(run) - start < MIN_RUN or start and not _likely(run[start:start + STEP]):
            continue
        end, found = len(run), False
        for plain in _plain(lambda: _steps(run, start, end)):
            yield start, end, plain
            found = True
        if not found and separators:
            upto = _utf8_up_to(_steps(run, start, len(run)))
            if upto and upto * 4 // 3 >= MIN_RUN:  # text up to a separator that is none of its own
                k = bisect.bisect_right(separators, start + (upto + 1) * 4 // 3 + 1) - 1
                while k >= 0 and (separators[k] - 1 - start) * 3 // 4 > upto:
                    k -= 1
                end = separators[k] - 1 if k >= 0 and separators[k] > start + MIN_RUN else 0
                for plain in _plain(lambda: _steps(run, start, end)) if end else ():
                    yield start, end, plain
                    found = True
        if found:
            done = end


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run without its breaks) of lines of one width, with or without the lines before and behind, likeliest first."""
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        k = 0
        while k < len(lines):
            width, last = lines[k][1] - lines[k][0], k + 1
            while last < len(lines) and lines[last][1] - lines[last][0] == width:
                last += 1
            if width >= MIN_RUN:
                shorter = last < len(lines) and lines[last][1] - lines[last][0] < width
                for a in ([k - 1] if k else []) + [k]:
                    for b in ([last + 1] if shorter else []) + [last]:
                        if b - a > 1:
                            yield lines[a][0], lines[b - 1][1], "".join(text[x:y] for x, y in lines[a:b])
            k = last


def layers(text: str) -> Iterator[tuple[int, int, str, list[int] | None]]:
    """Encoded runs of a text: (start, end, decoded, places of the decoded characters in the run or None)."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            plain, places = _mapped(m[0], PERCENT_UNIT, _percent)
            if plain != m[0]:
                yield m.start(), m.end(), plain, places
    if "\\" in text:
        for m in ESCAPE.finditer(text):
            plain, places = _mapped(m[0], ESCAPE_UNIT, _escaped)
            if plain != m[0]:
                yield m.start(), m.end(), plain, places
    joined = [(0, 0)]
    for start, end, run in _wrapped(text) if "\n" in text else ():
        if start < joined[-1][1]:
            continue
        data = bytes.fromhex(run) if HEX_RUN.fullmatch(run) else _bytes(run)
        for plain in _plain(_whole(data)):
            yield start, end, plain, None
            if joined[-1] != (start, end):
                joined.append((start, end))
    inside = lambda at: joined[bisect.bisect(joined, (at, len(text) + 1)) - 1][1] > at
    for m in BASE64.finditer(text):
        if not inside(m.start()):
            for a, b, plain in _base64(m[0]):
                yield m.start() + a, m.start() + b, plain, None
    for m in HEX_LAYER.finditer(text):
        if not inside(m.start()):
            for plain in _plain(_whole(bytes.fromhex(m[0]))):
                yield m.start(), m.end(), plain, None


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text."""
    text = text or ""
    base = base_spans(text)
    spans, seen = set(base), set()
    identity = lambda a, b: (a, b)
    work = [(layers(text), identity)]  # layers still to be opened, with the way from their places to the text's
    while work:
        found, up = work[-1]
        step = next(found, None)
        if step is None:
            work.pop()
            continue
        start, end, layer, places = step
        place = (lambda a, b, s=start, p=places, up=up: up(s + p[a], s + p[b])) if places else (lambda a, b, s=start, e=end, up=up: up(s, e))
        key = (place(0, len(layer)), hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        spans.update((kind, *place(a, b)) for kind, a, b in base_spans(layer))
        work.append((layers(layer), place))
    return base, sorted(spans, key=_order)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = scan(text if isinstance(text, str) else "")
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))
