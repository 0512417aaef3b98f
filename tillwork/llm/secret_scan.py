"""Secrets in whole texts, inside encoded layers too.

Every text starts a worklist. A layer is scanned for secrets; then it is put on
the list again with all its URL codes decoded in place, again with all its Unicode
escapes, and each of its stretches that is base64 is decoded and, if it is zlib, gzip,
bzip2 or bare deflate data, unpacked, all members and packed data inside packed data
too, and put on the list as a layer of its own, until none is left. A layer that was
seen before is not scanned again, so decoding that leads back to itself ends. Each
layer carries, for every character, the stretch of the original text it stands for:
a secret found three layers down has a span in the text.

Packed data are read whole, however much they hold, as a series of layers of about
``CHUNK`` bytes that part at characters no secret or code can contain. A run without
such a character is kept together up to ``LONGEST_RUN`` bytes; a longer one is read in
pieces that overlap by ``OVERLAP``, enough for any plain secret in it.

Defined cases: a null text is empty. Bytes of a decoded layer that are no characters
stay in their places and part what stands before and behind them; a URL code or escape of
no character, or a URL code of a control character, stays as it is. Damaged packed data
are read up to the damage, to within one read. A percent sign, backslash or ampersand that
was coded more than ``KEPT_CODINGS`` times over is brought down to that in one step. Spans
are in code points, ends exclusive, in order and without repeats.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.text import documents_of, slices

# The kinds in order, and what a secret of each looks like.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_LEAST_ASSIGNED = 8
# A run of the class is taken whole, so only its length decides.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Two halves of a UTF-16 pair make one character.
_ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}"
    r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
# A base64 run in either alphabet, and lines of one that follow each other.
_LEAST_CODE = 16
_EITHER = re.compile(r"[A-Za-z0-9+/_-]{%d,}+" % _LEAST_CODE)
_ALPHABETS = (r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]")
_RUNS = tuple(re.compile(f"{c}{{{_LEAST_CODE},}}+") for c in _ALPHABETS)
_LINES = tuple(re.compile(f"(?<!{c}){c}++(?:[ \\t]*+\\r?\\n[ \\t]*+{c}++)++") for c in _ALPHABETS)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")

# Any secret, coded or not, has at least this many of these in a row.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")

# Codings of a character that codes begin with, where it was coded again and again.
KEPT_CODINGS = 8
_CODINGS = {"%": re.compile("25"), "\\": re.compile("u005[cC]|x5[cC]"), "&": re.compile("#38;|#[xX]26;")}
_CHAINS = {sign: re.compile(f"(?:{unit.pattern}){{{KEPT_CODINGS + 1},}}+") for sign, unit in _CODINGS.items()}

CHUNK = 1 << 20
LONGEST_RUN = 64 << 20
OVERLAP = 1 << 20
_READ = 4096
# What secrets, codes and lines of base64 are made of; bytes beyond ASCII may be half a character.
_INSIDE = frozenset(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\&#;{}\t\r\n" + bytes(range(128, 256)))
_PARTING = bytes(b not in _INSIDE for b in range(256))
MARK = "[SECRET]"

Span = tuple[int, int, int]


def found_in(text: str) -> list[Span]:
    """(start, end, kind) of the secrets that stand plainly in ``text``."""
    spans = [
        (m.start(), m.end(), 0) for m in _ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= _LEAST_ASSIGNED
    ]
    spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


class Layer:
    """A decoded text; ``starts`` and ``ends`` give each character's stretch of the original."""

    def __init__(self, text: str, starts, ends) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def original(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _is_text(data: bytes) -> bool:
    try:
        return not _CONTROL.search(data.decode())
    except UnicodeDecodeError:
        return False


def _of_bytes(data: bytes, starts, ends) -> Layer:
    """The layer that bytes make, given the stretch of every byte; bytes of no character are one each."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return Layer(text, starts, ends)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    stray = (code >= 0xDC80) & (code <= 0xDCFF)
    last = np.cumsum(np.where(stray, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))) - 1
    return Layer(text, starts[np.append(0, last[:-1] + 1)], ends[last])


def _replaced(layer: Layer, parts: list[tuple[int, int, str]]) -> Layer | None:
    """``layer`` with each stretch (start, end) replaced by one character; None if there is none."""
    if not parts:
        return None
    begin, end = (np.fromiter(column, np.int64, len(parts)) for column in list(zip(*parts, strict=True))[:2])
    # First and last place of every character: all places but those inside a stretch.
    kept = np.ones(len(layer.text) + 1, np.int64)
    np.add.at(kept, begin + 1, -1)
    np.add.at(kept, end, 1)
    kept[1:] -= 1
    first = np.flatnonzero(np.cumsum(kept[:-1]) > 0)
    last = np.append(first[1:], len(layer.text)) - 1
    text, at = [], 0
    for start, stop, character in parts:
        text += [layer.text[at:start], character]
        at = stop
    return Layer("".join([*text, layer.text[at:]]), layer.starts[first], layer.ends[last])


def _coded_once_more(text: str, sign: str, end: int) -> int:
    """Where a code of ``sign`` that ends at ``end`` ends with the codings of it that are too many."""
    if sign in _CHAINS and (codings := _CHAINS[sign].match(text, end)):
        return [m.end() for m in _CODINGS[sign].finditer(text, *codings.span())][-KEPT_CODINGS - 1]
    return end


def _percent_layer(layer: Layer) -> Layer | None:
    """The layer with all its URL codes decoded in place; codes of no character are kept as they are."""
    parts = []
    for run in _PERCENTS.finditer(layer.text):
        at = run.start()
        for character in bytes.fromhex(run.group().replace("%", "")).decode("utf-8", "surrogateescape"):
            broken = "\udc80" <= character <= "\udcff"
            end = at + 3 * (1 if broken else len(character.encode()))
            if not broken and not _CONTROL.match(character):
                parts.append((at, _coded_once_more(layer.text, character, end), character))
            at = end
    return _replaced(layer, parts)


def _escape_layer(layer: Layer) -> Layer | None:
    """The layer with all its Unicode escapes decoded in place; those of no character are kept."""
    parts = []
    for escape in _ESCAPE.finditer(layer.text):
        code = escape.group()
        if len(code) == 12 and code[0] == "\\" and code[6] == "\\":
            number = 0x10000 + ((int(code[2:6], 16) - 0xD800) << 10) + int(code[8:], 16) - 0xDC00
        else:
            number = (int(code[2:-1], 10) if code[:2] == "&#" and code[2] not in "xX"
                      else int(code[3:-1], 16) if code[:2] == "&#" or code[2] == "{" else int(code[2:], 16))
        if number < 0x110000 and not 0xD800 <= number < 0xE000:
            start, end = escape.span()
            parts.append((start, _coded_once_more(layer.text, chr(number), end), chr(number)))
    return _replaced(layer, parts)


def _opener(head: bytes) -> Callable | None:
    """What unpacks data that begin so."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 5 and int.from_bytes(head[:2], "big") % 31 == 0:
        return lambda: zlib.decompressobj(zlib.MAX_WBITS | 32)
    return bz2.BZ2Decompressor if head[:3] == b"BZh" else None


def _pieces(data: bytes) -> Iterator[bytes]:
    return (data[at:at + _READ] for at in range(0, len(data), _READ))


def _opened(packed: Iterable[bytes], opener: Callable) -> Iterator[bytes]:
    """What packed data hold, member by member, then whatever follows them as it is."""
    packed = iter(packed)
    machine, held = opener(), b""
    try:
        for piece in packed:
            data, held = held + piece, b""
            while data or not machine.eof:
                if machine.eof:
                    if len(data) < 6:
                        held = data
                        break
                    if (opener := _opener(data)) is None:
                        yield data
                        yield from packed
                        return
                    machine = opener()
                out = machine.decompress(data, CHUNK)
                if out:
                    yield out
                data = machine.unused_data if machine.eof else getattr(machine, "unconsumed_tail", b"")
                # Output may be waiting though all input was taken.
                if not data and len(out) < CHUNK:
                    break
    except (zlib.error, OSError, ValueError, EOFError):
        return
    if held:
        yield held


def _is_deflate(data: bytes) -> bool:
    """Whether ``data``, all of them, are bare deflate data."""
    machine, held = zlib.decompressobj(-zlib.MAX_WBITS), 0
    try:
        out = machine.decompress(data, CHUNK)
        while out and not machine.eof:
            held += len(out)
            out = machine.decompress(machine.unconsumed_tail, CHUNK)
    except zlib.error:
        return False
    return machine.eof and not machine.unused_data and held + len(out) > 0


def _unpacked(data: bytes) -> Iterator[bytes] | None:
    """What packed data hold in the end, in chunks; None if ``data`` are not packed."""
    seen: set[bytes] = set()
    level: Iterator[bytes] = iter([data])
    for depth in itertools.count():
        head, whole = bytearray(), True
        for chunk in level:
            head += chunk
            if depth and len(head) > CHUNK:
                whole = False
                break
        head = bytes(head)
        if whole:
            key = hashlib.blake2b(head, digest_size=16).digest()
            if key in seen:
                return iter(())
            seen.add(key)
        opener = _opener(head)
        if opener is None and whole and not _is_text(head) and _is_deflate(head):
            def opener():
                return zlib.decompressobj(-zlib.MAX_WBITS)
        first = None
        if opener is not None:
            inner = _opened(itertools.chain(_pieces(head), level), opener)
            first = next(inner, None)
        if first is None:
            return itertools.chain([head], level) if depth else None
        level = itertools.chain([first], inner)


def _parted(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The chunks joined and parted anew, where no secret, code or character is cut."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) < CHUNK:
            continue
        at = held.translate(_PARTING).rfind(1) + 1
        if at:
            yield held[:at]
            held = held[at:]
        elif len(held) > LONGEST_RUN:
            yield held
            # Four characters of base64 stay together.
            held = held[(len(held) - OVERLAP) // 4 * 4:]
    if held:
        yield held


def _wrapped(text: str) -> Iterator[list[list[tuple[int, int]]]]:
    """Readings of each block of base64 lines, the likelier first; a reading is the places of its lines.

    The lines of a block are equally long but for a shorter last one, and the first
    may start or the last end within other text. What stands there may also be no
    part of the block, so it is read without them too.
    """
    for lines in _LINES:
        for match in lines.finditer(text):
            places = [m.span() for m in _LINE.finditer(text, *match.span())]
            lengths = [end - start for start, end in places]
            at = 0
            while at < len(places):
                upto = at + 1
                while upto < len(places) and lengths[upto] == lengths[at]:
                    upto += 1
                tail = upto < len(places) and lengths[upto] < lengths[at]
                # '-----END' closes a block, but in the URL alphabet it could be code.
                closed = tail and text.startswith("-----", places[upto][0])
                readings = [
                    places[start:end] for start in ([0, 1] if at == 1 else [at])
                    for end in (([upto, upto + 1] if closed else [upto + 1, upto]) if tail else [upto])]
                readings = [
                    r for r in readings if (len(r) > 1 or closed) and sum(end - start for start, end in r) >= _LEAST_CODE]
                if readings:
                    yield readings
                at = upto


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of base64 on one line, in one alphabet or the other, the longer before those inside them."""
    for run in _EITHER.finditer(text):
        found = {m.span() for runs in _RUNS for m in runs.finditer(text, *run.span())}
        yield sorted(found, key=lambda span: span[0] - span[1])


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    # Places that a reading has explained are not read again in part.
    taken: bytearray | None = None

    def decoded(places: list[tuple[int, int]]) -> tuple[Iterable[Layer], bool]:
        nonlocal taken
        found, explained = _of_base64(layer, places)
        if explained:
            taken = bytearray(len(text)) if taken is None else taken
            for start, end in places:
                taken[start:end] = b"\1" * (end - start)
        return found, explained

    if "\n" in text:
        # Longer blocks first, so that their parts in the other alphabet are not read again.
        for readings in sorted(_wrapped(text), key=lambda r: r[0][0][0] - r[0][-1][1]):
            for places in readings:
                if taken is not None and sum(taken.count(0, *place) for place in places) < _LEAST_CODE:
                    break
                found, explained = decoded(places)
                yield from found
                if explained:
                    break
    for spans in _runs(text):
        for start, end in spans:
            if taken is None or taken.find(0, start, end) >= 0:
                yield from decoded([(start, end)])[0]


def _of_base64(layer: Layer, places: list[tuple[int, int]]) -> tuple[Iterable[Layer], bool]:
    """The layers that the base64 in these places of ``layer`` makes, its lines joined.

    True with them if they are packed data or text throughout, so that the places are
    surely base64. Others are read for the text that may stand between other bytes.
    """
    code = "".join(layer.text[start:end] for start, end in places)
    code = code[:-1] if len(code) % 4 == 1 else code
    pad = -len(code) % 4
    try:
        data = base64.b64decode(code + "=" * pad, b"-_" if "-" in code or "_" in code else None, True)
    except (binascii.Error, ValueError):
        return (), False
    packed = _unpacked(data)
    if packed is not None:
        # Bytes of a packed layer stand for the whole stretch, its padding included.
        end = places[-1][1]
        end += pad if pad and layer.text.startswith("=" * pad, end) else 0
        whole = layer.original(places[0][0], end)
        return (_of_bytes(p, _Same(whole[0], len(p)), _Same(whole[1], len(p))) for p in _parted(packed)), True
    explained = _is_text(data)
    if not explained and not _READABLE.search(data):
        return (), False
    at = np.concatenate([np.arange(start, end) for start, end in places])
    byte = np.arange(len(data))
    first = byte // 3 * 4 + byte % 3
    return [_of_bytes(data, layer.starts[at[first]], layer.ends[at[first + 1]])], explained


class _Same:
    """A sequence that holds one value everywhere."""

    def __init__(self, value: int, size: int) -> None:
        self._value, self._size = value, size

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, place):
        return self._value if np.ndim(place) == 0 else _Same(self._value, len(place))


class _Steps:
    """Place plus a constant, for the text itself."""

    def __init__(self, add: int) -> None:
        self._add = add

    def __getitem__(self, place):
        return place + self._add


def _layers_in(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and (decoded := _percent_layer(layer)):
        yield decoded
    if ("\\" in layer.text or "&#" in layer.text) and (decoded := _escape_layer(layer)):
        yield decoded
    yield from _base64_layers(layer)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Secrets that stand plainly in the text, and those with the decoded layers' ones."""
    base = found_in(text)
    spans = set(base)
    seen: set[bytes] = set()
    # Layers are decoded when their turn comes: one of each depth is held.
    work = [_layers_in(Layer(text, _Steps(0), _Steps(1)))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = hashlib.blake2b(f"{int(layer.starts[0])}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        spans.update((*layer.original(start, end), kind) for start, end, kind in found_in(layer.text))
        work.append(_layers_in(layer))
    return base, sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of the secrets of every row of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text.decode("utf-8", "replace"))
                counts = [sum(kind == k for _, _, kind in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in columns)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return documents_of(docs).mapInArrow(find, SCAN)


def without_secrets(text: str, mark: str = MARK) -> str:
    """The text with ``mark`` in the place of every span; spans that overlap become one."""
    kept, at, upto = [], 0, -1
    for start, end, _ in all_spans(text)[1]:
        if start >= upto:
            kept += [text[at:start], mark]
        upto = at = max(upto, end)
    return "".join([*kept, text[at:]])


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without secrets and ``n_chars``, if there, to match."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [
                None if t is None else without_secrets(t, mark) for t in batch.column("text").to_pylist()]
            columns = [
                pa.array(texts, batch.schema.field("text").type) if name == "text" else batch.column(name)
                for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    changed = docs.mapInArrow(replace, docs.schema)
    if "n_chars" not in docs.columns:
        return changed
    kind = dict(docs.dtypes)["n_chars"]
    return changed.withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
