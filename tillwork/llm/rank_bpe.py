"""Byte-pair encoding and decoding with a public tokenizer's vocabulary file.

Contiguous rank array: a word is a row of parts and a row of the ranks of adjacent
parts. The smallest rank is found by a scan, the boundary it stands for is deleted,
and the ranks to its left and right are looked up again, until no pair has a rank.
All short words of one length are done together: each step deletes one boundary in
every row that still has a rank, so the rows stay equally long and contiguous.
A scan per step is quadratic in the word, so words beyond ``SHORT`` bytes keep their
ranks in a heap instead, with the same result.

Texts are split at ASCII white space, which the vocabulary drops and never merges
across. Each distinct run is encoded once and kept; the kept runs are replaced by
the newer ones when there are too many. Runs of Latin-1 characters, which never
compose with each other, are lower-cased and split into words here; the normaliser
and word pattern of the file itself are applied to all others, so that letters and
composition follow its Unicode version. The names of special tokens are matched in
texts, in their own case, as the file's library does.

Defined cases: a null or empty text has no ids and decodes to the empty text.
Repeated rows are encoded each. Ids that are null or not in the vocabulary decode to
nothing. Columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from tillwork.llm.text import slices
from tillwork.llm.tokens import VOCABULARY, vocabulary_path

SHORT = 40
KEPT_RUNS = 200_000
SLICE_BYTES = 2_000_000
_NO_RANK = np.iinfo(np.int32).max

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# The letters, numbers and white space of lower-cased Latin-1 runs.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANKS = "\x85\xa0"
# The file's word pattern over them.
_LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


class Merges:
    """The merge table of a vocabulary file: rank of a pair of ids, id of a rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        signs = byte_signs()
        # Ids of single bytes, inside a word and at its end.
        self.single = np.array([
            [vocabulary[sign] for sign in signs], [vocabulary[sign + suffix] for sign in signs]], np.int64)
        self.size = max(vocabulary.values()) + 1
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        first = np.r_[True, np.diff(pairs[order]) > 0] if len(order) else np.zeros(0, bool)
        self._pairs = np.r_[pairs[order][first], np.iinfo(np.int64).max]
        self._ranks = np.r_[order[first], _NO_RANK]
        self._rank_of: dict[int, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NO_RANK`` for pairs that never merge."""
        pairs = left * self.size + right
        at = np.searchsorted(self._pairs, pairs)
        return np.where(self._pairs[at] == pairs, self._ranks[at], _NO_RANK)

    def rank_of(self) -> dict[int, int]:
        """The same as a dictionary, for one pair at a time."""
        if not self._rank_of:
            self._rank_of = dict(zip(self._pairs[:-1].tolist(), self._ranks[:-1].tolist(), strict=True))
        return self._rank_of


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the characters
    from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def merge_rows(words: np.ndarray, merges: Merges) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Encode words of one length, a row of bytes each: row numbers with their ids."""
    count, length = words.shape
    parts = merges.single[0][words]
    parts[:, -1] = merges.single[1][words[:, -1]]
    ranks = merges.ranks(parts[:, :-1], parts[:, 1:])
    number = np.arange(count)
    while length > 1:
        best = ranks.argmin(axis=1)
        lowest = ranks[np.arange(len(best)), best]
        done = lowest == _NO_RANK
        if done.any():
            yield number[done], parts[done]
            going = ~done
            number, parts, ranks, best, lowest = (x[going] for x in (number, parts, ranks, best, lowest))
        if not len(number):
            return
        row = np.arange(len(number))
        # Delete the boundary behind the best pair's first part, and the pair's rank.
        keep = np.ones(parts.shape, bool)
        keep[row, best + 1] = False
        parts = parts[keep].reshape(len(row), length - 1)
        parts[row, best] = merges.merged[lowest]
        keep = np.ones(ranks.shape, bool)
        keep[row, best] = False
        ranks = ranks[keep].reshape(len(row), length - 2)
        length -= 1
        left, right = best > 0, best < length - 1
        ranks[row[left], best[left] - 1] = merges.ranks(parts[row[left], best[left] - 1], parts[row[left], best[left]])
        ranks[row[right], best[right]] = merges.ranks(parts[row[right], best[right]], parts[row[right], best[right] + 1])
    if len(number):
        yield number, parts


def merge_long(word: bytes, merges: Merges) -> list[int]:
    """Encode one word of any length: ranks in a heap, parts in a linked list."""
    parts = merges.single[0][np.frombuffer(word, np.uint8)].tolist()
    parts[-1] = int(merges.single[1][word[-1]])
    rank_of, size, merged = merges.rank_of(), merges.size, merges.merged
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    heap = [(rank, i) for i in range(len(parts) - 1)
            if (rank := rank_of.get(parts[i] * size + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        # Entries of pairs that have changed since are passed over.
        if parts[i] < 0 or j < 0 or rank_of.get(parts[i] * size + parts[j]) != rank:
            continue
        parts[i], parts[j] = int(merged[rank]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (new := rank_of.get(parts[a] * size + parts[b])) is not None:
                heappush(heap, (new, a))
    return [part for part in parts if part >= 0]


def merge_words(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word, as little-endian 32-bit numbers."""
    found: list[bytes] = [b""] * len(words)
    if not words:
        return found
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0, True])
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        alike, length = order[start:end], int(lengths[order[start]])
        if length > SHORT:
            for i in alike.tolist():
                found[i] = np.array(merge_long(words[i], merges), "<i4").tobytes()
            continue
        joined = b"".join([words[i] for i in alike.tolist()])
        for rows, parts in merge_rows(np.frombuffer(joined, np.uint8).reshape(-1, length), merges):
            data, width = parts.astype("<i4").tobytes(), 4 * parts.shape[1]
            for place, i in enumerate(alike[rows].tolist()):
                found[i] = data[place * width:(place + 1) * width]
    return found


class Encoder:
    """Encodes texts run by run and keeps the runs it met."""

    def __init__(self, path: str, kept_runs: int = KEPT_RUNS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self._special = {t["content"]: t["id"] for t in stated["added_tokens"] if t["special"]}
        self._names = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        file_rules = Tokenizer.from_file(path)
        self._normaliser, self._splitter = file_rules.normalizer, file_rules.pre_tokenizer
        self._byte_of = {sign: byte for byte, sign in enumerate(byte_signs())}
        self._kept_runs = kept_runs
        self._runs: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _words(self, text: str) -> list[bytes]:
        """Words of a run, or of a part of one, in the bytes that are merged."""
        if max(text, default="") <= "\xff":
            return [word.encode() for word in _LATIN_WORDS.findall(text.lower())]
        split = self._splitter.pre_tokenize_str(self._normaliser.normalize_str(text))
        return [bytes(map(self._byte_of.__getitem__, word)) for word, _ in split]

    def _learn(self, runs: Iterable[bytes]) -> None:
        """Encode runs that are not kept: each word that occurs in them once."""
        number: dict[bytes, int] = {}
        # Runs of one word, of a word and marks behind it, and all others.
        words: list[bytes] = []
        marked: list[bytes] = []
        cores: list[int] = []
        marks: list[int] = []
        others: list[tuple[bytes, list[int]]] = []
        for run in runs:
            if run.isalpha():  # of bytes: A-Z and a-z only
                words.append(run)
                continue
            core = run.rstrip(_MARKS)
            if core.isalpha():
                marked.append(run)
                cores.append(number.setdefault(core.lower(), len(number)))
                marks.append(number.setdefault(run[len(core):], len(number)))
                continue
            text = run.decode("utf-8", "replace")
            if self._names is not None and b"<|" in run and self._names.search(text):
                pieces = []
                for piece in self._names.split(text):
                    if piece in self._special:
                        pieces.append(-1 - self._special[piece])
                    else:
                        pieces += [number.setdefault(w, len(number)) for w in self._words(piece)]
            else:
                pieces = [number.setdefault(w, len(number)) for w in self._words(text)]
            others.append((run, pieces))
        plain = [number.setdefault(word.lower(), len(number)) for word in words]
        ids = merge_words(list(number), self._merges)
        known = self._runs
        known.update(zip(words, map(ids.__getitem__, plain), strict=True))
        known.update(zip(
            marked, map(add, map(ids.__getitem__, cores), map(ids.__getitem__, marks)), strict=True))
        for run, pieces in others:
            known[run] = b"".join([ids[p] if p >= 0 else (-1 - p).to_bytes(4, "little") for p in pieces])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids end."""
        if len(self._runs) > self._kept_runs:
            self._older, self._runs = self._runs, {}
        whole = pa.array([text if _keeps_case(text) else text.lower() for text in texts], pa.large_binary())
        # As bytes: nothing here looks at characters beyond ASCII.
        split = pc.ascii_split_whitespace(whole.view(pa.large_string()))
        coded = split.flatten().view(pa.large_binary()).dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, older = self._runs, self._older
        found = list(map(known.get, met))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            runs = [met[k] for k in missing]
            known.update((run, older[run]) for run in runs if run in older)
            self._learn([run for run in runs if run not in known])
            for k, run in zip(missing, runs, strict=True):
                found[k] = known[run]
        ids = pa.array(found, pa.large_binary())
        joined = ids.take(coded.indices)
        starts = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) // 4
        ends = starts[split.offsets.to_numpy()[1:]]
        return np.frombuffer(joined.buffers()[2] or b"", "<i4", starts[-1]), ends


def _keeps_case(text: bytes) -> bool:
    """Whether lower-casing A-Z beforehand could change the ids.

    It could where a special token may be named, and where a letter may be composed
    with one of the marks U+0300 to U+037F, as some compose with small letters only.
    """
    return b"<|" in text or b"\xcc" in text or b"\xcd" in text


@cache
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process; what it keeps serves all tasks run there."""
    return Encoder(vocabulary_path(vocabulary))


@cache
def vocabulary_size(vocabulary: str) -> int:
    """One more than the largest id."""
    return len(_tokens(vocabulary)) - 1


@cache
def _tokens(vocabulary: str) -> pa.Array:
    """The token of each id, and a null behind them."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        stated = json.load(file)
    if stated["decoder"] is not None:
        raise NotImplementedError("only vocabularies that state no decoder: their tokens are joined by blanks")
    named = {i: token for token, i in stated["model"]["vocab"].items()}
    named |= {t["id"]: t["content"] for t in stated["added_tokens"]}
    return pa.array([named.get(i) for i in range(max(named) + 2)], pa.string())


def decode(ids: np.ndarray, offsets: np.ndarray, vocabulary: str = VOCABULARY) -> pa.Array:
    """The text of each list of ids: its tokens with a blank between."""
    tokens = _tokens(vocabulary)
    none = len(tokens) - 1
    named = tokens.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
    if named.null_count:
        there = named.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(there)][offsets]
        named = named.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), named), " ")


def _with(df: DataFrame, column: str, kind: DataType) -> StructType:
    return df.drop(column).schema.add(column, kind)


def _replaced(batch: pa.RecordBatch, dropped: str, **values: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != dropped and c not in values]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *values.values()], names=[*names, *values])


def encoded(
    docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, back: str | None = None,
) -> DataFrame:
    """``docs`` with the ids (``array<int>``) of its texts in place of the texts.

    ``back`` names a column for what the ids decode to, as ``decoded`` gives it, in the same pass.
    """
    work = "_text_bytes"
    rows = docs.withColumn(work, F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))).drop(
        text, ids, *([back] if back else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in slices(batches, work, SLICE_BYTES):
            numbers, ends = known.encode(batch.column(work).to_pylist())
            offsets = np.r_[0, ends]
            values = {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers, pa.int32()))}
            if back:
                values[back] = decode(numbers, offsets, vocabulary)
            yield _replaced(batch, work, **values)

    schema = _with(rows.drop(work), ids, ArrayType(IntegerType()))
    return rows.mapInArrow(encode, schema.add(back, StringType()) if back else schema)


def decoded(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text``, what its ids decode to; special tokens are shown by name."""

    def to_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(4 * SLICE_BYTES // 10, 4 * len(whole.column(ids).flatten())))
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                lists = batch.column(ids)
                values = lists.flatten()
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                numbers = pc.fill_null(values, -1).to_numpy()
                yield _replaced(batch, text, **{text: decode(numbers, np.r_[0, np.cumsum(counts)], vocabulary)})

    rows = df.drop(text)
    return rows.mapInArrow(to_text, _with(rows, text, StringType()))


def digests(df: DataFrame, ids: str = "ids", text: str = "decoded") -> list[Column]:
    """Count and SHA-256 of the ids, in decimal with a blank between, and SHA-256 of the decoded text."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    ]
