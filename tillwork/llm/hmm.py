"""Scoring of whole texts with a hidden Markov language model.

Words are counted over all training texts. Each word seen ``LEAST_SEEN`` times has an
emission probability in each latent state; all others share one there and are told apart
by their smoothed share, so the model covers every word. Baum-Welch trains the states: each
task sums expected counts over its whole texts, Spark adds the tasks' sums, and the new model
goes out with the next pass. Training and scoring are exact; texts too long to step through
are cut into stretches whose transfer matrices are computed side by side and
then multiplied, which gives each stretch what comes before and behind it.

The counts and emissions of frequent words go to all tasks: of as many classes of counts,
``CLASSES`` to a doubling, as hold ``SENT`` words at most. All other words are looked up by a
join, in which no word is frequent, and their emissions stay in a table that grows with the
corpus. During the passes these outer words share the symbol ``rare`` with the seldom ones. The
last pass also sums what each of them is expected to count in each state, which divides the
emission of ``rare`` among them.

Defined cases: a null or empty text is its end alone. Without training texts all
counts are zero and every word has probability 1 in the base score. Repeated rows
are scored each. A null doc_id counts as an empty one in the split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.text import RowKeys, documents_of, slices, split_number
from tillwork.llm.wanted import marked, marks
from tillwork.sources.scratch import materialise, new_path

STATES = 8
PASSES = 4
FOLDS, HELD_OUT = 5, 1
# Rarer words say too little of their state to have an emission of their own.
LEAST_SEEN = 8
SENT = 250_000
CLASSES = 64
LONGEST_SENT = 64
LONG = 65_536
_STRETCH = 4096
# Texts of more words are trained on in stretches; as many symbols are worked on at a time.
TRAINED = 16_384
_AT_ONCE = 1 << 20
# Steps of the recursions from one scaling to the next.
_STEPS = 8
_HELD_WORDS = 400_000
_END, _RARE = 0, 1
_SCALE = 1 << 16
_PRIOR, _SHARED = 100.0, 0.05
# The end of a text in the count table; no word is empty.
_END_WORD = b""


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over the training texts, ends included, in a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen.update(_words(text))
            seen[_END_WORD] += batch.num_rows
            if len(seen) > _HELD_WORDS:
                yield _counts(seen)
                seen.clear()
        yield _counts(seen)

    training = documents_of(docs).where(split_number(FOLDS) != HELD_OUT)
    counts = training.mapInArrow(count, "word binary, n long")
    return materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _counts(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """Counts that all tasks have. Words are in order of their counts."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    ends: int
    total: int
    distinct: int
    # The least class of counts that is sent, and the words seen often enough that are not.
    least: int | None = None
    outer_words: int = 0
    outer_total: int = 0

    @property
    def named(self) -> int:
        """Words with an emission of their own, the first ones."""
        return int((self.counts >= LEAST_SEEN).sum())

    @property
    def base_denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def rare_total(self) -> int:
        return self.total - self.ends - int(self.counts[:self.named].sum())

    @property
    def rare_denominator(self) -> float:
        rare_words = self.distinct - (self.ends > 0) - self.named
        return self.rare_total + 0.5 * (rare_words + 1)

    @property
    def seldom_denominator(self) -> float:
        """The part of ``rare_denominator`` of words without an emission of their own."""
        return self.rare_denominator - self.outer_total - 0.5 * self.outer_words

    def shares(self) -> np.ndarray:
        """Smoothed share of each symbol."""
        counts = np.r_[self.ends, self.rare_total, self.counts[:self.named]] + 0.5
        return counts / counts.sum()


def _size() -> Column:
    return F.floor(F.log2("n") * CLASSES)


def _is_sent(least: int | None) -> Column:
    if least is None:
        return F.lit(False)
    return F.octet_length("word").between(1, LONGEST_SENT) & (_size() >= least)


def _is_outer(least: int | None) -> Column:
    return (F.octet_length("word") > 0) & (F.col("n") >= LEAST_SEEN) & ~_is_sent(least)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    ends = counts.where(F.octet_length("word") == 0).first()
    short = counts.where(F.octet_length("word").between(1, LONGEST_SENT))
    sent, least = 0, None
    for row in sorted(short.groupBy(_size().alias("size")).count().collect(), reverse=True):
        sent += row["count"]
        if sent > SENT:
            break
        least = row["size"]
    # At most SENT rows.
    table = counts.where(_is_sent(least)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    outer_total, outer_words = counts.where(_is_outer(least)).agg(F.sum("n"), F.count("*")).first()
    return Vocabulary(
        tuple(table.column("word").to_pylist()), table.column("n").to_numpy().astype(np.int64),
        ends["n"] if ends else 0, total or 0, distinct, least, outer_words, outer_total or 0)


ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare double, "
    "symbols binary, others array<struct<word binary, n long>>")


def _others(words: list[bytes], text_of: np.ndarray, texts: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of each text with their counts, and the place of each word among its text's."""
    distinct = pa.array(words, pa.binary()).dictionary_encode()
    size = len(distinct.dictionary) + 1
    pairs, place, counts = np.unique(
        text_of * size + distinct.indices.to_numpy(), return_inverse=True, return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(texts + 1) * size)
    kept = pa.StructArray.from_arrays(
        [distinct.dictionary.take(pa.array(pairs % size)), pa.array(counts.astype(np.int64))], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept), place - offsets[text_of]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as symbols, with what the words in the vocabulary add to the scores.

    Symbols beyond those of the vocabulary stand for the text's ``others``, in their order.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: place for place, word in enumerate(vocabulary.words)}
        base = np.r_[np.log10((vocabulary.counts + 0.5) / vocabulary.base_denominator), 0]
        rare = np.r_[np.log10((vocabulary.counts + 0.5) / vocabulary.seldom_denominator), 0]
        rare[:vocabulary.named] = 0
        end = float(np.log10((vocabulary.ends + 0.5) / vocabulary.base_denominator))
        keys = RowKeys()
        for batch in slices(batches, "text"):
            split = [_words(text) for text in batch.column("text").to_pylist()]
            words = list(chain.from_iterable(split))
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            text_of = np.repeat(np.arange(len(split)), lengths)
            places = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            symbols = np.where(places < vocabulary.named, places + 2, _RARE)
            unknown = np.flatnonzero(places < 0)
            others, codes = _others([words[i] for i in unknown.tolist()], text_of[unknown], len(split))
            symbols[unknown] = codes + vocabulary.named + 2
            ends = np.cumsum(lengths)
            data = np.insert(symbols, ends, _END).astype("<u4")
            offsets = np.r_[0, 4 * (ends + np.arange(1, len(split) + 1))].astype(np.int32)
            known = np.bincount(text_of[places >= 0], minlength=len(split)) + (vocabulary.ends > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.take(len(split))), batch.column("doc_id"), batch.column("held_out"),
                 pa.array(lengths + 1), pa.array(known.astype(np.int64)),
                 pa.array(np.bincount(text_of, base[places], len(split)) + end, pa.float64()),
                 pa.array(np.bincount(text_of, rare[places], len(split)), pa.float64()),
                 pa.BinaryArray.from_buffers(pa.binary(), len(split), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                 others],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "symbols", "others"])

    path = new_path(docs.sparkSession, "encoded")
    split = documents_of(docs).withColumn("held_out", split_number(FOLDS) == HELD_OUT)
    split.mapInArrow(turn, ENCODED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ENCODED).parquet(path)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(vocabulary: Vocabulary, states: int) -> Model:
    """Sticky states whose emissions differ by a hash of the word."""
    names = [b"\0end", b"\0rare", *vocabulary.words[:vocabulary.named]]
    uniform = np.array([[xxhash.xxh3_64_intdigest(w, k) for k in range(states)] for w in names]) / 2.0 ** 64
    emit = vocabulary.shares()[:, None] * np.exp(2 * uniform)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _stretches(texts: list[np.ndarray], model: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the texts with the state distribution at the end of what is before each,
    the weight of each last state by what is behind, and whether a text starts there."""
    parts, before, behind, first = [], [], [], []
    states = len(model.start)
    cuts = [[text[k:k + TRAINED] for k in range(0, len(text), TRAINED)] for text in texts]
    # The stretches of all long texts side by side.
    several = [part for cut in cuts if len(cut) > 1 for part in cut]
    all_logs, all_reached = _transfers(several, model) if several else (np.zeros((0, states)),) * 2
    at = 0
    for cut in cuts:
        ends = [model.start]
        weights = [np.ones(states)]
        if len(cut) > 1:
            logs, reached = all_logs[at:at + len(cut)], all_reached[at:at + len(cut)]
            at += len(cut)
            power = 10 ** (logs - logs.max(1, keepdims=True))
            for k in range(len(cut) - 1):
                ahead = ends[-1] @ model.move if k else ends[-1]
                state = (ahead * power[k]) @ reached[k]
                ends.append(state / state.sum())
            for k in range(len(cut) - 1, 0, -1):
                weight = model.move @ (power[k] * (reached[k] @ weights[-1]))
                weights.append(weight / weight.sum())
        parts += cut
        before += ends
        behind += weights[::-1]
        first += [True] + [False] * (len(cut) - 1)
    return parts, np.array(before), np.array(behind), np.array(first)


def _expected(texts: list[np.ndarray], model: Model) -> Model:
    """Expected counts of starts, moves and emissions in whole texts."""
    found = Model(np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit))
    parts, before, behind, first = _stretches(texts, model)
    group = np.cumsum([len(p) for p in parts]) // _AT_ONCE
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        _add_expected([parts[i] for i in at], before[at], behind[at], first[at], model, found)
    return found


def _even(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Emissions over their mean in all states, and log10 of that mean, by symbol."""
    mean = model.emit.mean(1)
    return model.emit / mean[:, None], np.log10(mean)


def _add_expected(parts, before, behind, first, model: Model, found: Model) -> None:
    """Add what stretches side by side, the longest first, are expected to count."""
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    flat = np.concatenate(parts).astype(np.int64)
    before, first = before[order], first[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), "right").tolist()
    # Symbols, emissions and states of one step after another.
    seen = np.concatenate([flat[starts[:count] + t] for t, count in enumerate(active)])
    ahead = _even(model)[0][seen]
    forward = np.empty_like(ahead)
    at = np.r_[0, np.cumsum(active)].tolist()
    scales: dict[int, np.ndarray] = {}
    for t, count in enumerate(active):
        state = forward[at[t]:at[t + 1]]
        if t:
            np.matmul(forward[at[t - 1]:at[t - 1] + count], model.move, out=state)
        else:
            state[:] = np.where(first[:, None], before, before @ model.move)
        state *= ahead[at[t]:at[t + 1]]
        if t % _STEPS == _STEPS - 1:
            scales[t] = state.sum(1, keepdims=True)
            state /= scales[t]
    weights, back, moved = behind[order], np.ascontiguousarray(model.move.T), np.zeros_like(model.move)
    for t in range(len(active) - 1, -1, -1):
        count, over = active[t], active[t + 1] if t + 1 < len(active) else 0
        state, weight, after = forward[at[t]:at[t + 1]], weights[:count], ahead[at[t]:at[t + 1]]
        # Stretches that end here start their way back.
        if over < count:
            weight[over:] /= (state[over:] * weight[over:]).sum(1, keepdims=True)
        after *= weight
        if t in scales:
            after /= scales[t]
        if t:
            moved += forward[at[t - 1]:at[t - 1] + count].T @ after
        else:
            found.start[:] += (state * weight)[first].sum(0)
            moved += before[~first].T @ after[~first]
        state *= weight
        np.matmul(after, back, out=weight)
    found.move[:] += moved * model.move
    posterior = np.ascontiguousarray(forward.T)
    for k in range(len(model.start)):
        found.emit[:, k] += np.bincount(seen, posterior[k], len(model.emit))


def _own_symbols(batch: pa.RecordBatch, counts: np.ndarray, symbol_of: np.ndarray, known: int) -> list[np.ndarray]:
    """The texts of a batch with a symbol for each of their others, ``counts`` of them to a text,
    in place of the numbers from ``known`` on."""
    texts = [np.frombuffer(s, "<u4").astype(np.int64) for s in batch.column("symbols").to_pylist()]
    for text, start in zip(texts, (np.cumsum(counts) - counts).tolist(), strict=True):
        beyond = np.flatnonzero(text >= known)
        text[beyond] = symbol_of[start + text[beyond] - known]
    return texts


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, a null one 0, and all their elements."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64), column.flatten()


def train(
    encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES,
) -> tuple[Model, DataFrame]:
    """Baum-Welch over all training texts, in one pass at least: the model, and ``word, emission`` of the outer words."""
    if passes < 1:
        raise ValueError("there must be a pass")
    context = encoded.sparkSession.sparkContext
    model = first_model(vocabulary, states)
    shares = vocabulary.shares()
    outer = counts.where(_is_outer(vocabulary.least))
    keys = outer.select(F.xxhash64("word").alias("key"))
    wanted = marks(keys, "key", vocabulary.outer_words)
    # Sums leave a task once, so fewer and longer tasks send less.
    training = encoded.where(~F.col("held_out")).coalesce(4 * context.defaultParallelism)
    columns = [f"s{k}" for k in range(states)]
    sums = [F.sum(c).alias(c) for c in columns]
    schema = ", ".join(["symbol long", "word binary", *(f"{c} long" for c in columns)])
    for done in range(1, passes + 1):
        if done < passes:
            expected = training.select("symbols").mapInArrow(_summing(model), schema).groupBy("symbol").agg(*sums)
        else:
            last = training.select("symbols", "others").mapInArrow(_summing(model, wanted), schema)
            everything = materialise(last.groupBy("symbol", "word").agg(*sums), "expected")
            expected = everything.where("word IS NULL").drop("word")
        table = expected.toArrow()
        found = np.zeros((len(model.emit) + states + 1, states))
        found[table.column("symbol").to_numpy()] = np.stack(
            [table.column(c).to_numpy() for c in columns], axis=1) / _SCALE
        emit, move, start = np.split(found, [len(model.emit), len(model.emit) + states])
        rare = emit[_RARE]
        emit = emit + (_PRIOR + _SHARED * emit.sum(0)) * shares[:, None]
        move, start = move + 1, start[0] + 1
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    # Words the filter let pass by chance are in no row of the join.
    named = materialise(everything.join(outer, "word").select("word", "n", *columns), "outer")
    return divided(model, vocabulary, rare, named, columns)


def divided(
    model: Model, vocabulary: Vocabulary, rare: np.ndarray, named: DataFrame, columns: list[str],
) -> tuple[Model, DataFrame]:
    """The emission of ``rare``, expected ``rare`` times in each state, divided among the outer words and the rest."""
    outer = np.array([x or 0 for x in named.agg(*(F.sum(c) for c in columns)).first()]) / _SCALE
    prior = _PRIOR + _SHARED * rare
    each = model.emit[_RARE] / (rare + prior)
    share = (F.col("n") + F.lit(0.5)) / F.lit(vocabulary.rare_denominator)
    emission = F.array(*(
        (F.lit(float(e)) * (F.col(c) / F.lit(_SCALE) + F.lit(float(p)) * share)).cast("float")
        for e, p, c in zip(each, prior, columns, strict=True)))
    emit = model.emit.copy()
    seldom = vocabulary.seldom_denominator / vocabulary.rare_denominator
    emit[_RARE] = each * (np.maximum(rare - outer, 0) + prior * seldom)
    return Model(model.start, model.move, emit), named.select("word", emission.alias("emission"))


def _summing(model: Model, wanted: np.ndarray | None = None):
    """Sums of expected counts; with the filter ``wanted`` also those of the words it lets pass."""
    symbols, states = model.emit.shape

    def rows(numbers: np.ndarray, words: list[bytes] | None, values: np.ndarray) -> pa.RecordBatch:
        values = np.rint(values * _SCALE).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(words or [None] * len(numbers), pa.binary()),
             *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(states))],
            names=["symbol", "word", *(f"s{k}" for k in range(states))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((symbols + states + 1, states))
        for batch in slices(batches, "symbols"):
            words: list[bytes] = []
            if wanted is None:
                texts = [np.frombuffer(s, "<u4") for s in batch.column("symbols").to_pylist()]
                texts = [np.where(text < symbols, text, _RARE) for text in texts]
            else:
                counts, others = _lists(batch.column("others"))
                distinct = pc.dictionary_encode(others.field("word"))
                named = distinct.dictionary.to_pylist()
                keys = np.array([xxhash.xxh64_intdigest(w, 42) for w in named], np.uint64).view(np.int64)
                passed = np.flatnonzero(marked(keys, wanted))
                words = [named[i] for i in passed.tolist()]
                symbol_of = np.full(len(named), _RARE)
                symbol_of[passed] = symbols + np.arange(len(passed))
                texts = _own_symbols(batch, counts, symbol_of[distinct.indices.to_numpy()], symbols)
            wide = Model(model.start, model.move, np.r_[model.emit, np.repeat(model.emit[_RARE:_RARE + 1], len(words), 0)])
            found = _expected(texts, wide)
            total[:symbols] += found.emit[:symbols]
            total[symbols:symbols + states] += found.move
            total[-1] += found.start
            if words:
                total[_RARE] += found.emit[symbols:].sum(0)
                yield rows(np.full(len(words), -1), words, found.emit[symbols:])
        used = np.flatnonzero(np.rint(total * _SCALE).any(1))
        yield rows(used, None, total[used])

    return add


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    result = np.zeros(len(sequences))
    short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
    start = np.broadcast_to(model.start, (len(short), len(model.start)))
    result[short], _ = _forward([sequences[i] for i in short], start, model)
    for i in set(range(len(sequences))) - set(short):
        result[i] = _long(sequences[i], model)
    return result


def _forward(sequences: list[np.ndarray], before: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled recursion side by side; ``before`` is the state distribution of the first symbol."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    flat = np.concatenate([np.zeros(0, np.int64), *sequences]).astype(np.int64)
    ordered = lengths[order]
    emit, log_mean = _even(model)
    logs, last = np.zeros(len(sequences)), np.array(before)[order]
    filled = np.flatnonzero(lengths)
    logs[filled] = np.add.reduceat(log_mean[flat], (np.cumsum(lengths) - lengths)[filled]) if len(filled) else 0
    logs = logs[order]
    active = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), "right").tolist()
    state = last.copy()
    for t, count in enumerate(active):
        over = active[t + 1] if t + 1 < len(active) else 0
        ahead = state[:count] if t == 0 else state[:count] @ model.move
        state = ahead * emit[flat[starts[:count] + t]]
        if t % _STEPS == _STEPS - 1:
            scale = state.sum(1)
            state /= scale[:, None]
            logs[:count] += np.log10(scale)
        if over < count:
            scale = state[over:].sum(1)
            last[over:count] = state[over:] / scale[:, None]
            logs[over:count] += np.log10(scale)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return logs[back], last[back]


def _transfers(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch and first state: log10 probability, and the distribution of the last state."""
    states = len(model.start)
    each = max(1, _AT_ONCE // (states * max(map(len, parts))))
    found = []
    for k in range(0, len(parts), each):
        some = parts[k:k + each]
        found.append(_forward([p for p in some for _ in range(states)], np.tile(np.eye(states), (len(some), 1)), model))
    logs, ends = (np.concatenate(f) for f in zip(*found, strict=True))
    return logs.reshape(-1, states), ends.reshape(-1, states, states)


def _long(sequence: np.ndarray, model: Model) -> float:
    """The same for one long sequence, by the transfer matrices of its stretches."""
    logs, ends = _transfers([sequence[k:k + _STRETCH] for k in range(0, len(sequence), _STRETCH)], model)
    total, state = 0.0, model.start
    for k, (log, end) in enumerate(zip(logs, ends, strict=True)):
        weights = state if k == 0 else state @ model.move
        largest = log.max()
        reached = (weights * 10 ** (log - largest)) @ end
        total += largest + np.log10(reached.sum())
        state = reached / reached.sum()
    return float(total)


def score(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Token counts, base score and the model's log10 probability of every row."""
    counts = count_words(docs)
    words = vocabulary(counts)
    encoded = encode(docs, words)
    model, emissions = train(encoded, counts, words, states, passes)
    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "more", "more_base", "more_rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "symbols"):
            counted, found = _lists(batch.column("outer"))
            others = batch.column("others").to_numpy().astype(np.int64)
            # A symbol for each outer word of each text.
            own = found.field("emission").flatten().to_numpy().reshape(-1, states)
            symbol_of = np.full(others.sum(), _RARE)
            start = np.repeat(np.cumsum(others) - others, counted)
            symbol_of[start + found.field("at").to_numpy()] = len(model.emit) + np.arange(len(own))
            texts = _own_symbols(batch, others, symbol_of, len(model.emit))
            wide = Model(model.start, model.move, np.r_[model.emit, own])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(log_likelihoods(texts, wide))], names=[*kept, "path"])

    of_text = encoded.select("row", F.posexplode("others").alias("at", "other")).select("row", "at", "other.*")
    # Outer words without an emission in the training texts are none: all are seen there.
    looked_up = counts.withColumnRenamed("n", "c").join(emissions, "word", "left")
    share = F.coalesce("c", F.lit(0)) + F.lit(0.5)
    own = F.col("emission").isNotNull()
    by_text = of_text.join(looked_up, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(share / words.base_denominator)).alias("more_base"),
        F.sum(F.when(own, 0.0).otherwise(F.col("n") * F.log10(share / words.seldom_denominator))).alias("more_rare"),
        F.collect_list(F.when(own, F.struct("at", "emission"))).alias("outer"))
    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare double, "
        "more long, more_base double, more_rare double, path double")
    scored = encoded.withColumn("others", F.size("others")).join(by_text, "row", "left").mapInArrow(run, schema)
    zero = F.lit(0.0)
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("path") + F.col("rare") + F.coalesce("more_rare", zero)).alias("score"))
