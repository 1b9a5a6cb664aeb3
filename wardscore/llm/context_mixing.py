"""Language-model scores by logistic mixing of hashed-context bit predictors.

A token is spelled as bits: frequent tokens by their path in a Huffman tree, others by an escape and a Huffman code of their
bytes. Four predictors know the bits' counts in the training texts, each under another hashed context: none, the token
before, the two tokens before, and the last very frequent token, which tells the language; inside spelled words the bytes
before, the word so far, and bytes before with the language. A mixer adds the predictors' log odds with weights from a set
that a gate picks by how much each predictor has seen.
The weights are learned from all training texts: these are dealt into two folds by a hash of their text, and each is predicted
from the bits of the other, so that no text is judged by counts it has entered. What the mixer learns from is counted by Spark:
how often a bit was 0 and 1 at a depth when the predictors were in certain states. The weights go on adapting inside each scored
text (from one stretch of tokens to the next, so that only what has been read is used), and a last map refines the mixed
probability by what such predictions were worth. The sum of the bits' log probabilities is the text's.

What tasks gather from the corpus is summed by Spark: token counts by token, bit counts and states by slices of tables, which
have a fixed size. Beside it stands the unigram score; counts of the most frequent tokens go to every task, up to a
checked number, and those of all others are joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.line_quality import remainder
from wardscore.llm.text_bytes import LOWER, STIR, U64, flat, pieces, ragged, slice_hashes, small_batches, stirred, word_bounds
from wardscore.operators.settle import land

# Tokens with a path of their own, tokens whose counts go to every task, frequent tokens that tell the language.
CODED, KNOWN, TELLING = 1 << 17, 1 << 18, 256
# Occurrences from which a token has a path of its own.
LEAST_CODED = 3
# Slots of the predictors' tables, and slots in a slice.
SLOTS = (1 << 18, 1 << 21, 1 << 21, 1 << 21)
SLICE = 1 << 15
# Tokens between two updates inside a text; bytes of text handled at once, and bits hashed at once: so few that the arrays stay
# in the processor's caches.
STRETCH = 64
CHUNK, BLOCK = 1 << 19, 1 << 16
ONLINE_RATE = 0.002
# Folds of the training texts, and rounds in which the weights are fitted to the counted states.
FOLDS, ROUNDS = 2, 12
STOP = 256
SPREAD = U64(0x9E3779B97F4A7C15)
FIRST = np.concatenate([[0], np.cumsum(SLOTS)])


@dataclass
class Code:
    """Per symbol its path: nodes met and bits taken, in two flat arrays.

    ``steps`` says all of a step of a path in one number: a mark of the node, and depth and bit.
    """

    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    steps: np.ndarray


def _steps(starts: np.ndarray, lengths: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    step = ragged(np.zeros(len(starts), np.int64), lengths)
    mark = nodes.astype(np.uint32) * np.uint32(0x9E3779B1)
    small = np.minimum(step, 15) * 2 + bits
    return mark.astype(U64) << U64(32) | small.astype(U64)


def huffman(counts: np.ndarray, first_node: int) -> Code:
    """A code with short paths for frequent symbols; inner nodes are numbered from ``first_node``."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        side[y] = True
        heapq.heappush(heap, (a + b, node))
    root, at = 2 * n - 2, np.arange(n)
    paths, turns, depth = [], [], np.zeros(n, np.int64)
    while (open_ := at != root).any():
        paths.append(np.where(open_, parent[at], -1))
        turns.append(np.where(open_, side[at], False))
        depth += open_
        at = np.where(open_, parent[at], at)
    if not paths:
        return Code(np.zeros(n, np.int64), depth, np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, U64))
    # From the root down.
    table, turn = np.stack(paths, axis=1)[:, ::-1], np.stack(turns, axis=1)[:, ::-1]
    taken = table >= 0
    starts = np.cumsum(depth) - depth
    nodes, bits = (table[taken] - n + first_node).astype(np.int32), turn[taken]
    return Code(starts, depth, nodes, bits, _steps(starts, depth, nodes, bits))


@dataclass
class Lexicon:
    """Sorted hashes of the known tokens with counts and symbols (-1: spelled), and both codes."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tokens: Code
    spelled: Code
    escape: int
    end: int


def lexicon(hashes: np.ndarray, counts: np.ndarray, texts: int, total: int) -> Lexicon:
    """``counts`` of the known tokens, ``texts`` training texts, ``total`` words in them."""
    # Rarer tokens are spelled in training as they are in texts that were not trained on.
    best = np.lexsort((hashes, -counts))[: min(CODED, int((counts >= LEAST_CODED).sum()))]
    symbols = np.full(len(hashes), -1, np.int32)
    symbols[best] = np.arange(len(best))
    rest = max(1, total - int(counts[best].sum()))
    tokens = huffman(np.concatenate([counts[best], [rest, max(1, texts)]]), 0)
    # Letters are likelier than other bytes; the predictors learn the rest.
    shares = np.ones(257, np.int64)
    shares[list(b"abcdefghijklmnopqrstuvwxyz")] = 40
    shares[list(b"etaonirs")] = 80
    shares[list(b"0123456789.,!*|%&$#\xc3")] = 10
    shares[STOP] = 120
    order = np.argsort(hashes, kind="stable")
    escape = len(best)
    return Lexicon(hashes[order], counts[order], symbols[order], tokens, huffman(shares, escape + 1), escape, escape + 1)


@dataclass
class Events:
    """Bits of some texts: the bit, its slot in each predictor's table, whether it spells, its depth, its token and text."""

    bit: np.ndarray
    slots: np.ndarray
    spells: np.ndarray
    depth: np.ndarray
    stretch: np.ndarray | None
    text: np.ndarray | None
    # Where the bits come by stretch and text, those of tokens first: of both kinds the texts, stretches and bits of their runs.
    runs: tuple | None = None


@dataclass
class Tokens:
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    place: np.ndarray
    is_end: np.ndarray


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    """The words of lower-cased texts and after each text's words its end."""
    n = len(bounds) - 1
    starts, ends, text = word_bounds(data, bounds)
    hashes = slice_hashes(data, starts, ends)
    at = np.cumsum(np.bincount(text, minlength=n))
    put = lambda x, y: np.insert(x, at, y)
    text = put(text, np.arange(n))
    first = np.searchsorted(text, np.arange(n))
    end = np.zeros(len(text), bool)
    end[at + np.arange(n)] = True
    place = np.arange(len(text)) - first[text]
    return Tokens(put(hashes, U64(0)), put(starts, bounds[1:]), put(ends, bounds[1:]), text, place, end)


def found_in(lex: Lexicon, tokens: Tokens) -> np.ndarray:
    """The place of each token among the known ones, -1 for others and for ends."""
    different, at = np.unique(tokens.hashes, return_inverse=True)
    if not len(lex.hashes):
        return np.full(len(at), -1)
    place = np.minimum(np.searchsorted(lex.hashes, different), len(lex.hashes) - 1)
    place = np.where(lex.hashes[place] == different, place, -1)[at]
    return np.where(tokens.is_end, -1, place)


def _narrow(x: np.ndarray) -> np.ndarray:
    return (x >> U64(32)).astype(np.uint32)


def _follow(code: Code, symbols: np.ndarray, lengths: np.ndarray, contexts: list[np.ndarray], slots: np.ndarray, low: np.ndarray) -> None:
    """Writes for each bit of the symbols' paths the slots in the joint table of all predictors, one row each, and ``low``: depth and bit.

    Block after block of symbols, so that all of it stays in the caches.
    """
    ends = np.cumsum(lengths)
    moved = code.starts[symbols] - (ends - lengths)
    cuts = np.searchsorted(ends, np.arange(BLOCK, slots.shape[1], BLOCK))
    for i, j in zip([0, *cuts], [*cuts, len(ends)], strict=True):
        if i == j:
            continue
        size = lengths[i:j]
        a, b = ends[i] - size[0], ends[j - 1]
        at = np.repeat(moved[i:j], size)
        at += np.arange(a, b)
        steps = np.take(code.steps, at, mode="clip")
        parts = steps.view(np.uint32)
        mark = parts[1::2].copy()
        low[a:b] = steps.astype(np.uint8)
        for k, (context, slots_of) in enumerate(zip(contexts, SLOTS, strict=True)):
            mixed = np.repeat(context[i:j], size)
            mixed ^= mark
            mixed *= np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0xC2B2AE35)
            mixed >>= np.uint32(33 - slots_of.bit_length())
            np.add(mixed.view(np.int32), np.int32(FIRST[k]), out=slots[k, a:b])


def _runs(text: np.ndarray, stretch: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, stretch and bits of each run of symbols in one stretch of a text."""
    if not len(text):
        return text, stretch, bits
    begins = np.concatenate([[0], np.flatnonzero((stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1])) + 1])
    return text[begins], stretch[begins], np.add.reduceat(bits, begins)


def events_of(lex: Lexicon, data: np.ndarray, tokens: Tokens, place: np.ndarray, scored: bool = True) -> Events:
    """The bits of some texts; those that are only counted, not ``scored``, come without their stretch and text."""
    with np.errstate(over="ignore"):
        symbol = np.where(place >= 0, lex.symbols[place] if len(lex.symbols) else -1, -1)
        symbol = np.where(tokens.is_end, lex.end, np.where(symbol < 0, lex.escape, symbol))
        h = tokens.hashes
        before, earlier = np.zeros_like(h), np.zeros_like(h)
        before[1:], earlier[2:] = h[:-1], h[:-2]
        before[tokens.place < 1] = 1
        earlier[tokens.place < 2] = 1
        # The last telling token before each token of its text, 0 where there is none.
        tells = np.flatnonzero((symbol < TELLING) & ~tokens.is_end)
        last = np.zeros(len(h) + 1, np.int64)
        last[tells + 1] = tells + 1
        last = np.maximum.accumulate(last)[:-1]
        begun = np.arange(len(h)) - tokens.place
        language = np.where(last > begun, symbol[np.maximum(last - 1, 0)] + 1, 0).astype(U64)
        contexts = [
            np.zeros(len(h), np.uint32),
            _narrow(before * SPREAD),
            _narrow(stirred(before * U64(STIR) + earlier)),
            _narrow((language + U64(7)) * SPREAD),
        ]
        begins, ends = tokens.starts, tokens.ends
        if scored:
            text, stretch = tokens.text.astype(np.int32), (tokens.place // STRETCH).astype(np.int32)
            # By stretch, as they are scored; what came before each token is known by now.
            order = np.argsort(stretch, kind="stable")
            text, stretch, symbol, language = (v[order] for v in (text, stretch, symbol, language))
            contexts, begins, ends = [c[order] for c in contexts], begins[order], ends[order]
        lengths = lex.tokens.lengths[symbol]

        spelled = np.flatnonzero(symbol == lex.escape)
        size = ends[spelled] - begins[spelled] + 1
        where = ragged(begins[spelled], size)
        owner = np.repeat(np.arange(len(spelled)), size)
        inside = where - begins[spelled][owner]
        is_stop = inside == (size - 1)[owner]
        body = data if len(data) else np.zeros(1, np.uint8)
        sign = np.where(is_stop, STOP, body[np.minimum(where, len(body) - 1)]).astype(np.int64)
        back = lambda d: np.where(inside >= d, body[np.maximum(where - d, 0)], 0).astype(U64)
        tongue = language[spelled][owner]
        two = back(1) * U64(256) + back(2)
        three = two * U64(256) + back(3)
        inner = [
            _narrow((two + U64(1 << 30)) * SPREAD),
            _narrow(stirred(tongue * U64(1 << 24) + three)),
            _narrow(slice_hashes(data, begins[spelled][owner], where)),
            _narrow(stirred(tongue * U64(1 << 16) + two + U64(1 << 40))),
        ]
        inner_lengths = lex.spelled.lengths[sign]

        n, m = int(lengths.sum()), int(inner_lengths.sum())
        slots, low = np.empty((len(SLOTS), n + m), np.int32), np.empty(n + m, np.uint8)
        _follow(lex.tokens, symbol, lengths, contexts, slots[:, :n], low[:n])
        _follow(lex.spelled, sign, inner_lengths, inner, slots[:, n:], low[n:])
    bit = (low & np.uint8(1)).view(bool)
    low >>= np.uint8(1)
    low[n:] = np.repeat((16 + np.minimum(inside, 15)).astype(np.uint8), inner_lengths)
    spells = np.zeros(n + m, bool)
    spells[n:] = True
    if not scored:
        return Events(bit, slots, spells, low.view(np.int8), None, None)
    source = spelled[owner]
    runs = _runs(text, stretch, lengths), _runs(text[source], stretch[source], inner_lengths)
    per_bit = [np.concatenate([np.repeat(r[i], r[2]) for r in runs]) for i in (1, 0)]
    return Events(bit, slots, spells, low.view(np.int8), *per_bit, runs)


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A slot's log odds in sixteenths and, in the two lowest bits, how much it has seen."""
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)) * 16, -127, 127).round().astype(np.int64)
    return ((odds + 128) * 4 + np.digitize(zeros + ones, [1, 4, 32])).astype(np.uint16)


# What a packed slot says.
ODDS = ((np.arange(1024) >> 2) - 128).astype(np.float32) / 16
TRUST = (np.arange(1024) & 3).astype(np.uint8)

# States that a slot is counted in when the mixer learns, by trust: between which log odds it has another one. Sixteen in all;
# the first predictor, whose trust picks no weights, has sixteen by its log odds alone.
EDGES = ([], [-1.0, 0.0, 1.0], [-2.5, -0.9, 0.9, 2.5], [-4.0, -2.0, 0.0, 2.0, 4.0])
FIRST_EDGES = [-6.0, -5.0, -4.0, -3.0, -2.0, -1.2, -0.5, 0.0, 0.5, 1.2, 2.0, 3.0, 4.0, 5.0, 6.0]
BEGINS = np.cumsum([0] + [len(e) + 1 for e in EDGES])[:-1]
STATES = 16
STATE = np.array([BEGINS[t] + np.digitize(o, EDGES[t]) for o, t in zip(ODDS, TRUST, strict=True)], np.uint8)
STATE_TRUST = np.repeat(np.arange(4), [len(e) + 1 for e in EDGES])
FIRST_STATE = np.digitize(ODDS, FIRST_EDGES).astype(np.uint8)
# One cell for each depth and state of every predictor.
CELLS = 32 * STATES ** len(SLOTS)


def states_of(table: np.ndarray) -> np.ndarray:
    """The state of every slot of the joint table."""
    return np.concatenate([FIRST_STATE[table[: FIRST[1]]], STATE[table[FIRST[1] :]]])


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


GATES = 2 * 4**3
# The input beside the predictors' log odds.
CONSTANT = 0.25
# Steps of the mixed log odds: so many to one, from -REACH to REACH, and buckets of the refining map.
FINE, REACH, BUCKETS = 16, 8, 33
LEVELS = 2 * REACH * FINE + 1


@dataclass
class Mixer:
    table: np.ndarray
    weights: np.ndarray
    refined: np.ndarray
    constant: np.ndarray = field(default_factory=lambda: np.zeros(GATES, np.float32))

    def inputs(self, slots: np.ndarray, spells: bool) -> tuple[np.ndarray, np.ndarray]:
        """The predictors' log odds, and what the mixer makes of them before it adapts.

        Block after block, and by arithmetic rather than by tables where that does: every look-up costs more.
        """
        n = slots.shape[1]
        x, plain = np.empty((len(slots), n), np.float32), np.empty(n, np.float32)
        constant = self.constant * np.float32(CONSTANT)
        for a in range(0, n, BLOCK):
            block = slots[:, a : a + BLOCK].astype(np.intp)
            gate = np.full(block.shape[1], spells, np.uint8)
            for k, row in enumerate(block):
                seen = np.take(self.table, row, mode="clip")
                odds = x[k, a : a + BLOCK]
                odds[:] = seen >> 2
                odds -= 128
                odds *= np.float32(1 / 16)
                if k:
                    gate <<= np.uint8(2)
                    gate |= seen.astype(np.uint8) & np.uint8(3)
            gate = gate.astype(np.intp)
            mixed = np.take(constant, gate, out=plain[a : a + BLOCK], mode="clip")
            for row, weight in zip(x, self.weights, strict=True):
                weight = np.take(weight, gate, mode="clip")
                weight *= row[a : a + BLOCK]
                mixed += weight
        return x, plain

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By depth, step of the log odds and bit: the bit's cost and how far the prediction missed it.

        A refined prediction lies half way between the mixed log odds and what such odds were worth at this depth.
        """
        odds = np.arange(LEVELS) / FINE - REACH
        at = np.minimum((odds + REACH) * (BUCKETS - 1) / (2 * REACH), BUCKETS - 1.001)
        low = at.astype(int)
        part = at - low
        final = (odds + self.refined[:, low] * (1 - part) + self.refined[:, low + 1] * part) / 2
        cost = np.stack([np.logaddexp(0, final), np.logaddexp(0, -final)], axis=-1)
        miss = np.stack([-squash(final), 1 - squash(final)], axis=-1)
        return cost.astype(np.float32).ravel(), (miss * ONLINE_RATE).astype(np.float32).ravel()

    def score(self, events: Events, texts: int) -> np.ndarray:
        """Natural log probability of each text, the weights adapting along it; bits of tokens and of spelled bytes adapt their own."""
        out = np.zeros(texts)
        tables = self.tables()
        runs = events.runs or [None, None]
        before = 0
        for spells, run in zip((False, True), runs, strict=True):
            if run is not None:
                at = slice(before, before + int(run[2].sum()))
                before = at.stop
            else:
                # Stretch after stretch, in each text after text.
                at = np.flatnonzero(events.spells == spells)
                at = at[np.lexsort((events.text[at], events.stretch[at]))]
                run = _runs(events.text[at], events.stretch[at], np.ones(len(at), np.int64))
            if len(run[0]):
                self._add(out, tables, spells, events.bit[at], events.slots[:, at], events.depth[at], *run)
        return out

    def _add(self, out: np.ndarray, tables: tuple, spells: bool, bit, slots, depth, who, when, sizes) -> None:  # noqa: ANN001
        """Adds to ``out`` the log probabilities of bits that come by stretch and text, in runs of ``sizes``."""
        cost, miss = tables
        x, plain = self.inputs(slots, spells)
        # Where a bit's entries begin in the tables; the step of its log odds is added. All are whole numbers that floats hold.
        entry = depth.astype(np.float32)
        entry *= 2 * LEVELS
        entry += 2 * REACH * FINE
        entry += bit
        begins = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.concatenate([[True], when[1:] != when[:-1], [True]]))
        own = np.zeros((len(x) + 1, len(out)), np.float32)
        for f, g in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            a, b = begins[f], begins[f] + sizes[f:g].sum()
            ids, size, begin = who[f:g], sizes[f:g], begins[f:g] - a
            odds = plain[a:b].copy()
            # Nothing is learned yet in a text's first stretch.
            if f:
                odds += np.repeat(own[-1][ids] * np.float32(CONSTANT), size)
                for k, row in enumerate(x):
                    learned = np.repeat(own[k][ids], size)
                    learned *= row[a:b]
                    odds += learned
            np.clip(odds, -REACH, REACH, out=odds)
            odds *= FINE
            np.rint(odds, out=odds)
            odds *= 2
            odds += entry[a:b]
            at = odds.astype(np.intp)
            out[ids] -= np.add.reduceat(np.take(cost, at, mode="clip"), begin)
            missed = np.take(miss, at, mode="clip")
            for k, row in enumerate(x):
                own[k][ids] += np.add.reduceat(np.multiply(missed, row[a:b], out=odds), begin)
            own[-1][ids] += np.add.reduceat(missed, begin) * np.float32(CONSTANT)


def calibrated(table: np.ndarray, cells: np.ndarray, seen: np.ndarray) -> Mixer:
    """The weights of every gate, and the map behind them, fitted to the counted states of all training texts.

    ``cells`` counts zeros and ones by depth and states, ``seen`` the training bits by predictor and packed slot, which says what
    log odds a state stands for. Weights that the counts say nothing of stay at 0.3.
    """
    n_inputs = len(SLOTS) + 1
    weights = np.full((n_inputs, GATES), 0.3)
    odds_of = []
    for k, used in enumerate(seen):
        state = STATE if k else FIRST_STATE
        # A state that was never met stands for the middle of its slots.
        share = used + 1e-9
        odds_of.append(np.bincount(state, share * ODDS, STATES) / np.maximum(np.bincount(state, share, STATES), 1e-300))
    met = np.flatnonzero(cells.any(axis=1))
    zeros, ones = cells[met].T.astype(float)
    depth, parts = met // STATES ** len(SLOTS), [met // STATES ** (len(SLOTS) - 1 - k) % STATES for k in range(len(SLOTS))]
    x = np.stack([*[o[p] for o, p in zip(odds_of, parts, strict=True)], np.full(len(met), CONSTANT)])
    gate = (depth >= 16).astype(int)
    for part in parts[1:]:
        gate = gate * 4 + STATE_TRUST[part]
    # Newton's method for all gates at once, held back where little was seen.
    hold = np.eye(n_inputs) * 2.0
    for _ in range(ROUNDS):
        p = squash((x * weights[:, gate]).sum(axis=0))
        miss, bend = ones - (zeros + ones) * p, (zeros + ones) * p * (1 - p)
        slope = np.stack([np.bincount(gate, miss * row, GATES) for row in x], axis=1) - (weights.T - 0.3) @ hold
        curve = np.empty((GATES, n_inputs, n_inputs))
        for i in range(n_inputs):
            for j in range(i + 1):
                curve[:, i, j] = curve[:, j, i] = np.bincount(gate, bend * x[i] * x[j], GATES)
        step = np.linalg.solve(curve + hold, slope[..., None])[..., 0].T
        # No step so long that the next one starts from certainty.
        step *= np.minimum(1, 1 / np.maximum(np.abs(step).max(axis=0), 1e-12))
        weights += step
    mixer = Mixer(table, weights[:-1].astype(np.float32), np.zeros((32, BUCKETS), np.float32), weights[-1].astype(np.float32))
    odds = (x * weights[:, gate]).sum(axis=0)
    at = np.clip(((odds + 8) * 2).round(), 0, BUCKETS - 1).astype(int) + depth * BUCKETS
    hit, all_ = np.bincount(at, ones, 32 * BUCKETS), np.bincount(at, zeros + ones, 32 * BUCKETS)
    # Where little was seen, the map changes nothing.
    prior = squash(np.tile(np.arange(BUCKETS) / 2 - 8, 32))
    share = (hit + 20 * prior) / (all_ + 20)
    mixer.refined = np.log(share / (1 - share)).reshape(32, BUCKETS).astype(np.float32)
    return mixer


def _chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = flat(texts)
    for a, b in pieces(bounds, size):
        yield a, b, LOWER[data[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(hash, n) of all words of a one-column table of texts, added up in the tasks first."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return hashes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def give(hashes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(hashes), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(n[part])], names=["hash", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for _, _, data, bounds in _chunks(batch.column(0)):
                starts, ends, _ = word_bounds(data, bounds)
                held.append(tuple(np.unique(slice_hashes(data, starts, ends), return_counts=True)))
                waiting += len(held[-1][0])
                if waiting > 1_000_000:
                    held = [merge(held)]
                    waiting = len(held[0][0])
                    if waiting > 500_000:
                        yield from give(*held.pop())
                        waiting = 0
        if held:
            yield from give(*merge(held))

    return texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _folded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The chunks of a batch of texts with their folds, each fold's together."""
    fold = batch.column(1).to_numpy(zero_copy_only=False)
    for f in range(FOLDS):
        for _, _, data, bounds in _chunks(batch.column(0).filter(pa.array(fold == f))):
            yield f, data, bounds


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of an array of counts that hold any, zeros and ones of a slot side by side."""
    press = zstandard.ZstdCompressor(level=1)
    slices = [i for i in range(len(counts) // (2 * SLICE)) if counts[2 * i * SLICE : 2 * (i + 1) * SLICE].any()]
    for a in range(0, len(slices), 16):
        part = slices[a : a + 16]
        bodies = [press.compress(counts[2 * i * SLICE : 2 * (i + 1) * SLICE].tobytes()) for i in part]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "counts"])


def _by_slice(gathered: DataFrame, give, fields: str) -> DataFrame:  # noqa: ANN001
    """``give(slice, bodies)`` for each slice; bodies are as many as tasks have counted."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        now, sums = None, None
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if now is not None:
                        yield from give(now, sums)
                    now, sums = at, np.zeros(2 * SLICE, np.int64)
                sums += np.frombuffer(open_.decompress(body), np.int32)
        if now is not None:
            yield from give(now, sums)

    return gathered.repartition("slice").sortWithinPartitions("slice").mapInArrow(add_up, fields)


def bit_counts(texts: DataFrame, lex) -> tuple[list[np.ndarray], np.ndarray]:  # noqa: ANN001
    """The predictors' joint table, packed: of each fold and of all training texts; and how many training bits met a packed slot.

    ``texts`` has the columns text and fold, ``lex`` is the broadcast lexicon.
    """
    total = int(FIRST[-1])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FOLDS * 2 * total, np.int32)
        for batch in batches:
            for f, data, bounds in _folded(batch):
                tokens = tokens_of(data, bounds)
                events = events_of(lex.value, data, tokens, found_in(lex.value, tokens), scored=False)
                mine = counts[f * 2 * total : (f + 1) * 2 * total]
                for a in range(0, len(events.bit), BLOCK):
                    bit = events.bit[a : a + BLOCK].astype(np.intp)
                    for at in events.slots[:, a : a + BLOCK].astype(np.intp):
                        at <<= 1
                        at |= bit
                        np.add.at(mine, at, np.int32(1))
        # A slice's folds lie side by side, so that they meet in one task.
        press = zstandard.ZstdCompressor(level=1)
        by_fold = counts.reshape(FOLDS, -1, 2 * SLICE)
        slices = np.flatnonzero(by_fold.any(axis=(0, 2)))
        for a in range(0, len(slices), 8):
            part = slices[a : a + 8]
            keys = [int(i) * FOLDS + f for i in part for f in range(FOLDS)]
            bodies = [press.compress(by_fold[f, i].tobytes()) for i in part for f in range(FOLDS)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "counts"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        now, sums = None, None

        def done() -> pa.RecordBatch:
            whole = sums.sum(axis=0)
            table = packed(whole[::2], whole[1::2])
            bodies = [packed(s[::2], s[1::2]).tobytes() for s in sums] + [table.tobytes()]
            met = np.bincount(table, whole[::2] + whole[1::2], 1024).astype(np.int64).tobytes()
            columns = [pa.array([now], pa.int32()), *[pa.array([b], pa.binary()) for b in (*bodies, met)]]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at // FOLDS != now:
                    if now is not None:
                        yield done()
                    now, sums = at // FOLDS, np.zeros((FOLDS, 2 * SLICE), np.int64)
                sums[at % FOLDS] += np.frombuffer(open_.decompress(body), np.int32)
        if now is not None:
            yield done()

    names = ["slice", *[f"table{i}" for i in range(FOLDS + 1)], "met"]
    gathered = texts.mapInArrow(gather, "slice int, counts binary").withColumn("at", F.expr(f"slice div {FOLDS}"))
    gathered = gathered.repartition("at").sortWithinPartitions("at").select("slice", "counts")
    tables = [np.full(total, packed(np.zeros(1), np.zeros(1))[0], np.uint16) for _ in range(FOLDS + 1)]
    met = np.zeros((len(SLOTS), 1024), np.int64)
    # As many rows as the table has slices, a fixed number.
    for row in gathered.mapInArrow(give, "slice int, " + ", ".join(f"{n} binary" for n in names[1:])).collect():
        at = row["slice"] * SLICE
        for i, table in enumerate(tables):
            table[at : at + SLICE] = np.frombuffer(row[f"table{i}"], np.uint16)
        met[np.searchsorted(FIRST, at, "right") - 1] += np.frombuffer(row["met"], np.int64)
    return tables, met


def state_counts(texts: DataFrame, lex, states) -> np.ndarray:  # noqa: ANN001
    """Zeros and ones by depth and states of the predictors over ``texts`` (text, fold), each fold seen with the other's states.

    ``states`` is a broadcast list: by fold the states of all slots when that fold is left out.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * CELLS, np.int32)
        for batch in batches:
            for f, data, bounds in _folded(batch):
                tokens = tokens_of(data, bounds)
                events = events_of(lex.value, data, tokens, found_in(lex.value, tokens), scored=False)
                for a in range(0, len(events.bit), BLOCK):
                    key = events.depth[a : a + BLOCK].astype(np.int32)
                    for row in events.slots[:, a : a + BLOCK].astype(np.intp):
                        key <<= 4
                        key |= np.take(states.value[f], row, mode="clip")
                    key *= 2
                    key += events.bit[a : a + BLOCK]
                    np.add.at(counts, key.astype(np.intp), np.int32(1))
        yield from _slices(counts)

    def add_up(at: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        body = zstandard.ZstdCompressor(level=1).compress(sums.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([body], pa.binary())], names=["slice", "sums"])

    counts = np.zeros(2 * CELLS, np.int64)
    # Again a fixed number of rows.
    for row in _by_slice(texts.mapInArrow(gather, "slice int, counts binary"), add_up, "slice int, sums binary").collect():
        at = 2 * row["slice"] * SLICE
        counts[at : at + 2 * SLICE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["sums"]), np.int64)
    return counts.reshape(-1, 2)


def _frequent(counts: DataFrame, most: int) -> pa.Table:
    """(hash, n) of the tokens that occur at least so often that there are no more than ``most`` of them."""
    total, least = 0, None
    for step in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += step["words"]
        if total > most:
            break
        least = step["n"]
    return (counts.where(F.col("n") >= least) if least is not None else counts.limit(0)).toArrow()


def score_texts(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", known: int = KNOWN, calibration: int | None = None
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens: the lower-cased (A-Z) words, runs without ASCII white space, and one end. Models learn from the rows where
    ``training`` (over the column doc_id) holds. base_score is the unigram's log10 probability with one added to each count,
    score the mixed model's, bits_per_byte the latter over the text's UTF-8 bytes (null: no bytes). A null text is empty and
    has its end only. Null and repeated ids each give their row, an empty table an empty one; without training rows all
    counts are 0. Other columns are not read. Tokens are told apart by 64-bit hashes.

    ``known`` bounds the tokens whose counts go to every task; it changes the plan, not the unigram score. The mixer learns from
    all training rows, or where ``calibration`` is given from so many, those whose ids hash lowest; the predictors count all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    learned = rows.where(training)
    counts = land(count_tokens(learned.select("text")), "counts")
    words, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = learned.select("doc_id").count()
    train_tokens, distinct = words + texts, different + (texts > 0)
    top = _frequent(counts, known)
    lex = spark.sparkContext.broadcast(lexicon(top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy(), texts, words))
    # Equal texts share a fold, so none is predicted from a copy.
    folded = learned.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    tables, met = bit_counts(folded.select("text", "fold"), lex)
    # With two folds, what is known without one is what the other has counted.
    states = spark.sparkContext.broadcast([states_of(tables[1 - f]) for f in range(FOLDS)])
    trial = folded if calibration is None else folded.orderBy(F.xxhash64("doc_id"), "doc_id", "fold", "text").limit(calibration)
    cells = state_counts(trial.select("text", "fold"), lex, states)
    mixer = spark.sparkContext.broadcast(calibrated(tables[-1], cells, met))
    base_total = float(np.log10(train_tokens + distinct + 1))
    base_end = float(np.log10(texts + 1)) - base_total

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lex.value
        for batch in batches:
            for a, b, data, bounds in _chunks(batch.column(1)):
                tokens = tokens_of(data, bounds)
                place = found_in(words, tokens)
                n = b - a
                value = mixer.value.score(events_of(words, data, tokens, place), n) / np.log(10)
                hit = place >= 0
                base = np.bincount(tokens.text[hit], np.log10(words.counts[place[hit]] + 1) - base_total, n) + base_end
                known_ = np.bincount(tokens.text[hit], minlength=n) + (1 if texts else 0)
                other = ~hit & ~tokens.is_end
                cuts = np.concatenate([[0], np.cumsum(np.bincount(tokens.text[other], minlength=n))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens.hashes[other].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(np.bincount(tokens.text, minlength=n)), pa.array(known_),
                        pa.array(base), pa.array(value), pa.array(np.diff(bounds)), rest,
                    ],
                    names=["doc_id", "n_tokens", "known", "base", "score", "bytes", "rest"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens long, known long, base double, score double, bytes long, rest array<long>"
    scored = land(rows.mapInArrow(score, fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    # The rarer tokens' counts; a token that was never counted has none.
    rest = scored.select("row", F.explode("rest").alias("hash")).join(counts, "hash", "left")
    seen = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("row").agg(
        F.sum(F.log10(seen + 1.0) - F.lit(base_total)).alias("more"), F.sum((seen > 0).cast("long")).alias("more_known")
    )
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from six sevenths of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, remainder(F.col("doc_id"), 7) != 2)
    held_out = (remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    return scored.select(
        "doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
