"""BPE, MinHash, line quality and context mixing against the library or plain Python."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from wardscore.llm import bpe, context_mixing, line_quality, minhash_dedup, text_bytes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", " ", "a<|endoftext|>b", " <|endoftext|> x  ", "<|endoftext|><|endoftext|>", "a  b \x1c c\x85d", "it's 'tis don't",
    "ééé́ ١٢ ²", "x" * 5000, "\n\n\n a", "  lead", "trail  ", "ᲊ \U0001e6c0 a", "🤷🏽‍♂️ ok", "\x00 a\x00", "a　b",
]


def test_slice_hashes_depend_on_content_only():
    data = np.frombuffer(b"abc xabc abd ab", np.uint8)
    h = text_bytes.slice_hashes(data, np.array([0, 5, 9, 13, 3]), np.array([3, 8, 12, 15, 3]))
    assert h[0] == h[1] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("table_bytes", [bpe.TABLE_BYTES, 200, 0])
def test_bpe_equals_library(spark, table_bytes):
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*ODD, ODD[7]])], "doc_id long, text string, ids string")
    tokenizer = bpe._tokenizer(bpe.default_tokenizer())
    encoded = bpe.encode_documents(docs, table_bytes=table_bytes)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.decode_ids(encoded).collect()}
    digests = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, table_bytes=table_bytes).collect()}
    for i, x in enumerate([*ODD, ODD[7]]):
        ids = tokenizer.encode(x or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (ids, text) and text == (x or "")
        assert digests[i] == (len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), text)))


def test_bpe_decodes_any_ids(spark):
    rows = spark.createDataFrame([(1, [15496, 99999999, -3]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode_ids(rows).orderBy("k").collect()] == ["Hello", "", ""]
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text, n):
    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets, up = {i: shingles(x, n) for i, x in rows}, {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def crowd():
    """A crowd of copies with a few words changed, short texts, a shared passage."""
    draw = np.random.default_rng(8)
    word = lambda: f"w{draw.integers(0, 3000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for j in draw.choice(120, draw.integers(0, 8), replace=False):
            own[j] = word()
        rows.append((i, " ".join(own)))
    passage = " ".join(base[:60])
    rows += [(100 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(30)]
    rows += [(200, "One two"), (201, "one  TWO"), (202, "one two three"), (203, ""), (204, None), (205, " \n"), (206, "one"), (207, "ONE")]
    return rows + [(300 + i, " ".join(word() for _ in range(30))) for i in range(20)]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, None), (5, 80, None), (3, 85, 7)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, percent, block):
    if block:
        monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "CLASS_BLOCK", block)
    rows = crowd()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component int, signature string")
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_near_duplicates_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:1200]
    docs = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_near_duplicates_repeats_and_nulls(spark):
    long = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(4, long), (4, long), (2, long), (None, long), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 36, 2, False)] * 2 + [(2, 36, 2, True), (None, 36, None, True), (7, 0, 7, True)], key=str)
    left = sorted((r["doc_id"] or 0) for r in minhash_dedup.without_copies(docs).collect())
    assert left == [0, 2, 7]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_without_copies_keeps_one_row_of_each_group(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, one), (5, two), (5, two), (3, three), (9, one), (1, three), (6, None), (6, None), (6, " "), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash_dedup.without_copies(docs).collect()), key=str)
    assert len(got) == 6 and {(5, one), (5, two), (1, three), (6, " "), (7, "")} < set(got)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_misses_at_the_threshold_are_as_rare_as_stated(percent):
    s, least = percent / 100, minhash_dedup.least_agreement(percent)
    assert sum(math.comb(64, t) * s**t * (1 - s) ** (64 - t) for t in range(least)) <= 1 / 50_000


def test_lines_and_their_neighbours():
    data = np.frombuffer("a|b\n\nA A A\n".encode() + b"" + b"x", np.uint8)
    lines = line_quality.lines_of(data, np.array([0, 11, 11, 12]))
    assert lines.first.tolist() == [0, 4, 5, 6]
    own = line_quality.OWN
    assert (lines.features[1:4, own : 2 * own] == lines.features[0:3, :own]).all()
    assert (lines.features[0, own : 2 * own] == 0).all() and (lines.features[4, own : 3 * own] == 0).all()


def test_chain_equals_enumeration():
    draw = np.random.default_rng(2)
    odds, steps = draw.normal(size=7), draw.normal(size=(2, 2))
    first = np.array([0, 1, 5, 7])
    forward, backward = line_quality.chain(odds, first, steps)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weight = {}
        for path in itertools.product((0, 1), repeat=b - a):
            weight[path] = math.exp(sum(odds[a + i] for i, s in enumerate(path) if s) + sum(steps[s, t] for s, t in itertools.pairwise(path)))
        for i in range(b - a):
            good = sum(w for p, w in weight.items() if p[i]) / sum(weight.values())
            assert abs(line_quality.sigmoid(forward + backward)[a + i] - good) < 1e-9


def test_slopes_of_hidden_labels_equal_differences():
    """The fitted chance against enumeration of all labellings, its slopes against differences."""
    draw = np.random.default_rng(3)
    first, labels = np.array([0, 1, 5, 8]), np.array([1, 0, 1])
    lines = line_quality.Lines(draw.normal(size=(8, 3)), draw.integers(1, 9, 8).astype(float), first)
    weights, steps = draw.normal(size=3), draw.normal(size=(2, 2))

    def likely(w, s):
        total = 0.0
        for (a, b), label in zip(itertools.pairwise(first), labels, strict=True):
            odds, share = lines.features[a:b] @ w, lines.weights[a:b] / lines.weights[a:b].sum()
            paths = list(itertools.product((0, 1), repeat=b - a))
            weight = [math.exp(odds @ p + sum(s[i, j] for i, j in itertools.pairwise(p))) for p in paths]
            good = sum(c * (share @ p) for c, p in zip(weight, paths, strict=True)) / sum(weight)
            total += math.log(good if label else 1 - good) / len(labels)
        return total

    value, by_weights, by_steps = line_quality.gradient(lines.features, lines, labels, weights, steps)
    assert abs(value - likely(weights, steps)) < 1e-9
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert abs(by_weights[i] - (likely(weights + step, steps) - likely(weights - step, steps)) / 2e-5) < 1e-7
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert abs(by_steps[i, j] - (likely(weights, steps + step) - likely(weights, steps - step)) / 2e-5) < 1e-7


def test_spliced_documents_score_in_between():
    """Learned from whole good and bad documents only, each half of a spliced one keeps its side."""
    draw = np.random.default_rng(5)
    good = lambda: " ".join("".join(draw.choice(list("abcdefgh"), draw.integers(2, 8))) for _ in range(9)) + "."
    bad = lambda: "".join(draw.choice(list("$%&!|#0123456789 "), 50))

    def lines(texts):
        raw = [x.encode() for x in texts]
        return line_quality.lines_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))

    text = lambda *makers: "\n".join(m() for m in makers)
    labels = np.arange(80) % 2
    model = line_quality.fit(lines([text(*[good if y else bad] * draw.integers(1, 20)) for y in labels]), labels)
    mixed = lines([text(*[good] * 10, *[bad] * 10) for _ in range(10)])
    assert ((model.scores(mixed) > 0.3) & (model.scores(mixed) < 0.7)).all()
    forward, backward = line_quality.chain(model.odds(mixed), mixed.first, model.steps)
    is_good = (forward + backward > 0).reshape(10, 20)
    assert is_good[:, :10].mean() > 0.9 and is_good[:, 10:].mean() < 0.1
    whole = model.scores(lines([text(*[good] * 30), text(*[bad] * 30)]))
    assert whole[0] > 0.9 and whole[1] < 0.1


def test_quality_on_held_out_rows(spark, sf_dir):
    scores = {r["doc_id"]: r for r in line_quality.query(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(scores) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(scores[r["doc_id"]]["held_out"] for r in held)
    right = [scores[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    assert sum(right) / len(right) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "\n\n", 0.5), (None, "x\n", 0.5)], "doc_id long, text string, score double")
    none = line_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in line_quality.score_documents(docs, none, ["doc_id"]).collect()] == [0.5] * 4
    assert line_quality.good_documents(docs, none).columns == docs.columns
    one = line_quality.train(docs, spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int"))
    assert all(r["score"] > 0.5 for r in line_quality.score_documents(docs, one, ["doc_id"]).collect())
    assert line_quality.score_documents(docs.limit(0), one, ["doc_id"]).count() == 0


def test_training_sample_is_bounded_in_lines(spark, monkeypatch):
    """Whole documents up to the limit, long ones left out, the same text of an id whatever the order of the rows."""
    seen = []
    monkeypatch.setattr(line_quality, "fit", lambda lines, labels: seen.append((lines.first.tolist(), labels.tolist(), lines.features.sum())))
    rows = [(i, "a line\n" * (i % 5)) for i in range(300)] + [(1000, "x\n" * 500), *[(2000, f"text {i}") for i in range(9)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("quality")).distinct()
    for table in (docs, docs.orderBy("text").repartition(3)):
        line_quality.train(table, labels, most_lines=600)
    assert seen[0] == seen[1] and 590 < seen[0][0][-1] <= 600 and max(np.diff(seen[0][0])) <= 6
    line_quality.train(docs, labels, most_lines=100_000)
    assert len(seen[2][1]) == 302 and seen[2][0][-1] == sum(t.count("\n") + 1 for _, t in rows) - 8


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choice(vocabulary[: 5 + i % 30], draw.integers(1, 80)))) for i in range(300)]
    return [*rows, (300, None), (301, ""), (302, "Never SEEN before"), (303, "never seen"), (303, "never seen"), (None, "word1 Word1")]


@pytest.mark.parametrize("known", [context_mixing.KNOWN, 10, 0])
def test_unigram_equals_brute_force(spark, corpus, known):
    docs = spark.createDataFrame([(*r, "x") for r in corpus], "doc_id long, text string, score string")
    in_training = line_quality.remainder(context_mixing.F.col("doc_id"), 7) != 2
    got = context_mixing.score_texts(docs, in_training, known=known, calibration=40).collect()
    assert len(got) == len(corpus)
    counts, ends = collections.Counter(), 0
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    split = lambda x: WORDS.findall((x or "").translate(LOW))
    for i, x in corpus:
        if crc(i) != 2:
            counts.update(split(x))
            ends += 1
    total, size = sum(counts.values()) + ends, len(counts) + 1
    texts = dict(corpus)
    for r in got:
        words = split(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in words) + math.log10((ends + 1) / (total + size + 1))
        assert abs(base - r["base_score"]) < 1e-6 * max(1, abs(base))
        assert (r["n_tokens"], r["train_tokens"]) == (len(words) + 1, total)
        assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert r["score"] < 0 and math.isfinite(r["score"])
    # Without tokens that have a path, all words are spelled, which costs more than a known word.
    if known == context_mixing.KNOWN:
        assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_context_mixing_edges(spark):
    never = context_mixing.F.lit(False)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in context_mixing.score_texts(docs, never).collect()}
    assert (rows[1]["n_known"], rows[1]["train_tokens"], rows[1]["base_score"]) == (0, 0, 0.0)
    assert rows[2]["bits_per_byte"] is None and rows[2]["n_tokens"] == 1
    assert context_mixing.score_texts(docs.limit(0), never).count() == 0


def test_huffman_paths_are_a_code():
    code = context_mixing.huffman(np.array([50, 1, 1, 20, 7, 7, 9]), 100)
    paths = ["".join("01"[int(b)] for b in code.bits[s : s + n]) for s, n in zip(code.starts, code.lengths, strict=True)]
    assert sum(2.0 ** -len(p) for p in paths) == 1
    assert not any(p != q and q.startswith(p) for p in paths for q in paths)
    assert len(paths[0]) == min(map(len, paths)) and code.nodes.min() == 100


def test_chances_of_all_next_tokens_add_up():
    """What the mixed model gives to every token that can follow sums to one, whatever the table holds."""
    counts = np.array([9, 5, 4, 4], np.int64)
    hashes = np.array([11, 22, 33, 44], np.uint64)
    lex = context_mixing.lexicon(hashes, counts, 3, 30)
    table = np.random.default_rng(1).integers(0, 256, context_mixing.FIRST[-1]).astype(np.uint8)
    mixer = context_mixing.Mixer(
        table, np.full((4, context_mixing.GATES), 0.4, np.float32),
        np.random.default_rng(2).normal(size=(32, context_mixing.BUCKETS)).astype(np.float32),
    )
    none = np.zeros(0, np.uint8)
    total = 0.0
    for symbol in range(lex.end + 1):
        token = context_mixing.Tokens(
            np.array([hashes[symbol] if symbol < 4 else 0], np.uint64), *np.zeros((2, 1), int), np.zeros(1, int), np.zeros(1, int), np.array([symbol == lex.end])
        )
        events = context_mixing.events_of(lex, none, token, np.array([context_mixing.found_in(lex, token)[0]]))
        if symbol == lex.escape:
            path = ~events.spells
            events = context_mixing.Events(*(getattr(events, f)[..., path] for f in ("bit", "slots", "spells", "depth", "stretch", "text")))
        total += math.exp(mixer.score(events, 1)[0])
    assert abs(total - 1) < 1e-5


def test_predictors_tell_the_two_tokens_before():
    """Texts that differ only two tokens before a token have another slot there, and stored odds are fine."""
    data = np.frombuffer(b"one b c two b c", np.uint8)
    bounds = np.array([0, 7, 15])
    tokens = context_mixing.tokens_of(data, bounds)
    words = np.unique(tokens.hashes[~tokens.is_end])
    lex = context_mixing.lexicon(words, np.full(len(words), 5, np.int64), 2, 20)
    events = context_mixing.events_of(lex, data, tokens, context_mixing.found_in(lex, tokens))
    lengths = lex.tokens.lengths[np.where(tokens.is_end, lex.end, lex.symbols[context_mixing.found_in(lex, tokens)])]
    place = np.repeat(tokens.place, lengths)
    one, two = (events.slots[:, (events.text == t) & (place == 2)] for t in (0, 1))
    assert (one != two).any(axis=1).sum() == 1
    odds = context_mixing.ODDS[context_mixing.packed(np.array([10, 3]), np.array([12, 90]))]
    assert np.allclose(odds, np.log([12.4 / 10.4, 90.4 / 3.4]), atol=1 / 32)


def test_token_and_spelled_bits_adapt_apart():
    """What spelled bits teach the weights of a text does not move those of its token bits."""
    n = 256
    table = np.full(context_mixing.FIRST[-1], context_mixing.packed(np.array([2]), np.array([9]))[0])
    weights = np.full((len(context_mixing.SLOTS), context_mixing.GATES), 0.3, np.float32)
    mixer = context_mixing.Mixer(table, weights, np.zeros((32, context_mixing.BUCKETS), np.float32))

    def cost(bits, spells):
        slots = np.repeat(context_mixing.FIRST[:-1, None], len(bits), axis=1).astype(np.int32)
        zero = np.zeros(len(bits), np.int32)
        return mixer.score(context_mixing.Events(bits, slots, spells, zero.astype(np.int8), np.arange(len(bits), dtype=np.int32), zero), 1)[0]

    spelled, token = np.zeros(n, bool), np.ones(n, bool)
    both = cost(np.concatenate([spelled, token]), np.arange(2 * n) < n)
    assert abs(both - cost(spelled, token) - cost(token, ~token)) < 1e-3


@pytest.mark.parametrize("rows", [30, 260])
def test_mixer_learns_from_all_training_texts(spark, monkeypatch, rows):
    """Every bit of every training text is counted by each predictor and learned from by the mixer, few texts or many."""
    texts = [(i, f"w{i % 7} x{i % 3} w{i % 5} rare{i} " * 3) for i in range(rows)]
    fit, caught = context_mixing.calibrated, []
    monkeypatch.setattr(context_mixing, "calibrated", lambda *a: caught.append(a) or fit(*a))
    F = context_mixing.F
    got = context_mixing.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), F.col("doc_id") % 7 != 2).collect()
    assert len(got) == rows and all(math.isfinite(r["score"]) for r in got)
    (_, cells, seen), = caught
    data = "".join(x for i, x in texts if i % 7 != 2).encode()
    bounds = np.cumsum([0] + [len(x) for i, x in texts if i % 7 != 2])
    tokens = context_mixing.tokens_of(np.frombuffer(data, np.uint8), bounds)
    hashes, n = np.unique(tokens.hashes[~tokens.is_end], return_counts=True)
    lex = context_mixing.lexicon(hashes, n, len(bounds) - 1, int(n.sum()))
    events = context_mixing.events_of(lex, np.frombuffer(data, np.uint8), tokens, context_mixing.found_in(lex, tokens))
    assert cells.sum() == len(events.bit) and cells.sum(axis=0)[1] == events.bit.sum()
    assert (seen.sum(axis=1) == len(events.bit)).all()


def test_fitted_weights_follow_the_counted_states():
    """Where one predictor alone tells the bit, it gets the weight; gates that were never met keep theirs."""
    table = np.full(context_mixing.FIRST[-1], context_mixing.packed(np.array([2]), np.array([2]))[0])
    seen, cells = np.zeros((4, 1024), np.int64), np.zeros((context_mixing.CELLS, 2), np.int64)
    sure = [context_mixing.packed(np.array([a]), np.array([b]))[0] for a, b in ((99, 1), (1, 99))]
    level = context_mixing.packed(np.array([50]), np.array([50]))[0]
    seen[:, [*sure, level]] = 100
    for bit, slot in enumerate(sure):
        at = 0
        for k, packed_ in enumerate((level, slot, level, level)):
            at = at * 16 + int((context_mixing.STATE if k else context_mixing.FIRST_STATE)[packed_])
        cells[at, bit], cells[at, 1 - bit] = 9900, 100
    mixer = context_mixing.calibrated(table, cells, seen)
    gate = 63
    assert 0.9 < mixer.weights[1][gate] < 1.3 and abs(mixer.weights[1][0] - 0.3) < 1e-6


def test_counted_bits_are_the_scored_ones():
    """Bits that are only counted are not put in order, and are the same ones."""
    texts = context_mixing.pa.array([" ".join(f"w{i * i % 23}" for i in range(200)), "w1 unseen w2", ""])
    _, _, data, bounds = next(context_mixing._chunks(texts))
    starts, ends, _ = text_bytes.word_bounds(data, bounds)
    lex = context_mixing.lexicon(*np.unique(text_bytes.slice_hashes(data, starts, ends), return_counts=True), 3, len(starts))
    tokens = context_mixing.tokens_of(data, bounds)
    place = context_mixing.found_in(lex, tokens)
    scored = context_mixing.events_of(lex, data, tokens, place)
    counted = context_mixing.events_of(lex, data, tokens, place, scored=False)
    rows = lambda e: sorted(zip(e.bit.tolist(), e.depth.tolist(), *e.slots.tolist(), strict=True))
    assert rows(counted) == rows(scored) and counted.text is None and counted.stretch is None


def test_runs_are_those_of_the_bits():
    """Runs known by token are those of the bits, and texts cost the same however their bits come."""
    words = [f"w{i}" for i in range(300)]
    texts = context_mixing.pa.array([" ".join(words[i * i % 300] for i in range(900)), " ".join(words), "", "w7 neverseen w9"])
    _, _, data, bounds = next(context_mixing._chunks(texts))
    starts, ends, _ = text_bytes.word_bounds(data, bounds)
    hashes, counts = np.unique(text_bytes.slice_hashes(data, starts, ends), return_counts=True)
    lex = context_mixing.lexicon(hashes, counts + 3, 4, len(starts))
    tokens = context_mixing.tokens_of(data, bounds)
    place = context_mixing.found_in(lex, tokens)
    scored = context_mixing.events_of(lex, data, tokens, place)
    for kind, (text, stretch, size) in zip((False, True), scored.runs, strict=True):
        mine = scored.spells == kind
        assert (np.repeat(text, size) == scored.text[mine]).all() and (np.repeat(stretch, size) == scored.stretch[mine]).all()
    total = int(context_mixing.FIRST[-1])
    weights = np.full((len(context_mixing.SLOTS), context_mixing.GATES), 0.3, np.float32)
    table = np.random.default_rng(3).integers(0, 1024, total).astype(np.uint16)
    mixer = context_mixing.Mixer(table, weights, np.zeros((32, context_mixing.BUCKETS), np.float32))
    mixed = np.random.default_rng(4).permutation(len(scored.bit))
    fields = ("bit", "slots", "spells", "depth", "stretch", "text")
    other = context_mixing.Events(*(getattr(scored, f)[..., mixed] for f in fields))
    assert np.allclose(mixer.score(scored, 4), mixer.score(other, 4), rtol=1e-4)
