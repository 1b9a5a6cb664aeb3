"""Token alignment against whole-text encoding and links found one by one."""

import collections
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardscore.llm import token_alignment as T

ODD = [
    "", None, " ", "  ", "a ", "x\n  y\r\n\tz", "<|endoftext|> <s> </s>", "▁ab", "\x00a", "a　 b", "é" * 300, "𝔘 ok", "a\x85 \x1c b",
    " lead", "'s don't I'LL", "1２３ ４", "same words", "same words", "long " * 5000 + "x" * 3000,
]


@pytest.fixture(scope="module")
def sides():
    return T._sides(T.default_paths())


def plain(text, sides):
    """Ids and byte ranges of both sides from whole-text encoding; None for a text without tokens."""
    if not text:
        return None
    ids = [sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids, sides[1].model.encode(text)]
    ranges = []
    for side, own in zip(sides, ids):
        pieces = [side.pieces[i].as_py() for i in own]
        if b"".join(pieces) != (" " + text).encode():
            return None
        end, out = 0, []
        for piece in pieces:
            out.append((end, end + len(piece)))
            end += len(piece)
        ranges.append(out)
    return ids, ranges


def links_of(ranges):
    return [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e]


def brute(texts, sides):
    found = [plain(t, sides) for t in texts]
    links = [[] if f is None else _fast_links(f[1]) for f in found]
    pairs = [[] if f is None else [(f[0][0][i], f[0][1][j]) for i, j in own] for f, own in zip(found, links)]
    counts = collections.Counter(p for own in pairs for p in set(own))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for f, own in zip(found, pairs):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, ranges = f
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = ["|".join(",".join(str(i) for i, (_, e) in zip(ids[s], ranges[s]) if b < e <= stop) for s in (0, 1)) for b, stop in zip([0, *ends], ends)]
        sums = sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own)
        out.append((len(ids[0]), len(ids[1]), len(ends), len(own), *sums, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def _fast_links(ranges):
    out, first = [], 0
    for i, (s, e) in enumerate(ranges[0]):
        while ranges[1][first][1] <= s:
            first += 1
        j = first
        while j < len(ranges[1]) and ranges[1][j][0] < e:
            out.append((i, j))
            j += 1
    return out


def test_digests_equal_brute_force(spark, sf_dir, sides, monkeypatch):
    monkeypatch.setattr(T, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(T, "CHUNK_BYTES", 50_000)
    given_texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*ODD[:-1], *(t for t in given_texts if len(t or "") < 4000)]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, chunk double")
    got = {r[0]: tuple(r)[1:] for r in T.digests(docs.repartition(3)).collect()}
    assert got == dict(enumerate(brute(texts, sides)))


def test_long_text_repeats_and_missing_ids(spark, sides):
    rows = [(None, ODD[-1]), (7, ODD[-1]), (7, ODD[-1]), (8, "x")]
    got = sorted((tuple(r)[1:] for r in T.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute([t for _, t in rows], sides))
    assert T.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignments_give_ranges_links_and_groups(spark, sides):
    texts = [t for t in ODD[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in T.alignments(docs).collect():
        want = plain(texts[row.doc_id], sides)
        if want is None:
            assert not (row.a_ids or row.a_ends or row.b_ids or row.b_ends or row.links or row.group_ends)
            continue
        ids, ranges = want
        assert [row.a_ids, row.b_ids] == ids
        assert [row.a_ends, row.b_ends] == [[e for _, e in r] for r in ranges]
        assert [tuple(x) for x in row.links] == links_of(ranges)
        assert row.group_ends == sorted(set(row.a_ends) & set(row.b_ends))


def test_pair_counts(spark, sides):
    texts = ["the cat", "the cat sat", "the cat", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = collections.Counter()
    for t in texts:
        f = plain(t, sides)
        if f:
            want.update({(f[0][0][i], f[0][1][j]) for i, j in links_of(f[1])})
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in T.pair_counts(docs).collect()}
    assert got == {p: (n, n == max(m for q, m in want.items() if q[0] == p[0])) for p, n in want.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é'st1 \n\t　\xa0\x1c▁<>|０Ж漢"), max_size=40))
def test_units_encode_as_the_whole_text_does(text):
    own = T._sides(T.default_paths()) if not hasattr(T, "_tested") else T._tested
    T._tested = own
    a, _ = own[0].encode([" " + text])
    b, _ = own[1].encode([" " + text] if text else [""])
    assert a.tolist() == own[0].tokenizer.encode(" " + text, add_special_tokens=False).ids
    assert b.tolist() == own[1].model.encode(text)


def test_forgetting_changes_nothing(sides, monkeypatch):
    want = T.align(["some words here", "and more of them"], sides)
    monkeypatch.setattr(T, "REMEMBERED", 0)
    for _ in range(2):
        got = T.align(["some words here", "and more of them"], sides)
        assert got.a.id.tolist() == want.a.id.tolist() and got.b.id.tolist() == want.b.id.tolist()
