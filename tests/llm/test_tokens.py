"""Byte-level BPE, unigram counts, directly addressable codes and packing against plain versions."""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, dac, packing, unigram

from .fixtures import AWKWARD, clashing, table

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def key(rows, *names):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *(str(r[n]) for n in names)) for r in rows))


def test_bpe_matches_a_plain_encoder_and_decodes(spark, reference):
    got = bpe.encode(clashing(spark)).collect()
    assert len(got) == len(AWKWARD)
    want = [{"doc_id": i, "tokens": None if t is None else reference(t)} for i, t in AWKWARD]
    assert key(got, "tokens") == key(want, "tokens")
    assert all(r["decoded"] is (None if r["tokens"] is None else True) for r in got)
    back = bpe.decode(bpe.encode(table(spark))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(AWKWARD)


def test_bpe_long_pretoken_and_memo(reference):
    v = bpe.load_vocabulary()
    for text in ("ab" * 700, "naïve" * 90 + " " + "z" * 300, "a b a b a"):
        data = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(data)])
        ids, n = bpe.encode_texts(v, data, off)
        assert ids.tolist() == reference(text)
        assert bpe.count_texts(v, data, off).tolist() == n.tolist() == bpe.count_texts(v, data, off).tolist()


def test_bad_tokens_decode_to_null(spark):
    df = spark.createDataFrame([(1, [10**6]), (2, None), (3, []), (4, [-1])], "doc_id long, tokens array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == {1: None, 2: None, 3: "", 4: None}


def test_empty_tables(spark):
    empty = table(spark, [])
    for f in (bpe.encode, unigram.token_counts, dac.encode_tokens, packing.pack):
        assert f(empty).collect() == []


def test_codes_give_every_token_back_and_random_access(spark, reference):
    coded = dac.encode_tokens(clashing(spark)).cache()
    want = [{"doc_id": i, "tokens": None if t is None else reference(t)} for i, t in AWKWARD]
    assert key(dac.decode_tokens(coded).collect(), "tokens") == key(want, "tokens")
    for r in coded.where("codes is not null and doc_id is not null").collect():
        ids = dac.Codes(r["codes"]).decode()
        at = np.random.default_rng(1).permutation(len(ids))[:200]
        assert np.array_equal(dac.Codes(r["codes"]).at(at), ids[at]) and r["n_bytes"] == len(r["codes"])
    asked = spark.createDataFrame([(9, 0), (9, 10**6), (2, 0)], "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["token"] for r in dac.tokens_at(coded, asked).collect()}
    assert got == {(9, 0): reference(dict(AWKWARD)[9])[0], (9, 10**6): None, (2, 0): None}


def test_access_to_places_asked_often_nowhere_and_far_apart(spark, tmp_path):
    ids = np.arange(200_000) * 7919 % 50_000
    coded = spark.createDataFrame([(1, bytearray(dac.encode_ids(ids)), "x"), (2, bytearray(dac.encode_ids(ids[:3])), "x"), (2, bytearray(dac.encode_ids(ids[5:9])), "x"), (3, None, "x"), (None, bytearray(dac.encode_ids(ids[:3])), "x")], "doc_id long, codes binary, at string")
    asked = [(1, k) for k in range(0, 200_001, 997)] + [(1, 131_072)] * 150_000 + [(2, 0), (2, 3), (2, -1), (2, 2**62), (3, 0), (4, 0), (None, 0), (1, None)]
    questions = spark.createDataFrame(asked, "doc_id long, position long").withColumn("times", F.lit("x"))
    held = {1: [ids], 2: [ids[:3], ids[5:9]], 3: [ids[:0]]}
    want = Counter((d, k, int(x[k]) if 0 <= k < len(x) else None) for d, k in asked if k is not None for x in held.get(d, []))
    got = dac.tokens_at(coded, questions).groupBy("doc_id", "position", "token").count().collect()
    assert {(r["doc_id"], r["position"], r["token"]): r["count"] for r in got} == want
    assert dac.tokens_at(coded, questions.limit(0)).count() == 0 and dac.tokens_at(coded.limit(0), questions).count() == 0
    lists = dac._asked(questions).selectExpr("max(size(at)) AS m", "sum(aggregate(times, 0L, (s, t) -> s + t)) AS n").first()
    assert lists["m"] <= dac.ASKED and lists["n"] == len(asked) - 2


@pytest.mark.parametrize("widths", [(8, 4, 4, 16), (1, 1, 2, 4, 8, 16), (16, 16)])
def test_codes_of_wide_ids(widths):
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**31, 7] * 300)
    codes = dac.Codes(dac.encode_ids(ids, widths))
    assert np.array_equal(codes.decode(), ids) and codes[len(ids) - 2] == 2**31
    with pytest.raises(IndexError):
        codes[len(ids)]
    with pytest.raises(ValueError):
        dac.encode_ids(np.array([-1]), widths)


def brute_unigram(v, word):
    """(score, tokens) by trying every segmentation with memory only of prefixes."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = []
        for j in range(i):
            piece = word[j:i]
            if piece in v.score:
                options.append((best[j][0] + v.score[piece], -(best[j][1] + 1)))
            elif len(piece) == 1:
                options.append((best[j][0] + v.unknown, -(best[j][1] + len(piece.encode()))))
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def plain_unigram(v, word):
    """Best score and fewest tokens to each place from the right end, in whole numbers of the pieces' own scores."""
    best = {len(word): (0.0, 0)}
    for i in range(len(word) - 1, -1, -1):
        ways = []
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            if (piece := word[i:j]) in v.score:
                ways.append((v.score[piece] + best[j][0], best[j][1] + 1))
        if word[i] not in v.score:
            ways.append((v.unknown + best[i + 1][0], best[i + 1][1] + len(word[i].encode())))
        top = max(s for s, _ in ways)
        best[i] = (top, min(n for s, n in ways if abs(s - top) < 1e-9))
    return best[0][1]


def test_unigram_counts_match_a_plain_recurrence(spark):
    v = unigram.load_pieces()
    got = unigram.token_counts(clashing(spark)).collect()
    cache: dict[str, int] = {}
    want = []
    for i, t in AWKWARD:
        words = None if t is None else t.split()
        if words is not None:
            for w in words:
                if w not in cache:
                    cache[w] = plain_unigram(v, chr(unigram.MARK) + w) if len(w) > 100 else brute_unigram(v, chr(unigram.MARK) + w)
        want.append({"doc_id": i, "n_words": None if words is None else len(words), "n_tokens": None if words is None else sum(cache[w] for w in words)})
    assert key(got, "n_words", "n_tokens") == key(want, "n_words", "n_tokens")


def test_unigram_ties_take_fewer_tokens():
    v = unigram.make_pieces({"a": -1.0, "b": -1.0, "ab": -2.0, chr(unigram.MARK): -1.0})
    points = np.frombuffer("abab".encode("utf-32-le"), "<u4")
    assert unigram.count_words(v, points, np.array([0]), np.array([4])).tolist() == [3]


def plain_plan(size, tiers):
    """The same packing with sorted lists and no structure: longest first, gaps of longer windows from shorter tiers."""
    stock = [sorted(((int(s), -i) for i, s in enumerate(size) if (tiers[k - 1] if k else 0) < s <= tiers[k]), reverse=True) for k in range(len(tiers))]

    def take(k, most):
        for x in stock[k]:
            if x[0] <= most:
                stock[k].remove(x)
                return -x[1], x[0]
        return None

    out = []
    for k in range(len(tiers) - 1, -1, -1):
        own = []
        while got := take(k, tiers[k]):
            inside, gap = [got[0]], tiers[k] - got[1]
            while gap > 0 and (got := take(k, gap)):
                inside.append(got[0])
                gap -= got[1]
            own.append((gap, inside))
        for gap, inside in sorted(own, key=lambda w: (-w[0], w[1])):
            for lower in range(k - 1, -1, -1):
                while gap > 0 and (got := take(lower, gap)):
                    inside.append(got[0])
                    gap -= got[1]
            out.append((tiers[k], inside))
    return out


def test_packing_plan_matches_a_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size = rng.integers(1, 65, rng.integers(0, 120))
        assert packing.plan(size, (8, 16, 64)) == plain_plan(size, (8, 16, 64))


def test_groups_are_full_and_balanced():
    work = [9, 1, 1, 1, 9, 1, 1, 1, 5]
    got = packing.balance(work, 3)
    assert sorted(Counter(got).values()) == [3, 3, 3] and packing.balance([], 3) == []
    sums = [sum(w for w, g in zip(work, got, strict=True) if g == k) for k in range(3)]
    assert max(sums) - min(sums) <= 4


def test_packing_places_every_token_once(spark, reference):
    got = packing.pack(clashing(spark), tiers=(64, 256, 1024), step_tokens=2048, bucket_rows=4).collect()
    want = Counter(len(reference(t)) + 1 for i, t in AWKWARD if t)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["window_id"] >> 32 if r["doc_id"] == 5 else 0].append(r)
    assert sum(r["n_tokens"] for r in got) == sum(k * n for k, n in want.items())
    windows = defaultdict(list)
    for r in got:
        windows[r["window_id"]].append((r["position"], r["n_tokens"], r["tier"], r["step_group"]))
    for pieces in windows.values():
        at = 0
        for position, n, tier, _ in sorted(pieces):
            assert position == at
            at += n
        assert at <= tier and len({(p[2], p[3]) for p in pieces}) == 1
    groups = defaultdict(set)
    for w, pieces in windows.items():
        groups[pieces[0][3]].add((w, pieces[0][2]))
    assert all(len({t for _, t in g}) == 1 and len(g) * next(iter(g))[1] <= 2048 for g in groups.values())
    long = sorted((r["piece"], r["start"], r["n_tokens"]) for r in got if r["doc_id"] == 8)
    assert [s for _, s, _ in long] == [k * 1024 for k in range(len(long))] and sum(n for *_, n in long) == len(reference(dict(AWKWARD)[8])) + 1
    assert not {1, 2} & {r["doc_id"] for r in got}


def test_packing_parameters():
    with pytest.raises(ValueError):
        packing.pack_lengths(None, tiers=(8, 4))
