"""Very long texts, bytes that aren't text, empty tables, clashing columns and ties, for all operators and the pipeline."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, crf, dac, langid, licenses, ngram_join, packing, secrets, unigram, winnow
from cairn.llm.arrays import SLICE_BYTES, sound

from .fixtures import WORDS, clashing, prose, table

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def scanner():
    return secrets.train()


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(12)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(14)).capitalize() + "."
    lines = [line() for _ in range(70_000)]
    lines[-2] = "é Licensed under the Apache License, Version 2.0."
    lines[-1] = f'token = "{KEY}"'
    return "\n".join(lines)


@pytest.fixture(scope="module")
def tall(spark, long_text):
    """A text of over four slices between small ones, its altered copy, and a label for each of some pages."""
    words = long_text.split(" ")
    for i in range(0, len(words), 50):
        words[i] = "changed"
    rows = [(1, "one small text in front"), (2, long_text), (3, "one small text behind it"), (4, " ".join(words)), (5, "")]
    assert len(long_text) > 4 * SLICE_BYTES
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_very_long_texts_are_taken_whole(spark, tall, long_text, scanner):
    ids = by_id(bpe.encode(tall).select("doc_id", "n_tokens", "decoded"))
    assert all(r["decoded"] for r in ids.values()) and ids[2]["n_tokens"] > 900_000
    codes = dac.encode_tokens(tall)
    at = spark.createDataFrame([(2, 0), (2, ids[2]["n_tokens"] - 1), (2, ids[2]["n_tokens"]), (3, 0)], "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["token"] for r in dac.tokens_at(codes, at).collect()}
    tail = bpe.encode(tall.where("doc_id IN (2, 3)")).select("doc_id", F.element_at("tokens", -1).alias("z"), F.element_at("tokens", 1).alias("a")).collect()
    tail = {r["doc_id"]: r for r in tail}
    assert got == {(2, 0): tail[2]["a"], (2, ids[2]["n_tokens"] - 1): tail[2]["z"], (2, ids[2]["n_tokens"]): None, (3, 0): tail[3]["a"]}
    placed = packing.pack(tall).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).collect()
    assert {r["doc_id"]: r["n"] for r in placed} == {i: r["n_tokens"] + 1 for i, r in ids.items() if r["n_tokens"]}
    counts = by_id(unigram.token_counts(tall))
    assert counts[2]["n_words"] == len(long_text.split()) and counts[2]["n_tokens"] >= counts[2]["n_words"]
    prints = by_id(winnow.fingerprints(tall))
    assert prints[2]["positions"][-1] > len(long_text) - 200 and len(set(prints[2]["hashes"]) & set(prints[4]["hashes"])) > 1000
    found = {(r["doc_id"], r["license"]): r for r in licenses.licenses(tall).collect()}
    r = found[2, "Apache-2.0"]
    assert long_text[r["start"] : r["start"] + r["length"]].startswith("Licensed under the Apache License")
    (hit,) = [r for r in secrets.scan(tall, scanner).collect() if r["doc_id"] == 2]
    assert long_text[hit["start"] : hit["start"] + hit["length"]] == KEY
    masked = by_id(secrets.redact(tall, scanner))
    assert masked[2]["text"] == long_text.replace(KEY, secrets.MASK) and masked[2]["n_chars"] == len(masked[2]["text"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert by_id(crf.assess(tall, labels))[2]["n_lines"] == 70_000
    model = langid.train(tall)
    tongue = by_id(langid.identify(tall, model))
    letters = sum(len(w) for w in re.findall(r"[^\W\d_]+", long_text))
    assert tongue[2]["language"] == "en" and tongue[2]["n_grams"] > 2 * letters


def test_a_long_text_has_the_score_of_its_parts(tall):
    model = langid.train(tall)
    part = "the winter maps under stone ".encode()
    one = np.frombuffer(part * 60_000, np.uint8)
    many = np.frombuffer(part * 60, np.uint8)
    s, n = model.scores(one, np.array([0, len(one)]))
    t, m = model.scores(np.r_[many, many], np.array([0, len(many), 2 * len(many)]))
    inner = (t[0] - model.prior) / m[0]
    assert np.allclose((s[0] - model.prior) / n[0], inner, rtol=1e-3)


def test_long_texts_join_by_their_real_similarity(tall, long_text):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    grams = lambda t: {tuple(w) for w in zip(*(words(t)[k:] for k in range(3)), strict=False)}
    texts = {r["doc_id"]: r["text"] for r in tall.collect()}
    a, b = grams(texts[2]), grams(texts[4])
    want = len(a & b) / len(a | b)
    (got,) = [r for r in ngram_join.ngram_jaccard_join(tall, 0.3).collect() if r["doc_id_a"] == 2]
    assert got["doc_id_b"] == 4 and got["jaccard"] == pytest.approx(want)


@pytest.fixture(scope="module")
def broken(spark):
    """A text with a byte of no character in it, one cut within a character, and a sound one."""
    df = spark.createDataFrame([(1, b"some words \xff and others here"), (2, "plain caf".encode() + b"\xc3"), (3, b"quite another sound text")], "doc_id long, raw binary")
    return df.select("doc_id", F.expr("CAST(raw AS STRING)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))


def test_bytes_that_are_no_text_count_as_the_replacement_character(spark, broken, scanner):
    repaired = spark.createDataFrame([(1, "some words � and others here"), (2, "plain caf�"), (3, "quite another sound text")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = langid.train(repaired)
    for f in (bpe.encode, winnow.fingerprints, unigram.token_counts, dac.encode_tokens, licenses.licenses, ngram_join.similar_classes, packing.pack, lambda d: secrets.scan(d, scanner), lambda d: crf.assess(d, labels), lambda d: langid.identify(d, model)):
        assert sorted(map(str, f(broken).collect())) == sorted(map(str, f(repaired).collect()))
    assert {r["text"] for r in secrets.redact(broken, scanner).collect()} == {r["text"] for r in repaired.collect()}
    assert {r["doc_id"] for r in ngram_join.drop_similar(broken).select("doc_id").collect()} == {1, 2, 3}
    assert crf.keep_content(broken, labels).select("doc_id").count() == crf.keep_content(repaired, labels).count()
    assert langid.keep_identified(broken, model).select("doc_id").count() == langid.keep_identified(repaired, model).count()
    import pyarrow as pa

    assert sound(pa.array([None, "a"])).to_pylist() == [None, "a"]


def test_filters_keep_an_empty_table_and_clashing_columns(spark, scanner):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for docs in (table(spark, []), clashing(spark), clashing(spark).selectExpr("*", "1 AS x", "2 AS gone", "3 AS text_", "4 AS quality", "5 AS version", "6 AS class")):
        for f in (lambda d: langid.keep_identified(d), lambda d: crf.keep_content(d, labels), ngram_join.drop_similar, lambda d: secrets.redact(d, scanner)):
            out = f(docs)
            assert out.columns == docs.columns and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
            assert out.count() <= docs.count()
        crf.assess(docs, labels).collect()


def test_the_pipeline_on_no_documents_and_on_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    junk = lambda i: " | ".join(random.Random(i).choice(WORDS).title() for _ in range(9)) + " |"
    rows = [(i, prose(i, 50) if i % 3 else junk(i), "en" if i % 2 else "de", "s", 0) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, df in {"none": spark.createDataFrame([], schema), "clash": spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS node", "'y' AS accepted", "1 AS gone", "2 AS n_tokens", "3 AS tier", "4 AS label")}.items():
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (not got) if name == "none" else {r["doc_id"] for r in got} == {i for i in range(30) if i % 3}


def test_training_counts_are_those_of_the_texts(spark):
    """The log-probabilities from a count by hand, over the hashed n-grams of every text of a language."""
    rows = [(i, prose(i, 20), "a" if i % 3 else "b") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, lang in enumerate(model.languages):
        counts: Counter = Counter()
        for _, text, name in rows:
            if name == lang:
                seq = " " + re.sub(r"[^a-z]+", " ", text.lower()) + " "
                for n in langid.ORDERS:
                    for i in range(len(seq) - n + 1):
                        if seq[i : i + n].strip():
                            h = n
                            for c in seq[i : i + n]:
                                h = ((h << 21) & (2**64 - 1)) ^ (h >> 43) ^ ord(c)
                            counts[finish(h) >> (64 - langid.BITS)] += 1
        total = sum(counts.values())
        for code in range(1 << langid.BITS):
            want = np.log((counts[code] + langid.SMOOTHING) / (total + langid.SMOOTHING * (1 << langid.BITS)))
            assert abs(model.log_p[code, k] - want) < 1e-5
        assert np.exp(model.prior[k]) == pytest.approx(sum(r[2] == lang for r in rows) / len(rows))


def finish(h):
    m = 2**64 - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 33


def test_ties(spark):
    same = [(1, "alpha beta", "b"), (2, "alpha beta", "a")]
    got = langid.identify(spark.createDataFrame(same, "doc_id long, text string, lang string"), min_confidence=0.0).collect()
    assert {r["language"] for r in got} == {"a"} and all(r["confidence"] == 0.5 for r in got)
    flat = crf.Model(np.zeros((len(crf.FEATURES), 2)), np.zeros((2, 2)))
    assert flat.decode(np.ones((3, len(crf.FEATURES))), np.array([0, 3])).tolist() == [crf.BOILERPLATE] * 3
    text = "Licensed under the MIT License. Licensed under the MIT License."
    (r,) = licenses.licenses(table(spark, [(1, text)])).collect()
    assert r["start"] == 0 and r["coverage"] == 1.0


def test_mixed_pages_are_labelled_line_by_line(spark):
    junk = lambda r: " | ".join(r.choice(WORDS).title() for _ in range(9)) + " |"
    rows = []
    for i in range(120):
        r = random.Random(i)
        rows.append((i, "\n".join(prose(i * 9 + k, 12).capitalize() if i % 2 else junk(r) for k in range(r.randint(1, 6)))))
    long = "\n".join(prose(k, 12).capitalize() for k in range(5000))
    docs = spark.createDataFrame([*rows, (121, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(122)], "doc_id long, quality int, toxic int")
    model = crf.train(docs, labels)
    r = random.Random(5)
    page = [*(junk(r) for _ in range(3)), *(prose(k, 12).capitalize() for k in range(800, 806)), *(junk(r) for _ in range(4))]
    (got,) = crf.assess(spark.createDataFrame([(1, "\n".join(page))], "doc_id long, text string"), labels, model).collect()
    assert got["n_lines"] == 13 and got["content_lines"] == 6
    assert model.change[0, 0] + model.change[1, 1] > model.change[0, 1] + model.change[1, 0]  # labels like to stay
    # a long labelled document teaches by windows spread over all of it
    assert crf.windows_of(5000, 64, 8)[0] == (0, 64) and crf.windows_of(5000, 64, 8)[-1] == (4992, 5000) and len(crf.windows_of(5000, 64, 8)) == 8
    assert crf.windows_of(100, 64, 8) == [(0, 64), (64, 100)] and crf.windows_of(0, 64, 8) == []
    only_long = crf.train(docs.where("doc_id IN (0, 121)"), labels)
    assert (only_long.emit[:, 1] - only_long.emit[:, 0]).any()


def test_shards_give_any_token(spark, tmp_path):
    docs = clashing(spark).repartition(3)
    codes = dac.encode_tokens(docs)
    folder = f"file://{tmp_path}/shards"
    places = dac.write_shards(codes, folder)
    want = {}
    for r in bpe.encode(docs.where("doc_id > 5")).collect():
        for k, t in enumerate(r["tokens"] or []):
            want[r["doc_id"], k] = t
        want[r["doc_id"], len(r["tokens"] or [])] = None
    asked = spark.createDataFrame(list(want), "doc_id long, position long")
    got = {(r["doc_id"], r["position"]): r["token"] for r in dac.tokens_in_shards(places, asked, folder).collect()}
    assert got == want
    size = {f.name: f.stat().st_size for f in (tmp_path / "shards").iterdir() if not f.name.startswith(".")}
    assert sum(size.values()) == sum(r["n_bytes"] for r in places.collect()) and not any(n.startswith("_") for n in size)
    assert dac.write_shards(dac.encode_tokens(table(spark, [])), folder + "2").count() == 0


def test_hot_copies_and_families_beside_each_other(spark):
    """A third of the rows are one text, another third near copies of one: neither is compared with itself row by row."""
    r = random.Random(3)
    base = [f"{r.choice(WORDS)}{k}" for k in range(80)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(w if r.random() > 0.03 else f"x{r.randint(0, 10**6)}" for w in ["other", *base[::-1]])) for i in range(300)]
    rows += [(2000 + i, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = by_id(ngram_join.similar_classes(docs))
    assert {got[i]["class_id"] for i in range(300)} == {0} and {got[i]["n_links"] for i in range(300)} == {0}
    assert {got[1000 + i]["class_id"] for i in range(300)} == {1000}
    words = lambda t: {tuple(w) for w in zip(*(t.split()[k:] for k in range(3)), strict=False)}
    sets = {i: words(t) for i, t in rows if 1000 <= i < 2000}
    distinct = {frozenset(s): i for i, s in sets.items()}
    for i in (1000, 1111, 1299):
        want = sum(len(sets[i] & s) / len(sets[i] | s) >= 0.5 for s in distinct if s != sets[i])
        assert got[i]["n_links"] == want
    assert all(got[2000 + i]["class_id"] == 2000 + i for i in range(300))
    assert ngram_join.drop_similar(docs).count() == 302
