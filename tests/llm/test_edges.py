"""Odd tables for every training-data operator: empty, repeated rows, very long texts and words, clashing columns; and the pipeline end to end."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("panelforge.llm")
from panelforge.llm import bpe, common, decontamination, html_blocks, license_scan, media, ngram_jaccard, secret_scan, substring_dedup, token_files, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string, secret_spans string, candidate_rules string, row string"
LABELS = "doc_id long, quality int, toxic int"


def table(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "y", "s", "r", "w") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], LABELS)


BYTE, WORD = common.tokenizer_file("byte_bpe_50k.json"), common.tokenizer_file("word_bpe_49k.json")
OPERATORS = {
    "op1": lambda spark, docs: substring_dedup.substring_dedup(docs),
    "op2": lambda spark, docs: toxicity.toxicity_scores(docs, labels(spark, [(0, 0), (1, 1)])),
    "op3": lambda spark, docs: decontamination.contaminated(docs, spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, "")], "item_id long, text string")),
    "op4": lambda spark, docs: token_files.read_shards(token_files.write_shards(docs, WORD)),
    "op5": lambda spark, docs: license_scan.licensed(license_scan.document_files(docs)),
    "op7": lambda spark, docs: media.media_columns(docs),
    "op8": lambda spark, docs: bpe.bpe_digests(docs, BYTE),
    "op9": lambda spark, docs: secret_scan.secret_digests(docs),
    "op10": lambda spark, docs: ngram_jaccard.jaccard_components(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_missing_ids(spark, name):
    texts = ["one two three four five six", "token = abcdef123456 is said", None, ""]
    docs = table(spark, texts * 2 + texts[:2], [0, 1, 2, 3, 0, 1, 2, 3, None, None])
    out = OPERATORS[name](spark, docs).collect()
    if name == "op3":
        assert sorted((r.doc_id, r.item_id) for r in out if r.doc_id is not None) == [(0, 1)] and sum(r.doc_id is None for r in out) == 1
        return
    assert sorted(str(r.doc_id) for r in out) == sorted(["0", "1", "2", "3"] * 2 + ["None"] * 2)
    told = {}
    for r in out:  # rows that are alike get the same answer
        if r.doc_id is not None and name not in ("op1", "op4"):
            assert told.setdefault(r.doc_id, tuple(r)) == tuple(r)


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts_and_words(spark, name):
    rng = random.Random(5)
    letters = "".join(rng.choices("abcdefghij", k=150_000))
    line = " ".join(f"w{rng.randrange(4000)}" for _ in range(25_000)) + " license copyright"
    out = {r.doc_id: r for r in OPERATORS[name](spark, table(spark, [letters, "1" * 100_000, line, "a " * 50_000, "z" * 100_000, "plain words"])).collect()}
    if name == "op3":
        assert not out
    else:
        assert sorted(out) == [0, 1, 2, 3, 4, 5]
    if name == "op8":
        library = pytest.importorskip("tokenizers").Tokenizer.from_file(BYTE)
        ids = library.encode(letters, add_special_tokens=False).ids
        assert (out[0].n_tokens, out[0].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pages_empty_repeated_and_long(spark):
    article = "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>This is paragraph number {i} of the article with a good many words in it.</p>" for i in range(3000)) + "</article></body></html>"
    rows = [(1, "u", article, "x"), (1, "u", article, "x"), (None, None, None, "x"), (2, "v", "", "x")]
    schema = "page_id long, url string, html string, text string"
    out = html_blocks.extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.page_id) for r in out) == ["1", "1", "2", "None"]
    same = [r for r in out if r.page_id == 1]
    assert same[0] == same[1] and same[0].text.count("\n") == 2999 and same[0].n_chars == len(same[0].text)
    assert html_blocks.extracted(spark.createDataFrame([], schema)).count() == 0


def test_licence_versions_ties_and_repeated_paths(spark):
    opening = "This program is free software; you can redistribute it and/or modify"
    whole = opening + "\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation; either version {} of the License, or\n (at your option) any later version."
    files = [(1, "a/x.c", opening), (2, "b/x.c", whole.format(2)), (3, "c/x.c", whole.format(3).replace("software;", "software:")), (4, "d/LICENSE", "Released under the MIT License"), (5, "d/LICENSE", "Licensed under the BSD 3-Clause License"), (6, "d/e/f.c", "code")]
    got = {r.doc_id: r.license for r in license_scan.licensed(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: None, 2: "GPL-2.0", 3: "GPL-3.0", 4: "MIT", 5: "BSD-3-Clause", 6: "BSD-3-Clause"}


def test_disguises_are_read():
    words = ["stupid", "zorkly", "wait", "the", "hello", "moron"]
    grams = [f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)]
    model = toxicity.Toxicity(toxicity.Restorer(toxicity.CharModel({g: 5 * grams.count(g) for g in grams}), dict.fromkeys(words, 5)), {"zorkly": 4.0, "zork-": 1.0, "moron": 4.0}, -2.0)
    clean = model.score("wait for the hello")
    for text in ("zorkly", "Zorkly!", "z0rkly", "zoorkly", "zorrkly", "zo" + "o" * 45 + "rkly", "z  o  r  k  l  y", "z\no\nr\nk\nl\ny", "z.o.r.k.l.y", "zоrkly", "zοrkly", "**zorkly**", "m0r0n", "you mo-ron", '"zorkly"', "zorkly" + "y" * 3000):
        assert model.score(text) > 0.5 > clean, text
    for text in ("zebra", "zo", "z 0", "1" * 5000, "морон"):
        assert model.score(text) == clean, text


def test_every_weighed_sign_passes_the_gate():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeilorst", k=rng.randint(3, 9))) for _ in range(60)]
    grams = [f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)]
    model = toxicity.Toxicity(toxicity.Restorer(toxicity.CharModel({g: grams.count(g) for g in set(grams)}), dict.fromkeys(words, 3)), {s: 1.0 for w in words[:20] for s in toxicity.signs_of(w)}, 0.0)
    alike = {c: [k for k, v in toxicity.LOOKALIKES.items() if c in v] for c in "abcdeilorst"}
    for _ in range(1500):
        word = rng.choice(words)
        token = "".join(rng.choice([c, c, c * rng.randint(1, 3), rng.choice(alike[c] or [c]), c + rng.choice(".-*")]) for c in word) + rng.choice(["", ".", "!", '"'])
        low = token.lower()
        if model.met(low):
            model.memory.clear()
            assert model.candidates(low) == [low]


def test_alignment_finds_what_all_pairs_find(spark):
    """Seeds against Smith-Waterman over all pairs of items and documents, on edited copies and unrelated texts."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [rng.choices(vocabulary, k=rng.randint(20, 50)) for _ in range(12)]
    texts = []
    for k in range(150):
        copy = list(rng.choice(items))
        share = rng.choice([0, 0.1, 0.2, 0.3])
        for i in range(len(copy)):
            if rng.random() < share:
                copy[i] = rng.choice(vocabulary)
        if k % 3 == 0:
            del copy[rng.randrange(len(copy)) :][:4]
        filler = rng.choices(vocabulary, k=30)
        texts.append(" ".join(filler[:15] + copy + filler[15:]) if k % 5 else " ".join(rng.choices(vocabulary, k=90)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    hashed = {w: np.uint64(zlib.crc32(w.encode())) for w in vocabulary}
    words = [np.array([hashed[w] for w in t.split()], np.uint64) for t in texts]
    want = set()
    for j, item in enumerate(items):
        own = np.array([hashed[w] for w in item], np.uint64)
        for i, (score, *_) in enumerate(decontamination.align([own] * len(words), words)):
            if score >= decontamination.LEAST * decontamination.MATCH * len(own):
                want.add((i, j))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 80


def test_pipeline_end_to_end(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 8))) for _ in range(400)]
    item = rng.choices(words, k=40)
    texts, known = [], []
    for i in range(240):
        ws = rng.choices(words, k=60)
        if i % 4 == 0:
            ws[5:7] = ["zorkly", "grumbix"]
        texts.append(" ".join(ws))
        known.append((i, int(i % 4 == 0)))
    texts[1] = " ".join([*rng.choices(words, k=20), *item, *rng.choices(words, k=20)])
    texts[2] += " password = abcdef123456"
    near = texts[3].split()
    near[30] = "changed"
    texts += [" ".join(near * 1), texts[5], None, "", "", texts[7]]
    near_id, copy_id, null_id, empty_id, other_empty = 240, 241, 242, 243, 244
    ids = [*range(245), None]
    # a longer text, so that one changed word keeps the pair above 80 %
    texts[3], texts[near_id] = " ".join(words[:90]), " ".join([*words[:45], "changed", *words[46:90]])
    docs = table(spark, texts, ids).drop("row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, known).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    want = set(range(245)) - {i for i in range(240) if i % 4 == 0} - {1, near_id, copy_id}
    assert {r.doc_id for r in out} == want and len(out) == len(want)  # the row without an id was a copy of 7
    own = bpe.model(BYTE)
    told = {r.doc_id: r for r in out}
    assert told[2].ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ids(texts[2].replace("password = abcdef123456", "[secret]")))).encode()).hexdigest()
    assert {told[null_id].n_tokens, told[empty_id].n_tokens, told[other_empty].n_tokens} == {0}


def test_pipeline_on_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_split_joins_by_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "WHOLE_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    big = spark.createDataFrame([(i % 40 if i % 3 else 7, i) for i in range(400)], "k int, v int")
    small = spark.createDataFrame([(k, k * k) for k in range(30)], "k int, w int")
    got = sorted(tuple(r) for r in common.split_join(common.stored(big, "big"), small, "k").select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in big.join(small, "k").select("k", "v", "w").collect())
    assert {r.k for r in common.hot_keys(big, "k").collect()} == {7}
    texts = ["a b c d e f g h i j"] * 5 + ["a b c d e f g h i j k"] * 3 + [f"x{i} y z w v u t s r q p q{i}" for i in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(table(spark, texts), 3, 80).collect()}
    assert {got[i] for i in range(8)} == {0} and len({got[i] for i in range(8, 28)}) == 20
