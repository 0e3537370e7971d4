import os
import random

import numpy as np
import pytest

from loglattice.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies here")
PIECES = [
    "a", "b", "é", "ß", "1", "²", "½", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "᠎", "​", " ", "　", "中", "文", "'s", "'ll", "'LL", "'", "''", "'re", "'v", "!", "?", "=", "-", "👍", "‍", "Я", "й",
    "٣", "Ⅷ", "ａ", "́", "﻿", "<|endoftext|>", "aaaa", "    ", "ª", "ɐ", "ͅ", "҂", "€", "™", "\U00010400", "𝒳", "𝟗", "\x00", "the", "ing", "10000",
]
TEXTS = [None, "", " ", "\n\n", "a", "x" * 300_000, "ab " * 100_000, "aaaaaaaaaaaaaaaaaaa", "a" * 7 + " " + "b" * 8 + " " + "c" * 15 + " " + "d" * 16, "don't he'll it's we've I'm 'tis !'s 's''t", "same", "same"]


def want(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return tokens.Merges(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"))


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_ids_are_those_of_the_tokenizer(merges):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    for group in (len(texts), 700, 1):
        encoder = tokens.Encoder(merges, keep_words=500)
        got = []
        for i in range(0, len(texts) if group > 1 else 40, group):
            got += split(*encoder.encode(texts[i : i + group]))
        assert got == want(texts)[: len(got)]


def test_words_join_to_the_text():
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    data, place, length, counts = tokens.words_of(texts)
    numbers, words = tokens.numbered(data, place, length)
    at = 0
    for text, n in zip(texts, counts):
        assert b"".join(words[k] for k in numbers[at : at + n]).decode() == text
        at += n
    assert len(set(words)) == len(words) and at == len(numbers)


def test_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert got == dict(enumerate(want(TEXTS)))
    counts = {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in tokens.token_counts(df, keep="ids", group_chars=1000).collect()}
    assert counts == {i: ("x", len(w)) for i, w in enumerate(want(TEXTS))}
    assert tokens.encoded(df.limit(0)).count() == 0


def test_whole_table(spark, table):
    docs = table("documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(docs).collect()}
    assert got == dict(zip(texts, want(list(texts.values()))))


def test_merges_of_equal_tokens_do_not_overlap(merges):
    ids, ends = merges.replay([b"a" * n for n in range(12)] + [b""])
    assert len(ends) == 13 and ends[0] == 0 and ends[12] == len(ids)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:12])] == want(["a" * n for n in range(1, 12)])
    assert np.array_equal(merges.replay([])[0], np.zeros(0))


def test_ids_decode_to_the_text(spark):
    texts = ["Hello  world\r\n", "", None, "é漢字🙂\u0000", " " * 500, "a" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["data"]).decode() for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.decoded(tokens.encoded(df.limit(0))).count() == 0
