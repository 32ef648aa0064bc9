import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdance.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_match_library_on_documents(spark, library):
    words = packing.tokenizer(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, slow in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert words.encode(text).tolist() == slow.ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2060), st.sampled_from("aeisto'n. \n.,!0é<|>ßıİſ")), max_size=40))
def test_words_match_library(text):
    slow = Tokenizer.from_file(PATH) if not hasattr(test_words_match_library, "t") else test_words_match_library.t
    test_words_match_library.t = slow
    text = text.encode("utf-8", "replace").decode()
    assert packing.tokenizer(PATH).encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_special_strings_are_as_the_library_gives_them(spark, library):
    texts = ["x <|endoftext|> y", "<|startoftext|><|endoftext|>", "a<|ENDOFTEXT|>b", "<|endoftext|", "Two. <|startoftext|>İ and é<|endoftext|>" * 400]
    words, plain = packing.tokenizer(PATH), packing.tokenizer(PATH, True)
    as_text = Tokenizer.from_file(PATH)
    as_text.encode_special_tokens = True
    assert words.encode(texts[0]).tolist()[1] == 49407
    for t in texts:
        assert words.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        assert plain.encode(t).tolist() == as_text.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack(df, PATH, ids=True).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def brute_cost(places, costs, length):
    at, f = [0, *places], [0.0]
    for j in range(1, len(at)):
        f.append(costs[j - 1] + min(f[i] + length - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= length))
    return f[-1]


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(5, 40)
        places = np.cumsum([rng.randint(1, length) for _ in range(rng.randint(1, 40))]).tolist()
        costs = [float(rng.choice([0, 1, 2, 16])) for _ in places]
        cuts = packing.best_cuts(places, costs, length)
        price = dict(zip(places, costs))
        assert cuts[-1] == places[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
        assert sum(length - (b - a) + price[b] for a, b in zip([0, *cuts], cuts)) == brute_cost(places, costs, length)


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 3000])
def test_every_token_once(spark, library, block):
    rows = [(1, None), (2, ""), (None, "a b. c"), (3, "word " * 9000), (4, "x" * 5000), (5, "Same. Text!"), (5, "Same. Text!")]
    rows += [(10 + i, "It is so. " * (i * 7 % 200)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as sequence_id")
    got = packing.pack(df, PATH, block=block, ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.sequence_tokens for r in rs} == {at}
    for doc, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert all(r.doc_tokens == len(want) for r in by_doc[doc])
        if doc != 5:
            assert sum((r.ids for r in sorted(by_doc[doc], key=lambda r: r.start)), []) == want
    assert len(by_doc[5]) == 2


def test_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(2)
    got = packing.pack(df, PATH).select("sequence_id", "sequence_tokens", "padded_tokens").distinct().toPandas()
    assert got.sequence_tokens.sum() / got.padded_tokens.sum() > 0.99


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
