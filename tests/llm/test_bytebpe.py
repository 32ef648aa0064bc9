import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from verdance.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = bytebpe.tree_bpe(PATH, public_tokenizers.PATTERN)


def test_documents_match_library(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        ids = BPE.encode(r.text)
        assert ids == BPE.library.encode_ordinary(r.text)
        assert BPE.decode(ids) == r.text.encode()


ALPHABET = st.one_of(st.sampled_from(list(" \n\t'streved.!0ésöll   ")), st.characters())


@settings(max_examples=600, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.integers(1, 9))
def test_small_leaves_match_library(text, leaf):
    text = text.encode("utf-8", "replace").decode()
    old = bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES
    bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES = leaf, leaf
    try:
        ids = BPE.encode(text)
    finally:
        bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES = old
    assert ids == BPE.library.encode_ordinary(text) and BPE.decode(ids) == text.encode()


def test_long_pieces_match_library():
    rng = random.Random(5)
    for n in (65, 500, 3000):
        for letters in ("a", "ab", "abcdefghij", "ésöüñ", "the tion".replace(" ", "")):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert BPE.encode(text) == BPE.library.encode_ordinary(text)
    for text in (" " * 5000 + "x", "!" * 4097, "\n" * 999, "'s" * 800, "9" * 2000):
        assert BPE.encode(text) == BPE.library.encode_ordinary(text)


def test_every_token_is_rebuilt_by_merges():
    """The pair criterion needs each token to be the encoding of its own bytes."""
    for token in BPE.ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((BPE.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            assert rank < 1 << 60, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_operators(spark):
    rows = [(1, None), (2, ""), (None, "It's  a test.\n"), (3, "x y" * 40000), (3, "x y" * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "2 as n_tokens")
    got = sorted(bytebpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
    want = []
    for d, t in rows:
        ids = BPE.library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: str(next(g for g in got if tuple(g) == w)))
    back = bytebpe.decode(bytebpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(d), t or "") for d, t in rows)
    assert bytebpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
