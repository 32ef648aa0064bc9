import zlib
from collections import Counter

import numpy as np

from verdance.llm import langid, queries


def build(texts, **more):
    """Filters of all n-grams of ``(language, text)`` rows."""
    langs = sorted({lang for lang, _ in texts})
    return langid.assemble([(x, np.unique(np.concatenate([langid.grams(t) for lang, t in texts if lang == x]))) for x in langs], **more)


def test_held_out_accuracy(spark):
    got = queries.op10_langid(spark, "/root/testdata/sf0.1")
    truth = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert len(held) > 1000 and (held.lang_pred == held.lang).mean() > 0.99


def test_filters_return_all_languages_of_a_gram():
    texts = [("a", "alpha common"), ("b", "beta common"), ("c", "gamma")] * 3
    f = build(texts)
    sets = {lang: set(np.concatenate([langid.grams(t) for x, t in texts if x == lang]).tolist()) for lang in f.langs}
    codes = np.array(sorted(set().union(*sets.values())), np.uint64)
    for code, mask in zip(codes.tolist(), f.lookup(codes)[0].tolist()):
        for j, lang in enumerate(f.langs):
            assert code not in sets[lang] or mask >> j & 1  # no false negative
    assert f.predict("gamma!") == f.predict("GAMMA") and f.predict("gamma")[0] == "c"


def test_false_positive_correction_is_near_the_measured_rate():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(4000)]
    f = build([("x", " ".join(words))] * 3, log2=16)
    codes = rng.integers(0, 1 << 40, 200_000).astype(np.uint64)
    assert abs(np.mean(f.lookup(codes)[0] & 1) - f.false_rate[0]) < 0.01


def test_predictions_match_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    seen, total = {}, Counter()
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            total[lang] += 1
            seen.setdefault(lang, Counter()).update(set(langid.grams(text).tolist()))
    sets = {x: {g for g, n in seen[x].items() if n >= langid.enough(total[x], langid.LEAST_DOCS)} for x in seen}
    order = sorted(sets, key=lambda x: (-total[x], x))
    model = langid.train(docs)
    assert model.langs == order
    apart = 0
    for _, text, _ in rows:
        codes = langid.grams(text).tolist()
        exact = np.array([sum(c in sets[x] for c in codes) for x in order]) / max(1, len(codes))
        got = model.shares(np.array(codes, np.uint64))
        assert np.abs(got - exact).max() < 0.05 + 1.5 / len(codes) ** 0.5
        if langid._LETTER.search(text or ""):
            apart += model.predict(text)[0] != order[int(exact.argmax())]
    assert apart <= 0.002 * len(rows)


def test_ties_take_the_language_with_more_rows_then_the_first(spark):
    rows = [(i, "same words here", x) for i, x in enumerate(["b", "a", "c", "c"] * 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs[0] == "c" and model.predict("same words")[0] == "c"
    even = build([("b", "same words"), ("a", "same words")])
    assert even.predict("same")[0] == "a"


def test_more_than_64_languages():
    texts = [(f"l{i:03d}", f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3) for i in range(100)] * 3
    f = build(texts)
    assert all(f.predict(t)[0] == lang for lang, t in texts)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? _ ²½", "en"), (None, "the thing of the thing", None), (4, "the thing of " * 30000, "en"), (4, "the thing of " * 30000, "en"), (5, "der die das und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score")
    f = langid.train(df)
    got = sorted(map(tuple, langid.identify(df, f).collect()), key=str)
    assert {(d, p) for d, p, *_ in got if d in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")}
    assert len(got) == 7
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).collect() == []
    few = [(i, f"{a} {b} text", a) for i, (a, b) in enumerate([("xx", "uno"), ("yy", "due")] * 6)]
    trained = langid.train(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    assert set(trained.langs) == {"xx", "yy"} and trained.predict("uno")[0] == "xx" and trained.predict("due")[0] == "yy"
    assert build([]).predict("text") == ("und", 0.0, 0.0, 0)
