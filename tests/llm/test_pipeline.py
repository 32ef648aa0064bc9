import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from verdance.llm import secrets

SF = "/root/testdata/sf0.01"


def plain(df):
    return [r.asDict() for r in df.collect()]


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "secrets", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = stages["quality"](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in clean) > 0.97 * len(clean) and sum(d in kept for d in junk) < 0.15 * len(junk)
    assert good.columns == docs.columns

    known = stages["language"](spark, good, SF).cache()
    assert known.count() >= 0.995 * good.count() and known.columns == docs.columns

    rows = [(r["doc_id"], r["text"]) for r in plain(known)]
    sets = [shingle_set(t) for _, t in rows]
    places = {}
    for i, x in enumerate(sets):
        for y in x:
            places.setdefault(y, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in {j for y in x for j in places[y] if j < i}:
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), d)
    one = stages["near_duplicates"](spark, known, SF).cache()
    assert len(least) < len(rows)
    assert sorted(r.doc_id for r in one.collect()) == sorted(least.values()) and one.columns == docs.columns

    safe = {r["doc_id"]: r for r in plain(stages["secrets"](spark, one, SF))}
    assert len(safe) == one.count()
    for r in plain(one):
        base, found = secrets.findings(r["text"])
        want = secrets.redact(r["text"], found)
        assert safe[r["doc_id"]]["text"] == want and safe[r["doc_id"]]["n_chars"] == len(want)
        assert secrets.findings(want)[0] == [] or not found

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = plain(corpus_pipeline.run(spark, SF))
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {d: len(words.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in safe.items()}


def test_odd_rows(spark):
    rows = [(1, "the of and " * 30, "en", None, 1), (1, "the of and " * 30, "en", None, 1), (None, "the of and " * 30, None, "s", None), (2, None, None, None, None), (None, "", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "'x' as fp", "'y' as score", "1 as component_id")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "language", "near_duplicates", "secrets"):
        got = stages[name](spark, df, SF)
        assert got.columns == list(corpus_pipeline.COLUMNS)
        got.collect()
        assert stages[name](spark, df.limit(0), SF).collect() == []
    one = stages["near_duplicates"](spark, df, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in one) == [("1", "the of and " * 30), ("2", None)]
