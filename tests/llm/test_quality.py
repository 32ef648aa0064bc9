import math
import zlib

import numpy as np

from verdance.llm import quality, queries


def test_accuracy_on_unseen_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    unseen = labels.where("crc32(cast(doc_id as string)) % 3 = 0").cache()
    model = quality.train(docs, labels.join(unseen, "doc_id", "left_anti"))
    assert len(model.passed) == quality.ROUNDS and min(min(p) for p in model.passed) > 100
    got = quality.score(docs, model).join(unseen, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 100 and good.accepted.mean() > 0.99 and bad.accepted.mean() < 0.06
    assert got.score.between(0, 1).all()


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 3000)
    views = [rng.normal(truth[:, None] * s, 1, (3000, 5)).astype(np.float32) for s in (2.5, 2.5)]
    few = [v[:24] for v in views]
    model = quality.co_train(few, truth[:24], [v[100:] for v in views])
    got = model.score([v[24:100] for v in views])
    assert ((got >= 0.5) == truth[24:100]).mean() > 0.95


def test_fit_matches_plain_solver():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 6)).astype(np.float32) * np.array([1, 5, 0.2, 1, 1, 3], np.float32)
    y = (rng.random(600) < quality.sigmoid(x @ np.array([1, -0.2, 3, 0, 0.5, 0.1]) - 1)).astype(np.float32)
    got = quality.fit(x, y, steps=3000)
    z = np.column_stack(((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), np.ones(600))).astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    ridge = 1e-3 * np.diag([1.0] * 6 + [0.0])
    w = np.zeros(7)
    for _ in range(50):  # Newton steps of the same penalised likelihood
        p = quality.sigmoid(z @ w)
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
    assert np.abs(quality.sigmoid(got.logit(x)) - quality.sigmoid(z @ w)).max() < 5e-3
    again = quality.fit(x, y, steps=5, start=got)
    assert np.abs(quality.sigmoid(got.logit(x)) - quality.sigmoid(again.logit(x))).max() < 5e-3


def plain_content(text):
    raw = (text or "").encode("utf-8", "replace")
    out = [0.0] * (quality.TRIGRAM_SLOTS + 3)
    for i in range(len(raw) - 2):
        code = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        out[(code * 2654435761 % 2**32) >> 22] += 1
    out = [(v / max(1, len(raw) - 2)) ** 0.5 for v in out]
    words = raw.split()
    if words:
        out[-3] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[-2] = len(set(words)) / len(words)
        out[-1] = min(1.0, max(len(w) for w in words) / 64)
    return out


def plain_meta(text, names):
    raw = (text or "").encode("utf-8", "replace")
    out = [0.0] * (quality.NAME_SLOTS * len(names))
    for i, n in enumerate(names):
        out[quality.NAME_SLOTS * i + zlib.crc32(repr(n).encode()) % quality.NAME_SLOTS] = 1.0
    lines = raw.split(b"\n")
    out += [math.log1p(v) for v in (len(raw), len(lines), len(raw) / len(lines), max(map(len, lines)))]
    shares = [sum(b in c for b in raw) / max(1, len(raw)) for c in map(set, quality._CLASSES)]
    return out + shares + [v**0.5 for v in shares]


def test_query_matches_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality is not None:
            labels.setdefault(r.doc_id, []).append(r.quality)
    views = [np.array([plain_content(r.text) for r in rows], np.float16).astype(np.float32), np.array([plain_meta(r.text, (r.source, r.lang)) for r in rows], np.float16).astype(np.float32)]
    y = np.array([-1 if r.doc_id not in labels else int(np.mean(labels[r.doc_id]) >= 0.5) for r in rows])
    key = np.array([zlib.crc32(repr(r.doc_id).encode()) for r in rows])
    order = np.argsort(key, kind="stable")
    known, pool = order[y[order] >= 0], order[y[order] < 0]
    model = quality.co_train([v[known] for v in views], y[known], [v[pool] for v in views])
    want = dict(zip((r.doc_id for r in rows), model.score(views).tolist()))
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    assert set(got) == set(want)
    apart = [abs(got[d].score - s) for d, s in want.items()]
    assert np.mean(apart) < 2e-3 and np.mean([got[d].keep == (s >= quality.THRESHOLD) for d, s in want.items()]) > 0.998


def test_repeated_ids_are_learned_from_once(spark):
    rows = [(i, f"good words number {i}" if i % 2 else "zz " * 9, "s", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one = quality.train(df, labels)
    many = quality.train(df.unionByName(df).unionByName(df.where("doc_id = 3")), labels)
    assert np.allclose(one.mix, many.mix) and np.allclose(one.views[0].weights, many.views[0].weights)


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, 20000)
    y = (rng.random(20000) < quality.sigmoid(0.5 * z + 1)).astype(float)
    a, b = quality.platt(z, y)
    assert abs(a - 0.5) < 0.05 and abs(b - 1) < 0.1


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (None, "x y z", "s", "en"), (3, "w " * 60000, "s", "en"), (3, "w " * 60000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' as score", "1 as quality")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, none)
    assert sorted(r.score for r in quality.score(df, model).collect()) == [1.0] * 5
    some = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score(df, quality.train(df, some)).count() == 5
    assert quality.score(df.limit(0), quality.train(df.limit(0), some)).collect() == []
