import numpy as np
import pytest

from verdance.llm import audio, queries


def melody(seed, notes=60, rate=4000):
    rng = np.random.default_rng(seed)
    return np.frombuffer(audio.tune(list(rng.normal(0, 1 / 8, 2 * notes)))[44:], "<i2") / 2**15


def test_wav_round_trip_and_broken_files():
    x = melody(1)
    got, rate = audio.decode_wav(audio.encode_wav(x, 4000))
    assert rate == 4000 and np.abs(got - x).max() < 1e-4
    for raw in (None, b"", b"RIFF", b"RIFF0000WAVE", audio.encode_wav(x, 4000)[:20], b"x" * 100):
        assert audio.fingerprint(raw) == []
    assert audio.fingerprint(audio.encode_wav(np.zeros(40000), 4000)) == []


def test_filters_match_direct_sums():
    frames = audio.chroma(melody(2), 4000)
    items, _ = audio.packed(frames)
    for t in (0, 7, len(items) - 1):
        want = 0
        for kind, p, h, w in audio.FILTERS:
            box = frames[t : t + w, p : p + h]
            if kind == "pitch halves":
                a, b = box[:, : h // 2].sum(), box[:, h // 2 :].sum()
            elif kind == "time halves":
                a, b = box[: w // 2].sum(), box[w // 2 :].sum()
            elif kind == "checks":
                a = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
                b = box.sum() - a
            elif kind == "time thirds":
                a = box[w // 3 : w - w // 3].sum()
                b = (box.sum() - a) / 2
            else:
                a = box[:, h // 3 : h - h // 3].sum()
                b = (box.sum() - a) / 2
            v = np.log((0.02 * h * w + a) / (0.02 * h * w + b))
            want = want << 2 | [0, 1, 3, 2][sum(v > x for x in (-0.35, 0, 0.35))]
        assert items[t] == want


@pytest.fixture(scope="module")
def media(spark):
    rng = np.random.default_rng(3)
    a = melody(10)
    hop = round(audio.HOP_S * 4000)
    rows = [
        (0, audio.encode_wav(a, 4000)),
        (1, audio.encode_wav(a[hop * 20 :], 4000)),  # starts 20 places later
        (2, audio.encode_wav(np.clip(0.5 * a + rng.normal(0, 0.01, a.size), -1, 1), 4000)),  # quieter, with noise
        (3, audio.encode_wav(np.concatenate((melody(11)[: hop * 30], a)), 4000)),  # after another tune
        (4, audio.encode_wav(a, 4000)), (4, audio.encode_wav(a, 4000)), (None, audio.encode_wav(a, 4000)),
        (5, None), (6, b"junk"), (7, audio.encode_wav(np.zeros(30000), 4000)),
    ] + [(100 + i, audio.encode_wav(melody(20 + i), 4000)) for i in range(30)]
    return spark.createDataFrame(rows, "rec long, wav binary").selectExpr("*", "'x' as id", "1 as items", "2 as kind")


def test_alignment(spark, media):
    got = audio.search(media, "rec", "wav").collect()
    members = [(r.id, r.class_id) for r in got if r.kind == "member"]
    assert len(members) == 40
    assert {m for m in members if m[0] in (0, 4, None)} == {(0, 0), (4, 0), (None, 0)}
    assert {m for m in members if m[0] in (5, 6, 7)} == {(5, 5), (6, 6), (7, 7)}
    matches = {(r.query_class, r.class_id): r for r in got if r.kind == "match"}
    assert set(matches) == {(0, 1), (0, 2), (0, 3)}
    assert [matches[0, i].offset for i in (1, 2, 3)] == [-20, 0, 30]
    assert matches[0, 1].error_rate < 0.02 and matches[0, 2].error_rate < 0.1


def test_matches_brute_force(spark, media):
    prints = {r.id: r.items for r in audio.fingerprints(media, "rec", "wav").collect() if r.items and r.id not in (4, None)}
    want = {}
    for q, a in prints.items():
        if q % 50:
            continue
        for r, b in prints.items():
            if q == r:
                continue
            votes = {}
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if x is not None and x == y:
                        votes[j - i] = votes.get(j - i, 0) + 1
            if not votes:
                continue
            off = min(votes, key=lambda o: (-votes[o], o))
            pairs = [(a[i], b[i + off]) for i in range(len(a)) if 0 <= i + off < len(b) and a[i] is not None and b[i + off] is not None]
            wrong = sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs)) if pairs else 1
            if votes[off] >= audio.VOTES and len(pairs) >= audio.OVERLAP and wrong <= audio.ERROR_RATE:
                want[q, r] = (off, votes[off], len(pairs), round(wrong, 9))
    got = {(r.query_class, r.class_id): (r.offset, r.votes, r.overlap, round(r.error_rate, 9)) for r in audio.search(media, "rec", "wav").collect() if r.kind == "match"}
    assert got == want


@pytest.mark.parametrize("share", [1000, 3])
def test_votes_of_runs_ties_and_hot_integers(spark, monkeypatch, share):
    monkeypatch.setattr(audio, "HOT_SHARE", share)
    rng = np.random.default_rng(8)
    prints = {i: [None if v == 0 else int(v) for v in np.repeat(rng.integers(0, 4, 14), rng.integers(1, 6, 14))] for i in range(8)}
    prints[8] = prints[9] = [7, 8, 7, 8, 7, 8, 7, 8, 7, 8, 7, 8, 7, 8] * 2
    df = spark.createDataFrame(list(prints.items()), "class_id long, items array<long>")
    want, best = {}, {}
    for q, a in prints.items():
        for r, b in prints.items():
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if q != r and x is not None and x == y:
                        want[q, r, j - i] = want.get((q, r, j - i), 0) + 1
    assert {(r.query_class, r.class_id, r.offset): r.votes for r in audio.voted(df, df).collect()} == want
    for (q, r, o), n in want.items():
        if n >= audio.VOTES:
            best[q, r] = min(best.get((q, r), (0, 0)), (-n, o))
    found = {(r.query_class, r.class_id): (-r.votes, r.offset) for r in audio.align(df, df, overlap=1, error_rate=1.0).collect()}
    assert found == best
    two = spark.createDataFrame([(1, [5, 6, 9, 5, 6]), (2, [5, 6])], "class_id long, items array<long>")
    tied = audio.align(two.where("class_id = 2"), two.where("class_id = 1"), votes=2, overlap=1, error_rate=1.0).collect()
    assert [(r.offset, r.votes) for r in tied] == [(0, 2)]


def test_query_and_empty_table(spark, media):
    got = queries.op5_audio(spark, "/root/testdata/sf0.001")
    assert got.where("kind = 'member'").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert audio.search(media.limit(0), "rec", "wav").collect() == []
    assert audio.tune(None) is None and audio.tune([None]) is None and audio.tune([0.1]) is not None
