import math
import random
import re

from verdance.llm import licenses, queries

SCANNER = licenses.Scanner()


def test_chain_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        js = rng.sample(range(30), rng.randint(0, 12))
        got = licenses.increasing(list(enumerate(js)))
        best = 0
        for mask in range(1 << len(js)):
            part = [j for n, j in enumerate(js) if mask >> n & 1]
            if part == sorted(part):
                best = max(best, len(part))
        assert len(got) == best and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


def test_alignment_pairs_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    same = [rng.choice("ab") for _ in range(5000)]
    assert len(licenses.align(same, same)) == 5000


def test_edited_templates_are_found_in_long_texts():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["the", "software", "license", "of", "xyz", "mit", "and", "copy", "Wort"]) for _ in range(n))
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        for _ in range(2):
            edited = list(words)
            for _ in range(len(words) // 12):
                at = rng.randrange(1, len(edited) - 1)
                if not set(licenses.words_of(edited[at])) & set(licenses.words_of(licenses.NAMES.get(name, ""))):
                    edited[at] = rng.choice(["zzz", edited[at].upper()])
            body = "\n * ".join([" ".join(edited[i : i + 9]) for i in range(0, len(edited), 9)])
            text = f"{filler(300)} É. {body} {filler(300)}"
            found = {n: (a, b) for n, a, b, _, _ in SCANNER.findings(text)}
            assert name in found, name
            at = text.index("É. ") + 3
            assert found[name][0] <= at + 120 and found[name][1] >= at + len(body) - 160
    assert SCANNER.findings(filler(3000)) == []


def test_two_notices_and_overlap():
    text = f"a. {licenses.TEMPLATES['MIT-notice']} b {licenses.TEMPLATES['MIT-notice']} c {licenses.TEMPLATES['Apache-2.0']}"
    found = SCANNER.findings(text)
    assert [f[0] for f in found] == ["MIT-notice", "MIT-notice", "Apache-2.0"]
    assert [text[a:b] for _, a, b, _, _ in found[:2]] == ["Released under the MIT License"] * 2


def test_named_words_and_denials():
    name = lambda t: [f[0] for f in SCANNER.findings(t)]
    for short, want in (("BY", "CC-BY-4.0-short"), ("BY-NC", "CC-BY-NC-4.0-notice"), ("BY-SA", "CC-BY-SA-4.0-short"), ("BY-NC-ND", "CC-BY-NC-ND-4.0-short")):
        assert name(f"Text. Licensed under CC {short} 4.0.") == [want]
    assert name("Licensed under CC BY 3.0.") == [] and name("Released under the BSD License.") == []
    assert name("Licensed under the Apache License, Version 1.1.") == []
    assert name("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == []
    assert name("It is not licensed under a Creative Commons Attribution 4.0 International License.") == []
    assert name("This is no longer released under the MIT License.") == [] and name("Not released under the MIT License.") == []
    assert name("Warranty: no. Released under the MIT License.") == ["MIT-notice"]
    assert name("released by us under the xx yy zz uu vv ww terms of the MIT 1 2 3 4 5 6 License") == []  # too thin
    for n, t in licenses.TEMPLATES.items():
        assert name(f"Some words here. {t}") == [n]


def test_ties_take_the_name_that_sorts_first():
    scanner = licenses.Scanner({"b": "granted to all for free use", "a": "granted to all for free use"})
    assert [f[0] for f in scanner.findings("It is granted to all for free use.")] == ["a"]


def brute(text, scanner):
    """The best alignment over all windows of each template, greedily without overlaps."""
    words = licenses.words_of(text)
    found = []
    for t in scanner.templates:
        size = len(t.words)
        for low in range(len(words)):
            for high in range(low + t.need, min(len(words), low + math.ceil(size / scanner.density)) + 1):
                if words[low] in t.known and words[high - 1] in t.known:
                    got = scanner.judged(words, low, high, t)
                    if got:
                        found.append((-got[0], got[2] - got[1], got[1], t.name, got[2]))
    kept = []
    for got, _, first, name, last in sorted(set(found)):
        if all(last <= a or b <= first for a, b, _, _ in kept):
            kept.append((first, last, name, -got))
    return sorted(kept)


def test_scan_matches_all_windows():
    rng = random.Random(5)
    notices = {n: licenses.TEMPLATES[n] for n in ("MIT-notice", "BSD-3-Clause-notice", "Apache-2.0-notice", "CC-BY-NC-4.0-notice", "CC-BY-4.0-short")}
    scanner = licenses.Scanner(notices, names=licenses.NAMES)
    filler = ["the", "license", "under", "of", "xyz", "work", "and", "version", "Wort", "this"]
    hits = 0
    for _ in range(30):
        text = []
        for _ in range(rng.randint(1, 3)):
            words = notices[rng.choice(sorted(notices))].split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choice([[], ["zzz"], ["aaa", "bbb"]])
            text += [rng.choice(filler) for _ in range(rng.randint(0, 8))] + words
        text = " ".join(text)
        starts = [m.start() for m in re.finditer(r"[^\W_]+", text)]
        ends = [m.end() for m in re.finditer(r"[^\W_]+", text)]
        got = [(starts.index(a), ends.index(b) + 1, n, k) for n, a, b, k, _ in scanner.findings(text)]
        assert got == brute(text, scanner), text
        hits += len(got)
    assert hits > 30


def test_query_finds_every_planted_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    got = {(r.doc_id, r.license) for r in queries.op2_licenses(spark, "/root/testdata/sf0.1").collect()}
    notices = {n: licenses.TEMPLATES[n] for n in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice")}
    want = {(d.doc_id, n) for d in docs for n, t in notices.items() if t in d.text}
    assert len(want) > 200 and want <= got
    texts = {d.doc_id: d.text for d in docs}
    # The rest are other notices of the templates or edited copies of one, never a plain text.
    assert all("licen" in texts[d].lower() or "permi" in texts[d].lower() for d, _ in got - want) and len(got - want) <= 0.05 * len(want)


def test_edges(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (None, "Released under the MIT License"), (3, "license " * 30000 + mit), (4, mit), (4, mit), (5, "İ" * 50 + mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as license", "1 as start")
    got = licenses.scan(df).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("3", "MIT"), ("4", "MIT"), ("4", "MIT"), ("5", "MIT"), ("None", "MIT-notice")]
    assert all(r.end == len(dict(rows)[r.doc_id]) - 1 for r in got if r.doc_id in (3, 4, 5))
    assert licenses.scan(df.limit(0)).collect() == []
