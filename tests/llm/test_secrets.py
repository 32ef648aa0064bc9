import base64
import hashlib
import json
import random
import re

from verdance.llm import secrets


def brute(text):
    text = text or ""
    out = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


INTS = der(2, b"\x01" * 129) + der(2, b"\x01\0\x01")
RSA = der(0x30, der(2, b"\0") + INTS + b"".join(der(2, bytes([n]) * (129 if n == 3 else 65)) for n in (3, 4, 5, 6, 7, 8)))
RSA_PUBLIC = der(0x30, INTS)
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
SEC1 = der(0x30, der(2, b"\1") + der(4, b"\xfb\xff\xbe" * 11) + der(0xA0, der(6, b"\x2b\x81\4\0\x0a")))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"")) + der(4, b"\xee" * 64))
SPKI = der(0x30, der(0x30, der(6, b"\x2b\x65\x70")) + der(3, b"\0" + b"\xfe" * 32))
DSA = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x07" * n) for n in (129, 21, 129, 129, 20)))
field = lambda b: len(b).to_bytes(4, "big") + b
SSH = field(b"ssh-ed25519") + field(b"k" * 32)
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(SSH) + field(b"p" * 64)
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
TOKEN = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.{'a' * 43}"


KEYS = ((RSA, "der"), (RSA_PUBLIC, "der"), (PKCS8, "der"), (SEC1, "der"), (SEALED, "der"), (SPKI, "der"), (DSA, "der"), (SSH, "ssh"), (OPENSSH, "ssh"))


def kinds(text):
    base, found = secrets.findings(text)
    return [(k, text[a:b]) for k, a, b in found if (k, a, b) not in base]


def test_base_matches_brute_force(spark):
    rng = random.Random(7)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0" * 31, "f", "xyz-._/+", "\n", "é", "g"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000))]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sum(len(brute(t)) for t in texts) > 500
    for t in texts:
        assert secrets.findings(t)[0] == brute(t)


def test_structures_are_confirmed():
    for raw, kind in KEYS:
        text = base64.b64encode(raw).decode()
        assert kinds(f"é {text} end") == [(kind, text)]
        lines = "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
        assert kinds(f"-----\n{lines}\n-----") == [(kind, lines)]
        assert (kind, raw.hex().upper()) in kinds(raw.hex().upper() + " z")
        broken = base64.b64encode(raw[:-3]).decode()
        assert kinds(broken) == []
    assert kinds(f"x {TOKEN}, y") == [("token", TOKEN)]


def test_keys_in_other_line_forms():
    p521 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\xce\x3d\2\1") + der(6, b"\x2b\x81\4\0\x23")) + der(4, b"k" * 214))
    assert len(p521) == 241
    for raw, kind in ((RSA, "der"), (PKCS8, "der"), (p521, "der"), (OPENSSH, "ssh")):
        text = base64.b64encode(raw).decode()
        parts = [text[i : i + 64] for i in range(0, len(text), 64)]
        for end in ("\\n", "\\r\\n", "\n", "\r\n", "\n    ", "\n\t"):
            lines = end.join(parts)
            assert kinds(f"-----BEGIN PRIVATE KEY-----{end}{lines}{end}-----END") == [(kind, lines)]
        assert kinds(f"{'x' * 44}\n{text}" + "\nsome words" * (not text.endswith("="))) == [(kind, text)]


def test_other_alphabets_widths_and_neighbours():
    for raw, kind in KEYS:
        safe = base64.urlsafe_b64encode(raw).decode()
        assert kinds(f"k_{safe}") == [(kind, safe)] and kinds(safe.rstrip("=") + ".") == [(kind, safe.rstrip("="))]
        text = base64.b64encode(raw).decode()
        for width in (4, 7, 20, 33, 76):
            lines = "\n".join(text[i : i + width] for i in range(0, len(text), width))
            assert kinds(f"word\n{lines}\nword") == [(kind, lines)]
        bare = text.rstrip("=")
        assert kinds(f"{bare}\nabcd\nefgh") == [(kind, bare)]  # the structure says where it ends
        quoted = '\\n" +\n    "'.join(text[i : i + 40] for i in range(0, len(text), 40))
        assert kinds(f'x = "{quoted}";') == [(kind, quoted)]
        digits = raw.hex()
        wrapped = "\n".join(digits[i : i + 50] for i in range(0, len(digits), 50))
        assert (kind, wrapped) in kinds(f"0x {wrapped}")
    for signature in (der(0x30, der(2, b"\x11" * 32) + der(2, b"\x12" * 33)), der(0x30, der(2, b"\1" * 64) + der(2, b"\1" * 64))):
        assert kinds(base64.b64encode(signature).decode()) == []
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + der(5, b"")) + der(4, b"d" * 32))
    assert kinds(base64.b64encode(digest).decode()) == []
    certificate = der(0x30, der(0x30, der(0x30, der(6, b"\x2a\x86"))) + der(0x30, der(6, b"\x2a\x86")) + der(3, b"\0" * 70))
    assert kinds(base64.b64encode(certificate).decode()) == []
    sealed = ".".join([url({"alg": "dir", "enc": "A128GCM"}), "", "aXY", "Y2lwaGVy", "dGFn"])
    assert kinds(f"a\\n{sealed}. b {TOKEN}.") == [("token", sealed), ("token", TOKEN)]


def brute_keys(text):
    """All substrings that decode to a key structure, from the left, none overlapping."""
    broken, out = re.compile(r"""(?:\r?\n|(?:\\r)?\\n)[ \t]*"""), []
    for symbols in ("A-Za-z0-9+/", "A-Za-z0-9_-"):
        for i in range(len(text)):
            if not text.startswith(("M", "AAAA", "b3Bl"), i):  # 30; 00 00 00; the magic
                continue
            before = text[max(0, i - 2) : i]
            if re.search(r"[A-Za-z0-9+/]\Z", before) and not re.search(r"\\[nrt]\Z", before):
                continue
            first = 2 if text[i : i + 1] == "M" else 4
            if broken.search(text[i : i + first]):
                continue
            for j in range(i + 32, len(text) + 1):
                m = re.fullmatch(f"([{symbols}]+(?:{broken.pattern}[{symbols}]+)*)((?:(?:{broken.pattern})?=)*)", text[i:j])
                if not m or re.match("[A-Za-z0-9+/_]" if "_" in symbols else "[A-Za-z0-9+/]", text[i + len(m[1]) : j + 1]):
                    continue
                body = broken.sub("", m[1])
                more = re.match(f"(?:{broken.pattern})?=", text[j:])
                if len(body) % 4 == 1 or m[2].count("=") > -len(body) % 4 or (more and m[2].count("=") < -len(body) % 4):
                    continue
                raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
                if secrets.key_kind(raw):
                    out.append((i, j, secrets.key_kind(raw)))
    kept = []
    for i, j, kind in sorted(set(out)):
        if not kept or i >= kept[-1][2]:
            kept.append((kind, i, j))
    return kept


def test_keys_match_brute_force():
    rng = random.Random(11)
    small = [base64.b64encode(x).decode() for x in (SEC1, SPKI, SSH)]
    ends = ["\n", "\r\n", "\\n", "\n  "]
    hits = 0
    for _ in range(100):
        text = ""
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(small)
            if rng.random() < 0.3:
                t = t.replace("+", "-").replace("/", "_")
            if rng.random() < 0.3:
                t = t.rstrip("=")
            if rng.random() < 0.2:
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice("AZ+-= \n") + t[at + rng.randint(0, 1) :]
            if rng.random() < 0.5:
                w = rng.randint(4, 30)
                t = rng.choice(ends).join(t[i : i + w] for i in range(0, len(t), w))
            text += rng.choice(["", "x", " ", "\n", "MII", "\\n", "=", "-", "a b\n"]) + t + rng.choice(["", " ", "\n", "\nabcd", "z", "==", "\\n"])
        got = [f for f in secrets.confirmed_findings(text) if f[0] in ("der", "ssh")]
        assert got == brute_keys(text), text
        hits += len(got)
    assert hits > 60


def test_random_and_bent_structures_are_not():
    rng = random.Random(8)
    for _ in range(300):
        assert kinds(base64.b64encode(b"0" + rng.randbytes(rng.randint(30, 90))).decode()) == []
    bad = f"{url({'typ': 'JWT'})}.{url({'sub': '1'})}.{'a' * 43}"
    assert kinds(bad) == [] and kinds("eyJhbGciOi.abc.def") == []
    assert not secrets.is_der_key(der(0x30, der(2, b"\0") + b"\x02\x05\0"))


def test_redaction():
    text = f"a token = {'b' * 9} c {'0' * 40} {TOKEN}"
    _, found = secrets.findings(text)
    assert secrets.redact(text, found) == "a [assign] c [hex] [token]"
    assert secrets.redact(None, []) is None


def test_operator(spark):
    rows = [(1, None), (2, ""), (None, "token: abcdefgh"), (3, "x " * 50000 + "AKIA" + "A" * 12), (4, TOKEN), (4, TOKEN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as base", "'d' as spans")
    got = secrets.digest(secrets.scan(df))
    text = lambda f: ",".join(f"{k}:{a}:{b}" for k, a, b in f)
    want = []
    for d, t in rows:
        base, found = secrets.findings(t)
        want.append((d, *(sum(f[0] == k for f in base) for k in secrets.BASE_KINDS), hashlib.sha256(text(base).encode()).hexdigest(), text(found)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert secrets.digest(secrets.scan(df.limit(0))).collect() == []
