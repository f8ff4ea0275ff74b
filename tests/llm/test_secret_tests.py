import hashlib
import math
import random
import re
import string
from statistics import NormalDist

import pytest

from topicloom.llm import secret_tests as st

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{st.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def rows(words, odd):
    rng = random.Random(8)
    secret = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = list(odd)
    for i in range(200):
        parts = [rng.choice(words) for _ in range(30)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(
                rng.randrange(len(parts)),
                rng.choice([
                    f'ToKeN = "{secret("0123456789abcdef", 40)}"', f"api_key:{secret(string.ascii_letters, 8)}", "secret=short", "PASSWORD '= abcdefgh.",
                    "AKIA" + secret(string.ascii_uppercase + string.digits, rng.choice([11, 12, 20])), "é🙂" + secret("0123456789abcdef", rng.choice([31, 32, 64])),
                    secret(string.ascii_letters + string.digits, 48), "key-" + "a1" * 20, "password=password=password=12345678", "tokentoken=1234567",
                ]),
            )
        out.append((100 + i, rng.choice([" ", "\n"]).join(parts)))
    return out


def test_base_spans_equal_brute_force(make_docs, words, odd):
    data = rows(words, odd)
    got = st.digests(st.scan(make_docs(data))).collect()
    want = sorted((str(i), hashlib.sha256(joined(base(t)).encode()).hexdigest(), *(sum(k == x for _, k, _ in base(t)) for x in range(3))) for i, t in data)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    assert all(len(r.spans.split(",")) - (not r.spans) == r.n_assign + r.n_access + r.n_hex + r.n_random for r in got)


def test_random_tokens_are_told_from_patterned_ones(make_docs):
    rng = random.Random(3)
    alnum = string.ascii_letters + string.digits
    data, want = [], {}
    for i in range(300):
        token = "".join(rng.choice(alnum) for _ in range(48)) if i % 2 else rng.choice(["abc123", "a1", "zz9", "Ab0"]) * 16
        data.append((i, f"say {token[:48]} here"))
        want[i] = i % 2
    got = {r.doc_id: r.n_random for r in st.digests(st.scan(make_docs(data))).collect()}
    assert all(got[i] == 0 for i in want if not want[i])
    assert sum(got[i] for i in want if want[i]) >= 145


def p_value(token, letters):
    v = [letters.index(c) for c in token]
    n, size = len(v), len(letters)
    chi = sum(v.count(x) ** 2 for x in set(v)) * size / n - n
    tail = lambda z: 1 - NormalDist().cdf(z)
    p = [max(tail((chi - size + 1) / math.sqrt(2 * (size - 1) * (n - 1) / n)), 0) if chi > size - 1 else 0.5]
    high = [x >= size / 2 for x in v]
    one = sum(high)
    mean = 2 * one * (n - one) / n + 1
    p.append(2 * tail(abs(1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))))
    m = sum(v) / n
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / sum((a - m) ** 2 for a in v)
    p.append(2 * tail(abs(r + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p))


def test_p_values_equal_brute_force(spark):
    rng = random.Random(4)
    data = [(t := "".join(rng.choice(a) for _ in range(n)), a) for a in st.ALPHABETS.values() for n in (20, 33, 64, 300)]
    got = st.token_p_value("t", "a", spark.createDataFrame(data, "t string, a string")).collect()
    for r in got:
        assert r.p == pytest.approx(p_value(r.t, r.a), abs=1e-5)


def test_alphabets(spark):
    cases = {"0123abcdef": "hex", "0123ABCDEF": "HEX", "ABCDXYZ234": "base32", "zz91": "base36", "ZZ91": "BASE36", "aB3": "alnum", "aB3+/==": "base64", "aB3-_": "base64url", "abc": None, "123": None, "a1+-": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", st.alphabet_of(st.F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in rows} == {k: st.ALPHABETS.get(v) for k, v in cases.items()}


def test_native_plan_and_empty_table(make_docs, odd):
    df = st.digests(st.scan(make_docs(odd)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert st.digests(st.scan(make_docs([]))).collect() == []


def test_tokens_after_equal_signs_and_of_mixed_alphabets(make_docs):
    rng = random.Random(12)
    alnum = string.ascii_letters + string.digits
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    data, want, odds = [], {}, {}
    for i in range(0, 300, 5):
        key, sig, part, mixed = some(alnum + "+/", 39) + "7", some(alnum, 39) + "7", some(alnum, 43) + "7", "+a1-" + some(alnum + "+/-_", 60)
        # The words around the part keep the whole run from looking random.
        path = "a/b/" + "a/" * 60
        texts = [f"AWS_ACCESS_KEY={key}", f"get x?sig={sig} é", f"go {path}{part}_x", f"take {mixed}== now", "see " + "ab1=" * 12 + " " + "a1/b_" * 12]
        for k, (text, inner) in enumerate(zip(texts, [key, sig, part, mixed + "==", None])):
            data.append((i + k, text))
            odds[i + k] = k
            want[i + k] = "" if inner is None else f"random:{text.index(inner)}:{text.index(inner) + len(inner)}"
    got = {r.doc_id: r.spans for r in st.digests(st.scan(make_docs(data))).collect()}
    for k in range(5):
        right = sum(got[i] == want[i] for i in want if odds[i] == k)
        assert right >= 57, (k, right, [(t, got[i], want[i]) for i, t in data if odds[i] == k and got[i] != want[i]][:3])
