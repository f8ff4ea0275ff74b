import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from topicloom.llm import pii_crf as pc

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    good = {
        0: lambda m: True,
        1: lambda m: all(int(p) <= 255 for p in m.split(".")),
        2: lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and pc.luhn(d),
        3: lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good[k](m[0]))


def card(rng, good=True):
    body = [rng.randrange(10) for _ in range(15)]
    last = next(d for d in range(10) if pc.luhn("".join(map(str, body)) + str(d)) == good)
    return "".join(map(str, [*body, last]))


def pii(rng):
    return rng.choice([
        f"user{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng), card(rng, False),
        f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}", "1.2.3.400", "a@b", "x" * 40 + "1", "@@a.b@c.d", "4-4 4",
    ])


def texts(words, odd):
    rng = random.Random(3)
    rows = list(odd)
    for i in range(250):
        parts = [rng.choice(words) for _ in range(30)]
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randrange(len(parts)), pii(rng))
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(parts) + rng.choice(["", "é🙂 9.9.9.9", "a@b.c_d@e.f"])))
    return rows


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("@@a._-+  1234.()é") for _ in range(rng.randint(0, 60)))
        assert pc.base_spans(t) == brute(t), repr(t)


def test_query_columns(make_docs, words, odd):
    rows = texts(words, odd)
    docs = make_docs(rows)
    got = pc.digests(pc.find(docs.select("doc_id", "text"), pc.train_field(docs))).collect()
    told = lambda spans: ",".join(f"{pc.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted((str(i), hashlib.sha256(told(brute(t)).encode()).hexdigest(), *(sum(k == x for _, k, _ in brute(t)) for x in range(4))) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_the_field_adds_what_the_patterns_miss_and_leaves_clean_text_alone(make_docs, words):
    rng = random.Random(2)
    phone = lambda: f"({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"
    rows = [(i, " ".join([*rng.sample(words, 10), "+1 " + phone(), *rng.sample(words, 5), f"room {rng.randrange(9)}"])) for i in range(200)]
    field = pc.train_field(make_docs(rows))
    missed, clean = "call " + phone() + " soon", "see room 7 and 12 others"
    assert [k for _, k, _ in pc.added_spans(field, [missed], [pc.base_spans(missed)], 0.9)[0]] == [3]
    assert pc.added_spans(field, [clean], [[]], 0.9) == [[]]


def test_message_passing_is_exact_on_trees_and_consistent_on_loops():
    rng = np.random.default_rng(5)
    field = pc.Field({"a": 0, "b": 1}, rng.normal(size=(2, 5)), rng.normal(size=(5, 5)), np.eye(5) * 2)
    tree = pc.Nodes([(0, 1)] * 4, [["a"], ["b"], ["a", "b"], []], [(0, 1), (1, 2)], [(1, 3)])
    local = field.potentials([tree])
    p = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum(local[i, y[i]] for i in range(4)) + sum(field.chain[y[a], y[b]] for a, b in tree.chain) + sum(field.skip[y[a], y[b]] for a, b in tree.skip))
        for i in range(4):
            p[i, y[i]] += w
    assert field.beliefs([tree], rounds=60) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-6)
    # A repeated token without evidence of its own takes the label of the others.
    strong = pc.Field({"s": 0}, np.array([[4.0, 0, 0, 0, 0]]), np.zeros((5, 5)), np.eye(5) * 3)
    loop = pc.Nodes([(0, 1)] * 3, [["s"], [], ["s"]], [(0, 1), (1, 2)], [(0, 1), (1, 2), (0, 2)])
    assert strong.beliefs([loop])[1].argmax() == 0


def test_empty_tables(make_docs, odd):
    empty = make_docs([])
    assert pc.train_field(empty) is None and pc.find(empty, None).collect() == []
    assert all(r.added == [] for r in pc.find(make_docs(odd), None).collect())
