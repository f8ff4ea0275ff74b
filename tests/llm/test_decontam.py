import random
from collections import Counter

from topicloom.llm import decontam as dc

ITEMS = "item_id long, text string"


def sellers(pattern, text, anchored=False):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for i, c in enumerate(text):
        last, row = row, [i + 1 if anchored else 0]
        for j, p in enumerate(pattern):
            row.append(min(last[j] + (p != c), last[j + 1] + 1, row[j] + 1))
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("etaoin ")
        elif kind == 1:
            chars.insert(at, rng.choice("etaoin "))
        else:
            del chars[at]
    return "".join(chars)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 120)))
        for anchored in (False, True):
            assert dc.best_match(dc.letter_bits(p), len(p), t, anchored)[0] == sellers(p, t, anchored)


def cases(words, odd):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "abc"), (33, items[0][1]), (None, items[1][1][:40])]
    rows = list(odd)
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        _, item = items[rng.randrange(30)]
        part = edited(rng, item, rng.randint(0, len(item) // 7))
        rows.append((100 + i, text[: len(text) // 2] + rng.choice([" ", "\n", "", "  "]) + (part.upper() if i % 5 == 0 else part) + text[len(text) // 2 :]))
    return items, rows


def test_equals_brute_force(spark, make_docs, words, odd):
    items, rows = cases(words, odd)
    want = Counter()
    for d, t in rows:
        doc = dc.normal(t)[:2000]
        for i, item in items:
            p = dc.normal(item)
            if p and (e := sellers(p, doc)) <= int(0.1 * len(p)):
                want[d, i, e] += 1
    assert sum(want.values()) > 60
    bench = spark.createDataFrame(items, ITEMS)
    for block in (4_000_000, 2000):
        got = dc.find_items(make_docs(rows), bench, block_chars=block).collect()
        assert Counter((r.doc_id, r.item_id, r.edits) for r in got) == want
    hit = {d for d, _, _ in want}
    kept = dc.without_items(make_docs(rows), bench, block_chars=2000).collect()
    assert Counter(r.doc_id for r in kept) == Counter(d for d, _ in rows if d not in hit)


def test_empty_tables(spark, make_docs, odd):
    none = spark.createDataFrame([], ITEMS)
    assert dc.find_items(make_docs(odd), none).collect() == []
    assert dc.without_items(make_docs(odd), none).count() == len(odd)
    assert dc.find_items(make_docs([]), spark.createDataFrame([(1, "abc")], ITEMS)).collect() == []
