import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from topicloom.llm import simhash_trie as st


def plain_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, budget):
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    values = sorted(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= budget:
                up[root(a)] = root(b)
    return {p: root(p) for p in values}


def brute(rows, budget=2, shingle=3):
    prints = [(i, plain_print(t, shingle)) for i, t in rows]
    root = components({p for _, p in prints}, budget)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return Counter((i, p, least.get(root[p])) for i, p in prints)


def near_copies(words, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = list(rng.choice(rows)[1].split())
            if rng.random() < 0.7 and text:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + i, " ".join(text)))
        else:
            rows.append((1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(make_docs, words, odd):
    rows = odd + near_copies(words, 400, 1)
    got = st.near_duplicates(make_docs(rows), crowded=20)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("budget,crowded", [(2, 8), (2, 10**6), (1, 8), (3, 16)])
def test_tries_lose_no_link_between_dense_fingerprints(spark, budget, crowded):
    rng = np.random.default_rng(budget)
    centres = [int(x) for x in rng.integers(0, 2**64, 6, dtype=np.uint64)] + [0, 2**64 - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            p = c
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = st.fingerprint_links(spark.createDataFrame(signed, "fp long"), budget, crowded).collect()
    want, up = components(prints, budget), {p: p for p in prints}
    from itertools import chain

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in ((r.src % 2**64, r.dst % 2**64) for r in links):
        assert a in prints and b in prints and want[a] == want[b]
        up[root(a)] = root(b)
    assert len({root(p) for p in prints}) == len(set(want.values()))
    assert len(list(chain(links))) <= (budget + 1) * 40 * len(prints)


def test_one_of_each_group_stays(make_docs, words, odd):
    rows = odd + near_copies(words, 200, 2)
    kept = st.keep_one(make_docs(rows)).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    root, least = components({p for _, p in prints}, 2), {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    # Two texts of one id are two groups, each with a row of its own.
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert sorted(r.text for r in kept if r.doc_id == 5) == ["a", "b"]
    assert [r.text for r in kept if r.doc_id is None] == ["no id"]
    assert st.keep_one(make_docs([])).collect() == [] and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_keep_one_refuses_a_clashing_column(make_docs):
    with pytest.raises(ValueError, match="_same"):
        st.keep_one(make_docs([(1, "a")]).withColumnRenamed("lang", "_same"))
