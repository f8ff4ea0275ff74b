import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import merkle as mk
from topicloom.llm import oracles


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def path(level, i):
    """The root over ``level`` and the siblings of node ``i``, plainly."""
    out = []
    while len(level) > 1:
        at = i - i % 3
        out.append(("".join(level[at:i]), "".join(level[i + 1 : at + 3])))
        level, i = [sha("".join(level[a : a + 3])) for a in range(0, len(level), 3)], i // 3
    return level[0], out


def brute(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)``."""
    groups = {}
    for row in rows:
        leaf = sha("".join(map(field, row)))
        cut = row[4] if row[4] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 else row[4].replace("\n", "")
        groups.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0, leaf), sha("".join(map(field, (*row[:4], cut))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort()
    heads = [path([k[2] for k, _ in groups[s]], 0)[0] for s in names]
    out = []
    for n, s in enumerate(names):
        leaves = [k[2] for k, _ in groups[s]]
        root, above = path(heads, n)
        for i, ((has, doc, leaf), claimed) in enumerate(groups[s]):
            steps = path(leaves, i)[1] + above
            folded = claimed
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((doc if has else None, leaf, heads[n], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)


ROWS = [(1, "b", "en", 3, "a\nb"), (1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (None, "b", "en", 1, "x"), (None, "b", "en", 1, "y"),
        (3, None, "de", 0, ""), (4, "", "de", 5, "é\n1:x"), (5, "É", "de", 5, "\n" * 50_000), (-7, "a", "de", 5, "z\n"), (2, "b", "en", 9, "other")]


def test_addresses_are_a_permutation_with_each_half_in_one_piece():
    for levels in range(1, 8):
        flat = np.concatenate(mk.addresses(levels))
        assert sorted(flat) == list(range(mk.slots(levels)))
        for depth, places in enumerate(mk.addresses(levels)):
            assert len(places) == 3**depth
    top = mk.addresses(5)
    lower = {int(a) for depth in (2, 3, 4) for a in top[depth][: 3 ** (depth - 2)]}
    assert lower == set(range(4, 4 + mk.slots(3)))


def test_block_and_siblings_match_the_plain_tree():
    for width in (1, 2, 3, 4, 9, 10, 26, 27):
        leaves = [sha(str(i)) for i in range(width)]
        height = mk.climb(width)
        store, root = mk.build_block([bytes.fromhex(x) for x in leaves], height)
        assert len(store) == 32 * mk.slots(height + 1)
        got = mk.sibling_lists(store, width, height)
        for i in range(width):
            want_root, steps = path(leaves, i)
            assert root.hex() == want_root and list(zip(*got[i])) == steps


@pytest.mark.parametrize("height", [1, 2])
def test_equals_brute_force_over_many_tiers(spark, monkeypatch, height):
    monkeypatch.setattr(mk, "HEIGHT", height)
    monkeypatch.setattr(mk, "BASE", 3**height)
    rows = ROWS + [(100 + i, "hot", "en", i, f"line {i}\nend") for i in range(95)] + [(i, f"s{i}", "en", i, "one\n") for i in range(300, 331)]
    for parts in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            manifest = mk.build(frame(spark, rows), mk.without_newlines())
            got = sorted(map(tuple, mk.verify(manifest).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == brute(rows)
        assert manifest.root() == got[0][3]


def test_production_height_and_the_oracle(spark):
    rows = ROWS + [(1000 + i, "hot", "en", i, f"line {i}\nend") for i in range(800)]
    got = sorted(map(tuple, mk.verify(mk.build(frame(spark, rows), mk.without_newlines())).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(oracles.MERKLE).fetchall(), key=str) == got


def test_one_document_empty_table_and_extra_columns(spark):
    one = mk.verify(mk.build(frame(spark, ROWS[:1]), mk.without_newlines())).collect()
    assert [tuple(r) for r in one] == brute(ROWS[:1])
    empty = mk.build(frame(spark, []))
    assert mk.verify(empty).collect() == [] and empty.root() is None
    names = ["grp", "digest", "claimed", "idx", "width", "part", "seq", "block", "root", "members"]
    more = frame(spark, ROWS).withColumns({n: F.lit("extra") for n in names})
    assert sorted(map(tuple, mk.verify(mk.build(more, mk.without_newlines())).collect()), key=str) == brute(ROWS)


def test_unaltered_documents_verify(spark):
    assert all(r.verified for r in mk.verify(mk.build(frame(spark, ROWS))).collect())
