import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicloom.llm import chunk_bpe as cb

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def coded(coder, texts):
    rows = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    return [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(np.frombuffer(b"".join(rows), np.uint8), starts)]


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the ", "it's", "don't ", "É", "é", "́", " ́x", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x0b", "12345", "'s", "'", "...", "!?", "日本語",
             "\U0001f600", "İ", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "<|end", "</w>", "ab" * 40, "안녕", "가", "Å", "ạ̇", "-", "  "]
    passages = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(5)]
    return ["".join(rng.choice(passages) if rng.random() < 0.05 else rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("bits, least, most", [(9, 64, 8192), (3, 4, 40), (1, 1, 9)])
def test_ids_equal_the_library_over_any_cuts(library, monkeypatch, bits, least, most):
    monkeypatch.setattr(cb, "CUT_BITS", bits)
    monkeypatch.setattr(cb, "MIN_CHUNK", least)
    monkeypatch.setattr(cb, "MAX_CHUNK", most)
    monkeypatch.setattr(cb, "WINDOW", 8)
    coder = cb.ChunkCoder(PATH, 1 << 20)
    texts = odd_texts(700, bits)
    for at in range(0, len(texts), 50):
        block = texts[at : at + 50]
        assert coded(coder, block) == [plain(library, t) for t in block]
    assert coder.reused > 0 and coder.repaired > 0


def test_cuts_depend_on_content_only():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    found = []
    for before in (b"", b"x" * 777, "é".encode() * 500):
        data = np.frombuffer(before + passage, np.uint8)
        ends = cb.cuts(data, np.array([0, len(data)]))[0] - len(before)
        found.append({int(e) for e in ends if e > 2 * cb.MAX_CHUNK})
    assert len(found[0]) > 3 and found[0] == found[1] == found[2]
    # The neighbours of a text in its batch do not matter.
    two = np.frombuffer(passage + passage, np.uint8)
    first, second = cb.cuts(two, np.array([0, len(passage), 2 * len(passage)]))
    assert first.tolist() == (second - len(passage)).tolist()


def test_copies_are_encoded_once(library):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("aeiourtn") for _ in range(6)) for _ in range(3000))
    coder = cb.ChunkCoder(PATH)
    coded(coder, [passage])
    first = coder.encoded
    texts = [f"{'z ' * i}{passage} end{i}" for i in range(20)]
    assert coded(coder, texts) == [plain(library, t) for t in texts]
    # Only the chunks at the ends of the passage are new.
    assert coder.encoded - first <= 20 * 4 and coder.reused > 20 * (first - 4)


def test_memory_is_bounded_by_bytes():
    memory = cb.ByteMemory(100_000)
    for i in range(5000):
        memory.put(str(i).encode() * 50, b"x" * 100)
        assert memory.get(str(i).encode() * 50) == b"x" * 100
        assert memory.used <= 100_000 and sum(len(k) + len(v) for k, v in (*memory.young.items(), *memory.old.items())) < 200_000
    memory.put(b"long", b"x" * 50_000)
    assert memory.get(b"long") is None


def test_long_texts_take_linear_time(library):
    import time

    coder = cb.ChunkCoder(PATH)
    took = []
    for n in (200_000, 800_000):
        rng = random.Random(n)
        text = "".join(rng.choice("abcdefghij") for _ in range(n))
        start = time.time()
        assert len(coded(coder, [text + " tail"])[0]) > n / 10
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 1


def test_columns_on_spark(make_docs, odd, library):
    rows = odd + [(100 + i, t) for i, t in enumerate(odd_texts(60, 7))]
    docs = make_docs(rows).withColumn("same", F.lit(1))
    out = cb.decode(cb.encode(docs, PATH), PATH).collect()
    want = sorted((str(i), t, plain(library, t)) for i, t in ((i, t or "") for i, t in rows))
    assert sorted((str(r.doc_id), r.text or "", r.ids) for r in out) == want
    for r in out:
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.same == 1
    got = sorted(map(tuple, cb.digests(docs, PATH).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(
        ((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ((i, plain(library, t)) for i, t in rows)), key=str
    )


def test_empty_table_and_clashing_names(make_docs):
    assert cb.encode(make_docs([]), PATH).collect() == [] and cb.digests(make_docs([]), PATH).collect() == []
    with pytest.raises(ValueError, match="ids"):
        cb.encode(make_docs([]).withColumnRenamed("lang", "ids"), PATH)
    assert cb.digests(make_docs([(1, "a b")]).withColumnRenamed("lang", "n_tokens"), PATH).count() == 1
