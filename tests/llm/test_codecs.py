import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from topicloom.llm import piece_codec as pc
from topicloom.llm import rans_store as rs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = " ▁  \n\n\tabcdethin\x00é①🙂ABC_.,-#0129'\"{}()\x1c\x85 é"
    parts = [" ", "  ", "   ", "the", "\n", "\n ", "\n\n  ", "   \n", "return", "ing", "_", "==", "it's", "Don't.", "Hello,", "x!?", "<|endoftext|>", "ΣΑΣ", "İ"]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        else:
            yield "".join(rng.choice([*parts, " " * rng.randint(1, 40)]) for _ in range(rng.randint(0, 10)))


def test_pieces_equal_the_library():
    own, library = pc.pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in odd_texts(6000, 1):
        ids = np.frombuffer(own.encode(t), own.kind).tolist()
        assert ids == library.encode(t), repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)


def test_rows_are_decoded_together(monkeypatch):
    """Before, each id of each row went through Python."""
    own, library = pc.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", *odd_texts(400, 5), "", "x" * 3000]
    coded = pc._id_lists(own, texts)
    with monkeypatch.context() as m:
        m.setattr(pc.Pieces, "decode", lambda *_: pytest.fail("decoded one by one"))
        assert own.decode_lists(coded).to_pylist() == [library.decode(library.encode(t)) for t in texts]
        assert own.decode_lists(coded.slice(7, 20)).to_pylist() == [library.decode(library.encode(t)) for t in texts[7:27]]
    rng, e = random.Random(6), [own.byte_ids[b] for b in "é①".encode()]
    lists = [[rng.randrange(len(own.pieces)) for _ in range(rng.randint(0, 6))] for _ in range(500)]
    lists += [None, e[:1], e[1:], [], e, [0], [1], [2], e[:3], e[3:], None]
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(pc, "AT_ONCE", size)
        assert own.decode_lists(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [own.decode(x or []) for x in lists]
    assert own.decode_lists(pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    with pytest.raises(IndexError):
        own.decode_lists(pa.array([[len(own.pieces)]], pa.list_(pa.int32())))


def test_piece_columns(make_docs, odd):
    docs = make_docs(odd + [(8, "x" * 20000), (9, None)])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pc.decode(pc.encode(docs, MODEL), MODEL).collect()
    assert len(rows) == len(odd) + 2
    both = pc.encode_and_decode(docs, MODEL).collect()
    assert sorted(map(str, both)) == sorted(map(str, rows)) and pc.encode(docs, MODEL, verify=True).count() == len(rows)
    for r in rows:
        assert r.ids == library.encode(r.text) and r.decoded == library.decode(r.ids) and r.lang == "en"
    for r in pc.digests(pc.decode(pc.encode(docs, MODEL), MODEL)).collect():
        if r.doc_id == 4:
            ids = library.encode("One line\n\nTwo")
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pc.encode(make_docs([]), MODEL).collect() == []
    with pytest.raises(ValueError, match="ids"):
        pc.encode(docs.withColumnRenamed("lang", "ids"), MODEL)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(pc, "CACHE", 3)
    monkeypatch.setattr(rs, "CACHE", 3)
    own, library = pc.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words, whole = rs._WordIds(VOCAB), Tokenizer.from_file(VOCAB)
    for t in odd_texts(200, 2):
        assert np.frombuffer(own.encode(t), own.kind).tolist() == library.encode(t)
        assert words.ids(pa.array([t]))[1].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_words_equal_the_library():
    words, whole = rs._WordIds(VOCAB), Tokenizer.from_file(VOCAB)
    texts = [*odd_texts(6000, 3), "À Éa ßx µm ªº ÿŸ Ĳ ĳ ŉ Ā. ı, ÇA!?"]
    for part in (texts[::2], texts, [], [""], ["", "a", "", "\n"]):
        counts, ids = words.ids(pa.array(part, pa.string()).slice(0))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(part)] == [whole.encode(t, add_special_tokens=False).ids for t in part]
    counts, ids = words.ids(pa.array(texts).slice(7, 20))
    assert len(counts) == 20 and ids.tolist() == [i for t in texts[7:27] for i in whole.encode(t, add_special_tokens=False).ids]
    words.ids(pa.array(["x" * 65 + " " + "9" * 80 + " short"]))
    assert max(map(len, [*words.letters, *words.letters.old, *words.others, *words.others.old])) <= words.LONG


@pytest.mark.parametrize("n", [1, 31, 32, 33, 4000, 32768, 40000, 70000])
def test_frames_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49000)
    table = rs.Table(np.bincount(ids, minlength=49408))
    assert table.freq.sum() == 1 << table.bits and (table.freq[np.unique(ids)] > 0).all()
    cut = np.diff(np.append(0, np.sort(rng.integers(0, n + 1, 5)).tolist() + [n]))
    frame = rs.encode_frame(table, [None, 1, 2, 3, 2**62, -5], cut, ids)
    docs, lengths, got = rs.decode_frame(table, frame)
    assert docs == [None, 1, 2, 3, 2**62, -5] and (lengths == cut).all() and (got == ids).all()
    with pytest.raises(ValueError):
        rs.decode_frame(table, frame[:-1] + bytes([frame[-1] ^ 1]))


def test_decoding_starts_at_checkpoints_and_packs_well():
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.5, rs.BLOCK_STEPS * rs.LANES), 900)
    counts = np.bincount(ids, minlength=1000)
    table = rs.Table(counts)
    (block,) = table.encode(ids[None], rs.BLOCK_STEPS)
    for k in range(rs.BLOCK_STEPS // rs.CHECKPOINT_STEPS):
        assert (table.decode([block], k)[0] == ids[k * rs.CHECKPOINT_STEPS * rs.LANES :]).all()
    p = counts[counts > 0] / len(ids)
    assert len(block) * 8 < 1.05 * len(ids) * -(p * np.log2(p)).sum() + 16000
    broken = bytearray(block)
    broken[-1] ^= 255
    with pytest.raises(ValueError):
        table.decode([bytes(broken)])


def test_store_round_trip(spark, make_docs, odd, tmp_path, words, monkeypatch):
    rng = random.Random(4)
    docs = odd + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    whole = Tokenizer.from_file(VOCAB)
    folder = rs.write_store(make_docs(docs), VOCAB, 2, f"{tmp_path}/store")
    rows = sorted(rs.read_store(spark, folder).collect(), key=lambda r: r.start)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in rows] == [None] + sorted(i for i, _ in docs if i is not None)
    at = 0
    for r in rows:
        assert r.start == at and r.ids in want[r.doc_id]
        at += len(r.ids)
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in rs.read_store(spark, folder, checksums=True).collect()}
    assert sums == {(r.start, len(r.ids)): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    empty = rs.write_store(make_docs([]), VOCAB, 2, f"{tmp_path}/none")
    assert rs.read_store(spark, empty).collect() == []
