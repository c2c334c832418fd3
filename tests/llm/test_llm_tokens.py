"""Token files: coding round trips, and whole texts through the library itself."""

import random
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from plain import documents, prose

from docketry.llm import token_files as t
from docketry.llm.queries import TOKENIZER, token_rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(TOKENIZER)
    out.encode_special_tokens = True
    return out


def nasty():
    rng = random.Random(2)
    marks = [" ", "  ", "\n", "\t ", " ", " ", "　", "é", "ñ", "🙂", "中", "'s", "'", "don't", "a", "Z9", "...", "<|endoftext|>", "\r\n", "\x85", "ß", "Ж"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_codes_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 200, 70_000, 1 << 25):
        n = rng.integers(1, 30, 50)
        ranks = rng.integers(0, top, int(n.sum())).astype(np.uint32)
        control, data, n_control, n_data = t.pack(ranks, n)
        assert (t.unpack(control.tobytes(), data.tobytes(), n) == ranks).all()
        assert n_control.tolist() == (-(-n // 4)).tolist() and n_data.sum() == len(data)


def test_pieces_give_the_tokens_of_the_whole_text(tokenizer):
    texts = [*nasty(), "", "x " * 5000, "y" * 3000]
    block = next(iter(t.W.blocks(pa.array(texts), 1 << 30)))
    encoder = t.Encoder(TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, n = encoder.encode(block)
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_files_hold_every_document_in_order(spark, shared_folder, tokenizer):
    rng = random.Random(9)
    given = [(5, "five"), (3, None), (4, ""), (1 << 40, prose(rng, 30_000)), (-2, "é🙂 <|endoftext|>"), (8, "twice"), (8, "twice"), *[(100 + i, x) for i, x in enumerate(nasty()[:60])]]
    docs = documents(spark, given).repartition(5).withColumnsRenamed({"lang": "id", "source": "ids"})
    path = f"{shared_folder}/token-files"
    t.write_files(docs, path, TOKENIZER, block_tokens=500)
    got = sorted(t.read_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(given, key=lambda r: r[0])
    ids = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 0] for _, x in want]
    assert [r.doc_id for r in got] == [k for k, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == [0, *accumulate(len(x) for x in ids)][:-1]
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in t.read_files(spark, path, digest=True).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    ranks = [r.token for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    count = np.bincount([i for x in ids for i in x])
    assert ranks == sorted(np.flatnonzero(count).tolist(), key=lambda i: (-count[i], i))


def test_empty_table(spark, shared_folder):
    path = f"{shared_folder}/token-files-empty"
    t.write_files(documents(spark, [(1, "x")]).limit(0), path, TOKENIZER)
    assert t.read_files(spark, path).count() == 0 and t.read_files(spark, path, digest=True).count() == 0


def test_query_gives_the_ids_of_the_plain_call(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y z <|endoftext|>", *nasty()]
    ids = [[*plain.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert 50256 in ids[0]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_rows(documents(spark, texts)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_held_ids_stay_bounded_over_texts_without_spaces(monkeypatch):
    from docketry.llm import words as W

    rng = random.Random(8)
    encoder = t.Encoder(TOKENIZER)
    held = []
    for _ in range(6):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(20)] + ["some words " * 5]
        for block in W.blocks(pa.array(texts)):
            ids, n = encoder.encode(block)
            want = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
            assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
        held.append(len(encoder.ids))
    assert max(held) < 50
    monkeypatch.setattr(t, "CACHE_PIECES", 40)
    for k in range(20):
        texts = [" ".join(f"w{k}x{j}" for j in range(15))]
        (block,) = W.blocks(pa.array(texts))
        assert encoder.encode(block)[0].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert len(encoder.place) <= 40 and len(encoder.size) == len(encoder.place) and len(encoder.ids) < 400


def test_words_are_encoded_once_whatever_points_follow():
    marks = [".", ",", "!", "?", ";", "&&&", ").", "7"]
    texts = [" ".join(f"{w}{m}" for m in marks) for w in ("alpha", "beta", "gamma", "señor", "delta")]
    (block,) = t.W.blocks(pa.array([f"{x} end" for x in texts]))
    encoder = t.Encoder(TOKENIZER)
    ids, n = encoder.encode(block)
    want = [encoder.tokenizer.encode(f"{x} end", add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(encoder.place) < 25  # 40 ` word.` and the like, but few words and marks


def test_cuts_between_kinds_of_characters_give_the_tokens_of_the_whole_text(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(4)
    marks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1f", "\x7f", "\x85", "\xa0", " ", "é", "×", "́", "Ж", "٣", "½", "🙂", "'", "'s", "'re", "'S", "a", "t", "the", "12", "...", ",", "&&&", "<|endoftext|>", "<|", "|>", "endoftext", "AKIA9X", "ab01"]
    for added, whole in ((True, plain), (False, tokenizer)):
        encoder = t.Encoder(TOKENIZER, added)
        for few in (3, 6, len(marks)) * 5:
            some = rng.sample(marks, few)
            texts = ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(200)]
            ids, n = encoder.encode(next(iter(t.W.blocks(pa.array(texts), 1 << 30))))
            want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_joined_pieces_make_no_added_token(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    own.add_tokens([AddedToken("red fox", normalized=False)])
    own.save(str(tmp_path / "own.json"))
    encoder = t.Encoder(str(tmp_path / "own.json"), True)
    texts = ["a red b", "a fox b", "a red dog", "the fox"]
    ids, n = encoder.encode(next(iter(t.W.blocks(pa.array(texts)))))
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
