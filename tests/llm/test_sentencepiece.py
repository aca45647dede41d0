"""SentencePiece encoding and decoding against the library, and merging by definition against backtracking."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixture import documents

from motefield.llm import sentencepieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "<s>", "</s><unk>", "<0x41>", "▁", "▁▁ ▁", " " * 100, "\n" * 50, "a" * 5000, "=" * 333, "日本" * 700,
       "\x00a\x00", "😀 é ñandú\u0085 x", "the the  the   the", "aaaaaa aaaaaaa", "�﻿", "0123 45.67,8"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_ids_and_texts_equal_the_library(library):
    rng = random.Random(2)
    letters = "  ▁abcdefghe thein\n\t0123.,'\"éñß日本語中文кириллица😀\x00\u0085�<s></unk>=--_//"
    parts = ["th", "e", "in", "er", " ", "▁", "an", "ing", "tion", "  ", "    ", "-", "=="]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    coder, back = sentencepieces.Encoder(PIECES), sentencepieces.Decoder(PIECES)
    ids, count = coder.ids(texts)
    want = [library.encode(t) for t in texts]
    assert count.tolist() == [len(w) for w in want]
    flat = np.frombuffer(ids, "<i4")
    assert flat.tolist() == [i for w in want for i in w]
    assert back.texts(flat.astype(np.int64), count).to_pylist() == [library.decode(w) for w in want]


def test_memory_that_is_emptied_changes_nothing(library):
    coder = sentencepieces.Encoder(PIECES)
    coder.MOST = 3
    for text in [t for _, t in documents() if t] * 2:
        assert np.frombuffer(coder.ids([text])[0], "<i4").tolist() == library.encode(text)


def test_pieces_that_merging_cannot_make_and_dead_ends(tmp_path):
    """A small vocabulary in which the longest match is often wrong, and one piece is out of reach."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 2, True
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    for k, p in enumerate(["<unk>", "<s>", "</s>"]):
        add(p, 0, 2 if k == 0 else 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    merges = ["bc", "ab", "cd", "abc", "aa", "aaa", "bcd", "▁a", "dd", "abcd", "cc", "ccc", "▁▁", "▁▁a", "da"]
    for k, p in enumerate([*merges, *"abcd▁"]):
        add(p, -float(k // 2), 1)  # scores that tie
    path = tmp_path / "small.model"
    path.write_bytes(model.SerializeToString())
    library, coder = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepieces.Encoder(str(path))
    assert "abcd" not in coder.token or coder.vocab.merged("abcd") == ["abcd"]
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice("abcd  e") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(coder.ids([text])[0], "<i4").tolist() == library.encode(text), text


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentencepieces.Vocabulary(str(path))


def test_tables(spark, library):
    rows = documents(4) + [(0, "same id"), (0, "same id"), (None, "no id"), *((900 + k, t) for k, t in enumerate(ODD))]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, ids string, decoded double").repartition(3)
    found = sentencepieces.decoded(sentencepieces.encoded(docs, PIECES), PIECES)
    assert sorted(found.columns) == ["decoded", "doc_id", "ids", "text"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    got = sorted(((r.doc_id, r.text, r.ids, r.decoded) for r in found.collect()), key=key)
    want = sorted(((i, t, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=key)
    assert got == want
    empty = sentencepieces.decoded(sentencepieces.encoded(docs.limit(0), PIECES), PIECES)
    assert empty.count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0xFF + 3, 0xC3 + 3, 0xA9 + 3, 0])], "k int, ids array<int>")
    assert sorted((r.k, r.decoded) for r in sentencepieces.decoded(nulls, PIECES).collect()) == [
        (1, ""), (2, ""), (3, library.decode([0xFF + 3, 0xC3 + 3, 0xA9 + 3, 0]))]
