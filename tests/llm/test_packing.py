"""Packing: token ids against the tokenizer itself, pieces against an exact round trip."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motefield.llm.common import Texts
from motefield.llm.packing import Tournament, pack, packed
from motefield.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "It's a TEST, l'été ÀÉß÷×!", "x²y ½ éÅ <|endoftext|> <|ENDOFTEXT|>", "a b c…“q”.", "日本語 テスト Ωσς ΑΣ",
       "12345 a1b2 C3PO ...!!! ?!«»", "don't we'LL 'S", "́x ​z \x1c\x85", "Ünïcödé-ÄÖÜ_ñ", None, "a" * 5000, "ﬁ ﬀ İI ſ"]


@functools.cache
def both():
    return Tokenizer.from_file(PATH), WordTokenizer(PATH)


def test_ids_equal_the_tokenizers():
    whole, mine = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    for _ in range(2):
        ids, counts = mine.encode(Texts(pa.array(ODD)))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in ODD]
        assert [len(w) for w in want] == counts.tolist()
        assert [i for w in want for i in w] == ids.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abAZé ÉßΣ'<|>.,12\n\tñ́ ÷—")), max_size=25), max_size=5))
def test_ids_on_any_text(texts):
    whole, mine = both()
    ids, counts = mine.encode(Texts(pa.array(texts, pa.string())))
    assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]


def test_first_fit_by_tournament():
    rng = np.random.default_rng(3)
    for bins in (1, 2, 5, 33):
        tree, free = Tournament(bins, 100), [100] * bins
        for n in rng.integers(1, 40, 60):
            fits = [i for i, f in enumerate(free) if f >= n]
            if not fits:
                break
            free[fits[0]] -= int(n)
            assert tree.place(int(n)) == fits[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_pack_covers_every_token_once(lengths):
    sequences = pack(lengths, 32)
    seen = sorted((d, at + i) for s in sequences for d, at, n in s for i in range(n))
    assert seen == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    fill = [sum(p[2] for p in s) for s in sequences]
    assert all(f <= 32 for f in fill) and sum(f < 32 for f in fill) <= 1


def test_packed_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "tail", "y"), (3, "again and again", "y"), (3, "again and again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packed(docs, PATH, size=64, group_docs=4).collect()
    parts = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in parts.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 64
    for i, t in enumerate(ODD):
        if i != 3:
            own = sorted((r.start, r.ids, r.doc_tokens) for r in got if r.doc_id == i)
            ids = [x for _, p, _ in own for x in p]
            assert ids == whole.encode(t or "", add_special_tokens=False).ids + [2] and own[0][2] == len(ids)
    assert sum(r.length for r in got if r.doc_id is None) == len(whole.encode("tail", add_special_tokens=False).ids) + 1
    assert packed(docs.limit(0), PATH).count() == 0
