"""Token alignment against both libraries and a plain walk over byte offsets; merge-path pieces of every size."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixture import documents
from tokenizers import Tokenizer

from motefield.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "it's  we'll 'tis\n\n x'", "<|endoftext|> <s></s>", "  x   y  \x1c!\x1c", "one ▁ two", "日本語 " * 40, "😀é\u0085",
       "\x00 \x00", "tab\t\ttab \r\n end  ", "Çà été, l’été. «Ça»", "a" * 300, "x=1;y==2 // --- 3.14", " a b  c"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_table():
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokens(tools, text):
    """(id, end) of A and of B, or nothing."""
    a, b = tools
    if not text:
        return [], []
    table = byte_table()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], []
    ends = lambda raw: np.cumsum([len(r) for r in raw]).tolist()
    return list(zip(ids_a, ends(raw_a))), list(zip(ids_b, ends(raw_b)))


def expected(tools, texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    both = [tokens(tools, t) for t in texts]
    links = [[(i, j) for i, x in a for j in [dict((e, j) for j, e in b).get(x)] if j is not None] for a, b in both]
    count = Counter(p for some in links for p in some)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (a, b), mine in zip(both, links):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= c) for side in (a, b)))
            low = c
        out.append((len(a), len(b), len(cuts), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), ";".join(groups)))
    return out


def texts_of():
    rng = random.Random(4)
    letters = "   abcdefthe in's\n\t012.,'\"éñß日本▁<s>=-_/"
    long = "\n".join(t for _, t in documents(6) if t and len(t) < 3000)
    return ODD + [t for _, t in documents(3) if t is not None and len(t) < 5000] + [long] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]


def test_tokens_equal_the_libraries(tools):
    pair = alignment.Pair(BYTES, PIECES)
    pair.a.MOST = 50
    for texts in (texts_of(), texts_of()[::-1]):
        a, count_a, b, count_b = pair.tokens(texts)
        want = [tokens(tools, t) for t in texts]
        assert [len(x) for x, _ in want] == count_a.tolist() and [len(y) for _, y in want] == count_b.tolist()
        assert a.tolist() == [i for x, _ in want for i, _ in x] and b.tolist() == [i for _, y in want for i, _ in y]


def test_crossing_is_the_merge_path():
    rng = random.Random(5)
    for _ in range(400):
        a, b = (np.array(sorted(rng.sample(range(40), rng.randint(0, 20)))) for _ in range(2))
        steps = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for d in range(len(steps) + 1):
            assert alignment.crossing(a, b, d) == sum(side == 0 for _, side in steps[:d])


@pytest.mark.parametrize("work", [1 << 14, 64, 5, 1])
@pytest.mark.parametrize("hot", [1 << 19, 3])
def test_alignment(spark, tools, work, hot):
    texts = texts_of()[:: 1 if work == 64 else 4]
    rows = [(k, t, 5, "x") for k, t in enumerate(texts)] + [(3, "same text", 6, "y")] * 3 + [(None, None, 7, None), (None, "no id", 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links int, `kept` string").repartition(3)
    got = alignment.aligned(df, BYTES, PIECES, work=work, hot=hot)
    assert got.columns == ["doc_id", "kept", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = expected(tools, [r[1] or "" for r in rows])
    key = lambda r: tuple((x is None, x) if x is not None else (True, "") for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((r[0], r[3], *w) for r, w in zip(rows, want)), key=key)


def test_digest_and_empty_table(spark, tools):
    texts = texts_of()[::5]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for work in (1 << 14, 7):
        got = {r.doc_id: r.groups for r in alignment.aligned(df, BYTES, PIECES, digest=True, work=work).collect()}
        want = expected(tools, texts)
        assert got == {k: w[6] and hashlib.sha256(w[6].encode()).hexdigest() for k, w in enumerate(want)}
    assert alignment.aligned(df.limit(0), BYTES, PIECES).count() == 0
