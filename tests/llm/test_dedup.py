"""Exact, near, substring and line dedup against brute force."""

import hashlib
import random

import pytest
from fixture import blank_words, documents, lower_ascii

from motefield.llm import line_dedup as lines
from motefield.llm import minhash
from motefield.llm.common import shared_path
from motefield.llm.components import components
from motefield.llm.exact_dedup import DigestIndex, exact_dedup, text_digest
from motefield.llm.substring_dedup import anchors, substring_dedup

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use themselves."""
    rows = [(i, t, "k", 1.5, None) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, kept double, _text string").repartition(3)


def test_exact(spark, docs):
    got = {r.id: r for r in exact_dedup(docs).collect()}
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.digest == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_index_grows(spark):
    index = DigestIndex(spark, shared_path(spark, "index"), 4)
    batch = lambda rows: spark.createDataFrame(rows, "id long, text string").select("id", text_digest().alias("digest"))
    index.append(batch([(5, "a"), (7, "a"), (6, None), (None, "n")]))
    index.append(batch([(9, "a"), (10, "b"), (None, "c"), (11, ""), (11, "")]))
    again = DigestIndex(spark, index.path, 4)  # as a later session opens it
    again.append(batch([(1, "b"), (2, "d"), (2, "d")]))
    name = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("a", "b", "c", "d", "", "n")}
    assert sorted(((name[r.digest], r.keep_id) for r in again.rows().collect()), key=str) == sorted(
        [("a", 7), ("", 6), ("n", None), ("b", 10), ("c", None), ("d", 2)], key=str)
    assert "Exchange" not in again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()


def test_exact_index_reopens_with_its_own_buckets(spark):
    digests = spark.range(60).selectExpr("id", "sha2(string(id), 256) AS digest")
    index = DigestIndex(spark, shared_path(spark, "index"), 8)
    index.append(digests)
    again = DigestIndex(spark, index.path, 3)  # as a session with other shuffle partitions opens it
    again.append(digests)
    assert again.buckets == 8 and again.rows().count() == 60


def shingles(text, n):
    w = blank_words(lower_ascii(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def reachable(nodes, links):
    top = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


@pytest.mark.parametrize("n, share", [(3, 85), (5, 80)])
def test_near(docs, n, share):
    sets = {i: shingles(t, n) for i, t in ROWS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    want = reachable(sets, links)
    got = {r.id: r for r in minhash.near_duplicates(docs, n, share).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_without_broadcast_nulls_and_repeats(spark):
    rows = [(3, "a b c d e f g h"), (None, "a b c d e f g h"), (9, "A b c d e f g h"), (9, "A b c d e f g h"), (4, "x y"), (5, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df, few=0).collect()]
    assert sorted(got, key=str) == sorted([(3, 4, 3, True), (None, 4, None, True), (9, 4, 3, False), (9, 4, 3, False), (4, 1, 4, True), (5, 1, 5, True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [512, 20])
def test_near_pairs_in_a_crowd(spark, monkeypatch, hot):
    """Hundreds of documents just under the share; planted pairs just over it share three more words."""
    monkeypatch.setattr(minhash, "HOT", hot, raising=False)
    core, rows = " ".join(f"c{i}" for i in range(302)), []
    for i in range(300):
        rows.append((i, " ".join([core, *(f"d{i}x{k}" for k in range(27 + i % 5))])))
    for i in range(30):
        twin = rows[7 * i][1].split()[:302 + 3] + [f"e{i}x{k}" for k in range(24)]
        rows.append((1000 - i, " ".join(twin)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) == 30
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85)
    assert {r.id: r.component_id for r in got.collect()} == reachable(sets, links)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}


def test_forest_pairs_cross_ranges(spark):
    """Neighbours that a range cut parts still meet."""
    import numpy as np

    sig = np.arange(minhash.PERMUTATIONS, dtype=np.uint16).tobytes()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = minhash.candidates(spark.createDataFrame([(i, bytearray(sig)) for i in range(40)], "id long, sig binary"))
        found = {(r.a, r.b) for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(i, i + 1) for i in range(39)} <= found


def test_anchor_is_first_least():
    import numpy as np

    g = np.array([5, 3, 3, 9, 1, 1, 8, 2, 2, 2, 7], np.uint64)
    for width in (1, 2, 3, 5, 7):
        assert anchors(g, width).tolist() == [i + int(np.argmin(g[i:i + width])) for i in range(len(g) - width + 1)]


def repeated(rows, n):
    seen = {}
    for i, t in rows:
        w = blank_words(t)
        for at in range(len(w) - n + 1):
            seen.setdefault(tuple(w[at:at + n]), []).append((i, at))
    gone = {}
    for spots in seen.values():
        if len(spots) > 1:
            for i, at in spots:
                gone.setdefault(i, set()).update(range(at, at + n))
    return gone


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_substrings(docs, few, monkeypatch):
    from motefield.llm import substring_dedup as module

    whole = module.repeats
    monkeypatch.setattr(module, "repeats", lambda d, n, k: whole(d, n, k, few))
    gone = repeated(ROWS, 35)
    for r in substring_dedup(docs, keep=["doc_id"]).collect():
        w, cut = blank_words(ROWS[r.doc_id][1]), gone.get(r.doc_id, set())
        assert (r.n_words, r.n_removed) == (len(w), len(cut))
        assert r.kept_text == " ".join(x for k, x in enumerate(w) if k not in cut)
        assert {k for a, b in zip(r.repeats[::2], r.repeats[1::2]) for k in range(a, b)} == cut


def test_substrings_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "p " + text), (None, None), (2, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df).collect()), key=str)
    assert got == sorted([(1, 40, 40, text), (1, 40, 40, text), (None, 41, 40, "p " + text), (None, 0, 0, None), (2, 1, 0, "short")], key=str)
    assert substring_dedup(df.limit(0)).count() == 0


def without_lines(rows, least):
    seq, out = {}, {}
    for i, t in rows:
        seq[i] = [(k, x.strip(" \t\n\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n"))]
        seq[i] = [(k, x) for k, x in seq[i] if x]
    seen, gone = {}, {}
    for i in sorted(seq):
        own = [x for _, x in seq[i]]
        for p, line in enumerate(own):
            for j, q in seen.get(line, ()):  # the longest run that starts here and there
                other, n = seq[j], 0
                while p + n < len(own) and q + n < len(other) and own[p + n] == other[q + n][1]:
                    n += 1
                if sum(len(blank_words(x)) for x in own[p:p + n]) >= least:
                    gone.setdefault(i, set()).update(range(p, p + n))
            seen.setdefault(line, []).append((i, p))
    for i, t in rows:
        cut = {seq[i][p][0] for p in gone.get(i, ())}
        out[i] = (len(seq[i]), len(cut), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut))
    return out


@pytest.mark.parametrize("least", [10, 4])
def test_lines(docs, least):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.line_dedup(docs, least).collect()}
    assert got == without_lines(ROWS, least)


def test_lines_of_repeated_rows(spark):
    line = "a line of more than ten words that is repeated in here twice"
    df = spark.createDataFrame([(2, line), (2, line), (None, line + "\nown"), (7, None), (1, "x\n" + line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.kept_text) for r in lines.line_dedup(df).collect()), key=str)
    assert got == sorted([(2, 1, ""), (2, 1, ""), (None, 1, "own"), (7, 0, None), (1, 0, "x\n" + line)], key=str)
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_runs_of_any_number_of_lines(spark):
    """Three lines of 5, 4 and 5 words, seven of two words, and a long line with short ones after it."""
    three = ["a b c d e", "f g h i", "j k l m n"]
    seven = [f"s{k} t{k}" for k in range(7)]
    tail = [" ".join(f"w{k}" for k in range(40)), *(f"u{k} v{k}" for k in range(6))]
    rows = []
    for n, run in enumerate((three, seven, tail, seven[:4])):
        rows += [(10 * n + k, "\n".join([f"before {n} {k}", *run, f"after {n} {k}"])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.line_dedup(df).collect()}
    assert got == without_lines(rows, 10)
    assert [got[i][1] for i in (0, 1, 2, 11, 12, 21, 22, 30, 31)] == [0, 3, 3, 7, 7, 7, 7, 0, 0]


@pytest.mark.parametrize("least", [1, 3, 7])
def test_random_runs(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "e f g", "h i j k"]) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.line_dedup(df, least).collect()} == without_lines(rows, least)
