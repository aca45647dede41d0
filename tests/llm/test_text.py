"""Decontamination, quality, language, archives and page text against brute force and held-out accuracy."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from fixture import documents, lower_ascii, sentence

from motefield.llm import decontaminate, extract, langid, quality, warc
from motefield.llm.common import Texts

SMALL = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination(spark, most):
    rows = documents(8)
    rng = random.Random(1)
    source = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(rng.choice(source).split()[5:5 + rng.randint(1, 25)])) for k in range(12)]
    items += [(50, items[0][1]), (51, None), (52, ""), (53, "!!"), (54, "Two WORDS"), (55, sentence(rng, 30))]
    want = {}
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for k, b in items:
            bw = alnum(b)
            n = min(13, len(bw))
            grams = {tuple(bw[x:x + n]) for x in range(len(bw) - n + 1)} if n else set()
            for at in range(len(w) - n + 1) if n else ():
                if tuple(w[at:at + n]) in grams:
                    hit.update(range(at, at + n))
                    found.add(k)
        want[i] = len(w), len(hit), sorted(found), hit
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, items string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, most=most).cache()
    for r in found.collect():
        n, h, its, hit = want[r.doc_id]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, h, its)
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
    clean = {r.doc_id: r.text for r in decontaminate.without_spans(found).collect()}
    for i, t in rows:
        n, h, _, hit = want[i]
        assert alnum(clean[i]) == [x for k, x in enumerate(alnum(t)) if k not in hit]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination_of_null_and_repeated_ids(spark, most):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(None, f"own {passage}"), (None, "free of it"), (None, None), (1, f"{passage} x"), (1, f"{passage} x"), (1, "short"), (1, f"a b c {passage}"), (2, "y")]
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, most=most).collect()
    got = [(r.doc_id, r.text, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in found]
    want = []
    for i, t in rows:
        w = (t or "").split()
        at = w.index("p0") if "p0" in w else None
        want.append((i, t, len(w), 0, [], []) if at is None else (i, t, len(w), 13, [7], [(at, at + 13)]))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limits", [{}, {"most": 0}, {"most_bytes": 100}])
def test_contamination_by_items_without_an_id(spark, limits):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "two words here"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (None, passage), (None, "two words"), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, **limits).collect())
    assert got == [(1, 13, [7]), (2, 2, []), (3, 0, [])]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.classified(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got[got.quality == 1].predicted == 1).mean() > 0.98 and got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 0), (2, "a b", 0), (None, "x" * 30000, 1), (3, "wo rds", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0)], "doc_id long, quality int")
    out = quality.classified(docs, labels).collect()
    assert len(out) == 5 and {r.score for r in out} <= {0.5, 1.0, 0.0} and all(0 <= r.score <= 1 for r in out)
    assert quality.quality_filter(docs, labels.limit(0)).columns == docs.columns
    assert quality.classified(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(2)
    cov = [np.diag([1.0, 2.0]), np.array([[2.0, 0.5], [0.5, 1.0]])]
    means = np.array([[0.0, 1.0], [1.0, -1.0]])
    model = quality.Discriminant(means, np.array([np.linalg.cholesky(c) for c in cov]), np.array([np.log(np.linalg.det(c)) for c in cov]),
                                 np.array([0.25, 0.75]), np.zeros(2), np.ones(2))
    x = np.concatenate([[[np.log1p(1e9), 0.0]], np.stack([np.full(20, 25.0), rng.normal(size=20)], 1)])
    z = np.clip(x, -8, 8)
    dens = [-0.5 * np.einsum("ni,ij,nj->n", z - m, np.linalg.inv(c), z - m) - 0.5 * np.log(np.linalg.det(c)) + np.log(p) for m, c, p in zip(means, cov, model.priors)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(dens[1] - dens[0]) / np.sqrt(2))), atol=1e-6)


def test_forward_sums_all_segmentations():
    vocab = langid.Vocabulary(PIECES)
    weights = np.random.default_rng(0).random((vocab.size, 2)) + 0.1

    def brute(word):
        total = [np.ones(2)]
        for e in range(1, len(word) + 1):
            s = np.zeros(2)
            for a in range(e):
                i = pieces.get(word[a:e])
                if i is not None:
                    s += total[a] * weights[i]
            total.append(s)
        return np.log(total[-1])

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {bytes([int(model.id_to_piece(i)[3:5], 16)]): i for i in range(model.get_piece_size()) if model.is_byte(i)}
    pieces |= {model.id_to_piece(i).replace("▁", " ").encode(): i for i in range(model.get_piece_size())
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and "▁" not in model.id_to_piece(i)[1:]}
    for word in (b" therefore", " größe".encode(), b"zq", " ☃".encode()):
        got = langid.forward(np.frombuffer(word, np.uint8)[None, :], vocab, weights)[0]
        assert np.allclose(got, brute(word))
        total = np.zeros((vocab.size, 2))  # expected counts weigh the bytes they cover
        langid.expected(np.frombuffer(word, np.uint8)[None, :], np.ones((1, 2)), vocab, weights, total)
        assert np.allclose((total * vocab.lengths[:, None]).sum(0), len(word))
        if word[:1] != b" ":  # longer words always begin with the blank
            continue
        own, start, end = np.frombuffer(word[1:], np.uint8), np.array([0]), np.array([len(word) - 1])
        assert np.allclose(langid.forward_long(own, start, end, vocab, weights)[0], brute(word))
        again = np.zeros((vocab.size, 2))
        langid.expected_long(own, start, end, np.ones((1, 2)), vocab, weights, again)
        assert np.allclose(total, again)


def test_long_words_are_not_cut():
    """Words of 60 to 10 000 bytes against a plain pass in logarithms, in one and in many blocks."""
    vocab = langid.Vocabulary(PIECES)
    rng = np.random.default_rng(3)
    weights = rng.random((vocab.size, 2)) * 40.0 ** vocab.lengths[:, None] * 1e-4
    text = "".join(rng.choice(list("東京都は日本の首都であるaeiou"), 6000)).encode()
    words = [text[:10_000], text[30:168], text[3:63], b"therefore" * 30]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])

    def brute(word):
        total = np.full((len(word) + 1, 2), -np.inf)
        total[0] = 0
        m = np.frombuffer(word, np.uint8)
        for _, s, e, i in zip(*langid.arcs(m[1:], np.array([0]), np.array([len(m)]), vocab, 0, len(m))):
            total[e] = np.logaddexp(total[e], total[s] + np.log(weights[i]))
        return total[-1]

    want = np.array([brute(b" " + w) for w in words])
    assert np.allclose(langid.forward_long(buf, start, end, vocab, weights), want)
    assert np.allclose(langid.forward_long(buf, start, end, vocab, weights, block=100), want)
    short = np.frombuffer(b" " + words[2], np.uint8)[None, :]
    assert np.allclose(langid.forward(short, vocab, weights)[0], want[2])
    total = np.zeros((vocab.size, 2))
    langid.expected_long(buf, start, end, np.ones((4, 2)), vocab, weights, total)
    assert np.allclose((total * vocab.lengths[:, None]).sum(0), len(buf) + 4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identified(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, l, 1) for i, (t, l) in enumerate([("the cat", "en"), ("le chat", "fr"), (None, "en"), ("", "fr"), ("123 !?", None), ("Ünï" * 4000, None), ("the the", None)])]
    docs = spark.createDataFrame(rows + [rows[0], (None, "cat", "en", 2)], "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identified(docs, PIECES).collect()]
    assert len(got) == 9 and all(p == "und" and s == 0 for i, p, s in got if i in (2, 3, 4)) and all(p != "und" for i, p, _ in got if i in (0, 1, 5))
    assert all(r.lang_pred == "und" for r in langid.identified(docs.withColumn("lang", docs.lang.substr(9, 0)).replace("", None, "lang"), PIECES).collect())
    assert langid.identified(docs.limit(0), PIECES).count() == 0


def test_archives_round_trip(spark):
    odd = ["", None, "<p>é☃</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\nWARC/1.1", "a\nb\r\n\r\n", "long " * 60000, "<p>é☃</p>"]
    rows = [(i, f"http://h/{i}" if i % 2 else None, t, "clash") for i, t in enumerate(odd * 3)] + [(None, None, "<p>é☃</p>", ""), (2, "u\r\nX: y", "<p>é☃</p>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(pages).collect()
    assert len(got) == len(rows)
    for t in set(odd):
        data = (t or "").encode()
        ids = [i for i, _, x, _ in rows if (x or "") == (t or "")]
        least = min(i for i in ids if i is not None)
        own = [r for r in got if r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()]
        assert sorted(map(str, (r.page_id for r in own))) == sorted(map(str, ids)) and all(r.payload_bytes == len(data) for r in own)
        assert [r.page_id for r in own if r.record_type == "response"] == [least]
        assert all(r.refers_to == least for r in own if r.record_type == "revisit")
    large = warc.archived(pages, least=100).where("payload_bytes < 100")
    assert large.where("record_type = 'revisit'").count() == 0
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_of_others():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    members = b"".join(gzip.compress(record) for _ in range(3))
    assert [(h[b"warc-type"], b) for _, h, b in warc.parse_archive(warc._inflated(members))] == [(b"warcinfo", b"hi")] * 3
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"junk"))


PAGE = ("<html><head><title>T</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>{n}</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies {n}</div><main><h1>Head &amp; {n}</h1><p>First <b>bold {n}<p>Second\n  &lt;x&gt; {n}</p>"
        "<div class=ad>Buy</div><p>Share this page</p><section id=comments><p>me too</p></section></main><aside>more</aside><form><p>mail?</p></form>"
        "<footer>&copy; us</footer><script>if (a<b) x='</p>'</script>")


def test_page_text(spark):
    """Boilerplate by name goes, a line that all pages share goes as template, what varies stays."""
    rows = [(i, f"https://A.com/{i}", PAGE.format(n=f"n{i}")) for i in range(12)]
    plain = [(100 + i, "http://b.org/", f"<div id=menu1><a href=q>x</a></div><div>Body {i}<br>more</div><ul><li><a href=z>only links {i}</a></ul><p>tail") for i in range(2)]
    rows += plain + [(200, None, None), (201, "odd", ""), (202, "odd", "no tags < at > all & more"), (203, "odd", "<p>cut &am"), (204, "odd", "<!-- open"), (None, "odd", "<p>x</p>")]
    rows += [(300 + i, "http://copies.net", PAGE.format(n="same")) for i in range(9)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.id: r.text for r in extract.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == f"Head & n{i}\nFirst bold n{i}\nSecond <x> n{i}"
    assert got[100] == "Body 0 more\ntail" and got[200] == got[201] == got[204] == "" and got[None] == "x"
    assert got[202] == "no tags < at > all & more" and got[203] == "cut &am"
    assert all(got[300 + i].startswith("Head & same\nFirst bold same") for i in range(9))  # copies are one page: no template
    assert extract.main_text(pages.limit(0)).count() == 0


def test_tree_matching():
    a, b = extract.read_shape("d(x(#) p(#) y(#))"), extract.read_shape("d(p(#) y(#) z(#))")
    assert extract.tree_match(a, b) == (5, [(1, 0), (2, 1)])
    assert extract.shape_of(extract.parse("<div><p>a<p>b<h1>c</div>"))[1:] == ([0, 0, 1], ["a", "b", "c"])
    assert Texts(__import__("pyarrow").array(["ab", None, "c"])).offs.tolist() == [0, 2, 2, 3]


@pytest.mark.parametrize("page", [
    "<body class='single has-sidebar'><article><p>own</p></article></body>",
    "<body class='sidebar'><div><p>own</p></div></body>",
    "<main class='content with-sidebar'><p>own</p></main>",
    "<article class='post no-comments'><p>own</p></article>",
    "<article class='post social'><p>own</p></article>",
    "<div id='page' class='search-off'><p>own</p></div>",
    "<div class='page sidebar'><main><p>own</p></main></div>",
    "<article><p>own</p></article><div class='comments'><article class='comment'><p>said</p></article></div>",
    "<article><p>own</p><div class='related'><p>other</p></div></article><article class='promo'><p>bought</p></article>",
    "<div><p>own</p></div><div class='sidebar'><p>side</p></div>",
])
def test_names_do_not_drop_what_frames_the_content(page):
    shape, leaf, runs = extract.shape_of(extract.parse(page))
    keep = extract.wrapper(shape, shape)[1]
    assert [r for k, r in zip(leaf, runs) if keep[k]] == ["own"]


def _plain_match(x, y):
    """Simple tree matching as it is defined, without any shortcut."""
    if x[0] != y[0]:
        return 0
    best = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
    for i, p in enumerate(x[1]):
        for j, q in enumerate(y[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + _plain_match(p, q))
    return best[-1][-1] + 1


def test_tree_matching_against_brute_force():
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return "#"
        return f"{rng.choice('abc')}({' '.join(tree(depth - 1) for _ in range(rng.randint(1, 4)))})"

    def labels(node, path=()):
        path = (*path, node[0])
        return {node[2]: path} if not node[1] else {k: v for c in node[1] for k, v in labels(c, path).items()}

    for _ in range(300):
        a, b = extract.read_shape(f"r({tree(4)} {tree(4)})"), extract.read_shape(f"r({tree(4)} {tree(4)})")
        size, pairs = extract.tree_match(a, b)
        assert size == _plain_match(a, b)
        x, y = labels(a), labels(b)
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_deep_and_long_pages(spark):
    """5 000 unclosed blocks, 10 000 alternating ones against a seed of 9 000, elements without an end tag."""
    long = lambda n, more: "<body>" + "".join(f"<h2>head {k}</h2><p>text {k}</p>" for k in range(n // 2)) + more + "</body>"
    pages = [(1, "http://a/1", "<div>" * 5000 + "deep"), (2, "http://b/1", long(10_000, "<h3>x</h3>")), (3, "http://b/2", long(9_000, "<pre>y</pre>")),
             (4, "http://c/1", "<p>before <svg><path> after</p><p>tail"), (5, "http://c/2", "<p>a <math><mi>x</mi></math> b <object>fallback</object></p><title>t"),
             (6, "http://d/1", "<article><section class='related-work'>r</section><h2 class='share-price'>s</h2><div class='social-share'>no</div><p>t</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.id: r.text for r in extract.main_text(df).collect()}
    assert got[1] == "deep" and got[4] == "before after\ntail" and got[5] == "a x b fallback\nt" and got[6] == "r\ns\nt"
    assert got[2].count("\n") == 10_000 and got[3].count("\n") == 9_000
