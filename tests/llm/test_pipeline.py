"""The pipeline's stages against brute force, on a table with the awkward cases."""

import public_tokenizers
import pytest
from fixture import blank_words, documents
from test_dedup import reachable, shingles, without_lines
from test_text import alnum
from tokenizers import Tokenizer

import corpus_pipeline
from motefield.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in documents(3)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    passage = " ".join((documents(3)[-1][1] or "a b c " * 9).split()[:20])
    bench = [(1, passage), (2, None), (3, "x y z w x y z w x y z w x")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(len(t or "") > 100), 0) for i, t in documents(3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], folder).cache())
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[:-1])

    scores = quality.classified(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert set(texts[1]) == {r.doc_id for r in scores if r.predicted == 1}

    lines = without_lines(sorted(texts[1].items()), 10)
    assert texts[2] == {i: t for i, (n, gone, t) in lines.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text or "") for r in steps[2].collect())

    sets = {i: shingles(t, 5) for i, t in texts[2].items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = reachable(sets, links)
    assert texts[3] == {i: t for i, t in texts[2].items() if top[i] == i}

    items = [alnum(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    keep = {}
    for i, t in texts[3].items():
        w, hit = alnum(t), set()
        for b in items:
            n = min(13, len(b))
            for at in range(len(w) - n + 1) if n else ():
                if any(w[at:at + n] == b[k:k + n] for k in range(len(b) - n + 1)):
                    hit.update(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            keep[i] = t
    assert texts[4] == keep

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert set(pieces) == set(keep)
    for i, t in keep.items():
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == coder.encode(t or "", add_special_tokens=False).ids + [2]


def test_run_equals_the_stages_and_takes_empty_tables(spark, folder, tmp_path):
    got = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got and len({d for d, _, _ in got}) <= len(documents(3))
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_page_and_document_stages_keep_words(spark, folder):
    """No stage but line dedup changes a text."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = corpus_pipeline.near_stage(spark, docs, folder).collect()
    texts = dict(documents(3))
    assert near and all(blank_words(r.text) == blank_words(texts[r.doc_id]) for r in near)
