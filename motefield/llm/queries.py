"""The numbered queries with their SQL twins. Each is a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op3_exact_dedup(spark, folder):
    from motefield.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_decontamination", """
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    bg AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM bg),
    dg AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
    hits AS (SELECT doc_id, i, m, item_id FROM dg JOIN bg USING (m, g)),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op6_decontamination(spark, folder):
    from motefield.llm.decontaminate import contamination, is_contaminated

    found = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=["doc_id"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


@query("op9_packing")
def op9_packing(spark, folder):
    import public_tokenizers

    from motefield.llm.packing import packed

    return packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op5_substring_dedup", """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
    rep AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
    cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM rep),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n
             FROM words ANTI JOIN cut USING (doc_id, k) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark, folder):
    from motefield.llm.substring_dedup import substring_dedup

    found = substring_dedup(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_minhash_dedup", """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
    comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)""")
def op2_minhash_dedup(spark, folder):
    from motefield.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"), shingle=3, share=85)
    return found.withColumnRenamed("id", "doc_id")


@query("op1_quality_discriminant")
def op1_quality_discriminant(spark, folder):
    from motefield.llm.quality import classified

    return classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_language_id")
def op4_language_id(spark, folder):
    import public_tokenizers

    from motefield.llm.langid import identified

    return identified(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_warc_revisits", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first,
                 list_transform(range(0, 32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + CAST(
                   (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT)]) AS c FROM p)
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(c, '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d""")
def op7_warc_revisits(spark, folder):
    from motefield.llm.warc import archived

    return archived(table(spark, folder, "pages")).drop("archive")


@query("op10_main_text")
def op10_main_text(spark, folder):
    from motefield.llm.extract import main_text

    found = main_text(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_line_dedup", r"""
    WITH l AS (SELECT doc_id, k, list_extract(x, k) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k)),
    t AS (SELECT doc_id, k, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
    s AS (SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p FROM t WHERE line <> ''),
    d AS (SELECT doc_id, list(line ORDER BY p) AS lines, list(w ORDER BY p) AS ws FROM s GROUP BY 1),
    r AS (SELECT doc_id, p, n, array_to_string(lines[p:p + n - 1], chr(10)) AS run FROM (SELECT *, unnest(range(1, len(lines) - n + 2)) AS p
          FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM d)) WHERE list_sum(ws[p:p + n - 1]) >= 10),
    later AS (SELECT doc_id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY n, md5(run) ORDER BY doc_id, p) AS c FROM r) WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM later),
    kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY k) AS txt FROM t WHERE NOT EXISTS (SELECT 1 FROM s JOIN gone USING (doc_id, p) WHERE s.doc_id = t.doc_id AND s.k = t.k) GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
    SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
    FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op8_line_dedup(spark, folder):
    from motefield.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_token_alignment")
def op11_token_alignment(spark, folder):
    import public_tokenizers

    from motefield.llm.alignment import aligned

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), _pieces(), keep=["doc_id"], digest=True).withColumnRenamed("groups", "groups_sha256")


@query("op12_sentencepiece")
def op12_sentencepiece(spark, folder):
    from motefield.llm.sentencepieces import decoded, encoded

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decoded(encoded(docs, _pieces(), keep=["doc_id"]), _pieces())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, folder):
    from motefield.llm.conversations import damaged, repaired

    turns = table(spark, folder, "conversations")
    return repaired(damaged(turns), ids=turns)
