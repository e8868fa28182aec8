"""One named query per operator over the whole tables of a folder, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import bpe, decontam, fim, jaccard, langid, packing, phrases, quality, rules, shards, suffixes, urls, warc
from ripplegraph.llm.common import read

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived_pages(spark, read(spark, sf_dir, "pages"))
    return records.select(
        F.col("id").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(read(spark, sf_dir, "documents"), vocabulary())
    crc = F.crc32("ids").alias("ids_crc32")
    return packing.packed_with(pieces.select("doc_id", "piece", "start", "length", crc))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.without_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = _fold(3) == 1
    found = langid.predict(docs, langid.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("hits", "text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), RULES)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold(4) == 2
    found = quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.placed(read(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    found = bpe.decoded(bpe.encoded(read(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transformed(read(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fim.restored(), "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_best_fit_packing, op3_suffix_dedup, op4_language_id, op5_decontamination, op6_quality_rules, op7_jaccard_join,
        op8_url_filters, op9_quality_classifier, op10_sharding, op11_bpe, op12_phrases, op13_fill_in_middle,
    )
}
_DUCK_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_DUCK_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DUCK_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"

ORACLE: dict[str, str] = {
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_DUCK_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_DUCK_WORDS} AS ws FROM benchmark),
        starts AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, list_slice(ws, p, p + 9) AS win FROM starts),
        single AS (SELECT DISTINCT win, len(win) AS n FROM win),
        place AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
        next AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM place),
        cut AS (SELECT doc_id, p, n, list_slice(ten, 1, n) AS win FROM next, (SELECT DISTINCT n FROM single)),
        hits AS (SELECT doc_id, p, single.n, win FROM cut JOIN single USING (win)),
        words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hits) GROUP BY doc_id),
        met AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN win USING (win)),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM met GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    # the pages of the test tables have neither canonical links nor refreshes, so no aliases
    "op8_url_filters": f"""
        WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        ruled AS (SELECT *, CASE WHEN {_DUCK_FITS.format('www.example.com', '/en/')} THEN 'www.example.com/en/'
                                 WHEN {_DUCK_FITS.format('example.com', '/en/')} THEN 'example.com/en/'
                                 WHEN {_DUCK_FITS.format('net', '/es/')} THEN 'net/es/'
                                 WHEN {_DUCK_FITS.format('net', '/fr/')} THEN 'net/fr/'
                                 WHEN {_DUCK_FITS.format('com', '/')} THEN 'com/' END AS rule FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op12_phrases": f"""
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_DUCK_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        worded AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM piece),
        gram AS (SELECT lang, list_slice(ws, i, i + k - 1) AS g, k FROM (
            SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS v(k))),
        f AS (SELECT lang, g, k, count(*)::HUGEINT AS a FROM gram GROUP BY ALL),
        total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        longer AS (SELECT lang, g, max(a) AS most FROM (
            SELECT lang, g[1:2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM cand WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT cand.* FROM cand LEFT JOIN longer USING (lang, g) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
        cut AS (SELECT lang, g, k, a, unnest(range(1, k)) AS c FROM kept),
        way AS (SELECT cut.lang, cut.g, cut.a, c, l.a AS l, r.a AS r, (1000000 * cut.a * cut.a) // (l.a * r.a) AS score
                FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.g[1:c] JOIN f r ON r.lang = cut.lang AND r.g = cut.g[c + 1:cut.k]),
        least AS (SELECT * FROM way QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
        best AS (SELECT *, array_to_string(g, ' ') AS phrase,
                        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM least)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM best JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op13_fill_in_middle": """
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        units AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
                         [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM drawn),
        formed AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                          least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS low, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS high FROM units),
        cut AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m,
                       coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM formed)
        SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM cut
    """,
}
