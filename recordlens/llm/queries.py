"""One query per operator over its whole table, in the form the operator's contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm import (
    bpe,
    collocations,
    decontaminate,
    html_text,
    language_id,
    lexical_search,
    packing,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)

#: File of the public tokenizer that the contracts name.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence: text, declaration, and the source as host; documents have no address."""
    return language_id.identify(
        table(spark, sf_dir, "documents"), declared=language_id.declared_language("lang"),
        host=F.col("source"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages, with the markup's declaration, the address's host and its suffix."""
    pages = table(spark, sf_dir, "pages")
    pages = pages.withColumns({
        "words": F.regexp_replace("html", r"(?is)<(script|style|title)\b.*?</\1\s*>|<[^>]*>", " "),
        "markup": language_id.markup_language("html")})
    host = language_id.host_of("url")
    return language_id.identify(
        pages, "page_id", "words", language_id.declared_language("markup"), host,
        language_id.suffix_of(host)).withColumnRenamed("doc_id", "page_id")


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "covered_fraction", "longest_repeat")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label columns are the categories: low quality first, which then informs toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), {
        "low_quality": "quality = 0", "toxic": "toxic = 1"})
    return toxicity.classify(docs, chain)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_de_bruijn_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, shortest=2,
                                     least=10, share=50, top=2000)


def op13_dense_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {q.__name__: q for q in (
    op1_best_fit_packing, op2_suffix_array_dedup, op3_language_evidence, op4_warc_normaliser,
    op5_feistel_sharding, op6_simhash_components, op7_suffix_repetition,
    op8_template_decontamination, op9_toxicity_chain, op10_main_text, op11_pair_index_bpe,
    op12_de_bruijn_collocations, op13_dense_block_search, pages_language)}
#: SQL for the queries that it can express. Tokenizers, XXH64 with a seed, CRC-32, suffix order and
#: fitted models are not in it; tests hold those queries against brute force.
ORACLES: dict[str, str] = {
    "op4_warc_normaliser": """
        WITH hexed AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                 sha1(coalesce(html, '')) AS sha FROM pages),
        bits AS (
          SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: lpad(bin(
                   strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM hexed),
        coded AS (
          SELECT page_id, payload_bytes, sha, array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER)
                          + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                          + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
                          + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
                          + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '')
                   AS payload_digest,
                 min(page_id) OVER (PARTITION BY sha) AS least FROM bits)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to FROM coded""",
    "op12_de_bruijn_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
                   coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        runs AS (
          SELECT lang, m AS words, unnest(list_transform(range(1, len(w) - m + 2),
                   lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
          FROM lists, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m),
        f AS (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
        candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
        longer AS (
          SELECT lang, phrase, max(f) AS most FROM (
            SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')])
                     AS phrase FROM candidates WHERE words = 3) GROUP BY ALL),
        kept AS (
          SELECT candidates.* FROM candidates LEFT JOIN longer USING (lang, phrase)
          WHERE most IS NULL OR words = 3 OR 100 * most < 50 * f),
        cuts AS (
          SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head,
                 array_to_string(w[k + 1:], ' ') AS tail
          FROM kept, (VALUES (1), (2)) AS t(k) WHERE k < words),
        scored AS (
          SELECT cuts.*, x.f AS l, y.f AS r,
                 (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head
          JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (
                   PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
                 AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op13_dense_block_search": r"""
        WITH lists AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM lists WHERE len(w) > 0),
        asked AS (
          SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
          GROUP BY ALL),
        tf AS (
          SELECT doc_id, n, term, count(*) AS tf FROM (
            SELECT doc_id, len(w) AS n, unnest(w) AS term FROM lists)
          WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
          SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
        hits AS (
          SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (
                   1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
          FROM tf JOIN asked USING (term) JOIN weights USING (term), whole GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                 ::INTEGER AS rank, doc_id, score
        FROM hits WHERE score > 0 QUALIFY rank <= 20""",
}
