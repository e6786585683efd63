"""The registered queries of this subpackage: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import bpe, licences, linededup, packing, rules, simhash, spans, tiff, toxicity, warc

try:
    import public_tokenizers

    WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
except ImportError:  # the vocabulary files are an option of the box; the operators take any path
    WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derivative records for each page."""
    return warc.derive(warc.page_responses(_table(spark, sf_dir, "pages")), keep=("page_id",))


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_media(_table(spark, sf_dir, "documents"))
    pages = tiff.tiff_pages(media, keep=("doc_id", "n_bytes", "media"))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "width",
        "height",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), WORD_BPE)


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_scores(_table(spark, sf_dir, "documents"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: source, language, a directory for 64 ids; some are that tree's licence files."""
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    source, lang = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und"))
    block = F.floor(number / 64).cast("string")
    return docs.withColumn(
        "path",
        F.when(number % 1024 == 0, F.concat_ws("/", source, F.lit("LICENSE")))
        .when(number % 256 == 0, F.concat_ws("/", source, lang, F.lit("COPYING")))
        .when(number % 16 == 0, F.concat_ws("/", source, lang, block, F.lit("LICENSE.txt")))
        .otherwise(F.concat_ws("/", source, lang, block, F.concat(number.cast("string"), F.lit(".txt")))),
    )


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(document_files(_table(spark, sf_dir, "documents")), keep=("doc_id",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_derivatives,
        op2_tiff_media,
        op3_best_fit_packing,
        op4_nnpu_toxicity,
        op5_line_winnowing,
        op6_simhash_variants,
        op7_sentence_spans,
        op8_bpe_words,
        op9_rule_cascade,
        op10_licence_scan,
    )
    return {f.__name__: f for f in found}


RULE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM pos),
twice AS (SELECT rid, k FROM win GROUP BY rid, k HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, i + j AS p FROM win JOIN twice USING (rid, k) CROSS JOIN (SELECT unnest(range(0, 8)) AS j)),
rep AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
nb AS (SELECT rid, count(*) FILTER (a = b) AS n FROM (SELECT rid, unnest(ws[1:len(ws) - 1]) AS a, unnest(ws[2:len(ws)]) AS b FROM w WHERE len(ws) > 1) GROUP BY rid),
f AS (
  SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines, coalesce(nb.n, 0) AS n_same
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN nb USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 2 * n_dup_lines > n_lines OR 5 * n_same > n_words) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    """Only the rules are within SQL; the tests hold the others against brute force."""
    return {"op9_rule_cascade": RULE_SQL}
