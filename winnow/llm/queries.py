"""The operators applied to the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import alignment, hnsw, kneser, language, lines, mixing, packing, pairwise, phrases, rans, simhash, tagpaths, warc
from winnow.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder("doc_id", 4) == 2
    net = language.fit(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read_warc(spark, path, payload=False))
    return found.select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return lines.quality(docs).select("doc_id", *names)


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 7) == 2
    model = kneser.train(docs.filter(~held_out))
    return kneser.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    rans.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return rans.read_digests(spark, path)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 4) == 2
    model = pairwise.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    return pairwise.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op12_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.cross_tokenizer(docs, public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_warc_salvage, op3_line_frequency, op4_vector_links, op5_kneser_ney, op6_tag_paths, op7_best_fit_packing,
        op8_rans_tokens, op9_simhash, op10_water_filling, op11_pairwise_quality, op12_phrase_streams,
        op13_token_alignment,
    )
}

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {warc.MIN_REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.MIN_REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to
FROM r"""

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINES_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {SQL_WORDS} AS words FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
  unnest(list_transform(range(1, len(words) - 3), lambda x: array_to_string(words[x:x + 4], ' '))) AS w FROM d),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM places),
repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM
  (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
frequent AS (SELECT source, norm, arg_min(text, doc_id) AS first FROM worded GROUP BY source, norm HAVING count(DISTINCT doc_id) > {lines.MIN_DOCUMENTS}),
removed AS (SELECT doc_id, sum(w.n) AS n FROM worded w JOIN frequent f ON w.source IS NOT DISTINCT FROM f.source AND w.norm = f.norm
  WHERE w.text <> f.first GROUP BY doc_id),
base AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
  coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0) AS gone
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
ruled AS (SELECT *, n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (gone > 0 AND (n_words - gone < {lines.MIN_WORDS} OR 100 * (n_words - gone) < {lines.MIN_KEPT_PERCENT} * n_words))) AS kept
FROM ruled"""

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size, md5(doc_id::VARCHAR || ':{mixing.SEED}') AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM t),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM r),
q AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM q),
m AS (SELECT max(CASE WHEN lvl < ratio THEN lvl END) AS lam FROM v),
g AS (SELECT source, source_size, CASE WHEN lam * weight::DOUBLE < cap::DOUBLE THEN lam * weight::DOUBLE ELSE cap::DOUBLE END AS target FROM v, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole FROM g),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - (p.whole * p.source_size)::DOUBLE AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN before + size::DOUBLE / 2e0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o"""

PHRASE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
e AS (SELECT lang, s.k AS k, ws, unnest(range(1, len(ws) - s.k + 2)) AS i FROM w, (SELECT unnest(range(1, {phrases.MAX_WORDS + 1})) AS k) s WHERE len(ws) >= s.k),
c AS (SELECT lang, k, ws[i:i + k - 1] AS g, count(*)::HUGEINT AS a FROM e GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
scored AS (SELECT x.lang, x.g, x.a, x.cut, f.a AS l, s.a AS r, n, (1000 * x.a * n) // (f.a * s.a) AS score
  FROM cuts x JOIN c f ON f.lang = x.lang AND f.g = x.g[1:x.cut] JOIN c s ON s.lang = x.lang AND s.g = x.g[x.cut + 1:x.k] JOIN t ON t.lang = x.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (SELECT lang, ws, a, i, j FROM (SELECT lang, g AS ws, a, k, unnest(range(1, k)) AS i FROM c WHERE k > 2) y, LATERAL (SELECT unnest(range(i + 1, k + 1)) AS j)
  WHERE j - i + 1 < k),
covered AS (SELECT lang, ws[i:j] AS g, max(a) AS a FROM longer GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, array_to_string(w.g, ' ')) AS rank,
  array_to_string(w.g, ' ') AS phrase, w.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM worst w LEFT JOIN covered v ON v.lang = w.lang AND v.g = w.g
WHERE v.a IS NULL OR 100 * v.a < {phrases.COVER_PERCENT} * w.a
QUALIFY rank <= {phrases.TOP}"""

ORACLES = {"op2_warc_salvage": WARC_SQL, "op3_line_frequency": LINES_SQL, "op10_water_filling": MIX_SQL, "op12_phrase_streams": PHRASE_SQL}
