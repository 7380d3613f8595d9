"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bpe, embed_dedup, html_extract, langid, line_dedup, packing, quality, resample, secrets, shards, simhash, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS dropped
  FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.in_fold(5, 0)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), train=~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.in_fold(3, 1)
    model = langid.learn(docs, train=~held)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(65533)) AS text FROM documents),
rules(kind, turn, re, at_least) AS (VALUES
  ('assign', 1, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 2, '(AKIA[A-Z0-9]+)()', 20),
  ('hex', 3, '([0-9a-f]{24,})()', 24),
  ('private_key', 4, '(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\x20\x09-\x0D\\-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,})*))()', 0),
  ('github', 5, '(gh[opsu]_[A-Za-z0-9]{36})()', 0),
  ('google', 6, '(AIza[0-9A-Za-z_-]{35})()', 0),
  ('slack', 7, '(xox[abprs]-[A-Za-z0-9-]{10,})()', 0),
  ('stripe', 8, '([rs]k_live_[A-Za-z0-9]{16,})()', 0),
  ('jwt', 9, '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})()', 0)),
m AS (SELECT doc_id, kind, turn, re, at_least,
             string_split(regexp_replace(text, re, chr(1) || '\0' || chr(1), 'g'), chr(1)) AS pieces
      FROM t, rules WHERE regexp_matches(text, re)),
p AS (SELECT doc_id, kind, turn, re, at_least, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM m),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM p),
s AS (SELECT doc_id, kind, turn, CAST(stop - length(piece) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM o
      WHERE n % 2 = 0 AND length(CASE WHEN kind = 'assign' THEN regexp_extract(piece, re, 2) ELSE piece END) >= at_least),
g AS (SELECT doc_id,
             count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn) FILTER (WHERE turn <= 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query("op8_secret_scans", OP8_SQL)
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.coding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op11_kd_sharding")
def op11_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.kd_shards(table(spark, sf_dir, "documents"), shards.SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, 0 AS kind, text FROM documents
  UNION ALL SELECT NULL, -row_number() OVER (), 1, text FROM benchmark),
lists AS (
  SELECT doc_id, row, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM texts),
counted AS (SELECT row, kind, word, count(*) AS n FROM (SELECT row, kind, unnest(list) AS word FROM lists) GROUP BY ALL),
-- CRC-32 of a word's bytes, four bits at a time, low ones first
steps(step) AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[]),
hexed AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM counted)),
nibbles AS (
  SELECT word, flatten([[strpos('0123456789ABCDEF', digits[2 * i]) - 1, strpos('0123456789ABCDEF', digits[2 * i - 1]) - 1]
                        for i in range(1, length(digits) // 2 + 1)])::BIGINT[] AS low_first FROM hexed),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, low_first),
                               lambda crc, x: xor(crc >> 4, step[(xor(crc, x) & 15) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM nibbles, steps),
filled AS (SELECT kind, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (WHERE kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0)::DOUBLE AS t FROM filled),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE kind = 1), 0)::DOUBLE + 1) * (any_value(s) + 10000)
                                 / ((coalesce(sum(n) FILTER (WHERE kind = 0), 0)::DOUBLE + 1) * (any_value(t) + 10000))))::BIGINT AS gain
  FROM filled, sums GROUP BY bucket),
weighed AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(list) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM lists LEFT JOIN weighed USING (row) WHERE kind = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS among FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + noise AS score,
       CASE WHEN n_words >= 20 AND place <= 10 * among // 100 THEN place END AS rank
FROM ranked
"""


@query("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
