"""The queries of the operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, ann, bpe, embdedup, langid, licenses, packing, quality, runs, simhash, substring, suffix, tokenio
from millrace.llm.scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs), "text", "lang", F.col("doc_id"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, table = batch.column(1), bpe.tokens(vocabulary)
        numbers = pa.array([str(i) for i in range(len(table))])
        texts, decoded = bpe.joined(ids, numbers, " "), bpe.joined(ids, table, b"")
        columns = [batch.column(0), pc.list_value_length(ids).cast(pa.int64())]
        for found in (texts.cast(pa.binary()), decoded):
            columns.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in found]))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, then=digest, schema=schema)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenio.write_token_file(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    read = tokenio.read_chunks(spark, path).select(
        "shard",
        "chunk",
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return tokenio.with_starts(spark, path, read)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.cascade(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.REPORTED, "base_failed", "kept")


def periodic_end(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as op12 looks at them: in a tenth of the documents, chosen by id, all behind a place repeat what follows it."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    again = words[at : at + period]
    return words[:at] + (again * ((n - at) // period + 1))[: n - at]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periodic_end)
    numbers = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
    digests = F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")
    return found.select(*numbers, *digests)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(_table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select(*found.columns[:-1], digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_embedding_dedup,
            op3_best_fit_packing,
            op4_bpe,
            op5_simhash,
            op6_substring_dedup,
            op7_suffix_dedup,
            op8_token_file,
            op9_nearest,
            op10_license_scan,
            op11_quality_rules,
            op12_periodic_runs,
            op13_tokenizer_alignment,
        )
    }


def _license_sql() -> str:
    def canon(text: str) -> str:
        out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, new in licenses.RULES:
            out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
        for spelling, usual in licenses.SPELLINGS:
            out = f"replace({out}, '{spelling}', '{usual}')"
        return f"sha256(trim({out}, ' '))"

    known = ", ".join(
        "({}, {}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in licenses.KNOWN
    )
    return f"""
WITH known AS (SELECT {canon("body")} AS digest, min(license_id) AS license_id, arg_min(kind, (license_id, kind)) AS kind
               FROM (VALUES {known}) AS t(license_id, kind, body) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id, k.kind
FROM (SELECT doc_id, {canon("text")} AS digest FROM documents) d LEFT JOIN known k ON k.digest = d.digest"""


#: Links of all pairs with equal labels, and what each vector reaches.
_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS MATERIALIZED (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

#: Every window of words as text, those that start twice, and the words that they cover.
_SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + {substring.WINDOW - 1}], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM d)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS i FROM windows SEMI JOIN twice USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _quality_sql() -> str:
    """Each rule over all documents, by rows of words, windows and lines."""
    blank = " \\t\\x0B\\f\\r"

    def top(n: int) -> str:
        return f"""(SELECT doc_id, max(most) AS top{n} FROM (
            SELECT doc_id, count(*) * any_value(strlen(array_to_string(g, ''))) AS most
            FROM (SELECT doc_id, w[i : i + {n - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d))
            GROUP BY doc_id, g HAVING count(*) > 2) GROUP BY doc_id)"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeat AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat FROM (
        SELECT doc_id, unnest(range(i, i + 3)) AS place
        FROM windows SEMI JOIN (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1) USING (doc_id, s))
    GROUP BY doc_id),
lines AS (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^{blank}]') GROUP BY doc_id, line),
of_lines AS (
    SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS dup, sum((n - 1) * length(line)) AS dup_chars,
           sum(n) FILTER (regexp_matches(line, '^[{blank}]*([-*]|•)')) AS bullets,
           sum(n) FILTER (regexp_matches(line, '([.][.][.]|…)[{blank}]*$')) AS ellipses
    FROM lines GROUP BY doc_id),
m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, strlen(array_to_string(w, '')) AS word_bytes,
           length(text) AS chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars,
           len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letterless,
           coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses,
           coalesce(top2, 0) AS top2, coalesce(top3, 0) AS top3, coalesce(top4, 0) AS top4
    FROM d LEFT JOIN repeat USING (doc_id) LEFT JOIN of_lines USING (doc_id)
    LEFT JOIN {top(2)} USING (doc_id) LEFT JOIN {top(3)} USING (doc_id) LEFT JOIN {top(4)} USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * dup_chars > 20 * chars OR 100 * letterless > 20 * n_words OR 100 * bullets > 90 * n_lines
            OR 100 * ellipses > 30 * n_lines OR 100 * top2 > 20 * word_bytes OR 100 * top3 > 18 * word_bytes
            OR 100 * top4 > 16 * word_bytes) AS kept
FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": _EMBEDDING_SQL,
        "op6_substring_dedup": _SUBSTRING_SQL,
        "op10_license_scan": _license_sql(),
        "op11_quality_rules": _quality_sql(),
    }
