"""The queries opN_<name>: thin wrappers that apply each operator to its whole table and derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, html_text, language, licenses, lm, merkle, ngram_join, quality, simhash, token_counts, token_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *(F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.col("near")["class_id"].alias("class_id"), F.col("near")["n_links"].alias("n_links"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i+4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), z AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r
), l AS (
  SELECT p.a, p.b FROM p JOIN z za ON za.r = p.a JOIN z zb ON zb.r = p.b WHERE 10 * p.n >= 8 * (za.n + zb.n - p.n)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), c AS (
  SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a
), n AS (
  SELECT a AS r, count(*) AS n FROM e GROUP BY a
)
SELECT d.doc_id, c.class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links FROM d JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r
"""


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
), m AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.r = w.r
), v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         greatest(n_words, 1)::DOUBLE AS n, greatest(n_lines, 1)::DOUBLE AS nl, greatest(word_chars, 1)::DOUBLE AS nc FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / n BETWEEN 2.0 AND 15.0 AND n_symbols / n <= 0.10 AND n_stop / n >= 0.02
       AND n_dup_lines / nl <= 0.60 AND n_words / nl >= 1.5 AND n_upper / nc <= 0.50 AS kept
FROM v
"""

def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder (a null id: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(3, 1)))
    x = language.identify(docs.select("doc_id", "text", held_out(3, 1).alias("held_out")), model)
    return x.select("doc_id", "held_out", F.col("language")["lang"].alias("lang_pred"), F.col("language")["score"].alias("score"), F.col("language")["rejected"].alias("rejected"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.where(~held_out(7, 2))
    counts = lm.count(rows)
    model = lm.fit(rows, counts)
    x = lm.score(docs.withColumn("held_out", held_out(7, 2)), model, counts, keep_text=False)
    f = F.col("lm")
    return x.select("doc_id", "held_out", f["n_tokens"].alias("n_tokens"), f["n_known"].alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), f["base_score"].alias("base_score"), f["score"].alias("score"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.withColumn("n_chars", F.length("text").cast("long"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_records.read(spark, token_records.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col("licenses")
    return x.select(
        "doc_id", *(f[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")),
        F.array_join(f["base_labels"], ",").alias("base_labels"), F.array_join(f["labels"], ",").alias("labels"), F.round(f["score"], 6).alias("score"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"('{t.label}', {_sql_list(t.words)}, {_sql_list(t.key)}, {t.before}, {str(t.base).upper()})" for t in licenses.TEMPLATES)

OP5_SQL = rf"""
WITH t(label, notice, phrase, ahead, base) AS (VALUES {_TEMPLATES}), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), hit AS (
  SELECT r, w, label, notice, ahead, base, i FROM (SELECT r, w, t.*, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, t WHERE len(w) >= len(phrase) AND list_contains(w, phrase[-1]))
  WHERE w[i:i + len(phrase) - 1] = phrase
), word AS (
  SELECT r, label, base, i, len(notice) AS size, notice[q] AS x, CASE WHEN i - ahead - 1 + q >= 1 THEN w[i - ahead - 1 + q] END AS y FROM (SELECT *, unnest(range(1, len(notice) + 1)) AS q FROM hit)
), share AS (
  SELECT r, label, base, i, size, count(*) FILTER (WHERE x = y) / size AS s FROM (SELECT *, row_number() OVER () AS u FROM word) GROUP BY r, label, base, i, size
), one AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(i - 1) FILTER (WHERE base) AS first_word, max(i - 1) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r
), best AS (
  SELECT r, max(s) AS s FROM share GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(s, 0.0)::DOUBLE, 6) AS score
FROM d LEFT JOIN one ON one.r = d.r LEFT JOIN best ON best.r = d.r
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    f = F.col("found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, k, i, array_to_string(w[i:i+k-1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT r, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN found ON found.r = d.r
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return x.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048).drop("text")


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*MANIFEST_COLUMNS)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    x = merkle.manifest(docs, MANIFEST_COLUMNS, "doc_id", "lang", (changed, {"n_chars": F.col("n_chars") + 1}), drop=["source", "lang", "n_chars", "text"])
    f = F.col("merkle")
    return x.select("doc_id", f["leaf"].alias("leaf"), f["subroot"].alias("subroot"), f["root"].alias("root"), f["proof"].alias("proof_sha256"), f["folded"].alias("folded_root"), f["verified"].alias("verified"))


#: DuckDB has no crc32, so its table is built bit by bit and run over the digits of each id.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT 0 AS step, i, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT step + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc_table WHERE step < 8
), crc_list AS (
  SELECT list(c ORDER BY i) AS t FROM crc_table WHERE step = 8
), ids AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, s, 1 AS i, 4294967295::UBIGINT AS c FROM ids
  UNION ALL SELECT doc_id, s, i + 1, xor(c >> 8, t[CAST(xor(c, ord(s[i])::UBIGINT) & 255 AS INTEGER) + 1]) FROM crc, crc_list WHERE i <= len(s)
), chosen AS (
  SELECT doc_id, xor(c, 4294967295::UBIGINT) % 7 = 0 AS changed FROM crc WHERE i = len(s) + 1
), field AS (
  SELECT d.*, row_number() OVER () AS row, coalesce(changed, false) AS changed FROM documents d LEFT JOIN chosen USING (doc_id)
), leaves AS (
  SELECT row, doc_id, coalesce('=' || lang, '') AS g, sha256(p || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || q) AS leaf,
         sha256(p || coalesce(strlen(CAST(n_chars + changed::INTEGER AS VARCHAR)) || ':' || (n_chars + changed::INTEGER), '-') || q) AS seen
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS p, coalesce(strlen(text) || ':' || text, '-') AS q FROM field)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos FROM leaves
), tree AS (
  SELECT g, 0 AS k, list(leaf ORDER BY pos) AS l FROM placed GROUP BY g
  UNION ALL SELECT g, k + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM tree WHERE len(l) > 1
), subroots AS (
  SELECT g, l[1] AS subroot, k AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE len(l) = 1
), upper AS (
  SELECT 0 AS k, list(subroot ORDER BY pos) AS l FROM subroots
  UNION ALL SELECT k + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM upper WHERE len(l) > 1
), top AS (
  SELECT l[1] AS root FROM upper WHERE len(l) = 1
), siblings AS (
  SELECT row, k AS step, (pos >> k) & 1 AS side, coalesce(l[xor(pos >> k, 1) + 1], '') AS h FROM placed JOIN tree USING (g) WHERE len(l) > 1
  UNION ALL SELECT row, height + k, (s.pos >> k) & 1, coalesce(l[xor(s.pos >> k, 1) + 1], '') FROM placed JOIN subroots s USING (g), upper WHERE len(l) > 1
), path AS (
  SELECT row, list(side ORDER BY step) AS sides, list(h ORDER BY step) AS hs FROM siblings GROUP BY row
), folded AS (
  SELECT row, seen AS h, 1 AS i FROM placed
  UNION ALL SELECT f.row, CASE WHEN sides[i] = 1 THEN sha256(hs[i] || h) ELSE sha256(h || hs[i]) END, i + 1 FROM folded f JOIN path ON path.row = f.row WHERE i <= len(hs)
), ends AS (
  SELECT f.row, h FROM folded f LEFT JOIN path ON path.row = f.row WHERE i = coalesce(len(hs), 0) + 1
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(hs, ''), '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN subroots USING (g) JOIN ends ON ends.row = placed.row LEFT JOIN path ON path.row = placed.row, top
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), total AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 4) t(k) WHERE len(w) >= k)) GROUP BY ALL
), cand AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10
), cut AS (
  SELECT lang, phrase, w, a, j, array_to_string(w[:j], ' ') AS p, array_to_string(w[j+1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)
), scored AS (
  SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, j, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.p JOIN f y ON y.lang = cut.lang AND y.phrase = cut.q
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[i:i+1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM cand WHERE k = 3)) GROUP BY ALL
), best AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT best.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
"""


def op13_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    f = F.col("simhash")
    return x.select("doc_id", f["fingerprint"].alias("fingerprint"), f["component_id"].alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op10_ngram_join": op10_ngram_join,
    "op2_html_text": op2_html_text,
    "op3_language_id": op3_language_id,
    "op4_token_records": op4_token_records,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_collocations": op12_collocations,
    "op13_simhash_near": op13_simhash_near,
}
ORACLES: dict[str, str] = {"op5_license_scan": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_ngram_join": OP10_SQL, "op8_quality_rules": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_collocations": OP12_SQL}
