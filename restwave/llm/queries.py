"""The registered queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restwave.llm import bpe, classifier, html, lexical, mixing, neighbours, rules, secrets, sequences, simhash, substrings, urls, whitening

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sequences.write_sequences(table(spark, sf_dir, "documents"), sequences.new_folder(spark))
    return sequences.read_documents(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors.where("vec_id % 20 = 0"), neighbours.build_index(vectors))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), filters, keep=["page_id"])


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["past"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("explained", F.col("place")).alias("explained"), "identity_error")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_substrings, op3_simhash, op4_sequences, op5_line_rules, op6_bpe, op7_mixing,
                                    op8_neighbours, op9_main_text, op10_url_filter, op11_secrets, op12_lexical, op13_whitening, pipeline)}


OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS f FROM k GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (s) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
marked AS (SELECT words.*, gone.j IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, j)),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n, string_agg(word, ' ' ORDER BY j) FILTER (NOT out) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, s FROM k GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM k JOIN twice USING (doc_id, s)) GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS all_docs FROM d GROUP BY source),
often AS (SELECT lines.source, norm, min(doc_id) AS first FROM lines JOIN hosts ON lines.source IS NOT DISTINCT FROM hosts.source GROUP BY lines.source, norm
    HAVING count(DISTINCT t) > 4 AND (min(n) > 2 OR count(DISTINCT t) > 20 OR count(DISTINCT t) > 0.02 * any_value(all_docs))),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN often ON lines.source IS NOT DISTINCT FROM often.source AND lines.norm = often.norm
    WHERE doc_id <> first GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(gone.n, 0) AS removed_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.5 * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words
FROM y
"""

OP8 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c
    ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

OP10 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, host, path, h || s AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY coalesce(length(h || s), 0) DESC) AS n
    FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best WHERE n = 1
"""

OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d),
f AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS gain FROM f JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM g JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 50
"""


def statements() -> dict[str, str]:
    """No SQL where a query needs a hash, tokenizer, model or parser that SQL has not; tests hold those against brute force."""
    return {"op2_substrings": OP2, "op5_line_rules": OP5, "op8_neighbours": OP8, "op10_url_filter": OP10, "op12_lexical": OP12}
