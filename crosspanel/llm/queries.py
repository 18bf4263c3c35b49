"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import bpe, chat, decontaminate, embeddings, language, lines, main_text, prefix_trie, quality, repeats, resampling, simhash, warc
from crosspanel.llm.common import prepare, scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@query
def op10_quality(spark, sf_dir):
    """Quality score of every document; the model learns from rows outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").filter(_fold("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op6_line_dedup(spark, sf_dir):
    """Repeated chunks of lines removed from every document; the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op6_line_dedup"] = lines.DIGEST_SQL


@query
def op1_simhash(spark, sf_dir):
    """SimHash fingerprint of every document and the smallest doc_id its links reach."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_decontaminate(spark, sf_dir):
    """Words of every document that lie in 13-word windows of benchmark items, and the items found."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.verdicts(decontaminate.find(docs, items)).withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(words[i : i + n - 1], ' ') AS phrase
       FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
ln AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, ln WHERE len(words) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op3_bpe(spark, sf_dir):
    """Every text encoded by the ranks of a public vocabulary, and decoded again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=False).withColumnRenamed("id", "doc_id")


@query
def op7_chat(spark, sf_dir):
    """Every conversation formatted, and read back from the output."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"({a}L, {b}L, '{role}', '{text}')" for a, b, role, text in chat.PROBE)
    probe = spark.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_chat(chat.events_of(given.unionByName(probe))))


SQL["op7_chat"] = chat.DIGEST_SQL


@query
def op8_warc(spark, sf_dir):
    """A WARC record for every page, written and read back."""
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS holder,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM q
"""


@query
def op9_embeddings(spark, sf_dir):
    """Links between embeddings of one label at a cosine of 0.98 or more, and their components."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op5_language(spark, sf_dir):
    """The language of every document; the model learns outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs.filter(_fold("doc_id", 4) != 2)))
    return found.select(F.col("id").alias("doc_id"), (_fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op4_repeats(spark, sf_dir):
    """Bytes of every document that a repeated string of 400 bytes covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, with_kept=False).withColumnRenamed("id", "doc_id")
    return found.withColumn("kept_bytes", F.col("n_bytes") - F.col("n_removed"))


@query
def op11_resampling(spark, sf_dir):
    """Documents drawn towards the benchmark's distribution of words: weight, score and rank of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op11_resampling"] = resampling.SQL


@query
def op12_prefix_trie(spark, sf_dir):
    """The trie of all rebuilt conversations, one row for each node."""
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


SQL["op12_prefix_trie"] = prefix_trie.SQL


@query
def op13_main_text(spark, sf_dir):
    """The main text of every page, found by trees fitted on pages made of the table's own fragments."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
