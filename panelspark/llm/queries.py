"""The registered queries of this package, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from panelspark.llm import (conversations, fertility, fill_middle, hash_index, line_dedup, mixing, packing, repeats, superminhash,
                            token_transducer, toxicity, warc, window_dedup)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_minhash_near_dedup(spark, sf_dir):
    """Whole documents, five-word shingles, similarity 0.85; checked against brute force in the tests."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""")
def op2_exact_dedup(spark, sf_dir):
    return hash_index.exact_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op4_toxicity(spark, sf_dir):
    """Scores of all documents by a model of the rows that are not held out; checked by held-out accuracy in the tests."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op5_repeated_strings(spark, sf_dir):
    """Bytes under repeated strings of 200 bytes; checked against brute force in the tests."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
s AS (
  SELECT doc_id, pos, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS s
  FROM u WHERE w > 0),
g AS ( -- shortest runs of ten words from a unit on, over the gap behind a long unit, and up to a unit
  SELECT doc_id, pos, max(pos) OVER f AS till, list(line) OVER f AS content, sum(w) OVER f AS words
  FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)
  UNION ALL
  SELECT doc_id, pos, max(pos) OVER f, list(line) OVER f, CASE WHEN w >= 10 AND max(pos) OVER f > pos THEN w END
  FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, pos, list(line) OVER f, sum(w) OVER f
  FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY s + w RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)),
k AS (SELECT doc_id, pos, till, rank() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth FROM g WHERE words >= 10),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, till + 1)) AS pos FROM k WHERE nth > 1),
spans AS (SELECT doc_id, pos, till, max(till) OVER (PARTITION BY doc_id ORDER BY pos, till ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT doc_id, pos, till FROM k WHERE nth > 1)),
runs AS (SELECT doc_id, count(*) AS n FROM spans WHERE reach IS NULL OR pos > reach GROUP BY 1),
{tail}"""
OP6_TAIL = r"""
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(r.n, 0) AS n_runs, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN runs r ON d.doc_id = r.doc_id"""


@query(LINE_SQL.format(tail=OP6_TAIL))
def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", "text")


MIX_SQL = r"""
WITH z AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5('mix-1|' || doc_id) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM z GROUP BY 1),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
r AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, n, least(2 * n, w * coalesce((SELECT level FROM r WHERE 2 * n / w > level ORDER BY 2 * n / w, i LIMIT 1), 1e300)) AS target FROM r),
c AS (
  SELECT z.*, t.n, t.target, least(2, floor(t.target / nullif(t.n, 0))) AS base,
    sum(size) OVER (PARTITION BY z.source ORDER BY u) - size / 2 AS mid
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(size * (coalesce(base, 0) + CASE WHEN base < 2 AND target - base * n > 0 AND mid <= target - base * n THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""


@query(MIX_SQL)
def op7_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query()
def op8_tokeniser_fertility(spark, sf_dir):
    """Base rules and fertility bands per language; checked against brute force in the tests."""
    params = fertility.FertilityParams(model=public_tokenizers.path("piece_bpe_32k.model"), second=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return fertility.rate(table(spark, sf_dir, "documents"), params)


@query()
def op9_token_counts(spark, sf_dir):
    """Tokens of byte_bpe_50k.json; checked against the tokenizers library in the tests."""
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_pack(spark, sf_dir):
    """Sequences of 2048 tokens; checked against a plain packer's invariants and the library's ids in the tests."""
    params = packing.PackParams(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), params)


WINDOW_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
g AS (SELECT doc_id, pos, n, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS content FROM w),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth FROM g WHERE pos + 19 <= n),
m AS (
  SELECT w.doc_id, w.pos, word, coalesce(max(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN k ON w.doc_id = k.doc_id AND w.pos = k.pos),
r AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""


@query(WINDOW_SQL)
def op11_substring_dedup(spark, sf_dir):
    """Words under windows of 20 words that stand earlier in the corpus."""
    return window_dedup.drop_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


FIM_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3,
  CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS y FROM p),
f AS (SELECT *, strpos(y, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS i, strpos(y, '<M>') AS j FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(y) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN y WHEN 'psm' THEN y[4:i - 1] || y[j + 3:] || y[i + 3:j - 1] ELSE y[i + 3:j - 1] || y[j + 3:] || y[4:i - 1] END) AS restored_sha256
FROM f"""


@query(FIM_SQL)
def op12_fill_in_middle(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query()
def op13_conversation_repair(spark, sf_dir):
    """Faults and cheapest edits of whole conversations; checked against a search over all edits in the tests."""
    return conversations.repair_digests(table(spark, sf_dir, "conversations"))
