"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import (
    byte_bpe, exact_dedup, filter_audit, language_id, neighbours, ngram_join, packing, prefix_trie, quality, sharding,
    token_counts, toxicity, warc,
)
from cladewise.llm.common import held_out, table, text_or_empty, training_fold
from cladewise.session import scratch_path

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NEIGHBOURS, QUERY_STEP, SHARDS, TOKEN_LIMIT = 20, 20, 16, 4096


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    BUILDERS[build.__name__] = build
    return build


@_query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup.mark_copies(docs, F.sha2(text_or_empty(), 256).alias("text_sha256"))


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""


@_query
def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), f"vec_id % {QUERY_STEP} = 0", NEIGHBOURS)


@_query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    pages = warc.read_pages(spark, path)
    sound = F.when(F.col("complete"), F.col("record_key")).otherwise(
        F.raise_error(F.concat(F.lit("broken record "), F.coalesce("record_id", F.lit("?")))))
    facts = pages.select(
        "record_id", "record_type", sound.cast("long").alias("page_id"), "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
    )
    sources = facts.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
    ).dropDuplicates(["refers_to"])
    # Responses refer to nothing; a key of their own keeps them apart in the join.
    keyed = facts.withColumn("refers_to", F.coalesce("refers_to", F.concat(F.lit("none "), F.col("record_id"))))
    return keyed.join(sources, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"),
    )


SQL["op3_warc"] = """
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN last END AS refers_to
FROM (SELECT *, strlen(body) >= 1000 AND page_id <> last AS revisit FROM (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))
"""


@_query
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, folder, "documents"), ngram_join.Rule(words=3, percent=90))


SQL["op4_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS near FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.near)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(near) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


@_query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language_id.learn(docs.where(training_fold(F.col("doc_id"))))
    found = language_id.identified(docs.select("doc_id", "text"), profiles)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"),
    )


@_query
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@_query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    network = toxicity.fit(docs, table(spark, folder, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), network)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@_query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
    )
    return sharding.sharded(rows, ["doc_id", "text_crc32", "size"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _feistel_sql(rounds: int, seed: int) -> str:
    """The columns of one pass over ``x``, as nested selects from ``walk``."""
    inner = "SELECT n, x % a AS l, x // a AS r, a, b FROM walk, domain WHERE x >= rows OR step = 0"
    for step in range(rounds):
        moved, other, side = ("l", "r", "a") if step % 2 == 0 else ("r", "l", "b")
        draw = f"('0x' || substr(md5('{seed}-{step}-' || {other}), 1, 13))::BIGINT"
        inner = f"SELECT n, ({moved} + {draw} % {side}) % {side} AS {moved}, {other}, a, b FROM ({inner})"
    return f"SELECT n, r * a + l AS x, 1 AS step FROM ({inner})"


SQL["op9_sharding"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
body AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS digits FROM documents),
facts AS (
  SELECT doc_id, strlen(body) + 1 AS size, xor(4294967295, list_reduce(
    [4294967295] || [('0x' || substr(digits, 2 * i + 1, 2))::BIGINT for i in range(strlen(body))],
    lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1]))) AS text_crc32
  FROM body, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS n FROM facts),
domain AS (SELECT rows, a, (rows + a - 1) // a AS b FROM (SELECT count(*) AS rows, ceil(sqrt(count(*)))::BIGINT AS a FROM documents)),
walk AS (SELECT n, n AS x, 0 AS step FROM numbered UNION ALL {_feistel_sql(sharding.ROUNDS, 1)}),
placed AS (SELECT n, x FROM walk, domain WHERE step = 1 AND x < rows)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 16)::INT AS shard, x // 16 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (n)
"""


@_query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(cut).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@_query
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, metadata = table(spark, folder, "documents"), ["n_chars"]
    machine = quality.fit(docs, table(spark, folder, "labels"), metadata)
    found = quality.scored(docs.select("doc_id", "text", *metadata), machine, metadata)
    return found.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"),
        (F.col("_quality") >= 0.5).cast("int").alias("predicted"),
    )


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table(spark, folder, "conversations"))))


SQL["op12_prefix_trie"] = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
         sha256(strlen(role)::VARCHAR || ':' || role || text) AS k,
         len(regexp_extract_all(text, '[^ 	-]+')) AS words
  FROM turns),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS origin, xor(4294967295, list_reduce(
    [4294967295] || [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],
    lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
taken AS (
  SELECT i.conv_id, k.n, k.k, k.words FROM ids i JOIN keyed k ON k.conv_id = i.origin AND k.n <= i.h
  UNION ALL
  SELECT i.conv_id, k.n + 1000000000, k.k, k.words FROM ids i JOIN keyed k ON k.conv_id = i.conv_id AND k.n > i.h),
paths AS (SELECT conv_id, list(k ORDER BY n) AS p, list(words ORDER BY n) AS w FROM taken GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, d, sha256(array_to_string(p[1:d], ' ')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(p[1:d - 1], ' ')) END AS parent, coalesce(w[d], 0) AS words, d = len(p) AS ends
  FROM (SELECT conv_id, p, w, unnest(range(len(p) + 1)) AS d
        FROM (SELECT conv_id, coalesce(p, []) AS p, coalesce(w, []) AS w FROM ids LEFT JOIN paths USING (conv_id)))),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node),
counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY 1) c ON c.parent = n.node),
under AS (
  SELECT a.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM counted x JOIN prefixes a ON a.conv_id = x.conv_id AND a.d <= x.depth GROUP BY a.node)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN under u USING (node) LEFT JOIN nodes p ON p.node = c.parent
"""


@_query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op13_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w
  FROM documents),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body))::INT
         + 8 * regexp_matches(body, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)::INT AS mask
  FROM docs LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b FROM fails GROUP BY ALL),
letters AS (SELECT 1 << i AS bit, substr('ABCDE', i + 1, 1) AS l FROM range(5) r(i)),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, list_sum(bits[1:s - 1])::BIGINT AS earlier
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS s FROM orders)),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0 THEN b ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
