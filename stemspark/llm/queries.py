"""One query for each operator, over its whole table: thin, with the columns that its digest needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, codes, decontaminate, html, near, packing, prefixes, prints, quality, rules, shards, substrings, warc
from .store import table

#: A document's ids end with this one.
END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_and_measure(table(spark, sf_dir, "documents"))


def sharding_256k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small shards, so that a small table has many."""
    return shards.assign(table(spark, sf_dir, "documents"), 1 << 18)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = binary.write(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return binary.read(spark, manifest)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).withColumnRenamed("out", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, index).drop("url")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_label_errors(*codes.compress(table(spark, sf_dir, "embeddings")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations")).drop("place")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "sharding_256k": sharding_256k,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_binary": op5_token_binary,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fingerprints": op13_fingerprints,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


#: The counts of op9 and its lines, in SQL: a line is compared as its words, in small letters; a line goes if more than
#: 100 distinct documents of its host hold it.
_OP9 = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws)))
    WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM lines),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines WHERE len(lw) > 0 GROUP BY doc_id),
common AS (SELECT source, lw FROM full_lines WHERE len(lw) > 0 GROUP BY source, lw HAVING count(DISTINCT doc_id) > 100),
lost AS (SELECT f.doc_id, sum(len(f.lw)) AS n FROM full_lines f JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.lw = c.lw GROUP BY f.doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words
  FROM docs d JOIN ws USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * n_line_words > 50 * n_words AS kept
FROM counts
"""

#: Links between distinct sets of shingles on full counts, then the least id that links reach.
_OP1 = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS s FROM ws),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: The bucket of a key is that of the least depth whose bytes fit or which holds one key; 24 bits tell all ids apart.
_OP3 = r"""
WITH rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents),
deep AS (SELECT *, unnest(range(0, 25)) AS depth FROM rows),
cells AS (SELECT doc_id, n_bytes, depth, key >> CAST(60 - depth AS INTEGER) AS shard, key FROM deep),
sums AS (SELECT *, sum(n_bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_docs, min(key) OVER p AS lo, max(key) OVER p AS hi FROM cells WINDOW p AS (PARTITION BY depth, shard)),
fits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM sums WHERE shard_bytes <= {limit} OR lo = hi)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes > {limit} AS oversized FROM fits WHERE k = 1
"""

#: Records of pages: of equal payloads the greatest page_id is the response.
_OP10 = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> leader THEN leader END AS refers_to FROM m
"""

#: Windows of items as lists of words, joined to the documents' windows of the same length.
_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i+12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i+n-1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Windows as lists of words; a word goes if a window over it isn't the first of its equals.
_OP8 = r"""
WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+19] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM ws)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM ws LEFT JOIN lost USING (doc_id)
"""

#: Lloyd rounds of a product quantiser by comparing each part with every entry; whole numbers are held as such.
_ASSIGN = """
d{k} AS (
  SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS d
  FROM p JOIN b{k} b ON p.part = b.part),
a{k} AS (SELECT r, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY r, part)"""
_MOVE = """
m{k} AS (
  SELECT part, entry, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.part, a.entry, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS v FROM a{k} a JOIN p USING (r, part)) GROUP BY part, entry, i),
f{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(f.x, b.x) AS x FROM b{k} b LEFT JOIN f{k} f USING (part, entry))"""
_OP11 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 256) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT r, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM (SELECT r, x, unnest(range(0, 16)) AS part FROM v)),
b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
{_ASSIGN.format(k=0)}, {_MOVE.format(k=0, n=1)}, {_ASSIGN.format(k=1)}, {_MOVE.format(k=1, n=2)}, {_ASSIGN.format(k=2)},
c AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (r), book
"""

#: Prefixes as lists of turns; a node lies under the nodes of its smallest member's shorter prefixes.
_OP12 = """
WITH RECURSIVE bits AS (
  SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) r(n) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS x FROM bits WHERE k = 8),
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: xor(a >> 8, x[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (
  SELECT i.conv_id, 0 AS side, place, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 5 AND place < h UNION ALL
  SELECT i.conv_id, 1, place, role, text FROM ids i JOIN t USING (conv_id) WHERE place >= h),
lists AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY side, place) AS l FROM r GROUP BY conv_id),
full_lists AS (SELECT conv_id, coalesce(l, []) AS l FROM ids LEFT JOIN lists USING (conv_id)),
pre AS (SELECT conv_id, depth, len(l) AS n, l[1:depth] AS p, CASE WHEN depth > 0 THEN strlen(l[depth].text) ELSE 0 END AS bytes FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM full_lists)),
nodes AS (SELECT p, depth, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM pre GROUP BY p, depth),
of AS (SELECT conv_id, pre.depth, node FROM pre JOIN nodes ON pre.depth = nodes.depth AND pre.p = nodes.p),
up AS (SELECT n.*, o.node AS parent FROM nodes n LEFT JOIN of o ON o.conv_id = n.node AND o.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
every AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (node, depth)),
under AS (SELECT o.node, o.depth, sum(CASE WHEN e.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((e.n_convs - 1) * e.bytes) AS saved FROM every e JOIN of o ON o.conv_id = e.node AND o.depth <= e.depth GROUP BY ALL)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM every JOIN under USING (node, depth)
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": _OP1,
    "op3_sharding": _OP3.format(limit=shards.SHARD_BYTES),
    "sharding_256k": _OP3.format(limit=1 << 18),
    "op7_decontamination": _OP7,
    "op8_substring_dedup": _OP8,
    "op9_quality_rules": _OP9,
    "op10_warc": _OP10,
    "op11_vector_codes": _OP11,
    "op12_conversation_trie": _OP12,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
