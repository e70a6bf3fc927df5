"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, media, mixing, overlap, packing, prefixes, secrets, sharding, simhash, spelling, suffix, toxicity, warc

SHARDS = 24
TOKENS = 2048


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(_read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def secrets_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of the base kinds, which SQL can express too."""
    return op2_secrets(spark, sf_dir).drop("spans")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer(), TOKENS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(warc.captures(_read(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", "kind", "resolution", "source_id", "payload_digest", warc.header_lines(F.col("headers")).alias("headers"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), typos=31)


def op12_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlap.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared(_read(spark, sf_dir, "conversations"), moduli=(100, 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_secrets, secrets_base_spans, op3_neighbours, op4_repeats, op5_packing, op6_toxicity, op7_revisits, op8_mixing, op9_simhash, op10_media, op11_spelling, op12_overlap, op13_prefixes)}

_QUOTED = {"assign": secrets.ASSIGN.replace("'", "''"), "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{32,}"}
#: Of the kinds: the group that has to have a number of characters, and that number.
_LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "secrets_base_spans": "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT row, '{name}' AS name, {i} AS kind, {_LEAST[name][1]} AS least, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {_LEAST[name][0]}) AS part FROM d"
        for i, (name, p) in enumerate(_QUOTED.items())
    )
    + """),
e AS (SELECT row, name, kind, least, unnest(found) AS own, unnest(part) AS part, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0),
s AS (SELECT row, name, kind, least, length(part) AS n, sum(length(gap) + length(own)) OVER (PARTITION BY row, kind ORDER BY i) AS stop, length(own) AS own FROM e),
g AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  string_agg(name || ':' || CAST(stop - own AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - own, kind) AS spans FROM s WHERE n >= least GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (row)
""",
    "op7_revisits": r"""
WITH d AS (SELECT *, instr('0123456789abcdef', substr(md5(CAST(page_id AS VARCHAR)), 1, 1)) - 1 AS d FROM pages),
x AS (SELECT page_id, url, html, d, unnest(range(0, d % 5 + 1)) AS i FROM d),
f AS (SELECT *, (i = 0 AND d <> 7) OR i = 3 AS full_, regexp_replace(url, '#.*$', '') AS bare FROM x),
u AS (
  SELECT *, (length(html) + CASE WHEN full_ THEN CAST(i = 3 AS INT) ELSE CAST(((d + i) % 4 = 0) <> (i > 3) AS INT) END) % 3 AS v,
    regexp_replace(regexp_replace(trim(CASE WHEN i = 1 THEN regexp_replace(url, '^http:', 'https:') WHEN i = 2 THEN url || '#again'
      WHEN i = 3 THEN bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_campaign=x' ELSE url END), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM f),
p AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
           lambda y: y <> '' AND NOT regexp_matches(lower(y), '^(utm_|ref=|sessionid=|fbclid=|gclid=)'))), '&') AS query FROM u),
r AS (
  SELECT page_id * 8 + i AS record_id, i, page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, full_,
         CASE WHEN page_id % 7 <> 0 THEN '"v' || v || '"' END AS tag, CASE WHEN v <> 1 THEN 'day ' || v END AS seen, 'round ' || i AS day,
         CASE WHEN full_ THEN CAST(strlen(html) AS VARCHAR) ELSE '0' END AS bytes, CASE WHEN full_ THEN sha256(CASE WHEN i = 3 THEN html || '+' ELSE html END) END AS digest FROM p),
s AS (
  SELECT *, CASE WHEN NOT full_ THEN last_value(CASE WHEN full_ THEN record_id END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY i, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS src FROM r),
j AS (
  SELECT s.*, e.tag AS etag, e.seen AS eseen, e.bytes AS ebytes, e.digest AS edigest,
    CASE WHEN s.full_ THEN 'response' WHEN s.src IS NULL THEN 'missing' WHEN coalesce(s.tag = e.tag, s.seen = e.seen) IS NULL THEN 'unvalidated'
         WHEN coalesce(s.tag = e.tag, s.seen = e.seen) THEN 'resolved' ELSE 'mismatch' END AS resolution
  FROM s LEFT JOIN r e ON e.record_id = s.src)
SELECT record_id, url_key, CASE WHEN full_ THEN 'response' ELSE 'revisit' END AS kind, resolution, CASE WHEN resolution IN ('resolved', 'unvalidated') THEN src END AS source_id,
  CASE WHEN resolution IN ('resolved', 'unvalidated') THEN edigest ELSE digest END AS payload_digest,
  CASE WHEN resolution IN ('resolved', 'unvalidated')
    THEN concat_ws(chr(10), 'content-length: ' || ebytes, 'content-type: text/html', 'date: ' || day, 'etag: ' || coalesce('W/' || tag, etag), 'last-modified: ' || coalesce(seen, eseen))
    ELSE concat_ws(chr(10), 'content-length: ' || bytes, CASE WHEN full_ THEN 'content-type: text/html' END, 'date: ' || day, 'etag: ' || CASE WHEN full_ THEN '' ELSE 'W/' END || tag, 'last-modified: ' || seen) END AS headers
FROM j
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i FROM w),
l AS (SELECT a.i, a.w, a.cap, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce((SELECT sum(b.cap) FROM o b WHERE b.i < a.i), 0)) / (SELECT sum(b.w) FROM o b WHERE b.i >= a.i) AS level FROM o a),
f AS (SELECT arg_min(level, i) AS level FROM l WHERE level * w <= cap),
t AS (SELECT o.source, o.source_size, least(o.cap, f.level * o.w) AS target FROM o, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.*, n.source_size, n.target, n.times, n.target - n.times * n.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
""",
    "op11_spelling": f"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
y AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM u),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda a, c: xor(a // 256, t.t[1 + xor(a, c) % 256]))) AS h FROM y, t),
o AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
l AS (SELECT word, unnest(range(0, length(word))) AS i FROM w),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM l),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, w.word FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.v = w.word),
q AS (SELECT p.word, count(*) AS n_near, max(w.n) AS most FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT p.word, min(p.other) AS form, any_value(q.most) AS form_n FROM p JOIN q ON q.word = p.word JOIN w ON w.word = p.other AND w.n = q.most JOIN w own ON own.word = p.word WHERE q.most >= 10 * own.n GROUP BY p.word),
c AS (SELECT word, word AS root FROM w UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root),
e AS (SELECT c.word, c.root FROM c LEFT JOIN f ON f.word = c.root WHERE f.word IS NULL)
SELECT w.word, f.form, e.root, w.n, coalesce(q.n_near, 0) AS n_near, f.form_n FROM w JOIN e USING (word) LEFT JOIN q USING (word) LEFT JOIN f USING (word)
""",
    "op12_overlap": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS v FROM s),
k AS (SELECT DISTINCT n FROM v),
a AS (SELECT row, w, unnest(range(0, len(w))) AS i FROM d),
x AS (SELECT row, i, n, array_to_string(w[i + 1 : i + n], ' ') AS v FROM a, k WHERE i + n <= len(w)),
o AS (SELECT row, i, n, item_id FROM x JOIN v USING (n, v)),
p AS (SELECT DISTINCT row, unnest(range(i, i + n)) AS at FROM o),
h AS (SELECT row, count(*) AS n_hit FROM p GROUP BY row),
j AS (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL),
m AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM j GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN m USING (row)
""",
    "op13_prefixes": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM t),
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 6 AS h FROM z),
r AS (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= h
      UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.i > h),
m AS (SELECT conv_id, row_number() OVER own AS depth, length(text) AS size, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER own AS key FROM r WINDOW own AS (PARTITION BY conv_id ORDER BY part, i)),
n AS (SELECT * FROM m UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM n),
g AS (SELECT key, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT DISTINCT a.key, b.key AS below FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
q AS (SELECT s.key, CAST(count(*) FILTER (k.key IS NULL) AS BIGINT) AS n_leaves, CAST(sum((g.n_convs - 1) * g.size) AS BIGINT) AS saved_tokens FROM s JOIN g ON g.key = s.below LEFT JOIN k ON k.key = s.below GROUP BY s.key)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, q.n_leaves, q.saved_tokens, g.ends_sha256
FROM g JOIN q ON q.key = g.key LEFT JOIN k ON k.key = g.key LEFT JOIN g p ON p.key = g.up
""",
}
