"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import (
    binary_fuse,
    cross_parsing,
    decontaminate,
    kneser_ney,
    line_dedup,
    maxscore,
    mixing,
    pii,
    presence_masks,
    simhash,
    site_style_tree,
    source_divergence,
    warc,
)
from gapline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a benchmark item is found in a document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, after a round trip through dictionary-compressed archives."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: doc_id, n_lines, n_dropped, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs, counts=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in the place of personal data: doc_id, text, n_entities."""
    return pii.replace(table(spark, sf_dir, "documents"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document; trusted are those that labels call good and not toxic."""
    return kneser_ney.classify(table(spark, sf_dir, "documents"), kneser_ney.trusted_documents(table(spark, sf_dir, "labels")))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return site_style_tree.main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.identify(table(spark, sf_dir, "documents"))


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return presence_masks.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_binary_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts, found as one snapshot and one batch that arrives after it."""
    return binary_fuse.deduplicate(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_maxscore": op6_maxscore,
    "op7_mixing": op7_mixing,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_site_style_tree": op9_site_style_tree,
    "op10_language_id": op10_language_id,
    "op11_presence_masks": op11_presence_masks,
    "op12_binary_fuse": op12_binary_fuse,
    "op13_source_divergence": op13_source_divergence,
}

MAXSCORE_SQL = """
WITH ok AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
),
q AS (SELECT vec_id AS query_id, v AS qv FROM ok WHERE vec_id % 100 = 0),
scored AS (
  SELECT q.query_id, ok.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.qv, ok.v)]) AS BIGINT) AS score
  FROM q JOIN ok ON q.query_id <> ok.vec_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         greatest(0.05::DOUBLE, (1.0::DOUBLE + length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\p{L} \t\n\r\f]+', '', 'g')))
           / (1.0::DOUBLE + length(coalesce(text, '')))) AS quality,
         (CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents
),
keyed AS (SELECT *, -ln(u) / quality AS key FROM d),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, source_size::DOUBLE * 3 AS cap FROM sizes
),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM w
),
l AS (SELECT *, (total - full_before) / open_weight AS level FROM f),
o AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS open_level FROM l),
t AS (
  SELECT source, source_size, least(cap, coalesce(open_level * weight, cap)) AS target FROM o
),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS running
  FROM keyed k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN running - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

#: For items of at least 13 words, as the given tables have them.
DECONTAMINATE_SQL = r"""
WITH dt AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents)),
bt AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM (SELECT DISTINCT item_id, [x FOR x IN regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark)),
ds AS (SELECT doc_id, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o] AS s FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
bs AS (SELECT item_id, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o] AS s FROM bt WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
dk AS (SELECT doc_id, pos, 0 AS m, concat_ws(' ', s[1], s[2], s[4], s[6], s[7], s[9]) AS k FROM ds WHERE s[9] IS NOT NULL UNION ALL SELECT doc_id, pos, 1, concat_ws(' ', s[1], s[3], s[4], s[7], s[8], s[9]) FROM ds WHERE s[9] IS NOT NULL),
bk AS (SELECT item_id, pos, 0 AS m, concat_ws(' ', s[1], s[2], s[4], s[6], s[7], s[9]) AS k FROM bs WHERE s[9] IS NOT NULL UNION ALL SELECT item_id, pos, 1, concat_ws(' ', s[1], s[3], s[4], s[7], s[8], s[9]) FROM bs WHERE s[9] IS NOT NULL),
hits AS (SELECT DISTINCT dk.doc_id, bk.item_id, dk.pos - bk.pos AS start FROM dk JOIN bk USING (m, k)),
same AS (SELECT h.doc_id, h.item_id, h.start, bt.pos, bt.n, coalesce(dt.word = bt.word, false)::INT AS hit FROM hits h JOIN bt ON bt.item_id = h.item_id LEFT JOIN dt ON dt.doc_id = h.doc_id AND dt.pos = h.start + bt.pos),
wins AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id, item_id, start ORDER BY pos ROWS 12 PRECEDING) AS s13 FROM same)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(sum(hit) AS INT) AS matched, CAST(any_value(n) AS INT) AS item_words FROM wins GROUP BY doc_id, item_id, start HAVING max(CASE WHEN pos >= 12 THEN s13 END) >= 10
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < l.last THEN l.last END AS refers_to
FROM p LEFT JOIN l ON p.payload_digest = l.payload_digest
"""

PRESENCE_MASKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
n AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS n, CAST(coalesce(sum(n), 0) AS BIGINT) AS l FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
m AS (SELECT doc_id, 100 - 75 + (75 * n.n * s.n) // s.l AS m FROM n, s),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

BINARY_FUSE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, lang, source, term, count(*) AS n
  FROM (
    SELECT doc_id, lang, source,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM d
  ) GROUP BY ALL
),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, k.n AS all_n, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n
  FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term GROUP BY ALL
),
t AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT c.lang, c.source, c.term, c.n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c.n + 5)) // (t.total + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (c.all_n + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM c JOIN t USING (lang, source) JOIN v USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
own AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE_SQL,
    "op3_warc": WARC_SQL,
    "op6_maxscore": MAXSCORE_SQL,
    "op7_mixing": MIXING_SQL,
    "op11_presence_masks": PRESENCE_MASKS_SQL,
    "op12_binary_fuse": BINARY_FUSE_SQL,
    "op13_source_divergence": SOURCE_DIVERGENCE_SQL,
}
