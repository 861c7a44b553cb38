"""The registered queries of this package; SQL where it can say them, else tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .collocations import collocations
from .common import table
from .decontam import find_leaks, leak_report
from .filter_audit import audit_filters
from .html_text import page_texts
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .order_packing import pack_in_order
from .packing import pack_documents
from .sharding import shard_by_ring
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import is_held_out, score_toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_ring(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_report(find_leaks(docs, table(spark, sf_dir, "benchmark"), 10))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and the numbers of those that repeat an earlier line."""
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_in_order(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_sharding, op4_nearest_neighbours, op5_decontamination,
    op6_token_counts, op7_suffix_dedup, op8_line_dedup, op9_near_dedup, op10_html_extraction,
    op11_filter_audit, op12_order_packing, op13_collocations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_decontamination": rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER},
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM items WHERE len(w) > 0),
  wanted AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2),
    lambda i: array_to_string(w[i:i + m - 1], ' '))) AS gram FROM sized),
  placed AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM docs, (SELECT DISTINCT m FROM wanted) WHERE len(w) >= m),
  found AS (SELECT doc_id, item_id, i, p.m FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
    FROM placed) p JOIN wanted USING (m, gram)),
  hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + m)) AS place FROM found) GROUP BY 1),
  named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_near_dedup": rf"""WITH RECURSIVE worded AS (SELECT doc_id,
    list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM worded),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = other)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, m) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
  FROM worded LEFT JOIN sizes USING (doc_id)
  LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)""",
    "op11_filter_audit": r"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
  worded AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM texts JOIN firsts USING (t)),
  marked AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed,
    coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS toxic
    FROM worded LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l
    USING (doc_id)),
  counted AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM marked GROUP BY 1, 2),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, s.step::INTEGER AS step, filter_order[s.step] AS f,
    filter_order[:s.step - 1] AS ran FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
  rows AS (SELECT part, filter_order, step, f, counted.*, contains(failed, f) AS fails,
    len(list_filter(string_split(ran, ''), lambda x: x <> '' AND contains(failed, x))) = 0 AS alive
    FROM counted, steps),
  sums AS (SELECT part, filter_order, step, any_value(f) AS f,
    sum(n) FILTER (alive AND NOT fails) AS kept, sum(n) FILTER (alive AND fails) AS removed,
    sum(n) FILTER (fails AND NOT alive) AS redundant, sum(n) FILTER (failed = f) AS unique_fails,
    sum(good) FILTER (alive AND fails) AS good_lost, sum(toxic) FILTER (alive AND fails) AS toxic_lost
    FROM rows GROUP BY 1, 2, 3)
  SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM sums""",
    "op13_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
      lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
  f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
  n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY 1),
  c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
  cuts AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
    FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
  scored AS (SELECT cuts.lang, cuts.phrase, cuts.m, a, k, fx.f AS l, fy.f AS r, n,
      1000::HUGEINT * a * n // (fx.f::HUGEINT * fy.f) AS score
    FROM cuts JOIN n USING (lang) JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x
    JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
  weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS cover
    FROM c, (SELECT unnest(range(2, 5)) AS s), (SELECT unnest(range(1, 5)) AS i) WHERE s < m AND i + s - 1 <= m
    GROUP BY ALL),
  kept AS (SELECT weakest.* FROM weakest LEFT JOIN inner_ USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 100 * a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
    score::BIGINT AS score FROM kept QUALIFY rank <= 2000""",
}
