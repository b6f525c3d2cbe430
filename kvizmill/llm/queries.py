"""Queries p1 and p3 to p10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvizmill.llm.capping import over_cap
from kvizmill.llm.consensus import consensus_of_three, discover
from kvizmill.llm.encoding import encode_documents
from kvizmill.llm.language import identify, mislabelled
from kvizmill.llm.names import link_names, linked_pairs
from kvizmill.llm.neardup import near_duplicates, repeated_questions
from kvizmill.llm.packing import pack_documents
from kvizmill.llm.quotas import allocate, draw, question_strata, shortfalls, strata_counts
from kvizmill.llm.subjects import subject_areas
from kvizmill.operators.authors import pooled_authors
from kvizmill.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_questions(load(spark, sf_dir, "questions"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "questions"))[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_of_three(load(spark, sf_dir, "question_topics"))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover(load(spark, sf_dir, "question_topics"))[0]


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover(load(spark, sf_dir, "question_topics"))[1]


def p4_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(*(load(spark, sf_dir, t) for t in ("tg_posts", "topic_examples", "categories")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_areas(spark, sf_dir).select("id", "category").distinct()


def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_areas(spark, sf_dir).groupBy("category").agg(F.countDistinct("id").alias("posts"), F.avg("confidence").alias("mean_confidence"))


def _author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled_authors(load(spark, sf_dir, "packs"), load(spark, sf_dir, "questions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_pairs(_author_names(spark, sf_dir))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(_author_names(spark, sf_dir))


def _strata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, sf_dir, "sample_targets")
    return question_strata(*(load(spark, sf_dir, t) for t in ("questions", "packs", "question_topics")), targets), targets


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortfalls(p6_quotas(spark, sf_dir))


def p6_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate(strata_counts(*_strata(spark, sf_dir)))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(*_strata(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_cap(load(spark, sf_dir, "tg_posts"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "batch_limits"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(load(spark, sf_dir, "documents"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per stretch of one language, and one without language for a document without words."""
    found = identify(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "main", "confidence", F.posexplode_outer("segments").alias("segment", "s")).select(
        "doc_id", "main", "confidence", "segment", "s.lang", "s.end", F.col("s.confidence").alias("segment_confidence")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p3_found": p3_found,
    "p3_consensus": p3_consensus,
    "p3_annotators": p3_annotators,
    "p4_found": p4_found,
    "p4_areas": p4_areas,
    "p4_composition": p4_composition,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p6_found": p6_found,
    "p6_quotas": p6_quotas,
    "p6_sample": p6_sample,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}

_MEMBERS = """members AS (
            SELECT DISTINCT t.plan_id, t.stratum_key, q.question_id AS item FROM sample_targets t JOIN question_topics q
            ON t.dimension = 'subcategory' AND q.subcategory_id = t.subcategory_id
            UNION
            SELECT DISTINCT t.plan_id, t.stratum_key, q.id FROM sample_targets t
            JOIN packs p ON t.dimension = 'difficulty' AND t.low_bound <= p.difficulty AND p.difficulty < t.high_bound
            JOIN questions q ON q.pack_id = p.id)"""

#: Quotas by the totals at all turning points, a line drawn between the two that enclose the sample.
_QUOTAS = f"""{_MEMBERS}, counted AS (
            SELECT t.plan_id, t.stratum_key, t.target_share, t.min_rows, t.sample_rows, count(m.item) AS available
            FROM sample_targets t LEFT JOIN members m USING (plan_id, stratum_key) GROUP BY ALL),
        b AS (SELECT *, target_share AS s, least(min_rows, available)::DOUBLE AS f, available::DOUBLE AS c FROM counted),
        points AS (SELECT plan_id, f / s AS x FROM b WHERE s > 0 UNION SELECT plan_id, c / s FROM b WHERE s > 0),
        totals AS (SELECT plan_id, x, sample_rows, sum(least(c, greatest(f, x * s))) AS total
                   FROM points JOIN b USING (plan_id) GROUP BY ALL),
        low AS (SELECT plan_id, max(x) AS x0, max(total) AS t0 FROM totals WHERE round(total, 6) <= sample_rows GROUP BY ALL),
        high AS (SELECT plan_id, min(x) AS x1, min(total) AS t1 FROM totals WHERE round(total, 6) > sample_rows GROUP BY ALL),
        parts AS (SELECT b.*, least(c, greatest(f, round(coalesce(x0 + coalesce((sample_rows - t0) / (t1 - t0) * (x1 - x0), 0), 0) * s, 6))) AS part
                  FROM b LEFT JOIN low USING (plan_id) LEFT JOIN high USING (plan_id)),
        quotas AS (SELECT *, floor(part) + (part > floor(part) AND row_number() OVER (PARTITION BY plan_id
                   ORDER BY round(part - floor(part), 6) DESC, stratum_key)
                   <= sample_rows - sum(floor(part)) OVER (PARTITION BY plan_id))::INT AS quota FROM parts)"""

#: DuckDB twins of those that SQL can express.
SQL = {
    "p6_quotas": f"""
        WITH {_QUOTAS}
        SELECT plan_id, stratum_key, target_share, min_rows::BIGINT AS min_rows, sample_rows, available, quota::BIGINT AS quota,
            greatest(0, greatest(min_rows, round(target_share * sample_rows)) - quota)::BIGINT AS short,
            available < greatest(min_rows, target_share * sample_rows) AS out_of_reach FROM quotas""",
    "p6_sample": f"""
        WITH {_QUOTAS}, keyed AS (
            SELECT *, ((item % 2147483647 + 2147483647) % 2147483647 * 1103515245 + 42) % 2147483647 AS k FROM members)
        SELECT plan_id, stratum_key, item AS item_id FROM keyed JOIN quotas USING (plan_id, stratum_key)
        QUALIFY row_number() OVER (PARTITION BY plan_id, stratum_key
                                   ORDER BY (k % 65536 * 48271 + k // 65536) % 2147483647, item) <= quota""",
    "p6_found": f"""
        WITH {_MEMBERS}
        SELECT t.plan_id, t.stratum_key FROM sample_targets t LEFT JOIN members m USING (plan_id, stratum_key)
        GROUP BY t.plan_id, t.stratum_key, t.min_rows, t.target_share, t.sample_rows
        HAVING count(DISTINCT m.item) < greatest(t.min_rows::DOUBLE, t.target_share * t.sample_rows)""",
    "p7_found": """
        WITH once AS (SELECT channel_id, post_id, max(views) AS views FROM tg_posts
                      WHERE channel_id IS NOT NULL AND post_id IS NOT NULL GROUP BY ALL)
        SELECT channel_id, post_id FROM once
        QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY views DESC NULLS LAST, post_id)
                > (SELECT count(*) // 25 FROM once)""",
}
