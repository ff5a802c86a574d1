"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read
from . import groups, mixing, overlap, packing, quotas, stuffing, terms


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.normalised(read(spark, d, "qa_v3"), read(spark, d, "name_dict"), read(spark, d, "controls"))
    return overlap.found_pairs(rows)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "qa_v3")
    rows = overlap.normalised(records, read(spark, d, "name_dict"), read(spark, d, "controls"))
    return overlap.overlap_report(records, rows)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = overlap.normalised(read(spark, d, "qa_v3"), read(spark, d, "name_dict"), read(spark, d, "controls"))
    return overlap.overlap_classes(rows)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(read(spark, d, "qa_v3")).where("mark is not null").select("field", "term")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(read(spark, d, "qa_v3"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.related(*(read(spark, d, t) for t in ("qa_v3", "molecules", "name_dict", "controls")))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return groups.grouped_split(*(read(spark, d, t) for t in ("qa_v3", "name_dict", "controls")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).where("unmet").select("plan_id", "target_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.plan_report(*(read(spark, d, t) for t in ("qa_v3", "sample_plans", "sample_targets")))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.draw_sample(*(read(spark, d, t) for t in ("qa_v3", "sample_plans", "sample_targets")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    containers = read(spark, d, "containers")
    largest = containers.orderBy(F.desc("capacity"), "container_id").limit(1)
    return packing.divided(packing.pack_documents(read(spark, d, "documents"), largest))


def p5_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "containers"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_pack(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("unmet").select("mix_id", "source")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sample_mix(*(read(spark, d, t) for t in ("documents", "mixes", "mix_targets")))[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*mixing.sample_mix(*(read(spark, d, t) for t in ("documents", "mixes", "mix_targets"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(read(spark, d, "documents"))


def p7_measures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.measure_pages(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_report, p1_classes, p2_found, p2_counts, p3_found, p3_split, p4_found, p4_report, p4_sample,
            p5_found, p5_pack, p5_report, p6_found, p6_sample, p6_report, p7_found, p7_measures,
        )
    }


def _term_sql(c: str) -> str:
    """SQL of ``functions.text.term``."""
    wide, plain = ("".join(chr(x + d) for x in range(0x21, 0x7F)).replace("'", "''") for d in (0xFEE0, 0))
    folded = f"regexp_replace(translate({c}, '{wide}', '{plain}'), '[\\p{{Cf}}]', '', 'g')"
    return f"nullif(trim(regexp_replace(lower({folded}), '[\\s\\p{{Z}}\\x{{85}}_\\-]+', ' ', 'g')), '')"


def oracle_sql() -> dict[str, str]:
    counts = f"""WITH r AS (SELECT DISTINCT ON (row_id) row_id, prop, kind, name, pairs FROM qa_v3 WHERE row_id IS NOT NULL),
 t AS (SELECT 'prop' AS field, {_term_sql('prop')} AS term, row_id FROM r UNION ALL SELECT 'kind', {_term_sql('kind')}, row_id FROM r
  UNION ALL SELECT 'name', {_term_sql('name')}, row_id FROM r UNION ALL SELECT 'prop', {_term_sql('p.prop')}, row_id FROM (SELECT row_id, unnest(pairs) AS p FROM r)),
 c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT row_id) AS records, max(row_id) AS last_record FROM t WHERE term IS NOT NULL GROUP BY ALL)
 SELECT *, CASE WHEN records < {terms.LEAST_RECORDS} THEN 'rare' WHEN records > {terms.MOST_SHARE}::DOUBLE * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c"""
    unmet = f"""WITH r AS (SELECT DISTINCT ON (row_id) {_term_sql('kind')} AS k, {_term_sql('prop')} AS p FROM qa_v3 WHERE row_id IS NOT NULL),
 c AS (SELECT k, p, count(*) AS n FROM r GROUP BY ALL),
 g AS (SELECT t.plan_id, target_id, {_term_sql('kind')} AS wk, {_term_sql('prop')} AS wp, greatest(min_rows, floor(share * sample_rows + 0.5)) AS needed
  FROM sample_targets t JOIN sample_plans s ON s.plan_id = t.plan_id)
 SELECT plan_id, target_id FROM g WHERE coalesce((SELECT sum(n) FROM c WHERE (wk IS NULL OR c.k = wk) AND (wp IS NULL OR c.p = wp) AND (wk IS NOT NULL OR wp IS NOT NULL)), 0) < needed"""
    return {"p2_counts": counts, "p2_found": f"SELECT field, term FROM ({counts}) WHERE mark IS NOT NULL", "p4_found": unmet}
