"""Queries of the general data-curation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.chars import INVISIBLE_CLASS, one_to_one, width_pairs
from veilspark.operators.units import LOWER, UPPER, all_aliases, normalize_quantities, same_quantity_pairs
from veilspark.session import load

_MEASURED = "kind in ('amount', 'technical_metric')"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities of one project and kind that state one quantity in different units or scales."""
    e = load(spark, sf_dir, "entities").filter(_MEASURED)
    return same_quantity_pairs(e, "entity_id", ["project_id", "kind"], "original", "replacement_hint")


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount and metric once, as a number in the base unit of its dimension."""
    e = load(spark, sf_dir, "entities").filter(_MEASURED).select("entity_id", "kind", "original", "replacement_hint")
    q = normalize_quantities(e, "original", "replacement_hint").select("entity_id", "kind", F.col("q_value").cast("double").alias("value"), F.col("q_dimension").alias("dimension"), F.col("q_unit").alias("unit"), F.col("q_bound").alias("bound"))
    return q.distinct()


def _sql() -> str:
    """The quantities of entities in SQL: the same steps, written for an engine without lookahead."""
    one, two = one_to_one()
    wide, narrow = width_pairs()
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    fold = lambda c: f"translate(regexp_replace(translate(regexp_replace({c}, {lit(INVISIBLE_CLASS)}, '', 'g'), {lit(one + chr(0x2010))}, {lit(two + '-')}), {lit(INVISIBLE_CLASS)}, '', 'g'), {lit(wide)}, {lit(narrow)})"
    joined = f"regexp_replace({fold('original')}, '\\s+', '', 'g')"
    for _ in range(3):
        joined = f"regexp_replace({joined}, '(\\d),(\\d)', '\\1\\2', 'g')"
    words = "|".join(UPPER + LOWER)
    lead = "^(US\\$|\\$|€|[A-Z]{3}|百分之|千分之|人民币)?"
    han = "[零〇一二两三四五六七八九十百千]+"
    number = "[+-]?\\d+(?:\\.\\d+)?"
    digit = lambda p: f"greatest(instr('一二三四五六七八九', translate(regexp_extract(hn, '{p}', 1), '两', '二')), 0) * (length(regexp_extract(hn, '{p}', 1)) > 0)::INT"
    d = "[一二两三四五六七八九]"
    value = f"({digit(f'({d})千')}) * 1000 + ({digit(f'({d})百')}) * 100 + CASE WHEN contains(hn, '十') THEN greatest(({digit(f'({d})十')}), 1) * 10 ELSE 0 END + ({digit(f'({d})$')})"
    hint = fold("replacement_hint")
    named = f"coalesce(nullif(regexp_extract(h, '(?:原表单位为|单位[:为是]|unit[:=])\\s*([^;,]+)', 1), ''), nullif(regexp_extract(h, '以([^;,]+)计', 1), ''))"
    plain = "nullif(regexp_extract(h, '(?:^|;)\\s*\\(?(?:in\\s)?\\s*([^;()]+?)\\s*\\)?\\s*$', 1), '')"
    rows = ", ".join(f"({lit(a)}, {lit(u)}, {lit(m)}, {f}, {o})" for a, u, m, f, o in all_aliases())
    return f"""al(alias, unit, dimension, factor, off) AS (SELECT alias, unit, dimension, CAST(factor AS DECIMAL(16,6)), CAST(off AS DECIMAL(10,2)) FROM (VALUES {rows}) t(alias, unit, dimension, factor, off)),
q0 AS (SELECT DISTINCT entity_id, project_id, kind, {joined} AS q, {hint} AS h FROM entities WHERE kind IN ('amount', 'technical_metric')),
q1 AS (SELECT *, regexp_replace(q, {lit('(?i)^(?:' + words + ')')}, '') AS b FROM q0),
q2 AS (SELECT *, regexp_extract(b, '{lead}({number})(.*)$', 2) AS dg, regexp_extract(b, '{lead}({han})(.*)$', 2) AS hn, regexp_extract(b, '{lead}({number}|{han})(.*)$', 1) AS ld, regexp_extract(b, '{lead}({number}|{han})(.*)$', 3) AS rs FROM q1),
q3 AS (SELECT entity_id, project_id, kind, CASE WHEN dg <> '' THEN try_cast(dg AS DECIMAL(20,8)) WHEN hn <> '' THEN CAST({value} AS DECIMAL(20,8)) END AS n, coalesce(nullif(rs, ''), nullif(ld, ''), regexp_replace(trim(coalesce({named}, {plain})), '\\s+', '', 'g')) AS said,
CASE WHEN regexp_matches(lower(q), {lit('^(?:' + '|'.join(UPPER) + ')')}) THEN 'at_most' WHEN regexp_matches(lower(q), {lit('^(?:' + '|'.join(LOWER) + ')')}) THEN 'at_least' ELSE 'none' END AS bound FROM q2),
qq AS (SELECT entity_id, project_id, kind, (n + off) * factor AS v, dimension, unit, bound FROM q3 LEFT JOIN al ON alias = said)""".replace("\\\\", "\\")


QUERIES = {"p3_found": p3_found, "p3_normalized": p3_normalized}
SQL = {
    "p3_found": f"WITH {_sql()}, u AS (SELECT DISTINCT * FROM qq WHERE v IS NOT NULL AND unit IS NOT NULL) SELECT DISTINCT a.entity_id AS entity_a, b.entity_id AS entity_b FROM u a JOIN u b ON a.project_id = b.project_id AND a.kind = b.kind AND a.v = b.v AND a.dimension = b.dimension AND a.bound = b.bound AND a.unit <> b.unit AND a.entity_id < b.entity_id",
    "p3_normalized": f"WITH {_sql()} SELECT DISTINCT entity_id, kind, CAST(v AS DOUBLE) AS value, dimension, unit, bound FROM qq",
}
