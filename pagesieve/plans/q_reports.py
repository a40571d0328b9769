"""Report queries R1..R5 (R6 sits with the perplexity operator in q_lexical)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import reports as RP
from ..sources import tables
from . import sqlparts as Q
from .common import round_doubles
from .q_clean import ART_CTE
from .registry import query


@query("r01_class_counts", f"""WITH {ART_CTE}
SELECT slop, count(*) AS n FROM art WHERE slop IS NOT NULL GROUP BY slop""")
def r01_class_counts(spark, sf_dir):
    return RP.class_counts(tables.articles(spark, sf_dir))


@query("r02_domain_class_pivot", f"""WITH {ART_CTE}
SELECT domain, count(*) FILTER (WHERE slop = 'Non-Slop') AS non_slop, count(*) FILTER (WHERE slop = 'Slop') AS slop
FROM art WHERE slop IS NOT NULL GROUP BY domain""")
def r02_domain_class_pivot(spark, sf_dir):
    return RP.domain_class_pivot(tables.articles(spark, sf_dir))


def _hist_sql(value: str, bins: int = 50) -> str:
    return f"""WITH {ART_CTE},
v AS (SELECT ({value})::DOUBLE AS x FROM art WHERE text IS NOT NULL),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) END::BIGINT AS bin,
      lo, (hi - lo) / {bins}.0 AS w FROM v, e)
SELECT bin, round(any_value(lo) + any_value(w) * bin, 6) AS lower, count(*) AS n FROM b GROUP BY bin"""


@query("r03_length_histogram_k", _hist_sql("length(text) / 1000.0"))
def r03_length_histogram_k(spark, sf_dir):
    a = tables.articles(spark, sf_dir).where(F.col("text").isNotNull())
    return round_doubles(RP.equal_width_histogram(a, F.length("text") / F.lit(1000.0)))


@query("r03_length_histogram_half_k", _hist_sql("length(text) / 500.0"))
def r03_length_histogram_half_k(spark, sf_dir):
    a = tables.articles(spark, sf_dir).where(F.col("text").isNotNull())
    return round_doubles(RP.equal_width_histogram(a, F.length("text") / F.lit(500.0)))


_PARA_SQL = f"len(list_filter(string_split_regex(text, {Q.lit(P.PARAGRAPH_SPLIT)}), lambda p: regexp_matches(p, {Q.lit(P.NOT_S)})))"


@query("r04_paragraph_count_histogram", f"""WITH {ART_CTE}
SELECT {_PARA_SQL} AS value, count(*) AS n FROM art WHERE text IS NOT NULL GROUP BY 1""")
def r04_paragraph_count_histogram(spark, sf_dir):
    a = tables.articles(spark, sf_dir).where(F.col("text").isNotNull())
    return RP.value_histogram(a, F.size(T.paragraphs(F.col("text"))).cast("long"))


@query("r05_length_mean_var", f"""WITH {ART_CTE}
SELECT slop, round(avg(length(text)), 6) AS mean, round(var_pop(length(text)), 6) AS var, count(text) AS n
FROM art WHERE slop IS NOT NULL GROUP BY slop""")
def r05_length_mean_var(spark, sf_dir):
    a = tables.articles(spark, sf_dir).where(F.col("slop").isNotNull())
    return round_doubles(RP.mean_var(a, F.length("text"), by="slop"))
