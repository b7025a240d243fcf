"""Named queries of the training-text operators and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.cooccurrence import cooccurrences
from webloom.llm.leakage import leaks
from webloom.llm.mainbody import furniture_lines
from webloom.llm.neardup import near_duplicates, pairs
from webloom.llm.quality import FIGURES, scored, statistics, tails
from webloom.llm.residue import residue
from webloom.llm.sentences import sentences
from webloom.llm.tokenize import token_ids
from webloom.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture_lines(table(spark, d, "pages"), "id", "text", "title", "url")


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "pages"), "id", "text", "title", status="status_code").select("id")


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return tails(table(spark, d, "pages"), "id", "text", "title", "text_length", "links_count", status="status_code")


def _p4_figures(spark: SparkSession, d: str) -> DataFrame:
    figured = checkpoint(statistics(table(spark, d, "pages"), "id", "text", "title", "text_length", "links_count", status="status_code"))
    return scored(figured).select("id", "lang", "kind", "residue", *(f"{f}{x}" for f in FIGURES for x in ("", "_z", "_pct")))


#: G² from which on a pair is no chance (one in a thousand).
SIGNIFICANT = 10.83


def _p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in five rows or more that are significant, oftener together than by chance or less often."""
    pairs = cooccurrences(table(spark, d, "pages"), "links_json", min_llr=SIGNIFICANT)
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 3))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    lifted = F.col("n_ab") * F.col("n") >= 5 * F.col("n_a") * F.col("n_b")
    return cooccurrences(table(spark, d, "pages"), "links_json").where(lifted).select(F.col("item_a").alias("link_a"), F.col("item_b").alias("link_b"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Classes and links come from the operator; they are expanded here, since every pair is asked for."""
    return pairs(*near_duplicates(table(spark, d, "pages"), "id", "text", "title"))


def _p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def _p8_edits(spark: SparkSession, d: str) -> DataFrame:
    """The same with up to two words of twelve changed, put in or left out."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", max_edits=2, recall=0.95)


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {"p1_found": _p1_found, "p2_found": _p2_found, "p3_found": _p3_found, "p3_pairs": _p3_pairs, "p4_figures": _p4_figures, "p4_found": _p4_found, "p5_found": _p5_found, "p7_ids": _p7_ids, "p8_edits": _p8_edits, "p8_found": _p8_found, "p9_found": _p9_found}


#: Addresses of each row, one by one: strings, or an object's href or url; a text encoded twice is decoded first.
ADDRESSES = """
WITH texts AS (SELECT id, CASE WHEN json_valid(links_json) THEN links_json::JSON END AS j FROM pages),
decoded AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM texts),
elements AS (SELECT id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j) = 'OBJECT' THEN [j] END) AS e FROM decoded),
items AS (SELECT DISTINCT id, CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.href') = 'VARCHAR' THEN e ->> '$.href' WHEN json_type(e, '$.url') = 'VARCHAR' THEN e ->> '$.url' END END AS item FROM elements),
own AS (SELECT * FROM items WHERE item IS NOT NULL),
counts AS (SELECT item, count(*) AS n FROM own GROUP BY item HAVING count(*) >= 5),
known AS (SELECT id, item, n FROM own JOIN counts USING (item)),
pairs AS (SELECT a.item AS link_a, b.item AS link_b, count(*) AS n_ab, any_value(a.n) AS n_a, any_value(b.n) AS n_b FROM known a JOIN known b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5)
"""
RATIO = """
, total AS (SELECT count(DISTINCT id) AS n FROM own),
cells AS (SELECT *, [n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab] AS inner_cells, [n_a, n - n_a, n_b, n - n_b] AS sides FROM pairs, total),
scored AS (SELECT *, 2 * (list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END FOR x IN inner_cells]) - list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END FOR x IN sides]) + n * ln(n)) AS g FROM cells)
SELECT link_a AS item_a, link_b AS item_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift, round(g, 3) AS llr FROM scored WHERE g >= 10.83
"""
WINDOWS = r"""
SELECT {key}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (
SELECT {key}, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'))), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": ADDRESSES + "SELECT link_a, link_b FROM pairs WHERE n_ab * (SELECT count(DISTINCT id) FROM own) >= 5 * n_a * n_b",
        "p3_pairs": ADDRESSES + RATIO,
        "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({WINDOWS.format(key='doc_id', table='documents')}) d JOIN ({WINDOWS.format(key='item_id', table='benchmark')}) b USING (run)",
    }
