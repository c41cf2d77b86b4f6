"""Line deduplication by site-relative frequency.

Lines are counted per host: the pages of a host that contain a line, over all pages of that host. A line above the boilerplate
ratio is dropped from every page of that host. Page copies (equal whole texts on one host) count as one page on both sides of the
ratio; otherwise a page that is mirrored on its own host would count as boilerplate and vanish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_host, whole_text, written

RATIO = 0.1
#: A line on fewer distinct pages of a host is never boilerplate there, whatever its ratio.
MIN_PAGES = 3
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
#: Hosts' line lists are broadcast only up to so many lines (16 bytes each and the host); beyond that they are joined by host.
BROADCAST_LINES = 200_000


def _key(line: F.Column) -> F.Column:
    return F.regexp_replace(line, _EDGES, "")


def _hash(value: F.Column) -> F.Column:
    """128 bits of a string: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(value).alias("p"), F.xxhash64(F.lit(1), value).alias("q"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (hash), pages, total: the lines above the ratio on each host."""
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), whole_text(text_col).alias("text"))
    pages = pages.select("host", "text", F.xxhash64("text").alias("page"))
    total = pages.groupBy("host").agg(F.count_distinct("page").alias("total"))
    lines = pages.select("host", "page", F.explode(F.split("text", "\n")).alias("line")).select("host", "page", _key(F.col("line")).alias("line"))
    count = lines.where("line <> ''").select("host", _hash(F.col("line")).alias("line"), "page").select("host", "line.p", "line.q", "page").groupBy("host", "p", "q").agg(F.count_distinct("page").alias("pages"))
    return count.where(F.col("pages") >= min_pages).join(total, "host").where(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", F.struct("p", "q").alias("line"), "pages", "total")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The input rows and columns with boilerplate lines taken out of the text, plus n_lines and n_dropped.

    Lines are the parts between line feeds, compared without ASCII white space at their ends; blank lines are never dropped. Rows with
    nothing to drop keep their text as it is, a null text stays null, and a row whose lines all go stays with an empty text. A null
    host is one host of its own. Hosts with an empty table or a single page lose nothing. Columns with the names n_lines or n_dropped
    in the input are replaced.
    """
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages).select("host", "line"), "boilerplate")
    # A host has at most (mean lines of its pages) / ratio such lines, so a list per host is bounded by page length, not by pages.
    lists = found.groupBy("host").agg(F.collect_list("line").alias("__lines")).withColumnRenamed("host", "__at_host")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rows = by_host(docs.select(*[F.col(f"`{c}`") for c in kept], host.alias("__host")), lists, found, BROADCAST_LINES)
    parts = F.split(whole_text(text_col), "\n")
    stay = F.filter(parts, lambda x: (_key(x) == "") | ~F.array_contains(F.col("__lines"), _hash(_key(x))))
    rows = rows.withColumn("__stay", F.when(F.col("__lines").isNotNull(), stay))
    n = F.size(parts)
    gone = F.when(F.col("__stay").isNull(), 0).otherwise(n - F.size("__stay"))
    text = F.when(gone > 0, F.array_join("__stay", "\n")).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))


SQL = rf"""
    WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS t FROM documents),
    total AS (SELECT host, count(DISTINCT t) AS total FROM pages GROUP BY host),
    cut AS (SELECT doc_id, host, t, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS raw FROM pages),
    lines AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM cut),
    count AS (SELECT host, line, count(DISTINCT t) AS pages FROM lines WHERE line <> '' GROUP BY host, line),
    bad AS (SELECT host, line FROM count JOIN total USING (host) WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total),
    marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.line = b.line)
    SELECT doc_id, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE text END AS text, n_lines, n_dropped FROM (
        SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
        FROM marked GROUP BY doc_id) JOIN pages USING (doc_id)"""
