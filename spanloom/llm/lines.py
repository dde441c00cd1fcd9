"""Line dedup by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the number of its pages. Lines above
RATIO that stand on at least LEAST_PAGES pages are boilerplate of that host and are dropped from its pages.

Lines are counted as (host, digest) pairs, once for each page, with map-side partial counts; the texts move only if
the table of boilerplate lines is too large to broadcast. A host with n pages of m lines on average has at most
m / RATIO boilerplate lines, so each host's list is bounded by the size of its pages, not by their number. Hosts
with at least a thousandth of all pages (at most a thousand hosts) are salted in the join.

Defined cases: lines end at \\n and compare after trimming spaces; blank lines are never counted nor dropped; a null
or empty text has no lines and stays as it is; null hosts count as the host ''; repeated rows are pages each; a text
that loses all its lines becomes empty; other columns stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

RATIO = 0.05
LEAST_PAGES = 4
#: Bytes of boilerplate digests up to which they are broadcast; beyond, a salted shuffle join takes over.
BROADCAST_BYTES = 8 << 20
HOT_SHARE = 1000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, line digests, pages): the boilerplate lines of each host that has any."""
    base = pages.select(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    totals = base.groupBy("host").agg(F.count("*").alias("pages"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _solid), lambda x: F.unhex(F.md5(F.trim(x)))))
    counted = base.select("host", F.explode(digests).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    frequent = counted.join(totals, "host").filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return frequent.groupBy("host").agg(F.collect_list("line").alias("lines"), F.max("pages").alias("pages"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", ratio: float = RATIO, least: int = LEAST_PAGES, counts: bool = False) -> DataFrame:
    """pages without the boilerplate lines of their hosts, in the same columns.

    With counts set, two more columns: n_lines (all lines of the text) and n_dropped.
    """
    named = boilerplate(pages, host, text, ratio, least)
    found = save(named, "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines") * 17 + F.length("host") + 16), F.lit(0))).first()[0]
    site = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), site.alias("__host"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("__mix"))
    table = found.select(F.col("host").alias("__of"), F.col("lines").alias("__lines"), F.col("pages").alias("__pages"))
    if size <= BROADCAST_BYTES:
        joined = packed.join(F.broadcast(table.drop("__pages")), F.col("__host") == F.col("__of"), "left")
    else:
        total = pages.count()
        salts = (F.col("__pages") * HOT_SHARE / F.lit(max(1, total))).cast("int") + 1
        hot = table.filter(F.col("__pages") >= total / HOT_SHARE).select(F.col("__of").alias("__hot"), salts.alias("__salts"))
        spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        marked = packed.join(F.broadcast(hot), F.col("__host") == F.col("__hot"), "left")  # at most HOT_SHARE rows
        marked = marked.withColumn("__at", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.col("__mix"), F.col("__salts"))).cast("int"))
        joined = marked.join(spread, (F.col("__host") == F.col("__of")) & (F.col("__at") == F.col("__salt")), "left")
    old = F.col(f"__row.`{text}`")
    lines = _lines(old.cast("string"))
    bad = F.filter(lines, lambda x: _solid(x) & F.array_contains(F.col("__lines"), F.unhex(F.md5(F.trim(x)))))
    kept = F.filter(lines, lambda x: ~(_solid(x) & F.array_contains(F.col("__lines"), F.unhex(F.md5(F.trim(x))))))
    has = F.col("__lines").isNotNull() & old.isNotNull()
    new = F.when(has, F.array_join(kept, "\n")).otherwise(old)
    out = [new.alias(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in pages.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        out.append(F.when(old.isNull() | (old == ""), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"))
        out.append(F.when(has, F.size(bad)).otherwise(0).cast("long").alias("n_dropped"))
    return joined.select(*out)


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 4: documents without the lines that are frequent in their source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, row_number() OVER () AS page FROM documents),
split AS (SELECT page, host, string_split(text, chr(10)) AS ls FROM pages WHERE text IS NOT NULL),
seen AS (SELECT DISTINCT page, host, trim(x) AS line FROM (SELECT page, host, unnest(ls) AS x FROM split) WHERE trim(x) <> ''),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
bad AS (SELECT s.host, s.line FROM seen s JOIN totals t USING (host) GROUP BY s.host, s.line, t.pages
        HAVING count(*) >= {LEAST_PAGES} AND count(*) > t.pages * CAST({RATIO} AS DOUBLE)),
sets AS (SELECT host, list(line) AS bads FROM bad GROUP BY host)
SELECT p.doc_id,
       CAST(CASE WHEN p.text IS NULL OR p.text = '' THEN 0 ELSE len(s.ls) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN b.bads IS NULL OR s.ls IS NULL THEN 0 ELSE len(list_filter(s.ls, lambda x: list_contains(b.bads, trim(x)))) END AS BIGINT) AS n_dropped,
       sha256(CASE WHEN s.ls IS NULL THEN '' WHEN b.bads IS NULL THEN p.text
              ELSE coalesce(array_to_string(list_filter(s.ls, lambda x: NOT list_contains(b.bads, trim(x))), chr(10)), '') END) AS kept_sha256
FROM pages p LEFT JOIN split s USING (page) LEFT JOIN sets b ON b.host = p.host
"""
