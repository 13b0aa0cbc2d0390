"""Queries over web pages: titles, links, headings, entities, conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, udf
from ..operators import tables
from .registry import query, table


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages to Markdown, by Arrow batches, without a shuffle."""
    return table(spark, sf_dir, "pages").select("page_id", "url", udf.html_to_markdown(F.col("html")).alias("markdown"))


#: Folds the tokens of the tags that these pages use into Markdown; runs in DuckDB only.
_FOLD = r"""
WITH t AS (
  SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?is)<head>.*?</head>', '') AS body FROM pages
), k AS (
  SELECT page_id, title, regexp_extract_all(body, '<[^>]*>|[^<]+') AS tokens FROM t
), f AS (
  SELECT page_id, title, list_reduce(list_prepend({'md': '', 'li': '', 'in_li': false}, list_transform(tokens, lambda x: {'md': x, 'li': '', 'in_li': false})), lambda a, x: CASE
    WHEN x.md NOT LIKE '<%' THEN CASE WHEN a.in_li THEN {'md': a.md, 'li': a.li || ENT(x.md), 'in_li': true} ELSE {'md': a.md || CASE WHEN a.md LIKE '% ' THEN regexp_replace(WS(ENT(x.md)), '^ ', '') ELSE WS(ENT(x.md)) END, 'li': '', 'in_li': false} END
    WHEN regexp_matches(x.md, '^</(p|div|article|section|main|h[1-6])>$') THEN {'md': a.md || chr(10) || chr(10), 'li': a.li, 'in_li': a.in_li}
    WHEN regexp_matches(x.md, '^<(p|div|article|section|main)( [^>]*)?>$') THEN {'md': a.md || CASE WHEN a.md = '' OR a.md LIKE '%' || chr(10) THEN '' ELSE chr(10) || chr(10) END, 'li': a.li, 'in_li': a.in_li}
    WHEN regexp_matches(x.md, '^<h[1-6]( [^>]*)?>$') THEN {'md': a.md || CASE WHEN a.md = '' OR a.md LIKE '%' || chr(10) THEN '' ELSE chr(10) END || repeat('#', substr(x.md, 3, 1)::INTEGER) || ' ', 'li': a.li, 'in_li': a.in_li}
    WHEN regexp_matches(x.md, '^</?(b|strong)( [^>]*)?>$') THEN CASE WHEN a.in_li THEN {'md': a.md, 'li': a.li || '**', 'in_li': true} ELSE {'md': a.md || '**', 'li': '', 'in_li': false} END
    WHEN regexp_matches(x.md, '^<br ?/?>$') THEN CASE WHEN a.in_li THEN {'md': a.md, 'li': a.li || ' ', 'in_li': true} ELSE {'md': a.md || chr(10), 'li': '', 'in_li': false} END
    WHEN regexp_matches(x.md, '^<ul( [^>]*)?>$') THEN {'md': a.md || CASE WHEN a.md = '' OR a.md LIKE '%' || chr(10) THEN '' ELSE chr(10) END, 'li': a.li, 'in_li': a.in_li}
    WHEN x.md = '</ul>' THEN {'md': a.md || chr(10), 'li': a.li, 'in_li': a.in_li}
    WHEN regexp_matches(x.md, '^<li( [^>]*)?>$') THEN {'md': a.md, 'li': '', 'in_li': true}
    WHEN x.md = '</li>' THEN {'md': a.md || '- ' || trim(a.li, ' ' || chr(9) || chr(13) || chr(10)) || chr(10), 'li': '', 'in_li': false}
    ELSE a END) AS s FROM k
)
SELECT page_id, '# ' || ENT(trim(title, ' ' || chr(9) || chr(13) || chr(10))) || chr(10) || chr(10) || regexp_replace(s.md, chr(10) || '{3,}', chr(10) || chr(10), 'g') AS markdown FROM f
"""


def _replaced(sql: str, name: str, make) -> str:
    """Writes out NAME(argument) by the argument's text."""
    while (a := sql.find(f"{name}(")) >= 0:
        depth, b = 1, a + len(name) + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = sql[:a] + make(sql[a + len(name) + 1 : b - 1]) + sql[b:]
    return sql


def _entities_sql(arg: str) -> str:
    out = arg
    for name, sign in text.ENTITIES:
        quoted = sign.replace("'", "''")
        out = f"replace({out}, '{name}', '{quoted}')"
    return out


FOLD = _replaced(_replaced(_FOLD, "WS", lambda a: f"regexp_replace({a}, '[ \\n\\r\\t]+', ' ', 'g')"), "ENT", _entities_sql)


@query(FOLD)
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_markdown(spark, sf_dir).drop("url")


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ' || chr(9) || chr(13) || chr(10)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<[^>]*>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM pages")
def html_text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.capped_lines(F.regexp_replace("html", r"(?s)<[^>]*>", "\n")).alias("body"))


@query(f"SELECT page_id, {_entities_sql('html')} AS decoded FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.named_entities(F.col("html")).alias("decoded"))


@query(f"SELECT page_id, {_entities_sql('html')} AS decoded FROM pages")
def html_entities_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", udf.entities(F.col("html")).alias("decoded"))


@query(r"SELECT page_id, n, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label FROM (SELECT page_id, unnest(links) AS a, generate_subscripts(links, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS links FROM pages))")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit("<a [^>]*>[^<]*</a>"), 0)
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("n", "a"))
    return found.select("page_id", F.col("n").cast("long").alias("n"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label"))


@query(r"SELECT page_id, substr(h, 3, 1)::INTEGER AS level, regexp_extract(h, '>([^<]*)<', 1) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>')) AS h FROM pages)")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), 0)).alias("h"))
    return found.select("page_id", F.substring("h", 3, 1).cast("int").alias("level"), F.regexp_extract("h", ">([^<]*)<", 1).alias("heading"))


@query(FOLD.replace("SELECT page_id, '# '", "SELECT page_id, 0 AS page_ordinal, 1 AS page_number, '# '").replace("AS markdown FROM f", "AS text FROM f"))
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return tables.document_pages(files, keep=["page_id"]).select("page_id", "page_ordinal", "page_number", "text")


@query("SELECT page_id, len(string_split(html, '<p>')) - 1 AS paragraphs, strlen(html) AS bytes FROM pages")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (F.size(F.split("html", "<p>")) - 1).cast("long").alias("paragraphs"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT n_regionkey, r AS row_no, c AS column_no, v AS value FROM (SELECT n_regionkey, 0 AS r, 0 AS c, 'key' AS v FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 0, 1, 'name' FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0, n_nationkey::VARCHAR FROM nation UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, n_name FROM nation)")
def odf_cells_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import synthetic

    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), rows).alias("rows"))
    made = files.select("n_regionkey", synthetic.ods(F.col("rows")).alias("content"))
    cells = tables.table_cells(made, keep=["n_regionkey"])
    return cells.select("n_regionkey", F.col("row_no").cast("long").alias("row_no"), "column_no", "value")


@query(FOLD.replace("SELECT page_id, '# '", "SELECT page_id, 0 AS page_ordinal, '# '").replace("AS markdown FROM f", "AS text FROM f"))
def lateral_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function from SQL."""
    from ..operators import sql

    sql.register(spark)
    table(spark, sf_dir, "pages").selectExpr("page_id", "cast(html AS binary) content").createOrReplaceTempView("page_files")
    return spark.sql("SELECT f.page_id, p.page_ordinal, p.text FROM page_files f, LATERAL document_pages(f.content, 'a.html') p")


@query(FOLD)
def sql_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar function from SQL."""
    from ..operators import sql

    sql.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("web_pages")
    return spark.sql("SELECT page_id, html_markdown(html) AS markdown FROM web_pages")
