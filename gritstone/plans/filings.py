"""Queries over filings: names, lines, tables of contents, headings, company-year texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators.split import delimiter_counts
from .adapters import FILINGS, filings, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_list(entries) -> str:
    return "(" + ", ".join("'" + e.replace("'", "''") + "'" for e in sorted(entries)) + ")"


NAMED = f"""SELECT *, string_split(regexp_replace(filename, '\\.[^.]*$', ''), '_') AS p FROM ({FILINGS})"""
PARSED = f"""SELECT doc_id, filename, content, p[1] AS "Company", upper(p[2]) AS "FilingType",
TRY_CAST(CASE WHEN len(p) >= 4 THEN regexp_extract(p[3], '^(\\d{{4}})', 1) WHEN regexp_full_match(p[3], '\\d{{8}}') THEN substr(p[3], 1, 4) END AS INTEGER) AS "Year"
FROM ({NAMED}) WHERE len(p) >= 3"""
LINES = f"""SELECT doc_id, filename, "Company", "FilingType", "Year", line, pos FROM (
SELECT doc_id, filename, "Company", "FilingType", "Year", unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM ({PARSED}))"""
CLEAN_LINE = "trim(regexp_replace(replace(line, chr(9), ' '), '\\s{2,}', ' ', 'g'))"
#: A table of contents and marked titles, put into every other filing, so that the operators have work.
NOISY = f"SELECT doc_id, filename, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 90 + 1) || chr(10) || 'Table of Contents' || chr(10) || '##TITLE Item 1A' || chr(10) || content ELSE content END AS content FROM ({FILINGS})"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("doc_id") % 90 + 1).cast("string"), F.lit("\nTable of Contents\n##TITLE Item 1A\n"), F.col("content"))
    return filings(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("content")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_lines(C.parse_filename(filings(spark, sf_dir)))


@query(f'SELECT doc_id, "Company", "FilingType", "Year" FROM ({PARSED}) WHERE "Year" IS NOT NULL')
def parse_filename(spark, sf_dir):
    return C.parse_filename(filings(spark, sf_dir)).select("doc_id", "Company", "FilingType", "Year")


@query(f'SELECT doc_id, p[1] AS "Company", p[2] AS "FilingType", substr(p[3], 1, 4) AS "Year" FROM (SELECT doc_id, string_split(replace(filename, \'.txt\', \'\'), \'_\') AS p FROM ({FILINGS}))')
def parse_filename_lenient(spark, sf_dir):
    return C.parse_filename_lenient(filings(spark, sf_dir)).select("doc_id", "Company", "FilingType", "Year")


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {CLEAN_LINE} AS line FROM ({LINES})")
def clean_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", C.clean_line(F.col("line")).alias("line"))


NOISY_LINES = f"SELECT doc_id, filename, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM ({NOISY})"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {CLEAN_LINE} AS line FROM ({NOISY_LINES}) WHERE NOT regexp_matches(line, '(?i)^\\s*##title\\b') AND length({CLEAN_LINE}) >= 5")
def title_line_filter(spark, sf_dir):
    return C.keep_lines(C.explode_lines(_noisy(spark, sf_dir)), min_len=5).select("doc_id", "pos", "line")


@query(f"""SELECT filename, doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\\s*##title\\b')) AS dropped_title_lines,
count(*) FILTER (NOT regexp_matches(line, '(?i)^\\s*##title\\b') AND length({CLEAN_LINE}) >= 1) AS kept_lines FROM ({NOISY_LINES}) GROUP BY ALL""")
def audit_counts(spark, sf_dir):
    lines = C.explode_lines(_noisy(spark, sf_dir))
    return lines.groupBy("filename", "doc_id").agg(
        F.count_if(C.is_title_line(F.col("line"))).alias("dropped_title_lines"), F.count_if(~C.is_title_line(F.col("line")) & (F.length(C.clean_line(F.col("line"))) >= 1)).alias("kept_lines")
    )


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS content FROM ({FILINGS})")
def collapse_file(spark, sf_dir):
    return filings(spark, sf_dir).select("doc_id", C.collapse(F.col("content")).alias("content"))


CONTENTS = "(?i)(?:\\d{1,3}[ \\t]*(?:\\n{0,2})[ \\t]*)table of contents"


@query(f"SELECT doc_id, regexp_replace(content, '{CONTENTS}', '', 'g') AS content FROM ({NOISY})")
def strip_toc(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", C.strip_contents(F.col("content")).alias("content"))


@query(f"SELECT doc_id, regexp_replace(content, '{CONTENTS}', '', 'g') AS content FROM ({NOISY}) WHERE regexp_matches(content, '{CONTENTS}')")
def toc_matched_only(spark, sf_dir):
    d = _noisy(spark, sf_dir).where(C.has_contents(F.col("content")))
    return d.select("doc_id", C.strip_contents(F.col("content")).alias("content"))


#: Paragraphs: every third line end becomes a blank line.
PARAS = f"SELECT doc_id, regexp_replace(content, '\\.\\n', '.' || chr(10) || ' ' || chr(10), 'g') AS content FROM ({FILINGS})"
SPLIT_PARAS = f"list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).withColumn("content", F.regexp_replace("content", "\\.\n", ".\n \n"))


@query(f"SELECT doc_id, CAST(generate_subscripts({SPLIT_PARAS}, 1) - 1 AS INTEGER) AS pos, unnest({SPLIT_PARAS}) AS para FROM ({PARAS})")
def paragraph_split(spark, sf_dir):
    return _paras(spark, sf_dir).select("doc_id", F.posexplode(C.paragraphs(F.col("content"))).alias("pos", "para"))


#: Headings inside sentences: a risk heading after each full stop and space, in every third text.
INLINE = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(content, '\\. ([A-Z])', '. Risks Related to \\1', 'g') ELSE content END AS content FROM ({FILINGS})"
INLINE_PARTS = "list_filter(list_transform(string_split(regexp_replace(content, '([.;])\\s+(Risks? (?:Related|Relating) to [A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(generate_subscripts({INLINE_PARTS}, 1) - 1 AS INTEGER) AS part, unnest({INLINE_PARTS}) AS para FROM ({INLINE})")
def inline_title_split(spark, sf_dir):
    d = filings(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("content", r"\. ([A-Z])", ". Risks Related to $1")).otherwise(F.col("content")))
    return d.select("doc_id", F.posexplode(C.inline_title_parts(F.col("content"))).alias("part", "para"))


WORDS = "list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
DATE_WORD = "(regexp_full_match(w, '\\d+') OR regexp_matches(w, '^\\d{1,2}[./-]\\d{1,2}([./-]\\d{2,4})?$') OR w IN " + sql_list(C.MONTHS) + ")"


def dated(c: str) -> str:
    return f"len(list_filter({WORDS.format(c=f'lower({c})')}, lambda w: {DATE_WORD})) > 0"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {dated('line')} AS dated FROM ({NOISY_LINES})")
def date_number_predicate(spark, sf_dir):
    return C.explode_lines(_noisy(spark, sf_dir)).select("doc_id", "pos", C.has_date_or_number(F.col("line")).alias("dated"))


#: Lines in title case in every fifth row, and a run of capitals after a full stop in every seventh.
TITLED = f"""SELECT doc_id, pos, CASE WHEN doc_id % 5 = 0 AND pos = 0 THEN 'Cyber Security Threats ' || line WHEN doc_id % 7 = 0 AND pos = 1 THEN 'Intro text. SUPPLY CHAIN RISK ' || line ELSE line END AS para
FROM (SELECT doc_id, pos, line FROM ({LINES}) WHERE trim(line) <> '')"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).where(F.trim("line") != "")
    para = F.when((F.col("doc_id") % 5 == 0) & (F.col("pos") == 0), F.concat(F.lit("Cyber Security Threats "), "line")).when((F.col("doc_id") % 7 == 0) & (F.col("pos") == 1), F.concat(F.lit("Intro text. SUPPLY CHAIN RISK "), "line")).otherwise(F.col("line"))
    return d.select("doc_id", "pos", para.alias("para"))


LOWER_OK, CLOSED = sql_list(C.LOWER_OK), sql_list(C.CLOSED_CLASS)


def capitals(ws: str) -> str:
    return f"len(list_filter({ws}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN {LOWER_OK}))"


def noun(first: str) -> str:
    return f"(coalesce({first}, '') <> '' AND regexp_replace(lower({first}), '[^\\p{{L}}]', '', 'g') NOT IN {CLOSED})"


@query(f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, {capitals('ws[1:12]')} >= 3 AND len(ws) <= 12 AND NOT regexp_matches(trim(para), '[.!?;:]$') AND {noun('ws[1]')} AND NOT {dated('para')} AS heading
FROM (SELECT *, {WORDS.format(c='para')} AS ws FROM ({TITLED}))""")
def title_paragraphs(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", "pos", C.is_heading(F.col("para")).alias("heading"))


KNOWN_HEADING = " OR ".join(f"regexp_matches(t, '{p}')" for p in C.HEADINGS)
IS_TITLE = "regexp_matches(t, '^[^\\p{L}]*\\p{Lu}\\p{Ll}*(?:[^\\p{L}]+\\p{Lu}\\p{Ll}*)*[^\\p{L}]*$')"


@query(f"""WITH p AS (SELECT doc_id, pos, para, {WORDS.format(c='para')} AS ws FROM ({TITLED})),
c AS (SELECT doc_id, pos, ws, s, e, array_to_string(ws[s + 1:e], ' ') AS t FROM (SELECT doc_id, pos, ws, s, unnest(range(s + 3, least(s + 15, len(ws)))) AS e FROM (SELECT doc_id, pos, ws, unnest(range(0, 6)) AS s FROM p))),
g AS (SELECT doc_id, pos, min(s * 100000 + e) AS best FROM c WHERE len(ws) - e >= 5 AND ({capitals('ws[s + 1:e]')} >= 3 OR {KNOWN_HEADING} OR ({IS_TITLE} AND e - s <= 8)) AND {noun('ws[s + 1]')} AND NOT {dated('t')} GROUP BY ALL)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN best IS NULL THEN trim(para) ELSE array_to_string(list_concat(ws[1:best // 100000], ws[best % 100000 + 1:]), ' ') END AS text FROM p LEFT JOIN g USING (doc_id, pos)""")
def embedded_title_removal(spark, sf_dir):
    d = _titled(spark, sf_dir).withColumn("span", C.embedded_heading(F.col("para")))
    return d.select("doc_id", "pos", C.without_span(F.col("para"), F.col("span")).alias("text"))


@query(f"""WITH p AS (SELECT doc_id, pos, para, trim(regexp_extract(para, '[.;]\\s+([A-Z][A-Z\\s]{{3,100}})\\s+[A-Z]', 1)) AS found FROM ({TITLED})),
w AS (SELECT *, {WORDS.format(c='found')} AS ws FROM p)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN found <> '' AND len(ws) BETWEEN 3 AND 8 AND len(list_filter(ws, lambda w: length(w) >= 3)) >= 2 AND NOT {dated('found')} THEN trim(replace(para, found, '')) ELSE para END AS text FROM w""")
def caps_title_removal(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", "pos", C.without_caps_heading(F.col("para")).alias("text"))


COMPANY_YEARS = f"""SELECT "Company", "FilingType", "Year", string_agg({CLEAN_LINE}, chr(10) ORDER BY filename, doc_id, pos) AS text
FROM ({LINES}) WHERE length({CLEAN_LINE}) >= 1 GROUP BY ALL"""


def company_years(spark, sf_dir):
    lines = C.keep_lines(_lines(spark, sf_dir))
    # Several filings share a name here, so the document orders them.
    return C.aggregate_company_years(lines.withColumn("filename", F.struct("filename", "doc_id")))


@query(f"""SELECT "Company", "FilingType", "Year", text, length(text) AS n_chars, len({WORDS.format(c='text')}) AS n_words FROM ({COMPANY_YEARS})""")
def company_year_aggregate(spark, sf_dir):
    from ..functions.text import words

    return company_years(spark, sf_dir).select("Company", "FilingType", "Year", "text", F.length("text").cast("bigint").alias("n_chars"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))


#: Attributes of two thirds of the companies; the others stay unmatched. Nation 3 comes twice.
INFO = """SELECT 'src' || n_nationkey AS "Company", n_name AS "Company Fullname", r_name AS "Headquarters location", n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'src4', 'a later duplicate', 'nowhere', 1000"""


def _info(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    info = n.where("n_nationkey % 3 <> 0").join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("src"), "n_nationkey").alias("Company"), F.col("n_name").alias("Company Fullname"), F.col("r_name").alias("Headquarters location"), F.col("n_nationkey").cast("int").alias("k"))
    return info.unionByName(spark.range(1).select(F.lit("src4").alias("Company"), F.lit("a later duplicate").alias("Company Fullname"), F.lit("nowhere").alias("Headquarters location"), F.lit(1000).alias("k")))


ENRICHED = f"""SELECT m.*, i."Company Fullname", i."Headquarters location" FROM (SELECT "Company", "FilingType", "Year" FROM ({PARSED}) GROUP BY ALL) m
LEFT JOIN (SELECT * FROM ({INFO}) QUALIFY row_number() OVER (PARTITION BY "Company" ORDER BY k) = 1) i ON m."Company" = i."Company\""""


def _enriched(spark, sf_dir):
    main = C.parse_filename(filings(spark, sf_dir)).select("Company", "FilingType", "Year").distinct()
    return C.enrich(main, _info(spark, sf_dir), order="k").drop("k")


@query(f'SELECT "Company", "FilingType", "Year", "Company Fullname", "Headquarters location" FROM ({ENRICHED})')
def enrich_left_join(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query(f'SELECT DISTINCT "Company" FROM ({ENRICHED}) WHERE "Company Fullname" IS NULL AND "Headquarters location" IS NULL')
def unmatched_companies(spark, sf_dir):
    return C.unmatched(_enriched(spark, sf_dir), ["Company Fullname", "Headquarters location"])


@query(f"""WITH t AS (SELECT CAST(length(text) AS DOUBLE) AS n, "Company" AS c, "Year" AS y FROM ({COMPANY_YEARS}))
SELECT count(*) AS n, count(DISTINCT c) AS companies, min(y) AS first_year, max(y) AS last_year, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max,
round(quantile_cont(n, 0.01), 6) AS p01, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM t""")
def length_profile(spark, sf_dir):
    t = company_years(spark, sf_dir).select(F.length("text").cast("double").alias("n"), "Company", "Year")
    marks = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return t.agg(
        F.count("*").alias("n"), F.countDistinct("Company").alias("companies"), F.min("Year").alias("first_year"), F.max("Year").alias("last_year"), F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), *[F.round(F.percentile("n", F.lit(q)), 6).alias(k) for k, q in marks.items()],
    )


def _by_length(direction):
    def f(spark, sf_dir):
        d = filings(spark, sf_dir).select("doc_id", F.length("content").cast("bigint").alias("char_len"))
        return d.orderBy(getattr(F.col("char_len"), direction)(), "doc_id").limit(5)

    return f


QUERIES["shortest5"], ORACLE_SQL["shortest5"] = _by_length("asc"), f"SELECT doc_id, length(content) AS char_len FROM ({FILINGS}) ORDER BY 2, 1 LIMIT 5"
QUERIES["longest5"], ORACLE_SQL["longest5"] = _by_length("desc"), f"SELECT doc_id, length(content) AS char_len FROM ({FILINGS}) ORDER BY 2 DESC, 1 LIMIT 5"


@query(f"SELECT doc_id, length(content) AS char_len, count(*) OVER () AS suspects FROM ({FILINGS}) WHERE length(content) < 200 ORDER BY doc_id LIMIT 10")
def short_suspects(spark, sf_dir):
    d = filings(spark, sf_dir).select("doc_id", F.length("content").cast("bigint").alias("char_len")).where("char_len < 200")
    n = d.agg(F.count("*").alias("suspects"))
    return d.orderBy("doc_id").limit(10).join(F.broadcast(n))  # one row


@query(f"""WITH s AS (SELECT doc_id, content, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1:50] AS l FROM ({FILINGS})),
k AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, ',', '')))), 0) AS BIGINT) AS comma, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, ';', '')))), 0) AS BIGINT) AS semicolon, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x) - length(replace(x, chr(9), '')))), 0) AS BIGINT) AS tab FROM s)
SELECT *, CASE WHEN greatest(comma, semicolon, tab) = 0 THEN NULL WHEN tab = greatest(comma, semicolon, tab) THEN 'tab' WHEN comma = greatest(comma, semicolon, tab) THEN 'comma' ELSE 'semicolon' END AS delimiter FROM k""")
def delimiter_sniff(spark, sf_dir):
    return filings(spark, sf_dir).select("doc_id", *delimiter_counts(F.col("content")))
