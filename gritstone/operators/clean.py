"""Filings to clean company-year texts: names, lines, tables of contents, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_list, is_title, is_upper, let, ordered_join, starts_upper, strip, words

#: Words that may stand in lower case in a heading, and the months.
LOWER_OK = ("to", "of", "and", "for", "in", "on", "with", "at", "by", "the", "a", "an")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: How headings of risk sections begin.
HEADINGS = (
    r"^Risk(s)? Related to ",
    r"^Risks Associated With ",
    r"^General Risks$",
    r"^Legal Proceedings$",
    r"^Regulatory Risks$",
    r"^Risk Factor Summary$",
    r"^Summary of Risk Factors$",
    r"^Certain Risks? Relating to ",
)
#: Stand-in for a tagger: English words that do not begin a noun phrase read as a heading.
CLOSED_CLASS = (
    *LOWER_OK, "we", "our", "us", "you", "your", "he", "she", "it", "its", "they", "their", "this", "that", "these", "those", "if", "when", "while", "as", "because", "although", "however",
    "there", "here", "is", "are", "was", "were", "be", "been", "have", "has", "had", "may", "might", "can", "could", "will", "would", "should", "must", "not", "no", "any", "some", "such", "from", "or", "but",
)
#: Marked title lines, and page numbers before the words "table of contents".
TITLE_LINE = r"(?i)^\s*##title\b"
TABLE_OF_CONTENTS = r"(?i)(?:\d{1,3}[ \t]*(?:\n{0,2})[ \t]*)table of contents"

Predicate = Callable[[Column], Column]


def parse_filename(df: DataFrame, col: str = "filename") -> DataFrame:
    """Add Company, FilingType (upper case), Year from ``Company_Filing_YYYYMMDD`` or
    ``Company_Filing_Year_Date``; rows that lack any of them are dropped."""
    parts = F.split(F.regexp_replace(F.regexp_replace(col, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), "_")
    third = F.get(parts, 2)
    year = F.when(F.size(parts) >= 4, F.regexp_extract(third, r"^(\d{4})", 1)).when((F.size(parts) == 3) & third.rlike(r"^\d{8}$"), F.substring(third, 1, 4))
    known = F.size(parts) >= 3
    out = df.withColumn("Company", F.when(known, F.get(parts, 0))).withColumn("FilingType", F.when(known, F.upper(F.get(parts, 1))))
    return out.withColumn("Year", F.nullif(year, F.lit("")).try_cast("int")).dropna(subset=["Company", "FilingType", "Year"])


def parse_filename_lenient(df: DataFrame, col: str = "filename") -> DataFrame:
    """The same without checks: a name of fewer than three parts is Unknown; Year is text."""
    parts = F.split(F.replace(F.col(col), F.lit(".txt"), F.lit("")), "_")
    known = F.size(parts) >= 3
    pick = lambda c: F.when(known, c).otherwise("Unknown")
    return df.withColumn("Company", pick(F.get(parts, 0))).withColumn("FilingType", pick(F.get(parts, 1))).withColumn("Year", pick(F.substring(F.get(parts, 2), 1, 4)))


def explode_lines(df: DataFrame, col: str = "content") -> DataFrame:
    """One row for each line: pos (from 0) and line; all newline conventions count."""
    text = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "^\uFEFF", "")
    return df.select(*[c for c in df.columns if c != col], F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "line"))


def clean_line(c: Column) -> Column:
    """Without zero-width characters; tabs and runs of white space become one space; stripped."""
    c = F.translate(F.regexp_replace(c, "[\u200B-\u200D\uFEFF]", ""), "\t", " ")
    return strip(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def is_title_line(c: Column) -> Column:
    return c.rlike(TITLE_LINE)


def keep_lines(df: DataFrame, min_len: int = 1, col: str = "line") -> DataFrame:
    """Lines that are no marked titles, cleaned, and at least ``min_len`` (and one) long."""
    cleaned = df.where(~is_title_line(F.col(col))).withColumn(col, clean_line(F.col(col)))
    return cleaned.where(F.length(col) >= max(1, min_len))


def line_audit(df: DataFrame, by: str = "filename", min_len: int = 1) -> DataFrame:
    """Per file: marked title lines dropped and lines kept. One partial aggregation, no join."""
    titled = is_title_line(F.col("line"))
    kept = ~titled & (F.length(clean_line(F.col("line"))) >= max(1, min_len))
    return df.groupBy(by).agg(F.count_if(titled).alias("dropped_title_lines"), F.count_if(kept).alias("kept_lines"))


def collapse(c: Column) -> Column:
    """All non-blank lines, stripped, on one line."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), " ")


def strip_contents(c: Column) -> Column:
    """Without page numbers that stand before "table of contents", and without those words."""
    return F.regexp_replace(c, TABLE_OF_CONTENTS, "")


def has_contents(c: Column) -> Column:
    return c.rlike(TABLE_OF_CONTENTS)


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, blanks left out."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def inline_title_parts(c: Column) -> Column:
    """A paragraph cut before each "Risk(s) Related/Relating to X" that follows a full stop or semicolon."""
    marked = F.regexp_replace(c, r"(?<=[.;])\s+(?=Risks? (?:Related|Relating) to [A-Z])", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda p: p != "")


def has_date_or_number(c: Column) -> Column:
    """Any word is all digits, a date like 1/2 or 1.2.2023, or a month."""
    return F.exists(words(F.lower(c)), lambda w: w.rlike(r"^\d+$") | w.rlike(r"^\d{1,2}[./-]\d{1,2}([./-]\d{2,4})?$") | in_list(w, MONTHS))


def noun_first(c: Column) -> Column:
    """Default for "begins like a noun phrase": the first word is in no closed class. Pluggable."""
    first = F.lower(F.coalesce(F.get(words(c), 0), F.lit("")))
    return (first != "") & ~in_list(F.regexp_replace(first, r"[^\p{L}]", ""), CLOSED_CLASS)


def _capitals(ws: Column) -> Column:
    return F.size(F.filter(ws, lambda w: starts_upper(w) & ~in_list(F.lower(w), LOWER_OK)))


def is_heading(c: Column, noun: Predicate = noun_first) -> Column:
    """A paragraph that is a heading as a whole."""
    ws = words(F.regexp_replace(c, "\n", " "))
    return (_capitals(F.slice(ws, 1, 12)) >= 3) & (F.size(ws) <= 12) & ~strip(c).rlike(r"[.!?;:]$") & noun(c) & ~has_date_or_number(c)


#: The first words of HEADINGS: only windows that begin so are held against the patterns.
_HEADING_STARTS = ("Risk", "Risks", "General", "Legal", "Regulatory", "Summary", "Certain")
#: A word as it may stand in a title: no letters, or each run of them in upper and then lower case.
_TITLE_WORD = r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*)?$"


def embedded_heading(c: Column, noun: Predicate = noun_first) -> Column:
    """The first window of words that reads as a heading before a body of five words or more, as
    struct(s, e), words s to e (exclusive) from 0; null for none. At most 72 windows are looked at. What
    does not depend on the window is worked out once for each word and kept as a string of marks, so a
    window is judged by substrings; patterns are tried only where a window begins like one."""
    known = "|".join(f"(?:{pattern})" for pattern in HEADINGS)
    marks = lambda ws, test: F.array_join(F.transform(ws, lambda w: F.when(test(w), "1").otherwise("0")), "")

    def scan(row: Column) -> Column:
        ws, n = row["ws"], F.size(row["ws"])
        span = lambda s: F.when((F.least(s + 15, n - 4) > s + 3) & (F.substring(row["nouns"], s + 1, F.lit(1)) == "1"), F.transform(F.sequence(s + 3, F.least(s + 15, n - 4) - 1), lambda e: F.struct(s.alias("s"), e.alias("e"))))
        spans = F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), span), lambda x: x.isNotNull()))

        def good(x: Column) -> Column:
            width = x["e"] - x["s"]
            within = lambda name: F.substring(row[name], x["s"] + 1, width)
            capitals = F.length(F.replace(within("caps"), F.lit("0"), F.lit("")))
            text = F.array_join(F.slice(ws, x["s"] + 1, width), " ")
            title = (width <= 8) & ~within("titled").contains("0") & within("letters").contains("1")
            begins = in_list(F.get(ws, x["s"]), _HEADING_STARTS) & text.rlike(known)
            return ~within("dated").contains("1") & ((capitals >= 3) | title | begins)

        return F.get(F.filter(spans, good), 0)

    def facts(ws: Column) -> Column:
        return F.struct(
            ws.alias("ws"), marks(ws, lambda w: starts_upper(w) & ~in_list(F.lower(w), LOWER_OK)).alias("caps"), marks(ws, noun).alias("nouns"), marks(ws, has_date_or_number).alias("dated"),
            marks(ws, lambda w: w.rlike(_TITLE_WORD)).alias("titled"), marks(ws, lambda w: w.rlike(r"\p{L}")).alias("letters"),
        )

    # A window ends at word 20 at the latest, and needs only to know whether five more follow. Fewer than eight words, or
    # none that begins in upper case, leave no window.
    first = lambda ws: F.slice(ws, 1, 26)
    return let(first(words(c)), lambda ws: F.when((F.size(ws) >= 8) & F.exists(F.slice(ws, 1, 20), lambda w: w.rlike(r"\p{Lu}")), let(facts(ws), scan)))


def without_span(c: Column, span: Column) -> Column:
    """The text without the words of a span; only stripped where there is none."""
    rest = lambda ws: F.array_join(F.concat(F.slice(ws, 1, F.greatest(span["s"], F.lit(0))), F.slice(ws, span["e"] + 1, F.greatest(F.size(ws) - span["e"], F.lit(0)))), " ")
    return F.when(span.isNull(), strip(c)).otherwise(let(words(c), rest))


def caps_heading(c: Column) -> Column:
    """The first run of three to eight words in capitals after a full stop or semicolon, or null."""
    found = strip(F.regexp_extract(c, r"(?<=[.;])\s+([A-Z][A-Z\s]{3,100})(?=\s+[A-Z])", 1))
    ws = words(found)
    long = F.size(F.filter(ws, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$")))
    upper = F.forall(ws, lambda w: is_upper(w) | in_list(F.lower(w), LOWER_OK))
    return F.when((found != "") & F.size(ws).between(3, 8) & (long >= 2) & ~has_date_or_number(found) & upper, found)


def without_caps_heading(c: Column) -> Column:
    """Without any occurrence of that run."""
    found = caps_heading(c)
    return F.when(found.isNull(), c).otherwise(strip(F.replace(c, F.coalesce(found, F.lit("\u0001")), F.lit(""))))


def clean_titles(df: DataFrame, key: list[str], col: str = "content", noun: Predicate = noun_first) -> DataFrame:
    """The whole heading pass: (key, pos, part, text, removed). ``text`` is null for a paragraph that is a
    heading; ``removed`` lists what was taken out."""
    parts = df.select(*key, F.posexplode(paragraphs(F.coalesce(F.col(col), F.lit("")))).alias("pos", "para"))
    parts = parts.select(*key, "pos", F.posexplode(inline_title_parts(F.col("para"))).alias("part", "para"))
    parts = parts.withColumn("heading", is_heading(F.col("para"), noun)).withColumn("span", embedded_heading(F.col("para"), noun))
    parts = parts.withColumn("body", without_span(F.col("para"), F.col("span"))).withColumn("caps", caps_heading(F.col("body")))
    cut = F.array_join(F.slice(words(F.col("para")), F.col("span.s") + 1, F.col("span.e") - F.col("span.s")), " ")
    removed = F.when(F.col("heading"), F.array("para")).otherwise(F.array_compact(F.array(cut, F.col("caps"))))
    return parts.select(*key, "pos", "part", F.when(~F.col("heading"), without_caps_heading(F.col("body"))).alias("text"), removed.alias("removed"))


def cleaned_files(cleaned: DataFrame, key: str = "filename") -> DataFrame:
    """(key, text, removed_titles) of what clean_titles gives: the paragraphs that stay, with blank lines between,
    and what was taken out, one to a line. A file's text is the product, so it is gathered by design."""
    place = F.struct("pos", "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull() & (F.col("text") != ""), F.struct(place.alias("p"), F.col("text").alias("t"))))), lambda x: x["t"]), "\n\n")
    removed = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("removed").alias("r")))), lambda x: x["r"])), "\n")
    return cleaned.groupBy(key).agg(text.alias("text"), removed.alias("removed_titles"))


def aggregate_company_years(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """Lines (filename, pos, line, Company, FilingType, Year) to one text for each company, filing type and
    year: by file name, then line. The text is the product, so its group is gathered by design."""
    text = ordered_join(F.struct("filename", "pos"), F.col("line"), sep)
    return lines.groupBy("Company", "FilingType", "Year").agg(text.alias("text"))


def first_known(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of every column the first value, by ``order``, that is not null."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return df.groupBy(key).agg(*[first(c) for c in df.columns if c not in (key, order)])


def enrich(main: DataFrame, info: DataFrame, key: str = "Company", order: str | None = None) -> DataFrame:
    """Left join of attributes, of each key the first that is not null in each column. Spark picks a broadcast by the
    dimension's size; a large one is joined by shuffle."""
    rest = [c for c in info.columns if c != key]
    ordered = info.withColumn("_order", F.col(order) if order else F.struct(*rest)) if rest else info.withColumn("_order", F.lit(0))
    return main.join(first_known(ordered, key, "_order"), key, "left")


def unmatched(enriched: DataFrame, attributes: list[str], key: str = "Company") -> DataFrame:
    """Keys whose attributes are all null."""
    none = F.lit(True)
    for c in attributes:
        none = none & F.col(c).isNull()
    return enriched.where(none).select(key).distinct()
