"""Tokens for topic models: tokenizer, lemmas, stop words, phrases to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_list, strip
from ..session import durable

#: English function words dropped before topic modelling (public stop word lists agree on them).
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
#: Single words dropped from phrased tokens, first and second list.
UNIGRAM_STOPS_1 = ("include", "result", "subject", "certain", "addition", "future", "new", "provide", "business", "company")
UNIGRAM_STOPS_2 = (
    "change", "service", "operation", "increase", "impact", "time", "example", "additional", "ability", "experience", "market", "issue", "affect", "activity", "share", "respect",
    "operate", "use", "party", "states", "relate", "continue", "product", "united", "requirement", "cause", "significant", "exist", "base", "expect", "event", "far",
)
#: Terms that never label a topic.
LABEL_STOPS = ("limit_experience", "acquire_business", "chief_executive_officer", "result_material", "adversely_affect_value_share", "united_states")


def topic_tokens(c: Column, keep_numbers: bool = False) -> Column:
    """Lower-case words with an inner apostrophe, tags dropped; numbers become <NUM>. With
    ``keep_numbers`` thousands lose their commas, yet digits never are tokens."""
    s = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    s = F.regexp_replace(s, r"(\d),(?=\d{3}\b)", "$1") if keep_numbers else F.regexp_replace(s, r"\d+(?:[,\.\d]*\d)?", "<NUM>")
    return F.regexp_extract_all(s, F.lit(r"<NUM>|[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))


def corpus_tokens(c: Column) -> Column:
    """The tokenizer of the corpus statistics: no number marks."""
    s = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    return F.regexp_extract_all(s, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))


def lemmatised(tokens: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Default lemmas: a small dictionary, then suffix rules for plurals. ``lemmas`` overrides; a model can
    be put in its place by mapping over the table before this."""
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair]) if lemmas else None

    def rule(t: Column) -> Column:
        long = F.length(t) > 4
        out = (
            F.when(long & t.endswith("ies"), F.regexp_replace(t, "ies$", "y"))
            .when(long & t.rlike("(sses|shes|ches|xes)$"), F.regexp_replace(t, "es$", ""))
            .when(long & t.rlike("[^su]s$"), F.regexp_replace(t, "s$", ""))
            .otherwise(t)
        )
        return F.coalesce(table[t], out) if table is not None else out

    return F.transform(tokens, rule)


def filtered(tokens: Column, stopwords=STOPWORDS) -> Column:
    """Without number marks, stop words and single letters, in lower case."""
    kept = F.filter(tokens, lambda t: ~t.isin("<NUM>", "num"))
    return F.filter(F.transform(kept, F.lower), lambda t: ~in_list(t, stopwords) & (F.length(t) > 1))


def without_number_marks(tokens_str: Column) -> Column:
    """Tokens from their joined form, number marks dropped in any case."""
    return F.filter(F.split(tokens_str, r"\s+"), lambda t: (t != "") & ~F.lower(t).isin("<num>", "num"))


#: An entry of a list literal, in either kind of quotes, with escapes.
_ENTRY = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def coerced(c: Column) -> Column:
    """Tokens from a list literal (``['a', "it's"]``, escapes allowed) or from words with spaces between;
    blanks dropped."""
    entries = F.regexp_extract_all(c, F.lit(_ENTRY), F.lit(0))
    plain = F.transform(entries, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    # A literal has nothing but commas and blanks between its entries.
    literal = F.regexp_replace(c, _ENTRY, "").rlike(r"^\s*\[[\s,]*\]\s*$")
    listed = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\s+"))
    tokens = F.when(literal, plain).when(strip(c).startswith("["), listed).otherwise(F.split(c, r"\s+"))
    return F.filter(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), strip), lambda t: t != "")


def unphrased(tokens: Column, phrases) -> Column:
    """Listed phrases are taken apart in place."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.contains("_") & in_list(t, phrases), F.split(t, "_")).otherwise(F.array(t))))


def without_listed(tokens: Column, entries) -> Column:
    """Without any listed token, single words included."""
    return F.filter(tokens, lambda t: ~in_list(t, entries))


def without_unigrams(tokens: Column, words) -> Column:
    """Without listed single words; tokens with ``_`` stay."""
    return F.filter(tokens, lambda t: t.contains("_") | ~in_list(F.lower(t), words))


def with_places(df: DataFrame, order: str, out: str) -> DataFrame:
    """df with each row's place (from 0) by ``order``. Dense places come from counts per range of the order: each range
    is numbered by itself, and only the ranges' sizes are added up in one place."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    numbered = ranged.withColumn("_all", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_n0") + F.col("_all") - 1).drop("_part", "_all", "_n0")


def nonempty_view(df: DataFrame, tokens: str = "tokens", order: str = "row_id") -> DataFrame:
    """Documents that have tokens, with orig_row (0-based place among all) and lda_doc_id (0-based place among
    those kept)."""
    placed = with_places(df.withColumn("token_len", F.size(tokens)), order, "orig_row").where("token_len > 0")
    return with_places(placed, "orig_row", "lda_doc_id")


def full_stopwords(spark) -> set[str]:
    """The list above with the English list that Spark's own stop word remover brings."""
    from pyspark.ml.feature import StopWordsRemover

    return set(STOPWORDS) | {w.lower() for w in StopWordsRemover.loadDefaultStopWords("english")}


def label_terms(terms: DataFrame, topic: str = "topic_id", order: str = "rank", term: str = "term", stops=LABEL_STOPS, head: int = 50, top: int = 10) -> DataFrame:
    """Per topic the first ``top`` of its first ``head`` terms that are no stop phrases, joined by ", "."""
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(order, term))), lambda x: F.lower(strip(x[term])))
    kept = F.filter(F.slice(gathered, 1, head), lambda t: (t != "") & ~in_list(t, stops))
    return terms.groupBy(topic).agg(F.array_join(F.slice(kept, 1, top), ", ").alias("terms"))
