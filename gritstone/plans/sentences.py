"""Queries over sentences: splitting, duplicates, tokens, phrases, corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import dedup as D
from ..operators import phrases as P
from ..operators import split as S
from ..operators import tokens as T
from .adapters import CLUSTERED, HTML_TEXTS, SENTENCES, clustered, html_texts, sentences
from .filings import sql_list

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


TOKEN = "'[A-Za-z]+(?:''[A-Za-z]+)?|[\\$€£]?\\d+(?:[\\.,]\\d+)*%?'"
TOKENS = "regexp_extract_all({c}, " + TOKEN + ")"


@query(f"SELECT row_id, array_to_string({TOKENS.format(c='sentence')}, ' ') AS tokens, len({TOKENS.format(c='sentence')}) AS n FROM ({SENTENCES})")
def simple_tokens(spark, sf_dir):
    t = S.simple_tokens(F.col("sentence"))
    return sentences(spark, sf_dir).select("row_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("bigint").alias("n"))


CLOSED = "CASE WHEN {c} = '' OR regexp_matches({c}, '[.!?;]$') THEN {c} ELSE {c} || ';' END"


@query(f"SELECT row_id, {CLOSED.format(c='rtrim(sentence)')} AS sentence FROM ({SENTENCES})")
def terminal_punct(spark, sf_dir):
    return sentences(spark, sf_dir).select("row_id", S.terminated(F.col("sentence")).alias("sentence"))


SEGS = f"""SELECT sent_id, sentence_raw, i, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS txt, CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS s,
CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) + length(raw) AS BIGINT) AS e, len(parts) AS n
FROM (SELECT *, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM (SELECT *, string_split(sentence_raw, ';') AS parts FROM ({HTML_TEXTS})))"""


@query(f"SELECT sent_id, i, txt, s, e FROM ({SEGS})")
def semicolon_spans(spark, sf_dir):
    d = html_texts(spark, sf_dir).select("sent_id", F.posexplode(S.segments(F.col("sentence_raw"))).alias("i", "x"))
    return d.select("sent_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("x.txt").alias("txt"), F.col("x.s").cast("bigint").alias("s"), F.col("x.e").cast("bigint").alias("e"))


def _splitter(mode: str) -> str:
    """The fold over parts as a recursive query; state: the parts kept so far, and whether the next is skipped."""
    n_tok = "len(" + TOKENS.format(c="{c}") + ")"
    short = f"({n_tok.format(c='g.txt')} < 6 AND g.n > 1)"
    first = "len(r.out) = 0"
    merged = "list_append(r.out[1:len(r.out) - 1], {'txt': trim(r.out[len(r.out)].txt || ' ' || g.txt), 's': r.out[len(r.out)].s, 'e': g.e})"
    item = "{'txt': g.txt, 's': g.s, 'e': g.e}"
    if mode == "reference":
        wait = f"(NOT r.skip AND {first} AND {short} AND g.i < g.n)"
        out = f"CASE WHEN r.skip OR {wait} THEN r.out WHEN {short} AND NOT {first} THEN {merged} ELSE list_append(r.out, {item}) END"
        held, skip = "r.held", wait
    else:
        now = "CASE WHEN r.held IS NOT NULL THEN {'txt': trim(r.held.txt || ' ' || g.txt), 's': r.held.s, 'e': g.e} ELSE " + item + " END"
        wait = f"({first} AND {n_tok.format(c='(' + now + ').txt')} < 6 AND g.i < g.n)"
        out = f"CASE WHEN {wait} THEN r.out WHEN {first} THEN [{now}] WHEN {short} THEN {merged} ELSE list_append(r.out, {item}) END"
        held, skip = f"CASE WHEN {wait} THEN {now} END", "false"
    kind = "STRUCT(txt VARCHAR, s BIGINT, e BIGINT)"
    return f"""WITH RECURSIVE g AS MATERIALIZED ({SEGS}), t AS MATERIALIZED (SELECT *, len({TOKENS.format(c='sentence_raw')}) AS toks, length(sentence_raw) AS chars FROM ({HTML_TEXTS})),
r AS (SELECT sent_id, 0 AS i, CAST([] AS {kind}[]) AS out, CAST(NULL AS {kind}) AS held, false AS skip FROM t
UNION ALL SELECT r.sent_id, r.i + 1, {out}, {held}, {skip} FROM r JOIN g ON g.sent_id = r.sent_id AND g.i = r.i + 1),
f AS (SELECT sent_id, arg_max(out, i) AS out FROM r GROUP BY sent_id),
p AS (SELECT t.sent_id, toks, chars, CASE WHEN toks < 40 AND chars < 200 THEN [{{'txt': sentence_raw, 's': CAST(0 AS BIGINT), 'e': chars}}] ELSE out END AS pieces FROM t JOIN f USING (sent_id))
SELECT sent_id AS parent_sent_id, sub_id, sent_id || '-' || lpad(CAST(sub_id AS VARCHAR), CAST(greatest(2, length(CAST(sub_id AS VARCHAR))) AS INTEGER), '0') AS sub_sent_id, {CLOSED.format(c='rtrim(x.txt)')} AS sentence_sub,
x.s AS span_start, x.e AS span_end, toks AS parent_token_len, chars AS parent_char_len FROM (SELECT *, unnest(pieces) AS x, generate_subscripts(pieces, 1) AS sub_id FROM p)"""


def _split(mode):
    def f(spark, sf_dir):
        d = S.split_long(html_texts(spark, sf_dir), forward_merge=mode)
        longs = ["sub_id", "span_start", "span_end", "parent_token_len", "parent_char_len"]
        return d.select("parent_sent_id", "sub_sent_id", "sentence_sub", *[F.col(c).cast("bigint").alias(c) for c in longs])

    return f


for _mode in ("reference", "lossless"):
    QUERIES[f"semicolon_split_{_mode}"], ORACLE_SQL[f"semicolon_split_{_mode}"] = _split(_mode), _splitter(_mode)


@query(f"""WITH s AS ({_splitter('reference')}), per AS (SELECT parent_sent_id, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS parents, CAST(sum(n) AS BIGINT) AS subs, count(*) FILTER (n > 1) AS split_parents, round_even(count(*) FILTER (n > 1) / count(*), 4) AS split_share, coalesce(round_even(avg(n) FILTER (n > 1), 3), 1.0) AS mean_parts,
(SELECT count(*) FROM ({HTML_TEXTS})) - count(*) AS lost_parents FROM per""")
def split_summary(spark, sf_dir):
    d = html_texts(spark, sf_dir)
    return S.split_summary(S.split_long(d), d)


NORM = "trim(regexp_replace(trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')), '[;,.!?]+$', ''))"


@query(f"SELECT row_id, {NORM.format(c='sentence')} AS norm FROM ({SENTENCES})")
def normalize_text(spark, sf_dir):
    return sentences(spark, sf_dir).select("row_id", D.normalised(F.col("sentence")).alias("norm"))


@query(f"SELECT row_id, min(row_id) OVER (PARTITION BY {NORM.format(c='sentence')}) AS exact_rep, row_id = min(row_id) OVER (PARTITION BY {NORM.format(c='sentence')}) AS is_exact_rep FROM ({SENTENCES})")
def exact_dedup(spark, sf_dir):
    return D.exact_dedup(sentences(spark, sf_dir), "sentence", "row_id").select("row_id", "exact_rep", "is_exact_rep")


THRESHOLD = 0.3
UNIT = f"""SELECT row_id, list_transform(embedding, lambda x: x / (sqrt(list_sum(list_transform(embedding, lambda y: y * y))) + 1e-12)) AS u, row_id % 5 AS d FROM ({CLUSTERED})"""
EDGES = f"""SELECT l.row_id AS a, r.row_id AS b, list_sum(list_transform(list_zip(l.u, r.u), lambda z: z[1] * z[2])) AS sim FROM ({UNIT}) l JOIN ({UNIT}) r ON l.row_id < r.row_id
WHERE list_sum(list_transform(list_zip(l.u, r.u), lambda z: z[1] * z[2])) >= {THRESHOLD}"""


def _edges(spark, sf_dir):
    return D.similarity_edges(clustered(spark, sf_dir), THRESHOLD, "row_id")


@query(f"SELECT a, b, round(sim, 6) AS sim FROM ({EDGES})")
def near_dup_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("a", "b", *r6("sim"))


#: The leader rule row by row: a row joins the smallest leader that is its neighbour, else it leads.
LEADERS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b, sim FROM ({EDGES}) UNION ALL SELECT b, a, sim FROM ({EDGES})), n AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM ({CLUSTERED})),
nb AS MATERIALIZED (SELECT n.k, n.row_id, coalesce(list(e.b) FILTER (e.b < n.row_id), []) AS before FROM n LEFT JOIN e ON e.a = n.row_id GROUP BY ALL),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leads UNION ALL SELECT nb.k, CASE WHEN len(list_intersect(nb.before, w.leads)) = 0 THEN list_append(w.leads, nb.row_id) ELSE w.leads END FROM w JOIN nb ON nb.k = w.k + 1),
l AS MATERIALIZED (SELECT unnest(arg_max(leads, k)) AS lead FROM w),
m AS (SELECT e.a AS row_id, min(e.b) AS rep FROM e JOIN l ON e.b = l.lead WHERE e.a NOT IN (SELECT lead FROM l) GROUP BY 1)
SELECT n.row_id AS row, coalesce(m.rep, n.row_id) AS rep, coalesce(e.sim, 1.0) AS sim FROM n LEFT JOIN m USING (row_id) LEFT JOIN e ON e.a = m.row_id AND e.b = m.rep"""


@query(f"SELECT row, rep, round(sim, 6) AS sim FROM ({LEADERS})")
def leader_clusters(spark, sf_dir):
    return D.leader_clusters(clustered(spark, sf_dir), _edges(spark, sf_dir), "row_id").select("row", "rep", *r6("sim"))


MAPPING = f"""SELECT row AS row_index, rep AS rep_index, row = rep AS is_representative, sim AS sim_to_rep, count(*) OVER (PARTITION BY rep) AS cluster_size FROM ({LEADERS})"""


def _mapping(spark, sf_dir):
    # Each embedding's text is its own, so near duplicates alone decide.
    d = clustered(spark, sf_dir).withColumn("text", F.concat(F.lit("row "), F.col("row_id")))
    return D.dedup_mapping(d, "text", "embedding", THRESHOLD, "row_id")


@query(f"SELECT row_index, rep_index, is_representative, round(sim_to_rep, 6) AS sim_to_rep, cluster_size FROM ({MAPPING})")
def dedup_mapping(spark, sf_dir):
    return _mapping(spark, sf_dir).select("row_index", "rep_index", "is_representative", *r6("sim_to_rep"), "cluster_size")


WORST = f"""SELECT rep_index, arg_min(row_index, (sim_to_rep, row_index)) AS worst_member_row_index, round(min(sim_to_rep), 6) AS worst_sim FROM ({MAPPING}) WHERE row_index <> rep_index GROUP BY 1"""


@query(WORST)
def worst_member(spark, sf_dir):
    return D.worst_members(_mapping(spark, sf_dir)).select("rep_index", "worst_member_row_index", *r6("worst_sim"))


@query(f"""WITH m AS MATERIALIZED ({MAPPING}) SELECT r.rep_index, r.cluster_size, round(coalesce(min(s.sim_to_rep), 1.0), 6) AS min_sim, round(max(s.sim_to_rep), 6) AS max_sim, round(coalesce(avg(s.sim_to_rep), 1.0), 6) AS mean_sim,
round(quantile_cont(s.sim_to_rep, 0.05), 6) AS p05_sim, round(quantile_cont(s.sim_to_rep, 0.25), 6) AS p25_sim, round(quantile_cont(s.sim_to_rep, 0.5), 6) AS p50_sim, arg_min(s.row_index, (s.sim_to_rep, s.row_index)) AS worst_member_row_index
FROM (SELECT * FROM m WHERE is_representative) r LEFT JOIN (SELECT * FROM m WHERE row_index <> rep_index) s ON r.rep_index = s.rep_index GROUP BY ALL""")
def dedup_review(spark, sf_dir):
    return D.review(_mapping(spark, sf_dir)).select("rep_index", "cluster_size", *r6("min_sim", "max_sim", "mean_sim", "p05_sim", "p25_sim", "p50_sim"), "worst_member_row_index")


@query(f"""SELECT rep_index, row_index, cluster_size, round(sim_to_rep, 6) AS sim_to_rep, rank_in_cluster FROM (SELECT *, row_number() OVER (PARTITION BY rep_index ORDER BY sim_to_rep, row_index) AS rank_in_cluster FROM ({MAPPING}) WHERE row_index <> rep_index) WHERE rank_in_cluster <= 10""")
def least_similar_samples(spark, sf_dir):
    return D.least_similar(_mapping(spark, sf_dir)).select("rep_index", "row_index", "cluster_size", *r6("sim_to_rep"), "rank_in_cluster")


#: What is known of each row beside its similarity.
ATTRIBUTES = f"SELECT row_id, cluster, round(x, 6) AS x FROM ({CLUSTERED})"


def _attributes(spark, sf_dir):
    return clustered(spark, sf_dir).select(F.col("row_id").alias("row_index"), "cluster", *r6("x"))


@query(f"""WITH m AS MATERIALIZED ({MAPPING}), t AS MATERIALIZED ({ATTRIBUTES}), w AS (SELECT rep_index, arg_min(row_index, (sim_to_rep, row_index)) AS worst FROM m WHERE row_index <> rep_index GROUP BY 1)
SELECT m.rep_index, cluster_size, w.worst AS worst_member_row_index, p.cluster AS rep_cluster, p.x AS rep_x, q.cluster AS worst_member_cluster, q.x AS worst_member_x
FROM m LEFT JOIN w ON w.rep_index = m.rep_index LEFT JOIN t p ON p.row_id = m.rep_index LEFT JOIN t q ON q.row_id = w.worst WHERE is_representative""")
def review_attributes(spark, sf_dir):
    d = D.review(_mapping(spark, sf_dir), _attributes(spark, sf_dir))
    return d.select("rep_index", "cluster_size", "worst_member_row_index", "rep_cluster", "rep_x", "worst_member_cluster", "worst_member_x")


@query(f"""WITH t AS MATERIALIZED ({ATTRIBUTES}) SELECT s.rep_index, s.row_index, rank_in_cluster, p.cluster AS rep_cluster, p.x AS rep_x, q.cluster AS mem_cluster, q.x AS mem_x
FROM (SELECT *, row_number() OVER (PARTITION BY rep_index ORDER BY sim_to_rep, row_index) AS rank_in_cluster FROM ({MAPPING}) WHERE row_index <> rep_index) s JOIN t p ON p.row_id = s.rep_index JOIN t q ON q.row_id = s.row_index WHERE rank_in_cluster <= 10""")
def sample_attributes(spark, sf_dir):
    d = D.least_similar(_mapping(spark, sf_dir), attributes=_attributes(spark, sf_dir))
    return d.select("rep_index", "row_index", "rank_in_cluster", "rep_cluster", "rep_x", "mem_cluster", "mem_x")


@query(f"""SELECT count(*) AS count_docs, round(avg(cluster_size), 6) AS mean_cluster_size, round(quantile_cont(CAST(cluster_size AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(cluster_size AS DOUBLE), 0.9), 6) AS p90, max(cluster_size) AS max FROM ({MAPPING})""")
def dup_cluster_stats(spark, sf_dir):
    return K.cluster_size_stats(_mapping(spark, sf_dir)).select("count_docs", *r6("mean_cluster_size", "median", "p90"), "max")


LIGHT = "regexp_replace(lower(trim(sentence)), '\\s+', ' ', 'g')"


@query(f"SELECT count(*) AS total, count(DISTINCT {LIGHT}) AS unique_texts, round_even(1 - count(DISTINCT {LIGHT}) / count(*), 4) AS duplicate_rate, (SELECT count(DISTINCT {NORM.format(c='sentence')}) FROM ({SENTENCES})) AS after_dedup FROM ({SENTENCES})")
def dup_rate_compare(spark, sf_dir):
    s = sentences(spark, sf_dir)
    return K.duplicate_rate(s, D.lightly_normalised(F.col("sentence")), after=D.exact_dedup(s, "sentence", "row_id").where("is_exact_rep"))


RAW_TOKENS = "regexp_extract_all(regexp_replace(lower(regexp_replace({c}, '<[^>]+>', ' ', 'g')), '\\d+(?:[,\\.\\d]*\\d)?', '<NUM>', 'g'), '<NUM>|[A-Za-z]+(?:''[A-Za-z]+)?')"
FILTERED = f"list_filter({RAW_TOKENS}, lambda t: t NOT IN ('<NUM>', 'num') AND t NOT IN {sql_list(T.STOPWORDS)} AND length(t) > 1)"
DOCS = f"SELECT row_id, {FILTERED.format(c='sentence')} AS tokens FROM ({SENTENCES})"


def docs(spark, sf_dir):
    d = sentences(spark, sf_dir)
    return d.select("row_id", T.filtered(T.topic_tokens(F.col("sentence"))).alias("tokens"))


@query(f"SELECT row_id, array_to_string({RAW_TOKENS.format(c='sentence')}, ' ') AS tokens FROM ({SENTENCES})")
def lda_tokens(spark, sf_dir):
    return sentences(spark, sf_dir).select("row_id", F.array_join(T.topic_tokens(F.col("sentence")), " ").alias("tokens"))


@query(f"SELECT row_id, array_to_string(tokens, ' ') AS tokens_str FROM ({DOCS})")
def token_filter(spark, sf_dir):
    return docs(spark, sf_dir).select("row_id", F.array_join("tokens", " ").alias("tokens_str"))


@query(f"SELECT row_id, array_to_string(list_filter(string_split_regex(array_to_string({RAW_TOKENS.format(c='sentence')}, ' '), '\\s+'), lambda t: t <> '' AND lower(t) NOT IN ('<num>', 'num')), ' ') AS tokens_str FROM ({SENTENCES})")
def token_rebuild(spark, sf_dir):
    joined = F.array_join(T.topic_tokens(F.col("sentence")), " ")
    return sentences(spark, sf_dir).select("row_id", F.array_join(T.without_number_marks(joined), " ").alias("tokens_str"))


@query(f"SELECT row_id, array_to_string(list_concat(tokens, CASE WHEN row_id % 3 = 0 THEN ['it''s'] ELSE [] END), '|') AS tokens FROM ({DOCS})")
def token_coercion(spark, sf_dir):
    # The tokens as a list literal, read back; entries with an apostrophe stand in double quotes.
    d = docs(spark, sf_dir).withColumn("tokens", F.when(F.col("row_id") % 3 == 0, F.concat("tokens", F.array(F.lit("it's")))).otherwise(F.col("tokens")))
    quoted = F.transform("tokens", lambda t: F.when(t.contains("'"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), t, F.lit("'"))))
    literal = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return d.select("row_id", F.array_join(T.coerced(F.when(F.col("row_id") % 2 == 0, literal).otherwise(F.array_join("tokens", " "))), "|").alias("tokens"))


COUNTS = f"SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM ({DOCS})) GROUP BY 1"


@query(f"SELECT * FROM ({COUNTS}) ORDER BY count DESC, token LIMIT 50")
def token_topn(spark, sf_dir):
    return K.top_tokens(docs(spark, sf_dir), 50)


PAIRS = f"""SELECT a, b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(tokens)), lambda i: {{'a': tokens[i], 'b': tokens[i + 1]}}), recursive := true) FROM ({DOCS}) WHERE len(tokens) > 1) GROUP BY ALL"""
SCORED = f"""SELECT p.a, p.b, p.n, ln(p.n * N.N / (x.count * y.count)) / -ln(p.n / N.N) AS npmi, (p.n - 10) / (x.count * y.count) * (N.V1 + (SELECT count(*) FROM ({PAIRS}))) AS dflt
FROM ({PAIRS}) p JOIN ({COUNTS}) x ON x.token = p.a JOIN ({COUNTS}) y ON y.token = p.b, (SELECT CAST(sum(count) AS DOUBLE) AS N, count(*) AS V1 FROM ({COUNTS})) N WHERE p.n >= 10"""
#: The invented prose has no fixed expressions, so the npmi threshold lies low enough for some pairs.
LOW = 0.0


@query(f"SELECT a, b, n, round(npmi, 6) AS score FROM ({SCORED}) WHERE npmi > {LOW}")
def bigram_npmi(spark, sf_dir):
    return P.scored_pairs(docs(spark, sf_dir), min_count=10, threshold=LOW).select("a", "b", "n", *r6("score"))


@query(f"SELECT a, b, n, round(dflt, 6) AS score FROM ({SCORED}) WHERE dflt > 1")
def default_score_phrases(spark, sf_dir):
    return P.scored_pairs(docs(spark, sf_dir), min_count=10, threshold=1.0, scoring="default").select("a", "b", "n", *r6("score"))


def mined_sql(k: int, docs: str, min_count: int, threshold: float, scoring: str) -> str:
    """Tables ok{k} (topic, a, b) of the pairs in ``docs`` (row_id, topic, tokens) that score above the threshold."""
    score = "ln(p.n * t.total / (x.c * y.c)) / -ln(p.n / t.total)" if scoring == "npmi" else f"(p.n - {min_count}) / (x.c * y.c) * (t.kinds + v.kinds)"
    return f"""c{k} AS MATERIALIZED (SELECT topic, token, CAST(count(*) AS DOUBLE) AS c FROM (SELECT topic, unnest(tokens) AS token FROM {docs}) GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT topic, a, b, count(*) AS n FROM (SELECT topic, unnest(list_transform(range(1, len(tokens)), lambda i: {{'a': tokens[i], 'b': tokens[i + 1]}}), recursive := true) FROM {docs} WHERE len(tokens) > 1) GROUP BY ALL),
ok{k} AS MATERIALIZED (SELECT topic, a, b FROM (SELECT p.*, {score} AS score FROM p{k} p JOIN c{k} x ON x.topic = p.topic AND x.token = p.a JOIN c{k} y ON y.topic = p.topic AND y.token = p.b
JOIN (SELECT topic, sum(c) AS total, count(*) AS kinds FROM c{k} GROUP BY 1) t ON t.topic = p.topic JOIN (SELECT topic, count(*) AS kinds FROM p{k} GROUP BY 1) v ON v.topic = p.topic WHERE p.n >= {min_count}) WHERE score > {threshold})"""


def merged_sql(k: int, docs: str, ok: str, out: str) -> str:
    """Table ``out`` (row_id, topic, tokens): ``docs`` with the pairs in ``ok`` merged from left to right. In a run of
    neighbouring accepted pairs the first, third, ... are merged."""
    return f"""q{k} AS MATERIALIZED (SELECT row_id, i, q.a, q.b, ok.a IS NOT NULL AS hit FROM (SELECT row_id, topic, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS a, unnest(list_append(tokens[2:], NULL)) AS b FROM {docs} WHERE len(tokens) > 0) q
LEFT JOIN {ok} ok ON ok.topic = q.topic AND ok.a = q.a AND ok.b = q.b),
t{k} AS (SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS taken FROM q{k}),
u{k} AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY row_id ORDER BY i), false) AS gone FROM t{k}),
{out} AS MATERIALIZED (SELECT d.row_id, d.topic, coalesce(x.tokens, CAST([] AS VARCHAR[])) AS tokens FROM {docs} d LEFT JOIN (SELECT row_id, list(CASE WHEN taken THEN a || '_' || b ELSE a END ORDER BY i) AS tokens FROM u{k} WHERE NOT gone GROUP BY 1) x ON x.row_id = d.row_id)"""


MERGED = f"""WITH ok AS MATERIALIZED (SELECT 0 AS topic, a, b FROM ({SCORED}) WHERE npmi > {LOW}), d AS MATERIALIZED (SELECT row_id, 0 AS topic, tokens FROM ({DOCS})),
{merged_sql(0, 'd', 'ok', 'm')} SELECT row_id, tokens AS tokens_bi FROM m"""


def _merged(spark, sf_dir):
    d = docs(spark, sf_dir)
    return P.merge_phrases(d, P.scored_pairs(d, min_count=10, threshold=LOW), id_col="row_id")


@query(f"SELECT row_id, array_to_string(tokens_bi, ' ') AS tokens_bi FROM ({MERGED})")
def phrase_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("row_id", F.array_join("tokens_bi", " ").alias("tokens_bi"))


@query(f"SELECT phrase, count(*) AS count FROM (SELECT unnest(tokens_bi) AS phrase FROM ({MERGED})) WHERE contains(phrase, '_') GROUP BY 1")
def phrase_freq(spark, sf_dir):
    return P.phrase_frequencies(_merged(spark, sf_dir), "tokens_bi")


def phrase_chain(model: str, docs: str, bigram: tuple, trigram: tuple, scoring: str) -> str:
    """A model mined in ``model`` and applied to ``docs``: the table ``tri`` (row_id, topic, tokens)."""
    tables = [f"WITH f0 AS MATERIALIZED ({model}), d0 AS MATERIALIZED ({docs})", mined_sql(0, "f0", *bigram, scoring), merged_sql(0, "f0", "ok0", "f1"), mined_sql(1, "f1", *trigram, scoring), merged_sql(1, "d0", "ok0", "d1"), merged_sql(2, "d1", "ok1", "tri")]
    return ",\n".join(tables)


UNTOPIC = f"SELECT row_id, 0 AS topic, tokens FROM ({DOCS})"


@query(f"{phrase_chain(UNTOPIC, UNTOPIC, (10, LOW), (5, LOW), 'npmi')} SELECT phrase, count(*) AS count FROM (SELECT unnest(tokens) AS phrase FROM tri) WHERE contains(phrase, '_') GROUP BY 1")
def phrase_mining_trigrams(spark, sf_dir):
    return P.phrase_frequencies(P.mine_phrases(docs(spark, sf_dir), bigram=(10, LOW), trigram=(5, LOW), id_col="row_id"), "tokens_tri")


@query(f"{phrase_chain(f'{UNTOPIC} WHERE row_id % 2 = 0', UNTOPIC, (10, LOW), (5, LOW), 'npmi')} SELECT row_id, array_to_string(tokens, ' ') AS tokens_tri FROM tri")
def apply_phrases(spark, sf_dir):
    # A model made of every other sentence, applied to all.
    d = docs(spark, sf_dir)
    model = P.fit_model(d.where("row_id % 2 = 0"), bigram=(10, LOW), trigram=(5, LOW), id_col="row_id")
    return P.apply_model(d, *model, id_col="row_id").select("row_id", F.array_join("tokens_tri", " ").alias("tokens_tri"))


LEMMA = r"CASE WHEN length(t) > 4 AND ends_with(t, 'ies') THEN regexp_replace(t, 'ies$', 'y') WHEN length(t) > 4 AND regexp_matches(t, '(sses|shes|ches|xes)$') THEN regexp_replace(t, 'es$', '') WHEN length(t) > 4 AND regexp_matches(t, '[^su]s$') THEN regexp_replace(t, 's$', '') ELSE t END"


@query(f"SELECT row_id, array_to_string(list_filter(list_transform({RAW_TOKENS.format(c='sentence')}, lambda t: {LEMMA}), lambda t: t NOT IN ('<NUM>', 'num') AND t NOT IN {sql_list(T.STOPWORDS)} AND length(t) > 1), ' ') AS tokens_str FROM ({SENTENCES})")
def lemma_tokens(spark, sf_dir):
    t = T.filtered(T.lemmatised(T.topic_tokens(F.col("sentence"))))
    return sentences(spark, sf_dir).select("row_id", F.array_join(t, " ").alias("tokens_str"))


#: Phrases for the list operators: pairs of frequent syllables as the invented prose has them.
LISTED = ("the_of", "and_the", "on_the")
PHRASED = f"SELECT row_id, list_transform(tokens, lambda t, i: CASE WHEN i % 4 = 0 THEN 'on_the' WHEN i % 7 = 0 THEN 'keep_this' ELSE t END) AS tokens FROM ({DOCS})"


def _phrased(spark, sf_dir):
    t = F.transform("tokens", lambda t, i: F.when((i + 1) % 4 == 0, "on_the").when((i + 1) % 7 == 0, "keep_this").otherwise(t))
    return docs(spark, sf_dir).select("row_id", t.alias("tokens"))


@query(f"SELECT row_id, array_to_string(flatten(list_transform(tokens, lambda t: CASE WHEN t IN {sql_list(LISTED)} THEN string_split(t, '_') ELSE [t] END)), ' ') AS tokens FROM ({PHRASED})")
def unphrase(spark, sf_dir):
    return _phrased(spark, sf_dir).select("row_id", F.array_join(T.unphrased(F.col("tokens"), LISTED), " ").alias("tokens"))


STOP_LIST = ("on_the", "ing", "tion", "ble")


@query(f"SELECT row_id, array_to_string(list_filter(tokens, lambda t: t NOT IN {sql_list(STOP_LIST)}), ' ') AS tokens FROM ({PHRASED})")
def stop_phrase_filter(spark, sf_dir):
    return _phrased(spark, sf_dir).select("row_id", F.array_join(T.without_listed(F.col("tokens"), STOP_LIST), " ").alias("tokens"))


@query(f"SELECT row_id, array_to_string(list_filter(tokens, lambda t: contains(t, '_') OR lower(t) NOT IN {sql_list((*T.UNIGRAM_STOPS_1, 'ing', 'tion'))}), ' ') AS tokens FROM ({PHRASED})")
def unigram_stop_filter(spark, sf_dir):
    return _phrased(spark, sf_dir).select("row_id", F.array_join(T.without_unigrams(F.col("tokens"), (*T.UNIGRAM_STOPS_1, "ing", "tion")), " ").alias("tokens"))


@query(f"SELECT CAST(sum(count) FILTER (NOT contains(token, '_')) AS BIGINT) AS unigrams, CAST(sum(count) FILTER (contains(token, '_')) AS BIGINT) AS ngrams, round(sum(count) FILTER (contains(token, '_')) / sum(count), 6) AS ngram_share FROM (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM ({PHRASED})) GROUP BY 1)")
def ngram_share(spark, sf_dir):
    return K.ngram_share(_phrased(spark, sf_dir)).select("unigrams", "ngrams", *r6("ngram_share"))


@query(f"""SELECT row_id, orig_row, token_len, row_number() OVER (ORDER BY row_id) - 1 AS lda_doc_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS orig_row, len(tokens) AS token_len FROM ({DOCS})) WHERE token_len > 0""")
def nonempty_view(spark, sf_dir):
    return T.nonempty_view(docs(spark, sf_dir)).select("row_id", "orig_row", F.col("token_len").cast("bigint").alias("token_len"), "lda_doc_id")


PLAIN = "regexp_extract_all(lower(regexp_replace(sentence, '<[^>]+>', ' ', 'g')), '[A-Za-z]+(?:''[A-Za-z]+)?')"


@query(f"""WITH t AS (SELECT {PLAIN} AS tokens FROM ({SENTENCES})), l AS (SELECT CAST(len(tokens) AS DOUBLE) AS n FROM t)
SELECT count(*) AS documents, count(*) FILTER (n > 0) AS non_empty, count(*) FILTER (n = 0) AS empty, round_even(avg(n), 2) AS mean_tokens,
concat_ws(' / ', CAST(round_even(min(n), 0) AS INTEGER), CAST(round_even(quantile_cont(n, 0.5), 0) AS INTEGER), CAST(round_even(quantile_cont(n, 0.9), 0) AS INTEGER), CAST(round_even(quantile_cont(n, 0.99), 0) AS INTEGER), CAST(round_even(max(n), 0) AS INTEGER)) AS lengths,
(SELECT count(DISTINCT x) FROM (SELECT unnest(tokens) AS x FROM t)) AS vocabulary FROM l""")
def corpus_stats(spark, sf_dir):
    return K.corpus_stats(sentences(spark, sf_dir).select(T.corpus_tokens(F.col("sentence")).alias("tokens")))


@query(f"SELECT * FROM ({COUNTS}) WHERE NOT contains(token, '_') ORDER BY count DESC, token LIMIT 20")
def top_unigrams(spark, sf_dir):
    return K.top_tokens(docs(spark, sf_dir), 20, phrases=False)


@query(f"""WITH v AS (SELECT CAST(len(tokens) AS DOUBLE) AS v FROM ({DOCS})), e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM v)
SELECT CAST(least(floor((v - lo) / w), 49) AS BIGINT) AS bin, round(lo + least(floor((v - lo) / w), 49) * w, 6) AS low, count(*) AS count FROM v, e GROUP BY ALL""")
def hist_token_len(spark, sf_dir):
    return K.histogram(docs(spark, sf_dir), F.size("tokens"), 50).select("bin", *r6("low"), "count")
