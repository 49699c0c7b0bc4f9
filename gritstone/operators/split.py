"""Long sentences to traceable parts: tokens, semicolon spans, terminal punctuation, the splitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, rstrip, strip

TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?|[\$€£]?\d+(?:[\.,]\d+)*%?"


def simple_tokens(c: Column) -> Column:
    """Words, with one inner apostrophe, and numbers with currency or percent signs."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def terminated(c: Column, mark: str = ";") -> Column:
    """Right-stripped, and closed by ``mark`` unless empty or already closed."""
    s = rstrip(c)
    return F.when((s == "") | s.rlike(r"[.!?;]$"), s).otherwise(F.concat(s, F.lit(mark)))


def segments(c: Column, sep: str = ";") -> Column:
    """Parts between separators as array of struct(txt, s, e): txt stripped, s and e the span of the
    unstripped part."""
    raw = F.split(c, r"\Q" + sep + r"\E", -1)
    empty = F.array().cast("array<struct<txt:string,s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["e"] + len(sep)).otherwise(F.lit(0))
        return F.concat(acc, F.array(F.struct(strip(x).alias("txt"), start.cast("int").alias("s"), (start + F.length(x)).cast("int").alias("e"))))

    return F.aggregate(raw, empty, step)


def split_long(
    df: DataFrame,
    text_col: str = "sentence_raw",
    id_col: str = "sent_id",
    min_tokens_piece: int = 6,
    trigger_tokens: int = 40,
    trigger_chars: int = 200,
    sep: str = ";",
    forward_merge: str = "reference",
) -> DataFrame:
    """Each sentence as one or more rows.

    A sentence of fewer than ``trigger_tokens`` tokens and ``trigger_chars`` characters stays whole. Else
    it is cut at ``sep``; a part with fewer than ``min_tokens_piece`` tokens joins the one before it. A
    short first part joins the next; with ``forward_merge="reference"`` the pair is then lost (with
    only two parts the sentence gives no row), with ``"lossless"`` it is kept. Adds parent_sent_id,
    sub_id, sub_sent_id, sentence_sub, span_start, span_end, parent_token_len, parent_char_len.
    Everything is one fold inside a projection: no shuffle.
    """
    if forward_merge not in ("reference", "lossless"):
        raise ValueError(forward_merge)
    lossless = forward_merge == "lossless"
    text = F.coalesce(F.col(text_col), F.lit(""))
    piece = "struct<txt:string,s:int,e:int>"
    few = lambda t: F.size(simple_tokens(t)) < min_tokens_piece
    start = F.struct(F.array().cast(f"array<{piece}>").alias("out"), F.lit(None).cast(piece).alias("held"), F.lit(0).alias("i"), F.lit(False).alias("skip"))

    def step(acc: Column, x: Column, n: Column) -> Column:
        out, held, i = acc["out"], acc["held"], acc["i"]
        last = F.get(out, F.size(out) - 1)
        merged = F.struct(strip(F.concat_ws(" ", last["txt"], x["txt"])).alias("txt"), last["s"].alias("s"), x["e"].alias("e"))
        both = F.struct(strip(F.concat_ws(" ", held["txt"], x["txt"])).alias("txt"), held["s"].alias("s"), x["e"].alias("e"))
        short = few(x["txt"]) & (n > 1)
        first = F.size(out) == 0
        none = F.lit(None).cast(piece)
        if lossless:
            now = F.when(held.isNotNull(), both).otherwise(x)
            # What is held is judged again with what it was joined to.
            wait = first & few(now["txt"]) & (i + 1 < n)
            new_out = F.when(wait, out).when(first, F.array(now)).when(short, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))
            new_held = F.when(wait, now).otherwise(none)
            skip = F.lit(False)
        else:
            # A held first part takes the next one with it; both are passed over.
            wait = ~acc["skip"] & first & short & (i + 1 < n)
            new_out = F.when(acc["skip"] | wait, out).when(short & ~first, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))
            new_held = none
            skip = wait
        return F.struct(new_out.alias("out"), new_held.alias("held"), (i + 1).alias("i"), skip.alias("skip"))

    # The parts are bound once: inside a lambda they would be worked out anew for each step.
    folded = let(segments(text, sep), lambda parts: F.aggregate(parts, start, lambda acc, x: step(acc, x, F.size(parts)), lambda acc: acc["out"]))
    tokens, chars = F.size(simple_tokens(text)), F.length(text)
    whole = F.array(F.struct(text.alias("txt"), F.lit(0).alias("s"), chars.alias("e")))
    pieces = F.when((tokens < trigger_tokens) & (chars < trigger_chars), whole).otherwise(folded)
    keep = [c for c in df.columns if c not in ("parent_sent_id", "sub_id", "sub_sent_id", "sentence_sub", "span_start", "span_end", "parent_token_len", "parent_char_len")]
    rows = df.withColumn("_tokens", tokens).withColumn("_chars", chars).select(*keep, "_tokens", "_chars", F.posexplode(pieces).alias("_pos", "_piece"))
    return rows.select(
        *keep,
        F.col(id_col).cast("string").alias("parent_sent_id"),
        (F.col("_pos") + 1).alias("sub_id"),
        F.concat(F.col(id_col).cast("string"), F.lit("-"), F.format_string("%02d", F.col("_pos") + 1)).alias("sub_sent_id"),
        terminated(F.col("_piece.txt")).alias("sentence_sub"),
        F.col("_piece.s").alias("span_start"),
        F.col("_piece.e").alias("span_end"),
        F.col("_tokens").alias("parent_token_len"),
        F.col("_chars").alias("parent_char_len"),
    )


def split_summary(subs: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """parents, subs, split parents, their share (4 digits), mean parts of split ones (3 digits; 1 if
    none) and, given the parents' table, how many gave no row."""
    per = subs.groupBy("parent_sent_id").agg(F.count("*").alias("n"))
    split = F.count_if(F.col("n") > 1)
    out = per.agg(
        F.count("*").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("subs"), split.alias("split_parents"), F.coalesce(F.bround(split / F.count("*"), 4), F.lit(0.0)).alias("split_share"),
        F.coalesce(F.bround(F.avg(F.when(F.col("n") > 1, F.col("n"))), 3), F.lit(1.0)).alias("mean_parts"),
    )
    if parents is not None:
        out = out.join(F.broadcast(parents.agg(F.count("*").alias("given"))))  # one row each
        out = out.withColumn("lost_parents", F.col("given") - F.col("parents")).drop("given")
    return out


def delimiter_counts(c: Column) -> list[Column]:
    """Commas, semicolons and tabs in the first 50 non-blank lines, and the most frequent (ties: tab,
    comma, semicolon; null for none)."""
    lines = F.slice(F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: strip(x) != ""), 1, 50)
    count = lambda d: F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
    comma, semicolon, tab = count(","), count(";"), count("\t")
    most = F.greatest(comma, semicolon, tab)
    name = F.when(most == 0, None).when(tab == most, "tab").when(comma == most, "comma").otherwise("semicolon")
    return [comma.alias("comma"), semicolon.alias("semicolon"), tab.alias("tab"), name.alias("delimiter")]
