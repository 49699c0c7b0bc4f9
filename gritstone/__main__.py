"""Command line: ``python -m gritstone COMMAND ...`` with the usual pipeline steps."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import clean, dedup, phrases, split, tokens
from .session import builder, durable
from .sources import io


def numbered(df, name, first=1):
    """Rows numbered first, first + 1, ... in the order of the file, and kept, so that every plan sees the same numbers."""
    placed = tokens.with_places(durable(df.withColumn("_at", F.monotonically_increasing_id())), "_at", "_place")
    return durable(placed.withColumn(name, F.col("_place") + first).drop("_at", "_place"))


def collect(a, spark):
    files = io.read_texts(spark, a.in_dir, a.recursive)
    lines = clean.explode_lines(clean.parse_filename(files.select("filename", "content")))
    years = clean.aggregate_company_years(clean.keep_lines(lines, a.min_len), a.join_with)
    io.write_parquet(years, a.out) if a.export_parquet else io.write_csv(years, a.out)
    io.write_csv(clean.line_audit(lines, min_len=a.min_len), f"{a.out}.audit")


def split_cmd(a, spark):
    df = io.read_delimited(spark, a.input, a.sep, a.encoding) if a.input.endswith((".csv", ".txt", ".tsv")) else io.read_table(spark, a.input)
    text = a.text_col if a.text_col in df.columns else next(c for c, t in df.dtypes if t == "string")
    if a.id_col not in df.columns:
        df = numbered(df, a.id_col)
    out = split.split_long(df, text, a.id_col, a.min_tokens_piece, a.trigger_tokens, a.trigger_chars, forward_merge=a.forward_merge)
    io.write_both(out, a.output)
    split.split_summary(out, df).show(truncate=False)


def titles(a, spark):
    files = io.read_texts(spark, a.in_dir, a.recursive, skip_cleaned=True)
    cleaned = clean.cleaned_files(clean.clean_titles(files.select("filename", "content"), ["filename"]))
    io.write_texts(cleaned, f"{a.out}/cleaned", text="text")
    io.write_texts(cleaned.where("removed_titles <> ''"), f"{a.out}/removed_titles", text="removed_titles")


def dedup_cmd(a, spark):
    df = io.read_table(spark, a.input)
    if "embedding" not in df.columns:
        df = io.to_vector(df)
    if "row_index" not in df.columns:
        df = numbered(df, "row_index", 0)
    if a.sample_cap:
        df = io.first_rows(df, a.sample_cap, "row_index")
    mapping = durable(dedup.dedup_mapping(df, a.text_col, threshold=a.sim_threshold))
    io.write_parquet(mapping, f"{a.output_prefix}_mapping.parquet")
    io.write_parquet(df.join(mapping.where("is_representative").select("row_index", "cluster_size"), "row_index"), f"{a.output_prefix}_dedup.parquet")
    known = df.select("row_index", *[c for c in (*(a.id_cols or "").split(","), a.text_col) if c and c in df.columns])
    review = dedup.review(mapping, known).orderBy(F.desc("cluster_size"), "min_sim", "rep_index")
    io.write_csv(review, f"{a.output_prefix}_dedup_review.csv")
    io.write_csv(dedup.least_similar(mapping, a.samples_per_cluster, known), f"{a.output_prefix}_cluster_samples.csv")


def tokens_cmd(a, spark):
    df = io.read_table(spark, a.input)
    if a.sample_cap:
        df = df.limit(a.sample_cap)
    stops = tokens.full_stopwords(spark) | set(io.word_list(spark, a.extra_stopwords) if a.extra_stopwords else ())
    t = tokens.filtered(tokens.lemmatised(tokens.topic_tokens(F.col(a.text_col), a.keep_numbers)), stops)
    io.write_both(df.withColumn("tokens", t).withColumn("tokens_str", F.array_join("tokens", " ")), a.output_prefix)


def phrases_cmd(a, spark):
    df = io.read_table(spark, a.input)
    model = phrases.fit_model(df, "tokens", (a.bigram_min_count, a.bigram_threshold), (a.trigram_min_count, a.trigram_threshold), a.scoring)
    if a.save_model:
        phrases.save_model(*model, a.save_model)
    mined = phrases.apply_model(df, *model)
    io.write_parquet(mined, f"{a.output_prefix}_phrases_raw.parquet")
    io.write_csv(phrases.phrase_frequencies(mined, "tokens_tri").orderBy(F.desc("count"), "phrase"), f"{a.output_prefix}_phrase_freq.csv")


def apply_cmd(a, spark):
    df = io.read_table(spark, a.input)
    if a.phrase_model:
        df = phrases.apply_model(df, *phrases.load_model(spark, a.phrase_model))
    t = F.col("tokens_tri")
    if a.unphrase:
        t = tokens.unphrased(t, io.word_list(spark, a.unphrase, phrases=True))
    if a.stopphrases:
        t = tokens.without_listed(t, io.word_list(spark, a.stopphrases, phrases=True))
    io.write_parquet(df.withColumn("tokens_final", t).withColumn("tokens_final_str", F.array_join("tokens_final", " ")), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gritstone")
    sub = p.add_subparsers(required=True)

    def command(name, f, *options):
        c = sub.add_parser(name)
        for flag, kw in options:
            c.add_argument(flag, **kw)
        c.set_defaults(run=f)

    need, on = {"required": True}, {"action": "store_true"}
    d = lambda v: {"default": v, "type": type(v)}
    command("collect", collect, ("--in-dir", need), ("--out", need), ("--recursive", on), ("--min-len", d(1)), ("--join-with", d("\n")), ("--export-parquet", on))
    command("titles", titles, ("--in-dir", need), ("--out", need), ("--recursive", on))
    command(
        "split", split_cmd, ("--input", need), ("--output", need), ("--text-col", d("sentence_raw")), ("--id-col", d("sent_id")), ("--min-tokens-piece", d(6)), ("--trigger-tokens", d(40)), ("--trigger-chars", d(200)),
        ("--sep", {}), ("--encoding", {}), ("--forward-merge", {"default": "reference", "choices": ["reference", "lossless"]}),
    )
    command("dedup", dedup_cmd, ("--input", need), ("--output-prefix", need), ("--text-col", d("sentence_sub")), ("--id-cols", {}), ("--sim-threshold", d(0.97)), ("--samples-per-cluster", d(10)), ("--sample-cap", d(0)))
    command("tokens", tokens_cmd, ("--input", need), ("--text-col", need), ("--output-prefix", need), ("--extra-stopwords", {}), ("--keep-numbers", on), ("--lower", on), ("--sample-cap", d(0)))
    command(
        "phrases", phrases_cmd, ("--input", need), ("--output-prefix", need), ("--bigram-min-count", d(10)), ("--bigram-threshold", d(0.3)), ("--trigram-min-count", d(5)), ("--trigram-threshold", d(0.2)),
        ("--scoring", {"default": "npmi", "choices": ["npmi", "default"]}), ("--save-model", {}),
    )
    command("apply", apply_cmd, ("--input", need), ("--output", need), ("--phrase-model", {}), ("--unphrase", {}), ("--stopphrases", {}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a, builder().getOrCreate())


if __name__ == "__main__":
    main()
