"""Readers, writers, the command line and the streams."""

import pytest
from pyspark.sql import functions as F

from gritstone.sources import io


def test_texts(spark, tmp_path):
    (tmp_path / "a_10-K_20230131.txt").write_bytes(b"\xef\xbb\xbfline\xff one\n")
    (tmp_path / "a_cleaned.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("y")
    assert {r["filename"]: r["content"] for r in io.read_texts(spark, str(tmp_path)).collect()} == {"a_10-K_20230131.txt": "line one\n", "a_cleaned.txt": "x"}
    assert io.read_texts(spark, str(tmp_path), recursive=True, skip_cleaned=True).count() == 2


@pytest.mark.parametrize(("sample", "want"), [("a,b;c\n", ","), ("a;b;c,d", ";"), ("a\tb,c", "\t"), ("plain", None), ("", None)])
def test_delimiters(sample, want):
    assert io.sniff_delimiter(sample) == want


def test_encodings():
    assert io.sniff_encoding("é".encode() * 5 + b"\xc3") == "utf-8"
    assert io.sniff_encoding("é".encode("cp1252") + b" x") == "cp1252"
    assert io.sniff_encoding(b"\xef\xbb\xbfa") == "utf-8-sig"


def test_delimited_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("id;text\n1;déjà €\n2;x\n".encode("cp1252"))
    assert [(r["id"], r["text"]) for r in io.read_table(spark, str(p)).orderBy("id").collect()] == [("1", "déjà €"), ("2", "x")]


def test_lists_and_columns(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# note\n Chief Officer \n\nrisk-free\nRisk-Free\n")
    assert io.word_list(spark, str(p)) == ["chief officer", "risk-free"]
    assert io.word_list(spark, str(p), phrases=True) == ["chief_officer", "risk_free"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "emb_10 double, emb_2 double, x double")
    assert io.numbered_columns(df) == ["emb_2", "emb_10"]
    assert io.to_vector(df).first()["embedding"] == [2.0, 1.0]
    assert io.to_columns(io.to_vector(df), 2).columns == ["x", "emb_0", "emb_1"]
    assert io.pick_column(df, ["y", "x"]) == "x" and io.present(df, ["y", "x"]).columns == ["x"]
    with pytest.raises(ValueError):
        io.pick_column(df, ["y"])


def test_matrix_and_fallbacks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(",a,b\na,1,0.5\nb,0.5,1\n")
    assert {(r["a"], r["b"]): r["sim"] for r in io.read_matrix(spark, str(p)).collect()}[("a", "b")] == 0.5
    assert io.first_existing(spark, [str(tmp_path / "none"), str(p)]) == str(p)
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [str(tmp_path / "none")])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x 1")], "id long, tokens array<string>, text string")
    io.write_both(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).first()["tokens"] == ["a", "b"]
    assert spark.read.csv(str(tmp_path / "o.csv"), header=True).first()["tokens"] == "a b"
    io.write_matching(df, "[0-9]", "text", str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    io.write_texts(df.withColumn("filename", F.lit("f")), str(tmp_path / "t"))
    io.write_topics(spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "topic_id int, rank int, word string"), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first()["value"] == "Topic 00: a b"


def test_command_line(spark, tmp_path):
    from gritstone.__main__ import main

    src = tmp_path / "in"
    src.mkdir()
    (src / "Acme_10-K_20230131.txt").write_text("##TITLE x\nWe face risk; " + "many words follow here and there; " * 12)
    main(["collect", "--in-dir", str(src), "--out", str(tmp_path / "years"), "--export-parquet"])
    years = spark.read.parquet(str(tmp_path / "years"))
    assert years.count() == 1
    years.select(F.lit("1").alias("sent_id"), F.col("text").alias("sentence_raw")).write.parquet(str(tmp_path / "s.parquet"))
    main(["split", "--input", str(tmp_path / "s.parquet"), "--output", str(tmp_path / "sub")])
    assert spark.read.parquet(str(tmp_path / "sub.parquet")).count() > 1
    main(["tokens", "--input", str(tmp_path / "sub.parquet"), "--text-col", "sentence_sub", "--output-prefix", str(tmp_path / "tok")])
    main(["phrases", "--input", str(tmp_path / "tok.parquet"), "--output-prefix", str(tmp_path / "ph"), "--bigram-min-count", "2", "--bigram-threshold", "-1"])
    main(["apply", "--input", str(tmp_path / "ph_phrases_raw.parquet"), "--output", str(tmp_path / "final")])
    assert "tokens_final" in spark.read.parquet(str(tmp_path / "final")).columns


def test_streams(spark, tmp_path):
    from gritstone.streaming.incremental import exact_dedup_stream, filing_stream

    (tmp_path / "Acme_10-K_20230131.txt").write_text("one\n##title\ntwo")
    q = filing_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("lines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["line"] for r in spark.sql("select line from lines").collect()} == {"one", "two"}
    src = tmp_path / "s"
    spark.createDataFrame([("A.",), ("a",), ("b",)], "t string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(src))
    s = spark.readStream.schema("t string, ts timestamp").parquet(str(src))
    q = exact_dedup_stream(s, "t", "ts").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from firsts").count() == 2
