"""Sources and sinks: texts, delimited tables of unknown make, Parquet, lists; audits and reports.

Everything goes through Spark's readers and writers, so any file system Spark reaches will do.
"""

from __future__ import annotations

import codecs
import functools
import io as stdio
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip

#: Encodings tried in turn; the last never fails.
ENCODINGS = ("utf-8", "utf-8-sig", "ascii", "cp1252", "latin1")
DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab"}
HEAD_BYTES = 200_000


def read_texts(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.txt", skip_cleaned: bool = False, strict: bool = False) -> DataFrame:
    """(path, filename, content): whole texts by file, bad bytes and byte-order marks dropped. ``strict`` makes bad bytes
    an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = F.expr("validate_utf8(cast(content as string))") if strict else F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("\ufffd"), F.lit(""))
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.regexp_replace(text, "^\ufeff", "").alias("content"))
    out = out.where(~F.col("filename").startswith("."))
    return out.where(~F.contains(F.lower("filename"), F.lit("cleaned"))) if skip_cleaned else out


def sniff_delimiter(sample: str) -> str | None:
    """The most frequent of comma, semicolon and tab in the first 50 non-blank lines (ties: tab, comma,
    semicolon); None where there is none."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    counts = {d: sum(x.count(d) for x in lines) for d in ("\t", ",", ";")}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def sniff_encoding(head: bytes, whole: bool = False) -> str:
    """The first encoding that reads the head. A character cut at its end does not count against one."""
    for name in ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=whole)
        except UnicodeDecodeError:
            continue
        if name == "utf-8" and head.startswith(codecs.BOM_UTF8):
            return "utf-8-sig"
        return name
    return ENCODINGS[-1]


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the file, or of the first file of a folder, through Hadoop's streams: no more is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isDirectory():
        names = [s.getPath() for s in system.listStatus(target) if s.isFile() and s.getPath().getName()[:1] not in "._"]
        if not names:
            return b""
        target = min(names, key=lambda p: p.getName())
    stream = system.open(target)
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited table with a header, encoding and delimiter sniffed where not given; broken lines are
    dropped."""
    head = _head(spark, path)
    encoding = encoding or sniff_encoding(head, len(head) < HEAD_BYTES)
    sep = sep or sniff_delimiter(head.decode(encoding, errors="replace")) or ","
    java = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin1": "ISO-8859-1", "ascii": "US-ASCII"}.get(encoding, encoding)
    table = spark.read.csv(path, header=True, sep=sep, encoding=java, mode="DROPMALFORMED", multiLine=True, escape='"')
    if encoding == "cp1252":
        # It differs from latin1 in 0x80 to 0x9F only, where latin1 has control characters.
        pairs = [(bytes([b]).decode("latin1"), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]
        old, new = ("".join(x) for x in zip(*[p for p in pairs if p[1]], strict=True))
        names = [c.translate(str.maketrans(old, new)) for c in table.columns]
        table = table.select([F.translate(F.col(f"`{c}`"), old, new).alias(n) for c, n in zip(table.columns, names, strict=True)])
    return table.toDF(*[c.lstrip("\ufeff") for c in table.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, tab or comma separated, by the name's ending."""
    low = path.lower().rstrip("/")
    if low.endswith(".tsv"):
        return read_delimited(spark, path, sep="\t")
    if low.endswith((".csv", ".txt")):
        return read_delimited(spark, path)
    if low.endswith(".xlsx"):
        return read_sheet(spark, path)
    if low.endswith(".xls"):
        raise ValueError("the old binary spreadsheets have no reader here: save as XLSX, CSV or Parquet")
    return spark.read.parquet(path)


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The first sheet of an XLSX file, row by row, as text; gaps are None."""
    tag = lambda e: e.tag.rpartition("}")[2]
    inner = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(stdio.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [inner(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(first)).iter() if tag(e) == "row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(e for e in row if tag(e) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters[0], 0) - 1 if letters else k
                value = next((e.text for e in c if tag(e) == "v"), None)
                kind = c.get("t")
                cells[at] = shared[int(value)] if kind == "s" and value is not None else inner(c) if kind == "inlineStr" else value
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an XLSX file, its first row as header, all columns text. A sheet is made by people and is
    small (a million rows by its format): it is read in one piece through Spark's binary reader."""
    found = spark.read.format("binaryFile").load(path).orderBy("path").select("content").first()
    rows = sheet_rows(bytes(found["content"])) if found else []
    if not rows:
        return spark.createDataFrame([], "value string")
    names = [n if n else f"column{k + 1}" for k, n in enumerate(rows[0])]
    width = len(names)
    body = [tuple((r + [None] * width)[:width]) for r in rows[1:]]
    return spark.createDataFrame(body, StructType([StructField(n, StringType()) for n in names]))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A square CSV with names in its first column and header, as (a, b, sim)."""
    m = spark.read.csv(path, header=True, inferSchema=True)
    first, rest = m.columns[0], m.columns[1:]
    return m.unpivot(first, [F.col(f"`{c}`").cast("double").alias(c) for c in rest], "b", "sim").select(F.col(first).cast("string").alias("a"), "b", "sim")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several paths that is there."""
    for p in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return p
    raise FileNotFoundError(", ".join(paths))


def pick_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first of several columns that the table has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return found


def present(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that are there, in that order."""
    return df.select([c for c in dict.fromkeys(preferred) if c in df.columns])


def numbered_columns(df: DataFrame, prefix: str = "emb_") -> list[str]:
    """Columns named prefix and number, by number: 2 before 10."""
    found = [(int(c[len(prefix) :]), c) for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return [c for _, c in sorted(found)]


def to_vector(df: DataFrame, prefix: str = "emb_", out: str = "embedding") -> DataFrame:
    """Numbered columns as one array."""
    names = numbered_columns(df, prefix)
    return df.select(*[c for c in df.columns if c not in names], F.array(*[F.col(c).cast("double") for c in names]).alias(out))


def to_columns(df: DataFrame, size: int, vector: str = "embedding", prefix: str = "emb_") -> DataFrame:
    """An array as numbered columns."""
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, k).alias(f"{prefix}{k}") for k in range(size)])


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows, for debugging."""
    return df.orderBy(order).limit(n)


def word_list(spark: SparkSession, path: str, phrases: bool = False) -> list[str]:
    """Entries of a list, one to a line, in lower case, sorted; blanks and ``#`` comments left out. As phrases,
    spaces and hyphens become ``_``. A list is read by people and is small."""
    w = F.lower(strip(F.regexp_replace("value", "^\ufeff", "")))
    rows = spark.read.text(path).select(w.alias("w")).where((F.col("w") != "") & ~F.col("w").startswith("#"))
    if phrases:
        rows = rows.select(F.translate("w", " -", "__").alias("w"))
    return sorted(r["w"] for r in rows.distinct().collect())


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str, quote_all: bool = False, bom: bool = False) -> None:
    """CSV with a header in each part file. ``bom`` puts a byte-order mark before it, as spreadsheets like."""
    if not bom:
        df.write.mode("overwrite").option("quoteAll", str(quote_all).lower()).option("escape", '"').csv(path, header=True)
        return
    quoted = ",".join(('"' + c.replace('"', '""') + '"') if quote_all or set(c) & set('",\n') else c for c in df.columns)
    options = {"quoteAll": str(quote_all).lower(), "escape": '"', "header": "false"}

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["\ufeff" + quoted])], names=["value"])
        yield from batches

    df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Spark brings its Parquet writer with it, so there is no other engine to fall back to."""
    df.write.mode("overwrite").parquet(path)


def write_both(df: DataFrame, prefix: str) -> None:
    """Parquet for programs and CSV for people; arrays are joined for the latter."""
    write_parquet(df, f"{prefix}.parquet")
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
    write_csv(df.select(flat), f"{prefix}.csv")


def write_texts(df: DataFrame, path: str, by: str = "filename", text: str = "text") -> None:
    """One folder for each value of ``by``, holding its text."""
    df.select(by, text).write.mode("overwrite").partitionBy(by).text(path)


def write_matching(df: DataFrame, pattern: str, text: str, path: str) -> None:
    """Only the rows whose text the pattern matches."""
    write_parquet(df.where(F.col(text).rlike(pattern)), path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """(topic_id, rank, word) as lines "Topic 00: ..."."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    lines = topics.groupBy("topic_id").agg(words.alias("w")).select("topic_id", F.format_string("Topic %02d: %s", "topic_id", F.array_join("w", " ")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("topic_id").select("value").write.mode("overwrite").text(path)
