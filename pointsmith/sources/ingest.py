"""Readers: JSON and CSV records, spreadsheets, documents as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    """Points of a JSON-lines file of {id, vector, payload}; payload as JSON text, vectors in any accepted form.

    Shapes are told apart by how the vector's text begins.
    """
    raw = spark.read.schema("id string, vector string, payload string").json(path)
    v = F.try_parse_json(F.col("vector"))
    pair = "struct<indices:array<bigint>,values:array<float>>"
    is_rows, is_dense, is_object, single = (F.rlike(F.col("vector"), F.lit(p)) for p in (r"^\s*\[\s*\[", r"^\s*\[\s*[^\[\]\s]", r"^\s*\{", r'^\s*\{\s*"(indices|values)"'))
    dense, rows = F.try_variant_get(v, "$", "array<float>"), F.try_variant_get(v, "$", "array<array<float>>")
    # Each entry of an object by itself: sparse ones keep their names, of the dense ones the last counts.
    named = F.try_variant_get(v, "$", "map<string,variant>")
    pairs = F.map_filter(F.transform_values(named, lambda k, x: F.try_variant_get(x, "$", pair)), lambda k, x: x["indices"].isNotNull())
    sparse = F.when(single, F.create_map(F.lit("default"), F.try_variant_get(v, "$", pair))).when(is_object & (F.size(pairs) > 0), pairs)
    last_dense = F.try_element_at(F.filter(F.transform(F.map_values(named), lambda x: F.try_variant_get(x, "$", "array<float>")), lambda x: x.isNotNull()), F.lit(-1))
    return raw.select("id", F.col("id").try_cast("bigint").alias("id_num"), F.lit(None).cast("bigint").alias("version"), F.when(is_dense, dense).when(is_rows, F.get(rows, F.lit(0))).when(is_object & ~single, last_dense).alias("vector"), F.when(is_rows, rows).alias("multivector"), sparse.alias("sparse"), "payload")


def sniff(cell: Column) -> Column:
    """A cell's kind: number, bool, text or null, each cell by itself."""
    t = F.trim(cell)
    return F.when(t.isNull() | (t == ""), "null").when(t.try_cast("double").isNotNull() & ~F.rlike(t, F.lit("(?i)[a-df-z]")), "number").when(F.lower(t).isin("true", "false"), "bool").otherwise("string")


def read_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """A CSV with a header: rows of another number of cells are dropped, empty cells are null.

    typed: a column whose cells are all of one kind gets that type; mixed ones stay text. Kinds are found by one pass
    of aggregates, and the file is read by Spark, in splits.
    """
    # Without pruning, as a row whose cells aren't read is not seen to be malformed.
    df = spark.read.option("columnPruning", False).csv(path, header=True, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    if not typed or not df.columns:
        return df
    kinds = df.agg(*[F.array_sort(F.collect_set(sniff(F.col(f"`{c}`")))).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    out = []
    for i, c in enumerate(df.columns):
        own = set(kinds[i]) - {"null"}
        col = F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`"))
        out.append((col.try_cast("double") if own == {"number"} else col.try_cast("boolean") if own == {"bool"} else col).alias(c))
    return df.select(*out)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, every cell as text, empty ones as "". Needs pandas' reader for the format; small files only."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=0, dtype=str).fillna(""))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def html_text(html: Column) -> Column:
    """The visible text of HTML: scripts, styles, comments and tags go, entities of the common kinds are resolved."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.regexp_replace(F.regexp_replace(body, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def docx_text(data: bytes) -> str:
    """The paragraphs of a DOCX file."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    lines = ["".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", xml)]
    text = "\n".join(x for x in lines if x)
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&")


def read_documents(spark: SparkSession, path: str, pdf_reader=None) -> DataFrame:
    """(path, text) of TXT, MD, HTML, DOCX and, with pdf_reader (bytes -> text), PDF files under path.

    Plain text and HTML are decoded by Spark; only DOCX and PDF files go through Python, an Arrow batch at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).alias("kind"))

    @F.pandas_udf("string")
    def parsed(kind, data):
        import pandas as pd

        readers = {"docx": docx_text, "pdf": pdf_reader}
        return pd.Series([readers[k](bytes(x)) if readers.get(k) and x is not None else None for k, x in zip(kind, data)], dtype=object)

    binary = F.col("kind").isin("docx", "pdf")
    packed = files.where(binary).select("path", parsed("kind", "content").alias("text"))
    plain = files.where(~binary).select("path", "kind", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    shown = plain.select("path", F.when(F.col("kind").isin("html", "htm"), html_text(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return shown.unionByName(packed)


def to_envelope(df: DataFrame, took: float = 0.0) -> DataFrame:
    """One JSON row {result, status, time}. For pages of results: the rows come together in one; write large ones as a table."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("result"))
    return rows.select(F.to_json(F.struct("result", F.lit("ok").alias("status"), F.lit(took).alias("time"))).alias("response"))
