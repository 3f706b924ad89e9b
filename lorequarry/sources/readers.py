"""Readers of stage files, each with a schema of its own (nothing is inferred)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import safe_id, stem_id

PDF_MAGIC = "25504446"  # %PDF
PAPERS = "title string, authors array<string>, year int, arxiv_id string, abstract string"
SECTIONS = (
    "title string, authors array<struct<name:string,affiliation:string>>, abstract string, "
    "sections struct<introduction:string,method:string,results:string,conclusion:string>, "
    "references array<struct<id:string,title:string,authors:array<string>,year:string,raw:string>>"
)
ENTITIES = "arxiv_id string, title string, authors array<string>, methods_proposed array<string>, methods_criticized array<string>, topics array<string>"
CANDIDATE = "struct<author_id:string,display_name:string,institution:string,works:int,score:double,top_5_works:array<string>>"
CALL_LOG = "timestamp string, stage string, model string, input_tokens bigint, output_tokens bigint, cost double, cache_hit boolean, n_items int"
GOLD = "question string, relevant_chunks array<string>, relevant_papers array<string>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``arxiv_id, file_name, text`` of each file that matches; order by ``file_name``
    where order matters."""
    name = F.col("_metadata.file_name")
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path)
    return raw.select(stem_id(name).alias("arxiv_id"), name.alias("file_name"), F.col("value").alias("text"))


def json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``key, value`` of files that each hold one JSON object of rows."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, question, relevant_chunks, relevant_papers``: keys that begin with an
    underscore and blank questions are dropped; blank ids too."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "raw")).where("query_id not like '\\\\_%'")
    parsed = rows.select("query_id", F.from_json("raw", GOLD).alias("g"))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return parsed.where(F.trim(F.coalesce("g.question", F.lit(""))) != "").select(
        "query_id", F.trim("g.question").alias("question"), clean(F.col("g.relevant_chunks")).alias("relevant_chunks"), clean(F.col("g.relevant_papers")).alias("relevant_papers")
    )


def tolerant_jsonl(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Objects of JSON lines; blank lines, malformed ones and other values are skipped."""
    whole = lines.where(F.trim(F.col(column)).startswith("{") & F.try_parse_json(column).isNotNull())
    return whole.select(F.from_json(F.col(column), schema).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file, tolerantly; a path that does not exist is an empty table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return tolerant_jsonl(spark.read.text(path), schema)


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == PDF_MAGIC


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """``arxiv_id, content`` of the files that are PDFs by their first bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return raw.where(is_pdf(F.col("content"))).select(stem_id(F.element_at(F.split("path", "/"), -1)).alias("arxiv_id"), "content")


def download(papers: DataFrame, held: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """``arxiv_id, status, content`` for each of ``papers`` (``arxiv_id, url``) that ``held``
    (``arxiv_id, content``) has no content of.

    ``fetch`` runs on the executors, once for each paper; its first url, if a paper has
    several.  What is no PDF by its first bytes is ``no pdf``, what fails ``failed``, a
    null url ``no url``, and none of these has content.
    """
    have = held.where(F.octet_length("content") > 0).select("arxiv_id").distinct()
    todo = papers.join(have, "arxiv_id", "left_anti").groupBy("arxiv_id").agg(F.min("url").alias("url"))
    schema = pa.schema([("arxiv_id", pa.string()), ("status", pa.string()), ("content", pa.binary())])

    def one(url: str | None) -> tuple[str, bytes | None]:
        if not url:
            return "no url", None
        try:
            content = fetch(url)
        except Exception:  # the service's own errors are not known here
            return "failed", None
        return ("ok", content) if content[:4].hex().upper() == PDF_MAGIC else ("no pdf", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, url in zip(batch["arxiv_id"].to_pylist(), batch["url"].to_pylist(), strict=True):
                status, content = one(url)
                yield pa.RecordBatch.from_arrays([pa.array([paper], pa.string()), pa.array([status]), pa.array([content], pa.binary())], schema=schema)

    return todo.mapInArrow(run, "arxiv_id string, status string, content binary")


def pdf_texts(pdfs: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """``arxiv_id, status, n_pages, text`` of ``pdf_files``: the texts of the pages,
    joined by line breaks.  ``pages_of`` is a PDF library's; a file that it cannot read
    gives status ``failed`` and no text, one without any text ``empty``."""
    schema = pa.schema([("arxiv_id", pa.string()), ("status", pa.string()), ("n_pages", pa.int32()), ("text", pa.string())])

    def read(content: bytes) -> tuple[str, int, str | None]:
        try:
            pages = [page or "" for page in pages_of(content)]
        except Exception:  # the library's own errors are not known here
            return "failed", 0, None
        text = "\n".join(pages)
        return ("ok" if text.strip() else "empty"), len(pages), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, content in zip(batch["arxiv_id"].to_pylist(), batch["content"], strict=True):
                status, n, text = read(content.as_py() or b"")
                yield pa.RecordBatch.from_pydict({"arxiv_id": [paper], "status": [status], "n_pages": [n], "text": [text]}, schema=schema)

    return pdfs.select("arxiv_id", "content").mapInArrow(run, "arxiv_id string, status string, n_pages int, text string")


def search_results(rows: DataFrame) -> DataFrame:
    """Papers from search results ``entry_id, title, authors, published, summary``."""
    return rows.select(
        "title", "authors", F.year("published").alias("year"), safe_id(F.element_at(F.split("entry_id", "/abs/"), -1)).alias("arxiv_id"), F.col("summary").alias("abstract")
    )


def collection(spark: SparkSession, name: str, roots: dict[str, str]) -> DataFrame:
    """A collection by its alias; an unknown one fails with those there are."""
    if name not in roots:
        raise ValueError(f"unknown collection {name!r}; there are {', '.join(sorted(roots))}")
    return spark.read.parquet(roots[name])


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
