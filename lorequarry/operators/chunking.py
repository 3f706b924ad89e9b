"""Chunks of papers: plain recursive splitting, and by section."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.config import CHUNK_OVERLAP, CHUNK_SIZE, SECTION_PLAN, SMALLEST_RESPLIT

SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that begin with the separator, but for the first."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _windows(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces of at most ``size`` characters, that share up to ``overlap``."""
    start, total = 0, 0
    for end, piece in enumerate(pieces):
        if total + len(piece) > size and end > start:
            yield "".join(pieces[start:end])
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(pieces[start])
                start += 1
        total += len(piece)
    if start < len(pieces):
        yield "".join(pieces[start:])


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the widest separator that there
    is, and at narrower ones within pieces that are too long."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    narrower, out, short = separators[at + 1 :], [], []

    def flush() -> None:
        out.extend(c for w in _windows(short, size, overlap) if (c := w.strip()))
        short.clear()

    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, narrower) if narrower else [piece])
    flush()
    return out


def merge_to_n(pieces: list[str], n: int) -> list[str]:
    """Neighbouring pieces merged into ``n`` groups of near equal count."""
    if n <= 0:
        return []
    if len(pieces) <= n:
        return pieces
    bounds = [i * len(pieces) // n for i in range(n + 1)]
    return ["\n\n".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_to_n_column(pieces: Column, n: int) -> Column:
    """``merge_to_n`` as an expression."""
    size = F.size(pieces)
    bound = lambda i: F.floor(i * size / n).cast("int")
    group = lambda i: F.array_join(F.slice(pieces, bound(i) + 1, bound(i + 1) - bound(i)), "\n\n")
    return F.when(size <= n, pieces).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), group))


def split_in_range(text: str, least: int, most: int) -> list[str]:
    """From ``least`` to ``most`` pieces: merged if too many, cut finer if too few
    and the text is long enough; a short text is not padded out."""
    text = text.strip()
    pieces = [p for p in (c.strip() for c in split_text(text)) if p]
    if len(pieces) < least and len(text) > CHUNK_SIZE:
        finer = max(SMALLEST_RESPLIT, len(text) // least)
        pieces = [p for p in (c.strip() for c in split_text(text, finer, min(CHUNK_OVERLAP, finer // 2))) if p]
    return merge_to_n(pieces, most) if len(pieces) > most else pieces


def _array_udf(df: DataFrame, column: str, out: str, split) -> DataFrame:
    """``df`` with an array of strings made from ``column``, on Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([split(x or "") for x in part[column].to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], schema=arrow)

    return df.mapInArrow(run, schema)


def naive_chunks(documents: DataFrame) -> DataFrame:
    """``text, arxiv_id, chunk_id, source_file, method`` from ``arxiv_id, text,
    source_file``; blank documents give none."""
    filled = documents.select("arxiv_id", "text", "source_file").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    cut = _array_udf(filled, "text", "pieces", split_text)
    return cut.select("arxiv_id", "source_file", F.posexplode("pieces").alias("at", "text")).select(
        "text", "arxiv_id", F.format_string("%s_%04d", "arxiv_id", "at").alias("chunk_id"), "source_file", F.lit("pypdf").alias("method")
    )


def author_names(authors: Column) -> Column:
    """Trimmed names of author records, without blank ones."""
    names = F.transform(F.coalesce(authors, F.array()), lambda a: F.trim(a["name"]))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def section_chunks(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """``text, arxiv_id, section, chunk_id, authors, year, method`` by section plan.

    The abstract is one chunk; other planned sections are cut into their range;
    the rest are left out.  ``metadata`` gives the year by ``arxiv_id``, of repeated
    ids the last by ``seq``.
    """
    from lorequarry.operators.ranking import first_per_key

    years = first_per_key(metadata.select("arxiv_id", "year", "seq"), ["arxiv_id"], [F.col("seq").desc()]).select("arxiv_id", "year")
    plan = [F.struct(F.lit("abstract").alias("section"), F.col("abstract").alias("text"), F.lit(1).alias("least"), F.lit(1).alias("most"), F.lit(0).alias("nth"))]
    plan += [
        F.struct(F.lit(n).alias("section"), F.col(f"sections.{n}").alias("text"), F.lit(a).alias("least"), F.lit(b).alias("most"), F.lit(i).alias("nth"))
        for i, (n, a, b) in enumerate(SECTION_PLAN, 1)
    ]
    planned = (
        papers.select("arxiv_id", author_names(F.col("authors")).alias("authors"), F.explode(F.array(*plan)).alias("p"))
        .select("arxiv_id", "authors", "p.*").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    )
    packed = planned.withColumn("packed", F.concat_ws("\x1f", "least", "most", "text"))

    def split(value: str) -> list[str]:
        least, most, text = value.split("\x1f", 2)
        return [text.strip()] if most == "1" else split_in_range(text, int(least), int(most))

    cut = _array_udf(packed.drop("text"), "packed", "pieces", split)
    return (
        cut.select("arxiv_id", "authors", "section", F.posexplode("pieces").alias("at", "text")).join(years, "arxiv_id", "left")
        .select("text", "arxiv_id", "section", F.format_string("%s_%s_%02d", "arxiv_id", "section", "at").alias("chunk_id"), "authors", "year", F.lit("grobid").alias("method"))
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and their mean length (half to even) by section; a grand total has a null section."""
    return chunks.rollup("section").agg(F.count("*").alias("n"), F.coalesce(F.bround(F.avg(F.length("text"))), F.lit(0)).cast("bigint").alias("mean_chars"))
