"""Entry points end to end: index and graph building, the ways to answer a question,
and their evaluation.

Questions are rows, so a batch of them is one plan.  Model calls are injected; what
a model answered is a table (``query_id, response``) that a cache may replay.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lorequarry.config import CANDIDATES, CONTEXT_PATHS, RECALL_KS, STAGE_HITS, STAGES, TOP_K, VECTOR_CHUNKS
from lorequarry.functions.text import clamp_score, content_key, extract_json_text, format_hits
from lorequarry.operators import chunking, evaluate, filters, graph, ranking, vectors
from lorequarry.scratch import spool
from lorequarry.sources.services import call_service

# The instructions that go before a question.
INSTRUCTIONS = {
    "answer": "Answer from the numbered passages alone and name the papers used. If they do not hold the answer, say so.",
    "filter": "Return one JSON object with year_min, year_max, authors and section for the question; null or [] where it sets none.",
    "metadata": "Answer from the passages and the list of papers that match the filter. If they do not hold the answer, say so.",
    "entities": "Return one JSON object with author_name, topic, method and year_min for the question; null where it names none.",
    "extract": "Return one JSON object with title, authors, methods_proposed, methods_criticized and topics of the paper.",
    "hybrid": "Answer from the passages and the paths of the graph. Name the papers used. If they do not hold the answer, say so.",
    "graph": "Answer from the paths of the graph alone. If they do not hold the answer, say so.",
    "faithfulness": "Rate from 0 to 1 how far the passages support the answer. Return one JSON object with score.",
    "relevance": "Rate from 0 to 1 how far the answer meets the question. Return one JSON object with score.",
}


def prompt(kind: str, question: Column, **blocks: Column) -> Column:
    """Instruction, named blocks and the question, a blank line between."""
    named = [F.concat(F.lit(f"{name.replace('_', ' ').title()}:\n"), block) for name, block in blocks.items()]
    return F.concat_ws("\n\n", F.lit(INSTRUCTIONS[kind]), *named, F.concat(F.lit("Question: "), question))


def ask(prompts: DataFrame, cache: DataFrame, call: Callable[[str], str], model: str) -> DataFrame:
    """``prompts`` (``query_id, request``) with the model's ``response``."""
    return call_service(prompts.withColumn("cache_key", content_key(model, F.col("request"))), cache, call)


# --- building -------------------------------------------------------------------


def build_index(documents: DataFrame, cache: DataFrame, embed: Callable, model: str) -> tuple[DataFrame, DataFrame]:
    """Texts to a collection's rows; also what to add to the embedding cache."""
    probed = vectors.probe_cache(vectors.usable_chunks(chunking.naive_chunks(documents)), cache, model)
    fresh = vectors.embed_missing(probed, embed)
    whole = probed.drop("embedding").join(cache.select("cache_key", "embedding").unionByName(fresh), "cache_key")
    rows = whole.withColumns({"section": F.lit(None).cast("string"), "authors": F.lit(None).cast("array<string>"), "year": F.lit(None).cast("int")})
    return vectors.collection_rows(rows), fresh


def parse_entities(answers: DataFrame) -> DataFrame:
    """Models' answers as ``query_id, author_name, topic, method, year_min``."""
    found = filters.normalize_entities(extract_json_text(F.col("response")))
    return answers.select("query_id", found.alias("e")).select("query_id", "e.*")


def parse_records(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """Models' answers (``arxiv_id, response``) as rows for the graph; the title falls
    back to the paper's own (``arxiv_id, title``), and answers without JSON are left out."""
    known = papers.select("arxiv_id", F.col("title").alias("fallback"))
    # Answers are few bytes for the work they make: they are dealt out to all tasks first.  Exploded, and not
    # filtered, as a filter by what an expression gives would have it evaluated twice.
    dealt = answers.select("arxiv_id", "response").repartition("arxiv_id")
    raw = dealt.select("arxiv_id", F.explode(F.array_compact(F.array(extract_json_text(F.col("response"))))).alias("raw")).join(known, "arxiv_id", "left")
    record = filters.normalize_record(F.col("raw"), F.col("arxiv_id"), F.coalesce("fallback", F.lit("")))
    return raw.select(record.alias("r")).select("r.*")


def parse_filters(answers: DataFrame) -> DataFrame:
    """Models' answers as ``query_id, year_min, year_max, authors, section``."""
    found = filters.normalize_filter(extract_json_text(F.col("response")))
    return answers.select("query_id", found.alias("f")).select("query_id", "f.*")


# --- answering --------------------------------------------------------------------


def _search(collection: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    rows = collection.withColumnRenamed("document", "text")
    return vectors.top_k(rows, questions, k)


def metadata_hits(collection: DataFrame, questions: DataFrame, asked: DataFrame, k: int = TOP_K, candidates: int = CANDIDATES) -> DataFrame:
    """Each question under its own filter: years and section before the search, then
    the ``candidates`` nearest, and authors among those.

    Questions with the same filter share a search; there are as many searches as
    distinct filters, which the questions bound.
    """
    out = None
    for f in asked.select("year_min", "year_max", "section").distinct().collect():
        same = asked.where(F.col("year_min").eqNullSafe(f.year_min) & F.col("year_max").eqNullSafe(f.year_max) & F.col("section").eqNullSafe(f.section))
        rows = collection.withColumnRenamed("document", "text")
        near = vectors.top_k(rows, questions.join(same.select("query_id"), "query_id"), max(k, candidates), filters.build_where(f.year_min, f.year_max, f.section))
        needles = same.select("query_id", F.col("authors").alias("needles"))
        met = near.join(needles, "query_id")
        keep = (F.size("needles") == 0) | filters.author_matches(F.col("authors"), F.col("needles"))
        hits = vectors.over_fetch(met, keep, k).drop("needles", "fetched_rank")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else _search(collection, questions.limit(0), k)


def hybrid_rankings(questions: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, collection: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph's ranking, the vectors' ranking of papers, and the chunks behind it."""
    scored = graph.rank_by_signals(entities, nodes, edges)
    by_graph = ranking.ranked(scored, ["query_id"], ranking.graph_order("score", "year", "doc_id")).select("query_id", "doc_id", "rank")
    chunks = _search(collection, questions, VECTOR_CHUNKS).withColumnRenamed("arxiv_id", "doc_id")
    return by_graph, vectors.collapse_to_papers(chunks).select("query_id", "doc_id", "rank"), chunks


def hybrid_hits(questions: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, collection: DataFrame, fusion: str = "rrf", n: int = TOP_K) -> DataFrame:
    """``query_id, doc_id, rank, chunk_id, text, section`` of the best fused papers."""
    by_graph, by_vector, chunks = hybrid_rankings(questions, entities, nodes, edges, collection)
    fused = ranking.with_fused_rank(ranking.fuse(fusion, by_graph, by_vector), n)
    papers = nodes.where("kind = 'paper'").select(F.col("id").alias("doc_id"), "title")
    return ranking.context_hits(fused, chunks, papers)


def graph_hits(entities: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = TOP_K) -> DataFrame:
    """``query_id, doc_id, rank, chunk_id``: the ``n`` best papers by graph signals; a
    paper stands for its chunks under its own id."""
    scored = graph.rank_by_signals(entities, nodes, edges)
    best = ranking.ranked(scored, ["query_id"], ranking.graph_order("score", "year", "doc_id")).where(F.col("rank") <= n)
    return best.select("query_id", "doc_id", "rank", F.concat("doc_id", F.lit("_graph")).alias("chunk_id"))


def run_stages(
    questions: DataFrame, asked: DataFrame, entities: DataFrame, nodes: DataFrame, edges: DataFrame, collections: dict[str, DataFrame],
    stages: tuple[str, ...] = STAGES, k: int = STAGE_HITS,
) -> dict[str, DataFrame]:
    """The hits of each stage, as ``evaluate_stages`` takes them.

    ``collections``: ``naive`` and ``grobid`` chunks; the later stages search the
    latter.  ``asked`` are the questions' filters, ``entities`` their entities.
    """
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")

    def as_hits(found: DataFrame) -> DataFrame:
        return found.select("query_id", "rank", "chunk_id", F.col("arxiv_id").alias("doc_id"))

    runners = {
        "naive": lambda: as_hits(_search(vectors.require_rows(collections["naive"]), questions, k)),
        "grobid": lambda: as_hits(_search(vectors.require_rows(collections["grobid"]), questions, k)),
        "metadata": lambda: as_hits(metadata_hits(vectors.require_rows(collections["grobid"]), questions, asked, k)),
        "graph": lambda: graph_hits(entities, nodes, edges, k),
        "hybrid": lambda: hybrid_hits(questions, entities, nodes, edges, vectors.require_rows(collections["grobid"]), n=k).select(
            "query_id", "rank", "chunk_id", "doc_id"
        ),
    }
    return {stage: runners[stage]() for stage in stages}


def measured(stages: dict[str, DataFrame], questions: DataFrame) -> tuple[dict[str, DataFrame], dict[str, float], dict[str, int]]:
    """Each stage's hits, written once, with the milliseconds that a question took and
    how many hits there were: the writing itself is timed and counted."""
    asked = max(1, questions.count())
    hits, latency, counts = {}, {}, {}
    for stage, found in stages.items():
        seen = Observation()
        began = time.perf_counter()
        hits[stage] = spool(found.observe(seen, F.count(F.lit(1)).alias("hits")), f"stage-{stage}")
        latency[stage] = 1000 * (time.perf_counter() - began) / asked
        counts[stage] = seen.get["hits"]
    return hits, latency, counts


def judge_prompts(hits: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``query_id, metric, request``: what a judge is asked of each answer (``query_id,
    response``) to a question (``query_id, text``), with the ``TOP_K`` hits as passages."""
    passages = context(hits.where(F.col("rank") <= TOP_K))
    rows = questions.select("query_id", "text").join(answers.select("query_id", F.col("response").alias("answer")), "query_id").join(passages, "query_id", "left")
    passage = F.coalesce("context", F.lit(""))
    kinds = {"faithfulness": {"passages": passage, "answer": F.col("answer")}, "relevance": {"answer": F.col("answer")}}
    asked = [rows.select("query_id", F.lit(kind).alias("metric"), prompt(kind, F.col("text"), **blocks).alias("request")) for kind, blocks in kinds.items()]
    return asked[0].unionByName(asked[1])


def author_paths(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, paths``: up to ``CONTEXT_PATHS`` paths from asked authors to papers."""
    asked = entities.where("author_name is not null").select("query_id", F.col("author_name").alias("query"))
    found = asked.join(graph.match_names(asked, graph.labels(nodes, "author")), "query").select("query_id", F.col("id").alias("author_id"))
    walked = found.join(graph.author_papers(found, nodes, edges), "author_id")
    listed = F.array_sort(F.collect_set("path"))
    return walked.groupBy("query_id").agg(F.slice(listed, 1, CONTEXT_PATHS).alias("paths"))


def context(hits: DataFrame) -> DataFrame:
    """``query_id, context``: the hits of each question as numbered blocks."""
    fields = {"arxiv_id": "doc_id", "text": "text", "section": "section"}
    present = set(hits.columns)
    hit = F.struct(
        F.col("rank"), *(F.col(b).alias(a) for a, b in fields.items()),
        *((F.col(c) if c in present else F.lit(None)).cast(t).alias(c) for c, t in (("year", "int"), ("authors", "string"))),
    )
    return hits.groupBy("query_id").agg(format_hits(F.array_sort(F.collect_list(hit))).alias("context"))


def author_bundle(query: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All authors of a like name, with their papers, institutions and coauthors."""
    found = graph.find_authors(query, nodes).withColumnRenamed("id", "author_id")
    return {
        "authors": found,
        "papers": graph.author_papers(found, nodes, edges).orderBy("author_id", *ranking.year_asc("year", "paper_id")),
        "institutions": graph.author_institutions(found, nodes, edges),
        "coauthors": graph.coauthor_paths(found, nodes, edges).orderBy("author_id", "name", "coauthor_id", "paper_id"),
    }


def method_bundle(query: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All methods of a like name, best match first, and the papers against them."""
    return {
        "methods": graph.match_names(query, graph.labels(nodes, "method")).orderBy("query", F.col("score").desc(), "seq", "id"),
        "papers": graph.papers_criticising(query, nodes, edges).orderBy("query", *ranking.year_asc("year", "paper_id")),
    }


def print_hits(hits: DataFrame, n: int = TOP_K) -> None:
    """Rank, ids, section and distance of one question's hits."""
    rows = hits.orderBy("rank").limit(n).collect()
    print("\n".join(f"{r['rank']:>2}. {r['chunk_id']} [{r['section'] or '-'}] {r['distance']:.4f}" for r in rows) or "(yok)")


def print_paths(paths: DataFrame, n: int = TOP_K) -> None:
    """The first paths of an answer (column ``path``), numbered."""
    rows = paths.orderBy("path").limit(n).collect()
    print("\n".join(f"{k:>2}. {r['path']}" for k, r in enumerate(rows, 1)) or "(yok)")


# --- evaluating ---------------------------------------------------------------------


def evaluate_stages(gold: DataFrame, hits: dict[str, DataFrame], judged: DataFrame | None = None, latency_ms: dict[str, float] | None = None) -> DataFrame:
    """Means by stage of recall, judges' scores and latency, as text.

    ``hits``: by stage, ``query_id, rank, chunk_id, doc_id`` of the questions that
    were answered; others are left out of every mean.  ``judged``: ``stage,
    query_id, metric, response``.
    """
    if unknown := set(hits) - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    out = None
    for stage, found in hits.items():
        rows = evaluate.recall_at_k(gold, found, RECALL_KS).withColumn("stage", F.lit(stage))
        rows = rows.withColumn("latency_ms", F.lit((latency_ms or {}).get(stage)).cast("double"))
        out = rows if out is None else out.unionByName(rows)
    metrics = [f"recall_at_{k}" for k in RECALL_KS]
    if judged is not None:
        score = clamp_score(F.get_json_object(extract_json_text(F.col("response")), "$.score"))
        wide = judged.groupBy("stage", "query_id").pivot("metric", ["faithfulness", "relevance"]).agg(F.first(score))
        out = out.join(wide, ["stage", "query_id"], "left")
        metrics += ["faithfulness", "relevance"]
    metrics.append("latency_ms")
    return evaluate.summary(evaluate.stage_means(out, metrics), metrics)
