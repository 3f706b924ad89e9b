"""The property graph: nodes and edges as tables, and queries of one and two hops.

``nodes``: ``kind, id, name, aliases, institution, title, year, seq``.
``edges``: ``src_kind, src_id, relation, dst_kind, dst_id, seq``, each edge once.
``seq`` is the order of insertion, which decides ties.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.config import (
    AUTHOR_POINTS, CRITICISES, CRITICISES_POINTS, NAME_MATCH, PROPOSES, PROPOSES_POINTS, PUBLISHED, TITLE_MIN, TOPIC_METHOD_POINTS,
    TOPIC_TITLE_POINTS, WORKS_AT, WROTE, YEAR_POINTS,
)
from lorequarry.functions.text import (
    clean_text, distinct_ignoring_case, longest_label, name_labels, strip_version, year_from_paper_id,
)
from lorequarry.operators.filters import year_ok
from lorequarry.operators.fuzzy import like_names, like_titles
from lorequarry.operators.ranking import first_per_key, meet
from lorequarry.scratch import spool

NODE_COLUMNS = "kind string, id string, name string, aliases array<string>, institution string, title string, year int, seq bigint"


def edge(src_kind: str, src: Column, relation: str, dst_kind: str, dst: Column, seq: Column) -> list[Column]:
    return [
        F.lit(src_kind).alias("src_kind"), src.cast("string").alias("src_id"), F.lit(relation).alias("relation"),
        F.lit(dst_kind).alias("dst_kind"), dst.cast("string").alias("dst_id"), seq.cast("bigint").alias("seq"),
    ]


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, at its first insertion."""
    return edges.groupBy("src_kind", "src_id", "relation", "dst_kind", "dst_id").agg(F.min("seq").alias("seq"))


def simple_nodes(kind: str, ids: DataFrame) -> DataFrame:
    """Nodes without attributes from ``id, seq``: inserted if absent."""
    kept = ids.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.min("seq").alias("seq"))
    return _as_nodes(kept.withColumn("kind", F.lit(kind)))


def _as_nodes(df: DataFrame) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(NODE_COLUMNS).fields
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def paper_nodes(papers: DataFrame) -> DataFrame:
    """Papers from ``id, title, year, seq``: a later row replaces title and year."""
    last = first_per_key(papers.where(F.coalesce("id", F.lit("")) != ""), ["id"], [F.col("seq").desc()])
    return _as_nodes(last.withColumn("kind", F.lit("paper")))


def author_nodes(mentions: DataFrame) -> DataFrame:
    """Authors from mentions ``id, name, aliases, institution, seq``.

    Aliases merge in order ignoring case; the first institution that is not empty
    stays; the name is replaced by longer ones only.
    """
    named = mentions.where(F.coalesce("id", F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "name", "aliases", "institution")))
    gathered = named.groupBy("id").agg(ordered.alias("m"), F.min("seq").alias("seq"))
    m = F.col("m")
    aliases = F.flatten(F.transform(m, lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>"))))
    places = F.filter(F.transform(m, lambda x: clean_text(x["institution"])), lambda x: x != "")
    names = F.transform(m, lambda x: clean_text(x["name"]))
    return _as_nodes(
        gathered.select(
            F.lit("author").alias("kind"), "id", longest_label(F.get(names, F.lit(0)), names).alias("name"),
            distinct_ignoring_case(aliases).alias("aliases"), F.coalesce(F.get(places, F.lit(0)), F.lit("")).alias("institution"), "seq",
        )
    )


@dataclass
class Parts:
    """What nodes and edges are made of, written once.

    ``base``: rows of papers with ``year``, distinct cleaned ``names``, and if a row is the
    only one of its paper (``alone``); ``held``: the mapping to author ids, with names
    that are an author's only one (``single``); ``mentions``: ``held`` with the ``seq`` at
    which a name is first seen.
    """

    base: DataFrame
    held: DataFrame
    mentions: DataFrame


def parts_of(entities: DataFrame, mapping: DataFrame, papers: DataFrame) -> Parts:
    """See ``build``."""
    years = papers.select(strip_version(F.col("arxiv_id")).alias("bare"), F.col("year").alias("known")).dropDuplicates(["bare"])
    base = (
        entities.where(F.trim(F.coalesce("arxiv_id", F.lit(""))) != "")
        .withColumn("bare", strip_version(F.col("arxiv_id")))
        .join(years, "bare", "left")
        .withColumn("alone", F.count("*").over(Window.partitionBy("bare")) == 1)
        .withColumn("year", F.coalesce("known", year_from_paper_id(F.col("arxiv_id"))))
        .withColumn("names", F.array_distinct(F.transform("authors", clean_text)))
        .drop("authors", "known")
    )
    held = mapping.where(F.col("author_id").startswith("A"))
    for key in ("query_name", "author_id"):
        held = held.withColumn(f"one_{key}", F.count("*").over(Window.partitionBy(key)) == 1)
    base, held = spool(base, "graph-base"), spool(held.withColumn("single", F.col("one_query_name") & F.col("one_author_id")), "graph-names")
    # Of equal mentions the first alone tells: names are counted once before they meet the mapping.
    firsts = base.select("seq", F.explode("names").alias("query_name")).groupBy("query_name").agg(F.min("seq").alias("seq"))
    return Parts(base, held, spool(firsts.join(held, "query_name"), "graph-mentions"))


def edges_of(parts: Parts, wrote: bool = True) -> DataFrame:
    """Edges, each once.  What one row of a paper says is said once: only papers of
    several rows, and authors of several names, are grouped.

    A name that many authors share gives as many edges from each of its papers; without
    ``wrote`` edges from authors to papers are not made, and ``papers_by`` finds those
    of some authors.
    """
    alone, several = parts.base.where("alone"), parts.base.where("not alone")
    once = [*_said(alone), *([_wrote(alone, parts.held.where("single"))] if wrote else [])]
    again = [_works_at(parts.mentions)]
    if wrote and not parts.held.where("not single").isEmpty():
        again.append(_wrote(alone, parts.held.where("not single")))
    if not several.isEmpty():
        again += [*_said(several), *([_wrote(several, parts.held)] if wrote else [])]
    return spool(reduce(DataFrame.unionByName, [*once, distinct_edges(reduce(DataFrame.unionByName, again))]), "graph-edges")


def papers_by(parts: Parts, authors: DataFrame) -> DataFrame:
    """``query_id, paper_id, times``: for questions' ``authors`` (``query_id, id``), how many
    of them wrote a paper.  Their names are counted first, so that a name meets its papers
    once for a question, however many of the authors share it."""
    asked = spool(authors.distinct(), "asked-authors").join(parts.held.select("author_id", "query_name").distinct(), F.col("id") == F.col("author_id"))
    several = Window.partitionBy("query_id", "id")
    named = spool(asked.select("query_id", "id", "query_name", (F.count("*").over(several) > 1).alias("several")), "asked-names")
    papers = parts.base.select("arxiv_id", "alone", F.explode("names").alias("query_name"))
    counted = named.where("not several").groupBy("query_id", "query_name").agg(F.count("*").alias("times"))
    plain = papers.where("alone").join(counted, "query_name").select("query_id", F.col("arxiv_id").alias("paper_id"), "times")
    # An author of several names, and a paper of several rows, may meet more than once.
    again = papers.join(named, "query_name").where("several or not alone").select("query_id", "id", F.col("arxiv_id").alias("paper_id")).distinct()
    return plain.unionByName(again.select("query_id", "paper_id", F.lit(1).cast("bigint").alias("times")))


def nodes_of(parts: Parts, edges: DataFrame | None = None) -> DataFrame:
    """Nodes.  Those that are ends of edges are read from ``edges`` if they are made."""
    if edges is None:
        edges = reduce(DataFrame.unionByName, [*_said(parts.base), _works_at(parts.mentions)])
    ends = edges.where(F.col("dst_kind").isin("method", "institution", "year") & (F.coalesce("dst_id", F.lit("")) != ""))
    others = ends.groupBy(F.col("dst_kind").alias("kind"), F.col("dst_id").alias("id")).agg(F.min("seq").alias("seq"))
    authors = author_nodes(parts.mentions.select(F.col("author_id").alias("id"), F.col("query_name").alias("name"), "aliases", "institution", "seq"))
    papers = parts.base.select(F.lit("paper").alias("kind"), F.col("arxiv_id").alias("id"), "title", "year", "seq", "alone")
    kinds = [_as_nodes(papers.where("alone")), authors, _as_nodes(others)]
    if not parts.base.where("not alone").isEmpty():
        kinds.append(paper_nodes(papers.where("not alone").drop("kind")))
    return reduce(DataFrame.unionByName, kinds)


def build(entities: DataFrame, mapping: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from extracted entities, resolved authors and paper metadata.

    ``entities``: ``arxiv_id, title, authors, methods_proposed, methods_criticized,
    seq``; ``mapping``: ``query_name, author_id, institution, aliases``; ``papers``:
    ``arxiv_id, year``.  A year is the metadata's, else the id's.  Names meet the
    mapping by exact spelling after cleaning; the rest are left out.
    """
    parts = parts_of(entities, mapping, papers)
    edges = edges_of(parts)
    return nodes_of(parts, edges), edges


def _works_at(mentions: DataFrame) -> DataFrame:
    place = clean_text(F.col("institution"))
    return mentions.where(place != "").select(*edge("author", F.col("author_id"), WORKS_AT, "institution", place, F.col("seq")))


def _wrote(base: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges from authors to papers."""
    named = base.select("arxiv_id", "seq", F.explode("names").alias("query_name"))
    found = named.join(mapping.select("query_name", "author_id"), "query_name")
    return found.select(*edge("author", F.col("author_id"), WROTE, "paper", F.col("arxiv_id"), F.col("seq")))


def _said(base: DataFrame) -> list[DataFrame]:
    """Edges from papers to years and methods, each once for each row."""
    paper, seq = F.col("arxiv_id"), F.col("seq")

    def methods(column: str, relation: str) -> DataFrame:
        listed = base.select("arxiv_id", "seq", F.explode(distinct_ignoring_case(F.col(column))).alias("method"))
        return listed.select(*edge("paper", paper, relation, "method", F.col("method"), seq))

    year = base.where("year is not null").select(*edge("paper", paper, PUBLISHED, "year", F.col("year"), seq))
    return [year, methods("methods_proposed", PROPOSES), methods("methods_criticized", CRITICISES)]


def unresolved_mentions(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names on papers that the mapping lacks, with the times they stand there."""
    named = entities.select(F.explode("authors").alias("raw")).select(clean_text(F.col("raw")).alias("query_name"))
    return named.join(mapping, "query_name", "left_anti").groupBy("query_name").agg(F.count("*").alias("n"))


def summarize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, key, n``: nodes by kind and edges by relation; a missing key is '?'."""
    count = lambda df, what, key: df.groupBy(F.coalesce(key, F.lit("?")).alias("key")).agg(
        F.lit(what).alias("what"), F.count("*").alias("n")
    ).select("what", "key", "n")
    return count(nodes, "node", "kind").unionByName(count(edges, "edge", "relation"))


# --- names --------------------------------------------------------------------


def labels(nodes: DataFrame, kind: str) -> DataFrame:
    """``id, label, seq`` for each name, alias and id of the nodes of a kind."""
    own = nodes.where(F.col("kind") == kind)
    listed = F.concat(name_labels(F.col("name"), F.col("aliases")), F.array("id"))
    return own.select("id", "seq", F.explode(F.array_distinct(listed)).alias("label"))


def match_names(queries: DataFrame, labelled: DataFrame, least: float = NAME_MATCH) -> DataFrame:
    """``query, id, score, seq`` of the nodes whose best label reaches ``least``.

    Labels are looked up by what a like name shares with them, each spelling once,
    however many nodes have it; see ``fuzzy.like_names``.
    """
    found = like_names(queries.select("query"), labelled.select("label"), least)
    return found.join(labelled, "label").groupBy("query", "id").agg(F.max("score").alias("score"), F.min("seq").alias("seq"))


def find_authors(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``match_names``, but an author id asked for by itself is the one match."""
    ids = nodes.where("kind = 'author'").select("id", "seq")
    asked = queries.select("query").distinct()
    direct = asked.where(F.col("query").startswith("A")).join(ids, F.col("query") == F.col("id")).select("query", "id", F.lit(1.0).alias("score"), "seq")
    rest = asked.join(direct.select("query"), "query", "left_anti")
    return direct.unionByName(match_names(rest, labels(nodes, "author")))


def author_payload(nodes: DataFrame) -> DataFrame:
    """``author_id, name, aliases, institution`` as an answer shows an author: the id for a
    name that lacks, and no nulls."""
    own = nodes.where("kind = 'author'")
    none = F.array().cast("array<string>")
    return own.select(
        F.col("id").alias("author_id"), F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("institution", F.lit("")).alias("institution")
    )


def paper_payload(nodes: DataFrame) -> DataFrame:
    """``paper_id, title, year`` as an answer shows a paper: the id for a title that lacks."""
    own = nodes.where("kind = 'paper'")
    return own.select(F.col("id").alias("paper_id"), F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"), "year")


# --- hops ---------------------------------------------------------------------


def _hop(edges: DataFrame, relation: str, src_kind: str | None = None, dst_kind: str | None = None) -> DataFrame:
    kept = edges.where(F.col("relation") == relation)
    if src_kind:
        kept = kept.where(F.col("src_kind") == src_kind)
    return kept.where(F.col("dst_kind") == dst_kind) if dst_kind else kept


def step(kind: str, key: Column) -> Column:
    """A node in a path: its kind and id."""
    return F.concat(F.lit(f"{kind}:"), key)


def path(*parts: Column) -> Column:
    return F.concat_ws(" — ", *parts)


def _papers(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'paper'").select(F.col("id").alias("paper_id"), "title", "year")


def author_papers(authors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_id, paper_id, title, year, path`` for ``authors`` (``author_id``)."""
    wrote = _hop(edges, WROTE, "author", "paper").select(F.col("src_id").alias("author_id"), F.col("dst_id").alias("paper_id"))
    return (
        authors.select("author_id").distinct().join(wrote, "author_id").join(_papers(nodes), "paper_id")
        .select("author_id", "paper_id", "title", "year", path(step("author", F.col("author_id")), F.lit(WROTE), step("paper", F.col("paper_id"))).alias("path"))
    )


def author_papers_or_note(authors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_papers``, and for an id that the graph lacks one row that says so."""
    known = nodes.where("kind = 'author'").select(F.col("id").alias("author_id"))
    missing = authors.select("author_id").distinct().join(known, "author_id", "left_anti")
    note = missing.select(
        "author_id", F.lit(None).cast("string").alias("paper_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"),
        path(step("author", F.col("author_id")), F.lit("YOK"), F.lit("düğüm yok")).alias("path"),
    )
    return author_papers(authors, nodes, edges).unionByName(note)


def author_institutions(authors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_id, institution``: by edge, and the node's own where no edge names it."""
    asked = authors.select("author_id").distinct()
    by_edge = _hop(edges, WORKS_AT, "author").select(F.col("src_id").alias("author_id"), F.col("dst_id").alias("institution"))
    own = nodes.where("kind = 'author' and coalesce(institution, '') <> ''").select(F.col("id").alias("author_id"), "institution")
    return asked.join(by_edge.unionByName(own).distinct(), "author_id")


def papers_criticising(methods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query, paper_id, title, year, method_id, path``: papers that criticise a
    method of a like name; of several such methods the best match, then the first."""
    found = match_names(methods, labels(nodes, "method"))
    against = _hop(edges, CRITICISES, "paper", "method").select(F.col("src_id").alias("paper_id"), F.col("dst_id").alias("id"))
    rows = found.join(against, "id").select("query", "paper_id", F.col("id").alias("method_id"), "score", "seq")
    order = [F.col("score").desc(), F.col("seq"), F.col("method_id")]
    walked = path(step("paper", F.col("paper_id")), F.lit(CRITICISES), step("method", F.col("method_id"))).alias("path")
    return first_per_key(rows, ["query", "paper_id"], order).join(_papers(nodes), "paper_id").select("query", "paper_id", "title", "year", "method_id", walked)


def _all_wrote(edges: DataFrame) -> DataFrame:
    """``coauthor_id, paper_id``; an edge is in the table once."""
    return _hop(edges, WROTE, "author", "paper").select(F.col("src_id").alias("coauthor_id"), F.col("dst_id").alias("paper_id"))


def _asked_papers(authors: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked ids, each once, and ``author_id, paper_id`` of their papers.  Written, so
    that few of them are known to be few before all edges are dealt out to meet them."""
    ids = spool(authors.select("author_id").distinct(), "asked-authors")
    mine = ids.join(_all_wrote(edges), F.col("author_id") == F.col("coauthor_id")).select("author_id", "paper_id")
    return ids, spool(mine, "asked-papers")


def _shared_papers(mine: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_id, coauthor_id, paper_id``, each once."""
    return mine.join(_all_wrote(edges), "paper_id").where(F.col("coauthor_id") != F.col("author_id")).select("author_id", "coauthor_id", "paper_id")


def coauthors(authors: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_id, coauthor_id, papers``: others on the author's papers, and which.

    Two authors that are both asked for are met and grouped once, the smaller id first,
    and told of each other afterwards.
    """
    ids, mine = _asked_papers(authors, edges)
    both = ids.select(F.col("author_id").alias("coauthor_id"), F.lit(True).alias("both"))
    others = _all_wrote(edges).join(both, "coauthor_id", "left")
    met = mine.join(others, "paper_id").where((F.col("both").isNull() & (F.col("author_id") != F.col("coauthor_id"))) | (F.col("author_id") < F.col("coauthor_id")))
    found = met.groupBy("author_id", "coauthor_id").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"), F.max("both").alias("both"))
    one, other = (F.struct(F.col(a).alias("author_id"), F.col(b).alias("coauthor_id")) for a, b in (("author_id", "coauthor_id"), ("coauthor_id", "author_id")))
    return found.select(F.explode(F.when(F.col("both"), F.array(one, other)).otherwise(F.array(one))).alias("p"), "papers").select("p.*", "papers")


def coauthor_paths(authors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``author_id, coauthor_id, name, paper_id, path``: the two hops to each coauthor
    by each paper; ``name`` is the coauthor's, or the id where it has none."""
    names = nodes.where("kind = 'author'").select(F.col("id").alias("coauthor_id"), F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"))
    ends = [step("author", F.col("author_id")), F.lit(WROTE), step("paper", F.col("paper_id")), F.lit(WROTE), step("author", F.col("coauthor_id"))]
    return _shared_papers(_asked_papers(authors, edges)[1], edges).join(names, "coauthor_id").select("author_id", "coauthor_id", "name", "paper_id", path(*ends).alias("path"))


def coauthor_papers(authors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Two more hops: the papers that an author's coauthors wrote without the author."""
    _, mine = _asked_papers(authors, edges)
    others = spool(_shared_papers(mine, edges).select("author_id", "coauthor_id").distinct(), "coauthors")
    return (
        others.join(_all_wrote(edges), "coauthor_id").join(mine, ["author_id", "paper_id"], "left_anti")
        .join(_papers(nodes), "paper_id").select("author_id", "coauthor_id", "paper_id", "title", "year")
    )


# --- ranking by signals ---------------------------------------------------------


def rank_by_signals(entities: DataFrame, nodes: DataFrame, edges: DataFrame, parts: Parts | None = None) -> DataFrame:
    """``query_id, doc_id, score, year`` for questions' entities.

    ``entities``: ``query_id, author_name, topic, method, year_min``.  Points add up
    over signals, and over authors and methods of a like name: an author's paper,
    a criticised or proposed method, a topic that names a method or a title.  Every
    signal is gated by year.  A question with a year alone gets all papers from it on.
    With ``parts`` authors' papers are found by ``papers_by``, and ``edges`` may lack them.
    A question's year goes along with its signals, so that nothing gathers by question.
    """
    papers = _papers(nodes)

    def asked(column: str, kept: Column) -> DataFrame:
        return entities.where(F.col(column).isNotNull() & kept).select("query_id", "year_min", F.col(column).alias("query"))

    def met(wanted: DataFrame, kind: str) -> DataFrame:
        """Like nodes of all names asked for, matched at once and written once."""
        return spool(wanted.join(match_names(wanted, labels(nodes, kind)), "query").drop("score", "seq"), "met")

    by = met(asked("author_name", F.lit(True)), "author")
    if parts is None:
        wrote = _hop(edges, WROTE, "author", "paper").select(F.col("src_id").alias("id"), F.col("dst_id").alias("paper_id"))
        authors = by.join(wrote, "id").select("query_id", "year_min", "paper_id", F.lit(AUTHOR_POINTS).alias("points"))
    else:
        bounds = asked("author_name", F.lit(True)).select("query_id", "year_min").distinct()
        authors = papers_by(parts, by.select("query_id", "id")).join(F.broadcast(bounds), "query_id").select("query_id", "year_min", "paper_id", (AUTHOR_POINTS * F.col("times")).alias("points"))
    topics = spool(asked("topic", F.col("method").isNull() | (F.lower("topic") != F.lower("method"))), "topics")
    wanted = asked("method", F.lit(True)).withColumn("as", F.lit("method")).unionByName(topics.withColumn("as", F.lit("topic")))
    about = edges.where(F.col("relation").isin(CRITICISES, PROPOSES) & (F.col("src_kind") == "paper") & (F.col("dst_kind") == "method"))
    worth = F.when(F.col("as") == "topic", TOPIC_METHOD_POINTS).when(F.col("relation") == CRITICISES, CRITICISES_POINTS).otherwise(PROPOSES_POINTS)
    methods = met(wanted, "method").join(about, F.col("id") == F.col("dst_id")).select("query_id", "year_min", F.col("src_id").alias("paper_id"), worth.alias("points"))
    titles = like_titles(topics.select("query"), papers.select(F.col("title").alias("label")), TITLE_MIN).select("query", F.col("label").alias("title"))
    titled = topics.join(spool(titles, "titles-met"), "query").join(papers, "title").select("query_id", "year_min", "paper_id", F.lit(TOPIC_TITLE_POINTS).alias("points"))
    gated = reduce(DataFrame.unionByName, [authors, methods, titled]).join(papers, "paper_id").where(year_ok(F.col("year"), F.col("year_min")))
    by_year = entities.where("author_name is null and method is null and topic is null and year_min is not null").select("query_id", "year_min")
    fallback = meet(papers, by_year, "query_id").where("year >= year_min").select("query_id", "paper_id", "year", F.lit(YEAR_POINTS).alias("points"))
    every = gated.select("query_id", "paper_id", "year", "points").unionByName(fallback)
    return every.groupBy("query_id", F.col("paper_id").alias("doc_id")).agg(F.sum("points").cast("bigint").alias("score"), F.max("year").alias("year"))


def not_found_notes(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, note`` for asked authors and methods that no node is like."""
    out = []
    for column, kind in (("author_name", "author"), ("method", "method")):
        wanted = entities.where(F.col(column).isNotNull()).select("query_id", F.col(column).alias("query"))
        missed = wanted.join(match_names(wanted, labels(nodes, kind)).select("query").distinct(), "query", "left_anti")
        out.append(missed.select("query_id", F.concat(F.lit(f"{kind} not found: "), "query").alias("note")))
    return out[0].unionByName(out[1])
