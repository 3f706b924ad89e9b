"""Entity resolution: names on papers to canonical authors.

``names``: ``query_name, arxiv_id, seq`` (a row for each paper that a name stands on).
``candidates``: ``query_name, pos, author_id, display_name, institution, works,
score, top_5_works``.  ``authorships``: ``arxiv_id, pos, author_id, display_name,
raw_author_name, institution``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.config import (
    CONFIDENCE_MIN, HOMONYM_GAP, HOMONYM_MIN, INSTITUTION_BONUS, INSTITUTION_MIN, JOINT_FLOOR, SAME_PAPER_FLOOR, TITLE_FLOOR, TITLE_MIN,
)
from lorequarry.functions.text import aliases_of, clean_text, institution_score, name_key, name_score, short_id, title_score
from lorequarry.operators.ranking import first_per_key, top_per_group
from lorequarry.scratch import spool


#: Resolved co-listed names that are probed for joint works, candidates of a name, and works of a candidate.
PEERS_PROBED, CANDIDATES_A_NAME, TOP_WORKS = 2, 5, 5


def unique_names(mentions: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """``name_key, name, seq``: the first spelling of each name, trimmed, with the
    order in which it was first seen."""
    keyed = mentions.withColumn("name_key", name_key(F.col(name))).where("name_key <> ''")
    firsts = keyed.groupBy("name_key").agg(F.min(F.struct(F.col(seq).alias("seq"), F.trim(F.col(name)).alias("name"))).alias("f"))
    return firsts.select("name_key", "f.name", "f.seq")


def homonyms(candidates: DataFrame) -> DataFrame:
    """Names whose two best candidates both score at least ``HOMONYM_MIN``."""
    likely = candidates.where(F.col("score") >= HOMONYM_MIN).groupBy("query_name").agg(F.count("*").alias("n"))
    return likely.where("n >= 2").select("query_name")


def order_candidates(candidates: DataFrame) -> DataFrame:
    """``pos`` by score, then works; ties as they came."""
    over = Window.partitionBy("query_name").orderBy(F.col("score").desc(), F.col("works").desc(), F.col("pos"))
    return candidates.withColumn("pos", F.row_number().over(over) - 1)


def first_candidates(found: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates of names from a search (``query_name, pos, author_id, display_name,
    institution, works, score``): the first ``CANDIDATES_A_NAME`` that it returned,
    with the titles of their most cited works (``author_id, title, cited_by``), in
    order.  A blank id is no candidate, but takes its place in the search; a blank
    title is no work; equal citations go by title."""
    kept = top_per_group(found, ["query_name"], [F.col("pos")], CANDIDATES_A_NAME, "_nth").drop("_nth").where("coalesce(author_id, '') <> ''")
    titled = works.where("coalesce(title, '') <> ''")
    cited = top_per_group(titled, ["author_id"], [F.col("cited_by").desc_nulls_last(), F.col("title")], TOP_WORKS)
    listed = cited.groupBy("author_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t"))
    top = listed.select("author_id", F.col("t.title").alias("top_5_works"))
    with_works = kept.join(top, "author_id", "left").withColumn("top_5_works", F.coalesce("top_5_works", F.array().cast("array<string>")))
    return order_candidates(with_works)


def institution_of(last_known: Column, legacy: Column, affiliations: Column) -> Column:
    """The first named last-known institution, else the legacy one, else the named
    affiliation of the latest year (the last among equals; no year counts as -1)."""
    named = F.filter(last_known, lambda x: F.coalesce(x["display_name"], F.lit("")) != "")
    none = F.struct(F.lit(-2).alias("year"), F.lit(None).cast("string").alias("name"))

    def later(best: Column, a: Column) -> Column:
        year, name = F.coalesce(F.array_max(a["years"]), F.lit(-1)), a["institution"]["display_name"]
        usable = (F.coalesce(name, F.lit("")) != "") & (year >= best["year"])
        return F.when(usable, F.struct(year.alias("year"), name.alias("name"))).otherwise(best)

    return F.coalesce(F.get(named, F.lit(0))["display_name"], F.nullif(legacy, F.lit("")), F.aggregate(affiliations, none, later)["name"])


def parse_authorships(works: DataFrame) -> DataFrame:
    """``arxiv_id, pos, author_id, display_name, raw_author_name, institution`` from
    ``arxiv_id, authorships``; authors without a canonical id are left out."""
    rows = works.select("arxiv_id", F.posexplode("authorships").alias("pos", "a"))
    named = F.filter(F.col("a.institutions"), lambda i: F.coalesce(i["display_name"], F.lit("")) != "")
    return rows.select(
        "arxiv_id", "pos", short_id(F.col("a.author.id")).alias("author_id"), F.col("a.author.display_name").alias("display_name"),
        F.col("a.raw_author_name").alias("raw_author_name"), F.coalesce(F.get(named, F.lit(0))["display_name"], F.lit("")).alias("institution"),
    ).where(F.col("author_id").startswith("A"))


def match_paper(papers: DataFrame, works: DataFrame) -> DataFrame:
    """``arxiv_id, work_id``: the work of the same DOI, else the one found by title
    whose title is most alike, at least ``TITLE_MIN``; the first among equals.

    ``papers``: ``arxiv_id, title, doi``; ``works``: ``work_id, doi, title,
    searched_for`` (the paper whose title search found it), ``pos``.
    """
    by_doi = papers.join(works.where("doi is not null").select("doi", "work_id", "pos"), "doi")
    direct = first_per_key(by_doi, ["arxiv_id"], [F.col("pos"), F.col("work_id")]).select("arxiv_id", "work_id")
    rest = papers.join(direct, "arxiv_id", "left_anti").alias("p")
    found = rest.join(works.alias("w"), F.col("p.arxiv_id") == F.col("w.searched_for")).select(
        "p.arxiv_id", "w.work_id", "w.pos", title_score(F.col("p.title"), F.col("w.title")).alias("score")
    )
    best = first_per_key(found.where(F.col("score") >= TITLE_MIN), ["arxiv_id"], [F.col("score").desc(), F.col("pos")])
    return direct.unionByName(best.select("arxiv_id", "work_id"))


def byline_matches(names: DataFrame, authorships: DataFrame) -> DataFrame:
    """The byline of a name's papers that is most like the name, at least
    ``CONFIDENCE_MIN``; a pool entry that comes before all candidates."""
    met = names.join(authorships, "arxiv_id")
    alike = F.greatest(name_score(F.col("query_name"), F.col("display_name")), name_score(F.col("query_name"), F.col("raw_author_name")))
    scored = met.withColumn("score", alike).where(F.col("score") >= CONFIDENCE_MIN)
    best = first_per_key(scored, ["query_name"], [F.col("score").desc(), F.col("seq"), F.col("pos")])
    return best.select(
        "query_name", F.lit(-1).alias("pos"), "author_id", "display_name", "institution", F.lit(0).alias("works"), "score",
        F.array().cast("array<string>").alias("top_5_works"),
    )


def candidate_pool(names: DataFrame, candidates: DataFrame, authorships: DataFrame) -> DataFrame:
    """Byline matches, then candidates; each author once for a name, blank ids not."""
    pool = byline_matches(names, authorships).unionByName(candidates.select("query_name", "pos", "author_id", "display_name", "institution", "works", "score", "top_5_works"))
    return first_per_key(pool.where(F.coalesce("author_id", F.lit("")) != ""), ["query_name", "author_id"], [F.col("pos")])


def confidence(base: Column, same_paper: Column, title: Column, joint: Column, institution: Column) -> Column:
    """Name score raised to the floor of each kind of evidence; agreement of the
    institution adds to that, up to 1."""
    raised = F.greatest(
        base, F.when(same_paper, SAME_PAPER_FLOOR), F.when(title, TITLE_FLOOR), F.when(joint, JOINT_FLOOR)
    )
    return F.when(institution, F.least(F.lit(1.0), raised + INSTITUTION_BONUS)).otherwise(raised)


def is_ambiguous(conf: Column, hard: Column, second: Column) -> Column:
    close = (second >= CONFIDENCE_MIN) & (conf - second < HOMONYM_GAP)
    return F.when(conf < CONFIDENCE_MIN, True).when(hard, False).otherwise(F.coalesce(close, F.lit(False)))


def score_pool(names: DataFrame, pool: DataFrame, candidates: DataFrame, authorships: DataFrame, titles: DataFrame) -> DataFrame:
    """``pool`` with evidence, ``confidence`` and ``hard``.

    ``titles``: ``arxiv_id, title``.  Evidence: on the byline of one of the name's
    papers; a top work titled like one of them; a top work shared with a co-listed
    name's first two candidates; an institution like one on the papers or of the first
    candidates of co-listed names.
    """
    key = ["query_name", "author_id"]
    mine = names.select("query_name", "arxiv_id").distinct()
    on_paper = mine.join(authorships.select("arxiv_id", "author_id").distinct(), "arxiv_id").select(*key).distinct().withColumn("same_paper", F.lit(True))
    own_works = pool.select(*key, F.explode("top_5_works").alias("work"))
    titled = (
        own_works.join(mine.join(titles, "arxiv_id").select("query_name", "title"), "query_name")
        .where(title_score(F.col("work"), F.col("title")) >= TITLE_MIN).select(*key).distinct().withColumn("title_overlap", F.lit(True))
    )
    peers = mine.alias("a").join(mine.alias("b"), "arxiv_id").where("a.query_name <> b.query_name").select(F.col("a.query_name").alias("query_name"), F.col("b.query_name").alias("peer")).distinct()
    peer_firsts = peers.join(candidates.where("pos < 2").select(F.col("query_name").alias("peer"), F.col("author_id").alias("peer_id"), "pos", F.col("institution").alias("peer_place"), F.col("top_5_works").alias("peer_works")), "peer")
    peer_titles = peer_firsts.select("query_name", F.explode("peer_works").alias("w")).select("query_name", name_key(F.col("w")).alias("work_key")).where("work_key <> ''").distinct()
    shared = own_works.withColumn("work_key", name_key(F.col("work"))).join(peer_titles, ["query_name", "work_key"]).select(*key).distinct()
    places = mine.join(authorships, "arxiv_id").select("query_name", "institution").unionByName(peer_firsts.where("pos = 0").select("query_name", F.col("peer_place").alias("institution")))
    places = places.where(F.coalesce("institution", F.lit("")) != "").distinct().withColumnRenamed("institution", "place")
    agreed = (
        pool.join(places, "query_name").where(institution_score(F.col("institution"), F.col("place")) >= INSTITUTION_MIN)
        .select(*key).distinct().withColumn("institution_agree", F.lit(True))
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    joined = pool
    for side in (on_paper, titled, shared.withColumn("joint", F.lit(True)), agreed):
        joined = joined.join(side, key, "left")
    scored = joined.select(
        pool["*"], *(flag(F.col(c)).alias(c) for c in ("same_paper", "title_overlap", "joint", "institution_agree")),
        name_score(F.col("query_name"), F.col("display_name")).alias("name_score"),
    )
    return with_confidence(scored)


def with_confidence(scored: DataFrame) -> DataFrame:
    """``confidence``, ``hard`` and ``evidence`` by a row's name score and evidence."""
    evidence = F.array_compact(
        F.array(
            F.concat(F.lit("name:"), F.format_string("%.4f", "name_score")),
            *(F.when(F.col(c), F.lit(c)) for c in ("same_paper", "title_overlap")),
            F.when(F.col("joint"), F.lit("coauthor")),
            F.when(F.col("institution_agree"), F.lit("institution")),
        )
    )
    return scored.withColumns(
        {
            "confidence": confidence(F.col("name_score"), F.col("same_paper"), F.col("title_overlap"), F.col("joint"), F.col("institution_agree")),
            "hard": F.col("same_paper") | F.col("title_overlap") | F.col("joint"),
            "evidence": evidence,
        }
    )


def judge(scored: DataFrame, names: DataFrame) -> DataFrame:
    """The best of each name's pool, and if it is ``ambiguous`` (null: an empty pool)."""
    order = [F.col("hard").desc(), F.col("confidence").desc(), F.col("institution_agree").desc(), F.col("pos")]
    over = Window.partitionBy("query_name").orderBy(*order)
    ranked = scored.withColumn("nth", F.row_number().over(over)).withColumn("second", F.lead("confidence").over(over)).where("nth = 1")
    return names.select("query_name").distinct().join(ranked, "query_name", "left").select(
        "*", F.when(F.col("author_id").isNotNull(), is_ambiguous(F.col("confidence"), F.col("hard"), F.col("second"))).alias("ambiguous")
    )


def decide(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapping (``query_name, author_id, confidence, institution, aliases``) and
    what stays unresolved, with the reason and evidence."""
    record = ["query_name", "author_id", "confidence", "institution", aliases_of(F.col("query_name"), F.col("display_name")).alias("aliases")]
    reason = (
        F.when(F.col("author_id").isNull(), F.lit("no_candidates"))
        .when(F.col("confidence") < CONFIDENCE_MIN, F.lit(f"confidence < {CONFIDENCE_MIN}"))
        .otherwise(F.lit("homonym_no_paper_evidence"))
    )
    mapping = judged.where("not ambiguous").select(*record)
    rest = judged.where("ambiguous or author_id is null").select(*record, reason.alias("reason"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    return mapping, rest


def judge_in_order(names: DataFrame, scored: DataFrame, joint_pairs: DataFrame) -> DataFrame:
    """``judge`` with known joint works (``a < b``), as if names were judged one by one
    in the order in which they are first seen.

    A candidate that is on none of the name's papers, and has no other joint work, is
    looked up with the authors of the first ``PEERS_PROBED`` mentions beside the name
    whose names come earlier and are resolved by then.  Only a name that has a candidate
    with a known joint work with a candidate of such a peer can be judged otherwise
    for it; all others are judged at once.  Those are judged in rounds, each name once no
    earlier name beside it waits; rounds are as many as the longest chain of them.
    """
    order = names.groupBy("query_name").agg(F.min(F.struct("seq", "query_name")).alias("first"))
    mentions = names.select("query_name", "arxiv_id").distinct().join(names.select(F.col("query_name").alias("peer"), "arxiv_id", F.col("seq").alias("at")), "arxiv_id")
    beside = mentions.where("peer <> query_name").join(order, "query_name").join(order.select(F.col("query_name").alias("peer"), F.col("first").alias("peer_first")), "peer")
    earlier = beside.where("peer_first < first").select("query_name", "peer", "at")
    open_pairs = scored.where("not same_paper and not joint").select("query_name", "author_id")
    both_ways = joint_pairs.select(F.col("a").alias("author_id"), F.col("b").alias("peer_id")).union(joint_pairs.select("b", "a")).distinct()
    linked = open_pairs.join(both_ways, "author_id").join(scored.select(F.col("query_name").alias("peer"), F.col("author_id").alias("peer_id")), "peer_id")
    waiting = spool(linked.join(earlier, ["query_name", "peer"], "left_semi").select("query_name").distinct(), "waiting")
    beside_waiting = spool(earlier.join(waiting, "query_name", "left_semi"), "beside")
    probes = spool(open_pairs.join(waiting, "query_name", "left_semi").join(both_ways, "author_id"), "probes")
    at_once = names.join(waiting, "query_name", "left_anti")
    done = [spool(judge(scored.join(waiting, "query_name", "left_anti"), at_once), "judged")]
    while not waiting.isEmpty():
        held_up = beside_waiting.join(waiting.select(F.col("query_name").alias("peer")), "peer").select("query_name").distinct()
        ready = spool(waiting.join(held_up, "query_name", "left_anti"), "ready")
        resolved = reduce(DataFrame.unionByName, done).where("not ambiguous").select(F.col("query_name").alias("peer"), F.col("author_id").alias("peer_id"))
        seen = beside_waiting.join(ready, "query_name", "left_semi").join(resolved, "peer")
        probed = top_per_group(seen, ["query_name"], [F.col("at"), F.col("peer")], PEERS_PROBED).select("query_name", "peer_id").distinct()
        found = probes.join(probed, ["query_name", "peer_id"], "left_semi").select("query_name", "author_id", F.lit(True).alias("probed")).distinct()
        pool = scored.join(ready, "query_name", "left_semi").join(found, ["query_name", "author_id"], "left")
        raised = with_confidence(pool.withColumn("joint", F.col("joint") | F.coalesce("probed", F.lit(False))).drop("probed"))
        done.append(spool(judge(raised, ready), "judged"))
        waiting = spool(waiting.join(ready, "query_name", "left_anti"), "waiting")
    return reduce(DataFrame.unionByName, done)


def resolve(names: DataFrame, candidates: DataFrame, authorships: DataFrame, titles: DataFrame, joint_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names to authors.  With ``joint_pairs`` names are judged in the order in which
    they are first seen, in parallel as far as that allows; see ``judge_in_order``."""
    cleaned = names.withColumn("query_name", clean_text(F.col("query_name")))
    ordered = order_candidates(candidates)
    # Both are read several times, and their scores are dear: each is written once.
    pool = spool(candidate_pool(cleaned, ordered, authorships), "pool")
    scored = spool(score_pool(cleaned, pool, ordered, authorships, titles), "scored")
    return decide(judge(scored, cleaned) if joint_pairs is None else judge_in_order(cleaned, scored, joint_pairs))
