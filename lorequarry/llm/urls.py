"""URL filtering by host rules and mined association rules.

Hosts with a stated rule are judged by it.  The rest are judged by association
rules: FP-growth mines combinations of URL tokens from labelled pages, rules that
lead to the label ``bad`` are pruned by support and confidence to the smallest that
are sure, and an inverted index from one token of each finds those that a URL may satisfy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.arrow import pick
from lorequarry.scratch import spool

MIN_CONFIDENCE = 0.8
#: Bad labelled rows that must bear a rule, however many rows there are.
MIN_COUNT = 5


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host, its subdomains, and paths with a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where there is no ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _rule_struct(rules: tuple[HostRule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels and their parts at hyphens, path
    segments, parameter names, and scheme, each marked by where it stands."""
    host, path = split_url(url)
    tail = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    segments = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    params = F.filter(F.split(tail, "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("w:"), x)),
            F.transform(segments, lambda x: F.concat(F.lit("p:"), x)),
            F.transform(params, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
        )
    )


def _token_kinds(numbered: DataFrame, min_count: int) -> DataFrame:
    """``token, both, freq, kind`` of the tokens in at least ``min_count`` bad baskets.

    Tokens that stand in the same baskets are of one kind, called by the smallest: a
    repeated URL of any number of parameters is a basket of one item.
    """
    said = numbered.select("basket", "bad", F.explode("tokens").alias("token"))
    counts = said.groupBy("token").agg(
        F.count_if("bad").alias("both"), F.count("*").alias("freq"), F.sum(F.xxhash64("basket").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "basket")).alias("xor")
    )
    able = counts.where(F.col("both") >= min_count)
    return spool(able.withColumn("kind", F.min("token").over(Window.partitionBy("both", "freq", "sum", "xor"))).drop("sum", "xor"), "url-kinds")


def _recounted(found: DataFrame, held: DataFrame) -> DataFrame:
    """``antecedent, both, freq`` of mined sets, counted over all baskets, whole: each
    set is looked up under the rarest of its kinds."""
    common = held.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("baskets"))
    parts = found.select("antecedent", F.explode("antecedent").alias("kind")).join(common.hint("merge"), "kind")
    index = parts.groupBy("antecedent").agg(F.min_by("kind", F.struct("baskets", "kind")).alias("kind"))
    met = held.select("bad", "kinds", F.explode("kinds").alias("kind")).join(index.hint("merge"), "kind")
    return met.where(F.size(F.array_except("antecedent", "kinds")) == 0).groupBy("antecedent").agg(F.count_if("bad").alias("both"), F.count("*").alias("freq"))


def mine_rules(
    labelled: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
    widest: int | None = None,
) -> DataFrame:
    """``antecedent``, ``confidence``, ``support``, ``alternatives`` of rules that end in ``bad``.

    ``labelled`` has ``url`` and ``bad`` (boolean); each row is a basket, so a URL that
    is labelled twice counts twice; rows of null URL or label are left out.  Of rules
    that are sure enough only the smallest are kept, as they fire whenever a larger one
    does.  ``alternatives`` has for each token of a rule those that stood in the same
    baskets, any of which will do.  No bad rows give no rules.

    Only bad baskets are mined, whole, and what is found is counted over all baskets, so
    that no rule is missed and confidences are exact.  Tokens of the same baskets are one
    item, and a token that is sure alone is in no larger set.  There are as many sets
    as five bad baskets share kinds of tokens: URLs that share many of them, none
    sure alone, cost in proportion to 2 to the power of those.  A caller may set ``widest`` to
    bound that: a basket of more kinds is then mined by those that are bad most often.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double, alternatives array<array<string>>")
    numbered = spool(
        labelled.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("basket"), "bad", tokens(F.col("url")).alias("tokens")).where("size(tokens) > 0"),
        "url-baskets",
    )
    n, bad = numbered.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return none
    kinds = _token_kinds(numbered, min_count)
    sure = F.col("both") / F.col("freq") >= min_confidence
    alone = kinds.where(sure).select(
        F.array("token").alias("antecedent"), (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / n).alias("support"), F.array(F.array("token")).alias("alternatives")
    )
    left = kinds.where(~sure).select("token", "kind", (-F.col("both") / F.col("freq")).alias("good"), (-F.col("both")).alias("rare"))
    held = spool(
        numbered.select("basket", "bad", F.explode("tokens").alias("token")).join(left.where("token = kind").hint("merge"), "token")
        .groupBy("basket", "bad").agg(F.array_sort(F.collect_list(F.struct("good", "rare", "kind"))).alias("ranked"))
        .select("bad", F.transform("ranked", lambda x: x["kind"]).alias("kinds")),
        "url-able",
    )
    rows = held.where("bad").count()
    if not rows:
        return alone
    kinds_of = F.col("kinds") if widest is None else F.slice("kinds", 1, widest)
    items = held.where("bad").select(kinds_of.alias("items"))
    # FP-growth rounds the bar up to a count; half a row less keeps it at ``min_count``.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_count - 0.5) / rows), minConfidence=min_confidence).fit(items)
    sets = spool(model.freqItemsets.select(F.array_sort("items").alias("antecedent")), "url-itemsets")
    rules = spool(
        _recounted(sets, held).select("antecedent", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / n).alias("support"))
        .where(F.col("confidence") >= min_confidence),
        "url-rules",
    )
    least = _smallest(rules)
    members = left.groupBy("kind").agg(F.array_sort(F.collect_list("token")).alias("members"))
    named = least.select("antecedent", "confidence", "support", F.explode("antecedent").alias("kind")).join(members.hint("merge"), "kind")
    alternatives = F.array_sort(F.collect_list("members")).alias("alternatives")
    return alone.unionByName(named.groupBy("antecedent", "confidence", "support").agg(alternatives))


def _smallest(rules: DataFrame) -> DataFrame:
    """The rules that hold no smaller one: those of the least size stay, all that hold one
    of them go, and so on with what is left."""
    found, size = [], F.size("antecedent")
    while (k := rules.agg(F.min(size)).first()[0]) is not None:
        found.append(rules.where(size == k))
        firsts = found[-1].select(F.get("antecedent", F.lit(0)).alias("kind"), F.col("antecedent").alias("sub"))
        later = rules.where(size > k)
        met = later.select("antecedent", F.explode("antecedent").alias("kind")).join(firsts.hint("merge"), "kind")
        covered = met.where(F.size(F.array_except("sub", "antecedent")) == 0).select("antecedent").distinct()
        rules = spool(later.join(covered.hint("merge"), "antecedent", "left_anti"), "url-rules-left")
    return reduce(DataFrame.unionByName, found) if found else rules


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and ``confidence`` of the surest rule, for distinct ``urls`` that meet one.

    The index holds each rule under the alternatives to the one of its tokens that the
    fewest URLs have; a URL looks up each of its tokens and tests the rules found
    there.  Null URLs meet none, a URL that repeats comes once, and without rules or URLs none
    comes.  No side is bounded, so none is broadcast.
    """
    tokened = urls.select("url", tokens(F.col("url")).alias("tokens"))
    common = tokened.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    placed = rules.select("antecedent", F.posexplode("alternatives").alias("at", "members")).select("antecedent", "at", F.explode("members").alias("token"))
    # A rule with a token that no URL has is not met: it is left under one that some have.
    found = placed.join(common.hint("merge"), "token").groupBy("antecedent", "at").agg(F.sum("urls").alias("urls"))
    rarest = found.groupBy("antecedent").agg(F.min_by("at", F.struct("urls", "at")).alias("at"))
    index = rules.join(rarest.hint("merge"), "antecedent").select("antecedent", "alternatives", "confidence", F.explode(F.get("alternatives", F.col("at"))).alias("token"))
    return (
        tokened.select("url", "tokens", F.explode("tokens").alias("token"))
        .join(index.hint("merge"), "token")
        .where(F.forall("alternatives", lambda some: F.arrays_overlap(some, F.col("tokens"))))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for each row of ``pages``.

    ``labels`` marks pages by ``doc_id``, equal to ``page_id``: a page is bad if its
    ``quality`` is 0 or it is ``toxic``; null marks say neither, a page that is
    labelled twice is two baskets, and null ids label nothing.  A null url, or one without ``://``, has an
    empty host and path, meets no rule, and is allowed.  Repeated rows stay; an
    empty table gives an empty one; other columns are ignored.
    """
    rows = pick(pages, "page_id", "url")
    marks = labels.select(
        F.col("doc_id").alias("page_id"),
        (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    )
    mined = mine_rules(rows.join(marks.hint("merge"), "page_id"))
    host, path = split_url(F.col("url"))
    judged = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("stated", _rule_struct(rules, F.col("host"), F.col("path")))
    judged = judged.withColumn("asked", F.col("stated").isNull() & F.col("url").isNotNull())
    asked = judged.where("asked")
    hits = match_rules(asked.select("url").distinct(), mined)
    # Rows that ask nothing, null URLs among them, go round the join.
    met = asked.join(hits.hint("merge"), "url", "left").unionByName(judged.where("not asked").withColumn("confidence", F.lit(None).cast("double")))
    return met.select(
        "page_id",
        "host",
        "path",
        F.col("stated.rule").alias("rule"),
        F.coalesce("stated.verdict", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("stated").isNull(), F.col("confidence")).alias("confidence"),
    )
