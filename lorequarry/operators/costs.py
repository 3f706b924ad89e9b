"""Token and cost accounting of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lorequarry.config import CHAT_MODEL, PRICES
from lorequarry.functions.text import format_money


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))


def usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at the model's price; an unknown model costs what the chat model does."""
    prices = F.create_map(*(x for m, (a, b) in PRICES.items() for x in (F.lit(m), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))))
    known = F.when(model.isin(*PRICES), model).otherwise(F.lit(CHAT_MODEL))
    price = F.element_at(prices, known)
    return (tokens_in * price["i"] + tokens_out * price["o"]) / 1e6


def log_rows(calls: DataFrame) -> DataFrame:
    """Calls (``stage, model, input_tokens, output_tokens, cache_hit``) as log rows:
    a hit costs nothing; costs at eight places; with the time in UTC."""
    cost = F.when(F.col("cache_hit"), F.lit(0.0)).otherwise(F.round(usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens")), 8))
    return calls.select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), "*", cost.alias("cost"))


def aggregate(log: DataFrame) -> DataFrame:
    """By stage and in total (``is_total``): calls, tokens, cost, cost had nothing been
    cached, hits, misses, hit ratio in percent, savings.  Counts are of log lines."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit(CHAT_MODEL))
    hit = F.coalesce(F.col("cache_hit"), F.lit(False))
    rows = log.select(
        F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")).alias("stage"),
        _number("input_tokens").alias("i"), _number("output_tokens").alias("o"), _number("cost").alias("cost"), model.alias("model"), hit.alias("hit"),
    )
    full = usd(F.col("model"), F.col("i").cast("bigint"), F.col("o").cast("bigint"))
    out = rows.rollup("stage").agg(
        F.grouping("stage").cast("int").alias("is_total"),
        F.count("*").alias("calls"),
        F.sum(F.col("i") + F.col("o")).cast("bigint").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum(full).alias("cost_no_cache"),
        F.count_if(F.col("hit")).alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
    )
    return out.select(
        "*",
        F.coalesce(100.0 * F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), F.lit(0.0)).alias("hit_ratio"),
        (F.col("cost_no_cache") - F.col("cost")).alias("savings"),
    )


def savings(llm_log: DataFrame, embed_log: DataFrame) -> DataFrame:
    """``kind, cost, cost_no_cache, savings`` of each log and of both (``total``)."""
    totals = [aggregate(log).where("is_total = 1").select(F.lit(kind).alias("kind"), "cost", "cost_no_cache") for kind, log in (("language model", llm_log), ("embedding", embed_log))]
    rows = totals[0].unionByName(totals[1]).rollup("kind").agg(F.sum("cost").alias("cost"), F.sum("cost_no_cache").alias("cost_no_cache"))
    return rows.select(F.coalesce("kind", F.lit("total")).alias("kind"), "cost", "cost_no_cache", (F.col("cost_no_cache") - F.col("cost")).alias("savings"))


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """``status, n``: how many rows of a stage ended in each state."""
    return rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def report(llm_log: DataFrame, embed_log: DataFrame) -> str:
    """Markdown of both aggregates: a row for each stage, not for each call."""
    lines = ["# Cost report", ""]
    for title, log in (("Language model", llm_log), ("Embedding", embed_log)):
        table = aggregate(log).select(
            F.when(F.col("is_total") == 1, "**total**").otherwise(F.col("stage")).alias("s"), "calls", "tokens", format_money(F.col("cost")).alias("c"),
            format_money(F.col("cost_no_cache")).alias("n"), format_money(F.col("savings")).alias("v"), F.round("hit_ratio", 1).alias("h"), "is_total",
        )
        lines += [f"## {title}", "", "| stage | calls | tokens | cost | without cache | saved | hits % |", "|---|---|---|---|---|---|---|"]
        lines += [f"| {r.s} | {r.calls} | {r.tokens} | {r.c} | {r.n} | {r.v} | {r.h} |" for r in table.orderBy("is_total", "s").collect()]
        lines.append("")
    return "\n".join(lines)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, price_in double, price_out double")


def observed_statuses(rows: DataFrame, statuses: tuple[str, ...], counted: Observation, status: str = "status") -> DataFrame:
    """``rows`` as they are; ``counted`` gets how many have each of some stated statuses,
    and ``other``, from the pass that reads them."""
    each = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    other = F.count_if(~F.coalesce(F.col(status).isin(*statuses), F.lit(False))).alias("other")
    return rows.observe(counted, *each, other)
