"""Golden records: of the records of one cluster, each field's best value.

Every record is unpivoted to long rows ``(cluster, field, priority, value)``, one
for each field that it can supply; one grouped minimum over all fields takes the
row that comes first, with partial minima in each task, so that a cluster of any
size sends a row a field and task; then fields become columns again.  A field that
hangs on another (the balance on the segment) is chosen after it.

Staleness needs the latest date of a record's cluster.  Clusters beyond a share
of all records, so many at most, are broadcast; the others are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.scratch import spool

#: Sources by falling trust; any other, or none, comes last.
TRUST = ("partner", "store", "web", "crm")
STALE_HOURS = 30 * 24
BLANKS = " \t\n\x0b\f\r"
#: A cluster of more than one in so many records is large; so there are fewer than these.
LARGE = 1024


@dataclass(frozen=True)
class Field:
    """A field of the record: its columns, which come from one source record.

    ``trusted`` orders sources by freshness and trust before recency; ``first``
    gives a long that goes before all that, smaller first; a ``whole`` field is
    supplied even if it is null, any other only by records that have it.
    """

    name: str
    columns: tuple[str, ...]
    trusted: bool = False
    first: Callable[[], Column] | None = None
    whole: bool = False


FIELDS = (
    Field("name", ("name",), trusted=True, first=lambda: -F.length("name")),
    Field("email", ("email",), trusted=True),
    Field("segment", ("segment",)),
    Field("address", ("city", "nation_id"), trusted=True, whole=True, first=lambda: -(F.col("city").isNotNull().cast("long") + F.col("nation_id").isNotNull().cast("long"))),
    Field("balance", ("balance",)),
)


def _cleaned(clients: DataFrame) -> DataFrame:
    """The columns in use, with the cluster; blank strings are null, others as they are."""
    kinds = {f.name: f.dataType for f in clients.schema.fields}

    def tidy(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.when(F.btrim(c, F.lit(BLANKS)) != "", c) if isinstance(kinds[name], T.StringType) else c).alias(name)

    columns = [c for f in FIELDS for c in f.columns]
    trust = F.lit(len(TRUST))
    for rank, source in reversed(list(enumerate(TRUST))):
        trust = F.when(F.col("`source`") == source, rank).otherwise(trust)
    return clients.select(
        F.coalesce("`master_id`", "`client_id`").alias("cluster_id"), F.col("`client_id`").alias("client_id"), trust.alias("trust"), F.col("`updated_at`").alias("updated_at"), *map(tidy, columns)
    )


def _age(latest: Column, at: Column, kind: T.DataType) -> tuple[Column, Column]:
    """How long before the latest a date is, and if that is over the limit.

    A timestamp without a zone gives an interval, free of any session zone; one
    with a zone is compared in microseconds, so days of 23 or 25 hours count as they are.
    """
    if isinstance(kind, T.TimestampNTZType):
        return latest - at, (latest - at) > F.expr(f"INTERVAL '{STALE_HOURS}' HOUR")
    micros = F.unix_micros(latest) - F.unix_micros(at)
    return micros, micros > STALE_HOURS * 3_600_000_000


def with_staleness(records: DataFrame, large: int = LARGE) -> DataFrame:
    """Records with ``n_records`` of their cluster, ``age``, ``undated`` and ``stale``."""
    kind = records.schema["updated_at"].dataType
    stats = spool(
        records.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.max("updated_at").alias("latest")).withColumnRenamed("cluster_id", "of"), "golden-clusters"
    )
    every = stats.agg(F.sum("n_records")).first()[0] or 0
    # Fewer than ``large`` clusters can hold more than one in ``large`` records each.
    big = F.broadcast(stats.where(F.col("n_records") * large > every))
    same = F.col("cluster_id").eqNullSafe(F.col("of"))
    rest = records.join(big.select("of"), same, "left_anti").join(stats, same)
    dated = records.join(big, same).unionByName(rest).drop("of")
    age, late = _age(F.col("latest"), F.col("updated_at"), kind)
    return dated.select(
        "*", age.alias("age"), F.col("updated_at").isNull().alias("undated"), F.coalesce(late, F.lit(True)).alias("stale")
    ).drop("latest", "updated_at")


def _priority(field: Field) -> Column:
    """Smaller comes first; of one form for all fields."""
    first = field.first() if field.first else F.lit(0)
    by_trust = (F.col("stale"), F.col("trust")) if field.trusted else (F.lit(False), F.lit(0))
    return F.struct(
        first.cast("long").alias("first"), by_trust[0].alias("stale"), by_trust[1].alias("trust_before"), F.col("undated").alias("undated"), F.col("age").alias("age"),
        F.col("trust").alias("trust"), F.col("client_id").isNull().alias("nameless"), F.col("client_id").alias("client_id"),
    )


def _entry(field: Field, slots: dict[str, T.DataType]) -> Column:
    value = F.struct(*((F.col(c) if c in field.columns else F.lit(None).cast(kind)).alias(c) for c, kind in slots.items()))
    supplied = F.lit(True) if field.whole else F.coalesce(*(F.col(c).isNotNull() for c in field.columns))
    return F.struct(F.lit(field.name).alias("field"), supplied.alias("supplied"), F.struct(_priority(field).alias("priority"), value.alias("value")).alias("best"))


def survivors(records: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """``cluster_id, n_records`` and, for each field, the struct ``<name>`` with its
    ``best.value``, ``best.priority`` and ``n_stale``, the stale records that supply it."""
    slots = {c: records.schema[c].dataType for f in fields for c in f.columns}
    unpivoted = records.select("cluster_id", "n_records", "stale", F.explode(F.array(*(_entry(f, slots) for f in fields))).alias("e"))
    rows = unpivoted.where("e.supplied").select("cluster_id", "n_records", "stale", "e.field", "e.best")
    chosen = rows.groupBy("cluster_id", "n_records", "field").agg(F.min("best").alias("best"), F.sum(F.col("stale").cast("long")).alias("n_stale"))
    return chosen.groupBy("cluster_id", "n_records").pivot("field", [f.name for f in fields]).agg(F.first(F.struct("best", "n_stale"), ignorenulls=True))


def golden_records(clients: DataFrame, large: int = LARGE) -> DataFrame:
    """One record for each cluster (``master_id``, else ``client_id``) of ``clients``.

    Blank strings are null; unknown and null sources are trusted least; a null date
    is stale and comes last; rows that repeat count each, and give what one would.
    Rows without either id are one cluster, of null id; of records that tie in all
    else one without an id comes last, then the smaller value.  A field that no
    record has is null, and so is where it came from.  An empty table gives an empty
    one; other columns are ignored.
    """
    records = with_staleness(_cleaned(clients), large)
    wide = survivors(records, FIELDS)
    # The balance of the segment that won; where that has none, of any record.
    recent = F.struct(_priority(Field("balance", ("balance",))).alias("priority"), "balance")
    own = records.where("segment is not null and balance is not null").groupBy("cluster_id", "segment").agg(F.min(recent).alias("own"))
    own = own.toDF("of", "of_segment", "own")
    one = wide.select("*", F.col("segment.best.value.segment").alias("won"))
    joined = one.join(own, one["cluster_id"].eqNullSafe(own["of"]) & (one["won"] == own["of_segment"]), "left")
    value = lambda field, column=None: F.col(f"{field}.best.value.{column or field}")
    supplier = lambda field: F.col(f"{field}.best.priority.client_id").alias(f"{field}_from")
    in_segment = F.col("own").isNotNull()
    balance = F.when(in_segment, F.col("own.balance")).otherwise(value("balance"))
    addressed = value("address", "city").isNotNull() | value("address", "nation_id").isNotNull()
    return joined.select(
        "cluster_id", "n_records", F.col("address.n_stale").alias("n_stale"), value("name").alias("name"), value("email").alias("email"), F.col("won").alias("segment"),
        value("address", "city").alias("city"), value("address", "nation_id").alias("nation_id"), F.floor(100 * balance + 0.5).cast("long").alias("balance_cents"),
        supplier("name"), supplier("email"), supplier("segment"),
        F.when(in_segment, F.col("own.priority.client_id")).otherwise(F.col("balance.best.priority.client_id")).alias("balance_from"),
        F.when(addressed, F.col("address.best.priority.client_id")).alias("address_from"),
    )


def _golden_sql() -> str:
    blank = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    tidy = ", ".join(f"CASE WHEN trim({c}, {blank}) <> '' THEN {c} END AS {c}" for c in ("name", "email", "city", "segment"))
    trust = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(TRUST))
    recent = "r.updated_at DESC NULLS LAST, r.trust, r.client_id"
    trusted = f"r.stale, r.trust, {recent}"
    orders = {
        "name": f"length(r.name) DESC, {trusted}", "email": trusted, "segment": recent,
        "balance": f"CASE WHEN r.segment = g.won THEN 0 ELSE 1 END, {recent}",
    }
    best = lambda what, f: f"first({what} ORDER BY {orders[f]}) FILTER (WHERE r.{f} IS NOT NULL)"
    place = f"ORDER BY (r.city IS NOT NULL)::INT + (r.nation_id IS NOT NULL)::INT DESC, {trusted}"
    return f"""WITH c AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance, {tidy},
        CASE source {trust} ELSE {len(TRUST)} END AS trust FROM clients),
      r AS (SELECT *, coalesce(updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL {STALE_HOURS} HOUR, true) AS stale FROM c),
      g AS (SELECT cluster_id, {best('r.segment', 'segment')} AS won FROM r GROUP BY cluster_id)
      SELECT r.cluster_id, count(*) AS n_records, count(*) FILTER (WHERE r.stale) AS n_stale, {best('r.name', 'name')} AS name, {best('r.email', 'email')} AS email,
        any_value(g.won) AS segment, first(r.city {place}) AS city, first(r.nation_id {place}) AS nation_id,
        floor(100 * {best('r.balance', 'balance')} + 0.5)::BIGINT AS balance_cents, {best('r.client_id', 'name')} AS name_from, {best('r.client_id', 'email')} AS email_from,
        {best('r.client_id', 'segment')} AS segment_from, {best('r.client_id', 'balance')} AS balance_from,
        first(CASE WHEN r.city IS NOT NULL OR r.nation_id IS NOT NULL THEN r.client_id END {place}) AS address_from
      FROM r JOIN g ON r.cluster_id IS NOT DISTINCT FROM g.cluster_id GROUP BY r.cluster_id"""


GOLDEN_SQL = _golden_sql()
