"""Golden records against a plain loop over the rules."""

import random
from datetime import datetime, timedelta
from math import floor

import pytest
from lorequarry.llm import golden

SCHEMA = "client_id bigint, master_id bigint, source string, updated_at {}, name string, email string, city string, nation_id int, segment string, balance double"
LATE = datetime(9999, 1, 1)


def by_hand(rows):
    clusters = {}
    for row in rows:
        r = dict(zip("id master source at name email city nation segment balance".split(), row, strict=True))
        for c in ("name", "email", "city", "segment"):
            r[c] = r[c] if r[c] and r[c].strip(" \t\n\x0b\f\r") else None
        r["trust"] = {"partner": 0, "store": 1, "web": 2, "crm": 3}.get(r["source"], 4)
        clusters.setdefault(r["master"] if r["master"] is not None else r["id"], []).append(r)
    out = {}
    for key, rs in clusters.items():
        latest = max((r["at"] for r in rs if r["at"]), default=None)
        for r in rs:
            r["stale"] = r["at"] is None or latest - r["at"] > timedelta(hours=720)
            r["recent"] = (r["at"] is None, LATE - (r["at"] or LATE), r["trust"], r["id"] is None, r["id"] or 0)
            r["trusted"] = (r["stale"], r["trust"], *r["recent"])
        pick = lambda field, order: min((r for r in rs if r[field] is not None), key=order, default={})
        segment = pick("segment", lambda r: r["recent"])
        name = pick("name", lambda r: (-len(r["name"]), r["trusted"]))
        email = pick("email", lambda r: r["trusted"])
        balance = pick("balance", lambda r: (segment == {} or r["segment"] != segment["segment"], r["recent"]))
        home = min(rs, key=lambda r: (-(r["city"] is not None) - (r["nation"] is not None), r["trusted"]))
        held = home["city"] is not None or home["nation"] is not None
        out[key] = (
            len(rs), sum(r["stale"] for r in rs), name.get("name"), email.get("email"), segment.get("segment"), home["city"], home["nation"],
            floor(100 * balance["balance"] + 0.5) if balance else None, name.get("id"), email.get("id"), segment.get("id"), balance.get("id"), home["id"] if held else None,
        )
    return out


def taken(df):
    return {r.cluster_id: tuple(r)[1:] for r in df.collect()}


def some(rng, n):
    start = datetime(2024, 3, 1)
    edge = [timedelta(days=30), timedelta(days=30, microseconds=1), timedelta(days=30) - timedelta(microseconds=1), timedelta(0)]
    rows = []
    for i in range(n):
        at = rng.choice([None, start - rng.choice(edge), start - timedelta(hours=rng.randrange(2000)), start])
        text = lambda *more: rng.choice([None, "", " \t\x0b", *more])  # noqa: E731, B023
        rows.append((
            i, rng.choice([None, 1, 1, 2, 3, 4, 5, 600]), rng.choice(["partner", "store", "web", "crm", "else", None, " "]), at, text("Ann", " Ann", "Äñn😀", "Bo"),
            text("a@x", "b@y"), text("Oslo", "Rome "), rng.choice([None, 3, 4]), text("retail", "export"), rng.choice([None, 1.005, -2.345, 0.0, 99.995]),
        ))
    return rows


@pytest.mark.parametrize("kind,large", [("timestamp_ntz", 1024), ("timestamp_ntz", 3), ("timestamp", 1024)])
def test_by_hand(spark, kind, large):
    rng = random.Random(large)
    rows = some(rng, 400) + some(rng, 3) + [(None, None, "web", None, None, "n@x", None, None, None, None), (9001, None, None, None, None, None, None, None, None, None)]
    rows = [r for i, r in enumerate(rows) if i < 400 or r[0] is None or r[0] > 400]
    made = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(5)
    assert taken(golden.golden_records(made, large)) == by_hand(rows)


def test_days_are_720_hours_in_any_zone(spark):
    """A date without a zone has no short days, whatever the session's zone."""
    at = datetime(2024, 4, 20, 12)
    rows = [(1, 1, "web", at, "a", None, None, None, None, None), (2, 1, "web", at - timedelta(days=30), "bb", None, None, None, None, None), (3, 1, "web", at - timedelta(days=30, microseconds=1), "ccc", None, None, None, None, None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert golden.golden_records(spark.createDataFrame(rows, SCHEMA.format("timestamp_ntz"))).first().n_stale == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_table_repeats_and_extra_columns(spark):
    rows = some(random.Random(2), 30)
    made = spark.createDataFrame(rows, SCHEMA.format("timestamp_ntz"))
    assert golden.golden_records(made.limit(0)).count() == 0
    extra = made.selectExpr("*", "1 as cluster_id", "'x' as field", "2 as latest", "3 as stale", "4 as of", "5 as own", "6 as age")
    assert taken(golden.golden_records(extra)) == by_hand(rows)
    twice = taken(golden.golden_records(made.union(made)))
    assert {k: v[2:] for k, v in twice.items()} == {k: v[2:] for k, v in by_hand(rows).items()}
    assert all(v[0] == 2 * by_hand(rows)[k][0] for k, v in twice.items())
