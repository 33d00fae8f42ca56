"""Rolling totals, sessions and as-known attributes against brute force, with dirty rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clicklake.functions.times import iso_to_utc
from clicklake.operators.asof_intervals import as_known, validity
from clicklake.operators.rolling import daily_counts, trailing_sums
from clicklake.operators.sessions import sessions

T0 = datetime(2024, 9, 2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trailing_sums_match_brute_force(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 2, 2, 2, None]), T0 + timedelta(days=int(rng.random() ** 2 * 70), minutes=rng.randrange(900)), rng.choice([True, False, None])) for i in range(400)]
    data += rng.sample(data, 60) + [(900, 3, None, True), (901, 4, T0, True)]
    df = spark.createDataFrame(data, "id long, e long, at timestamp_ntz, label boolean").withColumn("day", F.lit("clash"))
    got = rows(trailing_sums(daily_counts(df, "e", "at", "label", "id"), (1, 7, 30)))
    want = []
    once = {r[0]: r for r in data if r[1] is not None and r[2] is not None}.values()
    for e in {r[1] for r in once}:
        own = [(r[2].date(), bool(r[3])) for r in once if r[1] == e]
        day = min(own)[0]
        while day <= max(d for d, _ in own):
            inside = lambda n: [c for d, c in own if day - timedelta(days=n) < d <= day]  # noqa: E731, B023
            want.append((e, day, len(inside(1)), sum(inside(1)), *(x for n in (1, 7, 30) for x in (len(inside(n)), sum(inside(n))))))
            day += timedelta(days=1)
    assert got == sorted(want)


def test_rolling_of_nothing(spark):
    df = spark.createDataFrame([], "id long, e long, at timestamp_ntz, label boolean")
    assert rows(trailing_sums(daily_counts(df, "e", "at", "label", "id"))) == []


def brute_sessions(data, gap):
    out = []
    for u in {r[0] for r in data if r[0] is not None}:
        own = sorted({(t, i) for v, t, i in data if v == u and t is not None})
        run = []
        for x in own:
            if run and (x[0] - run[-1][0]).total_seconds() > gap:
                out.append((u, run))
                run = []
            run.append(x)
        if run:
            out.append((u, run))
    return sorted((u, r[0][0], r[-1][0], len(r), r[0][1], r[-1][1]) for u, r in out)


def test_sessions_match_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *[T0 + timedelta(minutes=rng.randrange(6000))] * 9]), i) for i in range(500)]
    data += rng.sample(data, 80) + [(7, T0, 1000), (7, T0 + timedelta(minutes=30), 999), (8, T0, 3), (8, T0 + timedelta(minutes=30, microseconds=1), 2)]
    df = spark.createDataFrame(data, "u long, at timestamp_ntz, i long").withColumn("part", F.lit(1))
    for width in (600, 3600, 10**7):
        got = rows(sessions(df, "u", "at", "i", 1800, width).select("user", "start", "end", "n_events", "first_row", "last_row"))
        assert got == brute_sessions(data, 1800)
    assert rows(sessions(df.repartition(7).orderBy(F.rand(1)), "u", "at", "i").select("user", "start", "end", "n_events", "first_row", "last_row")) == brute_sessions(data, 1800)
    assert sessions(df.limit(0), "u", "at", "i").count() == 0


def test_as_known_never_looks_ahead(spark):
    rng = random.Random(3)
    stamp = lambda: T0 + timedelta(minutes=rng.randrange(0, 20000, 50))
    versions = [(rng.choice([1, 2, 3, None]), i, rng.choice([stamp(), None]) if i % 9 == 0 else stamp(), rng.choice([None, stamp()])) for i in range(150)]
    events = [(i, rng.choice([1, 1, 1, 1, 2, 9, None]), rng.choice([stamp(), stamp(), None])) for i in range(400)]
    v = spark.createDataFrame(versions + versions[:30], "a long, f long, c timestamp_ntz, l timestamp_ntz").withColumn("l", F.coalesce("l", "c"))
    e = spark.createDataFrame(events + events[:50], "i long, a long, t timestamp_ntz").withColumn("bucket", F.lit("x"))
    want = []
    for i, a, t in events:
        ok = [(c, x or c, f) for b, f, c, x in versions if t and a is not None and b == a and c and c < t and (x or c) < t]
        if ok:
            want.append((i, max(ok)[2]))
    for width, share in ((3600, 0.005), (86400, 0.9), (10**8, 0.2)):
        spans = validity(v.where("c is not null"), "a", F.greatest("c", "l"), F.struct("c", "l", "f"))
        got = rows(as_known(e, "a", "t", "i", spans, width, hot_share=share).select("event_id", "best.f"))
        assert got == sorted(want)
    assert as_known(e.limit(0), "a", "t", "i", spans).count() == 0
    assert as_known(e, "a", "t", "i", spans.limit(0)).count() == 0


def test_iso_spellings(spark):
    texts = ["2024-09-01 00:00:00", "2024-09-01T00:00:00", "2024-09-01T02:00:00+02:00", " 2024-08-31T18:30:00-05:30 ", "2024-09-01T00:00:00Z", "2024-09-01 00:00", "2024-09-01 00:00:00.000000", "2024-09-01T00:00:00.0000009", "2024-09-01T02:00:00+0200"]
    bad = ["", "NaT", "n/a", None, "2024-09-01", "2024-13-01 00:00", "2024-09-01 25:00:00", "x2024-09-01 00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad)], "i int, s string").orderBy("i").select(iso_to_utc(F.col("s"))).collect()]
    assert got == [datetime(2024, 9, 1)] * len(texts) + [None] * len(bad)
