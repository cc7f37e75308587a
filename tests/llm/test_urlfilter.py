"""URL lists: verdicts equal a plain scan of all entries; odd captures have a defined result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plotmark.llm import urlfilter
from plotmark.llm.queries import QUERIES

DAY = datetime(2024, 1, 1)
SCHEMA = "list string, kind string, pattern string, action string, time timestamp"


def slow_state(entries, at):
    """The entries (list, kind, pattern) that hold at a time, with the time since when."""
    out = {}
    for key in {e[:3] for e in entries if None not in e}:
        on, since = False, None
        for time in sorted({e[4] for e in entries if e[:3] == key and None not in e and e[4] <= at}):
            adds = any(e[3] == "add" for e in entries if e[:3] == key and e[4] == time)
            if adds and not on:
                since = time
            on = adds
        if on:
            out[key] = since
    return out


def slow_match(kind, pattern, host, path, query):
    whole = "/".join([host, *path]) + query
    if kind == "domain":
        return host == pattern or host.endswith("." + pattern)
    if kind == "host":
        return host == pattern
    if kind == "prefix":
        return any("/".join([host, *path[:i]]) == pattern for i in range(1, len(path) + 1))
    return whole == pattern


def test_against_a_plain_scan(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "example.com.evil.net"]
    pats = [("domain", "example.com"), ("domain", "com"), ("host", "a.example.com"), ("host", "example.com"),
            ("prefix", "other.org/x"), ("prefix", "other.org/x/y"), ("url", "other.org/x/y?q=1"), ("domain", "evil.net")]
    entries = []
    for _ in range(120):
        kind, pattern = rng.choice(pats)
        entries.append((rng.choice(["block", "allow"]), kind, pattern, rng.choice(["add", "remove"]),
                        DAY + timedelta(days=rng.randint(0, 400))))
    entries += [entries[0], (None, "host", "other.org", "add", DAY), ("block", "host", "other.org", "add", None)]
    captures = []
    for k in range(150):
        host, path = rng.choice(hosts), rng.choice([[], ["x"], ["x", "y"], ["x", "y", "z"]])
        query = rng.choice(["", "?q=1"])
        written = rng.choice(["http://", "HTTPS://user@", "//"]) + host.upper() + rng.choice(["", ":8080", "."])
        written += "/" + "/".join(path) + (query or rng.choice(["", "/", "#top"]))
        captures.append((k % 140, written, DAY + timedelta(days=rng.randint(-20, 420)), host, path, query))
    df = spark.createDataFrame([c[:3] for c in captures], "page_id long, url string, fetched timestamp")
    got = urlfilter.judge(df.repartition(3), spark.createDataFrame(entries, SCHEMA).repartition(4)).collect()
    want = []
    for page, url, at, host, path, query in captures:
        live = {k: s for k, s in slow_state(entries, at).items() if slow_match(k[1], k[2], host, path, query)}
        best = max(live, key=lambda k: (urlfilter.KINDS.index(k[1]), len(k[2]), k[0] == "block"), default=None)
        want.append((page, url, at, len(live), *(best or (None,) * 3), live.get(best), bool(best) and best[0] == "block"))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[8] for w in want) and any(w[4] == "allow" for w in want)


def test_a_flapping_pattern_has_disjoint_intervals(spark):
    days = spark.range(0, 900, numPartitions=5)
    entries = days.select(
        F.lit("block").alias("list"), F.lit("host").alias("kind"), F.lit("h.org").alias("pattern"),
        F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"),
        (F.lit(DAY) + F.make_dt_interval(F.col("id").cast("int"))).alias("time"),
    )
    rows = sorted((r["from"], r["to"]) for r in urlfilter.intervals(entries).collect())
    day = 86_400_000_000
    assert len(rows) == 450 and all(b - a == day for a, b in rows) and all(y[0] - x[1] == day for x, y in zip(rows, rows[1:]))


def test_odd_rows(spark):
    urls = [None, "", "no url", "http://", "http:///path", "https://h.org/" + "a/" * 20_000, "http://h.org"]
    rows = [(k, u, DAY, 1) for k, u in enumerate(urls)] + [(None, "http://h.org", DAY, 1), (9, "http://h.org", None, 1)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp, n_active int")
    entries = spark.createDataFrame([("block", "host", "h.org", "add", DAY), ("allow", "prefix", "h.org/a/a", "add", DAY)], SCHEMA)
    got = sorted(((r.page_id, r.n_active, r.list, r.blocked) for r in urlfilter.judge(df, entries).collect()), key=str)
    want = [(k, 0, None, False) for k in range(5)] + [(5, 2, "allow", False), (6, 1, "block", True)]
    want += [(None, 1, "block", True), (9, 0, None, False)] * 2
    assert got == sorted(want, key=str)
    assert urlfilter.judge(df.limit(0), entries).count() == 0
    assert {r.blocked for r in urlfilter.judge(df, entries.limit(0)).collect()} == {False}


@pytest.mark.parametrize("text", ["Python", "Arrow", "Cartesian", "NestedLoop"])
def test_plan(spark, sf, text):
    assert text not in QUERIES["op4_url_lists"](spark, sf)._jdf.queryExecution().executedPlan().toString()
