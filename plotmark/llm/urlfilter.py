"""Dated URL lists against captures, as DataFrame expressions only.

A list is a table of dated entries: an entry adds a pattern to a list or removes it. Entries
become validity intervals, and a capture meets the intervals that hold at its fetch time.
Kinds of pattern, from the least to the most specific:

* ``domain``: the host and all hosts below it
* ``host``: that host alone
* ``prefix``: host and the first segments of the path, such as ``example.com/a/b``
* ``url``: host, path and query

Of the active entries the most specific decides, then the longest pattern, then ``block``
before ``allow``. Schemes, ports, user names, fragments, the case of the host and slashes at
the end of a path do not matter.

Every distinct (url, time) is tried once, however often it occurs. It is joined by equality
on pattern and time bucket, so neither a host that most captures have nor a pattern that is
added and removed all the time brings all its rows together; intervals are made per pattern
and bucket, with the state before each bucket taken from one row per bucket.

A null or empty url has no pattern, and at an unknown time nothing is active: such captures
are not blocked. Entries with a null in them are ignored, repeated ones count once. Where a
pattern is added and removed at one time, the addition holds. Captures are returned row
by row, repeated and null ids included; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotmark.session import materialize

KINDS = ("domain", "host", "prefix", "url")
# Length of a time bucket: thirty days, in microseconds.
BUCKET = 30 * 86_400 * 1_000_000
_URL = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)((?:\?[^#]*)?)"


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _bucket(at: str) -> Column:
    return F.floor(F.col(at) / BUCKET)


def patterns(url: Column, labels: Column, segments: Column) -> Column:
    """All (kind, pattern) that a url falls under, with at most so many labels and path segments."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")
    parts = F.split(host, r"\.")
    path = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
    n, depth = F.size(parts), F.least(F.size(path), segments)
    whole = F.concat(F.array_join(F.array_prepend(path, host), "/"), F.regexp_extract(url, _URL, 3))
    counted = lambda last: F.filter(F.sequence(F.lit(0), last), lambda i: i > 0)

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))

    found = F.concat(
        named("domain", F.transform(counted(F.least(n, labels)), lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))),
        named("host", F.array(host)),
        named("prefix", F.transform(counted(depth), lambda i: F.concat_ws("/", host, F.array_join(F.slice(path, 1, i), "/")))),
        named("url", F.array(whole)),
    )
    return F.when(host != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, from, to) of each stretch in which a pattern is on a list.

    Times are microseconds; ``from`` belongs to the interval, ``to`` does not and is null
    where it has not ended. ``entries`` has list, kind, pattern, action (``add`` or
    ``remove``) and time.
    """
    key = ["list", "kind", "pattern"]
    states = (
        entries.select(*key, _micros(F.col("time")).alias("at"), (F.col("action") == "add").alias("on"))
        .dropna()
        .groupBy(*key, "at")
        .agg(F.max("on").alias("on"))
        .withColumn("bucket", _bucket("at"))
    )
    by_bucket, in_bucket = Window.partitionBy(*key).orderBy("bucket"), Window.partitionBy(*key, "bucket").orderBy("at")
    ends = states.groupBy(*key, "bucket").agg(F.max_by("on", "at").alias("last"))
    before = ends.select(*key, "bucket", F.lag("last", 1, False).over(by_bucket).alias("before"))
    changes = (
        states.join(before.hint("merge"), [*key, "bucket"])
        .withColumn("was", F.coalesce(F.lag("on").over(in_bucket), F.col("before")))
        .filter(F.col("on") != F.col("was"))
    )
    changes = materialize(changes.select(*key, "bucket", "at", "on"), "changes")
    firsts = changes.groupBy(*key, "bucket").agg(F.min("at").alias("first"))
    after = firsts.select(*key, "bucket", F.lead("first").over(by_bucket).alias("after"))
    until = F.coalesce(F.lead("at").over(in_bucket), F.col("after"))
    spans = changes.join(after.hint("merge"), [*key, "bucket"]).withColumn("to", until).filter("on")
    return spans.select(*key, F.col("at").alias("from"), "to")


def judge(
    captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched"
) -> DataFrame:
    """(id, url, time, n_active, list, kind, pattern, since, blocked) per capture.

    ``n_active`` counts the active entries that match; the next four name the one that
    decides, with the time from which it holds, and are null where there is none.
    """
    seen = captures.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_time")
    ).withColumn("_at", _micros(F.col("_time")))
    tried = seen.select("_url", "_at").dropna().distinct()
    valid = materialize(intervals(entries), "intervals")
    # How deep patterns go, and which time buckets the captures span: one row each.
    is_kind = lambda k: F.col("kind") == k
    deep = valid.agg(
        F.max(F.when(is_kind("domain"), F.size(F.split("pattern", r"\.")))).alias("labels"),
        F.max(F.when(is_kind("prefix"), F.size(F.split("pattern", "/")) - 1)).alias("segments"),
    ).first()
    span = seen.agg(F.min(_bucket("_at")).alias("low"), F.max(_bucket("_at")).alias("high")).first()
    low, high = F.lit(span["low"] or 0), F.lit(span["high"] or 0)
    first = F.greatest(_bucket("from"), low)
    last = F.least(F.coalesce(_bucket("to"), high), high)
    active = valid.filter(first <= last).select(
        "list", "kind", "pattern", "from", "to", F.explode(F.sequence(first, last)).alias("bucket")
    )
    under = F.explode(patterns(F.col("_url"), F.lit(deep["labels"] or 0), F.lit(deep["segments"] or 0)))
    keyed = tried.select("_url", "_at", _bucket("_at").alias("bucket"), under.alias("p"))
    keyed = keyed.select("_url", "_at", "bucket", "p.kind", "p.pattern")
    holds = (F.col("from") <= F.col("_at")) & (F.col("to").isNull() | (F.col("_at") < F.col("to")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    claim = F.struct(
        rank.alias("rank"),
        F.char_length("pattern").alias("length"),
        (F.col("list") == "block").alias("block"),
        "list",
        "kind",
        "pattern",
        F.timestamp_micros("from").alias("since"),
    )
    # Both joins' smaller sides compress well, so Spark takes them for small: they grow with
    # the lists and captures, and are sorted rather than sent whole.
    found = (
        keyed.join(active.hint("merge"), ["kind", "pattern", "bucket"])
        .filter(holds)
        .groupBy("_url", "_at")
        .agg(F.count("*").alias("n_active"), F.max(claim).alias("winner"))
    )
    out = seen.join(materialize(found, "found").hint("merge"), ["_url", "_at"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_time").alias(time_col),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        *[F.col(f"winner.{c}").alias(c) for c in ("list", "kind", "pattern", "since")],
        F.coalesce(F.col("winner.block"), F.lit(False)).alias("blocked"),
    )
