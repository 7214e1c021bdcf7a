"""URL lists with dates: entries become validity intervals, and an as-of join judges every capture at its fetch time.

A list is a history of additions and removals of host names; a name also covers the hosts below it. All of it is done with
DataFrame functions. The list meets distinct hosts, not captures: each host gets a timeline of stretches, and in each the
entry that decides, the longest active name, then the list's name. Stretches of a host never overlap, so a capture meets one
at most, and the join to captures is a plain equi-join on the host with a time bound, which adaptive execution splits where
one host holds a large share of the captures.

Defined cases: a capture without a readable host, or null fetch time, is judged by no entry; of events of one instant a
removal wins; additions of an active name and removals of an inactive one change nothing; names are compared in lower case;
repeated rows are judged alike; no list, no entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scheme, optional user, then the host.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: str) -> Column:
    h = F.rtrim(F.regexp_extract(F.lower(F.col(url)), HOST, 1), F.lit("."))
    return F.when(h != "", h)


def intervals(events: DataFrame) -> DataFrame:
    """(list, pattern, action 'add' or 'remove', at) to (list, pattern, start, stop): start <= t < stop; stop null: still active."""
    state = events.where(F.col("at").isNotNull()).groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    changes = state.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    return changes.withColumn("stop", F.lead("at").over(order)).where("on = 1").select("list", "pattern", F.col("at").alias("start"), "stop")


def suffixes(host: Column) -> Column:
    """The host and every name above it."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def timelines(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """Per host stretches (start, stop) in which the same entries are active, with the deciding entry and their number."""
    names = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("pattern"))
    met = names.join(valid, "pattern").select("host", "pattern", "list", "start", "stop")
    edges = met.select("host", F.col("start").alias("edge")).unionByName(met.where("stop is not null").select("host", F.col("stop").alias("edge"))).distinct()
    cut = edges.withColumn("next", F.lead("edge").over(Window.partitionBy("host").orderBy("edge")))
    active = cut.join(met, "host").where("start <= edge and (stop is null or stop > edge)")
    best = F.min(F.struct((-F.length("pattern")).alias("far"), "list", "pattern"))
    return active.groupBy("host", "edge", "next").agg(best.alias("best"), F.count("*").alias("n_active")).select("host", F.col("edge").alias("start"), F.col("next").alias("stop"), "best.list", "best.pattern", "n_active")


def judge(captures: DataFrame, events: DataFrame, carry: tuple[str, ...], url: str = "url", at: str = "fetched") -> DataFrame:
    """The carried columns with host, list, pattern, n_active and listed for every capture."""
    seen = captures.select(*carry, F.col(at).alias("_at"), host_of(url).alias("host"))
    lines = timelines(seen.where("host is not null").select("host").distinct(), intervals(events)).withColumnRenamed("host", "_host")
    on = (F.col("host") == F.col("_host")) & (F.col("_at") >= F.col("start")) & (F.col("stop").isNull() | (F.col("_at") < F.col("stop")))
    out = seen.join(lines, on, "left")
    return out.select(*carry, "host", "list", "pattern", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("pattern").isNotNull().alias("listed"))
