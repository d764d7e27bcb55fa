r"""URL filters by dated lists: which list entries were active when a page was fetched.

A list is a log of (list_key, action, day): a key is a host, a domain above it, or a host with the
first segments of a path; 'add' starts its validity, 'remove' ends it. The log becomes intervals
[start, until); a capture is matched with the intervals of its keys that hold its day: an as-of join.
Intervals are laid out over cells of ``CELL`` days, so the join is an equality of key and cell, with
the exact days as a further condition. Captures meet the list once for each distinct set of keys and
day, however many captures share a host. A capture has only keys of as many labels or path segments as some
key of the list has, so a URL of any length costs no more than its text times those few numbers.

Defined results: a URL without a scheme or host, or null, has no key and is never listed; a null
fetch day is not listed; log rows without a key or day are void; of log rows of one key and day the
'add' counts last; repeated captures have equal results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def domains(name: Column, sizes: Column) -> Column:
    """Those of the host and the domains above it, down to two labels, that have one of ``sizes`` labels."""
    labels = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
    fit = F.filter(sizes, lambda k: (name != "") & (k <= labels) & ((k > 1) | (labels == 1)))
    return F.transform(fit, lambda k: F.call_function("substring_index", name, F.lit("."), -k))


def path_keys(url: Column, name: Column, depths: Column) -> Column:
    """The host with as many first segments of the path as each of ``depths`` says."""
    parts = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/", -1), lambda x: x != "")
    fit = F.filter(depths, lambda d: (name != "") & (d <= F.size(parts)))
    return F.transform(fit, lambda d: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")))


def key_sizes(listed: DataFrame) -> tuple[Column, Column]:
    """The numbers of labels of the hosts and of path segments that keys of ``listed`` (list_key) have: no
    other key of a URL can be listed. Keys with k different numbers have at least k * k / 2 labels or segments,
    so those numbers are few."""
    path = F.length("list_key") - F.length(F.replace(F.col("list_key"), F.lit("/"), F.lit("")))
    labels = F.length("list_key") - F.length(F.replace(F.col("list_key"), F.lit("."), F.lit(""))) + 1
    found = listed.agg(F.sort_array(F.collect_set(F.when(path == 0, labels))), F.sort_array(F.collect_set(F.when(path > 0, path)))).first()
    literal = lambda sizes: F.array(*[F.lit(int(k)) for k in sizes]).cast("array<int>")
    return literal(found[0]), literal(found[1])


def intervals(log: DataFrame) -> DataFrame:
    """(list_key, start, until) of each 'add' up to the key's next row; until is null where it holds on."""
    steps = Window.partitionBy("list_key").orderBy("day", "is_add")
    return (
        log.where(F.col("list_key").isNotNull() & F.col("day").isNotNull())
        .select("list_key", "day", (F.col("action") == "add").cast("int").alias("is_add"))
        .withColumn("until", F.lead("day").over(steps))
        .where("is_add = 1 and (until is null or until > day)")
        .select("list_key", F.col("day").alias("start"), "until")
        .distinct()
    )


def judge(captures: DataFrame, log: DataFrame) -> DataFrame:
    """For each capture (page_id, url, fetched_on): page_id, host, fetched_on, n_active (entries that
    hold then), blocked, listed_key (the longest of them) and since (when that one began)."""
    valid = intervals(log)
    sizes, depths = key_sizes(valid)
    last = captures.agg(F.max("fetched_on").alias("d")).first()["d"]
    cell = lambda day: F.floor(F.unix_date(day) / CELL)
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    laid = valid.where(F.col("start") <= F.lit(last).cast("date")).withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(end))))
    own = captures.select("page_id", host(F.col("url")).alias("host"), "fetched_on", "url")
    keyed = own.withColumn("keys", F.concat(domains(F.col("host"), sizes), path_keys(F.col("url"), F.col("host"), depths))).withColumn("key_set", F.array_join("keys", " ")).drop("url")
    wanted = keyed.where("fetched_on is not null").select("key_set", "keys", "fetched_on").distinct()
    probes = wanted.select("key_set", "fetched_on", F.explode("keys").alias("list_key")).withColumn("cell", cell(F.col("fetched_on")))
    active = probes.join(laid, ["list_key", "cell"]).where("start <= fetched_on and (until is null or fetched_on < until)")
    best = F.max(F.struct(F.length("list_key").alias("n"), "list_key", "start"))
    decided = active.groupBy("key_set", "fetched_on").agg(F.count("*").alias("n_active"), best.alias("best"))
    decided = decided.select("key_set", F.col("fetched_on").alias("day"), "n_active", F.col("best.list_key").alias("listed_key"), F.col("best.start").alias("since"))
    out = keyed.join(decided, (keyed["key_set"] == decided["key_set"]) & (keyed["fetched_on"] == decided["day"]), "left")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return out.select("page_id", "host", "fetched_on", n.alias("n_active"), (n > 0).alias("blocked"), "listed_key", "since")
