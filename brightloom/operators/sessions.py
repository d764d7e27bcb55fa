"""Sessions of raters: stages in order, and ledgers whose entries are chained by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators.integrity import content_hash
from brightloom.operators.ledger import GENESIS, link_hash

# The stages of a session, in order.
STAGES = ("blind-recognition", "prompt-aware-criteria", "pairwise-preference")


def stage_findings(submissions: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(assignment_id, position, stage, finding) of submissions (assignment_id, position, stage) that a
    session does not accept: a stage that is not its own, one that is locked already, one out of order.
    What was not accepted does not count as done; since stages are few, the accepted ones are the n-th
    stage's first submission after the (n-1)-th's."""
    listed = F.array(*[F.lit(s) for s in stages])
    placed = submissions.withColumn("rank", F.array_position(listed, F.col("stage")))
    accepted, after = None, submissions.select("assignment_id").distinct().withColumn("done_at", F.lit(None).cast(dict(submissions.dtypes)["position"]))
    for k in range(1, len(stages) + 1):
        later = F.col("done_at").isNull() | (F.col("position") > F.col("done_at"))
        first = placed.where(F.col("rank") == k).join(after, "assignment_id").where(later).groupBy("assignment_id").agg(F.min("position").alias("done_at"))
        accepted = first.withColumn("rank", F.lit(k)) if accepted is None else accepted.union(first.withColumn("rank", F.lit(k)))
        after = first
    done = accepted.groupBy("assignment_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "done_at"))).alias("done"))
    both = placed.join(done, "assignment_id", "left")
    own = F.element_at("done", F.col("rank").cast("int"))
    finding = (
        F.when(F.coalesce(F.col("rank"), F.lit(0)) == 0, "not-of-this-session").when(F.col("position") == own, F.lit(None)).when(F.col("position") > own, "already-locked").otherwise("out-of-order")
    )
    return both.withColumn("finding", finding).where("finding is not null").select("assignment_id", "position", "stage", "finding")


def disclosure(submissions: DataFrame) -> DataFrame:
    """By assignment: the stages done in order, the next one (null when all are), and whether the prompt
    may be shown (after the first)."""
    bad = stage_findings(submissions).select("assignment_id", "position")
    good = submissions.join(bad, ["assignment_id", "position"], "left_anti").groupBy("assignment_id").agg(F.count("*").alias("stages_done"))
    listed = F.array(*[F.lit(s) for s in STAGES])
    every = submissions.select("assignment_id").distinct().join(good, "assignment_id", "left").fillna(0, ["stages_done"])
    return every.withColumn("next_stage", F.get(listed, F.col("stages_done").cast("int"))).withColumn("prompt_disclosed", F.col("stages_done") > 0)


def receipts(submissions: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The receipts of the submissions (assignment_id, position, stage, artifact_id, response, a canonical text)
    that their session accepts: assignment_id, position, stage, response_hash, previous_receipt_hash (null for
    the first) and receipt_hash. An ordered fold over a session's stages, which are few."""
    bad = stage_findings(submissions, stages).select("assignment_id", "position")
    good = submissions.join(bad, ["assignment_id", "position"], "left_anti")
    kinds = dict(submissions.dtypes)
    link = f"struct<position:{kinds['position']},stage:string,artifact_id:{kinds['artifact_id']},response_hash:string,previous_receipt_hash:string,receipt_hash:string>"
    row = F.struct("position", "stage", "artifact_id", content_hash(F.col("response")).alias("response_hash"))
    in_order = good.groupBy("assignment_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def next_link(links: Column, r: Column) -> Column:
        before = F.when(F.size(links) > 0, F.element_at(links, -1)["receipt_hash"])
        own = receipt_hash(F.col("assignment_id"), r["artifact_id"], r["stage"], r["response_hash"], before)
        return F.concat(links, F.array(F.struct(r["position"].alias("position"), r["stage"].alias("stage"), r["artifact_id"].alias("artifact_id"), r["response_hash"].alias("response_hash"), before.alias("previous_receipt_hash"), own.alias("receipt_hash"))))

    links = F.aggregate("rows", F.array().cast(f"array<{link}>"), next_link)
    return in_order.select("assignment_id", F.explode(links).alias("link")).select("assignment_id", "link.*")


def receipt_hash(assignment: Column, artifact: Column, stage: Column, response_hash: Column, previous: Column) -> Column:
    """sha256: and the digest of what a receipt binds."""
    stated = [F.coalesce(c.cast("string"), F.lit("")) for c in (assignment, artifact, stage, response_hash, previous)]
    return content_hash(F.concat_ws("\x1f", *stated))


def receipt_findings(found: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(assignment_id, stage, finding) of receipts: a hash that does not fit what it binds, a link that does not
    meet the stage before, a stage before that is missing. Every hash is recomputed, each by itself."""
    listed = F.array(*[F.lit(s) for s in stages])
    placed = found.withColumn("rank", F.array_position(listed, F.col("stage")))
    before = placed.select("assignment_id", (F.col("rank") + 1).alias("rank"), F.col("receipt_hash").alias("before_hash"))
    met = placed.join(before, ["assignment_id", "rank"], "left")
    own = receipt_hash(F.col("assignment_id"), F.col("artifact_id"), F.col("stage"), F.col("response_hash"), F.col("previous_receipt_hash"))
    findings = F.array(
        F.when(F.col("rank") == 0, "not-of-this-session"), F.when((F.col("rank") > 1) & F.col("before_hash").isNull(), "stage-missing"),
        F.when(~F.col("previous_receipt_hash").eqNullSafe(F.col("before_hash")) & ((F.col("rank") == 1) | F.col("before_hash").isNotNull()), "chain-drift"), F.when(F.col("receipt_hash") != own, "hash-drift"),
    )
    return met.select("assignment_id", "stage", F.explode(F.array_compact(findings)).alias("finding"))


def entry_hash(previous: Column, sequence: Column, alias: Column, payload: Column) -> Column:
    """The hash of a rating entry."""
    return link_hash(previous, sequence, alias, payload)


def chained(ratings: DataFrame) -> DataFrame:
    """The ledger of ratings (session_id, position, assignment_alias, payload): each with its sequence from 1
    on, previous_hash and entry_hash. An ordered fold: a session's ratings are one chain, in which a hash
    needs the one before it."""
    row = F.struct("position", "assignment_alias", "payload")
    link = "struct<position:{p},assignment_alias:string,payload:string,sequence:long,previous_hash:string,entry_hash:string>".format(p=dict(ratings.dtypes)["position"])
    in_order = ratings.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("ratings"))

    def next_link(links: Column, r: Column) -> Column:
        n, last = F.size(links).cast("long") + 1, F.when(F.size(links) > 0, F.element_at(links, -1)["entry_hash"]).otherwise(F.lit(GENESIS))
        own = F.struct(r["position"].alias("position"), r["assignment_alias"].alias("assignment_alias"), r["payload"].alias("payload"), n.alias("sequence"), last.alias("previous_hash"), entry_hash(last, n, r["assignment_alias"], r["payload"]).alias("entry_hash"))
        return F.concat(links, F.array(own))

    links = F.aggregate("ratings", F.array().cast(f"array<{link}>"), next_link)
    return in_order.select("session_id", F.explode(links).alias("link")).select("session_id", "link.*")


def chain_findings(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """(session_id, sequence, finding) of rating ledgers (session_id, sequence, assignment_alias, payload,
    previous_hash, entry_hash), one chain a session: gaps in the sequence, links that do not meet the
    entry before, hashes that do not fit the entry, assignments rated twice, and ones that are not
    among ``allowed`` (assignment_alias). Entries meet their predecessors by a join, so that a session
    may be long."""
    before = entries.select("session_id", (F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("_before"))
    known = allowed.select("assignment_alias", F.lit(True).alias("_known")).distinct()
    nth = Window.partitionBy("session_id", "assignment_alias").orderBy("sequence")
    met = entries.join(before, ["session_id", "sequence"], "left").join(known, "assignment_alias", "left").withColumn("_nth", F.row_number().over(nth))
    first = F.col("sequence") == 1
    findings = F.array(
        F.when(~first & F.col("_before").isNull(), "sequence-gap"),
        F.when(F.col("previous_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.coalesce("_before", F.col("previous_hash"))), "chain-drift"),
        F.when(F.col("entry_hash") != entry_hash(F.col("previous_hash"), F.col("sequence"), F.col("assignment_alias"), F.col("payload")), "hash-drift"),
        F.when(F.col("_nth") > 1, "rated-twice"), F.when(F.col("_known").isNull(), "not-in-session"),
    )
    return met.select("session_id", "sequence", F.explode(F.array_compact(findings)).alias("finding"))
