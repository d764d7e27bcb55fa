"""Audits, identities and validation of records."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Accepted spellings of booleans, fields that a response must not have.
TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")
SENSITIVE = ("address", "email", "ip", "ip_address", "name", "participant_id", "participant_name", "phone", "user_agent")


def parsed_bool(text: Column) -> Column:
    """True or false for the accepted spellings; null for others (quarantine those)."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


@F.pandas_udf(T.StringType())
def canonical_hash(json_text: pd.Series) -> pd.Series:
    """sha256: and the digest of a JSON text with sorted keys and no blanks."""
    form = lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json_text.map(lambda t: None if t is None else "sha256:" + hashlib.sha256(form(t).encode()).hexdigest())


def content_hash(text: Column) -> Column:
    """sha256: and the digest of a text."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def hmac_alias(column: Column, secret: bytes, domain: str, length: int = 12) -> Column:
    """The beginning of an HMAC-SHA256 of domain and value; the key stays in the function's closure."""

    @F.pandas_udf(T.StringType())
    def alias(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret, f"{domain}\x1f{v}".encode(), hashlib.sha256).hexdigest()[:length])

    return alias(column)


def custody_schedule(episodes: DataFrame, secret: bytes, duplicates: int = 10, domains: tuple[str, str, str] = ("alias", "selection", "order")) -> DataFrame:
    """The order in which episodes (repair_id) are rated, each once and ``duplicates`` of them, those of
    the least selection HMACs, twice: ordinal, assignment_alias, episode_alias, repair_id, occurrence and
    is_duplicate. All aliases and orders are HMACs of a secret, so only its keeper can repeat them. A study's
    episodes are few: one task numbers them."""
    if len(secret) < 32:
        raise ValueError("the secret must have 32 bytes or more")
    digest = lambda domain, value: hmac_alias(value, secret, domain, 64)
    named = episodes.select("repair_id", digest(domains[0], F.col("repair_id")).alias("alias"), digest(domains[1], F.col("repair_id")).alias("s"))
    chosen = named.withColumn("twice", F.row_number().over(Window.orderBy("s", "repair_id")) <= duplicates)
    each = chosen.withColumn("occurrence", F.explode(F.when(F.col("twice"), F.array(F.lit("primary"), F.lit("duplicate-1"))).otherwise(F.array(F.lit("primary")))))
    key = F.concat("repair_id", F.lit("\x1f"), "occurrence")
    keyed = each.withColumn("a", digest(domains[2], key)).withColumn("o", digest(domains[2], F.concat(F.lit("order\x1f"), key)))
    return keyed.select(
        F.row_number().over(Window.orderBy("o", "repair_id")).alias("ordinal"), F.concat(F.lit("assignment-"), F.substring("a", 1, 16)).alias("assignment_alias"),
        F.concat(F.lit("episode-"), F.substring("alias", 1, 16)).alias("episode_alias"), "repair_id", "occurrence", (F.col("occurrence") != "primary").alias("is_duplicate"),
    )


def blind(records: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """``records`` with the values of ``columns`` replaced by aliases (real, alias). Null stays null; a
    value without an alias raises an error when the row is read."""
    out = records
    for c in columns:
        named = aliases.select(F.col("real").alias(f"_{c}_real"), F.col("alias").alias(f"_{c}_alias"))
        out = out.join(named, F.col(c) == F.col(f"_{c}_real"), "left")
        value = F.when(F.col(c).isNotNull() & F.col(f"_{c}_alias").isNull(), F.raise_error(F.concat(F.lit(f"no alias for {c} "), F.col(c).cast("string")))).otherwise(F.col(f"_{c}_alias"))
        out = out.withColumn(c, value).drop(f"_{c}_real", f"_{c}_alias")
    return out


def unblinding_token(secret: bytes, study: str, columns: list[str], approver: str) -> str:
    """The authorisation to unblind these columns of a study, which only the keeper of the secret can give."""
    return hmac.new(secret, "\x1f".join(["unblind", study, approver, *sorted(columns)]).encode(), hashlib.sha256).hexdigest()


def unblind(records: DataFrame, aliases: DataFrame, columns: list[str], token: str, secret: bytes, study: str, approver: str) -> DataFrame:
    """The reverse of ``blind``; needs the token for just these columns."""
    if not hmac.compare_digest(token, unblinding_token(secret, study, columns, approver)):
        raise PermissionError("unblinding is not authorised")
    return blind(records, aliases.select(F.col("alias").alias("real"), F.col("real").alias("alias")), columns)


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def rows_commitment(rows: DataFrame, columns: list[str], name: str = "commitment") -> DataFrame:
    """One row: how many rows there are and a hash of their columns, whatever their order. Rows are hashed
    one by one and the hashes by their 4096 beginnings, so that no task gathers them all; null is not empty."""
    stated = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    own = rows.select(F.sha2(F.concat_ws("\x1f", *stated).cast("binary"), 256).alias("h"))
    leaf = own.groupBy(F.substring("h", 1, 3).alias("leaf")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    return leaf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), root.alias(name))


def manifest_receipt(listed: DataFrame) -> DataFrame:
    """One row: files and bytes of a manifest, and a hash over its entries. Entries are hashed by
    256 groups of their paths' hashes first, so that no task gathers them all."""
    entry = F.concat_ws("\x1f", "path", "sha256", F.col("bytes").cast("string"))
    leaf = listed.groupBy(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 2).alias("leaf")).agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n").cast("binary"), 256).alias("h")
    )
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    return leaf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), root.alias("manifest_sha256"))


def rights_audit(artifacts: DataFrame, ledger: DataFrame, own_prefix: str) -> DataFrame:
    """Artifacts whose source is neither in the ledger nor the project's own."""
    return artifacts.where(F.col("source_id").isNull() | ~F.startswith("source_id", F.lit(own_prefix))).join(ledger.select("source_id"), "source_id", "left_anti")


def rights_summary(artifacts: DataFrame, ledger: DataFrame, own_prefix: str) -> DataFrame:
    """Artifacts without rights, by source."""
    return rights_audit(artifacts, ledger, own_prefix).groupBy("source_id").agg(F.count("*").alias("artifacts"))


def validated_ratings(rows: DataFrame) -> DataFrame:
    """``rows`` (rating, confidence, recognised) with the names of invalid fields: ratings are whole
    numbers from 1 to 5, confidences from 0 to 100, recognised a boolean spelling or null."""
    invalid = F.array_compact(F.array(
        F.when(F.col("rating").isNull() | ~F.col("rating").between(1, 5) | (F.col("rating") != F.floor("rating")), "rating"),
        F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 100), "confidence"),
        F.when(F.col("recognised").isNotNull() & parsed_bool(F.col("recognised")).isNull(), "recognised"),
    ))
    return rows.withColumn("invalid_fields", invalid).withColumn("valid", F.size("invalid_fields") == 0)


def response_fields(response: Column, required: list[str]) -> Column:
    """(missing, prohibited) of a map of response fields: required ones that are absent or empty, and
    sensitive ones that are there."""
    keys = F.transform(F.map_keys(response), lambda k: F.lower(F.trim(k)))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.element_at(response, f), F.lit("")) == "", F.lit(f)) for f in required]))
    return F.struct(missing.alias("missing"), F.array_sort(F.array_intersect(keys, F.array(*[F.lit(s) for s in SENSITIVE]))).alias("prohibited"))


def fixity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) against a manifest (path, sha256): changed, missing or unlisted ones."""
    now = files.select("path", F.sha2("content", 256).alias("found"))
    both = manifest.select("path", F.col("sha256").alias("expected")).join(now, "path", "full_outer")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("found") != F.col("expected"), "changed")
    return both.withColumn("finding", kind).where("finding is not null")


def candidate_findings(tasks: DataFrame, panel: str, factors: list[str], expected: int) -> DataFrame:
    """What is wrong with a set of tasks: repeated ids, panels of the wrong size, incomplete factorials."""
    repeated = tasks.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-task").alias("finding"), F.col("task_id").cast("string").alias("subject"), "n")
    sizes = tasks.groupBy(panel).agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("panel-size").alias("finding"), F.col(panel).cast("string").alias("subject"), "n")
    levels = tasks.groupBy(panel).agg(F.count_distinct(*factors).alias("n"), *[F.count_distinct(f).alias(f"_{f}") for f in factors])
    full = F.lit(1)
    for f in factors:
        full = full * F.col(f"_{f}")
    holes = levels.where(F.col("n") < full).select(F.lit("incomplete-factorial").alias("finding"), F.col(panel).cast("string").alias("subject"), "n")
    return repeated.union(sizes).union(holes)


def resolve_selectors(selectors: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that each selector matches (a null key matches all), with how many there are."""
    on = None
    for k in keys:
        part = F.col(f"s.{k}").isNull() | (F.col(f"s.{k}") == F.col(f"t.{k}"))
        on = part if on is None else on & part
    joined = F.broadcast(selectors).alias("s").join(tasks.alias("t"), on, "left")
    return joined.groupBy("s.selector_id").agg(F.count("t.task_id").alias("matches"), F.min("t.task_id").alias("task_id")).withColumn("resolved", F.col("matches") == 1)
