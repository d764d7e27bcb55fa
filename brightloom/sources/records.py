"""Readers and writers of study records: declared schemas, nothing inferred."""

from __future__ import annotations

import csv
import hashlib
import html.parser
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions.draws import stable_seed

# Columns of a vote file, and columns that it must not have.
VOTE_COLUMNS = ("pair_id", "task_id", "criterion", "left_artifact_id", "right_artifact_id", "winner", "rater_hash")
VOTE_SENSITIVE = ("address", "email", "ip", "ip_address", "name", "participant_name", "phone", "user_agent")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a declared schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON documents, one row each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; Spark's committer makes the write atomic. Without ``overwrite`` an existing path is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_votes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(votes, rejects) of a CSV of pairwise votes. The header must have the seven columns and none that
    identifies a person; winners A or left, B or right and tie are known; rater hashes are 16 or more
    hexadecimal digits. All values are trimmed and rater hashes lowered, so that a rater is one rater in
    any spelling."""
    first = spark.read.text(path).first()
    header = [h.strip().lower() for h in next(csv.reader([first[0].removeprefix("\ufeff")]))] if first else []
    if found := sorted(set(header) & set(VOTE_SENSITIVE)):
        raise ValueError(f"columns that identify a person: {', '.join(found)}")
    if lacking := [c for c in VOTE_COLUMNS if c not in header]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    rows = spark.read.schema(", ".join(f"`{h}` string" for h in header)).option("header", True).csv(path)
    rows = rows.select(*[(F.lower(F.trim(h)) if h in ("rater_hash", "winner") else F.trim(h) if h in VOTE_COLUMNS else F.col(h)).alias(h) for h in header])
    side = F.when(F.col("winner").isin("a", "left"), "left").when(F.col("winner").isin("b", "right"), "right").when(F.col("winner") == "tie", "tie")
    named = rows.withColumn("side", side)
    good = F.col("side").isNotNull() & F.coalesce(F.col("rater_hash").rlike("^[0-9a-f]{16,}$"), F.lit(False)) & (F.col("left_artifact_id") != F.col("right_artifact_id"))
    return named.where(good), named.where(~F.coalesce(good, F.lit(False)))


def write_frozen(df: DataFrame, path: str) -> bool:
    """JSON lines that are written once: True if they were written now, False if ``path`` holds the same
    rows already, in whatever order; other rows there are an error."""
    spark = df.sparkSession
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        lines.write.text(path)
        return True
    figures = lambda x: x.agg(F.count("*"), *[F.sum(F.xxhash64("value", F.lit(k)).cast("decimal(38,0)")) for k in (0, 1)]).first()
    if figures(lines) != figures(spark.read.text(path)):
        raise ValueError(f"{path} holds other rows")
    return False


def evaluation_batch(pairs: DataFrame, seed: int) -> DataFrame:
    """Assignments of pairs (pair_id, task_id, criterion, left_artifact_id, right_artifact_id) for raters:
    sides are only called A and B, each row has a seed for the order of presentation, and the columns
    that raters fill in are empty."""
    empty = [F.lit("").alias(c) for c in ("winner", "rater_hash", "panel", "consent_version")]
    order = stable_seed(F.lit(seed), F.col("pair_id"), F.col("criterion"))
    return pairs.select("pair_id", "task_id", "criterion", "left_artifact_id", "right_artifact_id", F.lit("A").alias("left_alias"), F.lit("B").alias("right_alias"), order.alias("presentation_order_seed"), *empty)


# What the columns of an assignment are.
ASSIGNMENT_FIELDS = {
    "pair_id": "the comparison", "task_id": "the prompt and its condition", "criterion": "what is judged", "left_artifact_id": "the artifact shown as A", "right_artifact_id": "the artifact shown as B",
    "winner": "A, B or tie", "rater_hash": "a one-way hash of the rater", "panel": "the sampling panel", "consent_version": "the consent text that was approved",
}


def write_evaluation_batch(pairs: DataFrame, path: str, seed: int) -> DataFrame:
    """Write a batch under ``path``: assignments as CSV by pair and criterion, a dictionary of its fields and
    a manifest, which is returned: assignments, criteria, a hash over the assignments. No pairs are an error."""
    batch = evaluation_batch(pairs, seed)
    line = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in batch.columns])
    leaf = batch.groupBy(F.substring(F.sha2(F.col("pair_id").cast("binary"), 256), 1, 2).alias("leaf")).agg(
        F.count("*").alias("n"), F.collect_set("criterion").alias("c"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("h")
    )
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "").cast("binary"), 256)  # at most 256 leaves
    found = leaf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("criteria"), root.alias("assignments_sha256")).first()
    if not found["assignments"]:
        raise ValueError("a batch needs a pair")
    spark = pairs.sparkSession
    batch.repartitionByRange("pair_id", "criterion").sortWithinPartitions("pair_id", "criterion").write.mode("errorifexists").option("header", True).csv(f"{path}/assignments")
    spark.createDataFrame(list(ASSIGNMENT_FIELDS.items()), "field string, meaning string").coalesce(1).write.mode("errorifexists").json(f"{path}/dictionary")
    manifest = spark.createDataFrame([(seed, found["assignments"], found["criteria"], found["assignments_sha256"], False)], "seed long, assignments long, criteria array<string>, assignments_sha256 string, contains_direct_identifiers boolean")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def plain_text(markup: str | None) -> str | None:
    """The text nodes of a page, also those of scripts and styles, joined by one blank, with single blanks."""
    if markup is None:
        return None
    nodes: list[str] = []
    tokeniser = html.parser.HTMLParser(convert_charrefs=True)
    tokeniser.handle_data = nodes.append
    tokeniser.feed(markup)
    tokeniser.close()
    return " ".join(word for node in nodes for word in node.split())


@F.pandas_udf(T.StringType())
def html_text(markup: pd.Series) -> pd.Series:
    """``plain_text`` of a column."""
    return markup.map(plain_text)


_ATOM = "{http://www.w3.org/2005/Atom}"


# Rights under which text may be analysed, and kept.
ANALYSIS_RIGHTS = ("author-owned", "licensed", "permission-granted", "public-domain", "quotation-only")
EXPORT_RIGHTS = ("author-owned", "licensed", "permission-granted", "public-domain")


# Limits of a feed.
FEED_BYTES, FEED_ENTRIES, ENTRY_CHARACTERS = 10_000_000, 10_000, 200_000


def _feed_entry(entry: ET.Element, nth: int) -> dict:
    child = lambda name: entry.find(_ATOM + name)
    text = lambda name: None if child(name) is None else " ".join("".join(child(name).itertext()).split()) or None
    url = next((x.get("href") for x in entry.findall(f"{_ATOM}link") if x.get("rel", "alternate") == "alternate" and x.get("href")), None)
    name = text("id") or url or f"entry-{nth}"
    if url is None and name.startswith(("http://", "https://")):
        url = name
    return {
        "record_id": name, "title": plain_text(text("title")), "url": url, "published": text("published"), "updated": text("updated"), "text": plain_text(text("content") or text("summary") or ""),
        "categories": sorted({c.get("term") for c in entry.findall(f"{_ATOM}category") if c.get("term")}),
    }


def parse_feed(payload: bytes, max_bytes: int = FEED_BYTES, max_entries: int = FEED_ENTRIES, max_characters: int = ENTRY_CHARACTERS) -> list[dict]:
    """Entries of an Atom feed, by publication (or update) time and id. An entry without an id has its link
    for one, or its place; one without a link has its id, if that is a URL. A feed or an entry beyond the
    limits, and a document that declares entities or is no feed, are errors."""
    if len(payload) > max_bytes:
        raise ValueError("feed is too large")
    if b"<!DOCTYPE" in payload or b"<!ENTITY" in payload:
        raise ValueError("feed declares entities")
    root = ET.fromstring(payload)
    if root.tag != f"{_ATOM}feed":
        raise ValueError("not an Atom feed")
    found = root.findall(f"{_ATOM}entry")
    if len(found) > max_entries:
        raise ValueError("feed has too many entries")
    out = [_feed_entry(entry, nth) for nth, entry in enumerate(found, 1)]
    if long := [e["record_id"] for e in out if len(e["text"]) > max_characters]:
        raise ValueError(f"text is too long: {long[0]}")
    return sorted(out, key=lambda e: (e["published"] or e["updated"] or "", e["record_id"]))


def read_feeds(spark: SparkSession, path: str, rights_status: str = "metadata-only") -> DataFrame:
    """Entries of all Atom files under ``path``, with a hash of their text. The text itself is only kept
    under rights that allow its export."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p} | e for p, c in zip(frame["path"], frame["content"]) for e in parse_feed(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "record_id", "title", "url", "published", "updated", "text", "categories"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    entries = files.mapInPandas(parse, "path string, record_id string, title string, url string, published string, updated string, text string, categories array<string>")
    entries = entries.withColumn("content_sha256", F.when(F.col("text") != "", F.sha2(F.col("text").cast("binary"), 256))).withColumn("rights_status", F.lit(rights_status))
    return entries if rights_status in EXPORT_RIGHTS else entries.withColumn("text", F.lit(None).cast("string"))


def _permitted(entries: DataFrame, rights: tuple[str, ...], what: str) -> DataFrame:
    denied = F.raise_error(F.concat(F.lit(f"{what} is not permitted: "), F.coalesce("rights_status", F.lit("unknown"))))
    return entries.withColumn("rights_status", F.when(F.coalesce(F.col("rights_status").isin(*rights), F.lit(False)), F.col("rights_status")).otherwise(denied))


def prompt_records(entries: DataFrame) -> DataFrame:
    """Entries with text (source_id, record_id, title, url, published, updated, categories, text,
    rights_status) as prompts: source_id, record_id, prompt and metadata. Rights that do not allow
    analysis are an error."""
    some = _permitted(entries, ANALYSIS_RIGHTS, "analysis").where("text is not null and text <> '' and rights_status is not null")
    meta = F.struct("title", "url", "published", "updated", "categories", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    return some.select("source_id", "record_id", F.col("text").alias("prompt"), meta.alias("metadata"))


def write_corpus(entries: DataFrame, path: str) -> DataFrame:
    """Write entries as JSON lines in the order of their record ids, and return their summary: entries,
    first and last publication, and a hash over the ordered hashes of the entries, made range by range.
    Text of other than exportable rights is an error."""
    allowed = _permitted(entries, EXPORT_RIGHTS, "export").where("rights_status is not null")
    allowed.repartitionByRange("record_id").sortWithinPartitions("record_id").write.mode("errorifexists").json(path)
    hashed = allowed.select("record_id", "published", F.sha2(F.to_json(F.struct(*sorted(entries.columns))).cast("binary"), 256).alias("h"))
    leaf = hashed.groupBy(F.substring(F.sha2(F.col("record_id").cast("binary"), 256), 1, 3).alias("leaf")).agg(
        F.count("*").alias("n"), F.min("published").alias("first"), F.max("published").alias("last"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("h"),
    )
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "").cast("binary"), 256)  # at most 4096 leaves
    return leaf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.min("first").alias("first_published"), F.max("last").alias("last_published"), root.alias("corpus_sha256"))


def export_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines by sequence."""
    events.repartitionByRange("sequence").sortWithinPartitions("sequence").write.mode("errorifexists").json(path)


# Fields of an execution record, and the one that holds its hash.
RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("campaign_id", "cell_id", "worker_id", "lease_token", "model_id", "task_id", "terminal_state", "terminal_reason")], T.StructField("charged_cost", T.DoubleType()),
    T.StructField("artifact_id", T.StringType()), T.StructField("replicate", T.LongType()), T.StructField("seed", T.LongType()), T.StructField("attempt", T.LongType()), T.StructField("record_hash", T.StringType()),
])
_SCANNED = T.StructType([T.StructField("path", T.StringType()), T.StructField("problem", T.StringType()), *RECORD.fields])
_KINDS = {T.StringType: str, T.DoubleType: (int, float), T.LongType: int}


def record_hash(record: dict) -> str:
    """sha256: and the digest of a record without its hash: sorted keys, no blanks."""
    rest = {k: v for k, v in record.items() if k != "record_hash"}
    return "sha256:" + hashlib.sha256(json.dumps(rest, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "surrogatepass")).hexdigest()


def _scanned(content: bytes) -> tuple:
    """(problem, the fields of ``RECORD``) of a file."""
    nothing = (None,) * len(RECORD.fields)
    try:
        record = json.loads(content)
    except (ValueError, RecursionError):
        return "not-json", *nothing
    if not isinstance(record, dict):
        return "not-an-object", *nothing
    values, wrong = [], []
    for field in RECORD.fields:
        value = record.get(field.name)
        good = value is None or isinstance(value, _KINDS[type(field.dataType)]) and not isinstance(value, bool) and not (isinstance(value, int) and abs(value) >= 1 << 63)
        wrong += [] if good else [field.name]
        values.append((float(value) if isinstance(field.dataType, T.DoubleType) and value is not None else value) if good else None)
    if wrong:
        return f"wrong-type:{wrong[0]}", *values
    if not record.get("record_hash"):
        return "no-hash", *values
    try:
        return None if record["record_hash"] == record_hash(record) else "hash-mismatch", *values
    except (ValueError, RecursionError):  # numbers that JSON does not have
        return "not-json", *values


def read_execution_records(spark: SparkSession, root: str) -> DataFrame:
    """The execution records of all JSON files below ``root``/execution-records, in any file system: path,
    problem (not-json, not-an-object, wrong-type, no-hash, hash-mismatch; null for a good one) and the
    record's fields. A bad file is a row, but for empty ones, which Spark does not read: their records are missing.
    ``problem is null`` is what ``ledger.reconcile_executions`` takes."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *_scanned(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=_SCANNED.names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(f"{root}/execution-records")
    return files.select("path", "content").mapInPandas(scan, _SCANNED)


_RASTER = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("aspect_ratio", T.DoubleType()), T.StructField("channel_means", T.ArrayType(T.DoubleType())),
    T.StructField("channel_deviations", T.ArrayType(T.DoubleType())), T.StructField("dynamic_range", T.DoubleType()),
])


@F.pandas_udf(_RASTER)
def raster_statistics(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Figures of images given as rows of RGB bytes and their width: means, deviations and range of the
    channels, from 0 to 1. Null for no pixels."""
    out = []
    for data, w in zip(pixels, width):
        rgb = np.frombuffer(data or b"", np.uint8).reshape(-1, 3) / 255.0
        if not len(rgb) or not w:
            out.append((None,) * 6)
            continue
        h = len(rgb) // int(w)
        out.append((int(w), h, w / max(1, h), rgb.mean(axis=0).round(6).tolist(), rgb.std(axis=0).round(6).tolist(), float((rgb.max(axis=0) - rgb.min(axis=0)).mean())))
    return pd.DataFrame(out, columns=_RASTER.names)
