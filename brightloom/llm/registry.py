"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import decontam, fingerprint, langid, middle, mixing, neardup, oracles, packing, pii, pipeline, quality, runs, toxicity, urlfilter, warc
from brightloom.llm.common import md5_number
from brightloom.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def _draw(salt: str, column: Column, modulus: int) -> Column:
    return md5_number(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("")))) % modulus


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of an archive of all pages against a replica with damage: by a hash of the id, about one
    record in 101 has its body changed, one in 211 is missing, and one in 307 only the replica has."""
    pages = table(spark, sf_dir, "pages")
    one_in = lambda n: _draw("damage", F.col("page_id"), n) == 0
    body = F.when(one_in(101), F.concat(F.lit("*"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    records = lambda df, html: df.select(F.col("page_id").alias("record_id"), warc.record_text(F.col("page_id"), F.col("url"), html).alias("payload"))
    return warc.audit(records(pages.where(~one_in(307)), F.col("html")), records(pages.where(~one_in(211)), body)).drop("named")


def filter_log(captures: DataFrame) -> DataFrame:
    """A dated list about the hosts of ``captures``: some hosts are listed for a time, some of them
    again, and some first path segments for good."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = captures.select(urlfilter.host(F.col("url")).alias("k")).where("k <> ''").distinct()
    h = hosts.where(_draw("list", F.col("k"), 4) == 0).withColumn("a", _draw("add", F.col("k"), 300)).withColumn("b", F.col("a") + 1 + _draw("remove", F.col("k"), 60))
    first = captures.select(F.explode(urlfilter.path_keys(F.col("url"), urlfilter.host(F.col("url")), F.array(F.lit(1)))).alias("k")).distinct().where(_draw("path", F.col("k"), 5) == 0)
    rows = [
        h.select("k", F.lit("add"), day(F.col("a"))),
        h.select("k", F.lit("remove"), day(F.col("b"))),
        h.where(_draw("again", F.col("k"), 3) == 0).select("k", F.lit("add"), day(F.col("b") + 20)),
        first.select("k", F.lit("add"), day(_draw("first", F.col("k"), 366))),
    ]
    log = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return log.toDF("list_key", "action", "day")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that a hash of its id gives, against a dated list."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _draw("fetch", F.col("page_id"), 366).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    return urlfilter.judge(captures, filter_log(captures))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("removal_spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and reordered."""
    return middle.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document."""
    return runs.report(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_mixing": op1_mixing, "op2_warc_fixity": op2_warc_fixity, "op3_fingerprint": op3_fingerprint, "op4_language": op4_language, "op5_neardup": op5_neardup, "op6_url_filter": op6_url_filter, "op7_decontamination": op7_decontamination, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_pii": op10_pii, "op11_middle": op11_middle, "op12_periodic_runs": op12_periodic_runs, "op13_packing": op13_packing, "pipeline": pipeline.run}

ORACLES: dict[str, str] = oracles.ORACLES
