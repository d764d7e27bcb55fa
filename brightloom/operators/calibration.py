"""Responses of a human calibration study: stage-wise validation and analysis.

A response is a row with stage, response (a map of field to text) and what was shown: artifact_id,
duplicate_group_id and the expected labels (expected_animal, expected_mobile_object,
expected_relation), each of which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.draws import stable_id
from brightloom.functions.names import free
from brightloom.operators.annotate import normalised_label
from brightloom.operators.integrity import SENSITIVE
from brightloom.operators.ratings import agreement_figures

# Fields that each stage needs, by kind, and the labels that are judged.
OPEN_TEXT = {"animal_open_text": "expected_animal", "mobile_object_open_text": "expected_mobile_object", "relation_open_text": "expected_relation"}
RATINGS = ("animal_rating_1_to_5", "object_rating_1_to_5", "interaction_rating_1_to_5")
REQUIRED = {
    "blind-recognition": (*OPEN_TEXT, "recognition_confidence"),
    "prompt-aware-criteria": ("animal_defects", "object_defects", "interaction_defects", *RATINGS, "criterion_confidence"),
    "pairwise-preference": ("pairwise_winner",),
}
PERCENT = {"blind-recognition": ("recognition_confidence",), "prompt-aware-criteria": ("criterion_confidence",)}
WHOLE = {"prompt-aware-criteria": RATINGS}
WINNERS = ("a", "b", "tie")


def _field(name: str) -> Column:
    return F.element_at("response", F.lit(name))


def _number(name: str) -> Column:
    """The finite number that a field states; null for anything else."""
    return _finite(F.trim(_field(name)).try_cast("double"))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _by_stage(per_stage: dict[str, Column]) -> Column:
    out = F.array().cast("array<string>")
    for stage, names in per_stage.items():
        out = F.when(F.col("stage") == stage, names).otherwise(out)
    return out


def _opened(responses: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``responses`` with a column for each field that a stage needs, and one for the number in it where it has to
    be one; and those columns by field. The map is opened once a row, not once for each rule."""
    fields = list(dict.fromkeys(n for names in REQUIRED.values() for n in names))
    numeric = [n for n in fields if any(n in names for kind in (PERCENT, WHOLE) for names in kind.values())]
    texts, raw, numbers = (free(responses, *[f"_{kind}_{n}" for n in names]) for kind, names in (("text", fields), ("raw", numeric), ("number", numeric)))
    text, x = dict(zip(fields, texts, strict=True)), dict(zip(numeric, raw, strict=True))
    out = responses.select("*", *[_field(n).alias(text[n]) for n in fields])
    out = out.select("*", *[F.trim(F.col(text[n])).try_cast("double").alias(x[n]) for n in numeric])
    out = out.select(*[c for c in out.columns if c not in raw], *[_finite(F.col(x[n])).alias(c) for n, c in zip(numeric, numbers, strict=True)])
    return out, {n: F.col(c) for n, c in text.items()}, {n: F.col(c) for n, c in zip(numeric, numbers, strict=True)}


def _judged(responses: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``validated`` with the columns of ``_opened``."""
    opened, text, number = _opened(responses)
    absent = lambda n: F.coalesce(text[n], F.lit("")).isin("", "[]")
    missing, invalid = {}, {}
    for stage, names in REQUIRED.items():
        missing[stage] = F.array_compact(F.array(*[F.when(absent(n), F.lit(n)) for n in names]))
        wrong = [F.when(~absent(n) & ~F.coalesce(number[n].between(0, 100), F.lit(False)), F.lit(n)) for n in PERCENT.get(stage, ())]
        wrong += [F.when(~absent(n) & ~F.coalesce(number[n].between(1, 5) & (number[n] == F.floor(number[n])), F.lit(False)), F.lit(n)) for n in WHOLE.get(stage, ())]
        if "pairwise_winner" in names:
            wrong.append(F.when(~F.coalesce(F.lower(F.trim(text["pairwise_winner"])), F.lit("")).isin(*WINNERS), F.lit("pairwise_winner")))
        invalid[stage] = F.array_sort(F.array_compact(F.array(*wrong)))
    keys = F.transform(F.map_keys("response"), lambda k: F.lower(F.trim(k)))
    out = (
        opened.withColumn("missing_fields", _by_stage(missing)).withColumn("invalid_fields", _by_stage(invalid))
        .withColumn("prohibited_fields", F.array_sort(F.array_intersect(keys, F.array(*[F.lit(s) for s in SENSITIVE]))))
    )
    clean = (F.size("missing_fields") == 0) & (F.size("invalid_fields") == 0) & (F.size("prohibited_fields") == 0)
    return out.withColumn("valid", F.coalesce(F.col("stage").isin(*REQUIRED) & F.col("response").isNotNull() & clean, F.lit(False))), text, number


def validated(responses: DataFrame) -> DataFrame:
    """``responses`` with the names of missing, invalid and prohibited fields, and valid. Confidences are
    from 0 to 100, ratings whole numbers from 1 to 5, winners a, b or tie. An unknown stage and a null
    response are invalid."""
    return _judged(responses)[0].select(*[F.col("`" + c.replace("`", "``") + "`") for c in responses.columns], "missing_fields", "invalid_fields", "prohibited_fields", "valid")


def analysis(responses: DataFrame) -> DataFrame:
    """(figure, name, value): responses received, valid and invalid; valid ones by stage; accuracy of each
    open label and of the whole scene over comparable responses (0 without any); the Brier score of
    the stated confidence; mean ratings; winners as written; consistency of each label within
    duplicate groups and its nominal alpha over artifacts (absent without a pair)."""
    label = lambda c: normalised_label(F.trim(c))
    judged, text, number = _judged(responses)
    base = judged.select(
        "stage", "valid", "duplicate_group_id", "artifact_id", text["pairwise_winner"].alias("winner"), number["recognition_confidence"].alias("confidence"),
        *[label(text[n]).alias(n) for n in OPEN_TEXT], *[label(F.col(e)).alias(e) for e in OPEN_TEXT.values()], *[number[n].alias(n) for n in RATINGS],
    )
    blind = (F.col("stage") == "blind-recognition") & F.col("valid")
    criteria = (F.col("stage") == "prompt-aware-criteria") & F.col("valid")
    right = {n: F.col(n) == F.col(e) for n, e in OPEN_TEXT.items()}
    whole, shown = F.lit(True), F.lit(True)
    for n, e in OPEN_TEXT.items():
        whole, shown = whole & right[n], shown & F.col(e).isNotNull()
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(of & hit), F.count_if(of)), F.lit(0.0))
    miss = F.col("confidence") / 100 - F.when(whole, 1.0).otherwise(0.0)
    figures = [("responses", "received", F.count("*")), ("responses", "valid", F.count_if("valid")), ("responses", "invalid", F.count_if(~F.col("valid")))]
    figures += [("stage", s, F.count_if(F.col("valid") & (F.col("stage") == s))) for s in REQUIRED]
    figures += [("accuracy", n, share(right[n], blind & F.col(e).isNotNull())) for n, e in OPEN_TEXT.items()]
    figures += [("accuracy", "scene", share(whole, blind & shown)), ("brier", "recognition", F.coalesce(F.avg(F.when(blind & shown, miss * miss)), F.lit(0.0)))]
    figures += [("mean-rating", n, F.avg(F.when(criteria, F.col(n)))) for n in RATINGS]
    one = base.agg(*[v.cast("double").alias(f"f{k}") for k, (_, _, v) in enumerate(figures)])
    rows = F.array(*[F.struct(F.lit(kind).alias("figure"), F.lit(name).alias("name"), F.col(f"f{k}").alias("value")) for k, (kind, name, _) in enumerate(figures)])
    out = one.select(F.explode(rows).alias("r")).select("r.*").where("value is not null and (figure <> 'stage' or value > 0)")
    winners = base.where((F.col("stage") == "pairwise-preference") & F.col("valid")).groupBy(F.col("winner").alias("name")).agg(F.count("*").cast("double").alias("value"))
    # one row for each label and grouping; what is not grouped drops out
    grouping = lambda figure, item: F.struct(F.lit(figure).alias("figure"), F.col(item).cast("string").alias("item"))
    named = base.where(blind).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("category")) for n in OPEN_TEXT])).alias("l"), F.array(grouping("duplicate-consistency", "duplicate_group_id"), grouping("alpha", "artifact_id")).alias("groups"))
    each = named.select("l.name", "l.category", F.explode("groups").alias("g")).select("g.figure", "g.item", "name", "category").where("item <> ''")
    agreed = agreement_figures(each, ["figure", "name"])
    agreed = agreed.select("figure", "name", F.when(F.col("figure") == "alpha", F.col("alpha")).otherwise(F.col("consistency")).alias("value")).where("value is not null")
    return out.union(winners.select(F.lit("winner").alias("figure"), "name", "value")).union(agreed)


# When responses to an artifact need another look.
MODAL_SHARE, RANGE, CONFIDENCE = 2 / 3, 2.0, 50.0


def adjudication_queue(responses: DataFrame, modal_share: float = MODAL_SHARE, rating_range: float = RANGE, confidence: float = CONFIDENCE) -> DataFrame:
    """(item_id, artifact_id, stage, field, reason, values, share) of artifacts whose responses disagree: open
    labels whose commonest value has less than ``modal_share`` of several, ratings that lie
    ``rating_range`` or more apart, and recognition with a low mean confidence. ``values`` are the
    counts, as value=n joined by ';'. Ids are hashes of all of these."""
    known = responses.where("artifact_id is not null and artifact_id <> '' and response is not null")
    blind = F.col("stage") == "blind-recognition"
    open_text = F.array(*[F.struct(F.lit(n).alias("field"), normalised_label(F.trim(_field(n))).alias("value"), F.lit(None).cast("double").alias("x")) for n in OPEN_TEXT])
    rated = F.array(*[F.struct(F.lit(n).alias("field"), _number(n).cast("string").alias("value"), _number(n).alias("x")) for n in RATINGS])
    each = known.select("artifact_id", "stage", F.explode(F.when(blind, open_text).otherwise(rated)).alias("f")).select("artifact_id", "stage", "f.*").where("value is not null")
    counted = each.groupBy("artifact_id", "stage", "field", "value").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda v: F.concat(v["value"], F.lit("="), v["n"].cast("string"))), ";")
    fields = counted.groupBy("artifact_id", "stage", "field").agg(F.sum("n").alias("total"), (F.max("n") / F.sum("n")).alias("share"), (F.max("x") - F.min("x")).alias("range"), shown.alias("values"))
    reason = F.when(F.col("range").isNull() & (F.col("share") < modal_share), "inter-rater-label-disagreement").when(F.col("range") >= rating_range, "criterion-rating-range")
    labels = fields.where("total >= 2").withColumn("reason", reason).where("reason is not null").select("artifact_id", "stage", "field", "reason", "values", "share")
    sure = known.where(blind).groupBy("artifact_id", "stage").agg(F.avg(_number("recognition_confidence")).alias("mean"), F.count(_number("recognition_confidence")).alias("n")).where(F.col("mean") < confidence)
    unsure = sure.select("artifact_id", "stage", F.lit("recognition_confidence").alias("field"), F.lit("low-mean-recognition-confidence").alias("reason"), F.concat(F.lit("observations="), F.col("n").cast("string")).alias("values"), (F.col("mean") / 100).alias("share"))
    return labels.union(unsure).select(stable_id("ADJ", 20, F.col("artifact_id"), F.col("stage"), F.col("field"), F.col("reason"), F.col("values")).alias("item_id"), "*")
