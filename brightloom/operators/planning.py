"""Factorial designs, execution plans, campaign states, costs, shards and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions.draws import hash_number, stable_id, stable_seed
from brightloom.operators.ordered import hash_range, with_ahead


def factorial_cells(tasks: DataFrame, models: DataFrame, replicates: int, stage: str, base_seed: int) -> DataFrame:
    """Every task with every model and replicate, with stable ids and seeds. The product is the
    design itself; its factors are small tables of tasks and models."""
    cells = tasks.crossJoin(F.broadcast(models)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("stage_id", F.lit(stage))
    seeded = cells.withColumn("seed", stable_seed(F.lit(base_seed), F.col("stage_id"), F.col("model_id"), F.col("task_id"), F.col("replicate")))
    return seeded.withColumn("cell_id", stable_id("PCELL", 24, F.col("stage_id"), F.col("model_id"), F.col("task_id"), F.col("replicate"), F.col("seed")))


def campaign_cells(cells: DataFrame, qualified: DataFrame, prices: DataFrame, input_tokens: int = 300, output_tokens: int = 8000) -> DataFrame:
    """Cells with their state (blocked without qualification or price, else ready) and estimated cost."""
    cost = F.col("request_fee") + F.lit(float(input_tokens)) * F.col("input_per_million") / 1e6 + F.lit(float(output_tokens)) * F.col("output_per_million") / 1e6
    out = cells.join(qualified.select("model_id", "qualified"), "model_id", "left").join(prices, "model_id", "left").withColumn("estimated_cost", cost)
    state = F.when(~F.coalesce("qualified", F.lit(False)), "blocked-qualification").when(F.col("estimated_cost").isNull(), "blocked-price").otherwise("ready")
    return out.withColumn("state", state).drop("qualified", "input_per_million", "output_per_million", "request_fee")


def campaign_shards(cells: DataFrame, size: int = 24) -> DataFrame:
    """Ready cells of a stage and model in runs of ``size``, by task and replicate."""
    order = Window.partitionBy("stage_id", "model_id").orderBy("task_id", "replicate")
    placed = cells.where("state = 'ready'").withColumn("n", F.row_number().over(order) - 1).withColumn("shard", F.floor(F.col("n") / size))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cell_id"))), lambda x: x["cell_id"]), ",")
    return placed.groupBy("stage_id", "model_id", "shard").agg(F.count("*").alias("cells"), F.sum("estimated_cost").alias("estimated_cost"), F.sha2(ids.cast("binary"), 256).alias("cells_sha256"))


def budget_gate(cells: DataFrame, reserve: float = 0.15, hard_budget: float | None = None, required: bool = True) -> DataFrame:
    """One row: known cost of all priced cells, with reserve, unpriced ready cells, and the gate."""
    total = cells.agg(F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("estimated_cost"), F.count_if((F.col("state") == "ready") & F.col("estimated_cost").isNull()).alias("unknown_cost_cells"), F.count("*").alias("cells"))
    out = total.withColumn("with_reserve", F.col("estimated_cost") * (1 + reserve))
    if hard_budget is None:
        rest = F.lit("blocked-no-hard-budget" if required else "advisory-no-hard-budget")
    else:
        rest = F.when(F.col("with_reserve") > hard_budget, "blocked-budget-exceeded").otherwise("pass")
    return out.withColumn("gate", F.when(F.col("unknown_cost_cells") > 0, "blocked-unknown-prices").otherwise(rest))


def score_band(score: Column) -> Column:
    """Below 0.4 low, up to 0.7 boundary, else high."""
    return F.when(score < 0.4, "low").when(score <= 0.7, "boundary").otherwise("high")


def disagreement_band(value: Column) -> Column:
    """From 0.2 high."""
    return F.when(value >= 0.2, "high").otherwise("low")


def calibration_sample(candidates: DataFrame, target: int, seed: int) -> DataFrame:
    """A sample balanced over cells of (stratum, model, score band, disagreement band): cells take
    turns, in a hash order of cells, each giving its members in a hash order."""
    cell = F.concat_ws("|", "stratum", "model_id", F.when(F.col("valid"), score_band(F.col("score"))).otherwise("invalid"), disagreement_band(F.col("disagreement")))
    out = candidates.withColumn("sampling_cell", cell)
    out = out.withColumn("_h", hash_number(F.lit(seed), F.col("artifact_id"))).withColumn("_c", hash_number(F.lit(seed), F.lit("cell"), F.col("sampling_cell")))
    out = out.withColumn("round", F.row_number().over(Window.partitionBy("sampling_cell").orderBy("_h", "artifact_id")))
    return out.orderBy("round", "_c", "sampling_cell").limit(target).select("artifact_id", "sampling_cell", "round")


def pairwise_tasks(selected: DataFrame, criteria: list[str], most: int, seed: int) -> DataFrame:
    """Within each task pairs of models (their first artifacts), at most ``most`` in a hash order, with
    hashed sides, for every criterion. A task has a row for each model before pairs are made."""
    first = selected.groupBy("task_id", "model_id").agg(F.min("artifact_id").alias("artifact_id"))
    a, b = (first.select("task_id", F.col("model_id").alias(f"m{k}"), F.col("artifact_id").alias(f"a{k}")) for k in (1, 2))
    pairs = a.join(b, "task_id").where("m1 < m2").withColumn("_h", hash_number(F.lit(seed), F.col("task_id"), F.col("m1"), F.col("m2")))
    kept = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy("_h", "m1", "m2"))).where(F.col("_n") <= most)
    swap = F.col("_h") % 2 == 1
    sided = kept.select("task_id", F.when(swap, F.col("a2")).otherwise(F.col("a1")).alias("left_id"), F.when(swap, F.col("a1")).otherwise(F.col("a2")).alias("right_id"))
    out = sided.withColumn("criterion", F.explode(F.array(*[F.lit(c) for c in criteria])))
    return out.withColumn("pair_id", stable_id("PAIR", 20, F.col("task_id"), F.col("left_id"), F.col("right_id"), F.col("criterion"), F.lit(seed)))


def calibration_design(candidates: DataFrame, target: int, seed: int, criteria: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(sample, pairs): a balanced sample of ``candidates`` (with task_id), and the pairs of models within tasks that
    its artifacts alone give."""
    sample = calibration_sample(candidates, target, seed)
    chosen = candidates.join(sample.select("artifact_id"), "artifact_id", "left_semi").select("task_id", "model_id", "artifact_id")
    return sample, pairwise_tasks(chosen, criteria, most, seed)


def next_ready(cells: DataFrame, limit: int) -> DataFrame:
    """The next ready cells by stage, model, task and replicate."""
    return cells.where("state = 'ready'").orderBy("stage_id", "model_id", "task_id", "replicate").limit(limit)


def split_sealed(tasks: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``tasks`` with sealed: heritage tasks stay public, of the rest the first share in hash order."""
    hashed = tasks.withColumn("_h", hash_number(F.lit(seed), F.col("task_id")))
    placed = with_ahead(hashed, ["is_heritage"], hash_range(F.col("_h"), 48), ["_h", "task_id"], {"_before": F.lit(1)})
    rest = tasks.agg(F.count_if(~F.col("is_heritage")).alias("_n"))
    return placed.join(F.broadcast(rest)).select(*tasks.columns, (~F.col("is_heritage") & (F.col("_before") < F.round(F.col("_n") * fraction))).alias("sealed"))


def set_commitment(tasks: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the hash of the sorted identities, whatever their order of arrival."""
    rows = F.array_sort(F.collect_list(F.concat_ws("\x1f", *columns)))
    return tasks.agg(F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("commitment"), F.count("*").alias("tasks"))


def qualification_plan(tasks: DataFrame, models: DataFrame, base_seed: int) -> DataFrame:
    """Every task with every model; seed = base + 10 000 * model index + task index."""
    m = models.withColumn("mi", F.row_number().over(Window.orderBy("model_id")) - 1)
    t = tasks.withColumn("ti", F.row_number().over(Window.orderBy("task_id")) - 1)
    out = t.crossJoin(F.broadcast(m)).withColumn("seed", F.lit(base_seed) + F.col("mi") * 10000 + F.col("ti"))
    return out.withColumn("cell_id", stable_id("QCELL", 20, F.col("model_id"), F.col("task_id"), F.col("seed"))).drop("mi", "ti")


def merge_replicates(scores: DataFrame, replicates: int, coverage: float = 0.8) -> DataFrame:
    """By model: expected and scored cells, whether each wave's coverage suffices, and over tasks with
    all replicates the mean, deviation and exact agreement. Columns: model_id, task_id, replicate, score."""
    tasks = scores.groupBy("model_id", "task_id").agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"), F.count_distinct("score").alias("values"), F.count("*").alias("planned"))
    full = F.col("n") == replicates
    return tasks.groupBy("model_id").agg(
        F.sum("planned").alias("planned"), F.sum("n").alias("scored"), (F.sum("n") / F.sum("planned") >= coverage).alias("eligible"), F.count_if(full).alias("complete_tasks"),
        F.avg(F.when(full, F.col("m"))).alias("complete_mean"), F.avg(F.when(full, F.col("sd"))).alias("mean_spread"), F.avg(F.when(full, (F.col("values") == 1).cast("double"))).alias("exact_agreement"),
    )
