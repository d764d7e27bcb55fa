"""Queries against their DuckDB SQL on tables where both could part."""

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, query, **tables):
    """The rows of a query and of its SQL over ``tables``, sorted."""
    db = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    key = lambda row: [(x is not None, str(x)) for x in row]
    return sorted((tuple(r) for r in entry.queries()[query](spark, str(folder)).collect()), key=key), sorted(db.execute(entry.oracle_sql()[query]).fetchall(), key=key)


@pytest.mark.parametrize("texts", [
    ["ends in &amp", "cut &am", "&ampamp;&amplt;&AMP&lt x&ltimes;y&copysr;&notit;&notin", "&#38;#38;&#65;&#x42 &#128;&#0;&#1;&#xD800;&#99999999999999999999;&#xfffe;", "a&nbsp;&#8195; b c d", None, "", "&", "&&;& &;", "&NotEqualTilde;&quot"],
    ["none at all", None],
])
def test_page_texts_know_references_with_and_without_semicolons(spark, tmp_path, texts):
    pages = spark.createDataFrame([(i, t if t is None else f"<title>{t}</title><style>p{{}}</style><p>{t}<!-- x --></p>") for i, t in enumerate(texts)], "page_id long, html string")
    mine, theirs = both(spark, tmp_path, "page_texts", pages=pages)
    assert mine == theirs and len(mine) == len(texts)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_ledger_reconcile_does_not_leave_a_hundredth_to_the_order_of_a_sum(spark, tmp_path):
    lost = {7: 0.01, 8: 0.02, 9: 0.0}  # value of the event that the log with gaps lacks, by user
    events = [(5 + 211 * (50 * u + 2 * k), None, u, "view", v, "{}") for u, v in lost.items() for k in range(25)]
    events += [(5 + 211 * (50 * u + 2 * k) + 1, None, u, "view", 560.21 + k * 33.33, "{}") for u in lost for k in range(25)]
    mine, theirs = both(spark, tmp_path, "ledger_reconcile", events=spark.createDataFrame(events, EVENTS))
    assert mine == theirs and [r[0] for r in mine] == ["7", "8"]
    one = [(5 + 211 * u, None, u, "view", 0.01, "{}") for u in range(10, 40)] + [(6 + 211 * u, None, u, "view", round(100 + u * 37.77, 2), "{}") for u in range(10, 40)]
    mine, theirs = both(spark, tmp_path, "ledger_reconcile", events=spark.createDataFrame(one, EVENTS))
    assert mine == theirs == []  # a hundredth is not more than one, whatever its sums look like


def test_state_costs_that_no_decimal_holds_are_still_summed(spark):
    from brightloom.operators import ledger

    events = spark.createDataFrame([(1, "a", "leased", 1e300), (2, "a", "ready", 2.0), (1, "b", "leased", None), (1, "c", "leased", 0.1), (2, "c", "ready", 0.2)], "sequence long, cell_id string, new_state string, cost double")
    assert {r["cell_id"]: r["cost"] for r in ledger.current_states(events).collect()} == {"a": 1e300, "b": None, "c": 0.3}


def test_log_findings_of_one_long_log(spark, tmp_path):
    kinds = ["view", "click", "view", "error", "signup", "purchase", "click"]
    events = [(k, None, 50 * (k % 3), kinds[k % 7], 4.0 + k % 11, "{}") for k in range(3000)]
    for query in ("appended_events", "log_findings"):
        mine, theirs = both(spark, tmp_path, query, events=spark.createDataFrame(events, EVENTS))
        assert mine == theirs and len(mine) > 10
    plan = entry.queries()["log_findings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
