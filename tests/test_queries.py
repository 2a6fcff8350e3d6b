"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quire.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL: set[str] = set()


def twin(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def shown(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_twin(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    names, expected = twin(plans.ORACLES[name], sf)
    assert sorted(names) == sorted(df.columns)
    assert shown(df.columns, df.collect()) == shown(names, expected)


def test_all_others_are_known():
    assert set(plans.QUERIES) - set(plans.ORACLES) == WITHOUT_SQL


def test_expand_with(spark, sf):
    lines = sum(r.text.count("\n") + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())
    got = plans.QUERIES["expand_with"](spark, sf)
    assert got.count() == lines
    assert got.where("reject_reason is not null").count() == 0


def test_stream_replay_over_batches(spark, tmp_path):
    from quire.streaming.replay import stream_replay

    batches = [[(1, 4, 10, 1, "move", 0, 3)], [(1, 4, 20, 2, "toggle", 0, None), (1, 4, 30, 3, "delete", None, None)], [(1, 4, 5, 4, "move", 0, 1)], [(1, 4, 15, 5, "reset", None, None)], [(1, 4, 12, 6, "move", 2, 0)]]
    schema = "doc_id bigint, n int, at bigint, seq bigint, op string, a int, b int"
    store = "spark.sql.streaming.stateStore.providerClass"
    was, got = spark.conf.get(store), []
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            edits = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("doc_id", "n", "timestamp_seconds(at) AS ts", "seq", "op", "a", "b")
            keep = lambda rows, _: got.extend((list(r.ord), r.n_late) for r in rows.collect())
            stream_replay(edits).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, was)
    assert got == [([1, 2, 3, 0], 0), ([2, 3, 0], 0), ([2, 3, 1], 1), ([1, 2, 3], 1), ([1, 2, 3], 1)]


@pytest.mark.parametrize("name", ["delete_pages", "delete_selected", "save_edits"])
def test_payload_moves_once(spark, name):
    from quire.operators import pages, replay

    rows = spark.range(50).selectExpr("id % 5 AS doc_id", "cast(id / 5 AS int) AS pos", "cast(id / 5 AS int) AS page_index", "concat('long', id) AS payload")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        if name == "delete_pages":
            made = pages.delete_pages(rows, rows.where("page_index = 2").select("doc_id", "page_index"))
        elif name == "delete_selected":
            made = pages.delete_selected(rows, rows.where("pos = 2").select("doc_id", "pos")).accepted
        else:
            docs = spark.range(5).selectExpr("id AS doc_id", "10 AS page_count", "'a.pdf' AS name")
            log = docs.selectExpr("doc_id", "timestamp_seconds(1) AS ts", "1L AS seq", "'move' AS op", "0 AS a", "3 AS b")
            made = replay.save_edits(rows, replay.replay_edits(docs, log), docs).accepted
        assert made.count() == (50 if name == "save_edits" else 45)
        made.collect()
        node, moved = made._jdf.queryExecution().optimizedPlan().toString(), 0
        plan = made._jdf.queryExecution().sparkPlan()
        physical = made._jdf.queryExecution().executedPlan().initialPlan().toString() if hasattr(made._jdf.queryExecution().executedPlan(), "initialPlan") else plan.toString()
        lines = physical.split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line and "payload" in " ".join(lines[i + 1 : i + 2]):
                moved += 1
        assert node
        assert moved == 1, physical
    finally:
        spark.conf.set(conf, was)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
