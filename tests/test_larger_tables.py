"""Queries against their SQL where the tables are larger than the test tables."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.functions import scalars
from marlstone.operators import lineage


def test_size_texts_beyond_one_gib(spark, tmp_path):
    pages = spark.range(2_000_000, step=997).union(spark.range(1040, 1060)).withColumnRenamed("id", "page_id")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"create or replace temp view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(f"select page_id, shown, kib, mib from ({entry.oracle_sql()['size_texts']})").fetchall()
    got = entry.queries()["size_texts"](spark, str(tmp_path)).select("page_id", "shown", "kib", "mib").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_readable_bytes_are_exact(spark):
    sizes = [1023, 1152, 1408, 1048575, 2**30, 3 * 2**40 // 2, 2**63 - 1]
    shown = spark.createDataFrame([(x,) for x in sizes], "b bigint").select(scalars.readable_bytes(F.col("b")))
    assert [x[0] for x in shown.collect()] == ["1023 B", "1.12 KiB", "1.38 KiB", "1024.00 KiB", "1.00 GiB", "1.50 TiB", "8388608.00 TiB"]


def test_recent_parents_by_brute_force(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    kind = "id bigint, ord bigint, g bigint, a string, b bigint, tags array<string>"
    rows = [(i, i * 3 if i < 150 else i * 3 + 900 * (i // 50), pick(1, 2, None), pick("x", "y", "", "unknown", None), pick(1, 2, None), rng.sample(["t", "u", "from_scratch", "v"], rng.randint(0, 3))) for i in range(300)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 300, 7)]  # equal places in time
    weights = {"a": 3, "b": 2.5}
    for group in (None, "g"):
        want = []
        for c in rows:
            best = None
            for p in rows:
                if p[1] < c[1] and (not group or p[2] is not None and p[2] == c[2]):
                    gain = 3 * (p[3] == c[3] and c[3] not in (None, "", "unknown")) + 2.5 * (p[4] == c[4] and c[4] is not None)
                    score = round(0.02 * p[1] + gain + 1.2 * len((set(p[5]) & set(c[5])) - {"from_scratch"}), 6)
                    best = min(best or (1e9,), (-score, p[1], p[0]))
            if best:
                want.append((best[2], c[0], -best[0]))
        got = lineage.parents(spark.createDataFrame(rows, kind), weights, group, "tags", 0.02)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "p_ord" not in plan


def test_stability_verdict_at_ties(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 40, "2024-01-%02d 0%d:00:00" % (i // 40 + 1, i % 9), rng.choice(["click", "error", "view"]), rng.randint(1, 9999) / 100) for i in range(800)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duckdb.sql("set timezone = 'UTC'")
    duckdb.sql(f"create or replace temp view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql(entry.oracle_sql()["stability_verdict"])
    got = entry.queries()["stability_verdict"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
