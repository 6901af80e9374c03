import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import controller, metrics
from marlstone.plans import catalog, training_rows
from marlstone.sources import readers, writers
from marlstone.streaming import ingest, replay


def test_listing_and_columns(spark, tmp_path):
    spark.range(10).withColumn("x", F.lit(1)).repartition(2).write.parquet(str(tmp_path / "a"))
    assert readers.list_files(spark, str(tmp_path)).count() == 2
    assert readers.list_files(spark, str(tmp_path), first=1).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.list_files(spark, str(tmp_path), "*.none")
    assert readers.parquet(spark, str(tmp_path / "a"), ["x"], every_file=True).columns == ["x"]
    with pytest.raises(ValueError, match="lacks y"):
        readers.parquet(spark, str(tmp_path / "a"), ["x", "y"])
    assert readers.row_count(spark, str(tmp_path / "a")) == 10
    assert readers.file_rows(spark.read.parquet(str(tmp_path / "a")), 2).count() == 4
    assert readers.wanted_or_all(spark.range(1), ["no"]).columns == ["id"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"step": 1, "loss": 2.5}\n\n{"step": 2}\nbroken\n[1]\n')
    assert sorted(r.step for r in readers.jsonl(spark, str(p), "step bigint, loss double", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(p), "step bigint, loss double").collect()


def test_lines_of_several_files_keep_file_order(spark, tmp_path):
    """The later file is the larger one, and file 10 follows file 2."""
    put = lambda n, loss, rows: (tmp_path / f"metrics.{n}-0.jsonl").write_text("\n".join(json.dumps({"step": s + 1, "loss": loss}) for s in range(rows)))
    put(0, 1.0, 3), put(2, 2.0, 3000), put(10, 3.0, 2)
    rows = readers.jsonl(spark, str(tmp_path), "step bigint, loss double")
    got = {r.step: r.loss for r in metrics.last_wins(rows, ["step"], ["line"]).where("step <= 3").collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 2.0}
    assert [r.step for r in rows.orderBy("line").limit(5).collect()] == [1, 2, 3, 1, 2]
    (tmp_path / "metrics.11-0.jsonl").write_text('{"step": 1}\n{"step": ')
    with pytest.raises(Exception, match="metrics.11-0.jsonl: malformed line"):
        readers.jsonl(spark, str(tmp_path), "step bigint, loss double").collect()


def test_csv_logs_genes(spark, tmp_path):
    (tmp_path / "k.csv").write_text("path,n\na,1\na,2\n")
    with pytest.raises(ValueError, match="repeated path"):
        readers.keyed_csv(spark, str(tmp_path / "k.csv"), "path string, n int", "path")
    (tmp_path / "l.txt").write_text("args={\"lr\": 0.5}\n[e: 1, 20/300] update_step=17\nsaved step_40.pt\nValueError nan\n")
    rows = readers.log_lines(spark, str(tmp_path / "l.txt")).orderBy("line").collect()
    assert (rows[1].epoch, rows[1].batch, rows[1].batches, rows[1].update_step) == (1, 20, 300, 17)
    assert rows[2].checkpoint_step == 40 and rows[3].alarm and not rows[1].alarm
    assert readers.start_arguments(spark, str(tmp_path / "l.txt"), "lr double").first().lr == 0.5
    genes = readers.gene_list(spark.createDataFrame([(0, "x", " B "), (1, "x", "a"), (2, "x", "b"), (3, "x", "")], "ord int, c string, Gene_name string"))
    assert [(r.ord, r.gene) for r in genes.orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "g.json").write_text(json.dumps({"ENS1.2": "A", "ens1": "B", "e2": " ", "e3": None}))
    assert [tuple(r) for r in readers.gene_map(spark, str(tmp_path / "g.json")).collect()] == [("ens1", "B")]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate\n3 4 2\n1 2 5.0\n3 4 1.5\n")
    assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 1, 5.0), (2, 3, 1.5)]


def test_cuts(spark):
    df = spark.createDataFrame([("f", 1, 5), ("f", 2, None), ("f", 3, 9), ("f", 4, 2)], "file string, line int, update_step int")
    assert [r.line for r in readers.up_to_step(df, 5).orderBy("line").collect()] == [1, 2, 4]
    assert [r.line for r in readers.log_up_to_step(df, 5).orderBy("line").collect()] == [1, 2]


def test_writers(spark, tmp_path):
    t = str(tmp_path / "t")
    writers.replace_rows(spark, t, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    writers.replace_rows(spark, t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(FileExistsError):
        writers.prepare_output(spark, str(tmp_path), "part")
    (tmp_path / "part_1").write_text("x")
    writers.prepare_output(spark, str(tmp_path), "part", overwrite=True)
    assert not (tmp_path / "part_1").exists() and (tmp_path / "t").exists()
    chunks, listed = training_rows.shards(spark.range(25), 3, ["id"], 10)
    got = writers.shards(chunks.drop("row"), str(tmp_path / "s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))
    with pytest.raises(ValueError):
        writers.checked(spark.range(3), str(tmp_path / "c"), 4)
    writers.csv(listed, str(tmp_path / "m"), ["start_row"])
    writers.jsonl(listed, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streamed_upsert_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"run": r, "step": s % 5, "line": 10 * s + r, "loss": float(s)} for s in range(12) for r in range(2)]
    for i in range(3):
        (src / f"{i}.jsonl").write_text("\n".join(map(json.dumps, rows[i::3])) + "\nbroken\n")
    stream = ingest.metric_stream(spark, str(src), "run bigint, step bigint, line bigint, loss double", 1)
    ingest.upsert_metrics(stream, str(tmp_path / "t"), str(tmp_path / "s"))
    want = {}
    for r in sorted(rows, key=lambda r: r["line"]):
        want[r["run"], r["step"]] = r["loss"]
    assert {(r.run, r.step): r.loss for r in spark.read.parquet(str(tmp_path / "t")).collect()} == want


def test_streamed_controller_equals_fold(spark, tmp_path):
    rows = [(r, s, abs((s * 37 + r * 11) % 23) * (1.0 + r / 2)) for r in range(4) for s in range(30)]
    df = spark.createDataFrame(rows, "run bigint, step bigint, norm double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = replay.replay_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("replayed").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.run: (tuple(r)[1:-2], r.aborted_at, r.reason) for r in spark.table("replayed").collect()}
    want = {r.run: (tuple(r)[1:-2], -1 if r.reason is None else r.aborted_at, r.reason or "") for r in controller.replay(df).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1:] == want[k][1:]


def test_plans(spark):
    coo = spark.createDataFrame([(1, "a", 0, 2.0), (1, "a", 3, 1.0), (1, "b", 1, 1.0), (2, "b", 1, 5.0), (2, "zz", 2, 9.0)], "cell_id bigint, symbol string, pos int, value double")
    obs = spark.createDataFrame([(1, "s1"), (2, "s2")], "cell_id bigint, accession string")
    meta = spark.createDataFrame([("s1", "Big Liver"), ("s1", "Zeta"), ("s3", "x")], "accession string, tissue string")
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, gene string")
    lookup = spark.createDataFrame([("tissue", 7, "big_liver")], "column string, id bigint, label string")
    rows = {r.cell_id: r for r in training_rows.training_rows(coo, obs, meta, genes, lookup, ["tissue"], 1, raw=True).collect()}
    assert rows[1].x == [3.0, 1.0, 0.0] and rows[2].x == [0.0, 5.0, 0.0]
    assert (rows[1].tissue_id, rows[2].tissue_id) == (7, -1)
    log = spark.createDataFrame([(1, i, i, 100.0 - i, 1.0, False, False, 0.1) for i in range(1, 80)] + [(2, 1, 1, 5.0, 2.0, True, False, 0.1)],
                                "run bigint, line bigint, step bigint, loss double, norm double, clipped boolean, skipped boolean, lr double")
    names = spark.createDataFrame([(1, "training_output_100m_data_1_x_20260501_101010"), (2, "training_output_100m_data_1_y_20260502_101010")], "id bigint, name string")
    t = catalog.tables(log, names, 10)
    assert [tuple(r)[:2] for r in t["run_relationships"].collect()] == [(1, 2)]
    assert t["metric_series"].where("run = 1").count() == 11
    assert {r.event for r in t["diagnostic_events"].where("run = 1").collect()} >= {"converged"}
    assert catalog.compare(t["metric_series"], [1, 2]).where("step = 1").first()["2"] == 5.0
    assert catalog.presence_mask(spark.createDataFrame([(1, None), (None, 2)], "a int, b int"), ["a", "b"]).agg(F.sum("present")).first()[0] == 3
