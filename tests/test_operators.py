import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import arrays, scalars
from marlstone.operators import controller, encode, layout, lineage, metrics, ordering, quality, rules


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


# --- metrics


def test_last_wins_and_summary(spark):
    raw = [(1, 1, 1, 100.0), (1, 2, 2, 80.0), (1, 3, 2, 70.0), (1, 4, 3, 60.0), (1, 5, None, 1.0)]
    df = spark.createDataFrame(raw, "run int, line int, step bigint, loss double")
    one = metrics.last_wins(df, ["run", "step"], ["line"])
    assert rows(one, "step", "loss") == [(1, 100.0), (2, 70.0), (3, 60.0)]
    s = metrics.summarise(one.withColumn("norm", F.col("loss") / 10).withColumn("clipped", F.lit(1)).withColumn("skipped", F.lit(0))).first()
    assert (s.best_loss, s.best_step, s.final_loss, s.row_count, s.clip_count, s.skip_count) == (60.0, 3, 60.0, 3, 3, 0)


def test_last_known_keeps_earlier_values(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None)], "step int, line int, norm double")
    assert metrics.last_known(df, ["step"], "line", ["norm"]).first().norm == 5.0


@pytest.mark.parametrize("n,most,want", [(5, 5, 5), (6, 5, 4), (10, 5, 6), (11, 5, 5), (1, 5, 1)])
def test_downsample(spark, n, most, want):
    df = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("step"))
    got = metrics.downsample(df, most)
    assert got.count() == want and got.agg(F.max("step")).first()[0] == n - 1
    assert {r.aggregation for r in got.collect()} == {"raw" if n <= most else "stride"}


def test_smoothing_against_padding(spark):
    v = [float((i * 7) % 11) for i in range(9)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "run int, step int, v double")
    for width in (3, 4, 5):
        p = width // 2
        padded = [v[0]] * p + v + [v[-1]] * (width - 1 - p)
        want = [sum(padded[i : i + width]) / width for i in range(9)]
        got = [r.smooth for r in metrics.smoothed(df, "v", width).orderBy("step").collect()]
        assert got == pytest.approx(want)
    assert [r.smooth for r in metrics.smoothed(df, "v", 20).orderBy("step").collect()] == v


def test_empty_window_is_kept(spark):
    df = spark.createDataFrame([(5, 1.0, 2.0, 0.1, True, 1.0)], "step int, loss double, norm double, lr double, clipped boolean, threshold double")
    w = spark.createDataFrame([("a", 0, 5), ("b", 5, 9)], "window string, lo int, hi int")
    got = {r.window: r for r in metrics.interval_means(df, w).collect()}
    assert (got["a"].n_rows, got["a"].clip_rate, got["a"].mean_clip_ratio) == (1, 1.0, 0.5)
    assert (got["b"].n_rows, got["b"].mean_loss, got["b"].clip_rate) == (0, None, None)


def test_controller_matches_plain_python(spark):
    inf = float("inf")
    data = [(r, s, float((s * 13 + r * 5) % 19) * (1 + r)) for r in range(5) for s in range(25)] + [(9, 1, None), (8, 1, 1.0), (8, 2, float("nan")), (8, 3, inf)]
    df = spark.createDataFrame(data, "run int, step bigint, norm double")
    p = controller.Settings(10.0, 0.9, 1.5, 3.0, 30.0, 0.5, 20.0, 5, 3, 1.2, 45.0)
    reasons = set()
    for r in controller.replay(df, p).collect():
        s = controller.START
        for _, step, norm in sorted(x for x in data if x[0] == r.run):
            s = controller.next_state(s, step, norm, p)
        assert tuple(r)[1:11] == pytest.approx(s[:10]) and (r.aborted_at if r.reason else -1, r.reason or "") == s[10:]
        reasons.add(r.reason)
    assert {"hard_limit", None} <= reasons
    calm = controller.replay(spark.createDataFrame([(1, i, 1.0) for i in range(300)], "run int, step bigint, norm double")).first()
    assert (calm.clipped, calm.passed, calm.reason) == (200, 100, None)  # the static threshold holds for the warm-up
    three = controller.replay(spark.createDataFrame([(1, i, inf) for i in range(9)], "run int, step bigint, norm double"), p).first()
    assert (three.reason, three.aborted_at, three.skipped, three.observed) == ("skips_in_row", 2, 3, 0)


# --- rules


def diagnosed(spark, series):
    base = {"clip": 0.0, "skip": 0.0, "head": None, "other": None, "lr": None, "resumed": False, "other2": None}
    data = [(1, i, *[({**base, **x})[k] for k in ("step", "loss", "clip", "skip", "head", "other", "lr", "resumed", "other2")]) for i, x in enumerate(series)]
    df = spark.createDataFrame(data, "run int, line int, step bigint, loss double, clip double, skip double, head double, other double, lr double, resumed boolean, other2 double")
    return {r.event for r in rules.events(rules.features(df)).collect()}


def test_rules(spark):
    assert diagnosed(spark, [{"step": s, "loss": float(100 - s)} for s in range(1, 80)]) == {"converged"}
    assert "bad_plateau" in diagnosed(spark, [{"step": i, "loss": x} for i, x in enumerate([100.0, 20.0, 55.0, 58.0, 60.0])])
    assert {"clip_storm", "skip_loop"} <= diagnosed(spark, [{"step": s, "loss": 10.0 + s, "clip": 0.75, "skip": 0.35} for s in range(1, 8)])
    heads = [{"step": 1, "loss": 10.0, "head": 100.0, "other": 50.0, "lr": 1e-6}, {"step": 2, "loss": 12.0, "head": 18.0, "other": 53.0, "lr": 1e-7}]
    assert {"primary_head_failure", "lr_floor_freeze"} <= diagnosed(spark, heads)
    two = [{"step": 1, "loss": 10.0, "head": 100.0, "other": 50.0, "other2": 1.0}, {"step": 2, "loss": 9.0, "head": 18.0, "other": 5.0, "other2": 1.0}]
    assert "primary_head_failure" in diagnosed(spark, two) and "primary_head_failure" not in diagnosed(spark, [{**x, "other2": None} for x in two])
    assert "resume_boundary" in diagnosed(spark, [{"step": 1, "loss": 1.0}, {"step": 1, "loss": 2.0}])
    assert "resume_boundary" in diagnosed(spark, [{"step": 1, "loss": 1.0, "resumed": True}])
    assert diagnosed(spark, [{"step": 1, "loss": None}]) == set()


# --- quality


def test_array_checks(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, [1.0, 0.0, -2.0]), (2, [float("nan"), inf, 3.0]), (3, []), (4, [0.0, 0.0])], "id int, x array<double>")
    got = {r.id: r for r in quality.cell_reductions(df).collect()}
    assert (got[1].val_max, got[1].libsize, got[1].nnz, got[1].bad) == (1.0, -1.0, 1, 0)
    assert (got[2].val_max, got[2].bad, got[3].val_max, got[3].width) == (3.0, 2, 0.0, 0)
    assert rows(quality.shape_check(df, 3), "id") == [(2,), (3,), (4,)]
    logs = df.select("id", arrays.scaled_log1p(F.col("x")).alias("y")).where("id = 4").first()
    assert logs.y == [0.0, 0.0]


def test_runs_test_and_p(spark):
    df = spark.createDataFrame([(1, i, float(i % 2)) for i in range(20)] + [(2, i, 1.0) for i in range(3)], "g int, o int, v double")
    got = {r.g: r for r in quality.runs_test(df, "g", "o", "v").withColumn("p", quality.two_sided(F.col("z"))).collect()}
    assert got[1].runs == 20 and got[1].z > 4 and got[1].p == pytest.approx(math.erfc(got[1].z / math.sqrt(2)))
    assert got[2].z is None


def test_one_sided_rows_and_prototypes(spark):
    a = spark.createDataFrame([(i, i) for i in range(10) if i % 3], "k int, v int")
    b = spark.createDataFrame([(i, 0) for i in range(12) if i % 2], "k int, v int")
    assert tuple(quality.reconcile(a, b, ["k"], ["v"]).first()) == (3, 3, 3, 0.0)
    protos = spark.range(encode.MOST_PROTOTYPES + 1).select(F.col("id").alias("k"), F.array(F.lit(1.0)).alias("proto"))
    with pytest.raises(ValueError, match="prototypes"):
        encode.nearest(spark.createDataFrame([(1, [1.0])], "id int, vec array<double>"), protos, 1)


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, v int")
    b = spark.createDataFrame([(2, 6), (3, 7), (4, 1)], "k int, v int")
    assert tuple(quality.reconcile(a, b, ["k"], ["v"]).first()) == (2, 1, 1, 1.0)


# --- encoding


def test_lookup_ids_never_collide(spark):
    old = spark.createDataFrame([("c", 5, "x"), ("c", 0, "y")], "column string, id bigint, label string")
    seen = spark.createDataFrame([("c", "x"), ("c", "a"), ("d", "q")], "column string, label string")
    assert rows(encode.unified_lookup(old, seen), "column", "id", "label") == [("c", 0, "y"), ("c", 5, "x"), ("c", 6, "a"), ("d", 0, "q")]
    df = spark.createDataFrame([("x",), (None,), ("new",)], "c string")
    assert sorted(r.c_id for r in encode.encode(df, old, ["c"]).collect()) == [-1, -1, 5]


def test_fill_obs_does_not_multiply(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    meta = spark.createDataFrame([("a", "Big Liver"), ("a", "Zeta"), ("b", None)], "k string, tissue string")
    assert rows(encode.fill_obs(obs, meta, "k"), "id", "tissue") == [(1, "big_liver"), (2, "unknown"), (3, "unknown")]


def test_genes(spark):
    coo = spark.createDataFrame([(1, "ENS1.4", 0, 1.0), (1, "ens1.2", 3, 2.0), (1, "zz", 1, 0.0)], "cell_id int, gene string, pos int, value double")
    mapping = spark.createDataFrame([("ens1.9", "A"), ("", "B")], "gene_id string, symbol string")
    named = encode.symbols(coo, mapping)
    assert rows(encode.collapse_columns(named), "symbol", "value", "pos") == [("A", 3.0, 0), ("zz", 0.0, 1)]
    assert rows(encode.min_genes(coo, 2), "cell_id", "genes") == [(1, 2)] and encode.min_genes(coo, 3).count() == 0
    assert encode.keep_genes(coo, spark.createDataFrame([("Ens1",)], "gene string")).count() == 2


# --- layout


def test_global_order_and_chunks(spark):
    df = ordering.shuffled(spark.range(1000).repartition(7), 5, ["id"], 8)
    got = {r.id: r.row for r in df.collect()}
    assert sorted(got.values()) == list(range(1000))
    again = {r.id: r.row for r in ordering.shuffled(spark.range(1000).repartition(3), 5, ["id"], 32).collect()}
    assert got == again != {r.id: r.row for r in ordering.shuffled(spark.range(1000), 6, ["id"], 8).collect()}
    chunks = ordering.in_chunks(df, 300)
    assert chunks.count() == 900 and layout.manifest(chunks).count() == 3
    kept = layout.manifest(ordering.in_chunks(df, 300, keep_rest=True)).orderBy("start_row").collect()
    assert [tuple(r)[1:] for r in kept] == [(0, 300, 300), (300, 600, 300), (600, 900, 300), (900, 1000, 100)]


def test_provenance_errors(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    listed = spark.createDataFrame([("a", 1), ("b", 3)], "target_path string, batch_order int")
    assert rows(layout.source_ids(files, listed), "file", "source_file_id", "source_batch_id") == [("a", 0, 1), ("b", 1, 3)]
    with pytest.raises(ValueError, match="1 files without"):
        layout.source_ids(files, listed.limit(1))
    with pytest.raises(ValueError, match="1 paths listed twice"):
        layout.source_ids(files, listed.union(listed.limit(1)))


def test_choices(spark):
    df = spark.createDataFrame([("a",), ("b",)], "species string")
    assert layout.choose(df, "species", exclude=["a"]).count() == 1
    for bad in ({"include": ["z"]}, {"exclude": ["a", "b"]}):
        with pytest.raises(ValueError):
            layout.choose(df, "species", **bad)
    assert layout.sampled_ranks(10, 4, False) == (3, 12) and layout.sampled_ranks(10, 4, True) == (2, 8)
    assert layout.mixed_seed(1, 1, 1, 1) == 1_010_112


# --- catalogue


def test_names(spark):
    names = ["training_output_100m_data_1_2_3_stable_lr5em4_from_scratch_20260523_130351", "training_output_500m_stab_A_20260518_213646", "other", "x_20261399_999999"]
    got = lineage.parse_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert (got[0].started_at, got[0].model_size, got[0].data_recipe, got[0].experiment) == ("2026-05-23T13:03:51", "100m", "data_1_2_3", "stable_lr5em4_from_scratch")
    assert got[0].tags == ["stable", "lr5em4", "from_scratch"]
    assert (got[1].data_recipe, got[1].model_size, got[1].experiment, got[2].started_at, got[3].started_at) == ("", "500m", "stab_A", None, None)
    assert (got[2].model_size, got[2].experiment) == ("unknown", "other")


def test_parents_and_index(spark):
    runs = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "a"), (4, 4, "a")], "id int, ord int, data string")
    assert rows(lineage.parents(runs, {"data": 3}), "child", "parent", "score") == [(2, 1, 0), (3, 1, 3), (4, 1, 3)]
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "run int, fingerprint string")
    state = spark.createDataFrame([(1, "x"), (2, "o"), (9, "q")], "run int, fingerprint string")
    assert rows(lineage.index_actions(now, state), "run", "action") == [(1, "keep"), (2, "refresh"), (3, "add"), (9, "remove")]


def test_scalars(spark):
    df = spark.createDataFrame([("1.5 GB", "nan", True), ("10KiB", "7.0000001", False), ("x", "2.5", None)], "s string, n string, b boolean")
    got = df.select(scalars.size_bytes(F.col("s")).alias("s"), scalars.strict_int(F.col("n")).alias("i"), scalars.lenient_int(F.col("n")).alias("l"), scalars.lax_number(F.col("n")).alias("x")).collect()
    assert [tuple(r) for r in got] == [(1610612736, None, None, None), (10240, 7, 7, 7.0000001), (None, None, 2, 2.5)]
    lr = [spark.range(1).select(scalars.learning_rate(F.lit(i), 1.0, 3, 10, 0.1)).first()[0] for i in (0, 2, 3, 10, 11)]
    assert lr == pytest.approx([0.25, 0.75, 1.0, 0.1, 0.1])
    assert spark.range(1).select(scalars.redact(F.lit("A=1 MY_TOKEN=abc x"))).first()[0] == "A=1 MY_TOKEN=<redacted> x"
