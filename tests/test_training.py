import pytest
from pyspark.sql import functions as F

from marlstone.functions import arrays
from marlstone.operators import layout, lineage, metrics, quality
from marlstone.sources import readers


@pytest.mark.parametrize("n,ranks,drop", [(7, 3, False), (7, 3, True), (2, 5, False), (6, 3, True), (2, 5, True), (0, 3, False)])
def test_sampler_deals_equal_shares(spark, n, ranks, drop):
    files = spark.createDataFrame([(f"f{i}",) for i in range(n)], "file string")
    got = layout.sampled_files(files, ranks, 1, drop_last=drop).orderBy("place", "rank").collect()
    each, total = layout.sampled_ranks(n, ranks, drop)
    assert [(r.place, r.rank) for r in got] == [(i, k) for i in range(each) for k in range(ranks)]
    names = [r.file for r in got]
    order = list(dict.fromkeys(names))
    assert not n or names == [order[i % len(order)] for i in range(total)]
    assert len(order) == min(n, total)


def test_read_ranges_cover_the_wanted_rows(spark):
    files = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 7, 3, 9])], "ord bigint, n_rows bigint")
    got = [tuple(r) for r in layout.read_ranges(files, 2, 6, 20).orderBy("chunk").collect()]
    assert got == [(1, 5, 15, 1, 9), (2, 15, 24, 0, 5)]
    assert layout.read_ranges(files, 2, 24, 30).count() == 0


def test_located_rows_by_blocks(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 0), ("c", 9)], "file string, n_rows bigint")
    wanted = spark.range(-1, 16).select(F.col("id").alias("global_idx"))
    got = sorted(tuple(r) for r in layout.locate(wanted, sizes, block=4).collect())
    assert got == [(i, "a", i) if i < 5 else (i, "c", i - 5) for i in range(14)]


def test_joins_and_column_orders_raise(spark):
    a, b = (spark.createDataFrame(rows, f"k int, {c} int") for c, rows in (("x", [(1, 1), (2, 2), (None, 3)]), ("y", [(2, 5), (3, 6), (None, 7)])))
    assert [tuple(r) for r in quality.one_to_one(a, b, ["k"]).collect()] == [(2, 2, 5)]
    with pytest.raises(ValueError, match="right"):
        quality.one_to_one(a, b.union(b), ["k"])
    assert arrays.column_order(["a", "b", "c"], ["c", "a", "b"]) == [2, 0, 1]
    for have, want in ((["a", "a"], ["a"]), (["a"], ["b"]), (["a", "b"], ["a"])):
        with pytest.raises(ValueError):
            arrays.column_order(have, want)


def test_run_folders_and_containment(spark, tmp_path):
    rows = [("training_output_a", "log.txt"), ("training_output_a", "x.pt"), ("training_output_b", "x.csv"), ("training_output_c_text_split", "x.pt"), ("other", "x.pt"), ("training_output_d", "metrics.jsonl")]
    got = lineage.candidates(spark.createDataFrame(rows, "name string, file string"))
    assert sorted(r.name for r in got.collect()) == ["training_output_a", "training_output_d"]
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to(tmp_path)
    root = str(tmp_path / "in")
    assert readers.inside(root, [root]) and readers.inside(root + "/x/y", [root])
    assert not readers.inside(root + "side", [root]) and not readers.inside(root + "/../x", [root])
    assert not readers.inside(str(tmp_path / "link"), [root])


BASE = {"loss": 1.0, "raw": 1.0, "ema": 1.0, "clip_at": 2.0, "skip_at": 3.0, "skip_max": 10.0, "hard_limit": None, "skipped": False, "action": "pass", "head": None, "zero": None}
SCHEMA = "run string, line int, step bigint, " + ", ".join(f"{k} {'boolean' if k == 'skipped' else 'string' if k == 'action' else 'double'}" for k in BASE)


@pytest.mark.parametrize(
    "changes,tripped",
    [
        ({}, set()),
        ({3: {"raw": 10.0}}, {"over_skip_max"}),
        ({0: {"hard_limit": 5.0}, 3: {"raw": 5.0}}, {"over_hard_limit"}),
        ({0: {"skip_max": -1.0}, 3: {"raw": 50.0}}, set()),
        ({11: {"loss": 1.6}}, {"worse_loss"}),
        ({i: {"skipped": True} for i in (2, 3, 5)} | {4: {"raw": None}}, {"long_streak"}),
        ({i: {"action": "skip_norm"} for i in (0, 2, 4, 6, 7, 9, 11)}, {"too_many_skips"}),
        ({i: {"head": 2.0} for i in range(12)}, {"primary_stuck"}),
        ({i: {"head": 2.0 - i / 6, "zero": 0.1} for i in range(12)}, set()),
        ({11: {"zero": 0.9}}, {"primary_stuck"}),
    ],
)
def test_stability_trip_wires(spark, changes, tripped):
    rows = [("r", i, i, *(BASE | changes.get(i, {})).values()) for i in range(12)]
    got = metrics.stability(spark.createDataFrame(rows, SCHEMA), streak=3, span=12, window=3).collect()
    names = ("too_many_skips", "long_streak", "over_skip_max", "over_hard_limit", "worse_loss", "primary_stuck")
    assert len(got) == 1 and {n for n in names if got[0][n]} == tripped and got[0].unhealthy == bool(tripped)
