"""Exploded rows are never broadcast: the planner takes them for as small as their source."""

from pyspark.sql import functions as F

from marlstone.llm import common, simhash


def joins(df):
    text = df._jdf.queryExecution().sparkPlan().toString()
    return text.count("BroadcastHashJoin"), text.count("SortMergeJoin")


def test_simhash_links_join_signatures_by_shuffles(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "materialise", lambda df: seen.append(joins(df)) or common.materialise(df))
    # 600 fingerprints within two bits: large buckets, so that the second level is used
    prints = spark.range(600).select((F.lit(3).cast("bigint") * F.expr("shiftleft(1L, cast(id % 60 as int))")).alias("fp"), F.col("id").alias("rep")).dropDuplicates(["fp"])
    found = simhash.links(prints, bucket=8)
    assert [x[0] for x in seen] == [0] and seen[0][1] == 1
    stars = found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")
    assert stars >= 4
    assert found.count() > 0


def test_only_hot_keys_are_broadcast(spark):
    rows = spark.range(50).select("id", F.explode(F.sequence("id", F.col("id") + 30)).alias("k"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = common.join_hot(rows, keyed, "k")
    assert joins(out) == (2, 1)
    assert out.count() == rows.count()


def test_near_copies_broadcast_no_members_of_chunks(spark, monkeypatch):
    from marlstone.llm import near_copies

    seen = []

    def recorded(df):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.materialise(df)

    monkeypatch.setattr(near_copies, "materialise", recorded)
    # one bucket of 40 sets, in pairs that share a band by their first shingles alone
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join([*words, *(f"x{i // 2}y{j}" for j in range(12 + i % 2))])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert near_copies.keep_first(docs, bucket=2, chunk=4).count() > 0
    grouped = [x for x in seen if "FlatMapGroupsInArrow" in x]
    assert len(grouped) == 2
    exploded = grouped[1]
    assert exploded.index("SortMergeJoin") < exploded.index("Union")
