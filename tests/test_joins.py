from helpers import events
from sealtrail.operators import chain
from sealtrail.plans import joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_broadcast_and_large_ones_are_not(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, table = events(spark, 20).where("id >= 'e0015'"), events(spark, 40)
        small, large = joins.present(few, table, "id"), joins.present(few, table, "id", limit=3)
        assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
        want = [f"e{i:04d}" for i in range(15, 20)]
        assert sorted(r["id"] for r in small.collect()) == sorted(r["id"] for r in large.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chains_continue_the_same_way_without_broadcasts(spark, monkeypatch):
    df = events(spark, 30).cache()
    heads = chain.segment_heads(chain.build_chain(df.where("id < 'e0010'")))
    rest = df.where("id >= 'e0010'")

    def links():
        return sorted((r["id"], r["seg"], r["pos"], bytes(r["this_hash"])) for r in chain.build_chain(rest, heads=heads, batch="1").collect())

    with_broadcast = links()
    monkeypatch.setattr(chain, "broadcast_if_small", lambda frame: frame)
    assert links() == with_broadcast
