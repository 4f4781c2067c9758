"""What Spark would send through the driver for want of a size."""

from waymark.llm import maxent


def test_counts_of_rare_tokens_are_not_broadcast(spark):
    rows = spark.createDataFrame([(0, [7, 8, 9]), (1, [8]), (2, [])], "chunk long, rare array<long>")
    counts = spark.createDataFrame([(8, 5), (9, 2)], "h long, c long")
    out = maxent._met(rows, counts)
    got = {r["chunk"]: (r["n_rare"], sorted(zip(r["at"] or [], r["c"] or [], strict=True))) for r in out.collect()}
    assert got == {0: (3, [(1, 5), (2, 2)]), 1: (1, [(0, 5)]), 2: (0, [])}
    assert "BroadcastExchange" not in out._jdf.queryExecution().toString()
