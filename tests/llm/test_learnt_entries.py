"""Which entries toxicity learns."""

from numera.llm import toxicity


def test_entries_are_learnt_where_most_rows_are_toxic(spark):
    rows = [(1, f"zorbak calm lake {i % 7}") for i in range(300)] + [(0, f"calm lake {i % 7}") for i in range(200)]
    got = toxicity.learn_entries(spark.createDataFrame(rows, "toxic int, text string"))
    assert "zorbak" in got and "calm" not in got and "lake" not in got


def test_all_significant_entries_are_learnt(spark):
    name = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(1, name(i % 2500)) for i in range(2500 * 12)] + [(0, "calm lake") for _ in range(40_000)]
    got = toxicity.learn_entries(spark.createDataFrame(rows, "toxic int, text string").repartition(4))
    assert set(got) == {name(i) for i in range(2500)}
