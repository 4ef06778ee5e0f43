from collections import Counter

from plugload import Settings
from plugload.llm.quoting import without_quotes

BLOCKS = Settings(window_rows=2, block_rows=4)


def test_rows_without_conversation_are_numbered_once(spark):
    rows = [(c, t, "user", f"says {t}\n> says {t - 1}") for c in (None, 1) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(3)
    plain, blocks = (without_quotes(df, s).collect() for s in (Settings(), BLOCKS))
    assert Counter(plain) == Counter(blocks)
    assert sorted(r["position"] for r in blocks if r["conv_id"] is None) == list(range(1, 41))
