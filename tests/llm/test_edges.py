"""Empty tables, nulls everywhere, repeated rows and extra columns for every operator."""

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import automaton, bpe, chat, decontaminate, masked_lm, quality, radix, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"
LEAK = "this item of the benchmark is here word for word in one of the documents as a leak to find"


def _benchmark(spark):
    return spark.createDataFrame([(7, LEAK), (None, None), (8, ""), (8, "")], "item_id long, text string")


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, bpe.default_path()),
    "quality": lambda d: quality.judged(d, []),
    "masked_lm": masked_lm.pseudo_likelihood,
    "clean": lambda d: decontaminate.clean(d, _benchmark(d.sparkSession)).select("doc_id", "text"),
    "leaks": lambda d: decontaminate.leaks(d, _benchmark(d.sparkSession)),
    "secrets": secrets.scan,
    "radix": radix.without_repeats,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.sparkSession.read.parquet(f"{SF}/labels.parquet"))),
    "automaton": automaton.without_repeats,
    "simhash": simhash.classes,
}
ROWS = [(None, None), (None, None), (1, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "\x00 \n"), (4, "x " * 3000), (5, "and " + LEAK), (5, "and " + LEAK)]
#: Rows that come back: all, but for searches, which report what they find, and filters.
EXPECTED = {"leaks": 2, "clean": 8}
CLASHING = ("n_words", "fp", "node", "kept", "spans", "score", "bucket", "tag", "ids", "row", "item_id", "lane", "piece", "y", "_found", "base_spans", "loss", "role2")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nothing_and_nulls(spark, name):
    run = OPERATORS[name]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    plain = run(df)
    want = sorted(map(repr, plain.collect()))
    assert len(want) == EXPECTED.get(name, len(ROWS))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    assert sorted(map(repr, run(df).select(*plain.columns).collect())) == want
    assert run(df.limit(0)).count() == 0


def test_chat_with_clashing_columns(spark):
    rows = [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, "assistant", ""), (2, 5, None, "x" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(repr, chat.digest(chat.format_turns(df)).collect()))
    assert len(want) == 3
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    assert sorted(map(repr, chat.digest(chat.format_turns(df)).collect())) == want
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
