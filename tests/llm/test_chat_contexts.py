from threadloom.llm import chat


def test_contexts_do_not_depend_on_size(spark):
    """A long conversation's examples carry their contexts as a short one's do; only stated limits leave them out."""
    rows = [(c, t, "assistant" if t % 2 else "user", "x" * 1500) for c, n in ((1, 4), (2, 200)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.prefix_examples(turns)
    got = made.selectExpr("conv_id", "length(context) = context_chars as whole").collect()
    assert len(got) == 102 and all(r["whole"] for r in got)
    limited = chat.prefix_examples(turns, whole_turns=chat.WHOLE_TURNS, whole_chars=chat.WHOLE_CHARS)
    assert {r["conv_id"] for r in limited.filter("context is null").collect()} == {2}
    key = lambda df: sorted(map(str, df.collect()))
    assert key(chat.read_back(made)) == key(chat.read_back(limited))
