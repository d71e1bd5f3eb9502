from lacuna.llm import decontaminate


def test_null_item_id(spark):
    """An item without an id is found like any other."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of it is here at all"), (3, f"so {other}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, other)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.op10(docs, items).collect()}
    assert found == {(1, None, 1.0), (3, 7, 1.0)}
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [2]
