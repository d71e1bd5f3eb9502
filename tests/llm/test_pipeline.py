import pytest
from test_similar import survivors

import corpus_pipeline
from lacuna.llm import decontaminate, toxicity
from lacuna.llm.common import cut


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What every stage read and made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        made[name] = docs
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "packing"]


def test_columns(stages):
    for name in ("toxicity", "line_dedup", "simhash", "decontaminate"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.sample(stages["documents"], labels, held_out=None))
    before = rows(stages["documents"])
    scores = toxicity.score_texts(model, [r.text for r in before.values()], {})
    expected = {i: r for (i, r), s in zip(before.items(), scores, strict=True) if s < corpus_pipeline.TOXIC}
    assert rows(stages["toxicity"]) == expected and 0 < len(expected) < len(before)


def test_lines(stages):
    before, after = rows(stages["toxicity"]), rows(stages["line_dedup"])
    seen, expected = set(), {}
    for i in sorted(before):
        lines, gone = before[i].text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        expected[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {i: r.text for i, r in after.items()} == expected
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert expected != {i: r.text for i, r in before.items()}


def test_near_duplicates(stages):
    before, after = rows(stages["line_dedup"]), rows(stages["simhash"])
    assert set(after) == survivors({i: r.text for i, r in before.items()})
    assert all(after[i] == before[i] for i in after) and len(after) < len(before)


def test_leaks(spark, sf_dir, stages):
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = rows(stages["simhash"]), rows(stages["decontaminate"])
    leaks = decontaminate.contaminated(stages["simhash"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert set(before) - set(after) == {r.doc_id for r in leaks.collect()}
    whole = {i for i, r in before.items() if any(x in r.text.lower() for x in items)}
    assert whole and not whole & set(after)
    assert all(after[i] == before[i] for i in after)


def test_packing(stages):
    pieces = stages["packing"].collect()
    docs = rows(stages["decontaminate"])
    assert {p.doc_id for p in pieces} == set(docs)
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_run(spark, sf_dir, stages):
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.columns == stages["packing"].columns and made.count() == stages["packing"].count()


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Labels and benchmark with nulls, repeated rows and columns of the documents' names."""
    path = tmp_path_factory.mktemp("odd")
    insult = "you utter vermin of a wretched liar"
    labels = [(i, i % 2, "x", 0.5) for i in range(100, 160)] + [(1, None, "x", None), (None, 1, None, 0.1), (4, 0, "y", 0.2), (4, 0, "y", 0.2)]
    spark.createDataFrame(labels, "doc_id long, toxic int, text string, score double").write.parquet(f"{path}/labels.parquet")
    items = [(1, "another text under the same id", "s"), (2, None, "s"), (None, "", None), (1, "another text under the same id", "s")]
    spark.createDataFrame(items, "item_id long, text string, tag string").write.parquet(f"{path}/benchmark.parquet")
    rude = [(i, f"{'a quiet day by the sea ' * 3}{insult if i % 2 else 'and some tea'} number {i}") for i in range(100, 160)]
    return str(path), rude


def test_stages_on_odd_rows(spark, awkward, odd_dir):
    path, rude = odd_dir
    more = spark.createDataFrame(rude, "doc_id long, text string").selectExpr("doc_id", "text", *[f"CAST(NULL AS {t}) AS {c}" for c, t in awkward.dtypes[2:]])
    docs = cut(awkward.unionByName(more), "odd")
    n_odd = awkward.count()
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, path), name)
        made[name] = docs
        if name != "packing":
            assert docs.dtypes == before.dtypes, name
    assert {r.doc_id for r in made["toxicity"].collect()} == {1, 2, 3, 4, None, 5, 6, 7} | set(range(100, 160, 2))
    assert made["line_dedup"].count() == n_odd + 30
    assert made["line_dedup"].filter("doc_id = 1").head().text == ""
    kept = sorted((r.doc_id or 0, r.text) for r in made["simhash"].collect())
    assert [i for i, _ in kept if i < 100] == [0, 1, 4, 4, 5, 6]
    assert sorted(r.doc_id or 0 for r in made["decontaminate"].collect() if (r.doc_id or 0) < 100) == [0, 1, 4, 5, 6]
    packed = made["packing"].filter("start = 0").collect()
    assert len(packed) == made["decontaminate"].count()


def test_stages_on_empty_tables(spark, nothing, odd_dir):
    path, _ = odd_dir
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, path), name)
        assert docs.count() == 0, name


def test_stages_on_empty_labels_and_benchmark(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_toxic(spark, awkward, str(tmp_path)).count() == awkward.count()
    assert corpus_pipeline.drop_leaks(spark, awkward, str(tmp_path)).count() == awkward.count()
