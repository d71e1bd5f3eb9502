"""Small corpora from literals, and comparison with DuckDB."""

from lacuna.schema import ENTITY, FEATURE, VALUE, Corpus


def corpus(spark, rows):
    """Rows ``(kind, file::name, {kind: [values]})`` as canonical frames."""
    entities, features, values = [], [], []
    for i, (kind, name, sets) in enumerate(rows):
        entities.append((name, kind, name, name.split("::")[0], 1, i))
        for k, vs in sets.items():
            features.append((name, k))
            values += [(name, k, v) for v in vs]
    return Corpus(
        spark.createDataFrame(entities, ENTITY), spark.createDataFrame(features, FEATURE), spark.createDataFrame(values, VALUE)
    )


def files(spark, paths, kind="function"):
    return corpus(spark, [(kind, f"{p}::f", {}) for p in paths]).entities


def pairs(findings):
    return sorted((r.rule_id, r.entity_id) for r in findings.gaps.collect())


def compare(spark, sf_dir, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns), name
    mine, theirs = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert mine.equals(theirs), name
    return len(mine)
