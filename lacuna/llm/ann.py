"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of ``STAGES`` codebooks.
Codewords span all dimensions: each book is fitted by k-means to what the books
before it leave over, on at most ``SAMPLE`` vectors.  Every vector is then encoded
by beam search (``BEAM`` partial sums are kept from book to book), and the squared
norm of its decoded sum is stored.  A query is scored against all codes by table
look-ups of its inner products with the codewords; the best ``KEEP`` codes of each
query are reranked by the exact distance of the original vectors, in doubles.

Equal vectors fold into one class before coding, so a vector that is repeated
without end is one candidate; a class keeps its ``k`` + 1 smallest ids, and no
other member can be among the k nearest.  A query's own class is always reranked.

Vectors that are null, empty, zero, hold null or non-finite components, or have
another length than most take no part, nor do null ids.  Rows equal in id and
vector count once.  Ties go to the smaller id.  Fewer than k other vectors: all
of them.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fresh_path, small_batches
from .token_files import open_store

STAGES, WORDS, BEAM = 24, 256, 4
#: Vectors that the codebooks are fitted to, at most.
SAMPLE = 16_384
#: Codes reranked for each query.
KEEP = 400
#: Queries scored together.
QUERY_BLOCK = 1024


def _fit(data: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """k-means codewords and each row's nearest."""
    book = data[rng.choice(len(data), words, replace=False)].copy()
    near = np.zeros(len(data), np.int64)
    for _ in range(rounds):
        near = np.argmin((book * book).sum(1) - 2 * data @ book.T, axis=1)
        counts = np.bincount(near, minlength=words)
        sums = np.stack([np.bincount(near, data[:, d], words) for d in range(data.shape[1])], 1)
        full = counts > 0
        book[full] = (sums[full] / counts[full, None]).astype(np.float32)
        book[~full] = data[rng.choice(len(data), (~full).sum())]
    return book, np.argmin((book * book).sum(1) - 2 * data @ book.T, axis=1)


def fit_books(sample: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """``stages x words x dimensions`` codebooks."""
    rng = np.random.default_rng(seed)
    left, books = sample.astype(np.float32).copy(), []
    words = min(words, len(left))
    for _ in range(stages):
        book, near = _fit(left, words, rng)
        left -= book[near]
        books.append(book)
    return np.stack(books)


def encode(data: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes and decoded squared norms by beam search."""
    stages, words, _ = books.shape
    n = len(data)
    left = data.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    size = (books * books).sum(2)
    who = np.arange(n)[:, None]
    for m in range(stages):
        rest = (left * left).sum(2)[:, :, None] + size[m] - 2 * left @ books[m].T
        flat = rest.reshape(n, -1)
        b = min(beam, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b] if b < flat.shape[1] else np.tile(np.arange(b), (n, 1))
        parent, word = best // words, best % words
        left = left[who, parent] - books[m][word]
        codes = np.concatenate([codes[who, parent], word[:, :, None].astype(np.uint8)], axis=2)
    pick = np.argmin((left * left).sum(2), axis=1)
    rows = np.arange(n)
    decoded = data.astype(np.float32) - left[rows, pick]
    return codes[rows, pick], (decoded * decoded).sum(1)


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    small_batches(table.sparkSession)
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    # -0.0 is as far from anything as 0.0
    rows = rows.withColumn("embedding", F.transform(v, lambda x: x + F.lit(0.0)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return rows.filter(F.size("embedding") == (sizes.d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(
    table: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    keep: int = KEEP,
    stages: int = STAGES,
    beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows of ``table`` nearest to each query row.

    Both are of ``valid_vectors``, and ``queries`` is part of ``table``.
    """
    spark = table.sparkSession
    members = table.distinct()
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = members.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = members.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = cut(classes.select(F.get("ids", F.lit(0)).alias("rep"), "ids", "embedding"), "classes")
    # two vectors under one id: the class is known by its vector too
    classes = classes.withColumn("mark", F.xxhash64("embedding"))
    asked = cut(queries.select("vec_id", "embedding").distinct(), "asked")
    ask = cut(asked.select("embedding").distinct().withColumn("q", F.xxhash64("embedding")), "vectors")
    n_ask = ask.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n_ask:
        return spark.createDataFrame([], empty)
    blocks = fresh_path(spark, "queries")
    ask.select("q", "embedding").repartition(-(-n_ask // QUERY_BLOCK)).write.parquet(blocks)

    sample = bounded_sample(classes.select("mark", "embedding"), SAMPLE, "mark").toPandas()["embedding"]
    books = spark.sparkContext.broadcast(fit_books(np.stack(sample.to_list()), stages))  # of a fixed size

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, norms = encode(_matrix(part["embedding"]), books.value, beam)
                yield pa.RecordBatch.from_arrays(
                    [part["rep"], part["mark"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))],
                    names=["rep", "mark", "code", "norm"],
                )

    index = cut(classes.select("rep", "mark", "embedding").mapInArrow(code, "rep long, mark long, code binary, norm float"), "index")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        reps = np.concatenate([b["rep"].to_numpy() for b in held])
        marks = np.concatenate([b["mark"].to_numpy() for b in held])
        norms = np.concatenate([b["norm"].to_numpy() for b in held])
        codes = np.frombuffer(b"".join(x for b in held for x in b["code"].to_pylist()), np.uint8).reshape(len(reps), -1)
        by = np.argsort(reps, kind="stable")  # ties of a score go to the smaller id
        reps, marks, norms, codes = reps[by], marks[by], norms[by], codes[by]
        fs, place = open_store(blocks)
        names = sorted(f.path for f in fs.get_file_info(_under(place)) if f.path.endswith(".parquet"))
        for name in names:
            with fs.open_input_file(name) as f:
                block = pq.read_table(f).combine_chunks().to_batches()
            for q in block:
                if not q.num_rows:
                    continue
                vectors = _matrix(q["embedding"]).astype(np.float32)
                tables = np.einsum("qd,mwd->mqw", vectors, books.value, optimize=True)
                best = np.zeros((len(vectors), 0), np.float32)
                where = np.zeros((len(vectors), 0), np.int64)
                for at in range(0, len(reps), 2048):
                    part = codes[at : at + 2048].astype(np.int64)
                    score = np.broadcast_to(norms[at : at + 2048], (len(vectors), len(part))).copy()
                    for m in range(part.shape[1]):
                        score -= 2 * tables[m][:, part[:, m]]
                    best = np.concatenate([best, score], 1)
                    where = np.concatenate([where, np.tile(np.arange(at, at + len(part)), (len(vectors), 1))], 1)
                    if best.shape[1] > keep:
                        top = np.argpartition(best, keep - 1, axis=1)[:, :keep]
                        best, where = np.take_along_axis(best, top, 1), np.take_along_axis(where, top, 1)
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q["q"].to_numpy(), n)),
                        pa.array(reps[where.ravel()]),
                        pa.array(marks[where.ravel()]),
                        pa.array(best.ravel()),
                    ],
                    names=["q", "rep", "mark", "near"],
                )

    found = index.mapInArrow(scan, "q long, rep long, mark long, near float")
    order = Window.partitionBy("q").orderBy("near", "rep", "mark")
    found = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep).select("q", "rep", "mark")
    own = ask.join(classes, "embedding").select("q", "rep", "mark")
    pairs = cut(found.unionByName(own).distinct(), "pairs")
    pairs = pairs.join(classes.select("rep", "mark", "ids", F.col("embedding").alias("there")), ["rep", "mark"])
    pairs = pairs.join(ask, "q")
    distance = F.sqrt(
        F.aggregate(F.zip_with("embedding", "there", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    )
    scored = pairs.select("q", "embedding", distance.alias("score"), F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy("score", "vec_id")
    lists = scored.select("q", "score", "vec_id").distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    lists = cut(lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "lists")
    ranked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q")).join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = ranked.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _under(place: str):
    from pyarrow.fs import FileSelector

    return FileSelector(place)


def op9(table: DataFrame) -> DataFrame:
    rows = cut(valid_vectors(table), "vectors")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
