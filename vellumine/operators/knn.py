"""Exact and approximate nearest-neighbour search of a query set over a vector table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import vectors as V
from vellumine.operators.scale import top_k
from vellumine.session import cut_lineage

QUERY_BLOCK = 1024
#: Candidates that a task holds before it writes them out.
HELD_CANDIDATES = 2_000_000
ORDER_DIGITS = 6
ASCENDING = {"l2": True, "cosine": False, "dot": False}


def _scores(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(rows, queries) matrix in double precision."""
    product = block @ queries.T
    if metric == "dot":
        return product
    if metric == "cosine":
        base = np.outer(np.linalg.norm(block, axis=1), np.linalg.norm(queries, axis=1))
        return np.divide(product, base, out=np.zeros_like(product), where=base > 0)
    squared = (block**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * product
    return np.sqrt(np.clip(squared, 0, None))


def _first_k(queries: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of every query by (key, id)."""
    order = np.lexsort((ids, keys, queries))
    ordered = queries[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    place = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[place < k]


def _candidates(scores: np.ndarray, ids: np.ndarray, k: int, ascending: bool, skip: np.ndarray | None) -> tuple:
    """(query, key, id, score) of each query's best ``k`` rows of a (rows, queries) matrix, ties by lowest id."""
    keys = np.round(scores.T, ORDER_DIGITS) * (1.0 if ascending else -1.0)
    if skip is not None:
        keys = np.where(skip.T, np.inf, keys)
    bound = np.partition(keys, k - 1, axis=1)[:, k - 1 : k] if keys.shape[1] > k else np.inf
    query, row = np.nonzero((keys <= bound) & np.isfinite(keys))
    found = (query, keys[query, row], ids[row], scores[row, query])
    kept = _first_k(*found[:3], k)
    return tuple(x[kept] for x in found)


#: Share of a block's pairs up to which single scores are cheaper than the whole product in double precision.
FEW_PAIRS = 1 / 32
#: Room for scores that rank equal after ``ORDER_DIGITS`` digits.
TIE_ROOM = 2e-6


def _better(block: np.ndarray, queries: np.ndarray, metric: str, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, row) of all pairs whose score may rank before ``reach``, each query's worst score so far; None if they are many.

    A product in single precision leaves out what the bound of its rounding error excludes, so none is lost. For distances,
    |q - c| < t is the same as q.c - |c|^2 / 2 > (|q|^2 - t^2) / 2.
    """
    long_c, long_q = np.linalg.norm(block, axis=1), np.linalg.norm(queries, axis=1)
    peak_c, peak_q = long_c.max(initial=0), long_q.max(initial=0)
    if not (peak_c < 1e15 and peak_q < 1e15):
        return None
    rounding = 2.0 ** -22 * (block.shape[1] + 4)
    if metric == "cosine":
        block = np.divide(block, long_c[:, None], out=np.zeros_like(block), where=long_c[:, None] > 0)
        queries = np.divide(queries, long_q[:, None], out=np.zeros_like(queries), where=long_q[:, None] > 0)
        least = reach - TIE_ROOM - rounding
    elif metric == "dot":
        least = reach - TIE_ROOM - rounding * peak_c * long_q
    else:
        block = np.concatenate([block, -0.5 * (long_c**2)[:, None]], axis=1)
        queries = np.concatenate([queries, np.ones((len(queries), 1))], axis=1)
        least = (long_q**2 - (reach + TIE_ROOM) ** 2) / 2 - rounding * (peak_c * long_q + peak_c**2 + long_q**2)
    # Rounded down, so that the threshold is not above its own value.
    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    product = queries.astype(np.float32) @ block.astype(np.float32).T
    some = np.flatnonzero(product.max(axis=1) >= least)
    hit = product[some] >= least[some][:, None]
    if np.count_nonzero(hit) > FEW_PAIRS * product.size:
        return None
    query, row = np.nonzero(hit)
    return some[query], row


def _pair_scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores in double precision of pairs, one row and one query each."""
    if metric == "l2":
        return np.linalg.norm(rows - queries, axis=1)
    product = (rows * queries).sum(axis=1)
    if metric == "dot":
        return product
    base = np.linalg.norm(rows, axis=1) * np.linalg.norm(queries, axis=1)
    return np.divide(product, base, out=np.zeros_like(product), where=base > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _packed(rows: DataFrame, block_rows: int, prefix: str) -> DataFrame:
    """Rows (id, v) as blocks: one row with the ids and the flat vectors (bytes of doubles) of up to ``block_rows`` rows of one width."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(widths):
                chosen = batch.filter(pa.array(widths == width))
                for start in range(0, chosen.num_rows, block_rows):
                    part = chosen.slice(start, block_rows)
                    flat = part.column(1).flatten().cast(pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column(0)], pa.list_(part.schema.field(0).type)), pa.array([flat.to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([width], pa.int32())],
                        names=[f"{prefix}_ids", f"{prefix}_v", f"{prefix}_width"],
                    )

    # Sorted, so that a task that runs again after a loss makes the same blocks.
    return rows.where("v IS NOT NULL").sortWithinPartitions("id").mapInArrow(pack, f"{prefix}_ids array<{kind}>, {prefix}_v binary, {prefix}_width int")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate for the optimised plan; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


#: Query blocks that a task may hold at once, in a grid.
HELD_BLOCKS = 64


def met_blocks(corpus: DataFrame, queries: DataFrame, query_bytes: int | None = None) -> DataFrame:
    """Every block of the corpus with every block of queries; blocks have ``c_ids`` and ``q_ids``.

    A query side below Spark's broadcast limit, by ``query_bytes`` as counted or else by Spark's estimate, is broadcast. Else the
    query blocks are counted, and both sides are dealt to a grid: a Cartesian product, whose tasks read one part of each side, so
    that each side is written once, whatever the number of cells. There are as many columns of queries as tasks or blocks, and
    rows of the corpus only for tasks that are left, since a query's best rows are written by every row of the grid.
    """
    spark = corpus.sparkSession
    limit = broadcast_limit(spark)
    asked_bytes = estimated_bytes(queries) if query_bytes is None else query_bytes
    if asked_bytes <= limit:
        return corpus.crossJoin(queries if query_bytes is None else F.broadcast(queries))
    queries = cut_lineage(queries)
    blocks = queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, min(blocks, max(tasks, -(-blocks // HELD_BLOCKS))))
    # A stated number of partitions: merged by their bytes, which are few, the products would end in few tasks. Query blocks are
    # dealt by their number, as by turns those of several partitions would meet in one.
    asked = queries.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(columns, "_n").drop("_n")
    return corpus.repartition(-(-tasks // columns)).hint("shuffle_replicate_nl").crossJoin(asked)


def _blocked(
    corpus: DataFrame, queries: DataFrame, k: int, ascending: bool, score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    exclude_self: bool = False, same_width: bool = True, block_rows: int = QUERY_BLOCK, metric: str | None = None,
) -> DataFrame:
    """(query_id, id, score) candidates: every block of queries meets every block of rows as two matrices.

    A task keeps the best ``k`` per query over the blocks it sees, so pairs never become rows; what it holds is written out
    when it exceeds ``HELD_CANDIDATES``. Ids keep their type. With ``metric``, once a query has ``k`` rows, others are told by a
    product in single precision (``_better``), and only those that may be among the best are scored in double precision.
    """
    pairs = met_blocks(_packed(corpus, block_rows, "c"), _packed(queries, block_rows, "q"))
    kinds = (queries.schema["id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for asked, (query, _, ids, scores) in held.values():
                yield pa.RecordBatch.from_arrays(
                    [asked.take(pa.array(query)), pa.array(ids.tolist(), id_type), pa.array(scores, pa.float64())], names=["query_id", "id", "score"]
                )

        def found_in(c, q, c_ids, asked, best) -> tuple:
            if metric is not None and best is not None and len(best[0]):
                places = np.bincount(best[0], minlength=len(q))
                # Rows of a query come in order, so the last one of a full list is its worst.
                reach = np.where(places == k, best[1][np.cumsum(places) - 1] * (1.0 if ascending else -1.0), np.inf if ascending else -np.inf)
                pairs = _better(c, q, metric, reach)
                if pairs is not None:
                    query, row = pairs
                    ids = np.array(c_ids.take(pa.array(row)).to_pylist())
                    if exclude_self:
                        other = ids != np.array(asked.take(pa.array(query)).to_pylist())
                        query, row, ids = query[other], row[other], ids[other]
                    scores = _pair_scores(c[row], q[query], metric)
                    return query, np.round(scores, ORDER_DIGITS) * (1.0 if ascending else -1.0), ids, scores
            ids = np.array(c_ids.to_pylist())
            skip = ids[:, None] == np.array(asked.to_pylist())[None, :] if exclude_self else None
            return _candidates(score(c, q), ids, k, ascending, skip)

        id_type = None
        for batch in batches:
            for i in range(batch.num_rows):
                c_ids, asked = batch.column("c_ids")[i].values, batch.column("q_ids")[i].values
                id_type = c_ids.type
                if same_width and batch.column("c_width")[i].as_py() != batch.column("q_width")[i].as_py():
                    continue
                c = np.frombuffer(batch.column("c_v")[i].as_buffer()).reshape(-1, batch.column("c_width")[i].as_py())
                q = np.frombuffer(batch.column("q_v")[i].as_buffer()).reshape(-1, batch.column("q_width")[i].as_py())
                key = hashlib.blake2b(q.tobytes() + repr([asked[0], asked[-1], len(asked)]).encode(), digest_size=16).digest()
                best = held[key][1] if key in held else None
                found = found_in(c, q, c_ids, asked, best)
                if best is not None:
                    if not len(found[0]):
                        continue
                    count -= len(best[0])
                    both = [np.concatenate(x) for x in zip(best, found)]
                    kept = _first_k(*both[:3], k)
                    found = tuple(x[kept] for x in both)
                # Copied, as a slice would hold its batch.
                held[key] = (held[key][0] if best is not None else pa.concat_arrays([asked]), found)
                count += len(found[0])
                if count > HELD_CANDIDATES:
                    yield from flush()
                    held, count = {}, 0
        yield from flush()

    return pairs.mapInArrow(search, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    corpus_id: str = "vec_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    block_rows: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact ``k`` nearest rows per query: (query_id, id, score, rank). Ids of any type keep it.

    Blocks of queries meet blocks of rows as matrices (``_blocked``); only ``tasks * queries * k`` candidates are shuffled,
    and no vector passes through the driver.
    """
    rows = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v"))
    found = _blocked(rows, asked, k, ASCENDING[metric], lambda c, q: _scores(c, q, metric), exclude_self, block_rows=block_rows, metric=metric)
    return top_k(found, ["query_id"], [_order(metric), F.col("id")], k)


def _order(metric: str) -> Column:
    shown = F.round("score", ORDER_DIGITS)
    return shown.asc() if ASCENDING[metric] else shown.desc()


def filtered_knn(corpus: DataFrame, queries: DataFrame, k: int, keep: Column, mode: str = "pre", **options) -> DataFrame:
    """k-NN with a metadata filter: ``pre`` searches matching rows only, ``post`` filters the top k."""
    if mode == "pre":
        return knn(corpus.where(keep), queries, k, **options)
    key = options.get("corpus_id", "vec_id")
    hits = knn(corpus, queries, k, **options)
    return hits.join(corpus.where(keep).select(F.col(key).alias("id")), "id", "left_semi")


def metadata_filter(conditions: dict) -> Column:
    """Equality, or membership when the value is a list; a missing value fails."""
    out = F.lit(True)
    for name, value in conditions.items():
        test = F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value)
        out = out & F.coalesce(test, F.lit(False))
    return out


# --- approximate search ---------------------------------------------------------------------


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


class IvfIndex:
    """Inverted file: k-means cells; a query scans its ``nprobe`` nearest cells."""

    def __init__(self, corpus: DataFrame, corpus_id: str = "vec_id", vector: str = "embedding", seed: int = 7):
        self.corpus_id, self.vector = corpus_id, vector
        dim = corpus.select(F.size(vector)).first()[0]
        n = corpus.count()
        cells = max(1, min(400, 2 * dim, n))
        self.model = KMeans(k=cells, seed=seed, featuresCol="_f", predictionCol="cell", maxIter=10).fit(_features(corpus, vector))
        self.centers = np.array(self.model.clusterCenters())
        self.table = self.model.transform(_features(corpus, vector)).select(
            F.col(corpus_id).alias("id"), F.col(vector).alias("v"), "cell"
        )

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", nprobe: int | None = None) -> DataFrame:
        """Rows of the probed cells are scored in blocks, as in exact search. Rows lie by cell, so a block holds few cells and
        only the queries that probe one of them are multiplied with it; pairs never become rows."""
        probes = min(nprobe or min(64, 2 * k), len(self.centers))
        centers, dim = self.centers, self.centers.shape[1]  # at most 400 vectors

        @F.pandas_udf("array<double>")
        def probed(vectors: pd.Series) -> pd.Series:
            matrix = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
            nearest = np.argsort(_scores(centers, matrix, "l2"), axis=0, kind="stable")[:probes].T
            marks = np.zeros((len(matrix), len(centers)))
            np.put_along_axis(marks, nearest, 1.0, axis=1)
            return pd.Series(list(np.concatenate([matrix, marks], axis=1)))

        def score(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
            cell, marks = rows[:, dim].astype(int), asked[:, dim:] > 0
            live = np.flatnonzero(marks[:, np.unique(cell)].any(axis=1))
            out = np.full((len(rows), len(asked)), np.inf)
            out[:, live] = np.where(marks[live][:, cell].T, _scores(rows[:, :dim], asked[live, :dim], "l2"), np.inf)
            return out

        rows = self.table.repartitionByRange("cell", "id").select(
            "id", F.concat(F.col("v").cast("array<double>"), F.array(F.col("cell").cast("double"))).alias("v")
        )
        asked = queries.select(F.col(query_id).alias("id"), probed(F.col(self.vector).cast("array<double>")).alias("v"))
        found = _blocked(rows, asked, k, True, score, same_width=False)
        return top_k(found, ["query_id"], [F.round("score", ORDER_DIGITS), F.col("id")], k)


class PqIndex:
    """Product quantisation: each sub-vector is replaced by its nearest of at most 256 centroids."""

    def __init__(self, corpus: DataFrame, corpus_id: str = "vec_id", vector: str = "embedding", seed: int = 7, parts: int | None = None):
        self.vector = vector
        dim = corpus.select(F.size(vector)).first()[0]
        self.parts = parts or max(1, min(8, dim // 32))
        self.width = dim // self.parts
        n = corpus.count()
        coded = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("v"))
        self.codebooks = []
        for m in range(self.parts):
            sub = coded.withColumn("_s", F.slice("v", m * self.width + 1, self.width))
            features = _features(sub, "_s")
            model = KMeans(k=min(256, n), seed=seed + m, featuresCol="_f", predictionCol=f"c{m}", maxIter=5).fit(features)
            self.codebooks.append(np.array(model.clusterCenters()))
            coded = model.transform(features).drop("_s", "_f")
        self.vectors = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("v"))
        self.codes = coded.select("id", F.array(*[F.col(f"c{m}") for m in range(self.parts)]).alias("codes"))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", rerank: int | None = None) -> DataFrame:
        """Asymmetric distance by table lookup, in blocks as in exact search; the best ``rerank`` are ranked by true distance."""
        books, width, parts = self.codebooks, self.width, self.parts

        def score(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
            lookup = [_scores(book, q[:, m * width : (m + 1) * width], "l2") ** 2 for m, book in enumerate(books)]
            return np.sqrt(sum(lookup[m][codes[:, m].astype(int)] for m in range(parts)))

        rows = self.codes.select("id", F.col("codes").cast("array<double>").alias("v"))
        asked = queries.select(F.col(query_id).alias("id"), F.col(self.vector).alias("v"))
        order = [F.round("score", ORDER_DIGITS), F.col("id")]
        found = top_k(_blocked(rows, asked, max(k, rerank or k), True, score, same_width=False), ["query_id"], order, max(k, rerank or k))
        if rerank:
            met = found.select("query_id", "id").join(self.vectors, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
            found = top_k(met.select("query_id", "id", V.l2(F.col("q"), F.col("v")).alias("score")), ["query_id"], order, k)
        return found


class LshIndex:
    """Random-projection hashing; candidates share a bucket with the query in any table."""

    def __init__(self, corpus: DataFrame, corpus_id: str = "vec_id", vector: str = "embedding", bucket: float = 0.6, tables: int = 6, seed: int = 7):
        self.vector, self.tables = vector, tables
        lsh = BucketedRandomProjectionLSH(inputCol="_f", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed)
        features = _features(corpus, vector)
        self.model = lsh.fit(features)
        self.table = self._hashed(features).select(F.col(corpus_id).alias("id"), F.col(vector).alias("v"), "hashes")

    def _hashed(self, features: DataFrame) -> DataFrame:
        arrays = F.transform("_h", lambda h: vector_to_array_first(h))
        return self.model.transform(features).withColumn("hashes", arrays)

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
        """Rows that share a bucket with a query are scored in blocks, as in exact search: a block that shares none is skipped, in
        others pairs without a common bucket are left out. Buckets of any size cost no more than a scan and make no rows."""
        tables = self.tables

        def score(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
            v, h, q, g = rows[:, :-tables], rows[:, -tables:], asked[:, :-tables], asked[:, -tables:]
            out = np.full((len(rows), len(asked)), np.inf)
            met = np.zeros(out.shape, bool)
            for t in range(tables):
                met |= h[:, t][:, None] == g[:, t][None, :]
            live = np.flatnonzero(met.any(axis=0))
            if len(live):
                out[:, live] = np.where(met[:, live], _scores(v, q[live], "l2"), np.inf)
            return out

        joined = lambda v: F.concat(F.col(v).cast("array<double>"), F.col("hashes")).alias("v")
        asked = self._hashed(_features(queries, self.vector)).select(F.col(query_id).alias("id"), joined(self.vector))
        found = _blocked(self.table.select("id", joined("v")), asked, k, True, score)
        return top_k(found, ["query_id"], [F.round("score", ORDER_DIGITS), F.col("id")], k)


def vector_to_array_first(h: Column) -> Column:
    return F.get(vector_to_array(h), F.lit(0))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits found, over all queries."""
    hit = approximate.select("query_id", "id", F.lit(1).alias("found"))
    joined = exact.join(hit, ["query_id", "id"], "left")
    return joined.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("wanted"),
        F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("recall"),
    )


# --- vector table maintenance ---------------------------------------------------------------


def delete_vectors(vectors: DataFrame, doomed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``vectors`` not named in ``doomed``; stable ids are kept."""
    return vectors.join(doomed.select(*on), list(on), "left_anti")


def index_status(vectors: DataFrame, vector: str = "embedding", expected: int | None = None) -> DataFrame:
    size = F.size(vector)
    return vectors.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(size).alias("dimension"),
        F.count_if(size != (F.lit(expected) if expected else size)).alias("mismatched"),
    )


def append_valid(vectors: DataFrame, path: str, dim: int, vector: str = "embedding") -> DataFrame:
    """Append the rows of the right dimension as Parquet; returns the skipped rows."""
    good = F.coalesce(F.size(vector) == dim, F.lit(False))
    vectors.where(good).write.mode("append").parquet(path)
    return vectors.where(~good)


def encode_texts(df: DataFrame, key: str, text: str, encode: Callable[[Column], Column], out: str = "embedding") -> DataFrame:
    """(key, vector), encoding each different text once.

    ``encode`` maps a text Column to a vector Column (``models.text_encoder``, or an expression). A text meets its copies by a
    digest on the map side and is shuffled once; vectors go back by digest to narrow rows, and as they are written first, that
    join's side with many copies of one text is split. A null text has no vector.
    """
    digest = F.sha2(F.col(text), 256)
    once = df.where(F.col(text).isNotNull()).groupBy(digest.alias("_digest")).agg(F.any_value(text).alias("_text"))
    vectors = cut_lineage(once.select("_digest", encode(F.col("_text")).alias(out)))
    return df.select(key, digest.alias("_digest")).join(vectors, "_digest", "left").select(key, out)


def duplicate_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keeper, copies): every document with the first of its identical copies.

    Copies are counted by an aggregate on the digest, then joined back; no window holds a
    group, so a text copied millions of times is handled like any other.
    """
    keyed = df.select(key, F.sha2(F.col(text), 256).alias("_digest"))
    heads = keyed.groupBy("_digest").agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(heads, "_digest").drop("_digest")
