"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

The index cuts the vectors into blocks by a hash of their id. In a block, the postings of each
dimension are ordered by value and cut into segments of one quantised value range each. For a
query, a segment's impact is the most that its range can add to a score above the least that
the dimension adds to any. Segments are processed in falling order of impact over all
dimensions; accumulators hold upper bounds. What is still to come for a candidate is bounded by
the next impact of each dimension it has not met. Work on a block stops only when these bounds
prove that few candidates can reach the k-th best exact score found so far; these are then
scored exactly. If that never happens, all postings are processed and the rest is the same.

Queries are cut into blocks too, and each pair of a query block and an index block is one small
group, so all rows meet all queries with bounded memory. A pair gives k rows a query; the best k
of these are taken with their ranks.

Nulls and odd cases: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part. Scores are exact: where sums could leave the exact range of float64, all
candidates are scored in whole numbers instead. A component or a score that is no long is an
error, as in SQL. Shorter vectors end in zeros. Repeated rows are one row of the index with their
number, however many they are; they are candidates each, and one query. Rows with the query's own
id are not its candidates. Equal scores go to the smaller id. Empty tables give no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from grainmill.llm import words as W

K = 5
SCALE = 256
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 4096
LEVELS = 8
# Bounds are checked after these shares of the segments, and at the end.
CHECKS = (0.4, 0.6, 0.75, 0.85, 0.95)
# Work stops once so few candidates can still be among the best.
FEW = 96
# Sums of whole numbers up to here, and differences of such sums, are exact in float64.
EXACT = float(1 << 50)

VECTORS = "vec_id long, codes array<long>"
BLOCK = "block long, ids binary, copies binary, codes binary, width int, order binary, starts binary"
FOUND = "query_block long, query_no int, query_id long, vec_id long, copies long, score long, met long, postings long"


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                ids, lists = part.column("vec_id"), part.column("embedding")
                values = lists.flatten()
                fine = pc.is_finite(pc.fill_null(values.cast(pa.float64()), float("nan")))
                bad = np.concatenate(([0], np.cumsum(~fine.to_numpy(zero_copy_only=False))))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                keep = bad[ends[1:]] == bad[ends[:-1]]
                keep &= pc.and_(pc.is_valid(ids), pc.is_valid(lists)).to_numpy(zero_copy_only=False)
                x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", over="ignore"):
                    codes = np.floor(scale * x)
                codes[~np.repeat(keep, sizes)] = 0
                if len(codes) and np.abs(codes).max() >= 2.0**63:
                    raise ValueError("a quantised component does not fit a long")
                codes = codes.astype(np.int64)
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes))
                mask = pa.array(keep)
                yield pa.record_batch([ids.filter(mask), arrays.filter(mask)], names=["vec_id", "codes"])

    return run


def quantised_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, codes``: floor(scale * component) of every vector that takes part."""
    return vectors.select("vec_id", "embedding").mapInArrow(_quantise(scale), VECTORS)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of codes as a matrix, shorter ones filled with zeros."""
    sizes = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.combine_chunks().flatten().to_numpy()
    return out


def place_type(n: int) -> type:
    """Of the places in a block of n vectors."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def packed(codes: np.ndarray) -> bytes:
    """Codes in the smallest whole numbers that hold them all; the size of one tells which."""
    low, high = (int(f(initial=0)) for f in (codes.min, codes.max))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return codes.astype(kind).tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    size = len(data) // max(1, n * width)
    return np.frombuffer(data, dtype=f"<i{size or 8}").reshape(n, width).astype(np.int64)


def _index_block(levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        codes = _matrix(table.column("codes"))
        n, width = codes.shape
        order = np.argsort(codes, axis=0, kind="stable").T.astype(place_type(n))
        starts = np.zeros((width, levels + 1), dtype=np.int32)
        for d in range(width):
            values = codes[order[d], d]
            edges = np.linspace(values[0], values[-1], levels + 1)[1:-1]
            starts[d, 1:-1] = np.searchsorted(values, edges)
            starts[d, -1] = n
        copies = table.column("copies").to_numpy() if "copies" in table.column_names else np.ones(n, np.int64)
        row = {
            "block": [key[0].as_py()], "ids": [table.column("vec_id").to_numpy().tobytes()],
            "copies": [copies.tobytes()],
            "codes": [packed(codes)], "width": [width],
            "order": [order.tobytes()], "starts": [starts.tobytes()],
        }
        return pa.table(row, schema=pa.schema([
            ("block", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("codes", pa.binary()),
            ("width", pa.int32()), ("order", pa.binary()), ("starts", pa.binary()),
        ]))

    return run


def build_index(vectors: DataFrame, n: int, *, block_vectors: int = BLOCK_VECTORS, levels: int = LEVELS) -> DataFrame:
    """One row for each block of different quantised vectors; ``n`` is their number."""
    blocks = max(1, -(-n // block_vectors))
    block = F.pmod(F.xxhash64("vec_id", "codes"), F.lit(blocks))
    # No two rows are equal, so hashing keeps blocks near the mean.
    return vectors.withColumn("block", block).groupBy("block").applyInArrow(_index_block(levels), BLOCK)


def best_of_block(
    query: np.ndarray, own: int, ids: np.ndarray, codes: np.ndarray, order: np.ndarray,
    starts: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and exact scores of the best k candidates of a block, and the postings met."""
    n, width = codes.shape
    other = ids != own
    k = min(k, int(other.sum()))
    if not k:
        return np.empty(0, dtype=np.int64), np.empty(0), 0
    levels = starts.shape[1] - 1
    size = np.diff(starts, axis=1)
    full = size > 0
    dims = np.arange(width)[:, None]
    low = codes[order[dims, np.minimum(starts[:, :-1], n - 1)], dims].astype(np.float64)
    high = codes[order[dims, np.maximum(starts[:, 1:] - 1, 0)], dims].astype(np.float64)
    weight = query[:, None]
    most = np.where(full, np.maximum(weight * low, weight * high), -np.inf)
    least = np.where(full, np.minimum(weight * low, weight * high), np.inf)
    floor = least.min(axis=1) if width else np.empty(0)
    impact = np.where(full, most - floor[:, None], -1.0)
    base = floor.sum()
    flat = np.argsort(-impact, axis=None, kind="stable")
    flat = flat[: int(full.sum())]
    upper, met, seen = np.zeros(n), np.zeros(n, dtype=np.int64), 0
    threshold, to_come = -np.inf, np.maximum(impact, 0.0)
    cuts = sorted({0, len(flat), *(int(len(flat) * share) for share in CHECKS)})
    for a, b in zip(cuts, cuts[1:]):
        part = flat[a:b]
        d, level = part // levels, part % levels
        counts = size[d, level]
        places = np.concatenate([order[i, starts[i, j] : starts[i, j + 1]] for i, j in zip(d, level)])
        upper += np.bincount(places, np.repeat(impact[d, level], counts), n)
        met += np.bincount(places, minlength=n)
        seen += len(places)
        # The largest impact that each dimension still has to give.
        to_come[d, level] = 0.0
        given = np.concatenate(([0.0], np.cumsum(np.sort(to_come.max(axis=1)))))
        bound = base + upper + given[-1] - given[met]
        bound[~other] = -np.inf
        lead = np.argpartition(-bound, k - 1)[:k]
        threshold = max(threshold, float((codes[lead] @ query).min()))
        possible = np.flatnonzero(bound >= threshold)
        if len(possible) <= FEW + k:
            break
    if not len(flat):
        possible = np.flatnonzero(other)
    scores = codes[possible] @ query
    best = np.lexsort((ids[possible], -scores))[:k]
    return possible[best], scores[best], seen


def exact_best(
    query: np.ndarray, own: int, ids: np.ndarray, codes: np.ndarray, k: int, reach: float,
) -> tuple[list[int], list[int], int]:
    """``best_of_block`` by whole numbers; ``reach``: no sum of products is larger."""
    kind = np.int64 if reach < 2.0**62 else object
    scores = codes.astype(np.int64).astype(kind) @ query.astype(np.int64).astype(kind)
    at = sorted(np.flatnonzero(ids != own).tolist(), key=lambda i: (-int(scores[i]), ids[i]))[:k]
    return at, [int(scores[i]) for i in at], codes.size


def _search(k: int):
    def run(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and index.num_rows:
            block = index.to_pylist()[0]
            ids = np.frombuffer(block["ids"], dtype=np.int64)
            width, n = block["width"], len(ids)
            codes = unpacked(block["codes"], n, width)
            copies = np.frombuffer(block["copies"], dtype=np.int64)
            order = np.frombuffer(block["order"], dtype=place_type(n)).reshape(width, n)
            starts = np.frombuffer(block["starts"], dtype=np.int32).reshape(width, -1)
            codes = codes.astype(np.float64)  # made from float64, so all of them are kept
            largest = np.abs(codes).max(axis=0)
            asked = queries.to_pylist()[0]
            names = np.frombuffer(asked["ids"], dtype=np.int64)
            vectors = unpacked(asked["codes"], len(names), asked["width"])
            both = min(width, asked["width"])
            for no, own in enumerate(names):
                query = np.zeros(width)
                query[:both] = vectors[no, :both]
                reach = float(np.abs(query) @ largest)
                if reach < EXACT:
                    at, scores, met = best_of_block(query, own, ids, codes, order, starts, k)
                else:
                    at, scores, met = exact_best(query, own, ids, codes, k, reach)
                rows += [
                    (key[0].as_py(), no, int(own), int(ids[i]), int(copies[i]), int(s), met, n * width)
                    for i, s in zip(at, scores)
                ]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=names)

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = K,
    scale: int = SCALE,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
    levels: int = LEVELS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of ``vectors`` for each query."""
    codes = quantised_vectors(vectors, scale).groupBy("vec_id", "codes").agg(F.count(F.lit(1)).alias("copies"))
    codes = W.bounded_rows(codes, "top-k-vectors")
    asked = quantised_vectors(queries, scale).dropDuplicates(["vec_id", "codes"])
    asked = W.bounded_rows(asked, "top-k-queries")
    n, n_asked = codes.count(), asked.count()
    n_blocks, n_query_blocks = max(1, -(-n // block_vectors)), max(1, -(-n_asked // block_queries))
    index = W.bounded_rows(build_index(codes, n, block_vectors=block_vectors, levels=levels), "top-k-index")
    groups = build_index(asked, n_asked, block_vectors=block_queries, levels=1)
    groups = groups.withColumnRenamed("block", "query_block").select("query_block", "ids", "codes", "width")
    left = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = index.withColumn(
        "query_block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long"))),
    )
    found = (
        left.groupBy("query_block", "block")
        .cogroup(right.groupBy("query_block", "block"))
        .applyInArrow(_search(k), FOUND)
    )
    best = Window.partitionBy("query_block", "query_no").orderBy(F.desc("score"), "vec_id")
    # Only the copies of the k best different rows are counted out.
    copies = F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("copy", F.explode(copies))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
