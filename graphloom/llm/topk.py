"""Exact top-k by inner product: tiled matrix products, thresholds carried from tile to tile, and merging in a tree.

Rows of the same vector are one candidate that keeps its k + 1 smallest ids, and queries of the same vector are asked
once. Both are packed into blocks, matrices in the narrowest integers that hold them, and dealt to tasks. A tile is one
block of queries against one of candidates; its product is one matrix multiplication in floats or doubles where these
hold every sum exactly, and in Python's integers else. A task carries each query's k + 1 best from tile to tile, so
that of later tiles just the scores are looked at that reach the last of these; tasks' lists are merged in a tree.
Last, each query's own row is taken out of its list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.staging import written, written_with

SCALE = 256
#: Blocks of queries are broadcast up to so many bytes, else every pair of partitions is met.
BROADCAST = 64 << 20
#: Tasks at most, and queries whose scores are worked out at once.
TASKS, STRIPE = 512, 1024
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _most(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


def _narrow(m: np.ndarray) -> np.ndarray:
    """A matrix in the narrowest integers."""
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if _most(m) <= np.iinfo(t).max and (not m.size or int(m.min()) >= np.iinfo(t).min)))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(width, kind, matrix, ends, ids): blocks of ``rows`` vectors of a width at most, of columns v and ids, an array."""

    def blocks(parts):
        import pyarrow as pa

        v, ids = (pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in ("v", "ids"))
        widths, starts, values = np.diff(v.offsets.to_numpy()), v.offsets.to_numpy()[:-1], v.values.to_numpy(zero_copy_only=False)
        counts, begins, flat = np.diff(ids.offsets.to_numpy()), ids.offsets.to_numpy()[:-1], ids.values.to_numpy(zero_copy_only=False)
        for width in np.unique(widths).tolist():
            every = np.flatnonzero(widths == width)
            for k in range(0, len(every), rows):
                at = every[k : k + rows]
                m = _narrow(values[starts[at, None] + np.arange(width)])
                own = np.concatenate([flat[begins[n] : begins[n] + counts[n]] for n in at.tolist()])
                ends = np.cumsum(counts[at]).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"width": width, "kind": m.dtype.str, "matrix": m.tobytes(), "ends": ends.tobytes(), "ids": own.astype(np.int64).tobytes()}], schema=schema)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                parts.append(batch.slice(k, rows))
                n += parts[-1].num_rows
                if n >= rows:
                    yield from blocks(parts)
                    parts, n = [], 0
        if n:
            yield from blocks(parts)

    import pyarrow as pa

    schema = pa.schema([("width", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary())])
    return vectors.select("v", "ids").mapInArrow(run, "width int, kind string, matrix binary, ends binary, ids binary")


class Block:
    """A packed block: vectors as a matrix, and each one's ids."""

    def __init__(self, width: int, kind: str, matrix: bytes, ends: bytes, ids: bytes):
        self.ends, self.ids = np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int64)
        self.matrix = np.frombuffer(matrix, kind).reshape(len(self.ends), width)
        self.most = _most(self.matrix)


def _int64(scores: list[int], same: list[bool]) -> list[int]:
    """Python's integers as longs. Only a vector's product with itself may be beyond, as a row is no candidate of its own."""
    if any(not s and not _LEAST <= x <= _MOST for x, s in zip(scores, same, strict=True)):
        raise OverflowError("a score is beyond 64 bits")
    return [min(max(x, _LEAST), _MOST) for x in scores]


class Best:
    """The ``keep`` best rows of each query of a block: scores from the highest, ties by the smaller id."""

    def __init__(self, queries: Block, keep: int):
        n = len(queries.ends)
        self.queries, self.keep = queries, keep
        self.scores, self.ids, self.have = np.full((n, keep), _LEAST), np.full((n, keep), _MOST), np.zeros(n, np.int64)

    def tile(self, candidates: Block) -> None:
        q, c = self.queries, candidates
        bound = q.most * c.most * max(1, q.matrix.shape[1])
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        right = c.matrix.astype(kind).T
        for k in range(0, len(q.ends), STRIPE):
            at = np.arange(k, min(k + STRIPE, len(q.ends)))
            scores = q.matrix[at].astype(kind) @ right
            self._exact(at, scores, c) if kind is object else self._take(at, scores, c)

    def _take(self, at: np.ndarray, scores: np.ndarray, c: Block) -> None:
        """Scores of a stripe that reach the last of their query's best; these are whole numbers, held exactly."""
        least = np.where(self.have[at] == self.keep, self.scores[at, -1].astype(np.float64), -np.inf)
        some = np.flatnonzero(scores.max(axis=1) >= least)
        if not len(some):
            return
        scores, least, n = scores[some], least[some], scores.shape[1]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and n > self.keep:
            # there are as many rows with these scores at least; all that tie with the last are kept until ids decide
            least[new] = np.partition(scores[new], n - self.keep, axis=1)[:, n - self.keep]
        row, column = np.divmod(np.flatnonzero(scores >= least[:, None].astype(scores.dtype)), n)
        self._merge(at[some[row]], scores[row, column].astype(np.int64), column, c)

    def _exact(self, at: np.ndarray, scores: np.ndarray, c: Block) -> None:
        for n, line in zip(at.tolist(), scores, strict=True):
            line = [int(x) for x in line]
            best = sorted(range(len(line)), key=line.__getitem__, reverse=True)
            least = line[best[min(self.keep, len(best)) - 1]]
            column = [k for k in best if line[k] >= least]
            same = [bool((self.queries.matrix[n] == c.matrix[k]).all()) and c.ends[k] - (c.ends[k - 1] if k else 0) == 1 for k in column]
            self._merge(np.full(len(column), n), np.array(_int64([line[k] for k in column], same), np.int64), np.array(column), c)

    def _merge(self, row: np.ndarray, score: np.ndarray, column: np.ndarray, c: Block) -> None:
        begins = np.concatenate([[0], c.ends[:-1]])[column]
        counts = c.ends[column] - begins
        place = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        old = np.unique(row)
        kept = np.arange(self.keep) < self.have[old, None]
        row = np.concatenate([np.repeat(row, counts), np.repeat(old, self.have[old])])
        score = np.concatenate([np.repeat(score, counts), self.scores[old][kept]])
        id_ = np.concatenate([c.ids[place], self.ids[old][kept]])
        order = np.lexsort((id_, ~score, row))
        row, score, id_ = row[order], score[order], id_[order]
        first = np.searchsorted(row, old)
        rank = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
        fine = rank < self.keep
        self.scores[row[fine], rank[fine]], self.ids[row[fine], rank[fine]] = score[fine], id_[fine]
        self.have[old] = np.minimum(np.diff([*first, len(row)]), self.keep)

    def own(self) -> list[int]:
        """Each query's product with itself, as it stands in the list."""
        m = self.queries.matrix.astype(object if self.queries.most**2 * max(1, self.queries.matrix.shape[1]) >= 2**63 else np.int64)
        return [min(int(x), _MOST) for x in (m * m).sum(axis=1)]


def _merge(lists: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The best (less, vec_id) per query vector and further keys, of lists of ``keep`` at most each."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, keep)
    return lists.groupBy("asked", *keys).agg(F.first("own").alias("own"), best.alias("best"))


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = 4096, fan: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding. Components become floor(256 x). Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all other rows than the query's own, also rows that repeat its vec_id.
    Rows with a null vec_id, a null embedding, or null, infinite or NaN components take no part. Vectors of
    different widths are no candidates of one another; a vector of any width is taken whole, and sums beyond 2^53 are
    worked out in integers. Other columns don't matter. No rows give no rows.
    """
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    keep = k + 1  # with a query's own row
    all_ = vectors.where(fine).select(F.col("vec_id").cast("long"), whole.alias("v")).withColumn("h", F.xxhash64("v"))
    few = all_.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("n") <= keep)
    blocks, told = written_with(_packed(few.groupBy("h", "v").agg(F.collect_list("vec_id").alias("ids")), rows), "blocks", F.count(F.lit(1)).alias("n"))
    of = all_.where(F.col("vec_id") % every == 0).groupBy("h", "v").agg(F.collect_list("vec_id").alias("query_ids"))
    of = written(of.withColumn("asked", F.monotonically_increasing_id()), "queries")
    asked, bytes_ = written_with(_packed(of.select("v", F.array("asked").alias("ids")), 8 * rows), "asked", F.coalesce(F.sum(F.length("matrix") + F.length("ids")), F.lit(0)).alias("n"))
    tasks = max(1, min(told["n"], TASKS))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    met = blocks.repartition(tasks).crossJoin(F.broadcast(asked) if bytes_["n"] <= BROADCAST else asked)

    def run(batches):
        import pyarrow as pa

        names = ("width", "kind", "matrix", "ends", "ids")
        best: dict[int, Best] = {}
        seen, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                q, c = ([part.column(f"{p}{n}")[0].as_py() for n in names] for p in ("q_", ""))
                if q[0] != c[0]:
                    continue
                if c[-1] != seen:
                    seen, block = c[-1], Block(*c)
                at = int(np.frombuffer(q[-1], np.int64)[0])
                if at not in best:
                    best[at] = Best(Block(*q), keep)
                best[at].tile(block)
        for b in best.values():
            own = b.own()
            for n in range(0, len(own), 4096):
                part = slice(n, n + 4096)
                some = np.arange(keep) < b.have[part, None]
                ends = pa.array(np.concatenate([[0], np.cumsum(b.have[part])]).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[part][some], pa.int64())) for x in (b.scores, b.ids))
                yield pa.RecordBatch.from_arrays([pa.array(b.queries.ids[part], pa.int64()), pa.array(own[part], pa.int64()), *lists], names=["asked", "own", "scores", "ids"])

    found = met.mapInArrow(run, "asked long, own long, scores array<long>, ids array<long>")
    level = found.select(F.spark_partition_id().alias("s"), "asked", "own", F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("less"), i.alias("vec_id"))).alias("best"))
    width = tasks
    while width > fan:
        width = -(-width // fan)
        level = _merge(level.withColumn("s", F.pmod("s", F.lit(width))), ["s"], keep)
    level = _merge(level, [], keep).join(of.select("asked", F.explode("query_ids").alias("query_id")), "asked")
    place = F.array_position("best", F.struct((-F.col("own")).alias("less"), F.col("query_id").alias("vec_id")))
    others = F.filter("best", lambda x, n: n + 1 != F.col("place"))
    out = level.withColumn("place", place).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every 50th."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
