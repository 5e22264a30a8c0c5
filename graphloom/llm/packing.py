"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most a sequence's length. Pieces are dealt into blocks of some thousands; each block
is a packing problem of its own that several islands work on. An island's chromosome is a list of bins. Crossover
injects whole well-filled bins of one parent into the other, removes bins that hold what is now there twice, and
puts the pieces that lost their bin back: first in the places of smaller ones where that fills a bin better, then by
best fit, largest first. After each epoch an island's elite goes to
the next island of its block. The bins that stay poorly filled in the best packing of each block are emptied, and
their pieces are mixed over all blocks and packed once more.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import worker
from graphloom.llm.pretokens import encoder, slices, vocabulary
from graphloom.llm.tables import table, texts
from graphloom.staging import written

#: Islands that one task evolves: a task takes longer to start than an island's epoch.
TOGETHER = 8
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, whole long"


def pieces_of(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: only documents over ``capacity`` ids are cut; their first piece may be shorter."""
    size = 4 * capacity

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, row = encoder(vocabulary(tokenizer)), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        whole = row  # counts the pieces that fill a sequence
        for batch in batches:
            out = []
            for part in slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    row += 1
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        whole += b - a == size
                        out.append((doc_id, row, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), whole if b - a == size else None))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "whole"])

    return docs.mapInArrow(run, PIECES)


class Rooms:
    """Bins by the room they have left; the tightest one that takes a piece is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.by = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, bin_: int, room: int) -> None:
        self.by[room].append(bin_)
        self.open |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, room) of the fullest bin with room for ``size``, which leaves the set."""
        fit = self.open >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        bin_ = self.by[room].pop()
        if not self.by[room]:
            self.open &= ~(1 << room)
        return bin_, room


Packing = tuple[list[list[int]], list[int]]  # bins, and how full each is


def best_fit(bins: list[list[int]], fill: list[int], order: list[int], size: list[int], capacity: int) -> Packing:
    """``bins`` with the pieces of ``order`` put in one after the other; a bin that takes one is a new list."""
    rooms = Rooms(capacity)
    for n, f in enumerate(fill):
        if f < capacity:
            rooms.put(n, capacity - f)
    for i in order:
        found = rooms.take(size[i])
        if found is None:
            bins.append([i])
            fill.append(size[i])
            rooms.put(len(bins) - 1, capacity - size[i])
        else:
            n, room = found
            bins[n] = [*bins[n], i]
            fill[n] += size[i]
            if room > size[i]:
                rooms.put(n, room - size[i])
    return bins, fill


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among as many, fuller full ones."""
    fill = np.array(packing[1], np.float64) / capacity
    return len(fill), -float(fill @ fill)


def trade(bins: list[list[int]], fill: list[int], lost: list[int], size: list[int], capacity: int) -> list[int]:
    """Displaced pieces take the places of smaller ones where that fills a bin better; what is displaced then, ascending."""
    lost = sorted(lost, key=size.__getitem__)
    sizes = [size[i] for i in lost]
    for n, b in enumerate(bins):
        room = capacity - fill[n]
        if not room or not lost:
            continue
        gain, out, at = 0, -1, -1
        for i in b:
            k = bisect_right(sizes, size[i] + room) - 1
            if k >= 0 and sizes[k] - size[i] > gain:
                gain, out, at = sizes[k] - size[i], i, k
        if gain:
            bins[n] = [lost.pop(at), *(i for i in b if i != out)]
            fill[n] += gain
            sizes.pop(at)
            k = bisect_right(sizes, size[out])
            sizes.insert(k, size[out])
            lost.insert(k, out)
    return lost


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rng: random.Random, share: float = 0.3) -> Packing:
    """A child of ``a`` with whole well-filled bins of ``b``: full ones if there are any, else of the fuller half."""
    full = [n for n, f in enumerate(b[1]) if f == capacity]
    filled = full or np.argsort(-np.array(b[1]), kind="stable")[: max(1, len(b[1]) // 2)].tolist()
    inject = rng.sample(filled, max(1, int(len(filled) * rng.uniform(share, 1))))
    keep, fill = [b[0][n] for n in inject], [b[1][n] for n in inject]
    held = {i for x in keep for i in x}
    emptied = set(np.argsort(np.array(a[1]), kind="stable")[: max(1, int(len(a[1]) * rng.uniform(0.01, 0.1)))].tolist())
    lost: list[int] = []
    for n, x in enumerate(a[0]):
        if n in emptied or not held.isdisjoint(x):
            lost += [i for i in x if i not in held]
        else:
            keep.append(x)
            fill.append(a[1][n])
    lost = trade(keep, fill, lost, size, capacity)[::-1]
    return best_fit(keep, fill, lost, size, capacity)


def evolve(size: list[int], capacity: int, start: list[list[list[int]]], seed: int, population: int, generations: int) -> list[Packing]:
    """The island's packings after some generations, best first. It stops where no packing can have fewer bins."""
    rng, least = random.Random(seed), -(-sum(size) // capacity)
    pool = [(bins, [sum(size[i] for i in b) for b in bins]) for bins in start]
    rated = [(fitness(x, capacity), n, x) for n, x in enumerate(pool)]
    while len(rated) < population and not any(r[0][0] <= least for r in rated):
        spread = 0.1 * rng.random() if rated else 0.0
        wobble = [s * (1 + spread * rng.random()) for s in size]
        made = best_fit([], [], sorted(range(len(size)), key=wobble.__getitem__, reverse=True), size, capacity)
        rated.append((fitness(made, capacity), len(rated), made))
    rated.sort(key=lambda r: r[:2])
    for g in range(generations):
        if rated[0][0][0] <= least or len(rated) < 2:
            break
        one, two = sorted(rng.sample(range(len(rated)), 2))
        child = crossover(rated[one][2], rated[two][2], size, capacity, rng)
        rated.append((fitness(child, capacity), population + g, child))
        rated = sorted(rated, key=lambda r: r[:2])[:population]
    return [x for _, _, x in rated]


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(labels) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(max(labels)) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return [b for b in out if b]


def _pack(small: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(block, row, piece, bin, offset, fill) of each piece, from (block, row, piece, length). A block's pieces are ordered by (row, piece)."""
    rows = small.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "piece", "length"))).alias("all"))
    rows = written(rows, "blocks")
    elites = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "all", F.array().cast("array<array<int>>").alias("elite"))
    for epoch in range(epochs):

        def island(batches, epoch=epoch):
            import pyarrow as pa

            worker.begins("packing")
            for batch in batches:
                out = []
                for block, isle, items, elite in zip(*(batch.column(c).to_pylist() for c in ("block", "island", "all", "elite")), strict=True):
                    size = [x["length"] for x in items]
                    found = evolve(size, capacity, [_bins(x) for x in elite], hash((block, isle, epoch)), population, generations)
                    out.append((block, isle, [_labels(x[0], len(size)).tolist() for x in found[:2]], *fitness(found[0], capacity)))
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["block", "island", "found", "n_bins", "roughness"])

        done = elites.repartition(max(1, -(-blocks * islands // TOGETHER)), "block", "island").mapInArrow(island, "block long, island int, found array<array<int>>, n_bins int, roughness double")
        done = written(done, "islands")
        if epoch + 1 < epochs:
            # each island keeps its best packing and gets that of the island before it
            sent = done.select("block", "island", F.col("found")[0].alias("p")).union(done.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("found")[0].alias("p")))
            elites = sent.groupBy("block", "island").agg(F.collect_set("p").alias("elite")).join(rows, "block").select("block", "island", "all", "elite")
    best = done.groupBy("block").agg(F.min_by(F.col("found")[0], F.struct("n_bins", "roughness", "island")).alias("bins")).join(rows, "block")
    each = best.select("block", F.explode(F.arrays_zip("all", "bins")).alias("x")).select("block", "x.all.*", F.col("x.bins").alias("bin"))
    from pyspark.sql import Window

    own = Window.partitionBy("block", "bin").orderBy("row", "piece")
    return each.select("block", "row", "piece", "bin", (F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"), F.sum("length").over(Window.partitionBy("block", "bin")).alias("fill"), "length")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, block: int = 2048, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 12, poor: float = 0.97) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    A piece of ``capacity`` ids is a sequence of its own. Others go to blocks of about ``block`` pieces; what lies in bins
    under ``poor`` of the capacity is dealt into blocks anew and packed again, with four times the ``generations``, as such bins
    are few. A block that reaches its lower bound, all ids over the capacity, stops there. sequence_id is the block and the bin in it, or a
    count of whole pieces; its last two bits tell these apart.
    No pieces give no rows.
    """
    pieces = written(pieces, "pieces")
    n = pieces.where(F.col("length") < capacity).count()
    blocks = max(1, -(-n // block))
    dealt = F.pmod(F.xxhash64("row", "piece"), F.lit(blocks))
    small = pieces.where(F.col("length") < capacity).select(dealt.alias("block"), "row", "piece", "length")
    first = written(_pack(small, blocks, capacity, islands, epochs, population, generations), "packed")
    again = first.where(F.col("fill") < poor * capacity)
    mixed = max(1, -(-again.count() // block))
    again = again.select(F.pmod(F.xxhash64("row", "piece", F.lit("again")), F.lit(mixed)).alias("block"), "row", "piece", "length")
    last = _pack(again, mixed, capacity, islands, epochs, 2 * population, 4 * generations)
    spot = lambda df, kind: df.select("row", "piece", (F.shiftleft(F.col("block"), 24) + F.col("bin") * 4 + kind).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    own = pieces.where(F.col("length") >= capacity).select("doc_id", "row", "piece", "start", "length", "ids_crc32", (F.col("whole") * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = spot(first.where(F.col("fill") >= poor * capacity), 0).unionByName(spot(last, 1))
    rest = pieces.where(F.col("length") < capacity).join(packed, ["row", "piece"]).select(own.columns)
    return rest.unionByName(own)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's pieces with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text gives one piece, the end id; a text over ``capacity`` ids is cut, however long, and all its pieces
    but the first are whole sequences. Rows that repeat a doc_id are packed each for itself; a null doc_id is kept;
    other columns don't matter. Of bins that are as full the one opened or left last takes a piece. No documents give no rows.
    """
    placed = pack_pieces(pieces_of(texts(docs), tokenizer, capacity, end_id), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(table(spark, sf_dir, "documents"))
