"""Removal of repeated passages by suffix arrays: per-shard arrays, common prefixes, and merging across shards.

A byte goes if a passage of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix of a
corpus would compare all shards with all others, so the suffixes are first brought to where their equals are:

1. Of the ``length - CONTEXT + 1`` places at which a passage's first bytes start, the one whose eight bytes have the
   smallest hash is the passage's anchor. It depends on the passage alone, so equal passages have equal anchors at
   equal distances. Passages in a row share an anchor; they are a run, its bytes a unit, and the hash of the
   ``CONTEXT`` bytes at the anchor its key. A repeated passage lies in units of one key, and every passage lies in
   one run. Keys that come once are done.
2. Equal units are one row with the number of their runs. Distinct units are dealt by ranges of (key, unit), so that a key
   of very many units covers several shards. Each shard has a suffix array by Larsson and Sadakane's refinement (only
   groups that still tie are sorted again, by the ranks further on) and Kasai's common prefixes; passages that share
   ``length`` bytes with a neighbour, or whose unit comes several times, are repeated.
3. Only a shard's first and last key can go on in other shards. Their distinct passages are merged across shards by binary
   search in the sorted digests.
4. The runs of each unit take its repeated passages back to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import table, texts
from graphloom.staging import written

LENGTH, CONTEXT, GRAM = 400, 100, 8
#: A shard's bytes, and rows up to which a list of keys or documents goes to all tasks.
SHARD, MOST_SENT = 2_000_000, 1_000_000
#: Bits of a place in a shard, and bytes that the first sort looks at.
PLACE, HEAD = 21, 5
#: UTF-8 never has this byte; it ends each unit in a shard.
STOP = 0xFF


def _windows(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes at each place, as one number."""
    return np.ndarray((len(data) - 7,), kind, data, 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(32)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    on, back = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], on[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int = LENGTH, context: int = CONTEXT) -> list[tuple[int, int, int]]:
    """(anchor, first start, number of starts) of each run of passages in one text."""
    if len(data) < length:
        return []
    grams = _mixed(_windows(np.frombuffer(data, np.uint8)))[: len(data) - context + 1]
    marked = (grams << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_sliding_least(marked, length - context + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
    counts = np.diff(np.append(first, len(anchors)))
    return list(zip(anchors[first].tolist(), first.tolist(), counts.tolist(), strict=True))


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def suffix_ranks(data: np.ndarray, length: int, room: np.ndarray | None = None) -> np.ndarray:
    """Ranks of all places by their first ``length`` bytes: equal ones have equal ranks, the place of the first of them in order.

    Only groups that still tie are sorted again, by the ranks of the places further on. A place, its group and the
    rank beyond share one integer, so that sorting is of plain numbers. ``room``: how many bytes each place has up to its
    unit's end; places with fewer than ``length`` have ranks by fewer bytes, which no other place needs.
    """
    n = len(data)
    if n >= 1 << PLACE:
        raise ValueError(f"a shard has at most {(1 << PLACE) - 1} bytes")
    head = _windows(np.concatenate([data, np.zeros(8, np.uint8)]), ">u8")[:n].astype(np.uint64) >> np.uint64(64 - 8 * HEAD)
    mixed = (head.astype(np.int64) << PLACE) | np.arange(n)
    depth, ranks, mask = HEAD, np.zeros(n + length, np.int32), (1 << PLACE) - 1
    while len(mixed):
        mixed.sort()
        key, tied = mixed >> PLACE, mixed & mask
        group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(group, len(tied)))
        base = key[group] >> PLACE if depth > HEAD else np.zeros(len(group), np.int64)  # what tied before
        first = np.maximum.accumulate(np.where(np.append(True, base[1:] != base[:-1]), group, 0))
        now = np.repeat(base + group - first, sizes)
        ranks[tied] = now
        if depth >= length:
            break
        step = min(depth, length - depth)
        more = np.repeat(sizes > 1, sizes)
        if room is not None:  # a place that reaches beyond its unit with the next bytes is looked up by none that doesn't
            more &= room[tied] >= depth + step
        tied, now = tied[more], now[more]
        mixed = (now << 2 * PLACE) | (ranks[tied + step].astype(np.int64) << PLACE) | tied
        depth += step
    return ranks[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, ranks: np.ndarray, begins: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order``, the starts of passages, how many bytes it shares with the one before it, ``length`` at most.

    Kasai's walk: a place shares at most one byte less than the place to its left did, if the places to the right of
    both are starts. Units are walked at once, a step being the next start of every unit. Ties in rank share ``length``
    bytes; after one a walk starts anew, as tied places have no order that it could rely on.
    """
    n = len(data)
    where, before = np.full(n + 1, -1, np.int64), np.full(n, -1, np.int64)
    where[order] = np.arange(len(order))
    before[order[1:]] = order[:-1]
    words = _windows(np.concatenate([data, np.zeros(length + 8, np.uint8)]))
    shared, by_size = np.zeros(len(order), np.int64), np.argsort(-starts, kind="stable")
    begins, starts = begins[by_size], starts[by_size]
    h = np.zeros(len(begins), np.int64)
    for step in range(int(starts[0]) if len(starts) else 0):
        live = int(np.searchsorted(-starts, -step, "left"))  # units with more starts than steps
        at = begins[:live] + step
        to = before[at]
        tie = (to >= 0) & (ranks[at] == ranks[to])
        now = np.where(where[to] >= 0, np.maximum(h[:live] - 1, 0), 0)
        now[tie | (to < 0)] = 0
        todo = np.flatnonzero((to >= 0) & ~tie)
        while len(todo):
            differ = words[at[todo] + now[todo]] ^ words[to[todo] + now[todo]]
            lowest = np.where(differ == 0, np.uint64(1), differ & (~differ + np.uint64(1)))
            alike = np.where(differ == 0, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
            now[todo] = np.minimum(now[todo] + alike, length)
            todo = todo[(alike == 8) & (now[todo] < length)]
        # what may be one less at the next start: nothing after a tie, or where the other unit has no more starts
        h[:live] = np.where((to >= 0) & (where[to + 1] >= 0), now, 0)
        shared[where[at]] = np.where(tie, length, now)
    return shared


def repeated_in_shard(units: list[bytes], starts: list[int], weights: list[int], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per unit, for each of its starts: whether its passage comes twice here, its class, and the class's weight.

    ``starts``: how many passages begin in each unit; ``weights``: how many runs have this unit.
    """
    data = np.frombuffer(b"".join(u + bytes([STOP]) for u in units), np.uint8)
    sizes, counts = np.array([len(u) for u in units], np.int64), np.array(starts, np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = np.cumsum(sizes + 1) - 1
    ranks = suffix_ranks(data, length, (np.repeat(ends, sizes + 1) - np.arange(len(data))).astype(np.int32))
    own = np.concatenate([np.arange(b, b + s) for b, s in zip(begins, starts, strict=True)])
    order = own[np.argsort(ranks[own], kind="stable")]
    shared = common_prefixes(data, order, ranks, begins, counts, length)
    classes = np.zeros(len(data), np.int64)
    classes[order] = np.cumsum(shared < length)
    weight = np.bincount(classes[own], np.repeat(weights, starts)).astype(np.int64)
    cls = [classes[b : b + s] for b, s in zip(begins, starts, strict=True)]
    return [weight[c] > 1 for c in cls], cls, [weight[c] for c in cls]


def _ranges(flags: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(number of the array, first, last + 1) of each stretch of true ones."""
    sizes = np.array([len(f) for f in flags], np.int64)
    own, begins = np.repeat(np.arange(len(flags)), sizes), np.cumsum(sizes + 1) - sizes
    flat = np.zeros(len(own) + len(flags) + 1, bool)  # a false one before each array and at the end
    flat[np.arange(len(own)) + own + 1] = np.concatenate(flags)
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    at = np.searchsorted(begins, edges[::2], "right") - 1
    return list(zip(at.tolist(), (edges[::2] - begins[at]).tolist(), (edges[1::2] - begins[at]).tolist(), strict=True))


RUNS = "key long, unit binary, doc_id long, h long, lo int, n int"
MARKS = "unit binary, a int, b int, key long, shard long, part int, digests binary, single array<int>, units array<binary>, starts array<int>"


def find_runs(docs: DataFrame, length: int, context: int) -> DataFrame:
    """The runs of all texts. ``docs``: doc_id, h, text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                key, unit, doc, own, lo, count = [], [], [], [], [], []
                for doc_id, h, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                    data = text.encode()
                    found = runs_of(data, length, context)
                    key += [int.from_bytes(_digest(data[a : a + context], 8), "little", signed=True) for a, _, _ in found]
                    unit += [_digest(data[s : s + n + length - 1] + bytes(str(a - s), "ascii")) for a, s, n in found]
                    lo += [s for _, s, _ in found]
                    count += [n for _, _, n in found]
                    doc += [doc_id] * len(found)
                    own += [h] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((key, pa.int64()), (unit, pa.binary()), (doc, pa.int64()), (own, pa.int64()), (lo, pa.int32()), (count, pa.int32()))], names=["key", "unit", "doc_id", "h", "lo", "n"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, RUNS)


def _some(rows: DataFrame, keys: DataFrame, on: list[str], most_sent: int) -> DataFrame:
    """The rows whose ``on`` is in ``keys``, a written table; it goes to all tasks if it is short."""
    return rows.join(F.broadcast(keys) if keys.count() <= most_sent else keys, on, "left_semi")


def unit_texts(docs: DataFrame, units: DataFrame, length: int, most_sent: int) -> DataFrame:
    """(key, unit, m, n, data) of distinct units, their bytes read where one of their runs lies."""
    asked = units.groupBy("rep.doc_id", "rep.h").agg(F.collect_list(F.struct("key", "unit", "m", F.col("rep.lo").alias("lo"), F.col("rep.n").alias("n"))).alias("asked"))
    asked = written(asked, "asked").withColumnsRenamed({"doc_id": "d", "h": "g"})
    here = _some(docs.where("doc_id is not null"), asked.select(F.col("d").alias("doc_id"), F.col("g").alias("h")), ["doc_id", "h"], most_sent).union(docs.where("doc_id is null"))
    rows = here.join(asked, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["h"] == F.col("g"))).select("text", "asked")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for text, asked in zip(part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True):
                    data = text.encode()
                    out += [(x["key"], x["unit"], x["m"], x["n"], data[x["lo"] : x["lo"] + x["n"] + length - 1]) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "unit", "m", "n", "data"])

    # rows that repeat doc_id and text give a unit as often; these are the same in all columns
    return rows.mapInArrow(run, "key long, unit binary, m long, n int, data binary").dropDuplicates(["unit"])


def _edge_lists(rows: list[tuple], classes: list[np.ndarray], weights: list[np.ndarray], key: int, length: int, bits: int):
    """A key's distinct passages in one shard as sorted lists of digests, one for each of 2^``bits`` parts of their range.

    Each list goes with the places in it of passages that come once here, their units and their starts.
    """
    seen: dict[int, tuple[bytes, int, bytes, int]] = {}
    for r, cls, w in zip(rows, classes, weights, strict=True):
        if r[0] == key:
            for i in np.unique(cls, return_index=True)[1].tolist():
                if cls[i] not in seen:
                    seen[int(cls[i])] = (_digest(r[4][i : i + length]), int(w[i]), r[1], i)
    parts: dict[int, list] = {}
    for x in sorted(seen.values()):
        parts.setdefault(int.from_bytes(x[0][:4], "big") >> (32 - bits), []).append(x)
    for part, found in parts.items():
        once = [n for n, x in enumerate(found) if x[1] == 1]
        yield part, b"".join(x[0] for x in found), once, [found[n][2] for n in once], [found[n][3] for n in once]


def shard_marks(units: DataFrame, length: int, shard: int, bits: int) -> DataFrame:
    """Rows of two kinds: a unit's repeated passages, from start a to b, as far as a shard knows; and sorted lists of what may repeat in another shard."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        kinds = {"unit": pa.binary(), "a": pa.int32(), "b": pa.int32(), "key": pa.int64(), "shard": pa.int64(), "part": pa.int32(), "digests": pa.binary(), "single": pa.list_(pa.int32()), "units": pa.list_(pa.binary()), "starts": pa.list_(pa.int32())}

        def done(rows):
            nonlocal number
            number += 1
            flags, classes, weights = repeated_in_shard([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length)
            out = [(rows[n][1], a, b, *[None] * 7) for n, a, b in _ranges(flags)]
            for key in {rows[0][0], rows[-1][0]}:
                out += [(None, None, None, key, number, *x) for x in _edge_lists(rows, classes, weights, key, length, bits)]
            for k in range(0, len(out), 20_000):
                part = out[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], t) for c, t in enumerate(kinds.values())], names=list(kinds))

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "unit", "m", "n", "data")), strict=True):
                if held and size + len(row[4]) + 1 > shard:
                    yield from done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield from done(held)

    return units.mapInArrow(run, MARKS)


def merged_marks(edges: DataFrame) -> DataFrame:
    """(unit, a, b) of passages at shards' ends that another shard has too. The lists of a key and part come together, in a row."""

    def merge(lists: list[dict]):
        runs = [np.frombuffer(x["digests"], "S16") for x in lists]
        merged = np.sort(np.concatenate(runs))
        for x, own in zip(lists, runs, strict=True):
            asked = own[x["single"]]  # each list is searched for in the merged one
            twice = np.searchsorted(merged, asked, "right") - np.searchsorted(merged, asked, "left") > 1
            yield from ((x["units"][n], x["starts"][n], x["starts"][n] + 1) for n in np.flatnonzero(twice).tolist())

    def run(batches):
        import pyarrow as pa

        now, lists = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["unit", "a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for x in batch.slice(k, 64).to_pylist():
                    if (x["key"], x["part"]) != now and lists:
                        yield out(list(merge(lists)))
                        lists = []
                    now = x["key"], x["part"]
                    lists.append(x)
        if lists:
            yield out(list(merge(lists)))

    return edges.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "unit binary, a int, b int")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, shard: int = SHARD, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every document; ``text`` is what is left of it.

    Texts count as UTF-8 bytes, a null one as empty; passages never cross documents and are judged on the input.
    Where a passage begins or ends inside a character, ``text`` shows its rest as U+FFFD; the digest is of the bytes.
    Texts of any length are gone through whole; texts shorter than ``length`` bytes stay. Of equal passages none is
    the first: all go. Rows that repeat a doc_id have a row each, and repeat one another; null doc_ids are kept;
    other columns don't matter. No documents give no rows.
    """
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    runs = written(find_runs(rows, length, context), "runs")
    keys = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    runs = written(_some(runs, keys, ["key"], most_sent), "candidates")
    units = runs.groupBy("key", "unit").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "h", "lo", "n")).alias("rep"))
    units = written(unit_texts(rows, units, length, most_sent), "units")
    size = units.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
    dealt = units.repartitionByRange(max(1, -(-size // (4 * shard))), "key", "unit").sortWithinPartitions("key", "unit")
    # parts of the digests' range are as many as shards, so that the lists of a part are about as long as a shard's
    bits = min(31, max(1, (size // shard).bit_length()))
    marks = written(shard_marks(dealt, length, shard, bits), "marks")
    edges = marks.where("unit is null").select("key", "shard", "part", "digests", "single", "units", "starts")
    # a key that all of its units share a shard with is done; others go on
    wide = written(edges.groupBy("key").agg(F.min("shard").alias("x"), F.max("shard").alias("y")).where("x < y").select("key"), "wide")
    across = merged_marks(_some(edges, wide, ["key"], most_sent))
    known = marks.where("unit is not null").select("unit", "a", "b").unionByName(across)
    spans = runs.join(known, "unit").select("doc_id", "h", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") - 1 + length).alias("end"))
    spans = written(spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"doc_id": "d", "h": "g"}), "spans")
    same = rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))

    def remove(batches):
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    data, kept, at, count = text.encode(), [], 0, 0
                    for s in spans or ():
                        if s["start"] > at or not count:
                            kept.append(data[at : s["start"]])
                            count += 1
                        at = max(at, s["end"])
                    left = b"".join([*kept, data[at:]])
                    out.append((doc, len(data), len(data) - len(left), count, hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds.values())], names=list(kinds))

    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    if spans.count() > most_sent:
        # every text is shuffled once
        return rows.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(remove, kept)
    ids = F.broadcast(spans.select("d", "g"))
    cut = rows.join(ids, same, "left_semi").join(spans, same).select("doc_id", "text", "spans").mapInArrow(remove, kept)
    none = F.lit(0).cast("long")
    whole = rows.join(ids, same, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")
    return cut.unionByName(whole)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, removed."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
