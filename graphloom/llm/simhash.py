"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits have a common neighbour within r bits of both. So every distinct fingerprint
emits all its variants within half the radius, and those that meet at a variant are all within the radius of one
another: a variant's group has one fingerprint for each variant of its centre at most, however many copies there
are. Within a group every member is linked to the smallest, which keeps what is reachable without emitting pairs.

The pipeline's stage asks for texts that share 0.8 of their five-word shingles. Their fingerprints differ in about ten
of 64 bits, up to some 18, a radius that no ball or block reaches without most unrelated texts meeting too. So
candidates meet at shingles there: all texts put theirs in one order, rare ones first, and two that are similar enough share
one of the first fifth of both. No such pair is lost, whatever the order. Each candidate pair's shingles are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import worker
from graphloom.llm.tables import table, texts
from graphloom.operators.components import connected_components
from graphloom.operators.entities import meet
from graphloom.staging import drop_written, noted, written, written_with

SEED = 42
#: The stage's near copies share 4 of 5 distinct shingles of five words.
WORDS, ALIKE = 5, (4, 5)
#: Shingles are counted by so many remainders of their hashes, in slices of which each is summed by a task.
COUNTERS, SLICES = 1 << 20, 64
#: Bits of the parities of a text's shingles. What two texts don't share changes at most as many bits as it has shingles, so
#: texts whose parities differ in more bits than that aren't alike: no pair is lost by it.
PARITIES = 1024
#: A shingle's members that aren't connected yet are all compared with one another, in slices of about this many against all.
CROWD = 1024
#: Up to so many ids of documents to compare, or of those that go, are broadcast, so that no texts are shuffled.
ASKED = 2_000_000


def _words(text: str) -> list[bytes]:
    # bytes.lower and bytes.split know just ASCII letters and the six ASCII white-space characters
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(found: list[bytes], words: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; of all words where they are fewer."""
    import xxhash

    if not found:
        return np.zeros(0, np.uint64)
    joined, step = b" ".join(found), min(words, len(found))
    ends = list(np.cumsum([len(w) + 1 for w in found]) - 1)
    starts = [0, *(e + 1 for e in ends[: len(found) - step])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[step - 1 :], strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    h = _shingles(_words(text), words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed integer."""

    def run(batches):
        import pyarrow as pa

        worker.begins("simhash")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fp = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """The signed masks of all changes of at most ``radius`` bits, no change first."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): links between ``nodes`` (node, fp), of distinct fp, that connect all within ``radius`` bits, verified."""
    if radius % 2:
        raise ValueError("the radius must be even: it is met from both sides")
    mask = F.explode(F.array(*map(F.lit, ball(radius // 2)))).alias("mask")
    variants = nodes.select("node", "fp", mask).select("node", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.select("node", "fp", F.min(F.struct("node", "fp")).over(Window.partitionBy("variant")).alias("to")).where(F.col("node") != F.col("to.node"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("to.fp"))) <= radius
    return met.where(near).select(F.col("node").alias("src"), F.col("to.node").alias("dst")).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Shingles are of lower-cased words between ASCII white space, over texts of any length; a bit that half the shingles
    have is zero. Null and empty texts have fingerprint zero and are linked like others; other columns don't matter. component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer. Rows
    that repeat a doc_id keep one row each. A null doc_id has its fingerprint and takes part in no component but its
    own, null. No documents give no rows.
    """
    found = written(fingerprints(texts(docs), words), "fingerprints")
    nodes = written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    joined = connected_components(links(nodes, radius))
    least = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = found.join(least, "fp", "left")
    return out.select("doc_id", hex_.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_fifth(shingles: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shingles at which a text meets all that are similar enough: the first ones by ``seen``, rare ones first, then by hash.

    Similar texts share 0.8 of the shingles of each at least. So of the shingles that both have, in an order that is the same for all
    texts, the first is among the first n - 0.8 n + 1 of each text of n.
    """
    few, many = ALIKE
    keep = len(shingles) - -(-few * len(shingles) // many) + 1
    return shingles[np.lexsort((shingles, seen[shingles % np.uint64(COUNTERS)]))[:keep]]


def parities(shingles: np.ndarray, width: int = PARITIES) -> np.ndarray:
    """A bit for each of ``width`` remainders of hashes, 64 to a number: whether an odd number of distinct shingles has it."""
    odd = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def wide_parities(shingles: np.ndarray) -> np.ndarray | None:
    """Parities of as many remainders as a text has shingles at least, a power of two, for texts of which ``PARITIES`` tell little."""
    return None if len(shingles) <= PARITIES else parities(shingles, 1 << (len(shingles) - 1).bit_length())


def could_be_alike(a: str, b: str) -> Column:
    """Whether sizes and parities of two texts leave it open that they are similar enough. Columns: a_size, a_parity, and b's."""
    few, many = ALIKE
    sizes = F.least(f"{a}_size", f"{b}_size") * many >= F.greatest(f"{a}_size", f"{b}_size") * few
    apart = F.lit(0)
    for n in range(PARITIES // 64):
        apart = apart + F.bit_count(F.get(f"{a}_parity", n).bitwiseXOR(F.get(f"{b}_parity", n)))
    near = apart * (many + few) <= (F.col(f"{a}_size") + F.col(f"{b}_size")) * (many - few)
    return sizes & near


def still_alike(a: str, b: str) -> Column:
    """Whether the wide parities, where both texts have them, leave it open too. Columns: a_size, a_wide, and b's.

    Of two sizes that are near enough one has twice the other's parities at most; these are folded, as a remainder's bit is that of the
    two remainders that it comes of.
    """
    few, many = ALIKE
    halves = lambda x: F.zip_with(F.slice(x, 1, F.expr(f"size({x}) div 2")), F.slice(x, F.expr(f"size({x}) div 2 + 1"), F.expr(f"size({x}) div 2")), lambda p, q: p.bitwiseXOR(q))
    as_wide_as = lambda x, y: F.when(F.size(x) == 2 * F.size(y), halves(x)).otherwise(F.col(x))
    bits = F.zip_with(as_wide_as(f"{a}_wide", f"{b}_wide"), as_wide_as(f"{b}_wide", f"{a}_wide"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    near = apart * (many + few) <= (F.col(f"{a}_size") + F.col(f"{b}_size")) * (many - few)
    return F.coalesce(near, F.lit(True))


def _identity(found: list[bytes]) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(found), SEED)).astype(np.int64))


def counters(docs: DataFrame) -> np.ndarray:
    """How many texts have shingles of each of ``COUNTERS`` remainders, 4 MB however many texts there are. They order shingles, so
    what is alike doesn't depend on them."""

    def count(batches):
        import zlib

        import pyarrow as pa

        worker.begins("simhash")
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for t in batch.slice(k, 256).column("text").to_pylist():
                    np.add.at(seen, (np.unique(_shingles(_words(t), WORDS)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        parts = [(n, zlib.compress(x.tobytes(), 1)) for n, x in enumerate(seen.reshape(SLICES, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["slice", "seen"])

    def add(batches):
        import zlib

        import pyarrow as pa

        worker.begins("simhash")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, x in zip(batch.column("slice").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                sums[n] = sums.get(n, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        packed = [x.astype(np.float32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "seen"])

    fields = "slice int, seen binary"
    out = np.zeros((SLICES, COUNTERS // SLICES), np.float32)
    for n, x in docs.select("text").mapInArrow(count, fields).repartition(SLICES, "slice").mapInArrow(add, fields).collect():
        out[n] = np.frombuffer(x, np.float32)
    return out.reshape(-1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, size, bands, parity, wide): h tells texts of other words apart, size counts distinct shingles, bands are those at
    which the text meets others."""
    seen = docs.sparkSession.sparkContext.broadcast(counters(docs))

    def run(batches):
        import pyarrow as pa

        worker.begins("simhash")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [_words(t) for t in part.column("text").to_pylist()]
                sets = [np.unique(_shingles(f, WORDS)) for f in found]
                hashed = [[y if y is None else y.view(np.int64) for y in (first_fifth(x, seen.value), parities(x), wide_parities(x))] for x in sets]
                columns = [pa.array([_identity(f) for f in found], pa.int64()), pa.array(map(len, sets), pa.int32()), *(pa.array([x[n] for x in hashed], pa.list_(pa.int64())) for n in (0, 1, 2))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "h", "size", "bands", "parity", "wide"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h long, size int, bands array<long>, parity array<long>, wide array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(h, shingles): the distinct shingles of texts."""

    def run(batches):
        import pyarrow as pa

        worker.begins("simhash")
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                found = [_words(t) for t in batch.slice(k, 64).column("text").to_pylist()]
                columns = [pa.array(map(_identity, found), pa.int64()), pa.array([np.unique(_shingles(f, WORDS)).view(np.int64) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "shingles"])

    return docs.select("text").mapInArrow(run, "h long, shingles array<long>")


#: What :func:`could_be_alike` looks at.
LOOKS = ("size", "parity")


def _side(nodes: DataFrame, name: str, looks: tuple[str, ...] = LOOKS) -> DataFrame:
    return nodes.select(F.col("h").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in looks))


def _alike(pairs: DataFrame, nodes: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst): those of ``pairs``, whose sizes and parities leave it open, whose shingles are similar enough, which is compared exactly.

    Long texts are looked at by their wide parities first, so that hardly any shingles are written but those of texts that are alike.
    """
    few, many = ALIKE
    with noted() as passed:
        could = written(pairs.distinct(), "candidates")
        asked = written(could.select(F.explode(F.array("src", "dst")).alias("h")).distinct(), "looked_at")
        long_ = first.where("wide is not null").join(F.broadcast(asked) if asked.count() <= ASKED else asked, "h", "left_semi")
        wide = written(long_.select("h", "size", "wide"), "wide")
        could = could.join(_side(wide, "src", ("size", "wide")), "src", "left").join(_side(wide, "dst", ("size", "wide")), "dst", "left")
        could = written(could.where(still_alike("src", "dst")).select("src", "dst"), "close")
        asked = could.select(F.explode(F.array("src", "dst")).alias("h")).distinct()
        ids, told = written_with(nodes.join(asked, "h", "left_semi").select(F.col("node").alias("doc_id")).distinct(), "asked", F.count(F.lit(1)).alias("n"))
        rows = docs.join(F.broadcast(ids) if told["n"] <= ASKED else ids, "doc_id", "left_semi")
        sets = written(shingle_sets(rows).join(asked, "h", "left_semi").dropDuplicates(["h"]), "shingles")
    side = lambda name: sets.select(F.col("h").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = could.join(side("src"), "src").join(side("dst"), "dst")
    shared, total = F.size(F.array_intersect("src_set", "dst_set")), F.size("src_set") + F.size("dst_set")
    out = written(both.where(shared * many >= (total - shared) * few).select("src", "dst"), "alike")
    drop_written(docs.sparkSession, passed)
    return out


def _first_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, first): h and the least doc_id, node, of each text, and its row of ``found`` that counts, so that bands aren't shuffled
    where up to ``ASKED`` rows are copies."""
    named = found.where("doc_id is not null")
    nodes = written(named.groupBy("h").agg(F.min("doc_id").alias("node"), F.min("row").alias("row")), "nodes")
    copies, told = written_with(named.select("row").join(nodes.select("row"), "row", "left_anti"), "copies", F.count(F.lit(1)).alias("n"))
    first = named.join(F.broadcast(copies), "row", "left_anti") if told["n"] <= ASKED else named.join(nodes.select("row"), "row", "left_semi")
    return nodes, first


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id reachable over similar texts.

    Texts of the same words are one node. At a shingle of :func:`first_fifth` all are compared with the one that meets most
    others, then all those that are not connected yet with one another, however many; all pairs that are similar enough meet.
    Sizes and parities are looked at for each such pair where they meet, which takes time with the square of a shingle's
    members that stay unlike; rows are made of those alone that may be alike.
    """
    docs = texts(docs)
    found = written(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes, first = _first_rows(found)
    members = first.select("h", F.explode("bands").alias("key"))
    members = written(members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "members")
    met = members.groupBy("h").agg(F.sum("n").alias("met"))
    looks = written(first.select("h", *LOOKS).join(met, "h"), "looks")
    heads = members.join(met, "h").groupBy("key").agg(F.max(F.struct("met", "h")).alias("head")).select("key", F.col("head.h").alias("dst"))
    near = members.join(heads, "key").where("h <> dst").select(F.col("h").alias("src"), "dst").distinct().join(_side(looks, "src"), "src").join(_side(looks, "dst"), "dst")
    linked = _alike(near.where(could_be_alike("src", "dst")).select("src", "dst"), nodes, first, docs)
    joined = written(connected_components(linked), "joined")
    apart = members.where("n > 2").join(joined.withColumnRenamed("node", "h"), "h", "left").select("h", "key", F.coalesce("component", "h").alias("component"))
    open_ = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    apart = written(apart.join(open_, "key").join(looks.select("h", *LOOKS), "h"), "apart")
    sides = [apart.select("key", F.col("h").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("component", *LOOKS))) for x in ("src", "dst")]
    # what can't be similar enough is left out where members meet, so no rows are made of it
    pairs = meet(*sides, ["key"], CROWD, (F.col("src") < F.col("dst")) & (F.col("src_component") != F.col("dst_component")) & could_be_alike("src", "dst")).select("src", "dst")
    linked = connected_components(linked.union(_alike(pairs, nodes, first, docs)))
    grouped = nodes.select("h", "node").join(linked.withColumnRenamed("node", "h"), "h", "left").select("h", "node", F.coalesce("component", "h").alias("component"))
    least = grouped.join(grouped.groupBy("component").agg(F.min("node").alias("component_id")), "component").select("h", "component_id")
    out = found.select("doc_id", "h").join(least, "h", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Documents without near-copies: of each component of :func:`near_groups` the row of the smallest doc_id stays,
    with all its columns.

    Rows with a null doc_id stay as well. Of rows that repeat the smallest doc_id all stay, as they are one document.
    Null and empty texts are copies of one another; texts of any length are compared whole. No documents give no rows.
    """
    with noted() as passed:
        groups = written(near_groups(docs), "groups")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    gone, told = written_with(gone.join(keep, "doc_id", "left_anti"), "gone", F.count(F.lit(1)).alias("n"))
    drop_written(docs.sparkSession, passed)  # the stages after this one find the disk as this one did
    return docs.join(F.broadcast(gone) if told["n"] <= ASKED else gone, "doc_id", "left_anti").select(docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))
