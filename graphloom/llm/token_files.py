"""Token ids in binary files of directly addressable codes.

An id is split into chunks of ``width`` bits, lowest first. Level k holds the k-th chunks of all ids that have
one, level 0 of all ids; a bitmap per level but the last says which of its chunks go on, and a rank directory
counts the set bits before each block of 512. So the place of an id's next chunk is a rank, and any id is read
without decoding others.

File, little-endian: ``GLDAC2\\0\\0``, then header counts as unsigned 64-bit integers (documents, ids, levels,
width, documents without an id, which come last), the length of each level, then the documents' ids (signed 64-bit, 0
without one), their starts within the file (unsigned 64-bit, one more than documents), and for each level its chunks (unsigned 8- or 16-bit), its bitmap
and its rank directory (unsigned 64-bit).
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretokens import encoder, slices, vocabulary
from graphloom.llm.tables import table, texts
from graphloom.staging import fresh_path

MAGIC, BLOCK, DEPTH = b"GLDAC2\0\0", 512, 4


def encode_levels(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level; there is one level at least."""
    kind, levels, rest = (np.uint8 if width == 8 else np.uint16), [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest >> np.uint32(width) > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        levels.append(((rest & np.uint32((1 << width) - 1)).astype(kind), np.packbits(more, bitorder="little"), np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint64)))
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            return levels


class CodeFile:
    """The ids of one file's documents, from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of codes")
        n_docs, self.n_ids, n_levels, self.width, n_nameless = map(int, np.frombuffer(data, "<u8", 5, 8))
        kind, at = ("<u1" if self.width == 8 else "<u2"), 48
        sizes = np.frombuffer(data, "<u8", n_levels, at)
        at += 8 * n_levels
        self.docs, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
        self.nameless = np.arange(n_docs) >= n_docs - n_nameless
        self.starts, at = np.frombuffer(data, "<u8", n_docs + 1, at), at + 8 * (n_docs + 1)
        self.levels = []
        for n in map(int, sizes):
            chunks = np.frombuffer(data, kind, n, at)
            at += chunks.nbytes
            bits = np.frombuffer(data, "<u1", -(-n // 8), at)
            at += bits.nbytes
            ranks = np.frombuffer(data, "<u8", -(-n // BLOCK) + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def dump(docs: list[int | None], counts: list[int], ids: np.ndarray, width: int = 8) -> bytes:
        """A file's bytes. Documents without an id (None) must be last."""
        levels = encode_levels(ids, width)
        head = [np.array([len(docs), len(ids), len(levels), width, docs.count(None), *(len(x[0]) for x in levels)], "<u8"), np.array([d or 0 for d in docs], "<i8"), np.concatenate([[0], np.cumsum(counts)]).astype("<u8")]
        return MAGIC + b"".join(x.tobytes() for x in [*head, *(y for x in levels for y in x)])

    def _goes_on(self, level: int, i: int) -> bool:
        return bool(self.levels[level][1][i >> 3] >> (i & 7) & 1)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, bits, ranks = self.levels[level]
        first = i // BLOCK * BLOCK
        inside = np.unpackbits(bits[first // 8 : -(-i // 8)], bitorder="little")[: i - first]
        return int(ranks[i // BLOCK]) + int(inside.sum())

    def id_at(self, i: int) -> int:
        """The i-th id, from one chunk and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for level, (chunks, _, _) in enumerate(self.levels):
            out |= int(chunks[i]) << (self.width * level)
            if not self._goes_on(level, i):
                break
            i = self._rank(level, i)
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end."""
        out, where, begin, stop = np.zeros(end - start, np.uint32), np.arange(end - start), start, end
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[begin:stop].astype(np.uint32) << np.uint32(self.width * level)
            more = np.unpackbits(bits[begin // 8 : -(-stop // 8)], bitorder="little")[begin % 8 : begin % 8 + stop - begin].astype(bool)
            where = where[more]
            if not len(where):
                break
            begin = self._rank(level, begin)
            stop = begin + len(where)
        return out


def _open(uri: str):
    """The file system of a URI and the path there, on whatever store the shared folder is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_bytes: int = 24 << 20) -> DataFrame:
    """Write all documents' ids, each with ``end_id`` after it, in ascending order of doc_id, then of a hash of the text; returns the manifest.

    The manifest has a row per file, in order: (shard, path, first_doc, last_doc, n_docs, n_tokens). A null text is
    an empty one; rows with a null doc_id come after all others, by the hash of their text. Rows that repeat a
    doc_id are all kept, those of one text next to one another. A text of any length is in one file; other columns don't matter. A file is written under another name and then moved, so a lost or repeated task leaves no
    half of one. No documents give no files.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    # ranges are drawn from a sample that the driver holds, so texts aren't part of the key
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    order = F.col("doc_id").asc_nulls_last(), F.col("h").asc()
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(vocabulary(tokenizer)), end_id.to_bytes(4, "little")
        doc_ids, counts, parts = [], [], []
        for batch in batches:
            for part in slices(batch):
                doc_ids += part.column("doc_id").to_pylist()
                got = enc.encode(part.column("text").to_pylist())
                counts += [len(x) // 4 + 1 for x in got]
                parts += [CodePart(got, end)]
        if not doc_ids:
            return
        ids = np.concatenate([p.ids for p in parts])
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        name = f"{at}/shard-{shard:06d}.dac"
        with store.open_output_stream(f"{name}.{attempt}") as out:
            out.write(CodeFile.dump(doc_ids, counts, ids))
        store.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/shard-{shard:06d}.dac"], "first_doc": pa.array([doc_ids[0]], pa.int64()), "last_doc": pa.array([doc_ids[-1]], pa.int64()), "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]})

    return ordered.mapInArrow(run, "shard int, path string, first_doc long, last_doc long, n_docs long, n_tokens long")


class CodePart:
    """The ids of a few texts with the end id after each, in the smallest type that holds them."""

    def __init__(self, encoded: list[bytes], end: bytes):
        ids = np.frombuffer(b"".join([y for x in encoded for y in (x, end)]), "<u4")
        self.ids = ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids


def read_token_files(manifest: list, spark) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest; start counts over all files.

    ``manifest``: its rows, one per file. A file is read by one task.
    """
    files = sorted(manifest, key=lambda r: r["shard"])
    starts = [0, *accumulate(r["n_tokens"] for r in files)]
    listed = spark.createDataFrame([(r["path"], s) for r, s in zip(files, starts, strict=False)], "path string, base long").repartition(max(1, len(files)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, at = _open(path)
                with store.open_input_stream(at) as f:
                    file = CodeFile(f.read())
                starts = file.starts.astype(np.int64)
                crc, step = [], 1 << 20
                for k in range(0, len(file.docs)):
                    a, b, c = int(starts[k]), int(starts[k + 1]), 0
                    for x in range(a, b, step):
                        c = zlib.crc32(file.ids(x, min(b, x + step)).astype("<u4").tobytes(), c)
                    crc.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(file.docs, pa.int64(), mask=file.nameless), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written to files, and what the files say of each document."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"))
    return read_token_files(manifest.collect(), spark)
