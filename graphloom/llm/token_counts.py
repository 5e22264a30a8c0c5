"""Token counts from the counts of distinct pre-tokens, without the ids of any document.

1. Every pre-token (a chunk of :mod:`graphloom.llm.pretokens`) is counted over the corpus.
2. Each distinct one is encoded once; its number of pieces is all that is kept.
3. The documents' pre-token frequencies meet these numbers in a join and are summed.

Pre-tokens with at least one in ``HEAD`` of all occurrences, of which there can't be more than ``HEAD``, go to all
tasks as a table, long ones by a digest, so that its bytes are bounded too; a document's frequencies of these are summed
where they are counted, and only the rest, none of which is frequent, is shuffled for the join.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretokens import chunk_of, encoder, slices, vocabulary
from graphloom.llm.tables import table, texts
from graphloom.staging import written

#: At most so many pre-tokens are sent to all tasks, those longer than HEAD_CHARS as digests.
HEAD, HEAD_CHARS = 1 << 20, 64
#: Documents' own sums travel with made-up pre-tokens; so many of them spread the sums evenly.
SPREAD = 4096
#: No pre-token's key starts like this, as no chunk has white space after other characters.
OWN, DIGEST = "\0\0own ", "\0\0sha "


def pretoken_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """(key, freq) of every distinct pre-token of the texts."""

    def run(batches):
        import pyarrow as pa

        enc, seen = encoder(path), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "freq"])
            seen.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    seen.update(enc.keys(text))
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "key string, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))


def pieces_of(frequencies: DataFrame, path: str) -> DataFrame:
    """(key, freq, n): how many ids each distinct pre-token has."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                n = [len(x) // 4 for x in enc.ids(part.column("key").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("freq"), pa.array(n, pa.int32())], names=["key", "freq", "n"])

    return frequencies.mapInArrow(run, "key string, freq long, n int")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, over its whole text.

    A null text is empty; an empty one has no tokens; a text of any length is counted whole. Rows that repeat a doc_id are summed apart, as long as
    their texts differ; rows that repeat both give one row each. A null doc_id is kept. No rows give no rows.
    """
    spark, rows = docs.sparkSession, texts(docs)
    counted = written(pieces_of(pretoken_frequencies(rows, vocabulary(tokenizer)), vocabulary(tokenizer)), "pretokens")
    total = counted.agg(F.sum("freq").alias("n")).first()["n"] or 0
    short = F.when(F.length("key") <= HEAD_CHARS, F.col("key")).otherwise(F.concat(F.lit(DIGEST), F.sha2(F.col("key").cast("binary"), 256)))
    head = {r["key"]: r["n"] for r in counted.where(F.col("freq") * HEAD >= total).select(short.alias("key"), "n").toLocalIterator()}
    sent, name = spark.sparkContext.broadcast(head), tokenizer

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, head, n = encoder(vocabulary(name)), sent.value, TaskContext.get().partitionId() << 33
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "key": pa.string(), "freq": pa.int32(), "own": pa.int64(), "n_bytes": pa.int64()}
        for batch in batches:
            for part in slices(batch):
                row, doc, key, freq, own, size = [], [], [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n += 1
                    rest, known = [], 0
                    for k in enc.keys(text):
                        number = head.get(k if len(k) <= HEAD_CHARS else DIGEST + hashlib.sha256(k.encode()).hexdigest())
                        if number is None:
                            rest.append(k)
                        else:
                            known += number
                    found = Counter(rest)
                    row += [n] * (len(found) + 1)
                    doc += [doc_id] * (len(found) + 1)
                    key += [f"{OWN}{n % SPREAD}", *found]
                    freq += [1, *found.values()]
                    own += [known, *[0] * len(found)]
                    size += [len(text.encode()), *[0] * len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((row, doc, key, freq, own, size), kinds.values(), strict=True)], names=list(kinds))

    rest = rows.mapInArrow(run, "row long, doc_id long, key string, freq int, own long, n_bytes long")
    made_up = spark.range(SPREAD).select(F.concat(F.lit(OWN), F.col("id").cast("string")).alias("key"), F.lit(0).alias("n"))
    numbers = counted.where(F.col("freq") * HEAD < total).select("key", "n").unionByName(made_up)
    sums = rest.join(numbers, "key").groupBy("row", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), (F.sum("own") + F.sum(F.col("freq").cast("long") * F.col("n"))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
