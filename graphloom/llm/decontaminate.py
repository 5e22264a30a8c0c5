"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A mask keeps five words of a window and ignores the positions between them. Each mask's words are hashed at every
place of a document and of a benchmark item; equal hashes propose that the item lies in the document along a
diagonal (place in the document less place in the item), and the whole item is then compared along it, word by word.
An item is contained where at least ``SIMILARITY`` of its words, and five, agree.

The masks leave no such diagonal out: of an item's windows of six words one has at most one substitution, and then
it holds five words in a row or a mask with one gap; items of ten words with two neighbouring substitutions in the
middle need the mask with a gap of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import table, texts
from graphloom.staging import written

#: Offsets of the words that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5), (0, 1, 2, 3, 6))
WEIGHT, SIMILARITY = 5, 0.8
#: Benchmark seeds up to this number go to all tasks; beyond it, both sides are shuffled by hash.
MOST_SENT = 1_000_000


def words(text: str = "text") -> Column:
    """A text's lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _xor(first: Column, *more: Column) -> Column:
    for x in more:
        first = first.bitwiseXOR(x)
    return first


def _places(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each mask at each place of ``w``: at, seed. A seed is made of the words' hashes, each turned by its offset."""
    hashed = rows.where(F.size("w") >= WEIGHT).select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))
    at = hashed.select(*keep, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - WEIGHT)).alias("at"))
    near = at.select(*keep, "at", *(_turned(F.get("hashes", F.col("at") + o), 9 * o).alias(f"h{o}") for o in range(max(map(max, MASKS)) + 1)))
    seeds = F.array(*(_xor(F.lit(n), *(F.col(f"h{o}") for o in mask)) for n, mask in enumerate(MASKS)))
    return near.select(*keep, "at", F.explode(seeds).alias("seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, start): each benchmark item that a document contains, at its best place.

    n_words: of the item; start: place of its first word in the document, negative if that is cut off; of places
    with as many words matched the first. Words are lower-cased runs of letters and digits. Null texts are empty;
    items of fewer than five words can't be told from chance and take no part, nor do rows with a null id. Rows that
    repeat an id count as one. Texts of any length are searched whole; other columns don't matter. Empty tables give no rows.
    """
    own = texts(docs).where("doc_id is not null").select("doc_id", words().alias("w"))
    items = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).select("item_id", words().alias("w")).where(F.size("w") >= WEIGHT).distinct()
    items = written(items, "items")
    seeds = written(_places(items, "item_id").select("seed", "item_id", "at").distinct(), "seeds")
    sent = F.broadcast if seeds.count() <= most_sent else lambda df: df
    whole = items.select("item_id", F.col("w").alias("item"))
    proposed = seeds.select("seed", "item_id", F.col("at").alias("item_at"))
    hits = _places(own, "doc_id").join(sent(proposed), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start"))
    # a diagonal is compared once, however many of its seeds agree, and only texts with one are read again
    hits = written(hits.distinct(), "hits")
    some = own.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = hits.join(sent(whole), "item_id").join(some, "doc_id")
    agree = F.size(F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda i: F.get("w", F.col("start") + i) == F.get("item", i)))
    found = hits.select("doc_id", "item_id", F.size("item").cast("long").alias("n_words"), agree.cast("long").alias("n_matched"), F.col("start").cast("long").alias("start"))
    good = found.where((F.col("n_matched") >= F.col("n_words") * similarity) & (F.col("n_matched") >= WEIGHT))
    best = F.max(F.struct("n_matched", (-F.col("start")).alias("back"), "n_words"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_words", "b.n_matched", (-F.col("b.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, with all their columns, that contain no benchmark item.

    Rows with a null doc_id stay, as do null and empty texts. Rows that repeat a doc_id go together, if one of them contains
    an item. An empty benchmark leaves all documents, no documents give no rows.
    """
    gone = written(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents that contain a benchmark item, and which."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b WHERE len(w) >= 5),
m AS (
  SELECT doc_id, item_id, n, p - i AS start, count(*) AS n_matched
  FROM dw JOIN bw USING (word)
  GROUP BY ALL HAVING count(*) * 5 >= n * 4 AND count(*) >= 5
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, start) AS k FROM m
)
SELECT doc_id, item_id, n AS n_words, n_matched, start FROM r WHERE k = 1
"""
