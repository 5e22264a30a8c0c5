"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of the terms' weights + sum over pairs of terms of the inner products of their factors):
the pairs catch an insult that meets a mention of a group where either alone is harmless. A text's terms are its
distinct lower-cased words, hashed into buckets.

The machine is trained in one task, on at most about ``SAMPLE`` labelled rows that are not held out, chosen by a hash of
their doc_id where there are more; everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import worker
from graphloom.llm.tables import table, texts

#: Labelled rows to train on, about; all their buckets are used.
SAMPLE = 12_000
BITS, RANK, EPOCHS, STEPS, BATCH, RATE, SHRINK = 16, 4, 12, 1500, 128, 0.02, 2e-4
LEAST, DEVIATIONS = 3, 4.0
#: A pair counts as meeting by more than chance where all pairs together would do so once in e to this power samples.
SURE = 3.0
#: How fast factors are learnt against weights: what single terms explain is theirs.
PAIRS = 0.1
WORD = re.compile(r"[^\W_]+")
REJECT = 0.3
REMEMBERED = 200_000

_buckets: dict[str, int] = {}
worker.remembers("toxicity", _buckets.clear)


def bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        if len(_buckets) < REMEMBERED:
            _buckets[word] = found
    return found


def terms(text: str) -> list[int]:
    """The distinct buckets of a text's words, in order."""
    return sorted({bucket(w) for w in set(WORD.findall(text.lower()))})


def _sums(flat: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[flat]`` over each text's terms."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values[flat], axis=0, dtype=np.float64)])
    return np.diff(total[np.concatenate([[0], ends])], axis=0)


def raw_scores(model: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Scores before the sigmoid. ``model``: bias in its last row, then per bucket weight and factors."""
    flat, ends = np.array([i for r in rows for i in r], np.int64), np.cumsum([len(r) for r in rows], dtype=np.int64)
    v = model[:-1, 1:]
    sums = _sums(flat, ends, np.concatenate([model[:-1, :1], v, (v * v).sum(axis=1, keepdims=True)], axis=1))
    return model[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which buckets tell a label at all: in ``LEAST`` rows, and more often with one label than chance allows (``DEVIATIONS``)."""
    n, flat = 1 << BITS, np.concatenate(rows)
    one = np.bincount(flat, np.repeat(y, [len(r) for r in rows]), n)
    seen, ones = np.bincount(flat, minlength=n), y.sum()
    share = seen / len(y)
    spread = np.sqrt(share * (1 - share) * (1 / ones + 1 / (len(y) - ones))) + 1e-12
    return (seen >= LEAST) & (np.abs(one / ones - (seen - one) / (len(y) - ones)) > DEVIATIONS * spread)


def paired(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which buckets, in ``LEAST`` rows, tell a label together with another one, beyond what both tell by themselves.

    Two buckets that add up have the sum of their log odds where they meet. The labels seen there instead must be less
    likely than one in all pairs (``SURE``), by Chernoff's bound, which holds for small counts too.
    """
    n, flat, sizes = 1 << BITS, np.concatenate(rows), [len(r) for r in rows]
    seen, one = np.bincount(flat, minlength=n), np.bincount(flat, np.repeat(y, sizes), n)
    used = np.flatnonzero(seen >= LEAST)
    out, place = np.zeros(n, bool), np.full(n, -1)
    place[used] = np.arange(len(used))
    own = [place[r][place[r] >= 0] for r in rows]
    logit = lambda p: np.log(p / (1 - p))
    all_ = logit((y.sum() + 0.5) / (len(y) + 1))
    odds = logit((one[used] + np.exp(all_) / (1 + np.exp(all_))) / (seen[used] + 1)) - all_
    least = np.log(max(1, len(used) * (len(used) - 1) / 2)) + SURE
    ends = np.cumsum([len(r) for r in own])
    flat, row = np.concatenate(own), np.repeat(np.arange(len(rows)), [len(r) for r in own])
    order = np.argsort(flat, kind="stable")
    # a row's buckets ascend, so those after a bucket's place are the ones that a pair hasn't been seen with
    holders = np.split(order, np.cumsum(seen[used])[:-1]) if len(used) else []
    for a, at in enumerate(holders):
        after = [flat[k + 1 : e] for k, e in zip(at.tolist(), ends[row[at]].tolist(), strict=True)]
        toxic = [x for x, i in zip(after, row[at].tolist(), strict=True) if y[i]]
        both = np.bincount(np.concatenate(after), minlength=len(used))
        with_one = np.bincount(np.concatenate(toxic), minlength=len(used)) if toxic else np.zeros(len(used), np.int64)
        b = np.flatnonzero(both >= LEAST)
        p, q = sigmoid(all_ + odds[a] + odds[b]), with_one[b] / both[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(q > 0, q * np.log(q / p), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
        sure = b[both[b] * far > least]
        if len(sure):
            out[used[a]] = True
            out[used[sure]] = True
    return out


def train(rows: list, labels: list[int], seed: int = 7) -> np.ndarray:
    """Logistic loss, adaptive steps, weights and factors shrunk towards zero; buckets that tell nothing stay there.

    Small samples are gone through more often, for ``STEPS`` steps at least. Without rows of both labels the machine knows the bias alone: the smoothed share of label 1.
    """
    n, rng = 1 << BITS, np.random.default_rng(seed)
    model = np.zeros((n + 1, RANK + 1))
    share = (sum(labels) + 1) / (len(labels) + 2)
    model[-1, 0] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        return model
    y, arrays = np.array(labels, np.float64), [np.array(r, np.int64) for r in rows]
    tells = telling(arrays, y) | paired(arrays, y)
    if not tells.any():
        return model
    model[:-1][tells, 1:] = rng.normal(0, 0.03, (int(tells.sum()), RANK))
    arrays = [a[tells[a]] for a in arrays]
    first, second, step = np.zeros_like(model), np.zeros_like(model), 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            own = [arrays[i] for i in part]
            flat, at = np.concatenate(own), np.repeat(np.arange(len(part)), [len(x) for x in own])
            ends = np.cumsum([len(x) for x in own])
            v = model[flat, 1:]
            sums = _sums(np.arange(len(flat)), ends, np.concatenate([model[flat, :1], v, (v * v).sum(axis=1, keepdims=True)], axis=1))
            z = model[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1])
            g = (sigmoid(z) - y[part]) / len(part)
            each = np.concatenate([np.ones((len(flat), 1)), np.clip(sums[at, 1:-1] - v, -5, 5)], axis=1) * g[at, None]
            used, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, each[:, c], len(used)) for c in range(RANK + 1)], axis=1)
            used, grad = np.append(used, n), np.concatenate([grad, [[g.sum(), *[0] * RANK]]])
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.999 * second[used] + 0.001 * grad**2
            move = RATE * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-6)
            move[:, 1:] *= PAIRS
            now = model[used] - move
            now[:-1] = np.sign(now[:-1]) * np.maximum(np.abs(now[:-1]) - SHRINK, 0)
            model[used] = now
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The machine trained on labelled documents that are not held out. Rows without doc_id or label are not used."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int(part * (1 << 40)))
    rows = texts(docs).join(chosen, "doc_id")

    def hashed(batches):
        import pyarrow as pa

        worker.begins("toxicity")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [terms(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    def learn(batches):
        import pyarrow as pa

        worker.begins("training")
        rows = []
        for batch in batches:
            column = batch.column("terms")
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            rows += [(doc, y, flat[a:b]) for doc, y, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), ends[:-1], ends[1:], strict=True)]
        rows.sort(key=lambda r: (r[0], r[2].tobytes()))  # the same order each time, whatever tasks were repeated
        model = train([r[2] for r in rows], [r[1] for r in rows])
        rows = batch = column = flat = ends = None
        worker.give_back()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.astype(np.float32).tobytes()], pa.binary())})

    found = rows.select("doc_id", "toxic", "text").mapInArrow(hashed, "doc_id long, toxic int, terms array<int>")
    # hashed by many tasks, learnt by one
    learnt = found.repartition(1).mapInArrow(learn, "model binary").collect()
    return np.frombuffer(learnt[0]["model"], np.float32).reshape(-1, RANK + 1).astype(np.float64) if learnt else train([], [])


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, score) of all documents under a trained machine, whose size is fixed, so it goes to all tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        worker.begins("toxicity")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = sigmoid(raw_scores(sent.value, [terms(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, over its whole text.

    Null and empty texts have the score of the bias; a text of any length is scored whole. Rows that repeat a doc_id
    are scored each; a null doc_id is kept and not held out. Of labels that repeat a doc_id the larger counts.
    Without labels every score is one half; a score of exactly ``REJECT`` rejects. No documents give no rows.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, with all their columns, that the machine doesn't reject.

    Rows that repeat one another have one score, so all of them stay or none does; null and empty texts are judged
    by the bias. No documents give no rows; without labels every score is one half and so every document goes.
    """
    model = fit(docs, labels)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        worker.begins("toxicity")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = sigmoid(raw_scores(sent.value, [terms(t or "") for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(found < REJECT))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents' scores, learnt from the labels that aren't held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
