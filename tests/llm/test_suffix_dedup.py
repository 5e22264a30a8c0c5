"""Suffix-array deduplication against a count of all passages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm.suffix_dedup import STOP, _ranges, suffix_dedup, suffix_ranks

SCHEMA = "doc_id long, text string, lang string, spans string, key long"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "xx", None, 1) for i, t in rows], SCHEMA)
    got = suffix_dedup(df, **options).collect()
    whole = [r for r in got if "\ufffd" not in r["text"]]
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole) and len(whole) >= len(got) // 2
    return sorted((tuple(r)[:5] for r in got), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(30) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 20) :], text(rng.randint(0, 15))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + k, rows[3][1]) for k in range(6)] + [(200 + k, rows[4][1][: 20 + k] + "#" + rows[4][1][20 + k :]) for k in range(25)]
    return rows + [(7, rows[7][1]), (None, rows[5][1]), (300, None), (301, ""), (302, "a" * 300), (303, "xyz" * 60), (304, shared[0] + shared[0])]


@pytest.mark.parametrize("seed, shard", [(1, 1 << 20), (2, 700), (3, 2000)])
def test_like_brute_force(spark, seed, shard):
    rows = corpus(seed)
    assert result(spark, rows, length=40, context=10, shard=shard) == brute(rows, 40)


def test_hot_key_over_many_shards(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=400))
    rows = [(k, base[: 3 * k] + "!" + base[3 * k + 1 :]) for k in range(60)]
    assert result(spark, rows, length=40, context=10, shard=300, most_sent=0) == brute(rows, 40)


def test_empty(spark):
    assert result(spark, [], length=40, context=10) == []


def test_ranks_need_no_bytes_beyond_a_unit():
    rng = random.Random(7)
    units = ["".join(rng.choices("ab", k=rng.randint(40, 90))).encode() for _ in range(60)]
    units += [u[k:] + u[:k] for u in units[:20] for k in (0, 3, 17)]
    data = np.frombuffer(b"".join(u + bytes([STOP]) for u in units), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in units]) - 1
    room = np.repeat(ends, [len(u) + 1 for u in units]) - np.arange(len(data))
    whole, ranks = suffix_ranks(data, 40), suffix_ranks(data, 40, room)
    starts = np.flatnonzero(room >= 40)
    passages = [data[p : p + 40].tobytes() for p in starts]
    order = np.argsort(ranks[starts], kind="stable")
    assert [passages[k] for k in order] == sorted(passages)
    for found in (whole, ranks):  # equal passages, and no others, have equal ranks
        assert len(set(zip(found[starts].tolist(), passages, strict=True))) == len(set(passages)) == len(set(found[starts].tolist()))


def test_ranges_of_all_arrays_at_once():
    flags = [[1, 1, 0, 1], [1], [0, 0], [], [0, 1, 1], [1, 1]]
    assert _ranges([np.array(f, bool) for f in flags]) == [(0, 0, 2), (0, 3, 4), (1, 0, 1), (4, 1, 3), (5, 0, 2)]
