"""Ids, files of ids, counts and packing against the library on whole texts."""

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm.packing import PIECES, best_fit, crossover, evolve, pack, pack_pieces, trade
from graphloom.llm.pretokens import ChunkEncoder, chunk_of, encoder, key_of, vocabulary
from graphloom.llm.token_counts import token_counts
from graphloom.llm.token_files import CodeFile, read_token_files, write_token_files
from graphloom.staging import fresh_path

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary(NAME))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_keys_are_reversible():
    for chunk in (" a", "a", "\na", " \na", "  a", "\0a", " \0a", " ", "\n", "\t", "  "):
        assert chunk_of(key_of(chunk)) == chunk


@pytest.mark.parametrize("name", [NAME, "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name):
    rng, enc = random.Random(4), ChunkEncoder(vocabulary(name))
    if not enc.byte_level:
        pytest.skip("this vocabulary isn't byte-level: chunks go to the library whole")
    alphabet = [chr(c) for c in [*range(0x180), 0x2000, 0x2003, 0x200B, 0x2028, 0x3000, 0x1680, 0xFEFF, 0x4E00, 0x1F600, 0x660]] + [" "] * 60 + ["\n"] * 20 + ["'s", "'ll", "<|endoftext|>", "<|endoftext|"] * 8
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert enc.encode([text])[0] == packed(enc.tokenizer.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("width", [8, 16])
def test_code_file_gives_any_id(width):
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 200, 700), rng.integers(0, 50_257, 2000), rng.integers(0, 1 << 32, 50, dtype=np.uint64)]).astype(np.uint32)
    file = CodeFile(CodeFile.dump([4, 9], [700, 2050], ids, width))
    assert [file.id_at(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (513, 1030), (700, 700), (2700, 2750)):
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file.id_at(len(ids))
    empty = CodeFile(CodeFile.dump([1], [0], np.zeros(0, np.uint32)))
    assert empty.ids(0, 0).tolist() == [] and list(empty.starts) == [0, 0]


def test_files_read_back(spark, docs, odd_docs, library):
    manifest = write_token_files(docs.where("doc_id is not null"), fresh_path(spark, "t"), shard_bytes=4000).collect()
    assert len(manifest) > 2 and [m["first_doc"] for m in sorted(manifest, key=lambda m: m["shard"])] == sorted(m["first_doc"] for m in manifest)
    got = sorted(map(tuple, read_token_files(manifest, spark).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _ in odd_docs if i is not None)
    want = sorted((i, len(ids), zlib.crc32(packed(ids))) for i, t in odd_docs if i is not None for ids in [[*library(t), 0]])
    assert sorted((i, n, c) for i, _, n, c in got) == want
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]


def test_files_keep_documents_without_id_last(spark, docs, odd_docs, library):
    got = sorted(read_token_files(write_token_files(docs, fresh_path(spark, "t"), shard_bytes=4000).collect(), spark).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [*sorted(i for i, _ in odd_docs if i is not None), None, None]
    want = [(len(ids), zlib.crc32(packed(ids))) for i, t in odd_docs if i is None for ids in [[*library(t), 0]]]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got[-2:]) == sorted(want)


def test_files_take_no_documents(spark, no_docs):
    manifest = write_token_files(no_docs, fresh_path(spark, "t")).collect()
    assert manifest == [] and read_token_files(manifest, spark).collect() == []


def test_counts(docs, odd_docs, library):
    got = sorted((tuple(r) for r in token_counts(docs, limit=20).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n, n > 20) for i, t in odd_docs for n in [len(library(t))]), key=str)


def test_counts_without_head(docs, odd_docs, library, monkeypatch):
    from graphloom.llm import token_counts as module

    monkeypatch.setattr(module, "HEAD", 10)
    got = sorted((tuple(r)[:3] for r in module.token_counts(docs).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library(t))) for i, t in odd_docs), key=str)


def test_counts_of_nothing(no_docs):
    assert token_counts(no_docs).collect() == []


def test_packing(docs, odd_docs, library):
    capacity = 128
    got = pack(docs, capacity=capacity).collect()
    want = []
    for i, t in odd_docs:
        ids = [*library(t), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(packed(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // capacity) + 1


def test_packing_beats_best_fit(spark):
    rng = random.Random(12)
    size = [rng.randint(26, 50) for _ in range(1200)] + [100] * 5
    rows = [(None if k % 9 == 0 else k % 7, k, 0, 0, n, k, k if n == 100 else None) for k, n in enumerate(size)]
    got = pack_pieces(spark.createDataFrame(rows, PIECES), capacity=100, block=400).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["ids_crc32"] for r in got) == list(range(len(size)))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 100
    alone = best_fit([], [], sorted(range(len(size)), key=lambda i: -size[i]), size, 100)
    assert len(bins) < 0.97 * len(alone[0])


def test_trades_keep_every_piece_and_fill():
    rng = random.Random(15)
    size = [rng.randint(1, 60) for _ in range(200)]
    bins, fill = best_fit([], [], list(range(150)), size, 100)
    before = list(fill)
    lost = trade(bins, fill, list(range(150, 200)), size, 100)
    assert sorted([i for b in bins for i in b] + lost) == list(range(200)) and all(100 >= b >= a for a, b in zip(before, fill)) and sum(fill) > sum(before)
    assert fill == [sum(size[i] for i in b) for b in bins] and [size[i] for i in lost] == sorted(size[i] for i in lost)


def test_packing_nothing(no_docs):
    assert pack(no_docs).collect() == []


def test_crossover_keeps_every_piece():
    rng = random.Random(6)
    size = [rng.randint(1, 99) for _ in range(300)]
    order = list(range(300))
    a = best_fit([], [], order, size, 100)
    rng.shuffle(order)
    b = best_fit([], [], order, size, 100)
    for _ in range(20):
        a = crossover(a, b, size, 100, rng)
        assert sorted(i for x in a[0] for i in x) == list(range(300))
        assert a[1] == [sum(size[i] for i in x) for x in a[0]] and max(a[1]) <= 100


def test_evolution_improves_a_poor_start():
    rng = random.Random(7)
    size = [rng.choice((34, 33, 51, 49, 20, 26)) for _ in range(400)]
    poor = best_fit([], [], sorted(range(400), key=lambda i: size[i]), size, 100)
    found = evolve(size, 100, [poor[0]], 1, 4, 30)
    assert len(found[0][0]) < len(poor[0]) and sorted(i for x in found[0][0] for i in x) == list(range(400))


def test_encoder_is_shared():
    assert encoder(vocabulary(NAME)) is encoder(vocabulary(NAME))
