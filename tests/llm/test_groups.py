"""SimHash groups, decontamination, personal data, toxicity, top-k and chat formatting on small fixtures."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom import staging
from graphloom.llm import chat, decontaminate, pii, simhash, topk, toxicity


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# SimHash ------------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    own = [(i, slow_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in own if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in own:
            for j, b in own:
                if None not in (i, j) and (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted(((i, f"{f:016x}", label.get(i)) for i, f in own), key=str)


def test_simhash_groups(spark, docs, odd_docs, no_docs):
    assert rows_of(simhash.simhash_groups(docs)) == slow_groups(odd_docs)
    assert simhash.simhash_groups(no_docs).collect() == []


def test_simhash_chains(spark):
    rng = random.Random(8)
    prints = [0]
    for _ in range(60):
        prints.append(prints[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints += [rng.getrandbits(64) for _ in range(40)]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    from graphloom.operators.components import connected_components

    got = dict(tuple(r) for r in connected_components(simhash.links(nodes)).collect())
    values = list(dict.fromkeys(prints))
    label = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            label[i] = min(label[j] for j, b in enumerate(values) if (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(values))] == label


def slow_near_groups(rows):
    """{doc_id: smallest doc_id reachable over pairs that share 0.8 of their five-word shingles}."""
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((group[a], group[b]))
            group = {i: low if c == high else c for i, c in group.items()}
    return group


def near_copies():
    rng, rows = random.Random(21), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(60, 250))
        for changes in (0, 1, 2, 2, 3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    base = rng.choices(vocabulary, k=300)
    for _ in range(80):  # a crowd, in which copies of different changes are alike just by way of others
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(1, 9)):
            copy[at] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_groups_reach_similarity(spark):
    rows = near_copies()
    want = slow_near_groups(rows)
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert len(set(want.values())) < 0.7 * len(rows)
    assert got == want


def test_near_groups_lose_no_pair(spark):
    # pairs that share 8 of 10 shingles and not one of the MinHash bands that were used before
    rows = []
    for k in (4346, 4957, 8754):
        words = [f"w{k}x{n}" for n in range(13)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:12], "end"]))]
    want = {i: i // 2 * 2 for i, _ in rows}
    assert slow_near_groups(rows) == want
    assert dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_first_fifths_of_similar_texts_meet():
    rng = np.random.default_rng(25)
    for seen in (np.zeros(simhash.COUNTERS, np.float32), rng.integers(0, 9, simhash.COUNTERS).astype(np.float32)):
        for n in (1, 2, 4, 8, 9, 10, 40, 81, 200, 900):
            both = rng.integers(0, 1 << 64, n, np.uint64)
            for more in range(0, n // 4 + 1, max(1, n // 12)):  # all that is apart in one text, or in both
                x, y = rng.integers(0, 1 << 64, more, np.uint64), rng.integers(0, 1 << 64, n // 4 - more, np.uint64)
                a, b = (np.unique(np.concatenate([both, z])) for z in (x, y))
                assert np.intersect1d(simhash.first_fifth(a, seen), simhash.first_fifth(b, seen)).size


def test_near_groups_compare_all_of_a_crowded_band(spark, monkeypatch):
    rng, rows, sign = random.Random(22), [], simhash.signatures
    for k in range(50):
        words = [f"w{k}x{n}" for n in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:99], f"y{rng.random()}"]))]
    # all meet in one band, and nowhere else
    alone = F.transform("bands", lambda x, n: F.when(n == 0, F.lit(7)).otherwise(F.xxhash64("h", n)))
    monkeypatch.setattr(simhash, "signatures", lambda docs: sign(docs).withColumn("bands", alone))
    for crowd in (simhash.CROWD, 8):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
        assert got == {i: i // 2 * 2 for i, _ in rows}


def test_near_groups_make_no_rows_of_a_crowd_of_unlike_copies(spark, monkeypatch):
    rng, rows, sizes, write = random.Random(23), [], [], simhash.written

    def spy(df, name):
        out = write(df, name)
        if name == "candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", spy)
    base = [f"w{k}" for k in range(150)]
    for n in range(200):  # two of them share some 0.66 of their shingles
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"y{n}x{at}"
        rows.append((n, " ".join(copy)))
    rows += [(1000 + n, f"{rows[n][1]} end") for n in range(20)]
    want = slow_near_groups(rows)
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == want and len(set(want.values())) > 100
    assert sum(sizes) < 3 * len(rows)


def test_parities_differ_in_no_more_than_texts_do():
    rng = np.random.default_rng(24)
    for n, changed in ((0, 0), (1, 0), (1, 1), (60, 7), (400, 90), (5000, 3000)):
        both, x, y = (np.unique(rng.integers(0, 1 << 64, k, np.uint64)) for k in (n, changed, changed // 2))
        a, b = (np.unique(np.concatenate([both, z])) for z in (x, y))
        apart = len(np.setxor1d(a, b))
        differ = int(np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum())
        assert differ <= apart and (apart - differ) % 2 == 0
        assert apart > 150 or differ > 0.8 * apart or not apart


def long_copies():
    """Texts of over 1,024 shingles around 0.8, and unlike ones that share a passage."""
    rng, rows = random.Random(26), []
    for n in (1000, 1030, 1900, 2100, 4200):
        words = [f"v{n}x{k}" for k in range(n)]
        rows.append((len(rows), " ".join(words)))
        for more in (0, n // 12, n // 4, n // 4 + 1, n // 4 + 9):  # longer by a quarter of the shingles: just alike
            rows.append((len(rows), " ".join([*words, *(f"z{len(rows)}x{k}" for k in range(more))])))
        for changed in (9, 22, 24):
            copy = list(words)
            for at in rng.sample(range(n), n * changed // 1000):
                copy[at] = f"y{len(rows)}x{at}"
            rows.append((len(rows), " ".join(copy)))
    shared = [f"s{k}" for k in range(900)]
    return rows, [(1000 + n, " ".join([*(f"u{n}x{k}" for k in range(3000)), *shared])) for n in range(8)]


def test_near_groups_of_long_texts(spark, monkeypatch):
    rows, unlike = long_copies()
    read, sets = [], simhash.shingle_sets

    def spy(docs):
        read.extend(r["doc_id"] for r in docs.select("doc_id").collect())
        return sets(docs)

    monkeypatch.setattr(simhash, "shingle_sets", spy)
    want = slow_near_groups(rows + unlike)
    got = dict(simhash.near_groups(spark.createDataFrame(rows + unlike, "doc_id long, text string").repartition(3)).collect())
    assert got == want and 5 < len({want[i] for i, _ in rows}) < len(rows)
    # unlike texts meet at the passage that they share, and their shingles aren't written
    assert len(read) > 20 and not set(read) & {i for i, _ in unlike}


def test_wide_parities_lose_no_pair(spark):
    rng = np.random.default_rng(27)
    pairs, alike = [], []
    for n in (900, 1024, 1025, 1600, 2040, 2049, 5000):
        for more in (0.0, 0.1, 0.24, 0.25, 0.4):
            both = rng.integers(0, 1 << 64, n, np.uint64)
            a, b = both, np.unique(np.concatenate([both, rng.integers(0, 1 << 64, int(n * more), np.uint64)]))
            for x, y in ((a, b), (b, a)):
                wide = [w if w is None else w.view(np.int64).tolist() for w in map(simhash.wide_parities, (x, y))]
                pairs.append((len(x), wide[0], len(y), wide[1]))
                alike.append(5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)))
    df = spark.createDataFrame(pairs, "a_size int, a_wide array<long>, b_size int, b_wide array<long>").coalesce(1)
    got = [r[0] for r in df.select(simhash.still_alike("a", "b")).collect()]
    assert all(g for g, w in zip(got, alike, strict=True) if w) and not all(got) and all(g for g, p in zip(got, pairs, strict=True) if not (p[1] and p[3]))


def test_near_dedup_leaves_just_what_it_reads(spark, docs):
    with staging.noted() as paths:
        kept = simhash.near_dedup(docs)
    names = {p.rsplit("/", 1)[1].split("-")[0] for p in paths}
    left = [p for p in paths if p in staging._written]
    assert {"signatures", "members", "groups", "gone"} <= names and len(left) == 1 and "/gone-" in left[0]
    assert not [p for p in paths if p not in left and os.path.exists(p.removeprefix("file://"))] and os.path.exists(left[0].removeprefix("file://")) and kept.count()


def test_near_dedup_keeps_one_of_each(spark, docs, odd_docs):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    groups = slow_groups(odd_docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, c in groups if i is None or i == c)


def test_near_dedup_shuffles_no_texts(spark, docs, monkeypatch):
    limit, want = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, plan in ((simhash.ASKED, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(simhash, "ASKED", most)
            kept = simhash.near_dedup(docs)
            got = rows_of(kept)
            assert plan in kept._jdf.queryExecution().executedPlan().toString() and got == (want or got)
            want = got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# decontamination ----------------------------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def slow_contaminated(rows, items):
    out = {}
    for d, text in rows:
        w = words(text)
        for i, item in items:
            b = words(item)
            if d is None or i is None or len(b) < 5:
                continue
            for start in range(-len(b), len(w) + 1):
                n = sum(1 for k, x in enumerate(b) if 0 <= start + k < len(w) and w[start + k] == x)
                if n >= max(5, 0.8 * len(b)):
                    out[d, i] = max(out.get((d, i), (0, -(10**9), 0)), (n, -start, len(b)))
    return sorted(((d, i, n, m, -s) for (d, i), (m, s, n) in out.items()), key=str)


@pytest.mark.parametrize("most_sent", [1_000_000, 0])
def test_contaminated(spark, docs, odd_docs, no_docs, most_sent):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((4, 5, 6, 9, 10, 13, 20, 37))))) for k in range(25)] + [(50, None), (51, ""), (None, "a b c d e f g")]
    rows = list(odd_docs)
    for n in range(120):
        item = rng.choice(items[:25])[1].split()
        for at in rng.sample(range(len(item)), rng.randint(0, -(-len(item) // 4))):
            item[at] = "changed"
        rows.append((1000 + n, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 30)), *(x.upper() + rng.choice(("", ",")) for x in item), *rng.choices(vocabulary, k=rng.randint(0, 30))])))
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, seed string")
    assert rows_of(decontaminate.contaminated(frame, bench, most_sent=most_sent)) == slow_contaminated(rows, items)
    assert decontaminate.contaminated(no_docs, bench).collect() == [] == decontaminate.contaminated(frame, bench.limit(0)).collect()
    gone = {d for d, *_ in slow_contaminated(rows, items)}
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns and rows_of(kept.select("doc_id")) == sorted(((i,) for i, _ in rows if i not in gone), key=str)


# personal data ------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fine = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fine[k](m[0])]
    return sorted(found)


def pii_rows():
    rng = random.Random(10)
    pieces = ["a.b@c.de", "@x.y", "a@b", "a@b.c@d.e", "10.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", "007.08.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+441234567890.", "12345678901234567890", "word", "é日", " ", "  ", "\n", ".", "-", "+", "😀", "x" * 30, "0" * 12]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 14)))) for k in range(300)]
    return rows + [(400, None), (401, ""), (None, "me@here.org"), (5, rows[5][1]), (5, "10.1.1.1"), (402, "a" * 200_000), (403, "1" * 50_000), (404, "1 " * 30_000), (405, "ü a@b.co " * 300)]


def test_base_spans(spark, no_docs):
    rows = pii_rows()
    frame = spark.createDataFrame([(i, t, 1, "k", "m") for i, t in rows], "doc_id long, text string, h int, kind string, match string").repartition(3)
    got = [(*r[:6], ",".join(s for s in r[6].split(",") if s and not s.startswith("term"))) for r in rows_of(pii.pii_report(frame))]
    want = []
    for i, t in rows:
        spans = slow_base(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *(sum(1 for s in spans if s[3] == k) for k in PATTERNS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.pii_report(no_docs).collect() == []


def test_revealing_terms_and_redaction(spark):
    rows = [(k, f"filler{k} text stands here. Zanzibarov writes from bob@corp.example often about weather{k} things") for k in range(5)]
    rows += [(10 + k, f"other words, no person, number {k} about weather and things that often stand here") for k in range(200)]
    rows += [(300, None), (301, "Zanzibarov alone")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(frame).collect()}
    text = rows[0][1]
    at, mail = text.index("Zanzibarov"), text.index("bob@")
    marked = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans[0].split(","))}
    assert f"term:{at}:{at + 10}," in spans[0] and f"email:{mail}:{mail + 16}" in spans[0] and not marked & {"often", "here", "about", "things"}
    assert spans[10] == "" and spans[301] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert "bob@" not in clean[0] and "Zanzibarov" not in clean[0] and "<EMAIL>" in clean[0] and clean[10] == rows[5][1] and clean[300] is None
    assert pii.sanitise(frame).columns == frame.columns


def test_revealing_terms_far_from_the_entity(spark):
    far = " and so on it goes" * 10
    rows = [(k, f"Élan writes from bob@corp.example{far} to Qwertz{k}, and Qwertz again{far} Élan") for k in range(4)]
    rows += [(10 + k, f"it goes on and so, again, number {k} writes to from") for k in range(200)] + [(300, "mail ann@corp.example, Qwertz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(frame).collect()}
    text = rows[0][1]
    want = sorted([(m.start(), 4, m.end()) for m in re.finditer("Qwertz|Élan", text)] + [(text.index("bob"), 0, text.index("bob") + 16)])
    assert spans[0] == ",".join(f"{'term' if k else 'email'}:{a}:{b}" for a, k, b in want)
    assert spans[300] == "email:5:21"  # holds another entity
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}[3] == rows[3][1].replace("Qwertz", "").replace("Élan", "").replace("bob@corp.example", "<EMAIL>")


def test_repeated_rows_change_no_terms(spark):
    rows = [(k, f"filler{k} text stands here. Zanzibarov writes from bob@corp.example often about weather{k} things") for k in range(5)]
    rows += [(10 + k, f"other words, no person, number {k} about weather and things that often stand here") for k in range(200)]
    rows += [(301, "Zanzibarov alone"), (None, "nobody, Zanzibarov")]
    for everywhere in (False, True):
        told = []
        for again in (1, 7):
            frame = spark.createDataFrame(rows + rows[:1] * (again - 1) + rows[-1:] * (again - 1), "doc_id long, text string")
            told.append({tuple(r) for r in pii.pii_report(frame, everywhere=everywhere).collect()})
        assert told[0] == told[1]
        marked = {r[0]: r[-1] for r in told[0]}
        assert "term" in marked[0] and marked[301] == ("term:0:10" if everywhere else "") and marked[None] == ("term:8:18" if everywhere else "")
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame, everywhere=everywhere).collect()}
        assert clean[301] == (" alone" if everywhere else "Zanzibarov alone") and "Zanzibarov" not in clean[0]


def slow_terms(rows, support, share, bits):
    """{(doc_id, text): revealing terms} by counting all pairs of terms and entities in distinct documents."""
    docs = list(dict.fromkeys((i, t or "") for i, t in rows))
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for _, t in docs]
    held = [{f"{k}:" + (t[a:b].lower() if k == "email" else t[a:b] if k == "ip" else re.sub("[^0-9]", "", t[a:b])) for a, _, b, k in slow_base(t)} for _, t in docs]
    n_term, n_entity = (itertools.chain.from_iterable(x) for x in (words, held))
    n_term, n_entity = pd_counts(n_term), pd_counts(n_entity)
    both = pd_counts((w, e) for ws, es in zip(words, held, strict=True) for w in ws for e in es)
    fine = {p for p, n in both.items() if n >= support and n >= share * n_term[p[0]] and np.log2(n * len(docs) / n_term[p[0]] / n_entity[p[1]]) >= bits}
    return {d: {w for w in ws for e in es if (w, e) in fine} for d, ws, es in zip(docs, words, held, strict=True)}


def pd_counts(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_terms_like_brute_force(spark):
    rng = random.Random(31)
    names, mails = [f"name{chr(97 + k)}" for k in range(12)], [f"m{k}@x.org" for k in range(6)] + ["10.0.0.7", "+1 555 123 4567"]
    rows = [(k, " ".join(rng.choices(names, k=rng.randint(0, 3)) + rng.choices(mails, k=rng.choice((0, 0, 1, 2))) + rng.choices(["alpha", "beta", "gamma", "of"], k=5))) for k in range(400)]
    rows = [(i, f"{t} friend{chr(97 + mails.index(m))}" if (m := next((x for x in mails if x in t.split()), None)) and rng.random() < 0.7 else t) for i, t in rows]
    rows += rows[:40] + [(900, None), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d: x for d, x in slow_terms(rows, 3, 0.5, 2.0).items() if x}
    got = {}
    terms, _ = pii.revealing_terms(frame, pii.base_spans(frame).cache(), 3, 0.5, 2.0, most_sent=0)
    texts_of = {(d, h): t for d, h, t in frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))).collect()}
    for r in terms.collect():
        got.setdefault((r["doc_id"], texts_of[r["doc_id"], r["h"]]), set()).add(r["term"])
    assert got == want and len(want) > 20


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (pii.pii_report(frame), pii.sanitise(frame), decontaminate.contaminated(frame, bench)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


# toxicity -----------------------------------------------------------------------------------------------------

def toxic_corpus(n=1500):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(400)]
    out = []
    for i in range(n):
        said = rng.choices(words, k=rng.randint(5, 60))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        said += ["insult"] * insult + ["group"] * group
        rng.shuffle(said)
        out.append((i, " ".join(said), int(insult and group)))
    return out


def test_toxicity_learns_pairs(spark):
    rows = toxic_corpus()
    frame = spark.createDataFrame([(i, t, "xx", 5) for i, t, _ in rows] + [(5000, None, "", 1), (5001, "", "", 1), (None, "insult group", "", 1)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, 1, y, "e") for i, _, y in rows] + [(None, 1, 1, "e"), (1, 1, None, "e"), (9999, 1, 1, "e")], "doc_id long, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    assert len(got) == len(rows) + 3 and not got[None]["held_out"]
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"]
    kept = toxicity.not_toxic(frame, labels)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_learns_pairs_that_tell_nothing_alone():
    rng = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    texts, labels = [], []
    for i in range(3000):
        a, b = i % 2, i // 2 % 2
        texts.append(toxicity.terms(" ".join(rng.choices(words, k=rng.randint(5, 60)) + ["left"] * a + ["right"] * b)))
        labels.append(a ^ b)
    y = np.array(labels[:2400])
    assert not toxicity.telling([np.array(t) for t in texts[:2400]], y)[[toxicity.bucket("left"), toxicity.bucket("right")]].any()
    assert toxicity.paired([np.array(t) for t in texts[:2400]], y).nonzero()[0].tolist() == sorted([toxicity.bucket("left"), toxicity.bucket("right")])
    got = toxicity.sigmoid(toxicity.raw_scores(toxicity.train(texts[:2400], labels[:2400]), texts[2400:]))
    assert ((got >= 0.5) == np.array(labels[2400:])).mean() > 0.95


def test_toxicity_learns_from_all_of_a_long_text(spark):
    filler = " ".join(f"word{k}" for k in range(6000))
    told = max((f"bad{k}" for k in range(500)), key=lambda w: toxicity.bucket(w) * 0x9E3779B1 & 0xFFFFFFFF)
    frame = spark.createDataFrame([(i, f"{filler} {told}" if i % 2 else filler) for i in range(80)], "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    assert toxicity.bucket(told) not in toxicity.terms(filler) and model[toxicity.bucket(told), 0] > 0.5


def test_toxicity_without_labels_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(no_docs, none).collect() == []


# top-k --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("rows", [16, 4096])
def test_topk(spark, rows):
    rng = np.random.default_rng(12)
    data = [(i, [float(x) for x in rng.normal(0, 1, 8).astype(np.float32)]) for i in range(230)]
    data += [(300 + k, data[7][1]) for k in range(20)] + [(50, data[3][1]), (400, None), (None, data[1][1]), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (450, [float("inf")] * 8), (500, [1e15] * 8), (501, [1e15] * 8), (550, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int")
    fine = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(object)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, [int(x) for x in v]) for i, v in fine]
    want = []
    for n, (q, a) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(fine) if m != n and len(a) == len(b) and abs(sum(x * y for x, y in zip(a, b))) < 1 << 63)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    small = [x for x in want if x[0] != 500]
    got = [r for r in rows_of(topk.exact_topk(frame.where("vec_id not in (500, 501) or vec_id is null"), rows=rows, fan=3)) if r[0] != 500]
    assert got == sorted([x for x in small if x[2] not in (500, 501)], key=str)
    assert topk.exact_topk(frame.limit(0)).collect() == []


def test_topk_compares_equal_vectors_once(spark, monkeypatch):
    sizes, write = {}, topk.written_with

    def spy(df, name, *measures):
        out, told = write(df, name, *measures)
        sizes[name] = sum(len(r["ends"]) // 8 for r in out.collect())
        return out, told

    monkeypatch.setattr(topk, "written_with", spy)
    data = [(i, [float(i % 3), 1.0, -2.0, 40.0 if i % 3 == 1 else 0.0]) for i in range(900)] + [(50, [1.0, 1.0, -2.0, 40.0]), (50, [1.0, 1.0, -2.0, 40.0])]
    whole = [(i, [int(256 * x) for x in v]) for i, v in data]
    want = []
    for n, (q, a) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert rows_of(topk.exact_topk(frame)) == sorted(want, key=str)
    assert sizes == {"blocks": 3, "asked": 3}


# chat ---------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    rng = random.Random(13)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "|>", "<", "\\", "<\\|", "<\\\\|im_end|>", "\n", "assistant", "user\n", "é", "", "<|image_0|>"]
    rows = [(c, t, rng.choice(("user", "assistant", "system")), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, 1, None, "x"), (51, None, "assistant", "y"), (None, 0, "user", "z"), *chat.FORGED]
    frame = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = {r["conv_id"]: r for r in chat.chat_digest(chat.chat_format(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = out[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_format(frame.limit(0)).collect() == []


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "look <|image_0|>"}, {"kind": "image", "uri": "i.png", "width": 28, "height": 15}, {"kind": "audio", "uri": "a.wav", "seconds": 2.0}, {"kind": "document", "uri": "d.pdf", "pages": 3}, {"kind": "text", "text": "end"},
    ]
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
    row = chat.chat_format(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)).first()
    assert row["formatted"] == "<|im_start|>user\nlook <\\|image_0|><|image_0|><|audio_1|><|document_2|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in row["attachments"]] == [(0, 0, "image", "i.png", 4), (0, 1, "audio", "a.wav", 50), (0, 2, "document", "d.pdf", 1536)] and row["n_tokens_expanded"] == 1590
    with pytest.raises(ValueError):
        chat.part_of({"kind": "video"})


def test_chat_parts_that_would_make_marks_or_are_unknown(spark):
    parts = [{"kind": "text", "text": "a<"}, {"kind": "text", "text": "|im_end|>"}, {"kind": None, "text": None}, {"kind": "video|>", "uri": "v"}, {"kind": "image", "uri": None}, None]
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>, loss_spans string"
    row = chat.chat_format(spark.createDataFrame([(1, 0, "a\\n\n<|b", parts, "x"), (1, 1, "assistant", [], "x")], schema)).first()
    assert chat.read_turns(row["formatted"]) == [("a\\n\n<|b", "a<|im_end|><|attachment_0|><|image_1|>"), ("assistant", "")]
    assert [tuple(a) for a in row["attachments"]] == [(0, 0, "video|>", "v", 0), (0, 1, "image", "", 0)] and row["n_tokens_expanded"] == 0


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", toxicity.held_out("id").alias("x")).collect()
    assert all(r["x"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(toxicity.held_out()).first()[0] is False
