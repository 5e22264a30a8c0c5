"""The pipeline against its stages applied by plain means."""

import corpus_pipeline
from graphloom.llm import queries


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        seen.append(ids)
        kept = after
    assert len(seen[0]) < docs.count() and seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] == seen[2]
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == seen[3]
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_stages_on_odd_documents(spark, docs, no_docs, odd_docs):
    sf = "/root/testdata/sf0.001"
    every = sorted(str(i) for i, _ in odd_docs)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).collect() == [], name
        rows = stage(spark, docs, sf).collect()
        ids = sorted(str(r["doc_id"]) for r in rows)
        assert set(ids) <= set(every), name
        if name == "packing":
            assert set(ids) == set(every)
            continue
        assert rows[0].__fields__ == docs.columns, name
        if name == "simhash":  # copies of text 5 go, and all texts without words but the first; rows without id stay
            blank = [i for i, t in odd_docs if i is not None and not (t or "").split()]
            assert ids.count("None") == 2 and not {"200", "201", "202", "203"} & set(ids) and ids.count("3") == 3 and [i for i in blank if str(i) in ids] == [min(blank)]
        if name in ("decontamination", "pii"):
            assert ids == every
        if name == "pii":
            assert sorted(str(r["text"]) for r in rows) == sorted(str(t) for _, t in odd_docs)
        if name == "toxicity":
            assert {"100", "101"} <= set(ids)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
