"""The pipeline's stages against brute force on small tables."""

import corpus_pipeline
from sightline.llm import toxicity
from sightline.llm.common import table
from test_passages import by_force, slow_words


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, names = {r["doc_id"]: r for r in docs.collect()}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.count() == len(after) and set(after) <= set(before)
        if name == "toxicity":
            assert set(after) == {i for i, t in before.items() if model.score(t or "") < 0.5}
        elif name == "exact dedup":
            last = {t or "": i for i, t in sorted(before.items())}
            assert set(after) == set(last.values())
        elif name == "substring dedup":
            gone = {}
            for i, at, n in by_force(before.items()):
                gone.setdefault(i, set()).update(range(at, at + n))
            for i, t in before.items():
                assert slow_words(after[i] or "") == [w for p, w in enumerate(slow_words(t or "")) if p not in gone.get(i, ())]
        if name != "substring dedup":
            assert all(t == rows[i]["text"] for i, t in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
