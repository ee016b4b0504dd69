from __future__ import annotations

import random

import corpus_pipeline


def test_stages_over_documents(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice(['an', 'or', 'et'])}{rng.randrange(60)}" for _ in range(n))
    line = "a line that is repeated in a number of documents"
    rows = [(i, f"{prose(60)}\n{line if i % 3 == 0 else prose(9)}\n{prose(40)}") for i in range(90)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, "too short"), (201, None), (202, " ".join(w + "###" for w in prose(120).split()))]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in now.collect()})
    clean = {i for i, _ in rows if i < 200}
    assert set(seen[0]) == clean and set(seen[1]) == clean and set(seen[2]) == set(range(90))
    assert sum(line in t for t in seen[1].values()) == 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(90))
    assert out.where("start = 0").count() == 90
