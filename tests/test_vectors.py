"""Vector search for many queries, and without the one query."""

from siftline.operators import history
from siftline.plans import bindings


def test_all_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "QUERY_BLOCK", 2)
    monkeypatch.setattr(history, "ROW_BLOCK", 7)
    rows = [(i, [float(i % 5), 1.0, i / 100]) for i in range(2, 260)] + [(900, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for q, v in rows[:-1]:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows[:-1])[:10]
            want |= {(q, i, round(-s, 6)) for s, i in scored if -s >= 0.3}
    got = {tuple(r) for r in bindings.QUERIES["vector_top_k_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 50
    assert bindings.QUERIES["vector_top_k"](spark, str(tmp_path)).count() == 0
