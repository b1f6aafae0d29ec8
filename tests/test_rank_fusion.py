"""Fused ranking keeps candidates that only one of words and vectors has."""

from loomgraph.plans import queries as Q


def test_one_sided_candidates(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", [(i, t) for i, t in [(1, "red fox"), (2, "blue hen"), (3, "grey owl"), (4, "old oak"), (5, "red kite")]], "doc_id long, text string")
    write("benchmark", [(1, "kite"), (9, "owl")], "item_id long, text string")
    write("embeddings", [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in Q.QUERIES["rank_fusion"](spark, str(tmp_path)).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append(r.doc_id)
    assert set(got[1]) == {1, 2, 3, 5} and got[1][-1] == 3  # 5 has no vector, 2 no word of the item
    assert got[9] == [3]  # the item has no vector
