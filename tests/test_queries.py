"""Queries over whole tables."""

from lectern.queries import QUERIES


def test_find_on_page_takes_every_item(spark, tmp_path):
    said = {k: f"Passage n{k}x of the bank says that word{k} stands before other{k} here." for k in range(30)}
    spark.createDataFrame(list(said.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100 + k, f"Some prose comes first. {t} More follows.") for k, t in said.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["find_on_page"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id, r.kind, r.at) for r in got) == [(k, 100 + k, "exact", 25) for k in said]
