from paginal.operators import search
from paginal.streaming.incremental import index_stream, indexed


def test_incremental_index(spark, tmp_path):
    source = tmp_path / "in"
    for k, text in enumerate(["a b", "b c", "a c b"]):
        spark.createDataFrame([(k, text)], "page_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("page_id long, text string").parquet(str(source))
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    post = indexed(spark, str(tmp_path / "out"))
    m = search.matches_in_postings(post, ("a", "b"))
    assert sorted(map(tuple, search.intersect(m, ("a", "b")).collect())) == [(0, 2), (2, 2)]
    assert post.count() == 7
