from passageworks.operators.chunking import chunk_prechunked
from passageworks.operators.pipeline import QuestionPipeline, hash_vectors


def test_questions_to_answers(spark):
    passages = [(1, "The mill of Leeds was built in 1804. It burned."), (2, "Bees live in hives."), (3, "The dam at Kiel holds water."), (4, ""), (5, None), (6, "東西")]
    chunks = chunk_prechunked(spark.createDataFrame(passages, "vec_id long, passage string"), "vec_id", "passage").withColumnRenamed("chunk_text", "text")
    store = chunks.join(hash_vectors(chunks, "vec_id", "text"), "vec_id")
    asked = spark.createDataFrame([(10, "when was the mill of Leeds built?"), (11, None), (12, "where do bees live?")], "sample_id long, query string")
    pipeline = QuestionPipeline(store, k=3, rerank_k=2)
    got = {r["sample_id"]: r for r in pipeline.run(asked).collect()}
    assert got[10]["answer"].strip() == "The mill of Leeds was built in 1804." and got[12]["reranked"][0]["chunk_id"] == "passage2"
    assert len(got[10]["retrieved"]) == 3 and [h["rank"] for h in got[10]["reranked"]] == [1, 2]
    assert got[11]["retrieved"] == [] and got[11]["answer"] == "" and "Question: " in got[11]["prompt"]
    plain = QuestionPipeline(store, score=None, k=3, rerank_k=2)
    first = {r["sample_id"]: r for r in plain.run(asked).collect()}[10]
    assert [h["chunk_id"] for h in first["reranked"]] == [h["chunk_id"] for h in first["retrieved"]][:2]
    assert plain.describe()["score"] == "passthrough"
