"""The sample of op3 holds one text of a repeated key."""

from pyspark.sql import functions as F

from coldgraph.llm import language

SF = "/root/testdata/sf0.001"


def test_language_sample_holds_one_row_of_a_repeated_key(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull())
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1)
    again = docs.unionByName(first.crossJoin(spark.range(500)).drop("id").select(docs.columns))
    found, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda names, rows: found.append([(n, g.tolist(), c.tolist()) for n, g, c in rows]) or fit(names, rows))
    for table in (docs, again):
        language.learn_languages(table, rows=20)
    assert found[0] == found[1] and 20 <= len(found[0]) <= 20 * known.select("lang").distinct().count()
