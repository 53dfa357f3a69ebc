"""What a training sample takes if nothing else is asked for."""

import zlib

from vitrine.llm import labels


def test_sample_takes_long_texts_and_1500_rows_a_class(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('a', case when id % 10 = 0 then 20000 else 10 end) as text")
    marks = spark.range(5000).selectExpr("id as doc_id", "1 as quality", "cast(id % 3 = 0 as int) as toxic")
    rows, _ = labels.sample(docs, marks, "toxic")
    assert sum(mark == 0 for *_, mark in rows) == 1500 and any(len(text) == 20000 for _, text, _ in rows)


def test_length_leaves_no_text_out(spark):
    """The lengths of those taken are as they come: a share of long texts like that of all."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('a', case when id % 4 = 0 then 40000 else 10 end) as text")
    marks = spark.range(4000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 = 0 as int) as toxic")
    rows, _ = labels.sample(docs, marks, "toxic", most=4 << 20)
    toxic = [len(t) for _, t, m in rows if m]
    assert 0.4 < sum(n == 40000 for n in toxic) / len(toxic) < 0.6 and (4 << 20) - 40000 <= sum(toxic) <= 4 << 20
    assert sum(m == 0 for *_, m in rows) == 1500


def test_ids_without_text_take_no_place(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'text' end as text").unionByName(spark.range(10).selectExpr("id as doc_id", "'atext' as text"))
    marks = spark.range(6000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    rows, share = labels.sample(docs, marks, "toxic", rows=1000)
    assert len(rows) == 1000 and share == 0.0
    assert all(zlib.crc32(str(d).encode()) % 5 and t in ("text", "atext") for d, t, _ in rows)
    assert {t for d, t, _ in rows if d in (2, 4, 6, 8)} <= {"atext"}


def test_a_text_beyond_the_bound_is_passed_over(spark):
    docs = spark.createDataFrame([(k, "x" * (1000 if k == 3 else 10)) for k in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows, _ = labels.sample(docs, marks, "toxic", most=500)
    assert 3 not in {d for d, _, _ in rows} and len(rows) > 20
    assert labels.sample(docs.limit(0), marks, "toxic") == ([], 0.0) and labels.sample(docs, marks.limit(0), "toxic") == ([], None)
