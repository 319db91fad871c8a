"""Inline paragraphs and documents that arrive as a stream."""

from pyspark.sql import functions as F

from clausewright.sources import inline
from clausewright.streaming import documents, evidence


def test_inline_paragraphs(spark):
    blocks = [
        ("a", 0, "Preface without a number."), ("a", 1, "1. Scope. It begins in 5. May. 2. Terms: 4. Not this. 3. Duty of care."), ("a", 2, "More of it; 4. Records stay."), ("a", 3, "9. New count. 10. Next: (1) first; (3) not yet; and (2) second or (3) third."), ("a", 4, None), ("a", 5, "  "),
        ("b", 0, "Text. 1. First. 2. Second."), ("b", 1, "3. third in small letters. 4. Fourth] 5. (Fifth)."),
    ]
    got = {}
    for r in inline.paragraphs(spark.createDataFrame(blocks, "doc string, pos int, text string").repartition(4)).orderBy("doc", "pos", "part").collect():
        got.setdefault(r.doc, []).append((r.pos, r.text))
    assert got == {
        "a": [(0, "Preface without a number."), (1, "1. Scope. It begins in 5. May."), (1, "2. Terms: 4. Not this."), (1, "3. Duty of care."), (2, "More of it;"), (2, "4. Records stay."), (3, "9. New count."), (3, "10. Next:"), (3, "(1) first; (3) not yet; and"), (3, "(2) second or"), (3, "(3) third.")],
        "b": [(0, "Text."), (0, "1. First."), (0, "2. Second."), (1, "3. third in small letters."), (1, "4. Fourth]"), (1, "5. (Fifth).")],
    }


def test_streamed_documents_equal_the_table_also_after_a_restart(spark, tmp_path):
    schema = "doc_id int, text string, source string"
    batches = [[(1, "a", "x"), (2, "b", "y"), (3, "a", "x")], [(4, "b", "y"), (5, "old", "x"), (6, None, "z")], [(7, "", "z"), (8, "c", None)]]
    sources = spark.createDataFrame([("x", "paper"), ("y", "web")], "source string, kind string")
    known = spark.range(1).select(F.sha2(F.lit("old"), 256).alias("content_hash"))
    folder, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))

    def run():
        live = documents.new_documents(documents.document_stream(spark, folder, schema, 1), sources, known)
        query = evidence.append_batches(live.select("content_hash", "kind"), out, mark).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        if n != 1:  # the second and third come together, after a restart
            run()
    run()  # nothing new
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = documents.new_documents(every, sources, known).select("content_hash", "kind")
    got = spark.read.parquet(out).select("content_hash", "kind")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4
    # a batch that runs again replaces what it wrote
    last = spark.read.parquet(f"{out}/batch=0")
    assert last.count() == 2
