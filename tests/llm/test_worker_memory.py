"""What a Python worker holds: of a batch, and between tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ascribe.llm import ngram_join, packing
from ascribe.llm.tokens import ChunkTokenizer, vocabulary_json
from ascribe.session import ARROW_BYTES, BATCH_BYTES


def largest_batch(docs):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"])
    return docs.mapInArrow(sizes, "b bigint").agg(F.max("b")).first()[0]


@pytest.fixture
def long_texts(spark):
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.unset(ARROW_BYTES)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 224)))
    yield spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    spark.conf.unset(ARROW_BYTES)
    if before is not None:
        spark.conf.set(ARROW_BYTES, before)


def test_batches_of_long_texts_are_bounded_by_bytes(spark, long_texts):
    few = long_texts.where("doc_id < 3")
    for operator in (ngram_join.near_duplicates, packing.pack):
        spark.conf.unset(ARROW_BYTES)
        operator(few).count()
        assert largest_batch(long_texts) < 2 * BATCH_BYTES             # 9 MB in one batch of up to 10,000 rows


def test_a_bound_of_the_session_is_kept(spark, long_texts):
    spark.conf.set(ARROW_BYTES, "100000")
    packing.pack(long_texts.where("doc_id < 3")).count()
    assert spark.conf.get(ARROW_BYTES) == "100000"


def test_packing_leaves_no_chunks_in_the_worker(spark, long_texts):
    def kept(batches):
        from ascribe.llm.tokens import _WORKER
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([max([t.rows for t in _WORKER.values()], default=0)])], names=["n"])
    packing.pack(long_texts, partitions=4).count()
    assert spark.range(64).repartition(32).mapInArrow(kept, "n bigint").agg(F.max("n")).first()[0] <= 1


def test_ids_are_alike_after_forgetting():
    tokenizer = ChunkTokenizer(vocabulary_json())
    texts = ["Some words, some Words.", None, "again: words"]
    first = [x.tolist() for x in tokenizer.encode(texts)]
    tokenizer.forget()
    assert tokenizer.rows == 1
    assert [x.tolist() for x in tokenizer.encode(texts)] == first
