"""Registered queries of the ten operators, with production parameters over their whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op1_bpe as op

    return op.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), finish=op.digest, schema=op.DIGEST)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op2_warc as op
    from lectern.llm.common import Workspace

    return op.read_archives(op.write_archives(Workspace(spark, "op2"), table(spark, sf_dir, "pages")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op3_tokens as op
    from lectern.llm.common import Workspace

    ws = Workspace(spark, "op3")
    return op.read_digests(op.write_ids(ws, table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op4_minhash as op

    return op.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op5_language as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return op.identify(docs).select("doc_id", op.held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: Verdict, host and path prefix of the URL rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op6_urls as op

    return op.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op7_spans as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op8_ann as op

    return op.search(table(spark, sf_dir, "embeddings"))


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op9_itq as op

    return op.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import op10_packing as op

    return op.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, finish=op.crc, schema=pa.schema([("ids_crc32", pa.int64())]))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_token_files, op4_minhash, op5_language, op6_urls, op7_spans, op8_ann, op9_itq, op10_packing)}


def _sql() -> dict[str, str]:
    from lectern.llm import op2_warc as two
    from lectern.llm import op9_itq as nine

    return {"op2_warc": two.SQL, "op9_itq": nine.SQL}


SQL = _sql()
