"""From raw documents to packed training sequences: five stages, each one operator over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``docs``, whatever these are beside doc_id, text and lang. Null and empty texts leave with the first stage, as
they have no language; an empty table gives an empty result. Rows without an id are decided like others, by their text. Ties between copies are
settled by the least id, then a hash of the text, then one of the other columns. Columns with the names of operators' results pass through. Very long texts
are processed whole by every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, jaccard, language, packing, secrets
from keyloom.llm.textops import Scratch, small

SECRET_MARK = "[SECRET]"


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns in0, in1, ..., which clash with no column of an operator's result, and the new name of each old one."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least_score=0.3) -> DataFrame:
    """Learns from the labelled rows of three folds of four; documents without a language, or hardly likely in any, go."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = language.train(docs, fold != 2)
    rows, names = aside(docs)
    found = language.predict(rows, model, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, *, most_bytes=64 << 20) -> DataFrame:
    """Of each group of documents that 5-word shingle sets with a Jaccard of 0.8 or more link, the one with the least id stays, then that with the least hash of its text.

    A document is an id and its text: different texts under one id, or without one, are decided apart. Of rows with the same id and text, one stays.
    """
    how = {"n": 5, "num": 80, "den": 100, "broadcast_bytes": most_bytes}

    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        groups = jaccard.join(docs, **how)
        # a row stays if its id is its component
        gone = Scratch(spark).save(groups.where("doc_id <> component_id").select("doc_id"), "decided")
        return docs.join(small(gone, most_bytes), "doc_id", "left_anti").select(*docs.columns)

    rows, names = aside(docs)
    rows = rows.withColumn("node", F.xxhash64(names["doc_id"], names["text"]))
    scratch = Scratch(spark)
    groups = jaccard.join(rows, id_col="node", text_col=names["text"], **how).groupBy("node").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    ids = rows.select("node", F.col(names["doc_id"]).alias("id")).distinct()
    groups = scratch.save(groups.join(ids, "node"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "node"))["node"].alias("first"))
    decided = scratch.save(groups.join(first, "component_id").select("node", "rows", (F.col("node") != F.col("first")).alias("gone")).where("gone or rows > 1"), "decided")
    kept = rows.join(small(decided.where("gone").select("node"), most_bytes), "node", "left_anti")
    twice = small(decided.where("not gone").select("node"), most_bytes)
    # which of several rows stays hangs on their columns, not on the order of tasks
    told = F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind))
    one = kept.join(twice, "node", "left_semi").groupBy("node").agg(F.min_by(F.struct(*names.values()), told).alias("row")).select("row.*")
    return back(kept.join(twice, "node", "left_anti").select(*names.values()).unionByName(one), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of 13 words of test items cover a twentieth or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names = aside(docs)
    found = decontaminate.scan(rows, benchmark, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return back(found.where(~F.col("contaminated")), names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. n_chars, where there is such a column, follows the text."""
    rows, names = aside(docs)
    text = names["text"]
    found = secrets.scan(rows, id_col=names["doc_id"], text_col=text, words=secrets.train(rows, text_col=text), keep=tuple(n for n in names.values() if n != text), mark=SECRET_MARK).withColumnRenamed("redacted", text)
    if "n_chars" in names:
        found = found.withColumn(names["n_chars"], F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return back(found, names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; one row per piece."""
    tokenizer_file, rank_file = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    return packing.pack(docs, rank_file, tokenizer_file=tokenizer_file)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("best-fit packing", best_fit_packing)]

#: SQL has no tokenizer and no language model, so the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
