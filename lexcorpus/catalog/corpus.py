"""The test tables in the shape of the corpus.

The test documents have no Turkish headings, no control characters and no
outcome phrases. ``RENDER`` puts them in, by plain replacements of line starts
and frequent words, so that the production rules run over every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.readers import spread_small

# (text in the table, text in the corpus), applied in this order.
RENDER = (
    (".\nTha", ".\nSONUÇ:\nTha"),
    (".\nThe", ".\n**H Ü K Ü M** :\nThe"),
    (".\nAnd", ".\nGEREĞİ DÜŞÜNÜLDÜ:\nAnd"),
    (".\nOf ", ".\n\n\n\nKARAR :\xa0Of "),
    (".\nIn ", ".\r\n\r\n\tIn "),
    (".\nTo ", ".\nsonuc:\nTo "),
    (".\nCi", ".\rK A R A R\nCi"),
    (" was ", " bozulmasına "),
    (" are ", " karar verildi "),
    (" les ", " reddine  "),
    (" und ", " adli para cezası "),
    (" at ", " beraat "),
    (" from ", " sanığın "),
    (" this ", " cezalandırılmasına "),
    (" el ", "\xa0onanmasına "),
    (" zu ", " hapis "),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(text: str) -> str:
    escapes = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\\": "\\\\"}
    return "'" + "".join(escapes.get(ch, ch) for ch in text) + "'"


def rendered(column: str) -> Column:
    """One SQL expression; each replacement runs only on texts that hold its left side."""
    sql = column
    for old, new in RENDER:
        swap = f"if(contains(t, {_literal(old)}), replace(t, {_literal(old)}, {_literal(new)}), t)"
        sql = f"transform(array({sql}), t -> {swap})[0]"
    return F.expr(sql)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, text, source)``."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return spread_small(rows, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), rendered("text").alias("text"), "source"
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, cluster_id)``: the labelled documents, with gaps between the labels."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        (F.col("quality") * 5 + F.col("toxic") * 2).cast("int").alias("cluster_id"),
    )


def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, cluster_id, name)``: one cluster per source and language."""
    docs = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 9).cast("int")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        (number * 4 + lang_number(F.col("lang"))).alias("cluster_id"),
        F.when(number % 5 == 0, F.concat(F.lit("x Temyiz "), F.col("source")))
        .otherwise(F.concat(F.lit("Grup "), F.col("lang"), (number % 3).cast("string")))
        .alias("name"),
    )


def lang_number(lang: Column) -> Column:
    return (
        F.when(lang == "de", F.lit(0)).when(lang == "en", F.lit(1)).when(lang == "es", F.lit(2)).otherwise(F.lit(3))
    )
