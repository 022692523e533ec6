"""Training-data pipeline over documents: five stages, each written and read again.

Every stage works on all rows its predecessor kept. Rows whose doc_id is null pass the
near-duplicate stage (they link with nothing); null and empty texts pass every stage, and
end without ids. Repeated rows of one doc_id count as copies: one stays.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvecal.llm import decontaminate, jaccard_join, piece_bpe, quality, secrets
from curvecal.llm.common import table
from curvecal.llm.queries import piece_model
from curvecal.session import materialize, ship_package


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship_package(spark)
    return quality.classify(docs, quality.fit(docs)).where("keep").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five words, Jaccard 0.8)."""
    ship_package(spark)
    groups = jaccard_join.link_components(docs, n=5, num=80, den=100)
    kept = groups.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), out="_hits")
    return hits.where(F.size("_hits") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    ship_package(spark)
    found = secrets.redact(secrets.find_secrets(docs, out="_spans"), spans="_spans")
    length = F.when(F.size("_spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their texts."""
    ship_package(spark)
    return piece_bpe.encode(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality", good_documents), ("near duplicates", one_of_each_group), ("decontamination", without_benchmarks),
          ("secrets", without_secrets), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


#: EM, near-duplicate components and piece coding have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None
