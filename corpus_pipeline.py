"""A training corpus from `documents`: five stages, each an operator over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontam, jaccard, lines, packing, toxicity
from rillstone.llm.queries import tokenizer_path
from rillstone.llm.shared import id_key, table, unused, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "_score")
    return toxicity.scored(docs, model, name=score).filter(F.col(score) < 0.5).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document all of whose lines go stays, empty.  A column n_chars is counted again."""
    counts = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    other = {c: unused(docs.columns, f"_{c}") for c in counts}
    short = lines.deduplicated(docs.withColumnsRenamed(other)).drop(*counts).withColumnsRenamed({v: k for k, v in other.items()})
    return short.withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, one with the least id; those without words are linked with nothing, and stay.

    Of the texts of one id that are linked, and of rows with equal id and text, one row stays: that of the least
    text hash, and of its rows the least by their other columns.
    """
    found = written(jaccard.linked(docs).filter("n_shingles > 0").select(id_key().alias("id"), "component_id", "component", "text_hash"), "groups")
    own = F.col("id") == id_key("component_id")
    # the rows of the least id, of which few groups have several
    least = found.filter(own).groupBy("id", "component").agg(F.min("text_hash").alias("stays"), F.max("text_hash").alias("last"), F.count("*").alias("rows")).filter("rows > 1")
    least = written(least, "least")
    hashes = found.filter(own).join(least.filter("stays <> last").select("id", "component", "stays"), ["id", "component"]).filter("text_hash <> stays")
    gone = found.filter(~own).select("id", "text_hash").union(hashes.select("id", "text_hash")).distinct()
    id_name, hash_name, row = (unused(docs.columns, c) for c in ("_id", "_hash", "_row"))
    keys = [id_name, hash_name]
    rows = docs.withColumns({id_name: id_key(), hash_name: F.xxhash64("text")})
    kept = rows.join(gone.toDF(*keys), keys, "left_anti")
    # equal rows are combined before they are shuffled
    twice = least.select("id", "stays").distinct().toDF(*keys)
    once = kept.join(twice, keys, "left_semi").select(*keys, F.struct(*docs.columns).alias(row)).groupBy(*keys).agg(F.min(row).alias(row)).select(f"{row}.*")
    return kept.join(twice, keys, "left_anti").select(*docs.columns).unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; so do all texts of an id one of which does."""
    key = unused(docs.columns, "_id")
    gone = decontam.contained(docs, table(spark, sf_dir, "benchmark")).select(id_key().alias(key)).distinct()
    return docs.withColumn(key, id_key()).join(gone, key, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", clean),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), tidy=True)
    return STAGES[-1][1](spark, docs, sf_dir)
