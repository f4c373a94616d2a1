"""Small side tables: definitions, hints, rules, history, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.sources.paths import exists


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """``[{refactoring_type, definition}]`` as ``(type, definition)``; the last duplicate wins."""
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<struct<refactoring_type:string,definition:string>>").alias("d"))
    rows = raw.select(F.posexplode("d").alias("pos", "d")).select("pos", "d.*")
    return rows.groupBy(F.col("refactoring_type").alias("type")).agg(F.max_by("definition", "pos").alias("definition"))


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("t"))
    return raw.select(F.explode("t").alias("type"))


def read_text_book(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object as ``(key, text)``: hint sentences, glossary terms, compound notes."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("key", "text"))


def read_hint_edges(spark: SparkSession, path: str) -> DataFrame:
    """``{label: [partner, ...]}`` as ``(src, ord, dst)``: any mined hint table."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    edges = raw.select(F.explode("m").alias("src", "dsts")).select("src", F.posexplode("dsts").alias("p", "dst"))
    return edges.select("src", (F.col("p") + 1).alias("ord"), "dst")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``{"A" or "A|B": [{consequent, score}]}`` as rule rows; a missing file means no rules."""
    if not exists(spark, path):
        return spark.createDataFrame([], "antecedent string, consequent string, score double")
    raw = spark.read.text(path, wholetext=True).select(F.from_json(
        "value", "map<string,array<struct<consequent:string,score:double>>>").alias("m"))
    return raw.select(F.explode("m").alias("antecedent", "rs")).select("antecedent", F.inline("rs"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """``{per_type: {label: {support, precision}}}``; a missing file means no history."""
    if not exists(spark, path):
        return spark.createDataFrame([], "type string, support bigint, precision double")
    raw = spark.read.text(path, wholetext=True).select(F.from_json(
        "value", "per_type map<string,struct<support:bigint,precision:double>>").alias("h"))
    return raw.select(F.explode("h.per_type").alias("type", "s")).select("type", "s.*")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Candidate score weights and priors, one row. A missing file is an error."""
    return spark.read.text(path, wholetext=True).select(F.from_json(
        "value", "alpha double, beta double, gamma double, cap_per_level map<string,int>, "
        "type_priors_per_level map<string,map<string,double>>, type_priors_global map<string,double>").alias("w")).select("w.*")
