"""Scores of predicted boundaries and of rules on examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundaries(phrases: DataFrame) -> DataFrame:
    """(doc_id, boundary_offset): characters before each phrase, counted over tokens; offset 0 is no boundary."""
    by = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    laid = phrases.withColumn("boundary_offset", F.coalesce(F.sum(F.char_length("surface")).over(by), F.lit(0)).cast("int"))
    return laid.filter((F.col("position") == F.col("bunsetsu_start")) & (F.col("boundary_offset") > 0)).select("doc_id", "boundary_offset")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def marked(laid: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """(doc_id, boundary_offset, predicted, gold): offsets that one of the two conditions on their row makes a boundary.

    laid has a row for each (doc_id, boundary_offset), so that the two sides meet without a join.
    """
    told = laid.select("doc_id", "boundary_offset", F.coalesce(predicted, F.lit(False)).alias("predicted"), F.coalesce(gold, F.lit(False)).alias("gold"))
    return told.filter("predicted or gold")


def met(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """The same of two tables with doc_id and boundary_offset."""
    p, g = predicted.select("doc_id", "boundary_offset").distinct(), gold.select("doc_id", "boundary_offset").distinct()
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["doc_id", "boundary_offset"], "full")
    return both.select("doc_id", "boundary_offset", F.col("p").isNotNull().alias("predicted"), F.col("g").isNotNull().alias("gold"))


def counts(items: DataFrame, boundaries: DataFrame) -> DataFrame:
    """items with hits, n_predicted and n_gold; items has doc_id, boundaries is of marked() or met()."""
    totals = boundaries.groupBy("doc_id").agg(F.count_if("predicted").alias("n_predicted"), F.count_if("gold").alias("n_gold"), F.count_if(F.col("predicted") & F.col("gold")).alias("hits"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("hits", "n_predicted", "n_gold")}
    return items.join(totals, "doc_id", "left").withColumns(zero)


def scored(items: DataFrame, boundaries: DataFrame) -> DataFrame:
    """counts() with F1: 1 where there is nothing to find and nothing is found."""
    found = counts(items, boundaries)
    precision = F.col("hits") / F.greatest("n_predicted", F.lit(1))
    recall = F.col("hits") / F.greatest("n_gold", F.lit(1))
    return found.withColumn("f1", F.when((F.col("n_predicted") == 0) & (F.col("n_gold") == 0), F.lit(1.0)).otherwise(f1(precision, recall)))


def per_sentence(items: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """scored() of two tables of boundaries."""
    return scored(items, met(predicted, gold))


def per_file(scored: DataFrame, file: str = "file") -> DataFrame:
    """Sums over the sentences of each file, and their precision, recall and F1."""
    total = scored.groupBy(file).agg(F.count("*").alias("sentences"), F.sum("hits").alias("hits"), F.sum("n_predicted").alias("n_predicted"), F.sum("n_gold").alias("n_gold"))
    precision, recall = F.col("hits") / F.greatest("n_predicted", F.lit(1)), F.col("hits") / F.greatest("n_gold", F.lit(1))
    return total.withColumns({"precision": precision, "recall": recall, "f1": f1(precision, recall)})


def worst(scored: DataFrame, n: int, tie: str = "doc_id") -> DataFrame:
    """The n sentences with the lowest F1, ties in input order."""
    return scored.orderBy("f1", tie).limit(n)


def differences(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, boundary_offset, side): boundaries that only one of the two has."""
    missed = gold.select("doc_id", "boundary_offset").exceptAll(predicted.select("doc_id", "boundary_offset")).withColumn("side", F.lit("missed"))
    return missed.unionByName(predicted.select("doc_id", "boundary_offset").exceptAll(gold.select("doc_id", "boundary_offset")).withColumn("side", F.lit("spurious")))


def one_sided(boundaries: DataFrame) -> DataFrame:
    """differences() of what marked() or met() gives."""
    return boundaries.filter("predicted <> gold").select("doc_id", "boundary_offset", F.when(F.col("gold"), "missed").otherwise("spurious").alias("side"))


def recall_and_coverage(examples: DataFrame, matched: DataFrame, rules: int) -> DataFrame:
    """Share of examples (example_id, rule_id) that their own rule matches, and share of rules with such an example."""
    hit = examples.join(matched.select("example_id", "rule_id").distinct().withColumn("hit", F.lit(1)), ["example_id", "rule_id"], "left")
    return hit.agg(F.count("*").alias("examples"), F.count("hit").alias("recalled"), F.countDistinct(F.when(F.col("hit").isNotNull(), F.col("rule_id"))).alias("rules_recalled")).select(
        "examples", "recalled", "rules_recalled", (F.col("recalled") / F.greatest("examples", F.lit(1))).alias("recall"), (F.col("rules_recalled") / F.lit(float(max(rules, 1)))).alias("coverage")
    )


def distinct_texts(examples: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, text): each text once, so that it is tokenised once."""
    return examples.select(F.col(text).alias("text")).distinct().select(F.xxhash64("text").alias("text_id"), "text")


def owner_guard(examples: DataFrame, rules: DataFrame) -> DataFrame:
    """Examples whose rule is not in the catalog: none in a sound manifest."""
    return examples.join(rules.select("rule_id").distinct(), "rule_id", "left_anti")
