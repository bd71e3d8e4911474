"""A sparse rule ensemble for text quality.

Statistics of a text are Spark column expressions.  From a random forest on a sample of labelled
documents every tree path becomes a conjunctive rule over the statistics; a lasso logistic
regression gives most rules weight zero; the others compile into one Spark column expression, which
scores every whole text on the JVM.

Learning reads at most ``train_rows`` labelled documents, those of smallest id hash: that bounds the
model's cost, and their ids are all that is broadcast; of rows that repeat an id one is learnt from.  Labels are the only other input; id,
language and source never enter a score.

Defined results: null and empty texts have all statistics zero and are scored like any other; null
ids are scored, never learnt from; of labels that repeat an id the largest counts; without two
classes to learn from every text scores the class's share (0.5 without any).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

TRAIN_ROWS = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Counts and rates of a text; all 0 for an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = count(r"\S+")
    per = lambda n, of: F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0)).cast("double")
    return {
        "chars": F.log1p(chars.cast("double")),
        "word_length": per(chars - words, words),
        "words_per_line": per(words, count(r"\n") + 1),
        "upper": per(count(r"\p{Lu}"), chars),
        "digits": per(count(r"[0-9]"), chars),
        "marks": per(count(r"[!-/:-@\[-`{-~]"), chars),
        "mark_runs": per(count(r"[!-/:-@\[-`{-~]{2,}"), words),
        "lone_marks": per(count(r"(?<=\s)[!-/:-@\[-`{-~](?=\s)"), words),
        "doubled": per(count(r"(?<=^|\s)(\S{1,40}) (?=\1(?:\s|$))"), words),
        "sentence_ends": per(count(r"[.!?](?=\s|$)"), words),
    }


class Rule(NamedTuple):
    """For some statistics a half-open range (above, up to]."""

    bounds: tuple[tuple[str, float, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, above, upto in self.bounds:
            if above > -math.inf:
                out = out & (F.col(name) > F.lit(above))
            if upto < math.inf:
                out = out & (F.col(name) <= F.lit(upto))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{a:.4g} < {n} <= {b:.4g}" for n, a, b in self.bounds)


class RuleEnsemble(NamedTuple):
    intercept: float
    weighted: list[tuple[float, Rule]]

    def score(self) -> Column:
        """The probability of label 1, over the columns of ``statistics``."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.weighted:
            total = total + F.when(rule.condition(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(forest, names: list[str]) -> list[Rule]:
    """Every path from a root to a node below it, as a rule; each once."""
    found: dict[Rule, None] = {}

    def walk(node, ranges: dict[str, tuple[float, float]]) -> None:
        if ranges:
            found[Rule(tuple((n, *ranges[n]) for n in sorted(ranges)))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        above, upto = ranges.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), ranges | {name: (above, min(upto, at))})
        walk(node.rightChild(), ranges | {name: (max(above, at), upto)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, train_rows: int) -> DataFrame:
    """(id, label) of the ``train_rows`` labelled ids with the smallest hashes."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    return known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(train_rows)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, trees: int = 8, depth: int = 4, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    named = statistics(F.col("_text"))
    names = list(named)
    sample = labelled_sample(labels, id_col, label_col, train_rows)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # at most train_rows ids
    # the scan keeps its tasks; one row of numbers an id moves (of texts that repeat an id the least), dealt alike in every run
    numbers = own.select("_id", "_label", F.struct(*(c.alias(n) for n, c in named.items())).alias("_s")).groupBy("_id", "_label").agg(F.min("_s").alias("_s"))
    rows = checkpoint(numbers.select("_id", "_s.*", "_label").repartition(4, "_id").sortWithinPartitions("_id"))
    share = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("ones")).first()
    if not share.n or share.ones in (0, share.n):
        odds = ((share.ones or 0) + 0.5) / (share.n + 1) if share.n else 0.5
        return RuleEnsemble(math.log(odds / (1 - odds)), [])
    vectors = rows.select(array_to_vector(F.array(*names)).alias("features"), "_label").cache()
    forest = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.7", minInstancesPerNode=5).fit(vectors)
    vectors.unpersist()
    rules = tree_rules(forest, names)
    held = rows.select(array_to_vector(F.array(*(r.condition().cast("double") for r in rules))).alias("features"), "_label").cache()
    lasso = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    held.unpersist()
    return RuleEnsemble(lasso.intercept, [(w, r) for w, r in zip(lasso.coefficients.toArray().tolist(), rules, strict=True) if abs(w) > 1e-6])


def score(docs: DataFrame, model: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    read = docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in statistics(F.col(text_col)).items()))
    return read.select(F.col("_id").alias(id_col), model.score().alias("score"))
