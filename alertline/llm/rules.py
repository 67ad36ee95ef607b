"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on statistics of labelled texts, every path from a root becomes a rule (a
conjunction of comparisons), a logistic regression with an L1 penalty keeps few of them with a weight
each, and the result is compiled into one column expression. Scoring is thus a projection: it moves
nothing and runs no Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertline.llm.text import SPACES, words
from alertline.session import stored

MAX_TRAINING_ROWS = 20_000
TREES = 24
DEPTH = 3
PENALTY = 0.002
MAX_STEPS = 200
SEED = 7
FIT_PARTITIONS = 3  # of the bounded training table
FOLDS = 3
HELD_OUT_FOLD = 1
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", "\"", "'", "”", "’", "»", ")", "]")


def fold() -> Column:
    """The fold of a document: crc32 of its id as text, modulo FOLDS. No id: null."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int")


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the statistics of ``text`` that rules compare, and their names. Null and empty texts have zeros."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_words", words(text)).withColumn("_text", text)
    n = F.greatest(F.size("_words"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    def count_sign(sign: str) -> Column:  # much quicker than a pattern
        return F.char_length("_text") - F.char_length(F.replace("_text", F.lit(sign), F.lit("")))

    docs = docs.withColumn("_chars", F.char_length(F.array_join("_words", "")))
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^" + SPACES[1:])))
    lines = F.greatest(F.size("_lines"), F.lit(1))
    ended = F.size(F.filter("_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(*SENTENCE_ENDS)))
    same = F.filter("_words", lambda w, i: (i > 0) & (w == F.get(F.col("_words"), i - 1)))
    statistics = {
        "words": F.log1p(F.size("_words").cast("double")),
        "word_length": F.col("_chars") / n,
        "symbols": count(r"[#*$%&<>@^~=+_\\/{}\[\]]") / n,
        "separators": (count_sign("|") + count_sign("•")) / n,
        "exclamations": count_sign("!") / n,
        "commas": count_sign(",") / n,
        "capitals": count(r"\p{Lu}") / F.greatest("_chars", F.lit(1)),
        "digits": count(r"[0-9]") / n,
        "distinct_words": F.size(F.array_distinct("_words")) / n,
        "repeated_words": F.size(same) / n,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "ended_lines": ended / lines,
    }
    names = [f"stat_{k}" for k in statistics]
    docs = docs.withColumns({f"stat_{k}": v.cast("double") for k, v in statistics.items()})
    return docs.drop("_words", "_text", "_chars", "_lines"), names


@dataclass(frozen=True)
class Rule:
    """Comparisons that must all hold: (statistic, is above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        holds = F.lit(True)
        for name, above, threshold in self.terms:
            holds = holds & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return holds


@dataclass
class RuleModel:
    """Weighted rules and an intercept."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1, from statistics columns."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Statistics and label of labelled documents outside the held-out fold.

    ``labels`` has doc_id and ``quality`` (0 or 1); rows with a null in either are left out, and of rows that
    repeat a doc_id the largest label counts. If there are more than ``max_rows``, those whose hashed id lies
    below a threshold are used, about ``max_rows``. So many ids at most are sent to all tasks, and only
    these texts are read for training.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold() != HELD_OUT_FOLD)
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    usable = stored(usable, "labels")
    share = min(1.0, max_rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows, names = with_statistics(texts)
    return rows.select("doc_id", "label", *names)


def fit_rules(rows: DataFrame, names: list[str], penalty: float = PENALTY) -> RuleModel:
    """Fit rules to a bounded table of statistics and ``label``.

    Without rows of both labels there are no rules, and the intercept alone gives the (smoothed) share of
    label 1.
    """
    rows = stored(rows.repartitionByRange(FIT_PARTITIONS, "doc_id").sortWithinPartitions("doc_id"), "training")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = ((ones or 0) + 1) / (n + 2)
    prior = math.log(share / (1 - share))
    if not n or ones in (0, n):
        return RuleModel(prior)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED
    ).fit(vectors.select("features", "label"))
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)}, key=lambda r: r.terms)
    if not rules:
        return RuleModel(prior)
    hits = rows.select("label", *(r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    hits = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(hits)
    hits = stored(hits.select("label", "features"), "rules")
    fitted = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=MAX_STEPS, tol=1e-6
    ).fit(hits)
    weighed = [Rule(r.terms, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if abs(w) > 1e-9]
    return RuleModel(float(fitted.intercept), weighed)


_BRANCH = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (-?[0-9.E+-]+|-?Infinity)\)")


def tree_rules(printed: str, names: list[str]) -> list[Rule]:
    """Every path prefix of a printed tree as a rule; comparisons that another one implies are left out."""
    path: list[tuple[int, tuple[str, bool, float]]] = []
    out = []
    for line in printed.split("\n"):
        m = _BRANCH.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (names[int(m[3])], m[4] == ">", float(m[5]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, above, threshold) in path:
            best = tightest.get((name, above), threshold)
            tightest[name, above] = max(best, threshold) if above else min(best, threshold)
        out.append(Rule(tuple(sorted((n, a, t) for (n, a), t in tightest.items()))))
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> RuleModel:
    """A model of ``quality`` from all labelled documents outside the held-out fold (see training_rows)."""
    rows = training_rows(docs, labels, max_rows)
    return fit_rules(rows, [c for c in rows.columns if c.startswith("stat_")])


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= 0.5).

    Reads ``text`` alone. Null and empty texts are scored by statistics of zero. Every row is scored for
    itself, repeated ones too; columns of the names added are replaced.
    """
    scored, names = with_statistics(docs.drop("score", "predicted"))
    scored = scored.withColumn("score", model.score()).drop(*names)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
