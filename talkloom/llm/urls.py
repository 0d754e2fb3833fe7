"""URL filters with DataFrame functions only: host and path rules, then a learnt classifier.

The classifier is a logistic regression on hashed character n-grams of host and path,
fitted on a small table of labelled urls. N-grams carry the part that they come from.
A url's weights are added up from a table of at most ``2 ** bits`` weights, so the model
that is sent to the tasks has a fixed bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.native import text_of
from talkloom.sources.scratch import written

GRAMS = (3, 4)
BITS = 14
#: Labelled urls that a fit uses at most: those with the lowest hashes.
MOST_LABELLED = 2000
ROUNDS = 20
#: Weight of the squared norm of the weights in the loss, the bias left out.
RIDGE = 1e-5
CUT = 0.5


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #``; empty without ``://``."""
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; equal lengths go by name."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def hashed_grams(host: Column, path: Column, bits: int = BITS) -> Column:
    """The distinct n-gram numbers below ``2 ** bits``; ``^`` and ``$`` mark the ends of a part, all digits are alike."""

    def of(part: Column, tag: str, n: int) -> Column:
        def grams(letters: Column) -> Column:
            starts = F.slice(letters, F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(0)))
            rest = range(1, n)
            return F.transform(
                starts,
                lambda c, i: F.pmod(F.xxhash64(F.lit(tag), c, *[F.get(letters, i + k) for k in rest]), F.lit(1 << bits)).cast("int"),
            )

        # The letters are bound once; as an expression they would be split again for every n-gram.
        once = F.array(F.split(F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$")), ""))
        return F.flatten(F.transform(once, grams))

    return F.array_distinct(F.concat(*[of(part, tag, n) for part, tag in ((host, "host"), (path, "path")) for n in GRAMS]))


@dataclass(frozen=True)
class UrlModel:
    """A weight for each n-gram number, and the bias: at most ``2 ** BITS`` numbers."""

    weights: tuple[float, ...]
    bias: float

    def score(self, grams: Column) -> Column:
        """The chance that the url is to be blocked. The weights are one constant of the plan."""
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        added = F.aggregate(grams, F.lit(0.0), lambda total, g: total + F.get(table, g))
        margin = F.lit(self.bias) + added / F.sqrt(F.greatest(F.size(grams), F.lit(1)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def labelled_table(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    """(url, label) from a list in the program; label 1 is to be blocked."""
    entries = [F.struct(F.lit(url).alias("url"), F.lit(label).cast("long").alias("label")) for url, label in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def fit(labelled: DataFrame, bits: int = BITS, rounds: int = ROUNDS, most: int = MOST_LABELLED) -> UrlModel:
    """Fit (url, label) by accelerated gradient steps over all rows, at most ``most`` of them by lowest hash.

    Rows are weighted so that both labels count alike; with one label only, all weigh 1.
    A weight's step is the inverse of a bound on how much the loss bends along it when all
    weights move at once: a url's feature values times their sum, a quarter of it averaged over the
    urls that have the n-gram. So steps cannot overshoot, and rare n-grams learn as fast as frequent ones.
    A round is one job: margins and errors per url, then sums per n-gram. Errors are
    whole millionths, so that sums are exact and the model is the same under any
    partitioning. Rows without label are left out; without rows the model says 0.5.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = written(
        labelled.where("label is not null")
        .orderBy(F.xxhash64("url"), "url", "label")
        .limit(most)
        .select(hashed_grams(host, path, bits).alias("grams"), F.col("label").cast("double").alias("label")),
        "url-labelled",
    )
    size, blocked = rows.agg(F.count("*"), F.sum("label")).first()
    blocked = blocked or 0.0
    even = 0 < blocked < size
    weight = F.when(F.col("label") == 1, size / (2 * blocked)).otherwise(size / (2 * (size - blocked))) if even else F.lit(1.0)
    # The bias is kept behind the weights. A url of n n-grams has features 1 / sqrt(n) and a bias feature
    # of 1, which add up to sqrt(n) + 1: times a feature, 1 + 1 / sqrt(n) for an n-gram, sqrt(n) + 1 for the bias.
    root = F.sqrt(F.greatest(F.size("grams"), F.lit(1)))

    def sums(of_bias: Column, of_gram: Column) -> list:
        """(n-gram, whole sum) over all rows, in millionths."""
        whole = [F.round(1e6 * weight * v).cast("long") for v in (of_bias, of_gram)]
        each = F.transform("grams", lambda g: F.struct(g.alias("gram"), whole[1].alias("v")))
        values = F.concat(F.array(F.struct(F.lit(1 << bits).alias("gram"), whole[0].alias("v"))), each)
        return rows.select(F.explode(values).alias("x")).groupBy("x.gram").agg(F.sum("x.v").alias("v")).collect()

    bends = [RIDGE] * ((1 << bits) + 1)
    for gram, bend in sums(root + 1, 1 + 1 / root):
        bends[gram] += bend / 4e6 / size
    here = last = [0.0] * ((1 << bits) + 1)
    pace = 1.0
    for _ in range(rounds if size else 0):
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = [x + (pace - 1) / faster * (x - y) for x, y in zip(here, last)]
        pace = faster
        error = F.col("label") - UrlModel(tuple(ahead[:-1]), ahead[-1]).score(F.col("grams"))
        last, here = here, list(ahead)
        for gram, step in sums(error, error / root):
            shrunk = 0.0 if gram == 1 << bits else RIDGE * ahead[gram]
            here[gram] += (step / 1e6 / size - shrunk) / bends[gram]
    return UrlModel(tuple(here[:-1]), here[-1])


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one, ``score`` of at least ``CUT``
    blocks. Null urls and urls without ``://`` have an empty host and path and are
    judged by the classifier, like all that no rule fits. Repeated rows give a row each;
    other columns are not read; an empty table gives no rows. Rules are given in the
    program and become part of the plan.
    """
    model = fit(labelled)
    named = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = named.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("score", model.score(hashed_grams(F.col("host"), F.col("path"))))
    learnt = F.when(F.col("score") >= CUT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learnt).alias("verdict"), "score"
    )
