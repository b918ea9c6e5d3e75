"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over printable ASCII, one of random strings and one of
ordinary identifiers, give each candidate token the mean log-likelihood ratio
of its character steps.  Both are trained from labelled samples; a threshold
between the classes is calibrated on the half of the samples not trained on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import spans
from panelwright.llm.common import let, written

KINDS = ("assign", "access", "hex", "random")
# (pattern, what a match must satisfy); the first group of an assignment is its value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_VALUE = 8
# A run is at least so long exactly when its leftmost match is.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
_SAMPLE_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
# The labelled sample is bounded: tokens of about SAMPLE_DOCS distinct texts by hash (never more than twice that), at most SAMPLE_TOKENS of each class.
SAMPLE_DOCS = 2_000
SAMPLE_TOKENS = 20_000
_FIRST, _CODES = 33, 94
# Weight of the prior: the random model leans to equal steps over letters and digits, the other to none.
PRIOR = 0.5


def base_spans(text: Column) -> Column:
    assign = spans.found(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE)
    return spans.together(assign, spans.found(text, 1, ACCESS), spans.found(text, 2, HEX))


def _codes(token: Column) -> Column:
    """Character codes 0 to 93; anything outside printable ASCII is the last."""
    return F.transform(
        F.split(token, ""), lambda c: F.when(F.ascii(c).between(_FIRST, _FIRST + _CODES - 2), F.ascii(c) - _FIRST).otherwise(_CODES - 1)
    )


@dataclass(frozen=True)
class Model:
    ratios: tuple[float, ...]  # of the step from code a to code b, at a * 94 + b
    threshold: float

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio of the steps of a token; higher is more random."""
        table = F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")

        def of(codes: Column) -> Column:
            step = F.transform(
                F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(table, F.get(codes, i) * _CODES + F.get(codes, i + 1))
            )
            return F.aggregate(step, F.lit(0.0), lambda acc, x: acc + x) / (F.size(codes) - 1)

        return F.when(F.length(token) < 2, F.lit(0.0)).otherwise(let(_codes(token), of))


def train(samples: DataFrame) -> Model | None:
    """Fit both models on rows ``(token, random)``; ``None`` if a class is missing.

    Half of the tokens, by hash, count steps; the other half sets the threshold,
    halfway between the highest ordinary and the lowest random scores but for
    the outermost thousandth and hundredth.  What reaches the driver are the
    counts of at most 94 x 94 steps per class.
    """
    samples = samples.where(F.length("token") >= 2).withColumn("half", F.pmod(F.xxhash64("token"), F.lit(2)))
    at = let(
        _codes(F.col("token")),
        lambda codes: F.transform(F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(codes, i) * _CODES + F.get(codes, i + 1)),
    )
    steps = samples.where("half = 0").select("random", F.explode(at).alias("step"))
    counts: dict[bool, list[float]] = {True: [0.0] * _CODES**2, False: [0.0] * _CODES**2}
    for random, step, n in steps.groupBy("random", "step").count().collect():
        counts[random][step] = float(n)
    if not any(counts[True]) or not any(counts[False]):
        return None
    usual = [chr(c + _FIRST).isalnum() for c in range(_CODES)]
    ratios = []
    for a in range(_CODES):
        rows = {kind: counts[kind][a * _CODES : (a + 1) * _CODES] for kind in counts}
        totals = {kind: sum(row) for kind, row in rows.items()}
        for b in range(_CODES):
            random = (rows[True][b] + PRIOR * (4.0 if usual[b] else 0.25)) / (totals[True] + PRIOR * (4.0 * sum(usual) + 0.25 * (_CODES - sum(usual))))
            ordinary = (rows[False][b] + PRIOR) / (totals[False] + PRIOR * _CODES)
            ratios.append(math.log(random / ordinary))
    untuned = Model(tuple(ratios), 0.0)
    held = samples.where("half = 1").select("random", untuned.score(F.col("token")).alias("score"))
    high, low = held.agg(
        F.percentile(F.when(~F.col("random"), F.col("score")), 0.999), F.percentile(F.when(F.col("random"), F.col("score")), 0.01)
    ).first()
    if high is None or low is None:
        return Model(tuple(ratios), 0.5)
    return Model(tuple(ratios), max(high, (high + low) / 2))


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """A bounded labelled sample from the documents themselves.

    Random: values of base spans, and digests of sampled texts in base64 and
    hex.  Ordinary: long tokens of the sampled texts outside of base spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one_in = max(1, docs.count() // SAMPLE_DOCS)
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.pmod("h", F.lit(one_in)) == 0)
    # Copies share a hash: a group of any size is one sampled text.  Only hashes are sorted.
    drawn = written(hashed.select("h").distinct().orderBy("h").limit(2 * SAMPLE_DOCS), "secret-drawn")
    picked = hashed.join(drawn, "h").groupBy("h").agg(F.min("text").alias("text")).select("text")
    picked = written(picked, "secret-sample")
    digests = picked.select(
        F.explode(F.array(F.base64(F.unhex(F.sha2("text", 256))), F.sha2("text", 256), F.substring(F.base64(F.unhex(F.sha1("text"))), 1, 24))).alias("token")
    )
    hidden = picked.select(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    ordinary = hidden.select(F.explode(F.regexp_extract_all("text", F.lit(_SAMPLE_TOKEN), F.lit(0))).alias("token"))
    # A token with many digits may be a secret of an unknown kind: it does not stand for ordinary ones.
    ordinary = ordinary.where(F.length(F.regexp_replace("token", "[^0-9]", "")) * 4 < F.length("token"))

    def few(tokens: DataFrame) -> DataFrame:
        return tokens.distinct().orderBy(F.xxhash64("token"), "token").limit(SAMPLE_TOKENS)

    values = picked.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).alias("token")).where(F.length("token") >= 16)
    random = few(digests.unionByName(values)).withColumn("random", F.lit(True))
    return written(random.unionByName(few(ordinary).withColumn("random", F.lit(False))), "secret-tokens")


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``base`` and ``all`` spans of each row; without a model only base spans.

    A token that the model finds random is added unless it overlaps a base
    span.  Null and empty texts have no spans; repeated rows keep a row each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    if model is None:
        return out.select("doc_id", "base", F.col("base").alias("all"))
    added = spans.found(F.col("text"), 3, TOKEN, lambda m: model.score(m) > model.threshold)
    both = let(F.struct(F.col("base").alias("base"), added.alias("added")), lambda x: spans.together(x["base"], F.filter(x["added"], lambda t: ~spans.overlaps(t, x["base"]))))
    return out.select("doc_id", "base", both.alias("all"))


def result(docs: DataFrame) -> DataFrame:
    """Contract columns: counts and digest of the base spans, and all spans."""
    scanned = scan(docs, train(labelled_tokens(docs)))
    counts = [spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return scanned.select(
        "doc_id", *counts, F.sha2(spans.written_out(F.col("base"), KINDS), 256).alias("base_sha256"), spans.written_out(F.col("all"), KINDS).alias("spans")
    )
