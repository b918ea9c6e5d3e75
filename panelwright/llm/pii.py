"""Personal data: candidate spans scored by gradient-boosted trees.

Generators with high recall propose spans, which may overlap: addresses with
spelled-out signs, numbers of either IP version, digit runs and groups,
telephone forms without a country code.  Boosted trees score each candidate by its format
and its context; per kind, a threshold calibrated for precision on held-out
labels selects, and of overlapping candidates the best is taken first, again and again.  Spans of the
base patterns always stay.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import spans
from panelwright.llm.common import doc_key, let, matches, written

KINDS = ("email", "ip", "card", "phone")
# Matches start where a run of their characters starts, or where the last match ended.
_START = r"(?:(?<![{0}])|\G)"
EMAIL = _START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _START.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

GENERATORS = (
    _START.format(r"\p{L}\p{N}._%+-") + r"[\p{L}\p{N}._%+-]++(?:\x20?[(\[](?:at|AT)[)\]]\x20?|@)[\p{L}\p{N}-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[\p{L}\p{N}-]++)++",
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|[0-9]{1,6}(?:\.[0-9]{1,6}){3})(?![0-9A-Za-z:])",
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])",
    r"(?<![0-9+(])(?:\(?[0-9]{3,4}\)?[\x20./-]?[0-9]{3}[\x20.-][0-9]{3,4}|00[1-9][0-9\x20()./-]{7,16}[0-9])(?![0-9])",
)
_CONTEXT = 24
# Words near a candidate that speak for its kind.
CUES = (
    r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
    r"(?i)\b(?:ip|host|server|address|addr|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
    r"(?i)\b(?:phone|tel|telefon|mobile|cell|fax|call|sms)\b",
)
PRECISION = 0.98
TREES, DEPTH = 10, 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _parts_fit(m: Column) -> Column:
    """Are the dotted parts at most 255?"""
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: F.when(F.length(p) <= 3, p.try_cast("int") <= 255).otherwise(False))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def base_spans(text: Column) -> Column:
    return spans.together(
        spans.found(text, 0, EMAIL), spans.found(text, 1, IP, _parts_fit), spans.found(text, 2, CARD, _card), spans.found(text, 3, PHONE, _phone)
    )


def candidates(text: Column) -> Column:
    """Proposed spans with their text and context, as array<struct<s, k, e, m, before, after>>."""

    def proposed(k: int, pattern: str) -> Column:
        return F.transform(
            matches(text, pattern),
            lambda m: F.struct(
                m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["m"].alias("m"),
                F.substring(text, F.greatest(m["s"] - _CONTEXT, F.lit(0)).cast("int") + 1, F.least(m["s"], F.lit(_CONTEXT)).cast("int")).alias("before"),
                F.substring(text, m["e"].cast("int") + 1, F.lit(_CONTEXT)).alias("after"),
            ),
        )

    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint,m:string,before:string,after:string>>")
    # No generator matches a text without a digit or an at sign.
    return F.when(text.rlike(r"[0-9@]|[(\[](?:at|AT)[)\]]"), F.concat(*[proposed(k, p) for k, p in enumerate(GENERATORS)])).otherwise(none)


def features() -> dict[str, Column]:
    """Format and context of a candidate row ``(k, m, before, after)`` as numbers."""
    m, k = F.col("m"), F.col("k")
    digits = _digits(m)
    near = F.concat_ws(" ", "before", "after")

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    out = {f"is_{name}": flag(k == i) for i, name in enumerate(KINDS)}
    out |= {
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": F.length(F.regexp_replace(m, r"[^\p{L}]", "")).cast("double"),
        "dots": F.length(F.regexp_replace(m, r"[^.]", "")).cast("double"),
        "groups": F.size(F.split(m, r"[^0-9]+")).cast("double"),
        "at_sign": flag(m.contains("@")),
        "opens_with_sign": flag(m.rlike(r"^[+(]")),
        "luhn": flag(F.when(F.length(digits).between(8, 24), _luhn(digits))),
        "octets": flag(F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), _parts_fit(m))),
        "long_last_label": flag(m.rlike(r"[.\])]\x20?[A-Za-z]{2,12}$")),
        "digit_before": flag(F.col("before").rlike(r"[0-9][\x20-]?$")),
        "digit_after": flag(F.col("after").rlike(r"^[\x20-]?[0-9]")),
        "letter_beside": flag(F.col("before").rlike(r"\p{L}$") | F.col("after").rlike(r"^\p{L}")),
    }
    return out | {f"cue_{name}": flag(near.rlike(cue) & (k == i)) for i, (name, cue) in enumerate(zip(KINDS, CUES, strict=True))}


def weak_label() -> Column:
    """What the checkable part of a format says: the label of a candidate."""
    m, k = F.col("m"), F.col("k")
    email = m.rlike(r"[.\])]\x20?[A-Za-z]{2,12}$")
    ip = F.when(m.contains(":"), F.size(F.split(m, ":")) == 8).otherwise(_parts_fit(m))
    phone = F.length(_digits(m)).between(10, 15) & (m.startswith("(") | m.startswith("00") | F.concat_ws(" ", "before", "after").rlike(CUES[3]))
    return F.coalesce(F.when(k == 0, email).when(k == 1, ip).when(k == 2, _card(m)).otherwise(phone), F.lit(False))


def _spoilt(m: Column, k: Column) -> Column:
    """The candidate with its checkable part broken."""
    last = F.pmod(F.substring(m, -1, 1).try_cast("int") + 1, F.lit(10)).cast("string")
    changed = F.concat(F.substring(m, F.lit(1), F.length(m) - 1), F.coalesce(last, F.lit("7")))
    return F.when(k == 1, F.concat(m, F.lit("99"))).when(k == 0, F.concat(m, F.lit("0"))).when(k == 3, F.substring(m, F.lit(1), F.length(m) - 3)).otherwise(changed)


@dataclass(frozen=True)
class Model:
    trees: GBTClassificationModel
    names: tuple[str, ...]
    thresholds: Mapping[int, float]

    def accepted(self, rows: DataFrame) -> DataFrame:
        """Candidate rows that reach the threshold of their kind, with the probability ``p``."""
        scored = self.trees.transform(_assembled(rows, self.names))
        at = F.lit(2.0)
        for kind, t in self.thresholds.items():
            at = F.when(F.col("k") == kind, F.lit(t)).otherwise(at)
        return scored.withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= at).select(*rows.columns, "p")


def _assembled(rows: DataFrame, names) -> DataFrame:
    known = features()
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.withColumns({n: known[n] for n in names}))


def labelled(rows: DataFrame) -> DataFrame:
    """Every distinct candidate row and its spoilt twin as ``(k, label, fold, *features, n)``; those alike in all of it are one row with their number ``n``."""
    both = rows.select("k", "m", "before", "after").distinct()
    both = both.select("k", F.explode(F.array(F.col("m"), _spoilt(F.col("m"), F.col("k")))).alias("m"), "before", "after")
    known = features()
    fold = F.pmod(F.xxhash64("m", "before"), F.lit(3))
    told = both.select("k", weak_label().cast("double").alias("label"), fold.alias("fold"), *[c.alias(n) for n, c in known.items()])
    return told.groupBy("k", "label", "fold", *known).agg(F.count(F.lit(1)).cast("double").alias("n"))


def train(rows: DataFrame) -> Model | None:
    """Fit trees on all candidate rows; ``None`` where a class is missing.

    Candidates of equal features are weighted by their number, so the trees
    read few rows however many candidates there are.  Two thirds of the
    candidates grow trees; on the rest each kind gets the lowest threshold at
    which its precision stays at or above ``PRECISION``.
    """
    told = written(labelled(rows), "pii-labelled")
    grown = told.where("fold > 0")
    if grown.select("label").distinct().count() < 2:
        return None
    names = tuple(features())
    vectors = VectorAssembler(inputCols=list(names), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="n").fit(vectors.transform(grown).select("features", "label", "n"))
    scored = trees.transform(vectors.transform(told.where("fold = 0"))).select("k", "label", "n", vector_to_array("probability")[1].alias("p"))
    by_p = scored.groupBy("k", "p").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    # One row per kind and distinct probability, of which few trees have few.
    upto = Window.partitionBy("k").orderBy(F.desc("p"))
    sums = by_p.select("k", "p", (F.sum("good").over(upto) / F.sum("n").over(upto)).alias("precision"))
    found = sums.where(F.col("precision") >= PRECISION).groupBy("k").agg(F.min("p").alias("p")).collect()
    return Model(trees, names, {r["k"]: max(r["p"], 0.5) for r in found})


def best_spans(found: Column) -> Column:
    """Of spans ``(p, s, k, e)``, smallest ``p`` first, each that overlaps none taken before it."""
    taken = F.aggregate(
        F.sort_array(found),
        spans.none(),
        lambda acc, x: F.when(spans.overlaps(x, acc), acc).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))),
    )
    return F.sort_array(taken)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``all`` spans of each row.

    Null and empty texts have no spans; rows that repeat id and text have the
    same.  Without candidates of both labels only base spans come out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", *doc_key(docs), base_spans(text).alias("base"), candidates(text).alias("candidates"))
    rows = written(rows, "pii-spans")
    one = rows.where(F.size("candidates") > 0).select("__d", "__t", "base", F.explode("candidates").alias("c"))
    one = one.select("__d", "__t", F.col("c.*"), spans.overlaps(F.col("c"), F.col("base")).alias("known"))
    model = train(one)
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("all"))
    taken = model.accepted(one.where(~F.col("known")).drop("known"))
    # Repeated rows propose the same spans.
    per_doc = taken.groupBy("__d", "__t").agg(F.collect_set(F.struct((-F.col("p")).alias("p"), "s", "k", "e")).alias("added"))

    per_doc = written(per_doc.select("__d", "__t", best_spans(F.col("added")).alias("added")), "pii-added")
    joined = rows.drop("candidates").join(per_doc, ["__d", "__t"], "left")
    return joined.select("doc_id", "base", spans.together(F.col("base"), F.coalesce("added", spans.none())).alias("all"))


def result(docs: DataFrame) -> DataFrame:
    """Contract columns: counts and digest of the base spans, and all spans."""
    scanned = scan(docs)
    counts = [spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return scanned.select(
        "doc_id", *counts, F.sha2(spans.written_out(F.col("base"), KINDS), 256).alias("base_sha256"), spans.written_out(F.col("all"), KINDS).alias("spans")
    )
