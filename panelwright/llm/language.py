"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of a bounded sample
of its labelled texts.  A text belongs to the language whose dictionary
encodes it in the fewest bytes; where the runner-up is nearly as small the
answer is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import sent_by_value, written
from panelwright.operators.ordered import top_per_group

sent_by_value(__name__)

# The bounded sample: per language at most SAMPLE_DOCS distinct texts (smallest hashes, texts of at most SAMPLE_CHARS first), DICTIONARY_BYTES in all.
SAMPLE_DOCS = 200
SAMPLE_PARTS = 16
SAMPLE_CHARS = 8_192
DICTIONARY_BYTES = 112 * 1024
LEVEL = 6
# Texts with a narrow margin are encoded again at this level before they are rejected.
FINE_LEVEL = 12
# A text is encoded block by block, so that the dictionary counts to its end.
BLOCK = 8_192
# Below this share of saved bytes against the runner-up the answer is rejected.
MIN_MARGIN = 0.005
FOLDS = 5
UNKNOWN = "und"
# Marks (vowel signs, accents) belong to the letter before them.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _letters(text: str) -> bytes:
    """Runs of letters with their marks in lower case, joined by spaces: what a language shows itself in."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace")


def held_out() -> Column:
    """One fifth of the documents by CRC-32 of the id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language from rows ``(text, lang)``; null texts and languages are left out."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    key = rows.select("lang", (F.length("text") > SAMPLE_CHARS).alias("long"), F.xxhash64("text").alias("h"))
    # Distinct by hash: a group of copies of any size is one sample.  Each of the parts a language is dealt to keeps its
    # best, so what meets in one task is bounded by SAMPLE_DOCS * SAMPLE_PARTS rows however many tasks read the texts.
    key = key.distinct().withColumn("part", F.pmod(F.col("h"), F.lit(SAMPLE_PARTS)))
    order = [("long", True), ("h", True)]
    thinned = top_per_group(key, ["lang", "part"], order, SAMPLE_DOCS).select("lang", "long", "h")
    ranked = top_per_group(thinned, ["lang"], order, SAMPLE_DOCS)
    chosen = written(ranked.select("lang", "h", "rn"), "language-sample")
    texts = rows.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"])
    content: dict[str, bytearray] = {}
    # At most SAMPLE_DOCS rows per language, cut to what one dictionary holds.
    for lang, text in texts.select("lang", "rn", F.substring("text", 1, DICTIONARY_BYTES).alias("text")).orderBy("lang", "rn").select("lang", "text").collect():
        own = content.setdefault(lang, bytearray())
        if len(own) < DICTIONARY_BYTES:
            own += _letters(text)[: DICTIONARY_BYTES - len(own)] + b" "
    return {lang: bytes(own) for lang, own in sorted(content.items())}


class Classifier:
    def __init__(self, dictionaries: Mapping[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = {level: [_coder(dictionaries[lang], level) for lang in self.langs] for level in (LEVEL, FINE_LEVEL)}

    def _ranked(self, raw: bytes, level: int) -> list[tuple[int, str]]:
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sizes = [sum(len(coder.compress(block)) for block in blocks) for coder in self.coders[level]]
        return sorted(zip(sizes, self.langs, strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; ``und`` and 0 for a text without a letter or a model without languages."""
        raw = _letters(text or "")
        if not raw or not self.langs:
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        best, second, *_ = self._ranked(raw, LEVEL)
        if best[0] > (1 - MIN_MARGIN) * second[0]:
            best, second, *_ = self._ranked(raw, FINE_LEVEL)
        return best[1], 1.0 - best[0] / second[0]


def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def classified(docs: DataFrame, dictionaries: Mapping[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each row; the score is the share of bytes saved against the runner-up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                    pa.array([score < MIN_MARGIN for _, score in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def result(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, predict all of them.

    Empty texts and texts without a letter (marks alone are none) are ``und``
    with score 0; with no labelled text at all everything is ``und``.  Repeated rows keep a row each.
    """
    model = train(docs.where(~held_out()).select("text", "lang"))
    return classified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
