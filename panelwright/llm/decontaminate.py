"""Benchmark decontamination by template canonicalisation.

Both sides are turned into template tokens: words with a digit become a number
slot, a known unit after a number becomes a unit slot, capitalised words inside
a sentence become a name slot (runs of one slot type are one slot), everything
else is the lower-cased word without punctuation.  Windows of template tokens
are hashed and joined; matched windows of a document and an item are gathered
along their diagonal, and a match counts when enough windows agree and the slots
are consistent: one value of the item always meets the same value of the document.
So a question asked anew with other numbers or names is found, and a text that
merely shares a frame is not.

Beside the templates, windows of the literal case-folded words are matched, so
capitals and punctuation do not hide a copy.  Windows whose slots hold the item's own
values count whatever the others say; consistency is asked of reworded ones.
A few literal windows do not count when the reworded ones around them contradict
each other; ``MIN_LITERAL_COPY`` of them, or all of the item's, do.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import doc_key, sent_by_value, written

sent_by_value(__name__)

WINDOW = 8
# A window needs this many literal words, at least half of it.
MIN_LITERAL = 4
# A hit has at least half the windows of the item, or this many in a row of template tokens.
MIN_SHARE = 0.5
MIN_MATCHED = 6
# So many identical windows (20 words in a row) are a copy, also where other windows contradict each other.
MIN_LITERAL_COPY = 13
# Bits of the presence map of template windows: a fixed size, whatever the size of the benchmark.
MAP_BITS = 24
# Units that may follow a number.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb lbs oz ml l cl s sec min h hr hrs hours minutes seconds days weeks months years "
    b"percent usd eur dollars euros cents kmh mph w kw v a hz khz mhz ghz kb mb gb tb c f".split()
)
_NUMBER, _UNIT, _NAME = 1, 2, 3
_MARK = {t: np.uint64(xxhash.xxh64_intdigest(b"\x00slot%d" % t)) for t in (_NUMBER, _UNIT, _NAME)}
# Length-preserving: letters to lower case, ASCII punctuation to spaces.
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))
_IS_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_IS_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_ENDS = np.array([chr(c) in ".!?\n|:" for c in range(256)])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
# Keeps literal windows apart from template windows.
_LITERAL_SALT = np.uint64(0xD6E8FEB86659FD93)


def _rolled(hashes: np.ndarray, width: int, start: np.uint64) -> np.ndarray:
    """Hash of each window of ``width`` hashes."""
    n = len(hashes) - width + 1
    total = np.full(n, start, np.uint64)
    for j in range(width):
        total = (total * _FACTOR) ^ hashes[j : j + n]
        total ^= total >> np.uint64(29)
    return total


class Literal:
    """Case-folded words of one text, without regard to capitals and punctuation."""

    def __init__(self, text: str | None):
        ws = _WORD.findall(unicodedata.normalize("NFC", text or "").casefold())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ws), np.uint64, len(ws))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.arange(n), _rolled(self.hashes, width, np.uint64(width) ^ _LITERAL_SALT)

    def slots(self, start: int, width: int) -> None:
        return None

    def edge(self, start: int, width: int) -> int:
        return 0


class Template:
    """Template tokens of one text: hashes, slot types, and where each token lies in the word list."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        plain = raw.translate(_PLAIN)
        self.words = plain.split()
        n = len(self.words)
        self.kinds = np.zeros(n, np.int8)
        if not n:
            self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        own = np.frombuffer(raw, np.uint8)
        blank = np.frombuffer(plain, np.uint8) <= 32
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        number = np.add.reduceat(_IS_DIGIT[own], starts) > 0
        ends = np.cumsum(_ENDS[own])
        fresh = np.concatenate(([True], ends[starts[1:]] > ends[starts[:-1]]))
        second = own[np.minimum(starts + 1, len(own) - 1)]
        # A capital of Latin-1 is C3 80 to C3 9E in UTF-8.
        capital = _IS_UPPER[own[starts]] | ((own[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        self.kinds[capital & ~fresh] = _NAME
        self.kinds[number] = _NUMBER
        for i in np.flatnonzero(number[:-1]).tolist():
            if not number[i + 1] and self.words[i + 1] in UNITS:
                self.kinds[i + 1] = _UNIT
        for kind, mark in _MARK.items():
            hashes[self.kinds == kind] = mark
        repeated = (self.kinds[1:] == self.kinds[:-1]) & np.isin(self.kinds[1:], (_NUMBER, _NAME))
        self.first = np.flatnonzero(np.concatenate(([True], ~repeated)))
        self.hashes, self.kinds = hashes[self.first], self.kinds[self.first]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with enough literal words."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = _rolled(self.hashes, width, np.uint64(width))
        literal = np.concatenate(([0], np.cumsum(self.kinds == 0)))
        good = np.flatnonzero(literal[width:] - literal[:-width] >= min(MIN_LITERAL, (width + 1) // 2))
        return good, total[good]

    def slots(self, start: int, width: int) -> list[str]:
        """Values of the slots of a window, in order."""
        edges = np.append(self.first, len(self.words))
        return [
            b" ".join(self.words[edges[i] : edges[i + 1]]).decode("utf-8", "replace")
            for i in range(start, start + width)
            if self.kinds[i]
        ]

    def edge(self, start: int, width: int) -> int:
        """1 if the first token of a window is a slot, 2 if the last one is, 3 for both."""
        return int(self.kinds[start] > 0) + 2 * int(self.kinds[start + width - 1] > 0)


_COLUMNS = "w long, at long, slots array<string>, edge int, width int, literal boolean"
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_())


def _window_rows(n_keys: int, widths: dict[bool, list[int]] | None, present: np.ndarray | None):
    """Map batches ``(keys..., text)`` to window rows; an item has windows of its own length if it is shorter than ``WINDOW``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            out: tuple[list, ...] = tuple([] for _ in _KINDS)
            for i, text in enumerate(batch.column(n_keys)):
                for literal, form in ((False, Template), (True, Literal)):
                    if widths is not None and not widths[literal]:
                        continue
                    tokens = form(text.as_py())
                    for width in widths[literal] if widths is not None else (min(WINDOW, max(len(tokens.hashes), 1)),):
                        starts, hashes = tokens.windows(width)
                        if present is not None:
                            place = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                            hit = (present[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                            starts, hashes = starts[hit], hashes[hit]
                        at = starts.tolist()
                        index += [i] * len(at)
                        values = (hashes.view(np.int64).tolist(), at, [tokens.slots(s, width) for s in at], [tokens.edge(s, width) for s in at])
                        for column, part in zip(out, (*values, [width] * len(at), [literal] * len(at)), strict=True):
                            column += part
            if index or present is None:
                keys = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(n_keys)]
                rows = [pa.array(column, kind) for column, kind in zip(out, _KINDS, strict=True)]
                names = [c.split()[0] for c in _COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([*keys, *rows], names=[*batch.schema.names[:n_keys], *names])

    return run


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, item_key, w, at, slots, edge, width, literal)``: template and literal windows of every item with two tokens or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", text).alias("item_key"), text.alias("text"))
    keyed = keyed.dropDuplicates(["item_key"])
    rows = keyed.mapInArrow(_window_rows(2, None, None), "item_id long, item_key long, " + _COLUMNS)
    return written(rows.where(F.col("width") > 1), "benchmark-windows")


def _presence(windows: DataFrame) -> np.ndarray:
    """A bit map of fixed size of the windows that occur; built by a grouped aggregate."""
    place = F.col("w").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = windows.select(F.shiftright(place, 5).alias("word"), place.bitwiseAND(F.lit(31)).alias("bit")).distinct()
    packed = words.groupBy("word").agg(F.sum(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).collect()
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    for word, bits in packed:
        out[word] = bits
    return out.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item.

    ``doc_id, item_id, n_windows, n_matched, reworded`` with the document's key
    ``__d, __t``; ``reworded`` says that a slot value differs.  Null and empty
    texts and items without a literal window match nothing.  Rows that repeat
    id and text are one document.
    """
    items = benchmark_windows(benchmark)
    lengths = items.groupBy("item_key", "literal").agg(F.max(F.col("at")).alias("last"), F.count(F.lit(1)).alias("n"))
    items = items.join(lengths, ["item_key", "literal"])
    present = _presence(items)
    widths: dict[bool, list[int]] = {False: [], True: []}
    for width, literal in items.select("width", "literal").distinct().collect():
        widths[literal].append(width)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(docs), F.col("text").cast("string").alias("text"))
    found = keyed.mapInArrow(_window_rows(3, widths, present), "doc_id long, __d long, __t long, " + _COLUMNS).drop("edge", "width")
    found = written(found.dropDuplicates(["__d", "__t", "w", "at"]), "document-windows")
    other = items.select(
        "item_id", "item_key", "n", "w", "literal", "last", "edge", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")
    )
    joined = found.join(other, ["w", "literal"]).where(F.col("literal") | (F.size("slots") == F.size("item_slots")))
    # A slot at either end of the item ends there: what the document has beyond it is not the item's.
    opens = (F.col("item_at") == 0) & (F.col("edge").bitwiseAND(F.lit(1)) > 0)
    closes = (F.col("item_at") == F.col("last")) & (F.col("edge").bitwiseAND(F.lit(2)) > 0)

    def own(a, b, i):
        ahead = opens & (i == 0) & F.endswith(b, F.concat(F.lit(" "), a))
        behind = closes & (i == F.size("slots") - 1) & F.startswith(b, F.concat(a, F.lit(" ")))
        return F.struct(a.alias("a"), F.when(ahead | behind, a).otherwise(b).alias("b"))

    zipped = F.transform("item_slots", lambda a, i: own(a, F.get("slots", i), i))
    pairs = F.coalesce(zipped, F.array().cast("array<struct<a:string,b:string>>"))
    key = ["doc_id", "__d", "__t", "item_id", "item_key"]
    diagonal = joined.select(*key, "n", "literal", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", pairs.alias("pairs"))
    changed = F.exists("pairs", lambda p: p["a"] != p["b"])
    gathered = diagonal.groupBy(*key, "n", "literal", "diagonal").agg(
        F.count_distinct("item_at").alias("n_matched"),
        F.count_distinct(F.when(~changed, F.col("item_at"))).alias("n_same"),
        F.array_distinct(F.flatten(F.collect_set(F.when(changed, F.col("pairs"))))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    enough = (F.col("n_matched") >= MIN_SHARE * F.col("n")) | (F.col("n_matched") >= MIN_MATCHED)
    copied = (F.col("n_same") == F.col("n")) | (F.col("n_same") >= MIN_LITERAL_COPY)
    judged = gathered.where(enough).select(
        *key, "n", "literal", "n_matched", "n_same", consistent.alias("consistent"), copied.alias("copied"), changed.alias("reworded")
    )
    # Contradicting windows take away what few literal windows alone would say.
    counted = F.when(F.col("consistent"), F.col("n_matched")).otherwise(F.col("n_same"))
    hit = F.struct(
        (~F.col("reworded") | ~F.col("consistent")).alias("same"), counted.alias("n_matched"), F.col("n").alias("n_windows")
    )
    best = judged.groupBy(*key).agg(
        F.max(F.when(F.col("copied") | (F.col("consistent") & ~F.col("literal")), hit)).alias("sure"),
        F.max(F.when(F.col("literal"), hit)).alias("likely"),
        F.bool_or(~F.col("consistent")).alias("contradicted"),
    )
    best = best.withColumn("b", F.coalesce("sure", F.when(~F.col("contradicted"), F.col("likely")))).where("b IS NOT NULL")
    return best.select("doc_id", "__d", "__t", "item_id", "b.n_windows", "b.n_matched", (~F.col("b.same")).alias("reworded"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of :func:`matches` without the internal key."""
    return matches(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_matched", "reworded")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    lost = written(matches(docs, benchmark).select("__d", "__t").distinct(), "contaminated")
    keyed = docs.withColumns(dict(zip(("__d", "__t"), doc_key(docs), strict=True)))
    return keyed.join(lost, ["__d", "__t"], "left_anti").select(*docs.columns)
