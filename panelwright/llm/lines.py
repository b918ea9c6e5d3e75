"""Line de-duplication by a suffix array over line identities, built with distributed prefix doubling.

The lines of all documents form one sequence of line identities (a pair of
hashes).  Lines that occur once cannot lie in a repeated run; the others get
a position ``p`` in document order, and neighbours among them in one document
form a stretch.  The rank ``r`` of a suffix (what follows a position in its
stretch) is the number of suffixes whose first ``h`` lines are smaller; doubling
joins ``(r[p], r[p+h])`` on the unique position and ranks the pairs by running
counts over ranges.  A suffix that ends before ``h`` more lines differs from all
others.  Suffixes alone in their class keep their rank; when all are, ``r`` is
the suffix array.

The longest common prefix of two neighbours in that order is read from the
levels, longest first.  Stretches of the order whose prefixes have ``k`` lines or
more in common are the intervals of the runs of ``k`` lines; what is not the first
of its interval starts a later copy.  The longer of its two common prefixes is
how far the run at a position repeats; it is maximal if the run one line before does
not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import SPACE_CLASS, WORD_CHAR, doc_key, written
from panelwright.operators.ordered import positions, running_sums

# A later copy goes if it lies in a repeated run of MIN_LINES lines, or alone has MIN_WORDS words,
# or alone has COMMON_WORDS words and its line stands in COMMON_DOCS documents.
MIN_LINES = 2
MIN_WORDS = 10
COMMON_WORDS = 4
COMMON_DOCS = 10


def _at_least(n: int) -> str:
    """Pattern of a line with ``n`` words or more."""
    return f"(?:{WORD_CHAR}++{SPACE_CLASS}++){{{n - 1}}}{WORD_CHAR}"


_LONG_LINE, _COMMON_LINE = _at_least(MIN_WORDS), _at_least(COMMON_WORDS)
# Levels of common prefixes read in one plan.
LEVELS_PER_PLAN = 3


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: document key, number among such lines, place, identity, and whether it has many words, or some."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    full = F.filter(split, lambda x: x["line"].rlike(WORD_CHAR))
    exploded = docs.select(*doc_key(docs), F.posexplode(full).alias("__ln", "__x"))
    line = F.col("__x.line")
    return exploded.select(
        "__d", "__t", "__ln", F.col("__x.at").alias("__at"),
        F.xxhash64(line).alias("__h"), F.hash(line).alias("__g"), line.rlike(_LONG_LINE).alias("__long"), line.rlike(_COMMON_LINE).alias("__some"),
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines that occur twice or more, with position ``p`` and the stretch ``run`` they lie in."""
    rows = written(line_rows(docs), "lines")
    often = rows.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Rows that repeat id and text are one document: one row per line of it.
    repeated = rows.join(often, ["__h", "__g"], "left_semi").dropDuplicates(["__d", "__t", "__ln"])
    at = positions(repeated, [], [("__d", True), ("__t", True), ("__ln", True)], "p", None)
    # Positions and line numbers advance together inside a stretch of repeated lines of one document.
    return written(at.withColumn("run", F.xxhash64("__d", "__t", F.col("p") - F.col("__ln"))), "line-positions")


def _ranked_lines(at: DataFrame) -> DataFrame:
    """Ranks of one line: ``(p, run, r, n, first)``, class size and leftmost position beside the rank, and ``alone``: goes without its neighbours."""
    per_doc = at.groupBy("__h", "__g", "__d", "__t").agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("f"))
    classes = per_doc.groupBy("__h", "__g").agg(F.sum("c").alias("n"), F.min("f").alias("first"), F.count(F.lit(1)).alias("n_docs"))
    placed = running_sums(classes, [], [("__h", True), ("__g", True)], {"upto": "n"})
    joined = at.join(placed, ["__h", "__g"])
    alone = F.col("__long") | (F.col("__some") & (F.col("n_docs") >= COMMON_DOCS))
    return written(joined.select("p", "run", (F.col("upto") - F.col("n")).alias("r"), "n", "first", alone.alias("alone")), "line-ranks")


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    """Ranks of ``2 h`` lines from those of ``h``: the members of each class are ordered by what follows ``h`` lines on."""
    ahead = ranks.select(F.col("p").alias("q"), F.col("run").alias("run2"), F.col("r").alias("r2"))
    open_ = ranks.where(F.col("n") > 1).select("p", "run", "r")
    follows = open_.join(ahead, (F.col("q") == F.col("p") + h) & (F.col("run") == F.col("run2")), "left")
    # An end is like no other, and smaller than any line.
    pairs = written(follows.select("p", "run", "r", F.coalesce("r2", -1 - F.col("p")).alias("r2")), "line-pairs")
    classes = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    placed = running_sums(classes, ["r"], [("r2", True)], {"upto": "n"})
    moved = pairs.join(placed, ["r", "r2"]).select("p", "run", (F.col("r") + F.col("upto") - F.col("n")).alias("r"), "n", "first")
    return written(moved.union(ranks.where(F.col("n") == 1).select("p", "run", "r", "n", "first")), "line-ranks")


def suffix_array(at: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Rank of every suffix, all different, and the levels ``(h, ranks)`` in which some suffixes share ``h`` lines."""
    levels, h, ranks = [], 1, _ranked_lines(at)
    while not ranks.where(F.col("n") > 1).isEmpty():
        levels.append((h, ranks))
        ranks = _doubled(ranks, h)
        h *= 2
    return ranks, levels


def common_prefixes(order: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``(r, p, run, before, lcp)``: lines that a suffix has in common with the one before it in the order."""
    prior = order.select((F.col("r") + 1).alias("r"), F.col("p").alias("before"), F.col("run").alias("run_before"))
    found = order.select("r", "p", "run").join(prior, "r", "left").withColumn("lcp", F.lit(0).cast("long"))
    for i, (h, ranks) in enumerate(reversed(levels), 1):
        known = ranks.where(F.col("n") > 1)
        own = known.select(F.col("p").alias("q1"), F.col("run").alias("u1"), F.col("r").alias("c1"))
        other = known.select(F.col("p").alias("q2"), F.col("run").alias("u2"), F.col("r").alias("c2"))
        found = found.join(own, (F.col("p") + F.col("lcp") == F.col("q1")) & (F.col("run") == F.col("u1")), "left")
        found = found.join(other, (F.col("before") + F.col("lcp") == F.col("q2")) & (F.col("run_before") == F.col("u2")), "left")
        longer = F.col("lcp") + F.when(F.col("c1") == F.col("c2"), h).otherwise(0)
        found = found.select("r", "p", "run", "before", "run_before", longer.cast("long").alias("lcp"))
        if i % LEVELS_PER_PLAN == 0 or i == len(levels):
            found = written(found, "line-prefixes")
    return found.drop("run_before")


def _later_starts(prefixes: DataFrame, min_lines: int) -> DataFrame:
    """Positions at which a later copy of ``min_lines`` lines starts: all but the leftmost of each interval."""
    cut = prefixes.select("r", "p", (F.col("lcp") < min_lines).cast("long").alias("cut"))
    numbered = written(running_sums(cut, [], [("r", True)], {"interval": "cut"}).select("p", "interval"), "line-intervals")
    firsts = numbered.groupBy("interval").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first")).where(F.col("n") > 1)
    return numbered.join(firsts, "interval").where(F.col("p") != F.col("first")).select("p")


def _lost(at: DataFrame, starts: DataFrame, first_level: DataFrame, min_lines: int) -> DataFrame:
    """``(__d, __t, __at)`` of the lines inside a later copy, and of later copies of lines that go alone."""
    covered = starts.select(F.explode(F.sequence(F.col("p"), F.col("p") + (min_lines - 1))).alias("p"))
    alone = first_level.where(F.col("alone") & (F.col("p") != F.col("first"))).select("p")
    return at.join(covered.union(alone).distinct(), "p", "left_semi").select("__d", "__t", "__at")


def deletions(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """Lines to delete as ``(__d, __t, __at)``, and the maximal repeated runs.

    A run is ``(__d, __t, start, n_lines, later)``: the most lines from ``start`` on
    that stand elsewhere too, ``min_lines`` or more, where no run one line earlier holds
    it; ``later`` says that it starts like one at an earlier position.
    """
    at = repeated_lines(docs)
    order, levels = suffix_array(at)
    if not levels:
        runs = at.where("false").select("__d", "__t", F.col("__ln").alias("start"), F.col("p").alias("n_lines"), F.lit(True).alias("later"))
        return at.where("false").select("__d", "__t", "__at"), runs
    prefixes = common_prefixes(order, levels)
    starts = written(_later_starts(prefixes, min_lines), "line-starts")
    both = prefixes.select("p", "lcp").union(prefixes.where("before IS NOT NULL").select("before", "lcp"))
    # Every position is in both columns, so this joins no hot key.
    reach = written(both.groupBy("p").agg(F.max("lcp").alias("n_lines")).join(at.select("p", "run", "__d", "__t", "__ln"), "p"), "line-reach")
    back = reach.select((F.col("p") + 1).alias("p"), F.col("run").alias("run_back"), F.col("n_lines").alias("held"))
    maximal = reach.where(F.col("n_lines") >= min_lines).join(back, "p", "left").where(
        F.col("held").isNull() | (F.col("run") != F.col("run_back")) | (F.col("held") <= F.col("n_lines"))
    )
    marked = maximal.join(starts.withColumn("later", F.lit(True)), "p", "left")
    runs = marked.select("__d", "__t", F.col("__ln").alias("start"), "n_lines", F.coalesce("later", F.lit(False)).alias("later"))
    return _lost(at, starts, levels[0][1], min_lines), runs


def shallow_deletions(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The lines of :func:`deletions` without the runs: classes of ``min_lines`` lines are its intervals, so doubling may end there."""
    at = repeated_lines(docs)
    h, first_level = 1, _ranked_lines(at)
    ranks = first_level
    while 2 * h <= min_lines:
        ranks, h = _doubled(ranks, h), 2 * h
    if h < min_lines:
        # Two windows of h lines that overlap cover exactly min_lines.
        ranks = _doubled(ranks, min_lines - h)
    starts = ranks.where((F.col("n") > 1) & (F.col("p") != F.col("first"))).select("p")
    return _lost(at, starts, first_level, min_lines)


def _per_doc(lost: DataFrame) -> DataFrame:
    return lost.groupBy("__d", "__t").agg(F.collect_set("__at").alias("__gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in ``gone``."""
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, lost: DataFrame | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``; ``n_chars`` follows where it exists.

    A null text stays null.  A document whose lines are all later copies keeps
    its row with an empty text.  Lines without a word stay where they are
    unless everything around them goes; they neither break nor make a run.
    """
    if lost is None:
        lost = shallow_deletions(docs, min_lines)
    per_doc = written(_per_doc(lost), "line-deletions")
    keyed = docs.withColumns(dict(zip(("__d", "__t"), doc_key(docs), strict=True)))
    # The deletions grow with the documents: one plan at every size, in which hot keys can be split.
    joined = keyed.join(per_doc.hint("merge"), ["__d", "__t"], "left")
    new = {"text": F.transform(F.array(F.struct("text", F.col("__gone").alias("gone"))), lambda x: _without(x["text"], x["gone"]))[0]}
    out = joined.withColumns(new)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per document: ``doc_id``, lines with a word, lines deleted, maximal repeated runs that start in it, lines of the longest, MD5 of the text left.

    A null text counts as empty here; repeated rows give a row each, and their
    lines and runs count as those of one document.
    """
    lost, runs = deletions(docs, min_lines)
    tallied = runs.groupBy("__d", "__t").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n_lines").alias("longest_run"))
    per_doc = written(_per_doc(lost).join(tallied, ["__d", "__t"], "full"), "line-deletions")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *doc_key(docs)).join(per_doc.hint("merge"), ["__d", "__t"], "left")
    full = F.size(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD_CHAR)))
    left = F.transform(F.array(F.struct("text", F.col("__gone").alias("gone"))), lambda x: _without(x["text"], x["gone"]))[0]
    return keyed.select(
        "doc_id",
        full.cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_runs", "longest_run")],
        F.md5(left).alias("text_md5"),
    )


def _plain(pattern: str) -> str:
    return pattern.replace("++", "+")


# "m" grows every repeated window line by line, so its last length at a position is how far the run there repeats.
ORACLE_SQL = rf"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, li, line, regexp_matches(line, '{_plain(_LONG_LINE)}') AS long, regexp_matches(line, '{_plain(_COMMON_LINE)}') AS common,
         row_number() OVER (PARTITION BY doc_id ORDER BY li) AS ln, row_number() OVER (ORDER BY doc_id, li) AS p
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS li FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS MATERIALIZED (SELECT line, min(p) AS c, count(DISTINCT doc_id) AS n_docs FROM l GROUP BY line HAVING count(*) > 1),
m AS (
  SELECT p, doc_id, c, CAST(1 AS BIGINT) AS k FROM l JOIN c USING (line)
  UNION ALL
  SELECT p, doc_id, c, k + 1 FROM (
    SELECT m.p, m.doc_id, m.k, min(m.p) OVER w AS c, count(*) OVER w AS n
    FROM m JOIN l ON l.p = m.p + m.k AND l.doc_id = m.doc_id WINDOW w AS (PARTITION BY m.c, l.line)) WHERE n > 1),
e AS (SELECT p, doc_id, max(k) AS reach, bool_or(k = 2 AND c < p) AS later2, bool_or(k = 1 AND c < p) AS later1 FROM m GROUP BY p, doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, max(reach) AS longest_run
      FROM (SELECT e.*, b.reach AS held FROM e LEFT JOIN e b ON b.p = e.p - 1 AND b.doc_id = e.doc_id)
      WHERE reach >= 2 AND (held IS NULL OR held <= reach) GROUP BY doc_id),
g AS (SELECT l.*, coalesce(later2, false) OR coalesce(lag(later2) OVER (PARTITION BY l.doc_id ORDER BY ln), false)
             OR (coalesce(later1, false) AND (long OR (common AND n_docs >= {COMMON_DOCS}))) AS gone
      FROM l LEFT JOIN e USING (p) LEFT JOIN c USING (line)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, list(li) FILTER (gone) AS gs FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run,
       md5(array_to_string(list_transform(list_filter(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1), lambda i: gs IS NULL OR NOT list_contains(gs, i)),
           lambda i: string_split(coalesce(text, ''), chr(10))[i]), chr(10))) AS text_md5
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
