"""SimHash clusters and line runs against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from panelwright.llm import lines, neardup, simhash

SPACES = "[ \t\n\x0b\f\r]+"


def plain_fingerprint(text):
    ws = [w for w in re.split(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(rows):
    """Union over all pairs; rows are (doc_id, fingerprint)."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    best = {r: min([d for d in g if d is not None], default=None) for r, g in groups.items()}
    return sorted((str(rows[i][0]), f"{rows[i][1]:016x}", str(best[root(i)])) for i in range(len(rows)))


def ours(docs):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.result(docs).collect())


def test_clusters_match_brute_force(documents):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.select("doc_id", "text").collect()]
    assert ours(documents) == plain_components(rows)


def test_cluster_edges(odd_docs, no_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    assert ours(odd_docs) == plain_components(rows)
    assert ours(no_docs) == []
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(set(c for _, _, c in plain_components(rows)))
    assert simhash.one_per_group(no_docs).collect() == []


def test_rows_without_ids_keep_one(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "quite another text of words")], "doc_id long, text string")
    assert simhash.one_per_group(docs).count() == 2


@pytest.mark.parametrize("groups", [simhash.fingerprint_groups, simhash.near_copies])
def test_rows_without_ids_follow_their_group(spark, groups):
    """Near copies without ids stay once, and not at all beside a named row, whatever other rows there are."""
    rng = random.Random(9)
    long = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(600)) for _ in range(3)]
    near = [t + " end" for t in long]
    assert all((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4 for a, b in zip(long, near, strict=True))
    rows = [(1, long[0]), (None, near[0]), (None, long[0]), (None, long[1]), (None, near[1]), (None, long[2]), (7, near[2]), (None, "one unrelated row")]
    kept = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), groups).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "None", "None"]
    assert {r.text for r in kept if r.doc_id is None} == {"one unrelated row", min(long[1], near[1])}


def plain_jaccard(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited_copies(rng, n):
    """Texts of 60 to 400 words and, of each, a copy with one to eight words replaced."""
    vocabulary = [f"w{i}" for i in range(3_000)]
    texts = []
    for _ in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        copy = list(own)
        for i in rng.sample(range(len(own)), rng.randint(1, 8)):
            copy[i] = "changed"
        texts += [" ".join(own), " ".join(copy)]
    return texts


def test_near_copies_match_brute_force(spark):
    """Pairs at five-word Jaccard 0.8 and more are found, most of which differ in more than four bits; others stay."""
    texts = edited_copies(random.Random(5), 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_per_group(docs, simhash.near_copies).collect()}
    want = {i for i in range(0, 300, 2)} | {i for i in range(1, 300, 2) if plain_jaccard(texts[i - 1], texts[i]) < 0.8}
    assert kept == want
    far = [i for i in range(1, 300, 2) if i not in want and (simhash.fingerprint(texts[i - 1]) ^ simhash.fingerprint(texts[i])).bit_count() > 4]
    assert len(far) >= 10


def test_linked_fingerprints_propose_near_copies(spark, monkeypatch):
    """Without a common min-hash key the forest still finds edited copies, and only those that the whole sets confirm are grouped."""
    monkeypatch.setattr(neardup, "band_keys", lambda shingles: [])
    texts = edited_copies(random.Random(5), 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) for t in texts]
    want = {i for i in range(1, 300, 2) if plain_jaccard(texts[i - 1], texts[i]) >= 0.8 and (prints[i - 1] ^ prints[i]).bit_count() <= 4}
    kept = {r.doc_id for r in simhash.one_per_group(docs, simhash.near_copies).collect()}
    assert len(want) >= 10 and kept == set(range(300)) - want


def one_frame(n, edits, words=120):
    """Texts that share a frame, with ``edits`` words of their own each."""
    rng = random.Random(edits)
    frame = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    texts = []
    for i in range(n):
        own = list(frame)
        for at in rng.sample(range(words), edits):
            own[at] = f"own{i}at{at}"
        texts.append(" ".join(own))
    return texts


def plain_groups(texts):
    sets = [set(neardup.shingle_set(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 18 * len(sets[i] & sets[j]) >= 8 * (len(sets[i]) + len(sets[j])):
                parent[root(i)] = root(j)
    return {root(i) for i in range(len(texts))}


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_families_around_the_threshold(spark, monkeypatch, edits):
    """Five-word similarities of about 0.84, 0.71, 0.60 and 0.52: no link is lost, and pairs of templated pages stay few."""
    made = []
    written = neardup.written

    def counted(df, label):
        out = written(df, label)
        if label == "near-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    # Several blocks in a key.
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 5_000)
    texts = one_frame(240, edits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_per_group(docs, simhash.near_copies).count() == len(plain_groups(texts))
    # Each shingle that is not crowded pairs a set with fewer than that many others.
    assert made[0] <= 5 * len(texts)


def test_near_links_inside_a_key_are_not_lost(spark, monkeypatch):
    """One key holds everything: whom the smallest sets do not confirm, the others find."""
    monkeypatch.setattr(neardup, "band_keys", lambda shingles: [7] if len(shingles) else [])
    texts = edited_copies(random.Random(6), 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i in range(24) if i % 2 == 0 or plain_jaccard(texts[i - 1], texts[i]) < 0.8}
    assert {r.doc_id for r in simhash.one_per_group(docs, simhash.near_copies).collect()} == want


def test_forest_loses_no_link(spark, monkeypatch):
    """Chains, a dense cluster and random points, with trees that split down to small leaves."""
    monkeypatch.setattr(simhash, "LEAF_ROWS", 40)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(3_000)}
    for base in list(fps)[:150]:
        x = base
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    center = rng.getrandbits(64)
    fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(800)}
    x = np.array(sorted(fps), np.uint64)
    unique = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    star = {r.u: r.v for r in simhash.stars(simhash.links(unique)).collect()}
    got = [star.get(int(v), int(v)) for v in x.view(np.int64)]
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 4):
            parent[root(i)] = root(int(j))
    want = [root(i) for i in range(len(x))]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def plain_lines(docs, min_lines):
    """Delete later copies: windows of min_lines lines, single lines of ten words or more, and common ones of four; count maximal repeated runs."""
    seen, out = {}, {}
    seqs = []
    for d, text in sorted(docs, key=lambda r: r[0]):
        all_lines = (text or "").split("\n")
        full = [i for i, line in enumerate(all_lines) if re.search("[^\x20\x09-\x0d]", line)]
        seqs.append((d, all_lines, full))
    in_docs = Counter(line for _, all_lines, full in seqs for line in {all_lines[i] for i in full})
    windows = Counter(tuple(a[i] for i in f[s:e]) for _, a, f in seqs for s in range(len(f)) for e in range(s + 1, len(f) + 1))
    for d, all_lines, full in seqs:
        gone = set()
        reach = [max((e - s for e in range(s + 1, len(full) + 1) if windows[tuple(all_lines[i] for i in full[s:e])] > 1), default=0) for s in range(len(full))]
        runs = [n for s, n in enumerate(reach) if n >= min_lines and (s == 0 or reach[s - 1] <= n)]
        for width in {1, min_lines}:
            for s in range(len(full) - width + 1):
                w = tuple(all_lines[i] for i in full[s : s + width])
                if w in seen:
                    n_words = len([x for x in re.split(SPACES, w[0]) if x])
                    long = n_words >= lines.MIN_WORDS or (n_words >= lines.COMMON_WORDS and in_docs[w[0]] >= lines.COMMON_DOCS)
                    if width == min_lines or (width == 1 and long):
                        gone |= set(full[s : s + width])
                else:
                    seen[w] = d
        kept = "\n".join(line for i, line in enumerate(all_lines) if i not in gone)
        out[d] = (len(full), len(gone), len(runs), max(runs, default=0), hashlib.md5(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_line_runs_match_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    pool = [f"line {i}" for i in range(6)] + [" ".join(f"word{j}" for j in range(i, i + 12)) for i in range(4)] + ["", " \t"]
    pool += ["a line that is common"] + [f"some line of five {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs += [(60 + i, docs[i][1] if i % 2 else docs[i][1] + "\n" + docs[i + 1][1]) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_lines(docs, min_lines)
    assert {r.doc_id: tuple(r)[1:] for r in lines.report(df, min_lines).collect()} == want
    kept = {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in lines.deduplicated(df, min_lines).collect()}
    assert kept == {d: w[-1] for d, w in want.items()}


def test_maximal_runs(spark):
    run = "\n".join(f"shared {i}" for i in range(7))
    docs = spark.createDataFrame([(1, f"own a\n{run}\nown b"), (2, f"own c\nown d\n{run}"), (3, "own e")], "doc_id long, text string")
    _, runs = lines.deletions(docs)
    assert sorted((r["__d"], r.start, r.n_lines, r.later) for r in runs.collect()) == [(1, 1, 7, False), (2, 2, 7, True)]


def test_suffix_array_is_sorted(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(30)]
    at = lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    order, levels = lines.suffix_array(at)
    rows = at.orderBy("p").collect()
    # Compared by the identities; an end is smaller than any line.
    suffix = {r.p: [(x["__h"], x["__g"]) for x in rows[r.p :] if x.run == r.run] for r in rows}
    found = lines.common_prefixes(order, levels).orderBy("r").collect()
    assert [r.r for r in found] == list(range(len(rows)))
    assert [suffix[r.p] for r in found] == sorted(suffix.values())
    for a, b in zip(found, found[1:]):
        pairs = zip(suffix[a.p], suffix[b.p])
        assert b.before == a.p and b.lcp == len(list(itertools.takewhile(lambda x: x[0] == x[1], pairs)))


def test_line_edges(odd_docs, no_docs):
    out = lines.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[2].text is None and by_id[3].text == ""
    assert by_id[9].text == "line one is here and it is long enough to count\n"
    assert by_id[9].n_chars == len(by_id[9].text)
    assert by_id[6].text == "" and by_id[1].text != ""
    assert lines.deduplicated(no_docs).collect() == [] and lines.report(no_docs).collect() == []
