"""Quality, decontamination, language, archive, chat, mixing and the pipeline."""

import random

import pytest
import regex
import zstandard

import corpus_pipeline
from panelwright.llm import archive, chat, decontaminate, language, mixing, neardup, quality
from panelwright.llm.catalog import MIX, ORACLE, QUERIES


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted(df.select(*columns).collect()) == _sorted(result.fetchall())


def test_quality_edges(odd_docs, no_docs):
    rows = quality.verdicts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_words == by_id[7].n_words == 0 and by_id[2].base_failed and not by_id[2].kept
    assert by_id[9].n_repeat_words == by_id[9].n_words == 550 and by_id[9].n_dup_lines == 49
    assert by_id[8].n_words == 30_000 and by_id[8].n_repeat_words == 0
    passing = quality.passing(odd_docs)
    assert passing.columns == odd_docs.columns
    assert passing.count() == sum(r.kept for r in rows)
    assert quality.verdicts(no_docs).collect() == [] and quality.passing(no_docs).collect() == []


def test_quality_rejects_symbols_and_keeps_prose(spark):
    rng = random.Random(1)
    words = ["the", "and", "river", "stone", "walks", "under", "bright", "morning", "with", "several", "friends", "home"]
    prose = [(i, " ".join(rng.choice(words) + str(i % 7) * (rng.random() < 0.1) for _ in range(rng.randint(40, 200))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(words) + "###$$$"[: rng.randint(3, 6)] for _ in range(100)), "en", "s") for i in range(30)]
    rows = quality.verdicts(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.kept for r in rows if r.doc_id >= 1000)
    assert all(r.kept for r in rows if r.doc_id < 1000)


ITEM = "A train leaves Boston at 60 km per hour and a car leaves at 45 km per hour so how long until they meet near Denver again"


def test_reparameterised_questions_are_found(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "two words"), (4, "")], "item_id long, text string")
    other = ITEM.replace("60", "82").replace("45", "31").replace("Boston", "Paris").replace("Denver", "Lyon")
    clash = "Tom has 5 apples and buys 5 more apples at the market so how many does he hold in the end now"
    docs = spark.createDataFrame(
        [
            (10, "intro words here. " + ITEM + ". and more"),
            (11, "some other words. " + other + " the end"),
            (12, "the train and the car are slow today and nothing else happens in this quiet text at all"),
            (13, clash.replace("5", "7", 1)),
            (14, None),
        ],
        "doc_id long, text string",
    )
    items = items.union(spark.createDataFrame([(5, clash)], "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.contaminated(docs, items).collect()}
    # Item 5 asks twice for one number; document 13 answers with two.
    assert rows == {(10, 1): False, (11, 1): True}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [12, 13, 14]


def test_identical_windows_count_beside_contradicting_ones(spark):
    """A list number before the item, a name before it, and one edit of a repeated name lose no verbatim copy."""
    birds = "12 birds sat in the old tree and then 12 more came along to sing with them until night"
    towns = "Boston is far away but people from Boston like to travel over the hills to see the wide river"
    long = " ".join(f"{'then Rome ' if i % 4 == 0 else ''}has plain{i} and other{i}" for i in range(12))
    items = spark.createDataFrame([(1, birds), (2, towns), (3, long)], "item_id long, text string")
    docs = [(1, "3. " + birds), (2, "we met Tom " + towns), (3, "so " + long.replace("Rome", "Oslo", 1)), (4, "12 birds and 12 more")]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 2), (3, 3)}


def test_case_and_short_items_do_not_hide_copies(spark):
    short = "Every river flows down to the sea"
    dashed = "one\u2013two \u201cthree\u201d four\u00a0five six seven"
    items = spark.createDataFrame([(1, ITEM), (2, short), (3, dashed)], "item_id long, text string")
    docs = [(1, "Intro " + ITEM.upper()), (2, ITEM.title()), (3, ITEM.lower()), (4, "whble Or onorha " + short + " onorha"), (5, "so " + dashed + " so"), (6, "every river")]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_decontamination_matches_search(documents, spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts, wanted = documents.select("doc_id", "text").collect(), items.collect()
    expected = {d.doc_id for d in texts if any(i.text in d.text for i in wanted)}
    assert {r.doc_id for r in decontaminate.contaminated(documents, items).collect()} == expected


def test_decontamination_edges(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(odd_docs, none).count() == odd_docs.count()
    items = spark.createDataFrame([(1, odd_docs.where("doc_id = 1").first().text), (1, None)], "item_id long, text string")
    left = decontaminate.clean(odd_docs, items)
    assert left.columns == odd_docs.columns
    assert {r.doc_id for r in left.collect()} == {2, 3, 5, 7, 8, 9, 10, 11}
    assert decontaminate.contaminated(no_docs, items).collect() == []


def test_language_accuracy_and_edges(spark, documents, odd_docs, no_docs):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = [r for r in language.result(documents).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.94 * len(rows)  # two of 38 texts are a word or two
    model = language.train(documents.select("text", "lang"))
    found = {r.doc_id: r for r in language.classified(odd_docs, model).collect()}
    assert [found[i].lang_pred for i in (2, 3, 7)] == ["und"] * 3 and found[8].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.classified(odd_docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.result(no_docs).collect() == []


def test_language_keeps_marks():
    assert language._letters("हिन्दी में लिखा 12 e\u0301te\u0301").decode() == "हिन्दी में लिखा e\u0301te\u0301"
    assert language._letters("\u0301\u0902 12 ² _") == b""


def test_language_matches_plain_compression(spark, documents):
    """Every whole text against zstandard used plainly: block by block, per dictionary, the smallest sum."""
    model = language.train(documents.where(~language.held_out()).select("text", "lang"))
    assert all(0 < len(d) <= language.DICTIONARY_BYTES + language.SAMPLE_DOCS for d in model.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.classified(documents, model).collect()}
    coders = {
        (lang, level): zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        for lang, d in model.items()
        for level in (language.LEVEL, language.FINE_LEVEL)
    }
    for r in documents.collect():
        raw = " ".join(regex.findall(r"\p{L}[\p{L}\p{M}]*", (r.text or "").lower())).encode()
        if not raw:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        for level in (language.LEVEL, language.FINE_LEVEL):
            sizes = sorted((sum(len(coders[lang, level].compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)), lang) for lang in model)
            if sizes[0][0] <= (1 - language.MIN_MARGIN) * sizes[1][0]:
                break
        assert got[r.doc_id] == (sizes[0][1], pytest.approx(1 - sizes[0][0] / sizes[1][0])), r.doc_id


def test_archive_edges(spark):
    long = "<p>x</p>" * 100
    pages = spark.createDataFrame(
        [
            (5, "http://a b/\t", long), (3, None, long), (3, None, long), (None, "u", long), (1, "http://e/", None), (2, "u", ""),
            (7, "u", "short"), (8, "u", "short"), (9, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n" + "\n1 0 x\n" * 30), (10, "é", "é\x00\r\n" * 99),
        ],
        "page_id long, url string, html string",
    ).selectExpr("*", "1 AS value", "2 AS digest")
    rows = archive.result(pages).collect()
    assert len(rows) == 10 and all(r.digest_ok for r in rows)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert [k for k in kinds if k[1] == "revisit"] == [("5", "revisit", 3), ("None", "revisit", 3)]
    sizes = {r.page_id: r.payload_bytes for r in rows}
    assert sizes[1] == sizes[2] == 0 and sizes[5] == 800 and sizes[10] == 99 * 5
    assert archive.result(pages.where("false")).collect() == []


def test_arc_versions_and_damage():
    one = b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n%s"
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    good = b"http://a/ 1.2.3.4 19990102030405 text/html 5\nhello\n"
    bad = b"http://b/ 1.2.3.4 19990102030405 text/html 999\nhello\n"
    two = b"http://c/ 1.2.3.4 1999 text/html 200 - - 0 f 3\nabc\n"
    found = list(archive.parse_arc(one % (len(block), block) + good + bad + two + good))
    assert [(r["url"], r["payload"], r["date"]) for r in found] == [
        ("http://a/", b"hello", "1999-01-02T03:04:05Z"),
        ("http://c/", b"abc", "1999-01-01T00:00:00Z"),
        ("http://a/", b"hello", "1999-01-02T03:04:05Z"),
    ]


def test_chat_round_trip(spark):
    texts = ["</s>", "\\", "\\\\</s>", "<\\s>", "[INST] x [/INST]", "<<SYS>>\\<</SYS>>", "[ROLE=abc] [/ROLE]", "[\\INST]", "", None, "plain", "a\nb <s>"]
    turns = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    turns += [(20, 0, "tool", "</s>[/ROLE]"), (20, 1, None, None), (20, None, "user]", "q"), (None, 0, "user", "x"), (21, 0, "user", "same"), (21, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments")
    rows = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    for c in range(12):
        own = [(r, x or "") for k, _, r, x in turns if k == c]
        assert [(t.role, t.text) for t in rows[c].turns] == own
        assert rows[c].loss_text == "".join(x for r, x in own if r == "assistant")
        assert rows[c].valid and "".join(s.text for s in rows[c].segments) == rows[c].formatted
        assert rows[c].formatted.count("</s>") == 2 and rows[c].formatted.count("[INST]") == 2
    assert [(t.role, t.text) for t in rows[20].turns] == [("user]", "q"), ("tool", "</s>[/ROLE]"), ("", "")] and not rows[20].valid
    assert rows[21].n_turns == 2 and not rows[21].valid and rows[None].n_turns == 1
    assert [r.conv_id for r in chat.result(df.where("false")).collect()] == [-7]


def plain_budgets(leaves, mix):
    """Water filling level by level with fractions."""
    from fractions import Fraction

    def fill(total, children):
        out, open_, rest = {}, dict(children), Fraction(total)
        while open_:
            w = sum(weight for weight, _ in open_.values())
            dry = {k: cap for k, (weight, cap) in open_.items() if rest * weight >= cap * w}
            if not dry:
                return out | {k: rest * weight / w for k, (weight, _) in open_.items()}
            out |= dry
            rest -= sum(dry.values())
            open_ = {k: v for k, v in open_.items() if k not in dry}
        return out

    def walk(prefix, total):
        if len(prefix) == 3:
            return {prefix: total}
        level = mixing.LEVELS[len(prefix)]
        children = {}
        for key, tokens in leaves.items():
            if key[: len(prefix)] == prefix:
                k = key[: len(prefix) + 1]
                w, cap = children.get(k, (mix.weights.get(level, {}).get(k[-1], 1), 0))
                children[k] = (w, cap + tokens * mix.max_epochs)
        out = {}
        for k, share in fill(total, children).items():
            out |= walk(k, share)
        return out

    every = sum(leaves.values())
    return walk((), min(every * mix.budget_percent // 100, every * mix.max_epochs))


def test_budgets_fill_siblings_before_ancestors(spark):
    rng = random.Random(5)
    leaves = {(d, lang, s): rng.randint(1, 100_000) for d in ("web", "books", "forum") for lang in ("en", "de") for s in "abc"}
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "__domain string, __lang string, __source string, tokens long")
    df = df.withColumn("tokens", df.tokens.cast("decimal(20,0)"))
    for percent, epochs in ((100, 3), (100, 1), (30, 1), (250, 3)):
        mix = mixing.Mix(weights={"domain": {"web": 9}, "lang": {"de": 5}}, budget_percent=percent, max_epochs=epochs)
        got = {(r["__domain"], r["__lang"], r["__source"]): r.budget for r in mixing.budgets(df, mix).collect()}
        want = plain_budgets(leaves, mix)
        assert all(abs(got[k] - want[k]) <= 3 for k in leaves)
        assert sum(got.values()) == min(sum(leaves.values()) * percent // 100, sum(leaves.values()) * epochs)


def test_mixing_draws_rows_without_an_id_by_their_text(spark):
    """Many null ids, texts of one length, repeated rows: what is cut does not depend on where rows lie."""
    rows = [(None if i % 3 else i, f"w{i // 2} a b c", "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(budget_percent=37)
    drawn = [sorted((str(r.doc_id), r.text, r.taken) for r in mixing.mixed(d, mix, ["doc_id", "text"]).collect()) for d in (df, df.repartition(7, "text"), df.orderBy("text").coalesce(1))]
    assert drawn[0] == drawn[1] == drawn[2]
    assert sum(t for _, _, t in drawn[0]) == 4 * 300 * 37 // 100


def test_quality_fences_move_smoothly_with_the_size_of_a_group(spark):
    """One document more never throws a group from its language's fences to its own."""
    prose = "some plain words of text that go on for quite a while and say nothing at all about any thing in the world today"

    def high(n):
        wide = [(f"{prose} {i}", "en", "wide") for i in range(200)]
        own = [(f"{prose} {'#' * 60} {i}", "en", "own") for i in range(n)]
        df = spark.createDataFrame(wide + own, "text string, lang string, source string")
        (row,) = quality.fences(quality.measured(df, [])).where("__source = 'own'").collect()
        return row["__high_symbols"]

    at = [high(n) for n in (1, 49, 50, 150)]
    assert at[0] < at[1] <= at[2] < at[3] and at[2] - at[1] < (at[3] - at[0]) / 20


def test_mixing_takes_each_leaf_budget(documents, odd_docs, no_docs):
    made = mixing.plan(documents, MIX).leaves.collect()
    want = {(r["__domain"], r["__lang"], r["__source"]): r.budget for r in made}
    got = {}
    for r in mixing.mixed(documents, MIX, ["doc_id", "lang", "source"]).collect():
        k = (r.domain, r.lang, r.source)
        got[k] = got.get(k, 0) + r.taken
    assert got == {k: b for k, b in want.items() if b}
    rows = mixing.mixed(odd_docs.drop("epoch"), MIX, ["doc_id", "text"], cut_text=True).collect()
    assert not {r.doc_id for r in rows} & {2, 3, 5, 7}
    assert all(len(r.text.split()) == r.taken for r in rows if r.taken < r.n_tokens)
    assert sum(r.taken for r in rows) == sum(r.budget for r in mixing.plan(odd_docs, MIX).leaves.collect())
    assert mixing.mixed(no_docs, MIX).collect() == []


def test_pipeline_matches_its_stages_by_hand(spark, sf_dir, documents):
    docs = {r.doc_id: r.text for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string").join(documents.drop("text"), "doc_id"), sf_dir)
        assert sorted(out.columns) == sorted(documents.columns)
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "near_dedup":
            sets = {d: set(neardup.shingle_set(t).tolist()) for d, t in docs.items()}

            def near(a, b, sets=sets):
                common = len(sets[a] & sets[b])
                return sets[a] == sets[b] or 18 * common >= 8 * (len(sets[a]) + len(sets[b]))

            assert all(any(near(d, k) for k in sets if k != d) for d in docs.keys() - after.keys())
            assert not any(near(a, b) for a in after for b in after if a < b)
        if name != "line_dedup":
            assert all(docs[d] == t for d, t in after.items())
        assert after.keys() <= docs.keys()
        docs = after
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} <= docs.keys()
    assert sum(r.taken for r in rows) == sum(len(t.split()) for t in docs.values())


def test_pipeline_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
        corpus_pipeline.STAGES[-1][1](spark, docs.drop("epoch"), sf_dir).collect()
