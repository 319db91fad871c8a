"""Quotes in other forms, work on a delta, brackets, places, draws, stages undone, edits and versions."""

import datetime as dt
import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.functions import variants as V
from clausewright.operators import change, compare, mutate, records, retrieve, rework, sequence, spans, undo, versioned
from clausewright.plans import delta, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# quotes


def test_places_of_very_many_matches(spark):
    text = "aé, " * 32_000
    began = time.time()
    got = one(spark, T.places(F.lit(text), "é,").alias("p")).p
    assert [(x.s, x.e) for x in got] == [(4 * i + 1, 4 * i + 3) for i in range(32_000)] and time.time() - began < 30
    assert one(spark, T.before_each(F.array().cast("array<int>")).alias("x")).x == []


def test_quotes_in_other_forms(spark):
    rng = random.Random(3)
    marks = ["‘", "’", "“", "–", "[", "{", ")", "  ", "\n\t", "\xa0", "ß", "é", "A", "b", ".", " "]
    fold = {"‘": "'", "’": "'", "“": '"', "–": "-", "[": "(", "{": "(", ")": ")"}
    rows = []
    for i in range(200):
        text = "".join(rng.choice(marks) for _ in range(80))
        a = rng.randint(0, 50)
        part = text[a : a + 25]
        quote = "".join(fold.get(c, c.upper() if c in "éb" else c) for c in part).replace(" ", "  ")
        rows.append((i, text, quote))
    df = spark.createDataFrame(rows, "i int, text string, quote string")

    def plain(t):
        """As compared: white space as one space, marks alike, small letters of one length."""
        alike = "".join(" " if c.isspace() else fold.get(c, c.lower()) for c in t)
        return re.sub(" +", " ", alike)

    found = Counter()
    for r in df.select("*", T.located_as(F.col("text"), F.col("quote")).alias("x")).collect():
        wanted = re.sub(r"\.+\Z", "", r.quote.strip(" "))
        if r.x is None:
            assert len(wanted) < 12 or plain(wanted).strip(" ") not in plain(r.text)
        else:
            got = r.text[r.x.s : r.x.e]
            want = (wanted, plain(wanted).strip(" "))[r.x.kind == "normalised"]
            assert (got if r.x.kind == "exact" else plain(got)) == want, (got, wanted)
            found[r.x.kind] += 1
    assert found["normalised"] > 100
    # a capital whose small letter is longer leaves all places right
    r = one(spark, T.located_as(F.lit("İİ  the  quick Brown fox"), F.lit("THE quick brown")).alias("x")).x
    assert (r.s, r.e, r.kind) == (4, 20, "normalised")


LIST = "17. Without prejudice to the rest, the office shall:\n(a) keep no anonymous file;\n(b) follow the joint procedure for all the holders, while opening a joint file;\n(c) verify the digital mark on the document."


def test_citations_move_from_a_lead_in_to_its_item(spark):
    rows = [(1, "follow the joint procedure for joint holders", "17. Without prejudice to the rest"), (2, "follow the joint procedure for joint holders", "(C)  Verify the digital mark"), (3, "maintain a register of visitors", "17. Without prejudice to"), (4, "keep", "nowhere in the text at all"), (5, "follow the joint procedure for joint holders", "17. WITHOUT prejudice to the rest")]
    items = spark.createDataFrame([(1, LIST, *r) for r in rows], "doc int, text string, item int, action string, quote string")
    got = {r.item: r for r in records.cited(items, "doc", "item", "text", "quote", "action").collect()}
    cut = lambda r: LIST[r.s : r.e]
    assert cut(got[1]).startswith("(b) follow") and cut(got[1]).endswith(";") and got[1].lead_in.endswith("the office shall:") and got[1].kind == "exact"
    assert cut(got[2]).startswith("(c) verify") and got[2].lead_in is None and got[2].kind == "normalised"
    assert cut(got[3]).endswith("the office shall:") and got[3].lead_in is None
    assert (got[4].outcome, got[4].s) == ("rejected", None) and got[5].outcome == "duplicate" and got[5].s == got[1].s


# work on a delta


def test_incremental_equals_full(spark, tmp_path):
    old = [(d, f"c{i}", i, f"clause {d} {i} shall hold. It may end.") for d in range(3) for i in range(6)]
    new = [(d, r, p, t.replace("hold", "stand") if (d, p) in {(0, 1), (2, 5)} else t) for d, r, p, t in old if (d, p) != (1, 2)] + [(1, "c9", 9, "a new clause shall come.")]
    frame = lambda rows: spark.createDataFrame(rows, "doc int, ref string, pos int, text string")
    seen = []

    def extract(rows):
        each = rows.select("doc", "ref", F.posexplode(F.split("text", r"\. ?")).alias("nth", "sentence")).where("sentence <> ''")
        seen.append(rows.count())
        return each

    map_to = lambda rows: rows.withColumn("control", F.length("sentence") % 5)
    before = map_to(extract(frame(old)))
    changes = change.same_place(frame(old), frame(new), F.col("text"))
    out = rework.re_mapped(before, changes, frame(new), extract, map_to)
    full = map_to(extract(frame(new)))
    key = lambda df: sorted(map(tuple, df.select("doc", "ref", "nth", "sentence", "control").collect()))
    assert key(out) == key(full)
    assert seen == [18, 3, 18] and out.where("fresh").count() == 5
    # the same through the store: closed and appended in one event
    store = versioned.VersionStore(spark, f"file://{tmp_path}/store", "id string, doc int, ref string, nth int, sentence string, control int")
    day = lambda n: F.lit(dt.datetime(2026, 1, n))
    named = lambda df, v: df.withColumn("id", F.sha2(F.concat_ws("|", F.lit(v), "doc", "ref", "nth", "sentence"), 256)).withColumn("control", F.col("control").cast("int"))
    store.commit("first", day(1), named(before, 1).withColumn("effective_from", day(1)))
    direct = changes.where("old_ref IS NOT NULL").select("doc", F.col("old_ref").alias("ref"))
    rework.committed(store, "second", day(2), named(out, 2), changes, direct)
    assert key(versioned.current(store.view())) == key(full)
    with pytest.raises(ValueError):
        rework.committed(store, "second", day(3), named(out, 2), changes, direct)


def test_versions_in_one_row_equal_full(spark):
    """Standing, edited, new and repealed clauses, each through the steps once."""
    texts = [("a. b", "a. b"), ("a. b", "a. c"), (None, "d"), ("e", None), ("", "f"), (None, None)]
    both = spark.createDataFrame([(1, f"c{i}", *t) for i, t in enumerate(texts)], "doc int, ref string, old_text string, new_text string")
    seen = []

    def extract(rows):
        seen.append(sorted(r.ref for r in rows.collect()))
        return rows.select("doc", "ref", F.posexplode(F.split("text", r"\. ?")).alias("nth", "sentence"))

    map_to = lambda rows: rows.withColumn("control", F.upper("sentence"))
    got = sorted(tuple(r) for r in rework.re_mapped_beside(both, extract, map_to).drop("doc").collect())
    assert got == [("c0", 0, "a", "A", False), ("c0", 1, "b", "B", False), ("c1", 0, "a", "A", True), ("c1", 1, "c", "C", True), ("c2", 0, "d", "D", True), ("c4", 0, "f", "F", True)]
    assert seen == [["c0"], ["c1", "c2", "c4"]]


def test_incremental_remap_shuffles_nothing_and_equals_its_sql(spark, tmp_path):
    import duckdb

    text = "The the cat sat on the mat in in Rome today. Each dog sleeps; no bird of of paradise sings here\n\nİ said: the owner keeps a register of visitors; the owner keeps a register of visitors"
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    docs = [(1, text), (2, None), (3, ""), (None, text), (4, "nothing that anybody shares with it, 1234 5678. " + many), (5, "cat dog cat dog cat dog cat dog. " + "é" * 30)]
    items = [(9, "a cat and a dog"), (3, "a dog and a cat"), (7, "register of visitors, owner"), (5, None), (11, many)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = delta.incremental_remap(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["doc", "ref", "nth", "sentence", "control_id", "shared", "fresh"]
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({delta.SQL['incremental_remap']})").fetchall()))
    got = found.select(columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.control_id for r in got if r.doc == 1} == {3, 7} and {r.shared for r in got if r.doc == 4} == {0, 600}


def test_controls_in_tasks_or_joined_give_the_same(spark):
    rows = spark.createDataFrame([(1, "L0", 0, "alpha beta, Beta gamma"), (1, "L0", 1, "1 2 3"), (2, "L1", 0, "beta"), (2, "L2", 0, "delta")], "doc bigint, ref string, nth int, sentence string")
    controls = spark.createDataFrame([("y", "alpha"), ("y", "beta"), ("x", "beta"), ("x", "gamma"), ("z", "delta")], "item_id string, word string")
    for of in (controls, controls.where("false")):
        here, joined = delta.mapped_to(of)(rows), delta.mapped_to(of, most=of.count() - 1)(rows)
        assert here.dtypes == joined.dtypes
        got = sorted(map(repr, here.collect()))
        assert got == sorted(map(repr, joined.collect()))
    assert sorted(repr(r.control_id) for r in delta.mapped_to(controls)(rows).collect()) == ["'x'", "'x'", "'z'", "None"]


def test_units_of_changed_clauses(spark):
    units = spark.createDataFrame([(1, 0, "a" * 10), (1, 10, "b" * 10), (1, 20, "c" * 10), (2, 0, "d" * 10)], "doc int, start int, text string")
    clauses = spark.createDataFrame([(1, "x", 0, 30, 1), (1, "x(1)", 12, 18, 2), (2, "y", 0, 10, 1)], "doc int, ref string, s bigint, e bigint, depth int")
    changed = spark.createDataFrame([(1, "x(1)"), (1, "x(1)")], "doc int, ref string")
    letters = lambda rows: rows.select("doc", F.explode(F.sequence(F.col("start").cast("bigint"), F.col("start").cast("bigint") + F.length("text") - 1)).alias("at"))
    got = rework.re_extracted(units, clauses, changed, letters).collect()
    assert sorted((r.doc, r.at, r.ref) for r in got) == [(1, i, "x(1)") for i in range(12, 18)]


def test_a_version_closed_twice_is_one_row(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    store = versioned.VersionStore(spark, f"file://{tmp_path}/store", "id string, key string")
    closing = lambda n: spark.createDataFrame([("a1", day(n)), ("a1", day(n + 1))], "id string, effective_to timestamp")
    store.commit("e1", F.lit(day(1)), spark.createDataFrame([("a1", "a", day(1))], "id string, key string, effective_from timestamp"))
    store.commit("e2", F.lit(day(5)), closures=closing(5))
    seen = store.simulated("e3", F.lit(day(8)), closures=closing(8))
    store.commit("e3", F.lit(day(8)), closures=closing(8))
    for view in (seen, store.view()):
        assert [(r.id, r.effective_to, r.superseded_at) for r in view.collect()] == [("a1", day(5), day(5))]


def test_many_edits_in_one_pass(spark):
    rng = random.Random(1)
    words = [f"w{i}x" for i in range(3000)]
    docs = [(i, " ".join(words[30 * i : 30 * i + 30])) for i in range(100)]
    chosen = rng.sample(range(3000), 900)
    new = {words[w]: rng.choice(["", "two words", "é"]) for w in chosen}
    edits = spark.createDataFrame([(f"{i:04d}", w, n, False) for i, (w, n) in enumerate(new.items())], "edit_id string, find string, replacement string, every boolean")
    changed = mutate.mutated(spark.createDataFrame(docs, "doc_id int, text string"), edits)
    assert len(changed._jdf.queryExecution().optimizedPlan().toString()) < 3_000_000 and changed._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {r.doc_id: r for r in changed.collect()}
    for i, text in docs:
        want = " ".join(" ".join(new.get(w, w) for w in text.split()).split())
        assert got[i].text == want
        for x in got[i].locations:
            w = list(new)[int(x.edit_id)]
            assert want[x.start : x.start + x.length] == new[w]
    with pytest.raises(ValueError):
        mutate.checked(spark.createDataFrame(docs, "doc_id int, text string"), edits, most=10)


def test_edits_that_touch(spark):
    edits = spark.createDataFrame([("a", "big cat", "dog", True), ("b", "cat", "", True), ("c", "big", "small", True), ("d", "aa", "b", True)], "edit_id string, find string, replacement string, every boolean")
    docs = spark.createDataFrame([(1, "cat big cat cat. cat"), (2, "aaa"), (3, ""), (4, None)], "doc_id int, text string")
    assert {r.edit_id: r.total for r in mutate.checked(docs, edits).collect()} == {"a": 1, "b": 4, "c": 1, "d": 2}
    assert {r.doc_id: r.text for r in mutate.mutated(docs, edits).collect()} == {1: "dog .", 2: "ba", 3: "", 4: None}


# brackets, places, draws, JSON


def test_brackets_by_stack(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("[[]]ab]é") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(500, None), (501, "[" * 50 + "]" * 60)]
    want = set()
    for i, text in rows:
        stack = []
        for at, c in enumerate(text or ""):
            if c == "[":
                stack.append(at)
            elif c == "]" and stack:
                want.add((i, len(stack), stack.pop(), at + 1))
    got = spans.bracket_ranges(spark.createDataFrame(rows, "doc int, text string"), "doc", "text")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_clauses_inside_a_marked_bracket(spark):
    clauses = spark.createDataFrame([(1, "1", 0, 90), (1, "2", 100, 150), (1, "3", 160, 200), (1, "4", 600, 700), (1, "5", 720, 800)], "doc int, ref string, s bigint, e bigint")
    ranges = spark.createDataFrame([(1, 1, 95, 205), (1, 1, 550, 710)], "doc int, level int, s bigint, e bigint")
    claimed = lambda ref: sorted(r.ref for r in spans.claimed(ranges, clauses, spark.createDataFrame([(1, ref)], "doc int, ref string"), "doc").collect())
    assert claimed("2") == ["2", "3"] and claimed("5") == ["4"] and claimed("1") == []


def test_places_in_an_order(spark):
    a = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "x int, t int").repartition(7)
    assert [(r.place, r.x) for r in sequence.placed(a, ["x"]).orderBy("place").collect()] == [(i + 1, i) for i in range(101)]
    assert sequence.placed(a.where("false"), ["x"]).count() == 0
    b = spark.createDataFrame([(i,) for i in range(5)], "y int")
    both = sequence.side_by_side(a.select("x"), b, ["x"], [F.desc("y")]).orderBy("place").collect()
    assert [r.y for r in both[:6]] == [4, 3, 2, 1, 0, None] and len(both) == 101


def drawn_expected(rows, themes, each, seed):
    key = lambda t, i: hashlib.sha256(f"{seed}:{t}:{i}".encode()).hexdigest()
    own = {}
    for t, i in sorted({(t, i) for t, i, ok in rows if ok and t in themes}, key=lambda x: (themes.index(x[0]), key(*x))):
        own.setdefault(i, t)
    order = {t: sorted((i for i, o in own.items() if o == t), key=lambda i: (key(t, i), i)) for t in themes}
    taken = {(t, i): t for t in themes for i in order[t][:each]}
    for k, name in enumerate(themes):
        have = sum(v == name for v in taken.values())
        for t in [*themes[k + 1 :], *themes[:k]]:
            for i in order[t]:
                if have < each and (t, i) not in taken:
                    taken[t, i] = name
                    have += 1
    return sorted((t, i, d) for (t, i), d in taken.items())


@pytest.mark.parametrize("each", [1, 4, 30])
def test_draws(spark, each):
    rng = random.Random(each)
    rows = [(rng.choice(["a", "b", "b", "c", "c", "c", "z"]), i % 50, rng.random() < 0.8) for i in range(70)]
    df = spark.createDataFrame(rows, "theme string, item int, ok boolean")
    got = sequence.drawn(df, ["a", "b", "c"], each, "s", F.col("ok"))
    assert sorted((r.theme, r.item, r.drawn_as) for r in got.collect()) == drawn_expected(rows, ["a", "b", "c"], each, "s")


def test_json_paths(spark):
    rows = [('{"judges": [{"gap_type": "x"}], "a\'b": null}',), ("not json",), (None,), ('{"judges": []}',)]
    v = V.variant(F.col("j"))
    got = spark.createDataFrame(rows, "j string").select(V.value_at(v, "judges", 0, "gap_type").alias("g"), V.has_key(v, "judges").alias("h"), V.differs(v, "x", "judges", 0, "gap_type").alias("d")).collect()
    assert [tuple(r) for r in got] == [("x", True, False), (None, False, True), (None, False, True), (None, True, True)]


def test_stages_are_undone(spark):
    rows = spark.createDataFrame([(1, "a", 1.5, None), (2, None, 2.5, None), (3, "c", 3.5, '{"check": "kept", "stage": "s", "was_kind": "old"}')], "id int, kind string, price double, evidence string")
    after = undo.overwritten(rows.where("id < 3"), "s", {"kind": F.lit("new"), "price": F.lit(0.0)}, F.col("id") <= 2).unionByName(rows.where("id = 3"))
    after = undo.added(after, spark.createDataFrame([(4, "d")], "id int, kind string"), "s")
    assert after.count() == 4 and {r.id: (r.kind, r.price) for r in after.collect()}[2] == ("new", 0.0)
    assert sorted(map(repr, undo.restored(after, "other", ["kind", "price"]).collect())) == sorted(map(repr, after.collect()))
    back = {r.id: r for r in undo.restored(after, "s", ["kind", "price"], keep="kept").collect()}
    assert {i: (r.kind, r.price, r.evidence is None) for i, r in back.items()} == {1: ("a", 1.5, True), 2: (None, 2.5, True), 3: ("old", 3.5, False)}


def test_coverage_elsewhere(spark):
    rows = lambda *r: spark.createDataFrame(r, "q_id int, i_id int, rank int")
    semantic = rows((1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 10, 1))
    lexical = rows((1, 11, 1), (1, 14, 2))
    edited = spark.createDataFrame([(1, 10), (1, 14), (2, 10)], "q_id int, i_id int")
    found = retrieve.coverage_candidates(lexical, semantic, edited, 2)
    assert sorted(map(tuple, found.collect())) == [(1, 11, 1, 1, False), (1, 12, None, 2, False), (1, 14, 2, None, True)]
    left = retrieve.unsupported(spark.createDataFrame([(1,), (2,), (2,)], "q_id int"), found)
    assert [(r.q_id, r.n) for r in left.collect()] == [(2, 0)]


def test_doubled_words_end_at_other_letters(spark):
    rows = spark.createDataFrame([("auen in in\u00e4einun",), ("\u00e9in in a",), ("in inner bin in in_",), ("the the of of",)], "text string")
    got = [r.t for r in rows.select(F.regexp_replace("text", delta.DOUBLED, "$1").alias("t")).collect()]
    assert got == ["auen in\u00e4einun", "\u00e9in a", "in inner bin in in_", "the of"]


def test_bracket_places_are_sums_of_lengths_in_windows(spark):
    rows = spark.createDataFrame([(1, "a[\u00e9[b]]c]["), (2, None)], "doc int, text string")
    found = spans.bracket_ranges(rows, "doc", "text")
    # no array grows by a fold over a text's brackets
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc, r.level, r.s, r.e) for r in found.collect()} == {(1, 1, 1, 7), (1, 2, 3, 6)}


def test_no_task_numbers_a_whole_source(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}", "s" if i % 6 else None) for i in range(60)], "doc_id bigint, text string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = text.version(spark, str(tmp_path), 0)
    assert "windowspecdefinition(source" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {("s" if i % 6 else None, i): n for of in (range(0, 60, 6), [i for i in range(0, 60, 2) if i % 6]) for n, i in enumerate(of, 1)}
    assert {(r.doc, int(r.text[5:])): r.pos for r in found.collect()} == want


def test_only_documents_with_a_match_are_cut_again(spark):
    asked = spark.createDataFrame([("o1", "The branch keeps signed records of every visit for ten years.", "must"), ("o2", "Quite unlike wording stands nowhere here today.", "must")], "id string, quote string, modality string")
    policies = spark.createDataFrame([(1, "Each branch keeps signed records of every visit for five years."), (2, "Nothing that matters is written down in this one.")], "doc int, text string")
    found = compare.compare(asked, policies, "doc")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") >= 2
    assert {r.id: (r.kind, r.window) for r in found.collect()} == {"o1": ("number_differs", "Each branch keeps signed records of every visit for five years."), "o2": ("no_similar_text", "")}
