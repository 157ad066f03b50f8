from rillworks.llm import hosts, leaks

ITEM = "A train leaves the station at 10 km per hour with Anna on board and later Anna counts 25 passengers in the last wagon"


def covered(words, k=8):
    runs = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    return len({p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + k)})


def test_measures_equal_plain_counts(spark):
    texts = [None, "", "  \t\n", "one two", "a b c d e f g h a b c d e f g h", "x " * 40, "l1 a\nl1 a\n\n\nl2\nl1 a", "# $ a&b <c> | é", "\x0bp\x0cq\x1cr", "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "end"]
    docs = spark.createDataFrame([(i, t, "h", 4) for i, t in enumerate(texts)] + [(None, "no key", None, 4)] * 2, "doc_id long, text string, source string, n_words int")
    got = {r["key"]: r for r in hosts.judged(docs).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), covered(words)), i
    assert hosts.judged(docs).count() == len(texts) + 2 and hosts.judged(docs.limit(0)).count() == 0


def test_bad_hosts_lose_their_good_rows_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "spam") for i in range(300)] + [(1000 + i, good, f"site{i % 5}") for i in range(2000)] + [(5000, bad, "tiny"), (5001, good, "tiny"), (5002, good, None)]
    kept = {r["key"] for r in hosts.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == {*range(1000, 3000), 5001, 5002}


def test_leaks_given_and_reparameterised(spark):
    again = ITEM.replace("10", "35").replace("25", "7").replace("Anna", "Maria").replace("km", "miles")
    mixed = again.replace("later Maria", "later Peter")
    clean = " ".join(f"other{i}" for i in range(200))
    docs = [(1, f"Before it. {ITEM} after it"), (2, f"{clean} {again}, {clean}"), (3, f"{clean} {mixed} {clean}"), (4, clean), (5, None), (6, ""), (7, ITEM.upper()), (8, "10 km 10 km 10 km " * 30), (9, ITEM), (9, ITEM), (None, ITEM), (10, clean * 200)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(70, ITEM), (50, ITEM), (60, None), (None, ITEM), (61, "too short"), (62, "5 kg 5 kg 5 kg 5 kg 5 kg")], "item_id long, text string")
    got = {(r["key"], r["item_id"]): (r["n_changed"] > 0) for r in leaks.leaks(frame, items).collect()}
    assert {k: v for k, v in got.items() if k[0] != 7} == {(1, 50): False, (2, 50): True, (9, 50): False, (None, 50): False}
    kept = sorted(r["doc_id"] for r in leaks.without_leaks(frame, items).collect() if r["doc_id"] != 7)
    assert kept == [3, 4, 5, 6, 8, 10]
    assert leaks.leaks(frame, items.limit(0)).count() == 0 and leaks.leaks(frame.limit(0), items).count() == 0


def test_given_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["key"], r["item_id"]) for r in leaks.leaks(docs, items).collect()}
    plain = {r["item_id"]: r["text"] for r in items.collect()}
    want = {(r["doc_id"], k) for r in docs.collect() for k, t in plain.items() if t in (r["text"] or "")}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


def pairs(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["key"], r["item_id"]) for r in leaks.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks_partly_copied_and_edited(spark):
    around = " ".join(f"other{i}" for i in range(40))
    part, edited = " ".join(ITEM.split()[:16]), ITEM.replace("and later", "and then later")
    other = edited.replace("Anna", "Maria").replace("10", "7")
    mixed = other.replace("later Maria", "later Peter")
    docs = [(1, f"{around}. {part} {around}"), (2, f"{around}. {edited} {around}"), (3, f"{around}. {other} {around}"), (4, f"{around}. {mixed} {around}"), (5, f"{mixed} {around} {other}")]
    assert pairs(spark, docs, [(1, ITEM)]) == {(1, 1), (2, 1), (3, 1), (5, 1)}


def test_leaks_names_that_begin_sentences_and_items_without_template_windows(spark):
    around = " ".join(f"other{i}" for i in range(40))
    tom = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have now?"
    sums = "12 + 30 = 42, 42 + 18 = 60, 60 + 12 = 72"
    items = [(1, tom), (2, "What is the capital of France?"), (3, sums), (4, ITEM), (5, "?!")]
    docs = [(1, f"{around}. {tom.replace('Tom', 'Sarah').replace('5', '9')} {around}"), (2, f"{around} what is the capital of France? {around}"), (3, f"{around}. {sums}"),
            (4, f"{around} {' '.join(ITEM.split()[:16])} {around}"), (5, f"{around} What is the capital of Spain? {around}"), (6, f"{around}. {sums.replace('18', '19')[8:]}"), (7, f'{around}: "{tom}" {around}'),
            (8, f"{around}. {tom.replace('Tom buys', 'Eva buys').replace('Tom has', 'Sarah has')} {around}")]
    assert pairs(spark, docs, items) == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 1)}


def test_leaks_behind_free_standing_signs(spark):
    from pyspark.sql import functions as F

    texts = ["Rates rose by 5 % again. " + ITEM, "It cost 5 $ then - 7 %, and 3 €. " + ITEM, "- 5 % of % and 8 $ (net) …", ""]
    made = leaks.templates(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert made.filter((F.size("tokens") != F.size("words")) | (F.size("tokens") != F.size("named"))).count() == 0
    assert pairs(spark, list(enumerate(texts)), [(1, ITEM)]) == {(0, 1), (1, 1)}


def test_leaks_with_glued_units_and_number_words(spark):
    around = " ".join(f"other{i}" for i in range(40))
    glued = "Along the long river they walked 5km before lunch and then another 12 km until the evening came"
    spelled = "The old baker waits thirty minutes for the dough and then twenty-five minutes for the bread to cool"
    items = [(1, glued), (2, spelled)]
    docs = [(1, f"{around}. {glued.replace('5km', '9 km').replace('12 km', '7km')} {around}"), (2, f"{around}. {spelled.replace('thirty', '45').replace('twenty-five', 'ten')} {around}"),
            (3, f"{around}. {spelled.replace('thirty minutes', '3h').replace('twenty-five minutes', 'ninety-one h')} {around}"), (4, f"{around} 5km 12 km thirty minutes {around}"), (5, "5km"), (6, "5% of 7km, 3$ (4kg)")]
    assert pairs(spark, docs, items) == {(1, 1), (2, 2), (3, 2)}


def test_window_hashes_are_those_of_templates(spark):
    from pyspark.sql import functions as F

    texts = ["Rates rose by 5 % again. " + ITEM, "one", "", None, "Tom has 5km. Tom's \t twenty-five\x0bdogs - % ΟΔΟΣ", "a b c d e f g", "a b c d e f g h", ITEM * 300]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for length in (1, 3, 8):
        made = leaks._runs(leaks._runs(leaks._hashed_templates(frame, "t"), "tokens", length), "named", length)
        want = leaks.templates(frame, "t").withColumn("tokens_1", leaks._word_hashes("tokens")).withColumn("named_1", leaks._word_hashes("named"))
        want = leaks._runs(leaks._runs(want, "tokens", length), "named", length)
        for row, other in zip(made.orderBy("t").collect(), want.orderBy("t").collect()):
            tokens, named = other[f"tokens_{length}"], other[f"named_{length}"]
            assert row[f"tokens_{length}"] == tokens and len(tokens) == max(0, len(other["tokens"]) - length + 1)
            assert row[f"named_{length}"] in (named, []) and {*row[f"tokens_{length}"], *row[f"named_{length}"]} == {*tokens, *named}
    assert leaks._hashed_templates(frame, "t").filter(F.col("tokens_1").isNull()).count() == 0


def test_leaks_of_rows_that_share_a_key(spark):
    words, around = ITEM.split(), " ".join(f"other{i}" for i in range(40))
    halves = [f"{around}. {' '.join(words[:12])}", f"{around}. {' '.join(words[12:])}"]
    docs = [(k, t) for k in (None, 7) for t in (f"{around}. {ITEM}", f"{around} clean", *halves)] + [(8, halves[0]), (8, halves[1])]
    assert pairs(spark, docs, [(1, ITEM)]) == {(None, 1), (7, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = leaks.without_leaks(frame, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(k), t) for k, t in docs if ITEM not in t)
