"""Keys of any type, and columns named like those that operators use inside."""

import pytest
from pyspark.sql import functions as F

from rillworks.llm import leaks, near_copies, packing, repeats

KEYS = {"long": int, "int": int, "string": lambda k: f"k{k:03}", "date": None}
WORDS = [f"w{i}" for i in range(400)]
COPY = " ".join(WORDS[:120])


def keyed(spark, kind, rows, columns="text string"):
    df = spark.createDataFrame([(k, *r) for k, *r in rows], f"k long, {columns}")
    made = {"long": F.col("k"), "int": F.col("k").cast("int"), "string": F.concat(F.lit("k"), F.lpad(F.col("k").cast("string"), 3, "0")), "date": F.date_add(F.lit("2024-01-01"), F.col("k").cast("int"))}
    return df.withColumn("doc_id", made[kind]).select("doc_id", *[c for c in df.columns if c != "k"], "k")


@pytest.mark.parametrize("kind", KEYS)
def test_near_copies_of_any_key_type(spark, kind):
    rows = [(3, COPY), (1, COPY), (2, COPY + " "), (7, " ".join(WORDS[200:300])), (None, COPY), (8, COPY.replace("w5 ", "w5 "))]
    got = {(r["doc_id"], r["component"]) for r in near_copies.classes(keyed(spark, kind, rows).drop("k").union(keyed(spark, kind, [(9, "x y")]).drop("k"))).select(F.col("key").alias("doc_id"), "component").collect()}
    names = {r["k"]: r["doc_id"] for r in keyed(spark, kind, [(i, "") for i in range(10)]).collect()}
    assert {c for _, c in got if c in (names[1], names[7], names[9])} == {names[1], names[7], names[9]} and (names[3], names[1]) in got and (None, names[1]) in got


def test_links_of_near_but_unequal_fingerprints(spark):
    for kind in ("int", "string"):
        fps = keyed(spark, kind, [(5, 0b1011), (4, 0b0011), (6, 1 << 40), (9, 0b1111)], "fp long").select(F.col("doc_id").alias("rep"), "fp")
        found = {tuple(r) for r in near_copies.links(fps).collect()}
        name = (lambda k: k) if kind == "int" else (lambda k: f"k{k:03}")
        assert {(name(5), name(4)), (name(9), name(4))} <= found and all(u > v for u, v in found)


@pytest.mark.parametrize("kind", KEYS)
def test_repeats_of_any_key_type(spark, kind):
    rows = [(5, "before " + COPY + " after"), (2, COPY), (9, "other"), (None, COPY), (2, COPY), (30, COPY)]
    got = repeats.without_repeats(keyed(spark, kind, rows))
    assert got.columns == ["doc_id", "text", "k", "n_words", "n_removed", "removed"] and got.schema["doc_id"] == keyed(spark, kind, rows).schema["doc_id"]
    assert sorted((r["k"] or 0, r["n_removed"], len(r["text"])) for r in got.collect()) == sorted([(5, 120, 12), (2, 0, len(COPY)), (2, 0, len(COPY)), (9, 0, 5), (0, 0, len(COPY)), (30, 120, 0)])


def test_clashing_names(spark):
    odd = ["_grp", "_row", "_full", "_id", "_a", "_b", "_number", "component", "number"]
    docs = spark.createDataFrame([(i, COPY, *[f"{c}{i}" for c in odd]) for i in range(3)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in odd))
    got = repeats.without_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "removed"] and {(r["_grp"], r["_number"]) for r in got.collect()} == {(f"_grp{i}", f"_number{i}") for i in range(3)}
    items = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string")
    clean = docs.withColumn("text", F.when(F.col("doc_id") == 1, "nothing of it").otherwise(F.col("text")))
    left = leaks.without_leaks(clean, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.drop("text").collect()] == [(1, *[f"{c}1" for c in odd])]
    rows = near_copies.grouped(docs)
    assert sorted(rows.columns) == sorted([*[c for c in docs.columns if c not in ("component", "number")], "number", "component"])
    assert rows.select("component").distinct().count() == 1 and {r["_grp"] for r in rows.collect()} == {"_grp0", "_grp1", "_grp2"}
    parts = docs.withColumn("length", F.lit(700)).drop("text")
    placed = packing.placed(parts)
    assert placed.columns == [*parts.columns, "sequence_id", "offset"] and sorted(r["_full"] for r in placed.collect()) == ["_full0", "_full1", "_full2"]
    assert placed.select("sequence_id").distinct().count() == 2
