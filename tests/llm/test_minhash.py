"""Links against all pairs, in the shapes that are hard for sketches and leaders."""

import random

import pytest

from gridloom.llm import minhash

from .test_contracts import components


def check(spark, texts, width, percent):
    table = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    out = minhash.near_duplicates(spark.createDataFrame([(d["doc_id"], d["text"]) for d in table], "doc_id long, text string").repartition(5), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == components(table, width, percent)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_edited_copies_near_the_threshold(spark, width, percent):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([12, 40, 150, 600]))
        for _ in range(8):
            share = rng.choice([0, 0.01, 0.02, 0.03, 0.04, 0.05])
            texts.append(" ".join(w if rng.random() >= share else rng.choice(words) for w in base))
    check(spark, texts + [None, "", "a b", "a  B", "common passage " * 3], width, percent)


def test_a_template_whose_copies_differ_just_too_much(spark):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(200)]
    texts = [" ".join(template[: 200 - 9 * k % 40] + [f"own{j}x{i}" for i in range(rng.randint(18, 30))]) for j, k in enumerate(range(150))]
    check(spark, texts, 3, 85)


def test_a_passage_in_every_text_links_nothing(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    check(spark, [f"{shared} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)], 5, 80)


def test_a_chain_of_small_edits_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        words[3 * i] = f"edit{i}"
    check(spark, texts, 3, 85)


def test_null_ids_are_rows_too(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (3, text), (5, text), (None, None), (9, "alone in here now ok")], "doc_id long, text string")
    out = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert [(i, c) for i, _, c, _ in out if i is not None] == [(3, 3), (5, 3), (9, 9)] and len(out) == 5


def test_lists_that_are_read_twice_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lists = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "rep long, value long").mapInArrow(count, "rep long, value long")
    assert {r["rep"] for r in minhash._met(lists).collect()} == {1, 2}
    assert made.value == 3
