"""The pipeline against plain Python, stage by stage, and null and repeated ids."""

import collections
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import language, queries, secrets

from .test_contracts import components
from .test_language import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    at = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_language_keeps_what_the_classifier_knows(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = language.fit_dictionaries(docs)
    before, after = rows(docs), rows(stages["language"])
    assert after == {i: d for i, d in before.items() if not plain(d["text"] or "", known)[1]}


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = rows(stages["language"]), rows(stages["near_duplicates"])
    kept = components(list(before.values()), 5, 80)
    assert after == {i: d for i, d in before.items() if kept[i][2]}


def test_live_secrets_are_blanked_and_nothing_else_changes(spark, stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["secrets"])
    scanned = {r["doc_id"]: r["live"] for r in secrets.scan_secrets(stages["near_duplicates"], owner=F.col("source")).collect()}
    assert set(after) == set(before)
    for i, d in before.items():
        text, at, parts = d["text"], 0, []
        for s in scanned[i]:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        if scanned[i]:
            text = "".join(parts) + text[at:]
        assert after[i] == d | {"text": text, "n_chars": len(text) if scanned[i] else d["n_chars"]}


def test_every_id_is_packed_once(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, d in rows(stages["secrets"]).items()}
    held = collections.defaultdict(list)
    for r in stages["packing"].collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        held[r["doc_id"]].append((r["start"], r["length"]))
    assert {i: sum(n for _, n in s) for i, s in held.items()} == {i: len(x) for i, x in ids.items()}


def test_run_gives_the_last_stage_and_cleans_up(spark, stages):
    folder = spark.conf.get("spark.checkpoint.dir")
    out = corpus_pipeline.run(spark, SF)
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert tokens(out) == tokens(stages["packing"])
    import os

    own = [d for d in os.listdir(folder) if d.startswith("pipeline-")]
    assert own and all(os.listdir(f"{folder}/{d}") == ["packing"] for d in own)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    table = [(None, a, "en", "s", 1), (1, a + " more", "en", "s", 1), (2, b, "en", "s", 1), (2, c, "en", "s", 1), (2, c, "en", None, 1), (None, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"live": F.lit(1), "place": F.lit("x"), "row": F.lit(2)})
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted([("None", a), ("2", b), ("2", c), ("None", "None"), ("None", "")])
    known = corpus_pipeline.known_language(spark, docs, SF)
    assert known.columns == docs.columns and sorted(str(r["text"]) for r in known.collect()) == sorted([a, a + " more", b, c, c])
    leak = docs.withColumn("text", F.when(F.col("text") == b, "token=Zk3fQ9xLm27PaRt8").otherwise(F.col("text")))
    blank = corpus_pipeline.secret_scan(spark, leak, SF)
    assert blank.columns == docs.columns and sorted((str(r["text"]), str(r["n_chars"])) for r in blank.collect()) == sorted([(a, "1"), (a + " more", "1"), ("[SECRET]", "8"), (c, "1"), (c, "1"), ("None", "None"), ("", "0")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
