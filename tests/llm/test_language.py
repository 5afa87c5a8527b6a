"""The compression classifier against plain Python, and few or many labels."""

import zstandard
from pyspark.sql import functions as F

from gridloom.llm import language


def plain(text, dictionaries, min_margin=0.002):
    data = language.letters_only(text)
    sizes = {}
    for name, (rows, content) in dictionaries.items():
        held = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = sum(len(coder.compress(data[i : i + language.WINDOW])) for i in range(0, len(data), language.WINDOW))
    if not sizes or not any(map(str.isalpha, text)):
        return "und", True
    (best, name), *rest = sorted((s, (-dictionaries[k][0], k)) for k, s in sizes.items())
    return name[1], bool(rest) and (rest[0][0] - best) / rest[0][0] < min_margin


def test_predictions_are_those_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = language.fit_dictionaries(docs)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in language.identify(docs, known).collect():
        assert (r["lang_pred"], r["rejected"]) == plain(text[r["doc_id"]], known)


def test_no_label_one_label_and_more_than_are_learned(spark):
    df = spark.createDataFrame([(1, "some words here", None), (2, None, "en"), (3, "12 34", "en")], "doc_id long, text string, lang string")
    none = language.fit_dictionaries(df.withColumn("lang", F.lit(None).cast("string")))
    assert none == {} and {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}
    one = language.fit_dictionaries(df)
    assert {r["doc_id"]: (r["lang_pred"], r["margin"], r["rejected"]) for r in language.identify(df, one).collect()} == {1: ("en", 1.0, False), 2: ("und", 0.0, True), 3: ("und", 0.0, True)}
    many = spark.range(900).selectExpr("id as doc_id", "concat('text of language number ', id % 300) as text", "concat('l', id % 300) as lang")
    assert len(language.fit_dictionaries(many)) == 256 and sorted(language.fit_dictionaries(many, most_labels=2)) == ["l0", "l1"]


def test_a_hot_id_gives_one_sample_and_ids_may_be_null(spark):
    rows = [(None, "the quick brown fox", "en")] * 300 + [(7, f"der schnelle braune fuchs {i}", "de") for i in range(300)] + [(i, f"more words {i}", "en") for i in range(100, 140)]
    known = language.fit_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert known["de"] == (300, language.letters_only("der schnelle braune fuchs 0")) and known["en"][0] == 340 and known["en"][1].count(b"quick") == 1


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(None, "some words", "en", 1), (1, "some words", "en", 2), (1, "some words", "en", 2)], "doc_id long, text string, lang string, margin int")
    out = language.identify(df, language.fit_dictionaries(df), keep="row").select("row.*").collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert language.identify(df.filter("false"), {}, keep="row").count() == 0
