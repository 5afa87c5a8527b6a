"""Every operator on nulls, empty and long texts, repeated rows, clashing column names, and an empty table."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import flac, imatch, language, licenses, minhash, packing, pieces, pii, queries, secrets, token_count

WORD, BYTES, PIECES = (queries.tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "language": lambda d: language.identify(d, language.fit_dictionaries(d)),
    "pii": pii.pii_spans,
    "licenses": licenses.license_scan,
    "minhash": minhash.near_duplicates,
    "flac": lambda d: flac.decode_flac(flac.encode_flac(queries.padded_payloads(d))),
    "tokens": lambda d: token_count.token_counts(d, tokenizer=BYTES),
    "imatch": imatch.next_likeness,
    "secrets": lambda d: secrets.scan_secrets(d, owner=F.col("source")),
    "pieces": lambda d: pieces.encode_pieces(d, model=PIECES),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(name, docs, none):
    run = OPERATORS[name]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(run(docs)) == ids(docs)
    assert run(none).count() == 0


ROWWISE = ["language", "pii", "licenses", "flac", "tokens", "secrets", "pieces", "minhash"]


@pytest.mark.parametrize("name", ROWWISE)
def test_values_don_t_depend_on_other_columns_or_on_repeated_rows(name, docs):
    run = OPERATORS[name]
    text = lambda rows: sorted(str(r.asDict(True)) for r in rows)
    plain = run(docs.select("doc_id", "text", "lang", "source")).collect()
    assert text(run(docs).collect()) == text(plain)
    twice = docs.unionByName(docs)
    if name == "language":  # fitted on the same rows
        known = language.fit_dictionaries(docs)
        run = lambda d: language.identify(d, known)
    assert text(run(twice).collect()) == sorted(2 * text(plain))


@pytest.mark.parametrize("name", ["language", "pii", "licenses", "tokens", "pieces", "flac", "minhash"])
def test_null_and_empty_texts_give_the_same(name, docs):
    out = {r["doc_id"]: r.asDict(True) for r in OPERATORS[name](docs.filter("doc_id in (1, 2, 12, 14)")).collect()}
    strip = lambda r: {k: v for k, v in r.items() if k not in ("doc_id", "component_id")}
    assert strip(out[1]) == strip(out[2]) and any(strip(out[i]) != strip(out[1]) for i in (12, 14))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_text_of_five_megabytes(name, spark):
    long = " ".join(f"word{i % 9973} and another{i % 7}" for i in range(220_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, "short text of some words here", "en", "b"), (3, long, "en", "c")], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r.asDict(True) for r in OPERATORS[name](df).collect()}
    assert set(out) == {1, 2, 3}
    if name not in ("imatch", "minhash"):
        assert {k: v for k, v in out[1].items() if k != "doc_id"} == {k: v for k, v in out[3].items() if k != "doc_id"}
    if name == "minhash":
        assert out[3]["component_id"] == 1


def test_packing_holds_every_row_and_no_row(docs, none):
    out = packing.pack_documents(docs, tokenizer=WORD)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert packing.pack_documents(none, tokenizer=WORD).count() == 0


def test_repeated_rows_repeat_their_result(docs):
    twice = docs.unionByName(docs)
    out = minhash.near_duplicates(twice).collect()
    assert len(out) == 34 and len({(r["doc_id"], r["component_id"]) for r in out}) == 17


def test_long_and_short_copies_are_linked_and_texts_without_words_are_not(docs):
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert out[7] == 6 and out[5] == 4 and out[9] == 8 and out[10] == 8
    assert [out[i] for i in (1, 2, 3)] == [1, 2, 3]


def test_small_sets_in_crowded_lists_keep_their_links(spark):
    base = "one two three four five six seven eight"
    rows = [(0, base)] + [(i, f"{base} tail{i}") for i in range(1, 400)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0}


def test_a_shared_secret_is_not_live(docs):
    out = {r["doc_id"]: r for r in secrets.scan_secrets(docs, owner=F.col("source")).collect()}
    assert out[16]["n_live"] == 0 and out[16]["n_shared"] == 2 and out[13]["n_shared"] == 2
