"""Fingerprints against plain Python, and rows of any ids."""

import math
import re

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import imatch

M = 0xFFFFFFFF
rot = lambda x, r: ((x << r) | (x >> (32 - r))) & M


def murmur(values):
    """The 32-bit hash of an array of longs, chained, from seed 42."""
    h = 42
    for v in values:
        for k in (v & M, (v >> 32) & M):
            k = rot((k * 0xCC9E2D51) & M, 15) * 0x1B873593 & M
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & M
        h ^= 8
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ (h >> shift)) * factor) & M
        h ^= h >> 16
    return h


def terms_of(text):
    words = {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.A) if w}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted({signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words})


def band_of(texts):
    df = {}
    for t in texts:
        for x in terms_of(t):
            df[x] = df.get(x, 0) + 1
    return {x for x, n in df.items() if imatch.MIN_IDF <= math.log(len(texts) / n) <= imatch.MAX_IDF}


def print_of(text, band):
    every = terms_of(text)
    own = [t for t in every if t in band] or every
    sets = [[t for t in own if (t >> (2 * j)) & 3 == 0] for j in range(16)]
    for rate in (16, 64, 256, 1024):
        kept = [t for t in own if (t >> 36) & (rate // 16 - 1) == 0]
        sets += [[t for t in kept if (t >> 34) & 3 == i and (t >> 32) & 3 == j] for i in range(4) for j in range(4)]
    return [murmur(s) if s else 0 for s in sets]


def likeness_of(a, b):
    if a == b:
        return 1.0
    scales = [list(zip(a[i : i + 16], b[i : i + 16], strict=True)) for i in range(0, 80, 16)]
    return max(sum(x == y != 0 for x, y in s) / max(sum(x != 0 or y != 0 for x, y in s), 4) for s in scales)


def brute(rows):
    """rows of (id, text) in their order -> (n_chars, edited, fingerprint, edited fingerprint, near_edited, near_next)."""
    band = band_of([t for _, t in rows])
    text = lambda p: ",".join(f"{x:x}" if x else "" for x in p)
    out = []
    for k, (_, a) in enumerate(rows):
        b = rows[(k + 1) % len(rows)][1]
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        p, e, n = (print_of(x, band) for x in (a, edited, b))
        out.append((len(a), edited, text(p), text(e), likeness_of(p, e), likeness_of(p, n)))
    return out


COLUMNS = ("n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_all_columns_are_those_of_plain_python(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = sorted(((d["doc_id"], d["text"] or "") for d in table), key=lambda r: r[0])
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r["doc_id"]: r for r in imatch.next_likeness(df, task_bytes=50_000).collect()}
    for (i, _), want in zip(rows, brute(rows), strict=True):
        got = tuple(out[i][c] for c in COLUMNS)
        assert got[:4] == want[:4] and all(abs(x - y) < 1e-12 for x, y in zip(got[4:], want[4:], strict=True))
    assert {i: out[i]["next_id"] for i, _ in rows} == {a: b for (a, _), (b, _) in zip(rows, [*rows[1:], rows[0]], strict=True)}


def test_rare_and_frequent_terms_are_outside_the_band(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id as doc_id", "concat('every ', case when id % 50 = 0 then 'some ' else '' end, 'only', id) as text")
    terms = imatch.lexicon(df)
    assert [r["term"] for r in terms.collect()] == terms_of("some")
    assert imatch.fingerprint(F.col("text"), "text", "p", imatch.shelves(terms))(df.limit(1)).count() == 1


def test_shelves_hold_every_term_and_no_other(spark):
    for n in (0, 1, 5, 1000, 20_000):
        texts = [f"w{k} x{k}" for k in range(n)]
        terms = sorted(t for text in texts for t in terms_of(text))
        own = spark.createDataFrame([(t,) for t in terms], "term long")
        shelves, bits = imatch.shelves(own)
        held = spark.range(1).select(shelves.alias("s")).first()["s"]
        assert len(held) == 1 << bits and sorted(t for shelf in held for t in shelf) == terms
        assert all((t & (1 << 64) - 1) >> (64 - bits) == k for k, shelf in enumerate(held) for t in shelf)
        asked = [(f"{text} stranger{k}",) for k, text in enumerate(texts[:: max(1, n // 500)])]
        if asked:
            df = spark.createDataFrame(asked, "text string")
            got = imatch.with_terms(df, F.col("text"), "text", "terms", shelves, bits).collect()
            assert sorted(t for r in got for t in r["terms"]) == sorted(t for (x,) in asked for t in terms_of(" ".join(x.split()[:2])))


def test_the_plan_shows_no_term_and_no_row_carries_the_shelves(spark):
    texts = [f"every word{i % 3} of text{i % 20}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    execution = imatch.next_likeness(df)._jdf.queryExecution()
    plan = execution.toString()
    assert band_of(texts) and not [t for t in band_of(texts) if str(t) in plan]
    assert "scalar-subquery" in execution.optimizedPlan().toString() and "AS _shelves" not in execution.optimizedPlan().toString()


def test_ids_of_any_type_far_apart_null_and_repeated(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    for kind, ids in (("string", [None, "a", "b", "b", "z"]), ("long", [None, -(2**63), 0, 0, 2**63 - 1])):
        df = spark.createDataFrame([(i, f"{base} w{k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
        out = imatch.next_likeness(df, task_bytes=64).collect()
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(map(str, ids))
        following = sorted((str(r["doc_id"]), str(r["next_id"])) for r in out)
        names = list(map(str, ids))
        assert following == sorted(zip(names, [*names[1:], names[0]], strict=True))


def test_equal_rows_follow_one_another_and_a_single_row_follows_itself(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text)] * 3 + [(2, "other words " * 20)], "doc_id long, text string")
    out = imatch.next_likeness(df).collect()
    assert sorted((r["doc_id"], r["next_id"], r["near_next"] == 1) for r in out) == [(1, 1, True), (1, 1, True), (1, 2, False), (2, 1, False)]
    one = imatch.next_likeness(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited"] == text[: len(text) - len(text) // 4] + text[: len(text) // 4]


def test_null_and_empty_texts_have_no_terms(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "abc")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in imatch.next_likeness(df).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] == out[3]["fingerprint"] == "," * 79
    assert out[1]["near_next"] == out[2]["near_next"] == 1 and (out[4]["n_chars"], out[4]["edited"]) == (3, "abc")
