"""Packing against the whole corpus: what it counts, and that rows of different splits meet."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import packing, queries
from gridloom.llm.common import id_and_text

WORD = queries.tokenizer_path("word_bpe_49k.json")
WORDS = "apple river stone cloud green table chair window garden music paper silver winter summer orange bridge castle forest island desert ocean mountain valley bread butter cheese coffee dinner engine farmer finger flower guitar hammer horse house jacket kitchen ladder lemon market mirror monkey needle number office parent pencil person planet pocket potato prince queen rabbit rocket school shadow sister spider spring street sugar".split()


def test_statistics_are_those_of_all_rows(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    ids = [[*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()]
    want = collections.Counter(t for d in ids for t in set(d))
    corpus = packing.corpus_of(packing.tokenise(id_and_text(docs), WORD, 1, "<u2"), "<u2")
    assert corpus.n == len(ids) and abs(corpus.mean - sum(map(len, ids)) / len(ids)) < 1e-9
    assert {t: n for t, n in enumerate(corpus.df.tolist()) if n} == want


def test_retrieval_is_that_of_plain_python():
    rng = random.Random(1)
    docs = [{t: rng.randint(1, 9) / 2 for t in rng.sample(range(40), rng.randint(1, 6))} for _ in range(50)]
    rows = [np.array(list(d.items()), dtype=packing.strong_type("<u2")).tobytes() for d in docs]
    got = packing.retrieval(rows, 5, "<u2")
    for i, d in enumerate(docs):
        best = sorted((sum(e.get(t, 0) for t in d) for j, e in enumerate(docs) if j != i), reverse=True)[:5]
        assert abs(got[i] - sum(s / (k + 1) for k, s in enumerate(best))) < 2e-2


def test_copies_of_other_splits_share_a_window(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=30)) for _ in range(1200)]
    # Copies are thousands of rows and three splits away from each other.
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(10_000 + i, t, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartitionByRange(4, "part", "doc_id")
    assert df.groupBy(F.spark_partition_id()).count().count() > 1
    out = packing.pack_documents(df, tokenizer=WORD, window=512).collect()
    held = collections.defaultdict(set)
    for r in out:
        held[r["doc_id"]].add(r["sequence_id"])
    assert len(held) == 2 * len(texts)
    assert sum(bool(held[i] & held[10_000 + i]) for i in range(len(texts))) > 0.9 * len(texts)


def test_neighbours_are_ranked_as_bm25_ranks_them():
    import math

    rng = random.Random(3)
    docs = [np.array(rng.choices(range(60), k=rng.randint(3, 40)), dtype=np.uint32) for _ in range(60)]
    df = collections.Counter(t for d in docs for t in set(d.tolist()))
    counts = np.zeros(61, dtype=np.int64)
    counts[list(df)] = list(df.values())
    corpus = packing.Corpus(len(docs), sum(map(len, docs)) / len(docs), counts)
    index = packing.Bm25(docs, 100, corpus)
    for seed in range(20):
        score = []
        for d in docs:
            held, length = collections.Counter(d.tolist()), packing.K1 * (1 - packing.B + packing.B * len(d) / corpus.mean)
            score.append(sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * held[t] * (packing.K1 + 1) / (held[t] + length) for t in set(docs[seed].tolist()) if df[t] > 1))
        used = np.zeros(len(docs), dtype=bool)
        used[[seed, 7]] = True
        got = index.neighbours(seed, used, 10)
        want = sorted((i for i in range(len(docs)) if not used[i] and score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:10]
        assert [round(score[i], 6) for i in got] == [round(score[i], 6) for i in want] and not {seed, 7} & set(got)


def test_null_ids_and_repeated_rows_are_packed_apart(spark):
    df = spark.createDataFrame([(None, "one two three"), (1, "four five"), (1, "four five"), (1, None), (2, "word " * 9000)], "doc_id long, text string").withColumn("start", F.lit("x"))
    out = packing.pack_documents(df, tokenizer=WORD).collect()
    total = collections.Counter()
    for r in out:
        total[r["doc_id"]] += r["length"]
    assert dict(total) == {None: 4, 1: 3 + 3 + 1, 2: 9001}
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 2048
