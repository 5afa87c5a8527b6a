"""Packing token sequences with lexical neighbours, looked for in the whole corpus.

Texts become ids once.  The number of documents, each term's document count and the mean
length are counted over all rows.  Each document is listed under every one of its strongest
BM25 terms; a term's list is sorted so that documents that share more of their strongest
terms stand together, and cut into pieces of bounded size.  In each piece documents are
ranked against each other, and each goes to the piece that holds its best neighbours.  So
input files and splits do not matter to which documents meet; a long list's pieces do.

Documents of a piece come together by a shuffle, and pieces make shards of bounded size.  A
window is opened by a seed document; the unused documents that BM25 ranks next to the seed
fill it in that order, the last one is cut at the window's end, and its rest is the seed of
the next window.  When the index has no unused neighbour the next unused document in order
follows.  So only a shard's tail can fall short of a window, and that is cut into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import id_and_text, materialise, once_a_worker, text_slices
from gridloom.llm.word_ids import WordIds

K1, B = 1.2, 0.75



def strong_type(width: str) -> np.dtype:
    """One strong term of a document: an id of the type ``width`` and its weight, to three digits, as retrieval adds up a few."""
    return np.dtype([("term", width), ("weight", "<f2")])


#: A piece of a list is named by its task and number; a choice is a score in hundredths and the complement of a name.
NUMBER_BITS, PIECE_BITS = 24, 42
PIECE_MASK = (1 << PIECE_BITS) - 1


@dataclass(frozen=True)
class Corpus:
    """What BM25 knows of all documents: their number, mean length and each term's document count."""

    n: int
    mean: float
    df: np.ndarray

    def strong_terms(self, flat: np.ndarray, sizes: np.ndarray, query_terms: int) -> tuple[np.ndarray, ...]:
        """Document, term and weight of all distinct terms, and the places of each document's strongest terms by falling weight."""
        n = len(sizes)
        owner = np.repeat(np.arange(n, dtype=np.uint64), sizes)
        key, count = np.unique((owner << np.uint64(32)) | flat, return_counts=True)
        doc, term = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = self.df[term]
        norm = K1 * (1 - B + B * sizes / max(self.mean, 1))
        weight = np.log1p((self.n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + norm[doc])
        weight[df < 2] = 0  # such a term finds no neighbour
        order = np.lexsort((term, -weight, doc))
        per_doc = np.bincount(doc, minlength=n)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        return doc, term, weight, order[(place < query_terms) & (weight[order] > 0)]


class Bm25:
    """Inverted index over the token ids of one shard's documents, weighed by the corpus."""

    def __init__(self, docs: list[np.ndarray], query_terms: int, corpus: Corpus):
        n = len(docs)
        doc, term, weight, strong = corpus.strong_terms(np.concatenate(docs), np.array([len(d) for d in docs], dtype=np.int64), query_terms)
        terms, term = np.unique(term, return_inverse=True)
        df = np.bincount(term, minlength=len(terms))
        self.queries = np.split(term[strong], np.cumsum(np.bincount(doc[strong], minlength=n))[:-1])
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.bounds = np.concatenate(([0], np.cumsum(df)))
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray, top: int) -> list[int]:
        """Unused documents by falling score, at most ``top``; ties by position."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in self.queries[seed]]
        if not spans:
            return []
        scores = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), minlength=self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > top:
            cut = np.partition(scores[found], -top)[-top]
            found = found[scores[found] >= cut]
        return found[np.argsort(-scores[found], kind="stable")][:top].tolist()


def shard_order(docs: list[np.ndarray], window: int, query_terms: int, top: int, corpus: Corpus) -> list[int]:
    """The order in which a shard's documents fill its windows."""
    n = len(docs)
    if n < 3:
        return list(range(n))
    index = Bm25(docs, query_terms, corpus)
    sizes = [len(d) for d in docs]
    used, order, at, next_free, seed, seen = np.zeros(n, dtype=bool), [], 0, 0, -1, -1
    waiting: list[int] = []
    for _ in range(n):
        # What opened the current window is its seed; its neighbours are asked for once a window.
        if order and at // window != seen:
            seen, seed = at // window, order[-1]
            waiting = index.neighbours(seed, used, top)[::-1]
        pick = -1
        while waiting and pick < 0:
            pick = waiting.pop()
            pick = -1 if used[pick] else pick
        if pick < 0 and order and order[-1] != seed:
            seed = order[-1]
            waiting = index.neighbours(seed, used, top)[::-1]
            pick = waiting.pop() if waiting else -1
        if pick < 0:
            while used[next_free]:
                next_free += 1
            pick = next_free
        used[pick] = True
        order.append(pick)
        at += sizes[pick]
    return order


def sequence_bounds(total: int, window: int) -> np.ndarray:
    """Where sequences begin and end in a shard's stream: windows, then falling powers of two."""
    bounds = list(range(0, total + 1, window))
    while (rest := total - bounds[-1]) > 0:
        bounds.append(bounds[-1] + (1 << (rest.bit_length() - 1)))
    return np.array(bounds, dtype=np.int64)


def pack_shard(docs: list[np.ndarray], window: int, query_terms: int, top: int, corpus: Corpus) -> dict[str, np.ndarray]:
    """Pieces of one shard: doc (position), start, length, sequence (number in the shard), offset."""
    order = np.array(shard_order(docs, window, query_terms, top, corpus), dtype=np.int64)
    sizes = np.array([len(docs[i]) for i in order], dtype=np.int64)
    ends = np.cumsum(sizes)
    bounds = sequence_bounds(int(ends[-1]), window)
    cuts = np.union1d(bounds, np.concatenate(([0], ends)))
    begin, end = cuts[:-1], cuts[1:]
    rank = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(bounds, begin, side="right") - 1
    return {"doc": order[rank], "start": begin - (ends - sizes)[rank], "length": end - begin, "sequence": sequence, "offset": begin - bounds[sequence]}


def id_slices(column: pa.Array, width: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` ids: first row, end row, their ids as one array, and each row's count."""
    held, opened = column.to_pylist(), zstandard.ZstdDecompressor().decompress
    sizes = np.array([zstandard.frame_content_size(x) for x in held], dtype=np.int64) // np.dtype(width).itemsize
    offsets, first = np.concatenate(([0], np.cumsum(sizes))), 0
    while first < len(held):
        end = min(len(held), max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1))
        yield first, end, np.frombuffer(b"".join(map(opened, held[first:end])), dtype=width).astype(np.uint32), sizes[first:end]
        first = end


def tokenise(texts: DataFrame, tokenizer: str, end_id: int, width: str) -> DataFrame:
    """uid (split and place in it), doc_id and ids (of the type ``width``, with the end id, compressed, as they are shuffled twice) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail, count = once_a_worker(WordIds, tokenizer), np.array([end_id], dtype=width).tobytes(), 0
        pressed = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                flat, bounds = coder.encode(data, offsets)
                raw, ends = flat.astype(width).tobytes(), (bounds * np.dtype(width).itemsize).tolist()
                uid = (batch.column("split")[0].as_py() << 33) + count + np.arange(end - first, dtype=np.int64)
                count += end - first
                ids = [pressed(raw[a:b] + tail) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(uid), batch.column("doc_id").slice(first, end - first), pa.array(ids, pa.binary())], ["uid", "doc_id", "ids"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.withColumn("split", F.spark_partition_id()).mapInArrow(run, f"uid long, doc_id {kind}, ids binary")


def corpus_of(tokens: DataFrame, width: str) -> Corpus:
    """Counted over all rows; each task sends a number for each term it saw, so at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(0, dtype=np.int64), 0, 0
        for batch in batches:
            for _, _, flat, sizes in id_slices(batch.column("ids"), width):
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                more = np.bincount((np.unique((owner << np.uint64(32)) | flat) & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(df))
                more[: len(df)] += df
                df, n, total = more, n + len(sizes), total + len(flat)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seen, [-1, -2]))), pa.array(np.concatenate((df[seen], [n, total])))], ["term", "n"])

    counted = {r["term"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(max(counted, default=0) + 1, dtype=np.int64)
    df[list(counted)] = list(counted.values())
    return Corpus(n, total / max(n, 1), df)


def strong_rows(tokens: DataFrame, width: str, corpus: Corpus, query_terms: int) -> DataFrame:
    """uid and strong (bytes of ``strong_type``, by falling weight) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = strong_type(width)
        for batch in batches:
            for first, end, flat, sizes in id_slices(batch.column("ids"), width):
                doc, term, weight, strong = corpus.strong_terms(flat, sizes, query_terms)
                packed = np.zeros(len(strong), dtype=kind)
                packed["term"], packed["weight"] = term[strong], weight[strong]
                raw = packed.tobytes()
                ends = (np.concatenate(([0], np.cumsum(np.bincount(doc[strong], minlength=len(sizes))))) * kind.itemsize).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(first, end - first), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["uid", "strong"])

    return tokens.select("uid", "ids").mapInArrow(run, "uid long, strong binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def postings(strong: DataFrame, width: str) -> DataFrame:
    """A row for each strong term: term, near, uid, strong.

    ``near`` names the document's other strong terms that come first in an order of the term's own, drawn
    by hashes: two documents have the first in common with the chance that a term of theirs is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = strong_type(width)
        for batch in batches:
            held = batch.column("strong").to_pylist()
            sizes = np.array([len(h) // kind.itemsize for h in held], dtype=np.int64)
            for q in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == q)
                term = np.frombuffer(b"".join([held[i] for i in rows.tolist()]), dtype=kind)["term"].reshape(len(rows), q).astype(np.uint64)
                drawn = _mixed(_mixed(term + np.uint64(1))[:, :, None] ^ term[:, None, :])
                drawn[:, np.arange(q), np.arange(q)] = np.iinfo(np.uint64).max
                first = np.argsort(drawn, axis=2)[:, :, : min(3, q - 1)]
                near = np.zeros((len(rows), q), dtype=np.int64)
                for i in range(first.shape[2]):
                    near |= np.take_along_axis(term, first[:, :, i], axis=1).astype(np.int64) << (42 - 21 * i)
                at = pa.array(np.repeat(rows, q))
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64).ravel()), pa.array(near.ravel()), batch.column("uid").take(at), batch.column("strong").take(at)], ["term", "near", "uid", "strong"])

    return strong.mapInArrow(run, "term long, near long, uid long, strong binary")


def retrieval(strong: list[bytes], top: int, width: str) -> np.ndarray:
    """For each document of a piece, its ``top`` best scores among the others, the i-th divided by i, summed."""
    m = len(strong)
    kind = strong_type(width)
    held = np.frombuffer(b"".join(strong), dtype=kind)
    doc = np.repeat(np.arange(m), [len(s) // kind.itemsize for s in strong])
    _, term, count = np.unique(held["term"], return_inverse=True, return_counts=True)
    # Common terms by a matrix product, others pair by pair.
    common = count > max(m // 16, 1)
    own = common[term]
    weight = np.zeros((m, int(common.sum())), dtype=np.float32)
    weight[doc[own], (np.cumsum(common) - 1)[term[own]]] = held["weight"][own]
    score = (weight > 0).astype(np.float32) @ weight.T
    if not own.all():
        doc, term, value = doc[~own], term[~own], held["weight"][~own]
        order = np.argsort(term, kind="stable")
        doc, term, value = doc[order], term[order], value[order]
        size = count[term]
        left = np.repeat(np.arange(len(term)), size)
        right = np.repeat(np.searchsorted(term, term), size) + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        score += np.bincount(doc[left] * m + doc[right], value[right], m * m).reshape(m, m).astype(np.float32)
    np.fill_diagonal(score, 0)
    k = min(top, m - 1)
    best = np.sort(np.partition(score, m - k, axis=1)[:, m - k :], axis=1)[:, ::-1]
    return best @ (1 / np.arange(1, k + 1))


def choices(listed: DataFrame, top: int, piece_rows: int, width: str) -> DataFrame:
    """uid and choice of each document in each piece of the lists, which are sorted by term and near."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows, current = [], None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("term", "near", "uid", "strong")], strict=True):
                if row[0] != current:
                    if len(rows) > 1:
                        yield rows
                    rows, current = [], row[0]
                rows.append(row)
                if len(rows) == piece_rows:
                    # Where ``near`` changes, so that like documents are not cut apart, unless that's too early.
                    cut = next((i for i in range(piece_rows - 1, piece_rows // 2, -1) if rows[i][1] != rows[i - 1][1]), piece_rows)
                    yield rows[:cut]
                    rows = rows[cut:]
        if len(rows) > 1:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, found, number, split = [], [], 0, [0]

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    split[0] = batch.column("split")[0].as_py()
                yield batch

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(np.concatenate(found))], ["uid", "choice"])
            uids.clear()
            found.clear()
            return out

        for rows in pieces(noted()):
            score = (retrieval([r[3] for r in rows], top, width) * 100).astype(np.int64)
            uids.extend([r[2] for r in rows])
            found.append((score << PIECE_BITS) | (PIECE_MASK - ((split[0] << NUMBER_BITS) + number)))
            number += 1
            if len(uids) > 10_000:
                yield flush()
        if uids:
            yield flush()

    return listed.withColumn("split", F.spark_partition_id()).mapInArrow(run, "uid long, choice long")


def pack_documents(
    df: DataFrame, *, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 2048, shard_tokens: int = 1_000_000,
    query_terms: int = 12, top: int = 32, with_ids: bool = False, piece_rows: int = 256,
) -> DataFrame:
    """Packs all rows into sequences of at most ``window`` ids.

    A row's ids are those the tokenizers library gives its text (null: empty) without added tokens, then
    ``end_id``.  Returns a row for each piece: the id column, start (the document's ids before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id,
    offset (in its sequence) and, with ``with_ids``, ids (array).  Neighbours are looked for among all rows, in
    pieces of at most ``piece_rows`` of each strong term's list; rows without a neighbour stay in their order.
    A shard ends at ``shard_docs`` rows or ``shard_tokens`` ids, so memory doesn't grow with the input.  Rows
    that repeat an id are packed apart, and so are null ids.  A document longer than a window fills windows of its own.  Equal
    scores go by position, equal texts are neighbours.  An empty table gives no rows.

    A document asks for neighbours by its ``query_terms`` strongest terms, as search engines do with a whole document for a query,
    and a window asks for ``top`` of them.  When these are used up the window's last document asks in its turn, and so on: so
    neither number ends the search while unused documents share a term, nor does it drop a row.
    """
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    # Read four times, so written once; uids stay what they are when a task is run again.
    tokens = materialise(tokenise(id_and_text(df, id_col, text_col), tokenizer, end_id, width))
    corpus = corpus_of(tokens, width)
    strong = materialise(strong_rows(tokens, width, corpus, query_terms))
    order = ["term", "near", "uid"]
    listed = postings(strong, width).repartitionByRange(*order).sortWithinPartitions(*order)
    # Every choice of a document differs in its piece, so the best one is one number.  Once they are written the lists' shuffle goes.
    chosen = materialise(choices(listed, top, piece_rows, width).groupBy("uid").agg(F.max("choice").alias("choice")))
    # No list's piece has a negative name: there is one for each run of rows that found nothing.
    alone = F.lit(-1) - F.shiftright("uid", 8)
    group = F.coalesce(F.col("choice").bitwiseAND(F.lit(PIECE_MASK)), alone)
    placed = tokens.join(chosen.hint("shuffle_hash"), "uid", "left").select(group.alias("group"), "uid", "doc_id", "ids")
    placed = placed.repartition("group").sortWithinPartitions("group", "uid").withColumn("split", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[np.ndarray] = []
        state = {"tokens": 0, "sequence": 0, "group": None}

        def flush() -> pa.RecordBatch:
            p = pack_shard(held, window, query_terms, top, corpus)
            spans = [held[d][s : s + n] for d, s, n in zip(p["doc"].tolist(), p["start"].tolist(), p["length"].tolist(), strict=True)]
            sizes = np.array([len(d) for d in held], dtype=np.int64)
            base = (split[0] << 32) + state["sequence"]
            columns = [pa.array(keys, key_type[0]).take(pa.array(p["doc"])), pa.array(p["start"]), pa.array(p["length"]), pa.array([zlib.crc32(x.tobytes()) for x in spans], pa.int64()), pa.array(sizes[p["doc"]]), pa.array(p["sequence"] + base), pa.array(p["offset"])]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in spans], pa.list_(pa.int32())))
            state["sequence"] += int(p["sequence"][-1]) + 1
            state["tokens"] = 0
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        split, key_type, opened = [0], [None], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if batch.num_rows:
                split[0], key_type[0] = batch.column("split")[0].as_py(), batch.schema.field("doc_id").type
            for group, key, raw in zip(*[batch.column(c).to_pylist() for c in ("group", "doc_id", "ids")], strict=True):
                # A piece is not cut unless it holds too many ids.
                if held and (len(held) >= shard_docs or state["tokens"] >= shard_tokens or group != state["group"] and len(held) + piece_rows > shard_docs):
                    yield flush()
                state["group"] = group
                keys.append(key)
                held.append(np.frombuffer(opened(raw), dtype=width).astype("<u4"))
                state["tokens"] += len(held[-1])
        if held:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = df.schema[id_col].dataType.simpleString()
    out = placed.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("doc_id", id_col)
