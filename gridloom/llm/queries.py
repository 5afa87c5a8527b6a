"""The registered queries: each applies its operator to the whole table and derives the columns asked for."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm import flac, imatch, language, licenses, minhash, packing, pieces, pii, quality, secrets, spelling, token_count, whitening
from gridloom.llm.common import documents, hex_sha256, id_and_text


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language.fold() == 2
    known = language.fit_dictionaries(docs.filter(~held_out))
    return language.identify(docs, known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    scores = F.transform("spans", lambda s: s["score"])
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in pii.KINDS], hex_sha256(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_max(scores).alias("best_score"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def padded_payloads(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and payload: the text's UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = id_and_text(df).select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    width = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / 64)) * 64
    zeros = F.unhex(F.repeat(F.lit("00"), (width - F.col("n_bytes")).cast("int")))
    return raw.select("doc_id", "n_bytes", F.concat("raw", zeros).alias("payload"))


#: What op5 tells of each stored payload.
MEDIA_FIELDS = StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")


def media_digest(media: bytes | None, blocks: Iterator[tuple[int, bytes]]) -> tuple[int, str, int, int, str, str]:
    """``MEDIA_FIELDS`` of a stream and the blocks of samples read from it, one block at a time."""
    media, whole, tail = media or b"", hashlib.sha256(), b""
    samples = n_blocks = peak = total = energy = crossings = 0
    below = None
    for offset, pcm in blocks:
        if offset != samples:
            raise ValueError("a block is missing")
        payload = (np.frombuffer(pcm, dtype=np.uint8) ^ 0x80).tobytes()
        whole.update(payload)
        tail = (tail + payload)[-64:]
        wide = np.frombuffer(pcm, dtype=np.int8).astype(np.int64)
        sign = wide < 0
        crossings += int(np.count_nonzero(sign[1:] != sign[:-1])) + (below is not None and below != bool(sign[0]))
        peak, total, energy = max(peak, int(np.abs(wide).max())), total + int(wide.sum()), energy + int(wide @ wide)
        samples, n_blocks, below = samples + len(wide), n_blocks + 1, bool(sign[-1])
    feature = f"samples={samples};blocks={n_blocks};peak={peak};sum={total};energy={energy};crossings={crossings}"
    return samples, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = flac.encode_flac(padded_payloads(documents(spark, sf_dir))).drop("payload")
    read = flac.read_blocks(stored, media_digest, MEDIA_FIELDS)
    # Every payload was stored just now: one that can't be read back is no result but a fault.
    sound = F.when(F.col("media_error").isNotNull(), F.raise_error(F.concat(F.lit("a stored payload can't be read back: "), "media_error")).cast("long")).otherwise(F.col("payload_bytes"))
    return read.withColumn("payload_bytes", sound).drop("media_error")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.next_likeness(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", hex_sha256(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir), owner=F.col("source"))
    of = lambda kind: F.size(F.filter("candidates", lambda c: c["number"] == secrets.KINDS.index(kind))).cast("long")
    base = secrets.span_list(F.col("candidates"), ("assign", "access", "hex"))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in secrets.KINDS], hex_sha256(base).alias("base_sha256"), secrets.span_list(F.col("candidates")).alias("spans"), "n_live", "n_shared")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer=tokenizer_path("word_bpe_49k.json"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), model=tokenizer_path("piece_bpe_32k.model"), digests=True)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fitted = whitening.fit_whitening(vectors)
    rows = whitening.whiten(vectors, fitted)
    error = whitening.identity_error(rows, fitted)
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained]) if fitted else F.array(F.lit(None).cast("double"))
    spread = rows.select("vec_id", F.lit(fitted.n if fitted else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return spread.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(documents(spark, sf_dir))).select("word", "form", "root", "n", "n_near", "form_n")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = quality.fit_lines(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs.select("doc_id", "text"), field).drop("text", "labels")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_license": op3_license,
    "op4_minhash": op4_minhash,
    "op5_flac": op5_flac,
    "op6_tokens": op6_tokens,
    "op7_imatch": op7_imatch,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_pieces": op10_pieces,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_quality": op13_quality,
    "pipeline": pipeline,
}


#: DuckDB SQL where it can express a query: near copies as a join on all shingles and the least id that links reach.
ORACLE: dict[str, str] = {
    "op4_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n + m - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 85 * (n + m - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, sh""",
}
