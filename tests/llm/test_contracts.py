"""Each registered query against plain Python over a whole table."""

import collections
import hashlib
import re
import zlib

import pyarrow.parquet as pq
import pytest

from gridloom.llm import queries

from .conftest import SMALL

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SMALL).collect()]


def test_op1_held_out_accuracy(spark, table):
    out = rows(spark, "op1_language")
    lang = {d["doc_id"]: d["lang"] for d in table}
    assert sorted(r["doc_id"] for r in out) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.98
    assert sum(r["rejected"] for r in out) < 0.02 * len(out)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
}
ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
SECRET = {
    "assign": ("(" + "|".join(map(ANY, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def base_spans(kinds, text):
    order = list(kinds)
    found = [(m.start(), order.index(k), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]
    return [(order[k], s, e) for s, k, e in sorted(found)]


def same_spans(out, table, kinds, extra):
    text = {d["doc_id"]: d["text"] or "" for d in table}
    assert sorted(r["doc_id"] for r in out) == sorted(text)
    for r in out:
        want = base_spans(kinds, text[r["doc_id"]])
        counts = collections.Counter(k for k, _, _ in want)
        assert {k: r[f"n_{k}"] for k in kinds} == {k: counts[k] for k in kinds}
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        got = [x for x in r["spans"].split(",") if x and x.split(":")[0] not in extra]
        assert got == [f"{k}:{s}:{e}" for k, s, e in want]


def test_op2_base_spans(spark, table):
    same_spans(rows(spark, "op2_pii"), table, PII, {"iban", "ssn"})


def test_op8_base_spans(spark, table):
    same_spans(rows(spark, "op8_secrets"), table, SECRET, {"known"})


def test_op3_planted_notices(spark, table):
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice", "Released under the MIT License.": "MIT notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice"}
    want = {d["doc_id"]: sorted({names[line] for line in (d["text"] or "").split("\n") if line in names}) for d in table}
    assert {r["doc_id"]: r["licenses"] for r in rows(spark, "op3_license")} == want


def components(table, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, lists = {}, collections.defaultdict(list)
    for d in table:
        w = re.findall("[^\x20\x09-\x0d]+", (d["text"] or "").translate(low))
        sets[d["doc_id"]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        for s in sets[d["doc_id"]]:
            lists[s].append(d["doc_id"])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        for j, n in collections.Counter(j for s in own for j in lists[s] if j < i).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_op4_components(spark, table):
    out = rows(spark, "op4_minhash")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == components(table, 3, 85)


def test_op5_round_trip(spark, table):
    text = {d["doc_id"]: (d["text"] or "").encode() for d in table}
    out = rows(spark, "op5_flac")
    assert len(out) == len(table)
    for r in out:
        payload = text[r["doc_id"]].ljust(max(1, -(-len(text[r["doc_id"]]) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert 0 < r["media_bytes"] < len(payload) * 1.1 + 200


def test_op6_library_counts(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    text = {d["doc_id"]: d["text"] or "" for d in table}
    for r in rows(spark, "op6_tokens"):
        t = text[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_op7_edits_and_likeness(spark, table):
    table = sorted(table, key=lambda d: d["doc_id"])
    out = {r["doc_id"]: r for r in rows(spark, "op7_imatch")}
    for d, e in zip(table, [*table[1:], table[0]], strict=True):
        a, b = d["text"] or "", e["text"] or ""
        k = len(a) // 4
        r = out[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), sha(a[: len(a) - k] + b[:k]))
        assert r["near_next"] == 1 or a != b
    by_text = {}
    for d in table:
        assert by_text.setdefault(d["text"], out[d["doc_id"]]["fingerprint"]) == out[d["doc_id"]]["fingerprint"]
    mean = lambda c: sum(r[c] for r in out.values()) / len(out)
    assert mean("near_edited") > 0.4 and mean("near_next") < 0.05


def test_op9_pieces(spark, table):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {d["doc_id"]: np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for d in table}
    out = rows(spark, "op9_packing")
    places, spans = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        spans[r["doc_id"]].append((r["start"], r["length"]))
    gapless = lambda spans, total: sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), [*sorted(spans)[1:], (total, 0)], strict=True))
    assert set(spans) == set(ids) and all(gapless(s, len(ids[i])) for i, s in spans.items())
    sizes = [sum(n for _, n in s) for s in places.values()]
    assert all(gapless(s, n) for s, n in zip(places.values(), sizes, strict=True)) and max(sizes) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 0.01 * sum(sizes)


def test_op10_library_ids(spark, table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    text = {d["doc_id"]: d["text"] or "" for d in table}
    for r in rows(spark, "op10_pieces"):
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
