"""Embedding, archive and packing operators, queries and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import embeddings, packing, warc
from ledgerloom.llm.oracles import llm_oracles
from ledgerloom.llm.queries import llm_queries
from tests.llm.helpers import documents, linked_roots, sample_texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ 3: embeddings
def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12))
    rows = []
    for i in range(150):
        vector = centers[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in vector], i % 2))
    rows += [(150 + k, rows[0][1], 0) for k in range(5)]
    rows += [(160, [2 * x for x in rows[0][1]], 0), (161, None, 0), (162, [0.0] * 12, 0), (163, [], 0), (164, rows[0][1], None)]
    rows += [(165, [float("nan")] * 12, 0), (166, [float("inf")] + [0.0] * 11, 0), (167, [None] + [1.0] * 11, 0), (168, [1.0, 0.0], 0), (169, [1.0, 0.01], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).withColumn("cls", F.lit("x"))
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, dtype=np.float32).astype(float), label)

    def linked(a, b):
        if a not in good or b not in good or good[a][1] != good[b][1] or len(good[a][0]) != len(good[b][0]):
            return False
        x, y = good[a][0], good[b][0]
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    ids = [r[0] for r in rows]
    roots = linked_roots(ids, linked)
    for tile in (8, 1024):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(table, tile=tile).collect()}
        assert len(got) == len(ids)
        for i in ids:
            assert got[i]["n_links"] == sum(linked(i, j) for j in ids if j != i), (tile, i)
            assert got[i]["component_id"] == roots[i] and got[i]["kept"] == (roots[i] == i)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_pairs_at_the_threshold():
    a = np.array([[1.0, 0.0]])
    b = np.array([[0.93, np.sqrt(1 - 0.93**2)], [0.9299999, np.sqrt(1 - 0.9299999**2)]])
    i, j = embeddings.close_pairs(a, b, 0.93, a, b)
    assert 1 not in j.tolist()


# ------------------------------------------------------------------ 5: archives
def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    html = ["<p>" + "é名" * n + "\r\n\r\nWARC/1.1\r\n" for n in (0, 40, 3_000, 20_000)] + [None, "", "x" * 99, "x" * 100]
    html += [html[2], html[2], html[6], "".join(rng.choice("ab\r\n") for _ in range(50_000)), html[7]]
    rows = [(i, None if i == 1 else f"http://a.b/\r\n {i}", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("id", F.lit(0))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    logical = warc.payloads(warc.reassemble(warc.read_records(spark, path)))
    got = {int(r["page_id"]): r for r in logical.collect()}
    assert len(got) == len(rows) and all(r["complete"] for r in got.values())
    owner = {r["record_id"]: i for i, r in got.items()}
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        original = first.setdefault(raw, i)
        if len(raw) >= 100 and original != i:
            assert got[i]["type"] == "revisit" and owner[got[i]["refers_to"]] == original
        else:
            assert got[i]["type"] == "response" and bytes(got[i]["payload"]) == raw
    segments = warc.read_records(spark, path).where("segment IS NOT NULL")
    assert segments.agg(F.max(F.octet_length("block"))).first()[0] <= warc.SEGMENT_BYTES + 3


def test_broken_segments_are_found(spark):
    schema = warc._RECORD
    part = lambda rid, kind, n, origin, total, block: (rid, None, kind, None, None, n, origin, total, block)
    rows = [
        part("a", "response", 1, None, None, b"ab"), part("a2", "continuation", 2, "a", 4, b"cd"),
        part("b", "response", 1, None, None, b"ab"), part("b3", "continuation", 3, "b", 4, b"cd"),
        part("c", "response", 1, None, None, b"ab"), part("c2", "continuation", 2, "c", 9, b"cd"),
        part("d2", "continuation", 2, "d", 2, b"cd"), part("e", "response", None, None, None, b"ef"),
    ]
    found = {r["record_id"]: r for r in warc.reassemble(spark.createDataFrame(rows, schema)).collect()}
    assert bytes(found["a"]["block"]) == b"abcd" and bytes(found["e"]["block"]) == b"ef"
    assert all(not found[k]["complete"] and found[k]["block"] is None for k in "bcd")


def test_framing():
    assert warc.dechunk(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.dechunk(b"zz\r\n") is None
    text = "aé名😀" * 50
    for size in (1, 2, 3, 7, 1000):
        parts = warc.split_text(text, size)
        assert "".join(parts) == text and all(len(p.encode()) <= max(size, 4) for p in parts)
        assert warc.dechunk(warc.chunked(text, size).encode()) == text.encode()
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"))
    data = zlib.compress(b"ab", wbits=31) + zlib.compress(b"cd", wbits=31)
    assert warc.inflate(data) == b"abcd" and warc.inflate(b"WARC") == b"WARC"


# ------------------------------------------------------------------ 10: packing
@pytest.mark.parametrize("dimensions", [2, 3])
def test_hilbert_neighbours_touch(dimensions):
    bits = 4
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_cuts_cover_every_id():
    for total in (1, 5, 16, 37, 64):
        for start in range(total):
            for length in range(1, total - start + 1):
                pieces = packing.cut(start, length, total, 16)
                assert sum(p[1] for p in pieces) == length and pieces[0][0] == 0
                assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
                assert all(p[1] + p[3] <= 16 for p in pieces)


def test_encoder_is_the_tokenizer():
    texts = [t or "" for t in sample_texts()] + [
        "It's they'RE 'set <|endoftext|> a1b22 foo_bar x<|startoftext|>y", "İstanbul ΟΔΟΣ é ́x ﬁ \x1c a\x85b\xa0c　d \x00z",
        "don't!!! ### <|x|> \t tab\x0bvt\x0cff", "ÀÉ" * 40,
    ]
    encoder = packing.Encoder(TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 12)
    encoder, plain = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ("a b c d e", "a b c d e", "f g", "a f é", "é z", "a b"):
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless(spark):
    texts = sample_texts(7)
    ids = [*range(len(texts) - 2), None, 3]
    docs = documents(spark, texts, ids)
    rows = packing.pack(docs, TOKENIZER, sequence=64).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r["length"] for r in rows) == total
    sequences: dict[int, list] = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or at & (at - 1) == 0
    for i in (0, 5, 12):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        joined = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), dtype="<u4").tolist()
        if i != 3:
            assert joined == [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2]
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


# ------------------------------------------------------------------ queries and pipeline
@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_queries_match_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for name_of in ("documents", "embeddings", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{sf_dir}/{name_of}.parquet'")
    expected = connection.execute(llm_oracles()[name]).df()
    got = llm_queries()[name](spark, sf_dir).toPandas()[list(expected.columns)]
    key = list(expected.columns)
    got, expected = (x.fillna(-1).sort_values(key).to_numpy().tolist() for x in (got, expected))
    assert got == expected


def test_pipeline_stage_by_stage(spark, sf_dir):
    from tests.llm.test_text_operators import naive_repeats, near_roots

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), name)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    first, one, cut, mix, pieces = seen.values()
    # near copies: five-word shingles and a similarity of 0.8, not the three words and two bits of op9
    roots = near_roots(dict(zip(first["doc_id"], first["text"], strict=True)))
    assert sorted(one["doc_id"]) == sorted(set(roots.values()))
    one = one.sort_values("doc_id")
    kept = naive_repeats([t.encode() for t in one["text"]], 100)
    assert [k.decode(errors="ignore") for k in kept] == cut.sort_values("doc_id")["text"].tolist()
    assert max(Counter(mix["doc_id"]).values()) <= 2 and set(mix["doc_id"]) <= set(cut["doc_id"])
    assert Counter(pieces[pieces["start"] == 0]["doc_id"]) == Counter(mix["doc_id"])
    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    order = ["doc_id", "sequence_id", "offset"]
    assert run[order].sort_values(order).to_numpy().tolist() == pieces[order].sort_values(order).to_numpy().tolist()
