"""Tokenizer alignment, phrase mining and benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import align, collocations, decontaminate
from tests.llm.helpers import CLASHING, documents, sample_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " lead", "trail ", "  two  spaces  ", "a\n b \n\nc", "tab\t x", "<|endoftext|> <s> </s> <0x0A> <unk>", "x\x00y \x1c z",
    "▁ literal ▁ marks", "名前 と 名前、テスト。", "😀 é ́x ﬁ\xa0\x85 end", "ab" * 300, "word\r\nword\r\n",
]


# ------------------------------------------------------------------ 11: alignment
def naive_groups(model, text):
    """Groups of ids by the offsets where tokens of both sides end, from the tokenizers on the whole text."""
    if not text:
        return None
    a, b = model.a.encode(" " + text, add_special_tokens=False).ids, model.b.encode(text)
    full = (" " + text).encode()
    if b"".join(model.a_bytes[i] for i in a) != full or b"".join(model.b_bytes[i] for i in b) != full:
        return None
    groups = defaultdict(lambda: ([], []))
    ends_a = list(itertools.accumulate(len(model.a_bytes[i]) for i in a))
    ends_b = list(itertools.accumulate(len(model.b_bytes[i]) for i in b))
    shared = sorted(set(ends_a) & set(ends_b))
    for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
        for token, end in zip(ids, ends, strict=True):
            groups[next(s for s in shared if s >= end)][side].append(token)
    return [groups[s] for s in shared]


def naive_digests(model, texts):
    linked = []
    for text in texts:
        groups = naive_groups(model, text)
        linked.append((groups, Counter((x, y) for a, b in groups or () for x in a for y in b)))
    held = Counter(pair for _, pairs in linked for pair in pairs)
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for groups, pairs in linked:
        if groups is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in pairs.items()),
            hashlib.sha256(said.encode()).hexdigest(),
        )


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("run_chars", [align.RUN_CHARS, 50])
def test_alignment_matches_brute_force(spark, monkeypatch, run_chars):
    monkeypatch.setattr(align, "RUN_CHARS", run_chars)
    texts = sample_texts(21) + ODD
    docs = documents(spark, texts, ids=[*range(len(texts) - 2), None, 2**60 + 1]).repartition(3)
    want = Counter(zip([*range(len(texts) - 2), None, 2**60 + 1], naive_digests(align.aligner(A, B), texts), strict=True))
    rows = align.alignment_digests(docs, A, B).collect()
    assert Counter((r["doc_id"], tuple(r[n] for n in NAMES)) for r in rows) == want
    assert align.alignment_digests(docs.limit(0), A, B).count() == 0


def test_diagonal_runs_find_all_common_ends():
    rng = random.Random(22)
    for _ in range(300):
        total = rng.randint(1, 80)
        a, b = (sorted({*rng.sample(range(1, total + 1), rng.randint(0, total - 1)), total}) for _ in range(2))
        found, runs = [], align.diagonal_runs(a, b)
        for (i, j, k), (next_i, _, _) in itertools.pairwise([*runs, (len(a), len(b), 0)]):
            assert a[i : i + k] == b[j : j + k]
            found += a[i : i + k]
            if next_i > i + k:
                found.append(a[next_i - 1])
        assert found == sorted(set(a) & set(b))


def test_parts_of_long_texts_and_large_groups(monkeypatch):
    model, rng = align.aligner(A, B), random.Random(23)
    texts = [" ".join(t for t in sample_texts(k) if t and len(t) < 500) for k in range(3)] + ODD
    for size, most in ((align.SEGMENT_CHARS, align.LARGE_GROUP), (9, 1)):
        monkeypatch.setattr(align, "SEGMENT_CHARS", size)
        monkeypatch.setattr(align, "LARGE_GROUP", most)
        monkeypatch.setattr(align, "REMEMBERED", rng.randint(3, 100))
        run = align._Run(model)
        for i, text in enumerate(texts):
            run.add(i, text)
            groups = naive_groups(model, text)
            pairs = Counter(x * len(model.b_bytes) + y for a, b in groups or () for x in a for y in b)
            assert dict(zip(run.keys[-1].tolist(), run.times[-1].tolist(), strict=True)) == pairs



class CountedCalls:
    """A tokenizer whose encoding calls are counted."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.tokenizer, name)


def test_new_units_are_encoded_together():
    model, rng = align.Aligner(A, B), random.Random(31)
    units = sorted({f"{rng.choice([' ', chr(10), '  '])}w{rng.randrange(10**9):x}" for _ in range(400)} | {" é", " 名前", " "})
    counted = []
    model._spells = lambda unit, a, b: counted.append(unit) or align.Aligner._spells(model, unit, a, b)
    model.a, model.b = CountedCalls(model.a), CountedCalls(model.b)
    model.learn(units)
    # one text of all units and the unit that is white space
    assert len(counted) == model.a.calls == model.b.calls == 2
    alone = align.Aligner(A, B)
    alone._learn_one_by_one(units)
    assert dict(model) == dict(alone)
    # units that B spells otherwise are told from the others
    model.learn(mixed := [f" v{i}" for i in range(40)] + [" ﬁ", "\n½", " ▁"])
    alone._learn_one_by_one(mixed)
    assert dict(model) == dict(alone) and model[" ▁"] is None


@pytest.mark.parametrize("unit_links", [align.UNIT_LINKS, 3])
def test_units_are_aligned_once(monkeypatch, unit_links):
    monkeypatch.setattr(align, "UNIT_LINKS", unit_links)
    walked, runs = [], align.diagonal_runs
    monkeypatch.setattr(align, "diagonal_runs", lambda a, b: walked.append(len(a)) or runs(a, b))
    model, text = align.Aligner(A, B), " ".join(f"zq{i}xv" for i in range(50)) + " plain words"
    texts = [text, text[::-1], text, text + "\n" + text, *ODD, *sample_texts(5)]
    run = align._Run(model)
    for i, t in enumerate(texts):
        run.add(i, t)
        if i == 2:
            # the third text is the first one: nothing is left to walk unless its units have too many links
            assert unit_links == 3 or len(walked) == 2
        groups = naive_groups(model, t)
        pairs = Counter(x * len(model.b_bytes) + y for a, b in groups or () for x in a for y in b)
        assert dict(zip(run.keys[-1].tolist(), run.times[-1].tolist(), strict=True)) == pairs
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or ())
        assert run.rows[-1][-1] == (hashlib.sha256(said.encode()).hexdigest() if groups else "")
        assert run.rows[-1][2:4] == (len(groups or ()), sum(pairs.values()))


def test_groups_as_rows(spark):
    texts = ["plain words here", None, "é"]
    rows = align.aligned_groups(documents(spark, texts), A, B).collect()
    model = align.aligner(A, B)
    got = {r["doc_id"]: list(zip(r["a"], r["b"], strict=True)) for r in rows}
    assert got == {i: naive_groups(model, texts[i]) for i in (0, 2)}


# ------------------------------------------------------------------ 12: phrases
def naive_phrases(rows, first, least):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            own = [w for w in re.split(rb"[ \t]+", piece) if w]
            words[lang] += len(own)
            for n in (1, 2, 3):
                counts[lang].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    for lang, f in counts.items():
        found = []
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in wanted.items():
            longer = [f[q] for q in wanted if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * x >= 50 * a for x in longer):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            yield (lang, rank, phrase.decode(), -a, left, right, words[lang], -score)


@pytest.mark.parametrize(("run_chars", "bits", "cells"), [(collocations.RUN_CHARS, 10, 8), (300, 1, 8), (2_000, 2, 10**6)])
def test_phrases_match_brute_force(spark, monkeypatch, run_chars, bits, cells):
    monkeypatch.setattr(collocations, "RUN_CHARS", run_chars)
    monkeypatch.setattr(collocations.counted_pairs, "__defaults__", (bits,))
    monkeypatch.setattr(collocations, "CELLS_A_HIT", cells)
    rng = random.Random(24)
    texts = sample_texts(24) + [
        "New York city, new york! NEW\tYORK city? new york city. " * rng.randint(1, 5) + "é ü\xa0é ü;é ü" for _ in range(9)
    ]
    docs = documents(spark, texts)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.phrases(docs, least=4, first=40).collect()
    assert {tuple(r) for r in got} == set(naive_phrases(rows, 40, 4))
    assert collocations.phrases(docs.limit(0)).count() == 0


def test_tiles_count_every_pair():
    rng = np.random.default_rng(25)
    for bits, n in ((1, 50), (3, 2_000), (10, 3_000), (2, 0)):
        left, right = rng.zipf(1.5, n) % 5_000, rng.zipf(1.5, n) % 5_000
        l, r, count, number = collocations.counted_pairs(left, right, bits)
        assert Counter(zip(left.tolist(), right.tolist(), strict=True)) == dict(zip(zip(l.tolist(), r.tolist(), strict=True), count.tolist(), strict=True))
        assert np.array_equal(l[number], left) and np.array_equal(r[number], right)


# ------------------------------------------------------------------ 13: decontamination
def naive_words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def naive_hits(texts, items, window):
    grams = defaultdict(set)
    for item, text in items:
        own = naive_words(text)
        for i in range(len(own) - min(window, len(own)) + 1) if own else ():
            grams[tuple(own[i : i + min(window, len(own))])].add(item)
    for text in texts:
        own, covered, held = naive_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(own) - n + 1):
                if (gram := tuple(own[i : i + n])) in grams:
                    covered.update(range(i, i + n))
                    held |= grams[gram]
        yield (len(own), covered, sorted(str(x) for x in held if x is not None))


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_matches_brute_force(spark, most):
    rng = random.Random(26)
    texts = [t for t in sample_texts(26) if t is None or len(t) < 3_000] + ["It's ÀB, c-d e!", "x" * 5_000]
    items = [(k, " ".join(rng.choice(texts[:20]).split()[:25])) for k in range(12)]
    items += [(3, "àb c"), (50, "IT S  Àb"), (51, "--"), (52, None), (None, "x"), (53, items[0][1].upper()), (54, "ÀB")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(1)).withColumn("row", F.lit(2))
    docs = documents(spark, texts)
    found = decontaminate.find_contamination(docs, benchmark, window=6, most=most, carry=("row",)).collect()
    for r, (n, covered, held) in zip(sorted(found, key=lambda r: r["doc_id"]), naive_hits(texts, items, 6), strict=True):
        spans = [(s["from"], s["to"]) for s in r["spans"]]
        assert r["n_words"] == n and r["items"] == held and r["row"] == f"row{r['doc_id']}"
        assert {w for low, high in spans for w in range(low, high)} == covered
        assert all(high < low for (_, high), (low, _) in itertools.pairwise(spans))


def test_contaminated_documents_and_spans_go(spark):
    texts = ["a b c d e f g, tail", "Keep. A b C d e f!", None, "", "clean text only here"]
    benchmark = spark.createDataFrame([(1, "b c d e")], "item_id long, text string")
    docs = documents(spark, texts)
    clean = decontaminate.clean_documents(docs, benchmark, window=4)
    assert clean.columns == docs.columns and set(CLASHING) <= set(clean.columns)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean_spans(docs, benchmark, window=4).collect()}
    assert cut == {0: "a f g, tail", 1: "Keep. A f!", 2: None, 3: "", 4: texts[4]}


def test_decontamination_of_empty_tables_and_repeats(spark):
    docs = documents(spark, ["a b c", "a b c", None], ids=[1, 1, None])
    none = spark.createDataFrame([], "item_id long, text string")
    benchmark = spark.createDataFrame([(1, "b c"), (1, "b c")], "item_id long, text string")
    assert [r["spans"] for r in decontaminate.find_contamination(docs, none).collect()] == [[], [], []]
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0
    rows = decontaminate.find_contamination(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"]), r["items"]) for r in rows) == [(0, 0, []), (1, 1, ["1"]), (1, 1, ["1"])]
