"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import docstats, langid, mixing, near_copies, ppm, quality_model, quality_rules, simhash, suffix
from tests.llm.helpers import documents, linked_roots, sample_texts


# ------------------------------------------------------------------ 1: PPM
def naive_ppm(train: list[bytes], texts: list[bytes], order: int) -> list[float]:
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    padded = lambda x: [ppm.START] * order + list(x) + [ppm.END]
    for x in train:
        s = padded(x)
        for i in range(order, len(s)):
            seen[order][tuple(s[i - order : i])][s[i]] += 1
    for k in range(order - 1, -1, -1):
        for ctx, counts in seen[k + 1].items():
            for symbol in counts:
                seen[k][ctx[1:]][symbol] += 1
    out = []
    for x in texts:
        s, total = padded(x), 0.0
        for i in range(order, len(s)):
            excluded: set[int] = set()
            for k in range(order, -1, -1):
                counts = seen[k].get(tuple(s[i - k : i]))
                if counts is None:
                    continue
                left = {a: c for a, c in counts.items() if a not in excluded}
                t = sum(left.values())
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / t)
                    break
                if left:
                    total += math.log10(len(left) / 2 / t)
                excluded |= set(counts)
            else:
                total -= math.log10(ppm.SYMBOLS - len(excluded))
        out.append(total)
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_matches_naive_trie(spark, order):
    texts = sample_texts()
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in ppm.score_texts(docs, F.col("doc_id") % 3 != 0, order=order).collect()}
    low = [ppm.lowered(t or "") for t in texts]
    used = [x for i, x in enumerate(low) if i % 3]
    words = Counter(w for x in used for w in [*x.split(), b" "])
    n, v = sum(words.values()), len(words)
    for i, (x, expected) in enumerate(zip(low, naive_ppm(used, low, order), strict=True)):
        tokens = [*x.split(), b" "]
        assert got[i]["score"] == pytest.approx(expected, rel=1e-9, abs=1e-9)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[i]["n_tokens"], got[i]["train_tokens"]) == (len(tokens), n)
        assert got[i]["n_known"] == sum(words[w] > 0 for w in tokens)


def test_ppm_runs_share_counts(spark, monkeypatch):
    texts = sample_texts(3)
    docs = documents(spark, texts, extra=False).repartition(5)
    got = {r["doc_id"]: r["score"] for r in ppm.score_texts(docs, F.lit(True), order=3).collect()}
    low = [ppm.lowered(t or "") for t in texts]
    for i, expected in enumerate(naive_ppm(low, low, 3)):
        assert got[i] == pytest.approx(expected, rel=1e-9)


def test_ppm_long_text_in_steps(monkeypatch):
    texts = [b"abcabc" * 50, b"", b"xyz"]
    whole = [(g.tolist(), o.tolist()) for g, o in ppm._gram_steps(texts, 3)]
    monkeypatch.setattr(ppm, "STEP", 7)
    parts = list(ppm._gram_steps(texts, 3))
    assert [x for g, _ in parts for x in g.tolist()] == [x for g, _ in whole for x in g]
    assert [x for _, o in parts for x in o.tolist()] == [x for _, o in whole for x in o]


def test_ppm_empty_and_untrained(spark):
    docs = documents(spark, ["ab", None], extra=False)
    assert ppm.score_texts(docs.limit(0), F.lit(True)).count() == 0
    rows = {r["doc_id"]: r for r in ppm.score_texts(docs, F.lit(None).cast("boolean")).collect()}
    assert rows[0]["score"] == pytest.approx(-3 * math.log10(257))
    assert (rows[1]["n_tokens"], rows[1]["n_known"], rows[1]["train_tokens"]) == (1, 0, 0)


# ------------------------------------------------------------------ 2: trees
def test_trees_learn_and_score():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2_000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality_model.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    row, total = x[7], model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > cut[node])
        total += leaf[node - len(feature)]
    assert model.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_scores_stand_odd_rows(spark):
    docs = documents(spark, sample_texts(), ids=[None, *range(1, 44), 43][: len(sample_texts())])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score_quality(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_model.score_quality(docs, labels.limit(0), F.lit(True)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert quality_model.score_quality(docs.limit(0), labels, F.lit(True)).count() == 0


# ------------------------------------------------------------------ 4: mixing
def test_mix_shares(spark):
    texts = ["w " * (k % 7 + 1) for k in range(200)] + [None, ""]
    docs = documents(spark, texts)
    rows = mixing.fair_mix(docs, carry=("run",)).collect()
    assert len(rows) == len(texts) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    total = sum(r["size"] for r in rows)
    assert 0 <= 1.5 * total - sum(r["taken"] for r in rows) < 8
    taken = defaultdict(int)
    for r in rows:
        taken[r["source_size"], r["target"]] += r["taken"]
    for (_, target), words in taken.items():
        assert abs(words - target) <= 8
    again = mixing.fair_mix(docs.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in rows}
    mixed = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]})


def test_mix_repeated_ids_and_empty(spark):
    docs = documents(spark, ["a b", "a b", "c"], ids=[1, 1, None])
    assert sum(r["size"] for r in mixing.fair_mix(docs).collect()) == 5
    assert mixing.fair_mix(docs.limit(0)).count() == 0
    assert mixing.mixed(documents(spark, [None, ""])).count() == 0


# ------------------------------------------------------------------ 6: rules
def test_base_counts():
    text = "a b c a b c d\n\nx y\nx y\n  \n##|"
    assert docstats.base_stats(text) == (12, 14, 3, 1, 6)
    assert docstats.base_stats(None) == (0, 0, 0, 0, 0)
    rng = random.Random(4)
    for _ in range(50):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert docstats.repeated_words(words) == len(hit)


def test_binomial_tail_is_exact():
    p = Fraction(1, 100)
    for n, k in ((10, 0), (300, 2), (900, 5), (50, 50)):
        exact = sum(Fraction(math.comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, 0.01) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.strictest([0, 0, 1, 0], 1_000, 0.01, 0.0004) == 1
    assert quality_rules.strictest([0, 0], 50, 0.01, 0.05) == -1


def test_rules_hold_their_risk(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 9) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(1200)]
    junk = [g.replace(" ", "### ") for g in good[:100]]
    docs = documents(spark, [*good, *junk, None, "few words"], extra=False).withColumn("lang", F.lit(None).cast("string"))
    labels = docs.select("doc_id", (F.col("doc_id") < 1200).cast("int").alias("quality"))
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert sum(not rows[i]["kept"] for i in range(1200)) <= 0.02 * 1200
    assert not any(rows[i]["kept"] for i in range(1200, 1302))
    assert "symbols" in rows[1200]["failed_rules"]
    unlabelled = quality_rules.apply_rules(docs, labels.limit(0)).where("NOT base_failed").agg(F.min("kept")).first()[0]
    assert unlabelled and quality_rules.apply_rules(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------ 7: repeats
def naive_repeats(texts: list[bytes], window: int):
    seen, out = set(), []
    for raw in texts:
        cover = [False] * len(raw)
        for p in range(len(raw) - window + 1):
            if raw[p : p + window] in seen:
                cover[p : p + window] = [True] * window
            seen.add(raw[p : p + window])
        out.append(bytes(b for b, c in zip(raw, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("window,seed", [(100, 32), (24, 8), (20, 16)])
def test_repeats_match_naive(spark, window, seed):
    texts = sample_texts(5) + ["abc" * 60 + "x" + "abc" * 60, "ab" * 399]
    docs = documents(spark, texts).repartition(3)
    rows = {r["doc_id"]: r for r in suffix.remove_repeats(docs, window=window, seed=seed).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, kept in enumerate(naive_repeats(raw, window)):
        assert bytes(rows[i]["kept"]) == kept, i
        assert rows[i]["n_bytes"] == len(raw[i])
        assert len(raw[i]) - len(kept) == sum(s["end"] - s["start"] for s in rows[i]["spans"])


def test_repeats_small_runs_and_chunks(spark, monkeypatch):
    from ledgerloom.llm import passages

    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(900)), dtype=np.uint8)
    whole = passages.samples(data, 20, 8)
    monkeypatch.setattr(passages, "CHUNK", 64)
    for a, b in zip(whole, passages.samples(data, 20, 8), strict=True):
        assert (a == b).all()
    start = np.arange(0, 850)
    hashes = passages.span_hashes(data, start, start + 20)
    groups = defaultdict(set)
    for h, s in zip(hashes, start, strict=True):
        groups[bytes(data[s : s + 20])].add(h)
    assert all(len(g) == 1 for g in groups.values()) and len({h for g in groups.values() for h in g}) == len(groups)


def test_repeats_with_repeated_and_null_ids(spark):
    line = " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [line, line, line, "short"], ids=[7, 7, None, None]).coalesce(1)
    rows = suffix.remove_repeats(docs).collect()
    assert sorted(len(r["kept"]) for r in rows) == [0, 0, 5, len(line)]
    assert [len(r["kept"]) for r in rows if r["doc_id"] is None] in ([0, 5], [5, 0])
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
    kept = suffix.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert {(r["text"], r["n_chars"]) for r in kept.collect()} == {("", 0), (line, len(line)), ("short", 5)}


# ------------------------------------------------------------------ 8: language
def test_language_by_compression(spark):
    rng = random.Random(3)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(150)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwx"))}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(vocab) * 40)]
    rows += [(900, None, "aa"), (901, "123 !!", None), (902, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    learned = langid.learn_dictionaries(docs, F.col("doc_id") % 4 != 2)
    assert set(learned) == set(vocab) and all(len(d) <= langid.DICTIONARY_BYTES for d in learned.values())
    got = {r["doc_id"]: r for r in langid.identify(docs, learned).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["accepted"] for i, _, lang in rows[:-3])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.accepted_rows(docs, learned)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 3
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.learn_dictionaries(docs.limit(0), F.lit(True)) == {}


def test_language_of_very_long_text(spark):
    rng = random.Random(4)
    vocab = {lang: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2_000)] for lang in ("aa", "bb", "cc")}
    draw = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    learned = {lang: draw(lang, 10_000).encode() for lang in vocab}
    model = langid.Compressors(learned)
    texts = [(k, draw(lang, 600_000)) for k, lang in enumerate(vocab)]
    for lang, (_, text) in zip(vocab, texts, strict=True):
        found, margins = zip(*[(p[0], p[2]) for p in map(model.predict, (text[:10_000], text[:300_000], text))], strict=True)
        assert set(found) == {lang} and max(margins) < 2 * min(margins)
    assert langid.accepted_rows(spark.createDataFrame(texts, "doc_id long, text string"), learned).count() == 3


def test_language_sample_takes_distinct_pieces(spark):
    rng = random.Random(5)
    opening = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    own = lambda k: "".join(rng.choice("ijklmnop ") for _ in range(9_000)) + f" {k}"
    copy = own(-1)
    rows = [(k, opening + own(k), "aa") for k in range(150)] + [(200 + k, copy, "bb") for k in range(60)]
    rows += [(300 + k, own(k), "bb") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn_dictionaries(docs, F.lit(True))
    assert len(learned["aa"]) == langid.DICTIONARY_BYTES
    # mostly what follows the shared opening, and no piece twice
    assert sum(c in b"ijklmnop" for c in learned["aa"]) > langid.DICTIONARY_BYTES / 2
    pieces = learned["bb"].split(b"\n")
    assert len(pieces) == len(set(pieces)) == 6 and {len(p) for p in pieces} == {langid.PIECE_CHARS}


# ------------------------------------------------------------------ 9: simhash
def naive_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_match_brute_force(spark):
    texts = sample_texts(6) + ["A b c d", "a B c d", "q"]
    docs = documents(spark, texts)
    fps = {i: naive_fingerprint(t) for i, t in enumerate(texts)}
    roots = linked_roots(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for r in simhash.simhash_classes(docs).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == roots[r["doc_id"]]


def test_balls_connect_all_within_two_bits(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for _ in range(3):
            near = fp
            for _ in range(rng.randint(1, 3)):
                near ^= 1 << rng.randrange(64)
            fps.add(near)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = [(r["u"], r["v"]) for r in links.collect()]
    got = {f: f for f in signed}
    for r in simhash.components(links).collect():
        got[r["node"]] = r["root"]
    expected = linked_roots(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert got == expected
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)


def test_simhash_null_ids_and_empty(spark):
    docs = documents(spark, ["same text here", "same text here", None], ids=[None, None, 4])
    assert sorted((r["component_id"] is None) for r in simhash.simhash_classes(docs).collect()) == [False, True, True]
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_sha_of_whole_text():
    from ledgerloom.llm import passages

    assert passages.sha256(b"abc") == hashlib.sha256(b"abc").hexdigest()


# ------------------------------------------------------------------ near copies of the pipeline
def naive_shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_roots(texts: dict) -> dict:
    sets = {i: naive_shingles(t) for i, t in texts.items()}
    return linked_roots(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    bases = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(80, 300))) for _ in range(12)]
    texts = sample_texts(6) + [edited(rng, b, n) for b in bases for n in (0, 1, 2, 3, 5, 8)]
    chain = bases[0].split()
    texts += [" ".join(chain[k:] + [f"c{j}" for j in range(k)]) for k in range(0, 40, 4)]
    roots = near_roots(dict(enumerate(texts)))
    docs = documents(spark, texts).repartition(3)
    for rounds, few in ((near_copies.PIVOT_ROUNDS, near_copies.FEW), (6, 0), (0, 0)):
        monkeypatch.setattr(near_copies, "PIVOT_ROUNDS", rounds)
        monkeypatch.setattr(near_copies, "FEW", few)
        kept = near_copies.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    # the two-bit balls alone leave near copies behind
    classes = {r["component_id"] for r in simhash.simhash_classes(docs).collect()}
    assert len(classes) > len(set(roots.values()))


def test_boilerplate_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(13)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(300))
    compared = []

    def counted(pairs, sets, compare=near_copies._compared):
        compared.append(pairs.count())
        return compare(pairs, sets)

    monkeypatch.setattr(near_copies, "_compared", counted)
    for n, own in ((300, 120), (300, 60), (600, 60)):
        compared.clear()
        texts = [f"{shared} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(own)) for _ in range(n)]
        assert near_copies.keep_one(documents(spark, texts, extra=False)).count() == n
        assert sum(compared) <= 4 * n


def test_shingles_of_long_texts_in_parts():
    from ledgerloom.llm.shingles import shingle_hashes

    text = " ".join(sample_texts(3)[:8])
    for words in (1, 3, 5, 10**4):
        whole = np.concatenate(list(shingle_hashes(text, words)))
        for size in (1, 7, 100):
            assert np.array_equal(whole, np.concatenate(list(shingle_hashes(text, words, size=size))))
    assert not list(shingle_hashes(" \n", 5)) and not list(shingle_hashes(None, 5))


def test_pipeline_drops_near_copies(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    roots = near_roots({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))


def test_near_copies_null_ids_and_empty(spark):
    docs = documents(spark, ["same text here", "Same  text here", None, " "], ids=[None, None, 2**60 + 1, 2**60 + 2])
    assert [r["doc_id"] for r in near_copies.keep_one(docs).orderBy("doc_id").collect()] == [None, 2**60 + 1]
    assert near_copies.keep_one(docs.limit(0)).count() == 0
