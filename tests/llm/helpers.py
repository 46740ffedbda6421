"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import random

WORDS = "the of and to in is that was for on are with as his they at be this from have or by one had".split()

# Names that operators use themselves, as extra columns of an input.
CLASHING = ("id", "row", "ord", "key", "n", "size", "_id", "_row", "rest", "run", "train", "text_", "root", "fp", "tile", "part")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sample_texts(seed: int = 1, n: int = 30) -> list[str | None]:
    rng = random.Random(seed)
    texts: list[str | None] = [sentence(rng, rng.randint(1, 60)) for _ in range(n)]
    shared = sentence(rng, 40)
    texts += [f"{sentence(rng, 5)} {shared} {sentence(rng, 5)}" for _ in range(4)]
    texts += [texts[0], texts[0], None, "", "   ", "ab" * 400, "é" * 150, "x", "Ünï 名前 😀 tail", "..!! 123", "wort " * 3000]
    return texts


def documents(spark, texts, ids=None, extra: bool = True):
    """A documents table with one row per text; ``extra`` adds columns with clashing names."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, ("en", "de", None)[k % 3], ("b", None, "a", "c")[k % 4], None if t is None else len(t))
        + (tuple(f"{c}{k}" for c in CLASHING) if extra else ())
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        names += "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, names)


def linked_roots(ids, linked) -> dict:
    """Smallest id reachable over the pairs for which ``linked`` holds."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
