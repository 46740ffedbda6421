"""Alignment of two tokenizers over whole texts by diagonal run skipping, and counts of the id pairs it links."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches
from ledgerloom.llm.packing import byte_letters
from ledgerloom.session import stage

# Characters that are aligned at a time, and characters of a run of texts that asks for its pairs' counts together.
SEGMENT_CHARS = 500_000
RUN_CHARS = 8_000_000
# Units that are remembered before the older half is forgotten.
REMEMBERED = 200_000
# Units fewer than these are encoded one by one.
JOINED_UNITS = 8
# Links of a unit beyond which its alignment isn't remembered with its ids.
UNIT_LINKS = 1_024
# Links of a group beyond which its pairs are counted from distinct ids, and how many pairs that makes at a time.
LARGE_GROUP = 65_536
# A unit begins with a space or line feed that follows no white space, and reaches up to the next such one: there both
# tokenizers end a token, whatever comes before or after.
_UNIT = re.compile(r"[ \n][^ \n]*(?:(?<=\s)[ \n][^ \n]*)*")
_CUT = re.compile(r"(?<=\S)[ \n]")
_aligners: dict[tuple[str, str], Aligner] = {}


class Aligner(dict):
    """Token ids that both tokenizers give for the units of texts, and their alignment, with the units remembered.

    Both tokenizers end a token where a unit ends, so no group reaches over one. A value holds the ids of A and of B,
    the linked pairs and the groups' text as bytes, the last two None for a unit of more than UNIT_LINKS links. It is
    None where the tokens of either don't spell the unit.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = {ord(letter): byte for byte, letter in byte_letters().items()}
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [bytes(map(letters.__getitem__, map(ord, entry))) for entry, _ in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") or "\n" in piece for piece in pieces):
            raise ValueError(f"{b_path} has pieces that reach over a space or line feed")
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids are kept in 16 bits: a vocabulary has more entries")
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # decimal ids with what follows them: within a group, between its sides, at its end
        numbers = [[str(i) + end for i in range(len(self.a_bytes))] for end in ",|"]
        numbers += [[str(i) + end for i in range(len(self.b_bytes))] for end in ",;"]
        self.texts = np.array([x for part in numbers for x in part], dtype=object)
        self.text_size = np.array(list(map(len, self.texts)), dtype=np.int64)
        self.old: dict = {}

    def _spells(self, unit: str, a: list[int], b: list[int]) -> bool:
        data = unit.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def learn(self, units: list[str]) -> None:
        """Remember all of ``units``, which begin with a space or line feed."""
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        new = [unit for unit in set(units) if unit not in self]
        if old := [unit for unit in new if unit in self.old]:
            self.update(zip(old, map(self.old.__getitem__, old), strict=True))
            new = [unit for unit in new if unit not in self.old]
        # a unit that ends in white space may share a token with what follows it
        self._learn_one_by_one([unit for unit in new if unit[-1].isspace()])
        self._learn_joined([unit for unit in new if not unit[-1].isspace()])

    def _learn_joined(self, units: list[str]) -> None:
        """Encode units that end in no white space as one text and cut its ids where the units end."""
        first = next((i for i, unit in enumerate(units) if unit[0] == " "), None)
        if len(units) < JOINED_UNITS or first is None:
            return self._learn_one_by_one(units)
        # B adds a space itself: a unit that begins with one goes first
        units[0], units[first] = units[first], units[0]
        text = "".join(units)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        ends = np.cumsum([len(unit) for unit in (units if text.isascii() else map(str.encode, units))])
        cuts = self._cuts(a, self.a_size, ends), self._cuts(b, self.b_size, ends)
        if any(cut is None for cut in cuts) or not self._spells(text, a, b):
            # some unit isn't spelled: halves without it are still encoded together
            half = len(units) // 2
            self._learn_joined(units[:half])
            return self._learn_joined(units[half:])
        self._remember(units, a, b, *cuts)

    @staticmethod
    def _cuts(ids: list[int], sizes: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many ids there are up to the end of each unit; None unless tokens end where all units do."""
        reached = np.cumsum(sizes[ids])
        last = np.searchsorted(reached, ends)
        if not len(reached) or last[-1] >= len(reached) or (reached[last] != ends).any():
            return None
        return last + 1

    def _remember(self, units: list[str], a: list[int], b: list[int], a_to: np.ndarray, b_to: np.ndarray) -> None:
        """Align the units' ids, given in turn and up to where each unit's end, and keep both by unit."""
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        values = [_cut(x.astype("<u2").tobytes(), to * 2) for x, to in ((a, a_to), (b, b_to))]
        a_at, b_at = group_starts(self.a_size[a], self.b_size[b])
        # links up to the end of each unit, where a group ends
        so_far = np.cumsum(np.diff(a_at) * np.diff(b_at))[np.searchsorted(a_at, a_to) - 1]
        wide = np.diff(so_far, prepend=0) > UNIT_LINKS
        if wide.any():
            a_ids, b_ids = map(list, values)
            for i in np.flatnonzero(wide):
                self[units[i]] = a_ids[i], b_ids[i], None, None
            rest = np.flatnonzero(~wide)
            if len(rest):
                a_n, b_n = (np.diff(to, prepend=0) for to in (a_to, b_to))
                a, b = a[np.repeat(~wide, a_n)], b[np.repeat(~wide, b_n)]
                self._remember([units[i] for i in rest], a, b, np.cumsum(a_n[rest]), np.cumsum(b_n[rest]))
            return
        pairs = _group_pairs(a, b, a_at, b_at, np.arange(len(a_at) - 1), len(self.b_bytes))
        codes = _text_codes(self, a, b, a_at, b_at)
        said = "".join(self.texts[codes].tolist()).encode()
        # two ids of 16 bits make a pair of 32
        values += [_cut(pairs.astype("<u4").tobytes(), so_far * 4), _cut(said, np.cumsum(self.text_size[codes])[a_to + b_to - 1])]
        self.update(zip(units, zip(*values, strict=True), strict=True))

    def _learn_one_by_one(self, new: list[str]) -> None:
        if not new:
            return
        by_a = self.a.encode_batch_fast(new, add_special_tokens=False)
        # B adds a space itself, but not to an empty text; before a line feed it is one too many
        by_b = self.b.encode([unit.removeprefix(" ") for unit in new], num_threads=1)
        spelled, all_a, all_b, a_n, b_n = [], [], [], [], []
        for unit, a, b in zip(new, by_a, by_b, strict=True):
            if unit[0] == "\n":
                b = b[1:] if b[0] == self.space else []
            elif len(unit) == 1:
                b = [self.space]
            if not self._spells(unit, a.ids, b):
                self[unit] = None
                continue
            spelled.append(unit)
            all_a += a.ids
            all_b += b
            a_n.append(len(a.ids))
            b_n.append(len(b))
        if spelled:
            self._remember(spelled, all_a, all_b, np.cumsum(a_n), np.cumsum(b_n))

    def found(self, part: str) -> list[tuple] | None:
        """Values of a part's units in turn, or None where tokens don't spell one of them."""
        units = units_of(part)
        values = list(map(self.get, units))
        if not all(values):
            missing = [i for i, value in enumerate(values) if value is None]
            self.learn([units[i] for i in missing])
            for i in missing:
                values[i] = self[units[i]]
            if not all(values):
                return None
        return values

    def segments(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of A and B of the parts of space+text, or None where the text has no tokens."""
        return self._over_parts(text, _ids, lambda a, b: (a, b))

    def aligned(self, text: str) -> Iterator[tuple] | None:
        """Numbers of A's and B's tokens, groups and links of the parts of space+text, their linked pairs in order, how
        often each is linked, and the groups' text with a semicolon behind each; None where the text has no tokens."""
        return self._over_parts(text, self._joined, self._by_ids)

    def _joined(self, values: list[tuple]) -> tuple:
        a, b, pairs, said = zip(*values, strict=True)
        if not all(pairs):
            return self._by_ids(*_ids(values))
        said, pairs = b"".join(said), np.frombuffer(b"".join(pairs), dtype="<u4")
        distinct, times = np.unique(pairs, return_counts=True)
        totals = sum(map(len, a)) // 2, sum(map(len, b)) // 2, said.count(b"|"), len(pairs)
        return *totals, distinct.astype(np.int64), times.astype(np.int64), said

    def _by_ids(self, a: np.ndarray, b: np.ndarray) -> tuple:
        a_at, b_at = group_starts(self.a_size[a], self.b_size[b])
        pairs, n = links(a, b, a_at, b_at, len(self.b_bytes))
        totals = len(a), len(b), len(a_at) - 1, int(n.sum())
        return *totals, *_merged(pairs, n), groups_text(self, a, b, a_at, b_at).encode()

    def _over_parts(self, text: str, of_values: Callable, of_ids: Callable) -> Iterator | None:
        if not text:
            return None
        parts = list(_parts(" " + text))
        if len(parts) > 1:
            # all parts must spell the text before the first one counts
            if any(self.found(part) is None for part in parts):
                return self._whole(text, of_ids)
            return (of_values(self.found(part)) for part in parts)
        values = self.found(parts[0])
        return iter([of_values(values)]) if values else self._whole(text, of_ids)

    def _whole(self, text: str, of_ids: Callable) -> Iterator | None:
        """For a text of which some unit isn't spelled: both tokenizers on the whole text decide."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not self._spells(" " + text, a, b):
            return None
        return iter([of_ids(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))])


def _cut(data: bytes, ends: np.ndarray) -> Iterator[bytes]:
    """Parts of ``data`` that end at ``ends``."""
    ends = ends.tolist()
    return map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))


def _ids(values: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A and B of units in turn."""
    a, b, _, _ = zip(*values, strict=True)
    return tuple(np.frombuffer(b"".join(x), dtype="<u2").astype(np.int64) for x in (a, b))


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, one for a Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def units_of(text: str) -> list[str]:
    """Units of a text that begins with a space or line feed."""
    return _UNIT.findall(text)


def _parts(text: str) -> Iterator[str]:
    """Parts of about SEGMENT_CHARS characters that begin where units begin."""
    at = 0
    while len(text) - at > SEGMENT_CHARS and (found := _CUT.search(text, at + SEGMENT_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def diagonal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Stretches of one-to-one tokens of two ascending lists of byte ends with the same last one.

    A stretch ``(i, j, k)`` says that ends i.. of ``a`` and j.. of ``b`` are equal for k tokens; between its end and the
    next stretch lies one group that is not one-to-one. At the index shift j - i windows of growing size
    are compared until one differs, the first difference is found by halving; the group there is walked
    token by token until both sides end together, which gives the next shift.
    """
    runs, i, j, n = [], 0, 0, len(a)
    while i < n:
        k, step = 0, 1
        while i + k < n and a[i + k : i + k + step] == b[j + k : j + k + step]:
            k += step
            step *= 2
        while step > 1 and i + k < n:
            step //= 2
            if a[i + k : i + k + step] == b[j + k : j + k + step]:
                k += step
        k = min(k, n - i)
        runs.append((i, j, k))
        i, j = i + k, j + k
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
    return runs


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... sizes[0] of them, then those of starts[1], and so on."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def group_starts(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of A and of B of every group, from the tokens' sizes in bytes; both end with the number of tokens."""
    runs = diagonal_runs(np.cumsum(a_size).tolist(), np.cumsum(b_size).tolist())
    i, j, k = np.array([*runs, (len(a_size), len(b_size), 0)], dtype=np.int64).T
    # a stretch's tokens are groups of their own; one more begins behind it unless the next stretch does
    groups = k + (np.append(i[1:], len(a_size)) > i + k)
    return (np.append(_ranges(x, groups), size) for x, size in ((i, len(a_size)), (j, len(b_size))))


def _group_pairs(
    a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, groups: np.ndarray, width: int
) -> np.ndarray:
    """Linked id pairs of the groups chosen, group by group."""
    n_a, n_b = np.diff(a_at)[groups], np.diff(b_at)[groups]
    sizes = n_a * n_b
    group = np.repeat(np.arange(len(groups)), sizes)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = place // n_b[group], place % n_b[group]
    return a[a_at[groups][group] + row] * width + b[b_at[groups][group] + col]


def links(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked id pairs (``a * width + b``) and how often each is linked; a pair may come several times."""
    small = np.flatnonzero(np.diff(a_at) * np.diff(b_at) <= LARGE_GROUP)
    pairs = [_group_pairs(a, b, a_at, b_at, small, width)]
    times = [np.ones(len(pairs[0]), dtype=np.int64)]
    for g in np.flatnonzero(np.diff(a_at) * np.diff(b_at) > LARGE_GROUP):
        own_a, of_a = np.unique(a[a_at[g] : a_at[g + 1]], return_counts=True)
        own_b, of_b = np.unique(b[b_at[g] : b_at[g + 1]], return_counts=True)
        pairs.append((own_a[:, None] * width + own_b).ravel())
        times.append((of_a[:, None] * of_b).ravel())
    return np.concatenate(pairs), np.concatenate(times)


def _merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their times."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, times, len(distinct)).astype(np.int64)


def groups_text(model: Aligner, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3;``: with a semicolon behind the last one too."""
    return "".join(model.texts[_text_codes(model, a, b, a_at, b_at)].tolist())


def _text_codes(model: Aligner, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Places in ``model.texts`` of what is said of each token."""
    of_a, of_b = len(model.a_bytes), len(model.b_bytes)
    code_a, code_b = a.copy(), b + 2 * of_a
    code_a[a_at[1:] - 1] += of_a
    code_b[b_at[1:] - 1] += of_b
    # every token's place: behind all tokens of earlier groups, B behind A
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + np.repeat(b_at[:-1], n_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(a_at[1:], n_b)] = code_b
    return codes


class _Run:
    """Documents that are counted together: their digests, and the pairs that each of them links."""

    def __init__(self, model: Aligner):
        self.model, self.ids, self.rows, self.keys, self.times, self.chars = model, [], [], [], [], 0

    def add(self, row_id, text: str | None) -> None:
        text = text or ""
        digest, totals = hashlib.sha256(), np.zeros(4, dtype=np.int64)
        parts, held = self.model.aligned(text), b""
        keys, times = [], []
        for *numbers, pairs, n, said in parts or ():
            totals += numbers
            # the last semicolon is none of the document's
            digest.update(held)
            digest.update(memoryview(said)[:-1])
            held = b";"
            keys.append(pairs)
            times.append(n)
        if len(keys) > 1:
            keys, times = ([x] for x in _merged(np.concatenate(keys), np.concatenate(times)))
        self.keys.append(keys[0] if keys else np.zeros(0, dtype=np.int64))
        self.times.append(times[0] if times else np.zeros(0, dtype=np.int64))
        self.ids.append(row_id)
        self.rows.append((*totals.tolist(), "" if parts is None else digest.hexdigest()))
        self.chars += len(text)

    def batch(self, number: int) -> pa.RecordBatch:
        pairs, code = np.unique(np.concatenate(self.keys), return_inverse=True)
        owner = np.repeat(np.arange(len(self.ids)), [len(k) for k in self.keys])
        # documents and places of their pairs ascend, so differences are small
        steps = np.diff(owner * max(len(pairs), 1) + code, prepend=0)
        coder = zstandard.ZstdCompressor(level=1)
        n_a, n_b, n_groups, n_links, digest = zip(*self.rows, strict=True)
        columns = {
            "run": pa.array([number], pa.int64()),
            "id": pa.array([self.ids], pa.list_(pa.string())),
            **{
                name: pa.array([list(x)], pa.list_(pa.int64()))
                for name, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))
            },
            "groups_sha256": pa.array([list(digest)], pa.list_(pa.string())),
            "pairs": pa.array([pairs], pa.list_(pa.int64())),
            "holders": pa.array([np.bincount(code, minlength=len(pairs))], pa.list_(pa.int64())),
            "steps": pa.array([coder.compress(steps.astype("<i8").tobytes())], pa.binary()),
            "times": pa.array([coder.compress(np.concatenate(self.times).astype("<i8").tobytes())], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


def _aligned_runs(slim: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a run of documents: their digests, the run's distinct pairs with holders, and each document's pairs."""

    def run(batches):
        model, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        held = _Run(model)
        for batch in batches:
            for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                held.add(row_id, text.as_py())
                if held.chars >= RUN_CHARS or len(held.ids) >= RUN_CHARS // 100:
                    yield held.batch(number)
                    held, number = _Run(model), number + 1
        if held.ids:
            yield held.batch(number)

    counts = ", ".join(f"{name} array<long>" for name in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"run long, id array<string>, {counts}, groups_sha256 array<string>, pairs array<long>, holders array<long>"
    return map_batches(slim, run, f"{schema}, steps binary, times binary")


def pair_counts(runs: DataFrame, width: int) -> DataFrame:
    """``pair``, ``count`` (documents that hold it linked) and ``best``: whether no pair of its A id has more.

    A ids are as many as A's vocabulary has entries, which bounds the broadcast of their highest counts.
    """
    held = runs.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.pairs", "x.holders")
    counts = stage(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("count")), "pair_counts")
    a_id = F.floor(F.col("pair") / width).alias("a_id")
    highest = counts.groupBy(a_id).agg(F.max("count").alias("highest"))
    both = counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id")
    return both.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment_digests(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Digest of the alignment of every text, encoded by tokenizer A (byte-level) and B (pieces with byte fallback).

    Token bytes of both spell a space and the text; offsets where both end a token cut them into groups, all pairs
    of a group are linked, and a pair's count is the number of documents that hold it linked. Returns
    ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links of the highest count of their A id),
    ``count_sum`` and ``groups_sha256``. Null and empty texts and those that either tokenizer doesn't spell have zeros and an
    empty digest. Rows that repeat an id are documents of their own, other columns are not read, an empty table gives no rows.

    Runs of documents ask for the counts of the distinct pairs they hold, and Spark brings the answers back to the
    run. A text is aligned a part at a time; memory of a task follows a run and its longest stretch without a space or line feed.
    """
    # ids travel as text: lists of integers with nulls would become floats
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    runs = stage(_aligned_runs(slim, a_path, b_path), "aligned_runs")
    width = len(aligner(a_path, b_path).b_bytes)
    asked = runs.select(F.col("run").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(runs, width), "pair").select("of", "place", "count", "best")

    def score(key, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        coder = zstandard.ZstdDecompressor()
        count, best = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
        count[known["place"]], best[known["place"]] = known["count"], known["best"]
        own = frame.iloc[0]
        at = np.cumsum(np.frombuffer(coder.decompress(own["steps"]), dtype="<i8"))
        times = np.frombuffer(coder.decompress(own["times"]), dtype="<i8")
        owner, code = at // max(len(known), 1), at % max(len(known), 1)
        sums = np.zeros((2, len(own["n_a"])), dtype=np.int64)
        np.add.at(sums[0], owner, best[code] * times)
        np.add.at(sums[1], owner, count[code] * times)
        columns = {name: own[name] for name in ("id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": own["groups_sha256"]}
        return pd.DataFrame({name: list(values) for name, values in columns.items()})

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = "id string, " + ", ".join(f"{name} long" for name in names) + ", groups_sha256 string"
    scored = runs.drop("pairs", "holders").groupBy("run").cogroup(answers.groupBy("of")).applyInPandas(score, schema)
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *names, "groups_sha256")


def aligned_groups(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The groups themselves: ``id_col``, ``part``, and ``a``, ``b`` (arrays of the groups' id arrays).

    One row for each part of a text (of about SEGMENT_CHARS characters; most texts are one part), none for
    texts without tokens.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        model = aligner(a_path, b_path)
        for batch in batches:
            kind = batch.schema.field("id").type
            for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                for n, (a, b) in enumerate(model.segments(text.as_py() or "") or ()):
                    a_at, b_at = group_starts(model.a_size[a], model.b_size[b])
                    sides = [
                        pa.array([np.split(x, at[1:-1])], pa.list_(pa.list_(pa.int64()))) for x, at in ((a, a_at), (b, b_at))
                    ]
                    ids = pa.array([row_id], kind)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n]), *sides], names=["id", "part", "a", "b"])

    kind = slim.schema["id"].dataType.simpleString()
    found = map_batches(slim, run, f"id {kind}, part long, a array<array<long>>, b array<array<long>>")
    return found.withColumnRenamed("id", id_col)
