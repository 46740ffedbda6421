"""Packing of tokenized documents along a space-filling curve."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_PATTERN, map_frames, text_slices
from ledgerloom.llm.ordering import range_sorted, running_total
from ledgerloom.session import stage

SEQUENCE = 4096
END_ID = 2
DIMENSIONS = 3
BITS = 16
BUCKETS = 512
# Pieces an encoder remembers before the older half is forgotten, and characters it cuts at a time.
REMEMBERED = 200_000
SEGMENT_CHARS = 1_000_000
# Texts of printable ASCII, Latin-1 and the six bytes that words are cut at: none of their characters changes or
# joins another when a text is normalised, but for the case.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff\x20\x09-\x0d]*")
_SPACE = re.compile(r"[\x20\x09-\x0d]")
_WORD = re.compile(WORD_PATTERN)
_encoders: dict[str, Encoder] = {}


class Encoder(dict):
    """Token ids of texts, exactly as the tokenizer gives them, with pieces of words remembered.

    Only for tokenizers that drop white space and never join across it: then a text's ids are those of
    its words in turn. Plain texts are cut by the tokenizer's own pattern, whose pieces go to its model
    directly; of all others each word that is not plain goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        setup = json.loads(self.tokenizer.to_str())
        split = (setup["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} doesn't drop white space between words")
        lowers = any(n["type"] == "Lowercase" for n in setup["normalizer"]["normalizers"])
        self.lower = str.lower if lowers else str
        self.special = [t["content"] for t in setup["added_tokens"]]
        # the classes of the pattern, spelled out for the characters of plain texts
        pattern = split["pattern"]["Regex"]
        for name in ("L", "N"):
            chars = regex.findall(rf"\p{{{name}}}", "".join(map(chr, range(0x21, 0x100))))
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(map(re.escape, chars)))
        self.pattern = re.compile(pattern)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65_536 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.bytes_as = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        """Ids of a piece of a plain text, or of a whole word that is not plain."""
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii():
                found = [t.id for t in self.model.tokenize(piece)]
            else:
                found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes_as))]
            ids = array(self.code, found).tobytes()
        self[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        found = []
        for part in _segments(text):
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            found.append(b"".join(map(self.__getitem__, self.pattern.findall(self.lower(part)))))
        return b"".join(found)

    def _other(self, text: str) -> bytes:
        """Ids of a text with characters that are not plain, or with a special token."""
        words = _WORD.findall(text)
        odd = [w for w in set(words) if not self._is_plain(w)]
        known = {}
        for at in range(0, len(odd), 10_000):
            part = odd[at : at + 10_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = array(self.code, got.ids).tobytes()
        return b"".join(known[w] if w in known else self._plain(w) for w in words)

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = (self._plain(t) if self._is_plain(t) else self._other(t) for t in texts)
        return [np.frombuffer(ids, dtype=self.kind) for ids in found]


def _segments(text: str) -> Iterator[str]:
    """Parts of about SEGMENT_CHARS characters, cut at white space."""
    at = 0
    while len(text) - at > SEGMENT_CHARS and (space := _SPACE.search(text, at + SEGMENT_CHARS)):
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def byte_letters() -> dict[int, str]:
    """Letter that byte-level models write for each byte: printable Latin-1 stays, others follow from U+0100 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(0x100 + n) for n, b in enumerate(moved)}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one for a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of every row of ``cells`` (integers below 2**bits).

    Works down the bits of all rows at once: at each level a set bit reflects the lower bits of the
    first axis, a clear one swaps them with the first axis' (the published transpose method);
    a Gray decoding and bit interleaving follow.
    """
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for a in range(axes):
            on = (x[a] >> np.uint64(level)) & one == one
            swap = np.where(on, np.uint64(0), (x[0] ^ x[a]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[a] = x[a] ^ swap if a else x[a]
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << one) | ((x[a] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_cells(ids: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Grid cell of each document: hashed term vector, projected to a few dimensions.

    Ids are hashed into BUCKETS, counts damped by the square root, the vector scaled to length 1,
    projected by fixed random directions and squashed to the grid.
    """
    directions = np.random.default_rng(7).standard_normal((BUCKETS, dimensions))
    vectors = np.zeros((len(ids), BUCKETS))
    for row, own in zip(vectors, ids, strict=True):
        hashed = (own.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(23)
        row[:] = np.sqrt(np.bincount(hashed.astype(np.int64) % BUCKETS, minlength=BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    squashed = 1 / (1 + np.exp(-1.7 * (vectors @ directions)))
    return np.minimum((squashed * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def tail_sequences(length: int) -> list[tuple[int, int]]:
    """Start and length of the sequences of the last ``length`` ids: powers of two, largest first."""
    found, start = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            found.append((start, 1 << bit))
            start += 1 << bit
    return found


def cut(start: int, length: int, total: int, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Pieces ``(ids before, length, sequence_id, offset)`` of a document at global ids start..start+length."""
    full = total // sequence * sequence
    ends = []
    at, end = start, start + length
    while at < min(end, full):
        stop = min(end, (at // sequence + 1) * sequence)
        ends.append((at - start, stop - at, at // sequence, at % sequence))
        at = stop
    if at < end:
        for number, (low, size) in enumerate(tail_sequences(total - full)):
            a, b = max(at, full + low), min(end, full + low + size)
            if a < b:
                ends.append((a - start, b - a, full // sequence + number, a - full - low))
    return ends


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of ``sequence`` ids.

    A document is its ids and ``end_id``; null texts are empty ones. Documents are range-sorted by
    the Hilbert key of their projected hashed vector, so neighbours share a sequence, and laid end to
    end; sequences are cut every ``sequence`` ids. What is left at the end of the whole table goes
    into sequences of powers of two, so none is padded. Returns ``id_col``, ``start``, ``length``, ``ids`` (binary, little-endian
    unsigned 32 bits), ``doc_tokens``, ``sequence_id`` and ``offset``. Rows that repeat an id
    are documents of their own; equal keys go by a hash of the id. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches):
            ids = encoder(tokenizer).encode(part["text"].tolist())
            yield pd.DataFrame(
                {
                    "_id": part["_id"],
                    "key": hilbert_keys(curve_cells(ids)),
                    "n": [len(x) + 1 for x in ids],
                    "ids": [x.tobytes() for x in ids],
                }
            )

    encoded = map_frames(slim, run, f"_id {kind}, key long, n long, ids binary")
    encoded = stage(encoded.withColumn("_row", F.monotonically_increasing_id()), "ids")
    mark = F.xxhash64(F.col("_id").cast("string"))
    order = [F.col("key"), F.col("mark"), F.col("_row")]
    curve = range_sorted(encoded.select("_row", "key", mark.alias("mark"), "n"), order, "curve")
    total = curve.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = running_total(curve, order, "n", "_end").select("_row", (F.col("_end") - F.col("n")).alias("at"))

    def pieces(batches):
        width = np.dtype(encoder(tokenizer).kind)
        for frame in batches:
            found = []
            for doc, n, raw, at in zip(frame["_id"], frame["n"], frame["ids"], frame["at"], strict=True):
                ids = np.append(np.frombuffer(raw, dtype=width), end_id).astype("<u4")
                for before, length, number, offset in cut(at, n, total, sequence):
                    found.append((doc, before, length, ids[before : before + length].tobytes(), n, number, offset))
            names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            out = pd.DataFrame(found, columns=names)
            yield out.astype({"_id": frame["_id"].dtype}) if len(out) else out

    laid = encoded.select("_row", "_id", "n", "ids").join(placed, "_row").select("_id", "n", "ids", "at")
    return map_frames(
        laid,
        pieces,
        f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    ).withColumnRenamed("_id", id_col)
