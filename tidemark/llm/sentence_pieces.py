"""Encoding and decoding with a BPE piece model by rounds of merges in numpy.

A text is cut where white space starts; no piece of such a model continues past
that point, so each part is merged by itself and equal parts are merged once. All
parts of a batch lie in one flat array of symbols. A round looks up the rank of
every pair of neighbours, takes for each part its leftmost pair of best rank by a
segmented minimum, merges these all at once and closes the gaps, until no pair is
left. One pair per part and round keeps the order of a priority queue.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.recent import Recent

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NO_RANK = np.int64(1 << 30)
#: Symbols of a part above which a heap takes its merges; rounds would cost the square of its length.
LONG_PART = 2048
#: Characters that are encoded at a time, and parts that stay known.
GROUP_CHARS, KNOWN_PARTS = 1 << 20, 150_000

# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


class PieceModel:
    """Vocabulary and pair ranks of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, pieces: list[tuple[str, float, int]], eos: int):
        self.eos = eos
        self.pieces = [piece for piece, _, _ in pieces]
        self.types = [kind for _, _, kind in pieces]
        self.texts = [None if kind == BYTE else "" if kind == CONTROL else piece.replace(SPACE, " ") for piece, _, kind in pieces]
        self.numerals = [str(number) for number in range(len(pieces))]
        self.byte_ids = [self.pieces.index(f"<0x{value:02X}>") for value in range(256)]
        mergeable = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        symbols = dict(mergeable)
        for piece in mergeable:
            for char in piece:
                symbols.setdefault(char, len(pieces) + len(symbols))
        order = {score: rank for rank, score in enumerate(sorted({score for _, score, kind in pieces if kind == NORMAL}, reverse=True))}
        self.chars = {symbol: number for symbol, number in symbols.items() if len(symbol) == 1}
        self.base = max(symbols.values(), default=0) + 2
        pairs: dict[int, tuple[int, int]] = {}
        for piece, number in mergeable.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[pieces[number][1]], number)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, pieces = model.normalizer_spec, [(p.piece, p.score, p.type) for p in model.pieces]
        plain = normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap and normal.escape_whitespaces
        inside = any(SPACE in piece.lstrip(SPACE) for piece, _, kind in pieces if kind == NORMAL)
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or inside or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        return cls(pieces, model.trainer_spec.eos_id)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NO_RANK), self.merged[at]


def merge_rounds(model: PieceModel, parts: list[str]) -> list[list[int]]:
    """The symbols of each part after all merges; characters without a symbol are ``-1 - code point``."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    values, at = np.unique(points, return_inverse=True)
    numbers = np.array([model.chars.get(chr(v), -1 - v) for v in values.tolist()], np.int64)
    symbol = numbers[at] if len(values) else points
    part = np.repeat(np.arange(len(parts)), lengths)
    done: list[list[int]] = [[] for _ in parts]
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rank, merged = model.looked_up(symbol, np.r_[symbol[1:], -1])
        last = np.r_[starts[1:], len(symbol)] - 1
        rank[last] = NO_RANK
        best = np.minimum.reduceat(rank * len(symbol) + np.arange(len(symbol)), starts)
        place, open_ = best % len(symbol), best // len(symbol) < NO_RANK
        for s, e in zip(starts[~open_].tolist(), (last + 1)[~open_].tolist(), strict=True):
            done[part[s]] = symbol[s:e].tolist()
        place = place[open_]
        symbol[place] = merged[place]
        keep = np.repeat(open_, last + 1 - starts)
        keep[place + 1] = False
        symbol, part = symbol[keep], part[keep]
    return done


def merge_long(model: PieceModel, part: str) -> list[int]:
    """The same for one long part, with a heap of pairs."""
    symbol = [model.chars.get(c, -1 - ord(c)) for c in part]
    before, after = list(range(-1, len(symbol) - 1)), [*range(1, len(symbol)), -1]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right >= 0 and symbol[left] >= 0 and symbol[right] >= 0:
            known = model.pairs.get(symbol[left] * model.base + symbol[right])
            if known:
                heapq.heappush(heap, (known[0], left, symbol[left], symbol[right], known[1]))

    for i in range(len(symbol) - 1):
        offer(i, i + 1)
    gone = [False] * len(symbol)
    while heap:
        _, left, a, b, whole = heapq.heappop(heap)
        right = after[left]
        if gone[left] or right < 0 or symbol[left] != a or symbol[right] != b:
            continue
        symbol[left], gone[right] = whole, True
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [s for s, g in zip(symbol, gone, strict=True) if not g]


def piece_ids(model: PieceModel, symbols: list[int], part: str) -> list[int]:
    """Ids of the symbols; characters that are no piece become their bytes."""
    if min(symbols) >= 0 and max(symbols) < len(model.pieces):
        return symbols
    ids: list[int] = []
    at = 0
    for symbol in symbols:
        if 0 <= symbol < len(model.pieces):
            ids.append(symbol)
            at += len(model.pieces[symbol])
        else:
            ids += [model.byte_ids[value] for value in part[at].encode()]
            at += 1
    return ids


def encode_parts(model: PieceModel, parts: list[str]) -> list[list[int]]:
    """Ids of each part."""
    short = [p for p in parts if len(p) <= LONG_PART]
    symbols = dict(zip(short, merge_rounds(model, short), strict=True))
    return [piece_ids(model, symbols[p] if p in symbols else merge_long(model, p), p) for p in parts]


def parts_of(text: str) -> list[str]:
    """The parts of a text, with the dummy prefix; none for an empty text."""
    return PART.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _characters(octets: bytes) -> str:
    """UTF-8 as text, each byte that belongs to no character as U+FFFD."""
    out: list[str] = []
    at = 0
    while at < len(octets):
        for size in (1, 2, 3, 4):
            try:
                out.append(octets[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def decoded(model: PieceModel, ids: list[int]) -> str:
    """The pieces as text with blanks; control pieces are nothing, bytes that are no UTF-8 are U+FFFD."""
    whole = [model.texts[number] for number in ids]
    if None not in whole:
        return "".join(whole)
    out: list[str] = []
    held = bytearray()
    for number in [*ids, -1]:
        if number >= 0 and model.types[number] == BYTE:
            held.append(int(model.pieces[number][3:5], 16))
            continue
        if held:
            out.append(_characters(bytes(held)))
            held.clear()
        if number >= 0:
            out.append(model.texts[number])
    return "".join(out)


def decode(model: PieceModel, ids: list[int]) -> str:
    """The text of ids, without the blank of the dummy prefix."""
    text = decoded(model, ids)
    return text.removeprefix(" ")


class Encoder:
    """Encodes many texts, keeping the parts it met last."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.recent = Recent(KNOWN_PARTS)

    def learn(self, parts: set[str]) -> dict[str, tuple[int, str, str]]:
        new = self.recent.missing(parts)
        known, numerals = self.recent.known, self.model.numerals
        for part, ids in zip(new, encode_parts(self.model, new), strict=True):
            known[part] = (len(ids), " ".join([numerals[i] for i in ids]), decoded(self.model, ids))
        return known

    def groups(self, texts: Iterator[str]) -> Iterator[list[list[str]]]:
        """The parts of texts, of about ``GROUP_CHARS`` characters at a time."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(parts_of(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group

    def encode(self, texts: Iterator[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids with blanks, decoded text) of each text; an end id follows the last part."""
        for group in self.groups(texts):
            known = self.learn(set().union(*group))
            for parts in group:
                found = [known[p] for p in parts]
                ids = " ".join([*(f[1] for f in found), str(self.model.eos)])
                yield sum(f[0] for f in found) + 1, ids, "".join(f[2] for f in found).removeprefix(" ")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, then ``ids`` (array of int) and ``decoded``.

    With ``digests`` the lists and texts are replaced by ``ids_sha256`` (of the
    decimal ids joined by a blank) and ``decoded_sha256``. An end id closes every
    text; null and empty texts have it alone and decode to the empty text. Other
    columns are not read. An empty table gives an empty result. The model is read on
    the driver and travels with the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            counts, ids, texts_out = [], [], []
            for count, id_text, text in encoder.encode(texts):
                counts.append(count)
                ids.append(hashlib.sha256(id_text.encode()).hexdigest() if digests else [int(x) for x in id_text.split(" ")])
                texts_out.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(texts_out, pa.string())], names=columns)

    schema = f"doc_id long, n_tokens long, {columns[2]} {'string' if digests else 'array<int>'}, {columns[3]} string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, schema)
