"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A batch of texts is cut wherever two neighbouring characters stand side by side in no piece: no merge can cross such a
place.  The distinct units between cuts are concatenated and indexed by a suffix array (prefix doubling up to the longest
piece).  Every piece of the vocabulary is found in it by binary search, which gives the range of its occurrences; the
occurrences are edges from a start to an end.  Sorted by position they are relaxed in rounds: an edge that joins
exactly two current symbols is live, and of each unit's live edges the best by score, leftmost on ties, is merged,
until none is live - the order in which the model's own encoder merges.  Characters without a piece become their bytes.

Work per slice of text is bounded by SLICE_CHARS or the longest text; no shuffle.

Defined cases: null and empty texts have no ids and decode to the empty text; the character U+2581 in a text decodes to a
space, as in the model's own decoder; repeated rows and null ids are kept; an empty table gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_CHARS = 1 << 21
_SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Longer units are merged one by one with a heap.
_LONG = 256


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only BPE models with identity normalisation and without user-defined symbols are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.unknown = proto.trainer_spec.unk_id
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.bytes_of: list[bytes] = []
        self.is_byte = np.zeros(len(proto.pieces), bool)
        pieces = []
        for k, p in enumerate(proto.pieces):
            raw = p.piece.replace(_SPACE, " ").encode()
            if p.type == _BYTE:
                raw = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[raw[0]] = k
                self.is_byte[k] = True
            elif p.type == _CONTROL:
                raw = b""
            elif p.type == _UNKNOWN:
                raw = proto.trainer_spec.unk_surface.encode()
            elif p.piece:
                pieces.append((p.piece, p.score, k))
            self.bytes_of.append(raw)
        chars = sorted({c for p, _, _ in pieces for c in p})
        self.char_of = np.zeros(0x110000, np.int32)  # dense number from 1; 0: in no piece
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.full(len(chars) + 1, -1, np.int32)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        long = []
        for p, score, k in pieces:
            code = [int(self.char_of[ord(c)]) for c in p]
            if len(code) == 1:
                self.single[code[0]] = k
            else:
                long.append((code, score, k))
                self.beside[code[:-1], code[1:]] = True
        long.sort(key=lambda x: x[0])
        self.width = max((len(c) for c, _, _ in long), default=1)
        self.table = np.zeros((len(long), self.width), np.int32)
        for row, (code, _, _) in zip(self.table, long, strict=True):
            row[: len(code)] = code
        self.length = np.array([len(c) for c, _, _ in long], np.int64)
        self.piece = np.array([k for _, _, k in long], np.int32)
        scores = np.array([s for _, s, _ in long])
        self.order = np.searchsorted(np.unique(-scores), -scores).astype(np.int64)  # 0 is merged first


@lru_cache(maxsize=2)
def model(path: str = MODEL) -> Model:
    return Model(path)


def suffix_array(text: np.ndarray, width: int) -> np.ndarray:
    """Places of ``text`` (small integers) in order of the ``width`` characters from there on."""
    rank = text.astype(np.int64)
    k = 1
    while k < width:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * np.int64(len(rank) + int(text.max(initial=0)) + 2) + ahead, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def occurrences(m: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row of the piece table) of every occurrence of every piece of two characters or more."""
    index = suffix_array(text, m.width)
    padded = np.concatenate([text, np.zeros(m.width, text.dtype)])
    step = np.arange(m.width)
    inside = step < m.length[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(m.length), np.int64), np.full(len(m.length), len(text), np.int64)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo]) // 2
            there, own = padded[index[mid][:, None] + step], m.table[todo]
            differs = (there != own) & inside[todo]
            at = differs.argmax(axis=1)
            row = np.arange(len(todo))
            some = differs[row, at]
            less = np.where(some, there[row, at] < own[row, at], after)
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)

    low = bound(False)
    times = bound(True) - low
    which = np.repeat(np.arange(len(times)), times)
    within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return index[low[which] + within], which


def _relax(m: Model, bounds: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges within units bounds[i]:bounds[i+1]; returns symbol starts, next symbol of each start, and the piece row that made it (-1: a character)."""
    n = int(bounds[-1])
    start, after, made = np.ones(n + 1, bool), np.arange(1, n + 2), np.full(n, -1, np.int64)
    unit = np.searchsorted(bounds, place, side="right") - 1
    order = np.lexsort((m.length[which], place))  # edges by position
    place, which, unit = place[order], which[order], unit[order]
    end = place + m.length[which]
    short = np.diff(bounds)[unit] <= _LONG
    for u in np.unique(unit[~short]):
        mine = unit == u
        _relax_long(m, place[mine], end[mine], which[mine], start, after, made, int(bounds[u + 1]))
    place, which, unit, end = place[short], which[short], unit[short], end[short]
    while len(place):
        second = after[place]
        live = start[place] & (second < end)
        live[live] = after[second[live]] == end[live]
        at = np.flatnonzero(live)
        if not len(at):
            break
        owner = unit[at]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        value = m.order[which[at]] * (_LONG + 1) + (place[at] - bounds[owner])
        least = np.minimum.reduceat(value, heads)
        group = np.cumsum(np.append(False, owner[1:] != owner[:-1]))
        won = at[value == least[group]]
        s, e = place[won], end[won]
        start[after[s]] = False
        after[s], made[s] = e, which[won]
        busy = np.zeros(len(bounds), bool)
        busy[owner] = True
        stay = busy[unit] & start[place] & start[end] & (after[place] < end)
        place, which, unit, end = place[stay], which[stay], unit[stay], end[stay]
    return start[:n], after, made


def _relax_long(m: Model, place, end, which, start, after, made, stop: int) -> None:
    """The same for one long unit: a heap of the edges that were live when seen."""
    edges = {(int(p), int(e)): int(w) for p, e, w in zip(place, end, which, strict=True)}
    before = {int(p) + 1: int(p) for p in range(int(place.min(initial=stop)) - 1, stop)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(s: int) -> None:
        if s < stop and (mid := int(after[s])) < stop:
            e = int(after[mid])
            if (w := edges.get((s, e))) is not None:
                heapq.heappush(heap, (int(m.order[w]), s, e, w))

    for s in sorted({int(p) for p in place}):
        offer(s)
    while heap:
        _, s, e, w = heapq.heappop(heap)
        mid = int(after[s])
        if not start[s] or mid >= e or int(after[mid]) != e:
            continue
        start[mid] = False
        after[s], made[s] = e, w
        before[e] = s
        if (left := before.get(s)) is not None and left >= 0 and start[left] and int(after[left]) == s:
            offer(left)
        offer(s)


def encode_batch(texts: list[str | None], path: str = MODEL) -> list[np.ndarray]:
    """Ids of each text."""
    m = model(path)
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < SLICE_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        out += _encode_slice(m, texts[lo:hi])
        lo = hi
    return out


def _encode_slice(m: Model, texts: list[str | None]) -> list[np.ndarray]:
    said = [(_SPACE if m.prefix else "") + t.replace(" ", _SPACE) if t else "" for t in texts]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in said])]).astype(np.int64)
    points = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return [np.zeros(0, np.int32) for _ in texts]
    code = m.char_of[points]
    cut = np.ones(n + 1, bool)
    cut[1:n] = ~m.beside[code[:-1], code[1:]]
    cut[edge] = True
    begin = np.flatnonzero(cut)
    begin, length = begin[:-1], np.diff(begin)
    # Units by content: a 64-bit hash of their characters.
    weight = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(length.max()) - 1, 0x9E3779B97F4A7C15, np.uint64)))
    inside = np.arange(n) - np.repeat(begin, length)
    value = np.add.reduceat(mix(points.astype(np.uint64) + np.uint64(1)) * weight[inside], begin)
    _, first, unit = np.unique(mix(value + length.astype(np.uint64)), return_index=True, return_inverse=True)
    sizes = length[first]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    where = np.repeat(begin[first] - bounds[:-1], sizes) + np.arange(bounds[-1])
    own_code, own_points = code[where], points[where]

    # A separator after each unit keeps matches inside one.
    spaced = np.zeros(bounds[-1] + len(sizes), np.int32)
    spaced[np.arange(bounds[-1]) + np.repeat(np.arange(len(sizes)), sizes)] = own_code
    place, which = occurrences(m, spaced)
    place = place - np.searchsorted(bounds[1:] + np.arange(1, len(sizes) + 1), place, side="right")
    start, _, made = _relax(m, bounds, place, which)

    heads = np.flatnonzero(start)
    ids = np.where(made[heads] >= 0, m.piece[np.maximum(made[heads], 0)] if len(m.piece) else -1, m.single[own_code[heads]]).astype(np.int64)
    ids[(made[heads] < 0) & (own_code[heads] == 0)] = -1
    head_unit = np.searchsorted(bounds, heads, side="right") - 1
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        raw = [chr(own_points[heads[k]]).encode("utf-8", "surrogatepass") for k in lone]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(r) for r in raw]
        ids, head_unit = np.repeat(ids, times), np.repeat(head_unit, times)
        ids[ids < 0] = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    per_unit = np.bincount(head_unit, minlength=len(sizes))
    offset = np.cumsum(per_unit) - per_unit
    times = per_unit[unit]
    take = np.repeat(offset[unit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    every = ids[take].astype(np.int32)
    until = np.concatenate([[0], np.cumsum(times)])[np.searchsorted(begin, edge)]
    return [every[a:b] for a, b in zip(until[:-1], until[1:], strict=True)]


def decode_ids(ids: np.ndarray, path: str = MODEL) -> str:
    """The text of some ids."""
    m = model(path)
    raw = [m.bytes_of[i] for i in ids.tolist()]
    if raw and m.prefix and raw[0][:1] == b" " and not m.is_byte[ids[0]]:
        raw[0] = raw[0][1:]
    joined = b"".join(raw)
    try:
        return joined.decode()
    except UnicodeDecodeError:
        return "".join(_lenient(raw))


def _lenient(raw: list[bytes]) -> Iterator[str]:
    """Bytes that are no UTF-8 become U+FFFD one by one."""
    data, k = b"".join(raw), 0
    while k < len(data):
        size = 1 if data[k] < 0x80 else 2 if 0xC0 <= data[k] < 0xE0 else 3 if 0xE0 <= data[k] < 0xF0 else 4
        try:
            yield data[k : k + size].decode()
            k += size
        except UnicodeDecodeError:
            yield "�"
            k += 1


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(encode_batch(batch.column(1).to_pylist(), path))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.values.to_numpy(), path) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every row: ``exact`` says that decoding the ids gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = encode_batch(texts, path)
            exact = [decode_ids(x, path) == (t or "") for x, t in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), _id_lists(found), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_sentence_pieces": op8_sentence_pieces}
ORACLES: dict = {}
