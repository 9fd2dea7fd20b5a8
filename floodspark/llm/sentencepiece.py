"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text becomes segments that no piece of the vocabulary can span: runs of the space mark and what follows them. New
segments of equal length advance together, one character a step: the hashes of the substrings that end there probe
the sorted hashes of the pieces, and a vectorised maximum keeps the best score and its backpointer. Characters that no
piece covers become byte pieces, so decoding gives the text back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import BASE, kept, mix, powers

MARK = "▁"
FALLBACK = -20.0
ENCODED = "doc_id long, ids binary, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean"


def load_pieces(model_file: str) -> dict:
    """The vocabulary as arrays: sorted substring hashes with their ids and scores, and the bytes of each id.

    A piece of merge rank r scores -log(r + 2), its share under Zipf's law: ranks themselves are no log probabilities.
    Scores are multiples of 2**-20, so sums are exact and ties the same everywhere.
    Control and unknown pieces are never produced; pieces of one byte stand for bytes no other piece covers.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = processor.get_piece_size()
    pieces = [processor.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int64)
    out, keys, ids = [], [], []
    for i, piece in enumerate(pieces):
        if processor.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            out.append(bytes([int(piece[1:-1], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
            keys.append(piece)
            ids.append(i)
    if any(MARK in p.lstrip(MARK) for p in keys):
        raise ValueError("a piece goes on past a space mark, so a text can't be cut there")
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary must have a piece for each byte")
    scores = np.round(-np.log(np.arange(len(ids)) + 2.0) * 2.0**20) / 2.0**20
    hashes = np.array([_hash_of(p) for p in keys], np.uint64)
    order = np.argsort(hashes)
    if (np.diff(hashes[order].view(np.int64)) == 0).any():
        raise ValueError("two pieces have the same hash")
    return {"hashes": hashes[order], "ids": np.array(ids)[order], "scores": scores[order], "bytes": out, "byte_ids": byte_ids,
            "longest": max(map(len, keys))}


def _hash_of(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in map(ord, piece):
        h = h * BASE + mix(np.array([c + 1], np.uint64))
    return (mix(h) ^ np.uint64(len(piece)))[0]


def viterbi(words: list[str], model: dict) -> list[bytes]:
    """The ids (32-bit little-endian) of the best segmentation of each word; all words have the same length.

    The best has the greatest sum of piece scores; between equals the longer last piece wins.
    """
    n, length, longest = len(words), len(words[0]), model["longest"]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
    spread = mix(codes.astype(np.uint64) + np.uint64(1))
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    step = np.zeros((n, length + 1), np.int32)
    piece = np.full((n, length + 1), -1, np.int32)
    rows = np.arange(n)
    power = powers(longest, BASE)
    for end in range(1, length + 1):
        width = min(longest, end)
        back = spread[:, end - width:end][:, ::-1]
        sums = mix(np.cumsum(back * power[:width], 1, dtype=np.uint64)) ^ np.arange(1, width + 1, dtype=np.uint64)
        at = np.minimum(np.searchsorted(model["hashes"], sums), len(model["hashes"]) - 1)
        known = model["hashes"][at] == sums
        scores = np.where(known, model["scores"][at], -np.inf)
        scores[:, 0] = np.where(known[:, 0], scores[:, 0], FALLBACK)
        total = scores + best[:, end - width:end][:, ::-1]
        pick = width - 1 - np.argmax(total[:, ::-1], 1)
        best[:, end] = total[rows, pick]
        step[:, end] = pick + 1
        piece[:, end] = np.where(known[rows, pick], model["ids"][at[rows, pick]], -1)
    ids, count, end, alive = np.zeros((n, length), "<u4"), np.zeros(n, np.int64), np.full(n, length), rows
    plain = np.ones(n, bool)
    while len(alive):
        taken = piece[alive, end[alive]]
        plain[alive] &= taken >= 0
        ids[alive, length - 1 - count[alive]] = np.maximum(taken, 0)
        count[alive] += 1
        end[alive] -= step[alive, end[alive]]
        alive = alive[end[alive] > 0]
    return [ids[k, length - c:].tobytes() if whole else _with_bytes(words[k], piece[k], step[k], model)
            for k, (c, whole) in enumerate(zip(count.tolist(), plain.tolist()))]


def _with_bytes(word: str, piece: np.ndarray, step: np.ndarray, model: dict) -> bytes:
    """The ids on the best path of a word that needs byte pieces."""
    out, end = [], len(word)
    while end:
        if piece[end] >= 0:
            out.append(int(piece[end]))
        else:
            out += model["byte_ids"][list(word[end - 1].encode("utf-8", "surrogatepass"))][::-1].tolist()
        end -= int(step[end])
    return np.array(out[::-1], "<u4").tobytes()


class Encoder:
    """Encodes texts; remembers up to ``limit`` segments."""

    def __init__(self, model: dict, limit: int = 800_000, cells: int = 1 << 19):
        self.model, self.limit, self.cells, self.known = model, limit, cells, {}
        size = np.array([len(b) for b in model["bytes"]])
        self.sizes, self.starts, self.data = size, np.cumsum(size) - size, np.frombuffer(b"".join(model["bytes"]), np.uint8)

    def segments(self, text: str) -> list[str]:
        """The text after a leading space, cut before every space that follows something else."""
        text = " " + text
        if "  " not in text and text[-1] != " ":
            return [MARK + w for w in text[1:].replace(MARK, " ").split(" ")] if MARK not in text else _cut(text)
        return _cut(text)

    def learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > self.limit and self.known:
            self.known, new = {}, list(segments)
        by_length: dict[int, list[str]] = {}
        for s in new:
            by_length.setdefault(len(s), []).append(s)
        for length, words in by_length.items():
            most = max(1, self.cells // (length * self.model["longest"]))
            for k in range(0, len(words), most):
                for word, ids in zip(words[k:k + most], viterbi(words[k:k + most], self.model)):
                    self.known[word] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; an empty text has none."""
        cut = [self.segments(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of the ids: bytes of the pieces in turn, without the leading space."""
        k = np.frombuffer(ids, "<u4")
        sizes = self.sizes[k]
        if not sizes.sum():
            return ""
        at = np.repeat(self.starts[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text = self.data[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _cut(text: str) -> list[str]:
    out, at = [], 0
    marks = text.replace(" ", MARK)
    for k in range(1, len(marks)):
        if marks[k] == MARK and marks[k - 1] != MARK:
            out.append(marks[at:k])
            at = k
    return [*out, marks[at:]]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, ids (32-bit little-endian), n_tokens, their unsigned crc32, n_chars, and whether
    decoding the ids gives the text again.

    Null and empty texts have no ids; the mark character itself decodes as a space, as in the library. Repeated rows
    and null keys are kept; other columns are never read. The vocabulary is of fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = kept("pieces", model, lambda: Encoder(model))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(texts)
                same = [encoder.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32", "n_chars", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of encoded documents; ids that the vocabulary lacks are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = kept("pieces", model, lambda: Encoder(model))
        for batch in batches:
            texts = [encoder.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
