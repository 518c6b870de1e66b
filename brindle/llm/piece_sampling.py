"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

A piece of rank r has the weight 1 / (r + offset) ** sharpness, both parameters: the public model file is one of merges, so it gives ranks and
no probabilities, and a rank law stands for those. A segmentation has the product of its pieces' weights. The lattice of a text falls apart where no piece can cross: before a run of spaces and
around characters that are in no piece. Equal parts of a slice share one forward pass, which sums the
weights of all segmentations of each prefix and keeps, for each end, the cumulative shares of its last
piece's lengths. Backward sampling then walks every occurrence from its end; the draw at a character
is a hash of the row key, the seed and the character's place, so a row's segmentation depends on its key
and text alone. Matching, filtering and sampling run over whole slices at once.

A space is written as U+2581. Characters without a piece, U+2581 itself among them, become byte pieces, so
decoding gives back every text exactly. Nulls give null pieces, empty texts none. Equal texts under
different keys may differ; rows equal in both are equal. An empty table gives an empty result. Extra
columns are carried; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ROW, U64, column, kept_columns, mapped, mix64, named, packed, powers, reuse_memory, text_slices, unpacked, with_fields

SPACE = 0x2581
TABLE_BITS = 18
SLICE_BYTES = 1 << 18  # of text sampled at once; its arrays are many times that
_MULTIPLY = U64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a SentencePiece model file as a hashed trie for walks over many positions at once."""

    def __init__(self, model: bytes, offset: float = 10.0, sharpness: float = 1.0) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * p.get_piece_size()
        weights: dict[str, tuple[int, float]] = {}
        normal = []
        for i in range(p.get_piece_size()):
            name = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                normal.append((-p.get_score(i), i, name))
                self.bytes[i] = name.replace("▁", " ").encode()
        for rank, (_, i, name) in enumerate(sorted(normal)):
            weights[name] = (i, (rank + offset) ** -sharpness)
        self.fallback = (len(normal) + offset) ** -sharpness * 1e-3
        self.longest = max(map(len, weights), default=1)
        self.alphabet = np.zeros(0x110000, bool)
        nodes: dict[str, int] = {}
        for name in weights:
            self.alphabet[[ord(c) for c in name]] = True
            for k in range(1, len(name) + 1):
                nodes.setdefault(name[:k], len(nodes))
        names = list(nodes)
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(names), U64)
            for i, name in enumerate(names):
                h = U64(0)
                for c in name:
                    h = self.extend(h, U64(ord(c)))
                hashes[i] = h
        assert len(np.unique(hashes)) == len(hashes)
        size = 1 << TABLE_BITS
        self.keys, self.at = np.zeros(size, U64), np.full(size, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            slot = h >> (64 - TABLE_BITS)
            while self.at[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.at[slot] = h, i
        self.ids = np.array([weights[n][0] if n in weights else -1 for n in names], np.int32)
        self.weights = np.array([weights[n][1] if n in weights else 0.0 for n in names], np.float64)
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_lengths, self.byte_starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + U64(1)) * _MULTIPLY
        return h ^ (h >> U64(32))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are trie nodes, as indices, and their nodes."""
        slot = (h >> U64(64 - TABLE_BITS)).astype(np.int32)
        found = self.at[slot]
        hit = self.keys[slot] == h
        hit &= found >= 0
        open_ = np.flatnonzero(~hit & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
            some = slot[open_]
            at = self.at[some]
            good = (self.keys[some] == h[open_]) & (at >= 0)
            found[open_[good]], hit[open_[good]] = at[good], True
            open_ = open_[~good & (at >= 0)]
        alive = np.flatnonzero(hit)
        return alive, found[alive]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.byte_lengths[ids]
        first = np.cumsum(lengths) - lengths
        return self.flat[np.arange(int(lengths.sum())) + np.repeat(self.byte_starts[ids] - first, lengths)].tobytes()


def _parts(points: np.ndarray, ends: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Starts of the lattice parts: texts' starts, spaces after other characters, and around unknown characters."""
    start = np.zeros(len(points), bool)
    start[0] = True
    start[ends[ends < len(points)]] = True
    space = points == SPACE
    start[1:] |= space[1:] & ~space[:-1]
    start |= ~known
    start[1:] |= ~known[:-1]
    return np.flatnonzero(start)


def _distinct(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence of each distinct part, and the distinct part of each occurrence."""
    with np.errstate(over="ignore"):
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        h = (points.astype(U64) + U64(1)) * _MULTIPLY
        h ^= h >> U64(29)
        h *= powers(int(lengths.max()) + 1)[place + 1]
        h = mix64(np.add.reduceat(h, starts) + lengths.astype(U64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    return one, which


def sample(texts: bytes, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of a slice (UTF-8 bytes) in order, and how many each text has."""
    n_texts = len(offsets) - 1
    points = np.frombuffer(texts.decode("utf-8").encode("utf-32-le"), np.int32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    raw = np.frombuffer(texts, np.uint8)
    char_at = np.flatnonzero((raw & 0xC0) != 0x80)
    char_ends = np.searchsorted(char_at, offsets)
    owner = np.repeat(np.arange(n_texts), np.diff(char_ends))
    marker = points == SPACE
    points = np.where(points == 0x20, np.int32(SPACE), points)
    known = pieces.alphabet[points]
    if marker.any():
        known &= ~marker
    starts = _parts(points, char_ends, known)
    lengths = np.diff(np.append(starts, len(points)))
    one, which = _distinct(np.where(marker, np.int32(0x110000), points), starts, lengths)

    # distinct parts, longest first; their characters by place, so that those of one place lie together
    by_length = np.argsort(-lengths[one], kind="stable")
    back = np.empty(len(one), np.int64)
    back[by_length] = np.arange(len(one))
    which, one = back[which], one[by_length]
    length = lengths[one]
    most = int(length[0])
    holds = np.searchsorted(-length, -np.arange(1, most + 1), side="right")  # parts that have place t
    place_at = np.concatenate([[0], np.cumsum(holds)])
    place = np.repeat(np.arange(most, dtype=np.int32), holds)
    part = np.arange(len(place), dtype=np.int32) - place_at[place].astype(np.int32)
    where = starts[one][part] + place
    chars, n = points[where].astype(U64), len(where)
    previous = np.where(place > 0, place_at[np.maximum(place - 1, 0)].astype(np.int32) + part, np.int32(n))

    # edges: a piece from a place to the place it ends on, by end, longest first
    found: list[tuple[np.ndarray, ...]] = []
    active = np.flatnonzero(known[where]).astype(np.int32)
    end, room = active, length.astype(np.int32)[part[active]] - place[active]
    h, single = np.zeros(len(active), U64), np.zeros(n, bool)
    step = np.append(holds, 0).astype(np.int32)  # from a character to the next of its part
    with np.errstate(over="ignore"):
        for k in range(pieces.longest):
            if k:
                inside = np.flatnonzero(room > k)
                active, room, h, end = active[inside], room[inside], h[inside], end[inside]
                end = end + step[place[end]]
            if not len(active):
                break
            h = pieces.extend(h, chars[end])
            alive, node = pieces.find(h)
            active, room, h, end = active[alive], room[alive], h[alive], end[alive]
            ids = pieces.ids[node]
            whole = np.flatnonzero(ids >= 0)
            last = end[whole]
            found.append((last, previous[active[whole]], pieces.weights[node[whole]], ids[whole]))
            if k == 0:
                single[last] = True
    rest = np.flatnonzero(~single)
    code = chars[rest].astype(np.int32)
    as_byte = np.where((code < 128) & ~marker[where[rest]], pieces.byte_ids[np.minimum(code, 127)], -2).astype(np.int32)
    lone = (rest, previous[rest], np.full(len(rest), pieces.fallback), as_byte)
    if found:
        found[0] = tuple(np.concatenate(x) for x in zip(found[0], lone, strict=True))
    else:
        found.append(lone)
    edge_at = np.concatenate([[0], np.cumsum(sum(np.bincount(x[0], minlength=n) for x in found))]).astype(np.int32)
    free = edge_at[:-1].copy()
    source, weight = np.empty(edge_at[-1], np.int32), np.empty(edge_at[-1])
    piece, size = np.empty(edge_at[-1], np.int32), np.empty(edge_at[-1], np.int8)
    for k in range(len(found) - 1, -1, -1):
        end, src, w, i = found[k]
        slot = free[end]
        free[end] += 1
        source[slot], weight[slot], piece[slot], size[slot] = src, w, i, k + 1

    # forward: total of a character is the summed weight of all segmentations of its part up to it
    total = np.empty(n + 1)
    total[n] = 1.0
    share = np.empty(edge_at[-1], np.float32)
    for t in range(most):
        lo, hi = place_at[t], place_at[t + 1]
        a, z = edge_at[lo], edge_at[hi]
        terms = total[source[a:z]] * weight[a:z]
        at = edge_at[lo:hi] - a
        sums = np.add.reduceat(terms, at)
        total[lo:hi] = sums
        running = np.cumsum(terms / np.repeat(sums, np.diff(np.append(at, z - a))))
        ahead = running[at - 1]
        ahead[0] = 0.0
        share[a:z] = running - np.repeat(ahead, np.diff(np.append(at, z - a)))
        if t % 16 == 15:  # only proportions count from here on
            for j in range(max(0, t - pieces.longest), t + 1):
                total[place_at[j] : place_at[j] + hi - lo] /= sums
    share[edge_at[1:] - 1] = 2.0

    # backward: every occurrence at once, from its end
    out = np.full(len(points), -1, np.int64)
    at, part, begin = lengths.copy(), which, starts
    with np.errstate(over="ignore"):
        row_key = mix64(keys.astype(U64) + _MULTIPLY)[owner]
        draw = (mix64(row_key + (np.arange(len(points)) - char_ends[owner]).astype(U64) * U64(0xC2B2AE3D27D4EB4F)) >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
    while len(at):
        edge = edge_at[place_at[at - 1] + part]
        u = draw[begin + at - 1]
        on = np.flatnonzero(share[edge] <= u)
        while len(on):
            edge[on] += 1
            on = on[share[edge[on]] <= u[on]]
        at = at - size[edge]
        out[begin + at] = piece[edge]
        more = at > 0
        at, part, begin = at[more], part[more], begin[more]

    token_at = np.flatnonzero(out != -1)
    ids = out[token_at]
    sizes = np.diff(np.append(char_at, len(raw)))
    if not (ids == -2).any():
        counts = np.diff(np.searchsorted(token_at, char_ends))
    else:
        width = np.where(ids == -2, sizes[token_at], 1)
        counts = np.bincount(owner[token_at], weights=width, minlength=n_texts).astype(np.int64)
        begins = np.cumsum(width) - width
        inner = np.arange(int(width.sum())) - np.repeat(begins, width)
        as_bytes = pieces.byte_ids[raw[np.repeat(char_at[token_at], width) + inner]]
        ids = np.where(np.repeat(ids == -2, width), as_bytes, np.repeat(ids, width))
    return ids, counts


def encode_sampled(df: DataFrame, model: bytes, text: str = "text", row_id: str = "doc_id", carry: list[str] | None = None, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """df's columns (or those in `carry`) with pieces (ids), n_pieces and lossless, which says that decoding gave the text back.

    The model file (some hundred kB) is broadcast.
    """
    made = ["pieces", "n_pieces", "lossless"]
    carry = kept_columns(df, carry, made)
    source = df.select(packed(carry), named(text).alias("_text"), F.xxhash64(named(row_id), F.lit(seed)).alias("_key"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        pieces = None
        for batch in batches:
            pieces = pieces or Pieces(shared.value, sharpness=sharpness)
            texts, keys = column(batch, "_text"), np.asarray(column(batch, "_key"))
            valid = np.asarray(texts.is_valid())
            for lo, hi, data, offsets in text_slices(texts, SLICE_BYTES):
                raw = data.tobytes()
                ids, counts = sample(raw, offsets, keys[lo:hi], pieces)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                spans = np.concatenate([[0], np.cumsum(np.add.reduceat(pieces.byte_lengths[ids], bounds[:-1][counts > 0]) if len(ids) else np.zeros(0, np.int64))])
                decoded, same = pieces.decode(ids), np.ones(hi - lo, bool)
                for j, i in enumerate(np.flatnonzero(counts > 0).tolist()):
                    same[i] = decoded[spans[j] : spans[j + 1]] == raw[offsets[i] : offsets[i + 1]]
                ok = valid[lo:hi]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(~ok))
                part = batch.slice(lo, hi - lo)
                arrays = [column(part, ROW), lists, pa.array(counts, mask=~ok), pa.array(same, mask=~ok)]
                yield pa.RecordBatch.from_arrays(arrays, names=[ROW, *made])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], "pieces array<int>, n_pieces long, lossless boolean"))), carry, *made)


def decode_pieces(df: DataFrame, model: bytes, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """df with the text of its pieces."""
    carry = kept_columns(df, None, [text])
    source = df.select(packed(carry), named(pieces).alias("_pieces"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Pieces(shared.value)
            texts = [known.decode(x.values.to_numpy()).decode("utf-8") if x.is_valid and len(x.values) else ("" if x.is_valid else None) for x in column(batch, "_pieces")]
            yield pa.RecordBatch.from_arrays([column(batch, ROW), pa.array(texts, pa.string())], names=[ROW, "_text"])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], "_text string"))), carry, F.col("_text").alias(text))
