"""Token files: ids of documents, entropy-coded in independent blocks, written and read by Spark.

A file is a Parquet container; each of its rows is a chunk of whole documents in ascending order of their ids.  A chunk holds
the documents' ids and lengths, a header, and blocks of BLOCK_TOKENS ids.  A block starts from a fresh model, has a
checksum of its ids, and is decoded from its own bytes and the header, without any other block.

The coder mixes three predictions of the next id: the id last seen after the two ids before (order 2), after the one before
(order 1), and frequencies (order 0).  How far orders 2 and 1 are trusted is learned while coding, for each level of
confidence.  Order 0 goes by classes of ids: the header has the ids of the chunk, in classes, and their shares of their
class; the frequencies of the classes are learned in each block, from the ids that no order predicted.  Mixed
frequencies drive a range coder with 64-bit state that emits words of 16 bits.  All blocks of a chunk are coded in step, as
lanes of arrays.

Edge cases: a null text counts as empty; every document ends with END_ID, so none is without ids; null document ids come
first; rows with equal ids are kept apart, null texts first, others by a hash of their text, so that many of them are dealt
to many tasks; document ids must be integers (others fail at the cast); any number of different token ids is stored; an empty table
gives no file rows and an empty result; a block whose checksum fails raises an error.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import bounded, col, cut, shared_dir, text_slices

#: The id after each document's ids.
END_ID = 2
#: Ids of a block, and about so many ids in a chunk (whole documents).
BLOCK_TOKENS, CHUNK_TOKENS = 2048, 8 << 20
#: Lines of a block's table of predictions; a line has 8 slots of order 1 and 8 of order 2, and fits a cache line.
LINES = 16
#: Classes of ids, the count that they start from together, and what an id adds to its class.
CLASSES, PRIOR, GAIN = 16, 2048, 16
#: Words whose ids a worker keeps: the latest so many, and as many of the generation before.
MEMO_WORDS = 500_000
#: Bytes of text that are encoded at once, and bytes of input for each partition that is written.
ENCODE_BYTES, PART_BYTES = 8 << 20, 32 << 20

_U = np.uint64
#: Bits of the weights of the mix and of the class frequencies.
_MIX, _FREQ = 8, 12
_LEVELS = 8
_SMALL = _U(1 << 48)
#: Up to this id, places in the header's list are looked up in a table.
_DENSE = 1 << 24


class OrderZero:
    """The header of a chunk: the ids that occur, in at most CLASSES classes of about equal weight, and their shares.

    ``share`` adds up to 2^bits in each class and is at least 1; ``weight`` says what the counts of the classes start from.
    """

    def __init__(self, ids: np.ndarray, share: np.ndarray, of_class: np.ndarray, weight: np.ndarray):
        self.ids, self.share, self.of_class, self.weight = (np.asarray(v, np.int64) for v in (ids, share, of_class, weight))
        self.classes = len(self.weight)
        self.bits = int(np.bincount(self.of_class, self.share).max(initial=1)).bit_length() - 1
        before = np.cumsum(self.share) - self.share
        self.first = before - (self.of_class << self.bits)

    @classmethod
    def of(cls, ids: np.ndarray) -> OrderZero:
        used, count = np.unique(ids, return_counts=True)
        middle = np.cumsum(count) - count + count // 2
        of_class = np.unique(middle * CLASSES // max(1, len(ids)), return_inverse=True)[1]
        starts = np.flatnonzero(np.r_[True, np.diff(of_class) > 0][: len(used)])
        members = np.diff(np.r_[starts, len(used)])
        sums = np.add.reduceat(count, starts) if len(used) else count
        bits = max(12, int(members.max(initial=1)).bit_length() + 1)
        share = 1 + count * ((1 << bits) - members[of_class]) // sums[of_class]
        share[starts] += (1 << bits) - (np.add.reduceat(share, starts) if len(used) else 0)
        return cls(used, share, of_class, np.maximum(1, sums * PRIOR // max(1, len(ids))))

    def pack(self) -> bytes:
        head = np.array([len(self.ids), self.classes], "<u4").tobytes()
        parts = (np.diff(self.ids, prepend=0), self.share, np.bincount(self.of_class, minlength=self.classes), self.weight)
        return zlib.compress(head + b"".join(p.astype("<u4").tobytes() for p in parts), 6)

    @classmethod
    def unpack(cls, data: bytes) -> OrderZero:
        values = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        n, classes = values[:2].tolist()
        gaps, share, members, weight = np.split(values[2:], np.cumsum([n, n, classes]))
        return cls(np.cumsum(gaps), share, np.repeat(np.arange(classes), members), weight)


class _Model:
    """Predictions for all lanes, of places in the header's list of ids: hashed slots with confidence, learned trust and class frequencies."""

    def __init__(self, lanes: int, zero: OrderZero):
        self.lanes, lane = lanes, np.arange(lanes, dtype=np.int64)
        # id and confidence of a slot as id * _LEVELS + confidence; id 0 with confidence 0 at first
        raw = np.zeros(lanes * LINES * 16 + 16, np.int32)
        self.seen = raw[-raw.ctypes.data // 4 % 16 :]
        self.line, self.level = lane * (LINES * 16), lane * _LEVELS + np.array([[0], [lanes * _LEVELS]])
        # of order 2, then of order 1
        start = np.array([4, 40, 90, 140, 170, 190, 210, 225], np.int32) << 8
        self.trust = np.concatenate([np.tile(start, lanes), np.tile(start >> 1, lanes)])
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.at = np.empty((2, lanes), np.int64)

        self.share, self.first, self.of_class = zero.share, zero.first, zero.of_class
        self.bits, self.classes = zero.bits, zero.classes
        self.total_bits = _U(_MIX + _FREQ + self.bits)
        self.width = 1 << (self.classes - 1).bit_length()
        self.row = lane * (self.width + 1)
        self.counts = np.tile(zero.weight.astype(np.int32), (lanes, 1))
        self.count_row, self.flat_counts = lane * self.classes, self.counts.reshape(-1)
        self.steps = self.renew_at = 0
        self.renew()

    def renew(self) -> None:
        """Class frequencies from the counts: 2^_FREQ in all, at least 1 each."""
        if self.steps < self.renew_at:
            return
        self.renew_at = max(64, min(2 * self.steps, self.steps + 512))
        total = 1 << _FREQ
        share = 1 + self.counts * np.int32(total - self.classes) // self.counts.sum(axis=1, dtype=np.int32)[:, None]
        ends = np.full((self.lanes, self.width + 1), total, np.int64)
        ends[:, 0] = 0
        np.cumsum(share[:, :-1], axis=1, out=ends[:, 1 : self.classes])
        self.ends = ends.reshape(-1)

    def predict(self) -> None:
        h = self.last * 40503
        line = (h & LINES - 1) << 4
        line += self.line
        np.bitwise_or(line, self.before * 30011 >> 3 & 7 | 8, out=self.at[0])
        np.bitwise_or(line, h >> 12 & 7, out=self.at[1])
        seen = self.seen[self.at]
        self.guess, self.conf = seen >> 3, seen & 7
        self.trust_at = self.level + self.conf
        self.q = self.trust[self.trust_at]
        w_two = self.q[0] * 247 >> 16
        w_two += 1
        known = (252 - w_two) * (self.q[1] >> 8) >> 8
        known += 1
        known += w_two
        np.copyto(w_two, known, where=self.guess[0] == self.guess[1])
        shift = _FREQ + self.bits
        self.w_zero = (256 - known).astype(np.int64)
        self.edge_two, self.edge_one = w_two.astype(np.int64) << shift, known.astype(np.int64) << shift

    def span(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids ``x`` within the mix; counts the classes of those that no order predicted."""
        hit_two, hit_one = self.hit = self.guess == x
        start = np.where(hit_two, 0, self.edge_two)
        size = np.where(hit_two, self.edge_two, self.edge_one - self.edge_two)
        rest = np.flatnonzero(~(hit_two | hit_one))
        if len(rest):
            y, weight = x[rest], self.w_zero[rest]
            c = self.of_class[y]
            at = self.row[rest] + c
            low = self.ends[at]
            each = (self.ends[at + 1] - low) * weight
            start[rest] = self.edge_one[rest] + (low * weight << self.bits) + each * self.first[y]
            size[rest] = each * self.share[y]
            self.flat_counts[self.count_row[rest] + c] += GAIN
        return start, size

    def by_place(self) -> np.ndarray:
        """For each class and place in it the id."""
        return np.repeat(np.arange(len(self.share), dtype=np.int32), self.share)

    def find(self, t: np.ndarray, by_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of the spans that hold the places ``t``."""
        two = t < self.edge_two
        x = np.where(two, self.guess[0], self.guess[1])
        start = np.where(two, 0, self.edge_two)
        size = np.where(two, self.edge_two, self.edge_one - self.edge_two)
        rest = np.flatnonzero(t >= self.edge_one)
        if len(rest):
            edge, weight, row = self.edge_one[rest], self.w_zero[rest], self.row[rest]
            t = t[rest] - edge
            # the numbers are exact as doubles, and so are the floors of their quotients
            q = (t / (weight << self.bits)).astype(np.int64)
            at, step = row.copy(), self.width >> 1
            while step:
                at += (self.ends[at + step] <= q) * step
                step >>= 1
            c = at - row
            low = self.ends[at]
            each = (self.ends[at + 1] - low) * weight
            low = low * weight << self.bits
            y = by_place[(c << self.bits) + ((t - low) / each).astype(np.int64)]
            x[rest] = y
            start[rest] = edge + low + each * self.first[y]
            size[rest] = each * self.share[y]
            self.flat_counts[self.count_row[rest] + c] += GAIN
        x = x.astype(np.int64)
        self.hit = self.guess == x
        return x, start, size

    def update(self, x: np.ndarray) -> None:
        q = self.q
        q += (self.hit * np.int32(65535) - q) >> 4
        self.trust[self.trust_at] = q
        conf = np.where(self.hit, np.minimum(self.conf + 1, _LEVELS - 1), 1)
        conf += (x << 3).astype(np.int32)
        self.seen[self.at] = conf
        self.before, self.last = self.last, x
        self.steps += 1
        self.renew()


def encode_blocks(ids: np.ndarray, zero: OrderZero) -> list[bytes]:
    """The blocks of a chunk: checksum of the ids, then the words of the range coder."""
    lanes = -(-len(ids) // BLOCK_TOKENS)
    steps = min(BLOCK_TOKENS, len(ids))
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = np.searchsorted(zero.ids, ids) if len(zero.ids) and zero.ids[-1] > _DENSE else _places(zero.ids)[ids]
    by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, zero)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 63), _U)
    room = 3 * steps + 8
    out = np.zeros((lanes, room), np.uint16)
    flat, place = out.reshape(-1), np.arange(lanes, dtype=np.int64) * room
    first = place.copy()
    for row in by_step:
        x = row.astype(np.int64)
        model.predict()
        start, size = model.span(x)
        unit = width >> model.total_bits
        moved = low + unit * start.view(_U)
        over = np.flatnonzero(moved < low)
        if len(over):
            _carry(flat, place[over] - 1)
        low, width = moved, unit * size.view(_U)
        small = np.flatnonzero(width < _SMALL)
        while len(small):
            part, at = low[small], place[small]
            flat[at] = (part >> _U(48)).astype(np.uint16)
            place[small] = at + 1
            low[small] = part << _U(16)
            wider = width[small] << _U(16)
            width[small] = wider
            small = small[wider < _SMALL]
        model.update(x)
    for shift in (48, 32, 16, 0):
        flat[place] = (low >> _U(shift)).astype(np.uint16)
        place += 1
    raw, filled = ids.astype("<u4"), (place - first).tolist()
    return [zlib.crc32(raw[i * BLOCK_TOKENS : (i + 1) * BLOCK_TOKENS].tobytes()).to_bytes(4, "little") + out[i, : filled[i]].astype("<u2").tobytes() for i in range(lanes)]


def _places(used: np.ndarray) -> np.ndarray:
    out = np.zeros(int(used.max(initial=0)) + 1, np.int32)
    out[used] = np.arange(len(used))
    return out


def _carry(flat: np.ndarray, at: np.ndarray) -> None:
    while len(at):
        flat[at] += np.uint16(1)
        at = at[flat[at] == 0] - 1


def decode_blocks(blocks: list[bytes], count: int, zero: OrderZero) -> np.ndarray:
    """The ids of blocks; an error if a checksum fails.  Any run of a chunk's blocks may be given, ``count`` ids in all."""
    lanes, steps = len(blocks), min(BLOCK_TOKENS, count)
    sizes = [len(b) // 2 - 2 for b in blocks]
    room = max(sizes, default=0) + 4
    words = np.zeros((lanes, room), np.uint16)
    for i, b in enumerate(blocks):
        words[i, : sizes[i]] = np.frombuffer(b, "<u2", offset=4)
    flat = words.reshape(-1)
    model = _Model(lanes, zero)
    by_place = model.by_place()
    offset, width = np.zeros(lanes, _U), np.full(lanes, (1 << 63), _U)
    for k in range(4):
        offset = offset << _U(16) | words[:, k]
    place = np.arange(lanes, dtype=np.int64) * room + 4
    last = np.arange(1, lanes + 1, dtype=np.int64) * room - 1
    by_step = np.empty((steps, lanes), np.int32)
    top = (1 << int(model.total_bits)) - 1
    for s in range(steps):
        model.predict()
        unit = width >> model.total_bits
        x, start, size = model.find(np.minimum((offset // unit).view(np.int64), top), by_place)
        offset -= unit * start.view(_U)
        width = unit * size.view(_U)
        small = np.flatnonzero(width < _SMALL)
        while len(small):
            at = place[small]
            offset[small] = offset[small] << _U(16) | flat[np.minimum(at, last[small])]
            place[small] = at + 1
            wider = width[small] << _U(16)
            width[small] = wider
            small = small[wider < _SMALL]
        by_step[s] = x
        model.update(x)
    ids = zero.ids[by_step.T.reshape(-1)[:count]]
    raw = ids.astype("<u4")
    for i, b in enumerate(blocks):
        if zlib.crc32(raw[i * BLOCK_TOKENS : (i + 1) * BLOCK_TOKENS].tobytes()) != int.from_bytes(b[:4], "little"):
            raise ValueError(f"the checksum of block {i} fails")
    return ids


def pack_chunk(ids: np.ndarray) -> bytes:
    """Number of ids and sizes of the header and the blocks, then these."""
    zero = OrderZero.of(ids)
    header, blocks = zero.pack(), encode_blocks(ids, zero)
    sizes = np.array([len(ids), len(header), len(blocks), *(len(b) for b in blocks)], "<u4").tobytes()
    return b"".join([sizes, header, *blocks])


def unpack_chunk(data: bytes) -> np.ndarray:
    count, header, blocks = (int(v) for v in np.frombuffer(data, "<u4", 3))
    if not count:
        return np.empty(0, np.int64)
    sizes = np.frombuffer(data, "<u4", blocks, 12)
    at = 12 + 4 * blocks
    ends = at + header + np.cumsum(sizes.astype(np.int64))
    return decode_blocks([data[int(e) - int(n) : int(e)] for e, n in zip(ends, sizes, strict=True)], count, OrderZero.unpack(data[at : at + header]))


#: Words of these letters, with at most one of these marks at the end, are lowered in Arrow and given to the library's model;
#: NFC and the splitting steps leave such words as they are.
_LETTERS, _MARKS = "A-Za-zªµºÀ-ÖØ-öø-įı-ƺƼ-ƿǄ-ȯȲ-ɏ", ".,:;!?"
_PLAIN = f"^[{_LETTERS}]+[{_MARKS}]?$"
#: Words of these letters and of ASCII are split here, if no special token can be in them.
_SIMPLE = regex.compile(rf"(?!.*<\|)[{_LETTERS}!-~]+")
_MARK_OF_BYTE = np.zeros(256, np.int64)
_MARK_OF_BYTE[list(_MARKS.encode())] = np.arange(1, len(_MARKS) + 1)


class LibraryEncoder:
    """Ids by the tokenizers library, which is asked once for each word that is not kept.

    White space always ends a piece, so words between it are encoded apart: plain and simple words (``_PLAIN``, ``_SIMPLE``),
    lowered and split, by the library's model, any other word, and every word of a tokenizer with other steps before the
    model, by the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.chars = [chr(b if b in printable else next(spare)) for b in range(256)]
        #: Ids of plain words without mark, and of other words.
        self.stems, self.words = _Memo(self._by_model), _Memo(self._by_pieces)
        steps = (json.loads(self.library.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        found = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and "Regex" in s["pattern"]), None)
        self.pieces = found and regex.compile(found)
        self.plain = bool(found) and self._plain_is_right()

    def _plain_is_right(self) -> bool:
        """Whether the short way gives the library's ids, tried on every letter and mark in several places."""
        letters = [c for c in map(chr, range(0x250)) if regex.fullmatch(f"[{_LETTERS}]", c)]
        tries = [a + b + m for a in letters for b in ("", "a", "Zé") for m in ("", ".")] + ["Za" + a for a in letters] + ["la" + m for m in _MARKS]
        tries += [f"aé{chr(a)}{chr(b)}Z{chr(a)}" for a in range(33, 127) for b in (a, 39, 46, 55)] + [f"{x}{w}" for w in ("'S", "'t", "'RE", "'ve", "'m", "'LL", "'d", "'x") for x in ("", "a", "1", ".", "'")]
        self.plain = True
        try:
            ids, n = self.encode(pa.array(tries))
        except Exception:  # noqa: BLE001 - a model of another kind doesn't know the characters
            return False
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] == [x + _END for x in self._by_library(tries)]

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, lowered: list[str]) -> list[bytes]:
        tokenize, chars = self.model.tokenize, self.chars
        shown = [w if w.isascii() else "".join([chars[b] for b in w.encode()]) for w in lowered]
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in shown]

    def _by_pieces(self, words: list[str]) -> list[bytes]:
        simple = [self.plain and _SIMPLE.fullmatch(w) is not None for w in words]
        split = [self.pieces.findall(w.lower()) if s else () for w, s in zip(words, simple, strict=True)]
        every = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(every, self.stems.of(every), strict=True))
        rest = iter(self._by_library([w for w, s in zip(words, simple, strict=True) if not s]))
        return [b"".join([ids[p] for p in pieces]) if s else next(rest) for s, pieces in zip(simple, split, strict=True)]

    def entries(self, words: pa.Array) -> list[bytes]:
        """The ids of each of some different words."""
        if not self.plain:
            return self.words.of(words.to_numpy(zero_copy_only=False).tolist())
        plain = pc.match_substring_regex(words, _PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        stem = pc.utf8_rtrim(low, _MARKS).dictionary_encode()
        last = np.frombuffer(low.buffers()[2], np.uint8)[np.frombuffer(low.buffers()[1], np.int32)[low.offset + 1 : low.offset + 1 + len(low)] - 1] if len(low) else np.empty(0, np.uint8)
        stems = self.stems.of(stem.dictionary.to_numpy(zero_copy_only=False).tolist())
        marks = [b"", *self.stems.of(list(_MARKS))]
        made = [stems[i] + marks[m] if m else stems[i] for i, m in zip(stem.indices.to_numpy().tolist(), _MARK_OF_BYTE[last].tolist(), strict=True)]
        other = self.words.of(words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist())
        out = np.empty(len(words), object)
        is_plain = plain.to_numpy(zero_copy_only=False)
        out[is_plain], out[~is_plain] = made, other
        return out.tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, END_ID after each, and each text's number of ids."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        entries = self.entries(coded.dictionary)
        codes = coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(entries), "<u4")
        n = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        n_word = n[codes]
        ends = np.cumsum(n_word)
        at = np.repeat(((np.cumsum(n) - n)[codes] - (ends - n_word)).astype(np.int32), n_word)
        at += np.arange(len(at), dtype=np.int32)
        offsets = split.offsets.to_numpy()
        text_ends = np.concatenate([[0], ends])[offsets - offsets[0]]
        return np.insert(flat[at], text_ends[1:], END_ID), np.diff(text_ends) + 1


class _Memo:
    """Results for words: of the latest MEMO_WORDS, and of as many before, from which words that come up again are taken over."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self.make = make
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        missing = [i for i, e in enumerate(out) if e is None]
        names = [words[i] for i in missing]
        found = list(map(self.old.get, names))
        ask = [w for w, e in zip(names, found, strict=True) if e is None]
        made = iter(self.make(ask))
        for i, w, e in zip(missing, names, found, strict=True):
            out[i] = e = next(made) if e is None else e
            if len(w) <= 64:
                self.known[w] = e
        if len(self.known) > MEMO_WORDS:
            self.known, self.old = {}, self.known
        return out


_END = np.array([END_ID], "<u4").tobytes()
_encoders: dict[str, LibraryEncoder] = {}


def _write_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = LibraryEncoder(path)
        enc = _encoders[path]
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            row = [[part], [seq], [len(ids)], [pa.concat_arrays(docs)], [np.concatenate(lengths)], [pack_chunk(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in (piece for whole in batches for piece in text_slices(whole, ENCODE_BYTES)):
            ids, n = enc.encode(batch.column(1))
            docs.append(batch.column(0))
            lengths.append(n)
            held.append(ids)
            size += len(ids)
            if size >= CHUNK_TOKENS:
                yield chunk()
                docs, lengths, held, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield chunk()

    return run


_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_DDL = "part int, seq bigint, n_tokens bigint, docs array<bigint>, lengths array<bigint>, payload binary"


def _partitions(docs: DataFrame) -> int:
    """As many as shuffles have, or more where Spark knows that the input is large: one for each PART_BYTES of it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 50  # what isn't read from files has no size that Spark could know, or one beyond this
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if known else 0)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents' ids to token files in ``path``, in ascending order of the document ids."""
    slim = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    twin = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    ordered = slim.repartitionByRange(_partitions(docs), "doc_id", twin).sortWithinPartitions("doc_id", twin, "text")
    ordered.mapInArrow(_write_chunks(tokenizer), _DDL).write.option("compression", "uncompressed").parquet(path)


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = unpack_chunk(batch.column("payload")[i].as_py()).astype("<u4")
            docs, lengths = batch.column("docs")[i].as_py(), np.array(batch.column("lengths")[i].as_py(), np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            start = ends - lengths + batch.column("start")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(chunks: DataFrame) -> DataFrame:
    """Per document of token files: ``doc_id, start, n_tokens, ids_crc32``, decoded from the blocks."""
    sums = cut(chunks.select("part", "seq", "n_tokens"))
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("inside", inside).join(parts, "part").select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("start"))
    joined = chunks.join(bounded(cut(starts)), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("docs", "lengths", "payload", "start")
    return joined.mapInArrow(_read_chunks, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, id_col, text_col)
    return read_tokens(spark.read.schema(_DDL).parquet(path))
