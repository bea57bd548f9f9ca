"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import struct
import sys
import types
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.texts import map_arrow
from stemma.shared import spread

#: Public 32,000-piece model; a path on the driver, from where the vocabulary is sent out.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are looked at together, and the longest stretch without a boundary that is searched in arrays.
BLOCK, STRETCH = 1 << 18, 256
#: Slots of a worker's memory of neighbours.
PAIR_SLOTS = 1 << 22
#: Stands between texts; no character has this number.
BREAK = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[i : i + 4])[0]
            i += 4
        elif kind == 1:
            i += 8
        else:
            raise ValueError("not a SentencePiece model")


@dataclass
class Vocabulary:
    """What a model file says: pieces with scores and kinds, the kind of model, the dummy prefix."""

    pieces: list[tuple[str, float, int]]
    model: int
    prefix: bool
    byte_fallback: bool

    @staticmethod
    def read(path: str) -> Vocabulary:
        pieces, model, prefix, fallback, squeeze, name = [], UNIGRAM, True, False, True, b""
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                model, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                name, prefix, squeeze = own.get(1, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if name not in (b"identity", b"") or squeeze:
            raise ValueError("only models that leave their text as it is are supported")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        return Vocabulary(pieces, model, prefix, fallback)


class _Table:
    """Long keys to numbers, looked up in whole arrays; -1 for other keys."""

    def __init__(self, known: dict[int, int]):
        bits = max(4, (8 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(known), np.int64), np.array(list(known.values()), np.int32)
        slot = self._slots(keys)
        while len(keys):
            slot[self.keys[slot] >= 0] += 1
            slot &= self.mask
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            one = free[one]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            keys, values, slot = (np.delete(x, one) for x in (keys, values, slot))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out, found = self.values[slot], self.keys[slot]
        others = np.flatnonzero(found != keys)
        out[others] = -1
        others = others[found[others] >= 0]
        while len(others):
            slot[others] = (slot[others] + 1) & self.mask
            found = self.keys[slot[others]]
            same = found == keys[others]
            out[others[same]] = self.values[slot[others[same]]]
            others = others[~same & (found >= 0)]
        return out


@dataclass
class Codec:
    """Encoder and decoder over a vocabulary.

    The search keeps, for each position of a window, the last piece of the best
    path that ends there. For a unigram model that is the path of the greatest
    score. For a BPE model it is the path that the merges themselves would leave:
    a sequence of pieces is their result exactly if every two neighbours are what
    their joined text is merged into, so each prefix has one such path and scores
    need no sum.

    All paths that can still be continued start within the greatest piece length.
    Where no piece of the text goes over a boundary they all meet there, whatever
    they are: what lies before is committed and forgotten. ``_block`` finds these
    boundaries for many characters at once and advances all stretches between them
    together, one character a step; only the stretch that is still open is carried
    into the next block. In a stretch of over ``STRETCH`` characters the paths that
    survive are traced back to where they meet (``search``).
    """

    vocabulary: Vocabulary
    ids: dict[str, int] = field(init=False)
    score: list[float] = field(init=False)
    longest: int = field(init=False)
    #: Boundaries at which something was committed, so far.
    commits: int = field(init=False, default=0)

    def __post_init__(self):
        v = self.vocabulary
        self.ids = {p: i for i, (p, _, kind) in enumerate(v.pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in v.pieces]
        self.longest = max(map(len, self.ids), default=1)
        byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(v.pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(v.pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32) if v.byte_fallback else None
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in v.pieces]
        self.lowest = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[list, list] | None] = {}
        # Every beginning of a piece, with the piece's id or -1: how far a search may go on from a start.
        self.beginnings: dict[str, int] = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids
        self._arrays()

    def _arrays(self):
        """The same in arrays. Symbols are the pieces, characters of pieces that are none, any other character and a start."""
        nodes = {b: k for k, b in enumerate(self.beginnings)}
        alone = sorted({c for p in self.ids for c in p} - self.ids.keys())
        other = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in self.beginnings and chr(c) not in alone)
        self.names = [p for p, _, _ in self.vocabulary.pieces] + alone + [other, ""]
        self.start = len(self.names) - 1
        symbol = self.ids | {c: len(self.vocabulary.pieces) + k for k, c in enumerate(alone)}
        self.node_symbol = np.array(list(self.beginnings.values()) or [-1], np.int32)
        self.first, self.single = np.full(BREAK + 1, -1, np.int32), np.full(BREAK + 1, self.start - 1, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.single[ord(c)] = k
        for b, k in nodes.items():
            if len(b) == 1:
                self.first[ord(b)] = k
        self.trie = _Table({nodes[b[:-1]] << 21 | ord(b[-1]): k for b, k in nodes.items() if len(b) > 1})
        self.weight = np.array([self.score[i] if kind == NORMAL else self.lowest for i, (_, _, kind) in enumerate(self.vocabulary.pieces)] + [self.lowest] * (len(alone) + 2))
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.pair_shift = np.uint64(64 - PAIR_SLOTS.bit_length() + 1)

    def merged(self, text: str) -> list[str]:
        """What the merges leave of a short text; the definition of the BPE model, used for pairs only."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """How the first and the last symbol of a piece grow: (score of the merge, symbol) each.

        None if a merge comes before one that it needs, or if the merges do not make the piece.
        """
        if piece in self.spines:
            return self.spines[piece]
        symbols = list(piece)
        first, final = [(float("inf"), symbols[0])], [(float("inf"), symbols[-1])]
        lowest, orderly = float("inf"), True
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                known = self.ids.get(symbols[i] + symbols[i + 1])
                if known is not None and (best is None or self.score[known] > best):
                    best, at = self.score[known], i
            if best is None or best >= lowest:
                orderly = False
                break
            lowest = best
            merged = symbols[at] + symbols[at + 1]
            if at == 0:
                first.append((best, merged))
            if at == len(symbols) - 2:
                final.append((best, merged))
            symbols[at : at + 2] = [merged]
        self.spines[piece] = (first, final) if orderly else None
        return self.spines[piece]

    def _fits(self, before: str, piece: str) -> bool:
        """Whether the merges keep ``piece`` after ``before`` (empty: at the start).

        The symbols on both sides of the border grow merge by merge, those of the
        better score first; the border falls if joining them is ever the best merge.
        """
        right = self._spines(piece)
        if right is None or not before:
            return self.merged(before + piece) == ([before, piece] if before else [piece])
        left = self._spines(before)
        if left is None:
            return self.merged(before + piece) == [before, piece]
        left, right, i, j = left[1], right[0], 0, 0
        while True:
            known = self.ids.get(left[i][1] + right[j][1])
            on_left = left[i + 1][0] if i + 1 < len(left) else None
            on_right = right[j + 1][0] if j + 1 < len(right) else None
            if known is not None:
                joined = self.score[known]
                if (on_left is None or joined > on_left) and (on_right is None or joined >= on_right):
                    return False
            if on_left is None and on_right is None:
                return True
            if on_right is None or (on_left is not None and on_left >= on_right):
                i += 1
            else:
                j += 1

    def search(self, text: str):
        """Yield the pieces of ``text`` as they are committed."""
        longest, beginnings, score, pairs = self.longest, self.beginnings, self.score, self.pairs
        bpe = self.vocabulary.model == BPE
        n, base = len(text), 0  # the lists are of positions base, base + 1, ...
        last: list[str | None] = [""]
        total = [0.0]
        for i in range(n):
            if i - base >= 4 * longest:
                alive = set(range(i - longest + 1, i + 1))
                while len(alive) > 1:
                    far = max(alive)
                    alive.remove(far)
                    alive.add(max(base, far - len(last[far - base])))
                meet = alive.pop()
                if meet > base:
                    yield from self._path(last, base, meet)
                    del last[: meet - base], total[: meet - base]
                    base = meet
            before = last[i - base]
            end = i
            while end < n:
                end += 1
                piece = text[i:end]
                known = beginnings.get(piece)
                if known is None:
                    if end > i + 1:
                        break
                elif known < 0 and end > i + 1:
                    continue
                while len(last) <= end - base:
                    last.append(None)
                    total.append(-1e300)
                if bpe:
                    # Each end has one last piece; the first that fits is it.
                    if last[end - base] is None:
                        fits = pairs.get((before, piece))
                        if fits is None:
                            if len(pairs) > 1_000_000:
                                pairs.clear()
                            fits = pairs[before, piece] = self._fits(before, piece)
                        if fits:
                            last[end - base] = piece
                else:
                    sum_ = total[i - base] + (self.lowest if known is None or known < 0 else score[known])
                    if sum_ > total[end - base]:
                        last[end - base], total[end - base] = piece, sum_
                if known is None:
                    break
        yield from self._path(last, base, n)

    @staticmethod
    def _path(last: list[str], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(last[end - base])
            end -= len(out[-1])
        return out[::-1]

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and symbols of all pieces in the text, and of each character alone; short ones first."""
        n = len(points)
        starts, lengths, symbols = [np.arange(n)], [np.ones(n, np.int64)], [self.single[points]]
        node = self.first[points]
        at = np.flatnonzero(node >= 0)
        node = node[at].astype(np.int64)
        for length in range(2, self.longest + 1):
            fit = np.searchsorted(at, n - length, "right")
            at, node = at[:fit], node[:fit]
            node = self.trie.get(node << 21 | points[at + length - 1])
            on = node >= 0
            at, node = at[on], node[on].astype(np.int64)
            if not len(at):
                break
            symbol = self.node_symbol[node]
            full = symbol >= 0
            starts.append(at[full])
            lengths.append(np.full(len(starts[-1]), length))
            symbols.append(symbol[full])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(symbols).astype(np.int64)

    def _neighbours(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """``_fits`` for arrays of symbols."""
        key = before * len(self.names) + symbol
        slot = ((key.view(np.uint64) * _ODD) >> self.pair_shift).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            names, n = self.names, len(self.names)
            out[new] = np.array([self._fits(names[k // n], names[k % n]) for k in keys.tolist()], bool)[back]
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], out[new]
        return out

    def _block(self, points: np.ndarray, final: bool) -> tuple[np.ndarray, int]:
        """The symbol that begins at each position (-1: none) up to the last boundary, and that boundary.

        Past the last ``longest`` characters of a block that is not ``final`` pieces
        may go on, so no boundary is looked for there.
        """
        n, bpe = len(points), self.vocabulary.model == BPE
        starts, lengths, symbols = self._edges(points)
        reach = np.arange(1, n + 1)
        reach[starts] = starts + lengths  # the longest comes last
        meet = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, n + 1)) + 1
        if not final:
            meet = meet[: np.searchsorted(meet, n - self.longest + 1, "right")]
        if not len(meet):
            return np.empty(0, np.int64), 0
        self.commits += len(meet)
        cut, begin = int(meet[-1]), np.concatenate(([0], meet[:-1]))
        size = meet - begin
        chosen = np.full(cut, -1, np.int64)
        for i, m in zip(begin[size > STRETCH].tolist(), size[size > STRETCH].tolist()):
            self._traced(points[i : i + m], chosen[i : i + m])
        origin, width = np.repeat(begin, size), np.repeat(size, size)
        mine = np.flatnonzero(starts < cut)
        mine = mine[width[starts[mine]] <= STRETCH]
        starts, lengths, symbols = starts[mine], lengths[mine], symbols[mine]
        step = (starts + lengths - origin[starts]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        starts, lengths, symbols = starts[order], lengths[order], symbols[order]
        last, back = np.full(cut + 1, -1, np.int64), np.zeros(cut + 1, np.int64)
        total = np.full(cut + 1, -np.inf)
        at = 0
        for count in np.bincount(step, minlength=1).tolist():
            i, m, k = starts[at : at + count], lengths[at : at + count], symbols[at : at + count]
            at += count
            if not count:
                continue
            opening = i == origin[i]
            if bpe:
                # Each end has one last piece; it is the one that fits.
                before = np.where(opening, self.start, last[i])
                live = np.flatnonzero(before >= 0)
                live = live[self._neighbours(before[live], k[live])]
                end = i[live] + m[live]
                last[end], back[end] = k[live], m[live]
            else:
                sums = np.where(opening, 0.0, total[i]) + self.weight[k]
                for length in np.unique(m)[::-1]:
                    own = np.flatnonzero(m == length)
                    end = i[own] + length
                    own, end = own[sums[own] > total[end]], end[sums[own] > total[end]]
                    total[end], last[end], back[end] = sums[own], k[own], length
        end = meet[size <= STRETCH]
        floor = begin[size <= STRETCH]
        while len(end):
            start = end - back[end]
            chosen[start] = last[end]
            more = start > floor
            end, floor = start[more], floor[more]
        return chosen, cut

    def _traced(self, points: np.ndarray, chosen: np.ndarray) -> None:
        """Fill in the symbols of one long stretch, as ``search`` commits them."""
        at = 0
        for piece in self.search(points.astype("<u4").tobytes().decode("utf-32-le")):
            chosen[at] = self.ids.get(piece, self.start - 1)
            at += len(piece)

    def _stretch(self, points: np.ndarray) -> int:
        """How long the first stretch is, found block by block."""
        at, reach = 0, 0
        while True:
            part = points[at : at + BLOCK]
            starts, lengths, _ = self._edges(part)
            ends = np.arange(1, len(part) + 1)
            ends[starts] = starts + lengths
            ends = np.maximum(np.maximum.accumulate(ends) + at, reach)
            final = at + len(part) == len(points)
            known = len(part) if final else len(part) - self.longest + 1
            meet = np.flatnonzero(ends[:known] == np.arange(at + 1, at + known + 1))
            if len(meet):
                return int(meet[0]) + at + 1
            at, reach = at + known, int(ends[known - 1])

    def _committed(self, points: np.ndarray):
        """Yield (position, symbols) as they are committed, the symbol of each position in turn."""
        at, n = 0, len(points)
        while at < n:
            part = points[at : at + BLOCK]
            chosen, cut = self._block(part, at + len(part) == n)
            if not cut:
                cut = self._stretch(points[at:])
                chosen = np.full(cut, -1, np.int64)
                self._traced(points[at : at + cut], chosen)
            yield at, chosen
            at += cut

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts, one text after the other, and how many each text has."""
        mark = SPACE if self.vocabulary.prefix else ""
        marked = [(mark + t).replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) + 1 for t in marked])
        points = np.frombuffer("\n".join([*marked, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        points[np.cumsum(sizes) - 1] = BREAK
        counts, ids, text, before = np.zeros(len(texts), np.int64), [], 0, False
        for at, chosen in self._committed(points):
            place = np.flatnonzero(chosen >= 0)
            symbol, point = chosen[place], points[at + place]
            ends = point == BREAK
            strange = (symbol >= len(self.out)) & ~ends
            if self.byte_ids is not None:
                many = np.where(strange, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
            else:  # unknown characters that follow one another have one id
                many = np.where(strange & np.concatenate(([before], strange[:-1])), 0, 1)
                before = bool(strange[-1])
            many[ends] = 0
            made = np.repeat(np.where(strange, self.unknown, symbol), many)
            if self.byte_ids is not None and strange.any():
                odd = np.flatnonzero(strange)
                made[np.repeat(strange, many)] = self.byte_ids[np.frombuffer(point[odd].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
            ids.append(made.astype("<i4"))
            owner = text + np.cumsum(ends) - ends
            counts += np.bincount(owner, weights=many, minlength=len(texts) + 1).astype(np.int64)[: len(texts)]
            text += int(ends.sum())
        return np.concatenate(ids) if ids else np.empty(0, "<i4"), counts

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as 32-bit little-endian numbers; none for null or empty."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement marks, ids outside the vocabulary the unknown piece."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.out)):
            ids = np.where((ids >= 0) & (ids < len(self.out)), ids, self.unknown)
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text[:1] == " " else text


def _codec(vocabulary: Vocabulary, key: str) -> Codec:
    """The worker's codec for a vocabulary, which outlives a task."""
    kept = sys.modules.setdefault("_stemma_codecs", types.ModuleType("_stemma_codecs")).__dict__
    if key not in kept:
        kept[key] = Codec(vocabulary)
    return kept[key]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, n_ids, ids, exact) for all documents.

    Whole texts are encoded as the model's own library does; ``exact`` says that
    decoding gives the text back, which only a text with U+2581 itself, or an
    unknown character without byte pieces, does not. A very long text is searched
    block by block. Null and empty texts have no
    ids and are exact. Null ids and repeated rows: each row its own result. Empty
    table: empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(model))
    key = f"{spark.sparkContext.applicationId}:{model}"
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])

    def run(batches):
        codec = _codec(vocabulary.value, key)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made, sizes = codec.encode_all(texts)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(made))
            exact = [codec.decode(made[a:b]) == (t or "") for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids, pa.array(exact, pa.bool_())], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_ids long, ids array<int>, exact boolean", rows=256)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids).

    Null or no ids: an empty text. A null among the ids, and an id outside the
    vocabulary: the unknown piece. Null doc_id and repeated rows: each row its own.
    Empty table: empty result. Other columns are ignored, whatever their names.
    """
    spark = encoded.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(model))
    key = f"{spark.sparkContext.applicationId}:{model}"
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = _codec(vocabulary.value, key)
        for batch in batches:
            texts = [codec.decode(np.array([-1 if i is None else i for i in x or []], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string", rows=256)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids, and whether these decode to the text."""
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
