"""SentencePiece encoding and decoding by vectorised merge rounds (operator 13).

For BPE models with byte fallback and identity normalisation, read from the
model file. A text is taken as a sentence: a space before it, spaces written as
``SPACE``. Which merge comes first is decided by the score of the merged piece,
then by the leftmost place. As no piece holds certain pairs of characters, a
text falls into *segments* that no merge crosses: words, and parts of words.

Segments of a whole Arrow batch lie in one flat array of symbols. A round

1. takes the least pair rank of each segment (``minimum.reduceat``),
2. merges all pairs of that rank at once, of overlapping ones the leftmost,
3. compacts the array, looks up the new pairs beside the merged symbols, and
   puts segments without a pair aside; the rounds end when none is left.

Merging at once equals merging one after another unless a merge makes a pair of
no higher rank beside it. Such a segment takes only its first merge in that
round, so the result is exact for every order of scores.

What is left of characters without a piece becomes byte pieces. Different
words are encoded once and kept (bounded) from batch to batch of a task.

Decoding joins the pieces of ids, replaces bytes that make no character by
U+FFFD each, and takes the first space off again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordBook, gather, offsets_of, slices, strings, text_buffer

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
NONE = np.iinfo(np.int32).max       # rank of what is no pair
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
KEPT_WORDS = 300_000                # words whose ids a task keeps


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- model file

def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, message[at:at + size]
            at += size


@dataclass
class PieceModel:
    """Pieces with scores and kinds; ids are their places."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    add_prefix: bool = True
    end_id: int = 2
    symbols: dict[str, int] = field(init=False)

    @staticmethod
    def load(path: str) -> PieceModel:
        rows, train, normal = [], {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    rows.append(dict(_fields(value)))
                elif number == 2:
                    train = dict(_fields(value))
                elif number == 3:
                    normal = dict(_fields(value))
        kinds = [r.get(3, NORMAL) for r in rows]
        if train.get(3, 1) != 2 or not train.get(35, 0):
            raise ValueError("only BPE models with byte fallback")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or train.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space and writes spaces as pieces do")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined or unused pieces are not supported")
        return PieceModel([r[1].decode() for r in rows], [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows], kinds,
                          bool(normal.get(3, 1)), train.get(42, 2))

    def __post_init__(self):
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        chars = sorted({c for p in normal for c in p})
        n = len(self.pieces)
        # symbols: normal pieces by id, then characters of pieces that are none, then any other character
        self.symbols = normal | {c: n + i for i, c in enumerate(c for c in chars if c not in normal)}
        self.other = n + len(chars)
        self.width = self.other + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c in chars:
            self.of_char[ord(c)] = self.symbols[c]
        inside = {(a, b) for p in normal for a, b in zip(p, p[1:], strict=False)}
        self.inside = np.array(sorted(self.symbols[a] * self.width + self.symbols[b] for a, b in inside), np.int64)
        level = {s: i for i, s in enumerate(sorted({self.scores[i] for i in normal.values()}, reverse=True))}
        pairs = sorted((self.symbols[p[:k]] * self.width + self.symbols[p[k:]], level[self.scores[i]], i)
                       for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([i for _, _, i in pairs], np.int32)
        self.bytes_id = np.zeros(256, np.int32)
        shown = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes_id[int(p[3:5], 16)] = i
                shown.append(bytes([int(p[3:5], 16)]))
            else:
                shown.append(b"" if k == CONTROL else (UNKNOWN_TEXT if k == UNKNOWN else p.replace(SPACE, " ")).encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8), offsets_of(np.array([len(s) for s in shown], np.int64))
        self.kind_of = np.array(self.kinds, np.int8)
        self.spaced = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(self.pieces, self.kinds, strict=True)])

    # ------------------------------------------------------------ encoding

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` for no pair) and merged symbol of neighbours."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], 0)

    def cuts(self, symbol: np.ndarray) -> np.ndarray:
        """True where no piece holds a character together with the one before it."""
        if not len(self.inside):
            return np.ones(len(symbol), bool)
        key = symbol[:-1].astype(np.int64) * self.width + symbol[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return np.r_[True, self.inside[at] != key][:len(symbol)]

    def merge(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merge rounds; ``start`` marks first symbols of segments. ``(place of the first character, symbol)``."""
        place, segment = np.arange(len(symbol)), np.cumsum(start)
        rank, new = self._beside(symbol, segment, np.arange(len(symbol)))
        done = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbol)]))
            rest = least != NONE
            if not rest.all():
                done.append((place[~rest], symbol[~rest]))
                symbol, place, segment, rank, new, least = (v[rest] for v in (symbol, place, segment, rank, new, least))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            order = np.arange(len(hit))
            since = order - np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], order, 0))
            hit = hit[since % 2 == 0]                           # of overlapping pairs every other one, from the left
            state, early = self._round(symbol, place, segment, rank, new, least, hit)
            if len(early):                                      # a merge made a pair that comes no later: one at a time
                one = np.r_[True, segment[hit[1:]] != segment[hit[:-1]]]
                state, _ = self._round(symbol, place, segment, rank, new, least, hit[one | ~np.isin(segment[hit], early)])
            symbol, place, segment, rank, new = state
        if not done:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        place, symbol = (np.concatenate(v) for v in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], symbol[order]

    def _beside(self, symbol, segment, at):
        """Rank and merged symbol of the pairs that begin at ``at``."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, new = self.pairs(symbol[at], symbol[after])
        return np.where((at + 1 < len(symbol)) & (segment[after] == segment[at]), rank, NONE).astype(np.int32), new.astype(np.int32)

    def _round(self, symbol, place, segment, rank, new, least, hit):
        """The state after merging at ``hit``; segments where a merge made a pair of no higher rank."""
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        symbol_, place_, segment_, rank_, new_, least_ = symbol.copy(), place[keep], segment[keep], rank[keep], new[keep], least[keep]
        symbol_[hit] = new[hit]
        symbol_ = symbol_[keep]
        at = moved[hit]
        beside = np.zeros(len(symbol_), bool)
        beside[at] = beside[at[at > 0] - 1] = True
        touched = np.flatnonzero(beside)
        rank_[touched], new_[touched] = self._beside(symbol_, segment_, touched)
        early = segment_[touched[rank_[touched] <= least_[touched]]] if len(touched) else np.empty(0, segment.dtype)
        early = early[np.isin(early, segment[hit])] if len(early) else early
        # between two merges side by side: the first one's symbol beside the second one's left half
        twin = hit[:-1][(hit[1:] == hit[:-1] + 2) & (segment[hit[1:]] == segment[hit[:-1]])]
        between, _ = self.pairs(new[twin], symbol[twin + 2] if len(twin) else symbol[:0])
        return (symbol_, place_, segment_, rank_, new_), np.union1d(early, segment[twin][between <= least[twin]])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of words, each with a space before it (spaces inside written as ``SPACE``)."""
        if not words:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        code = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32)
        begin = offsets_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        symbol = self.of_char[code]
        start = self.cuts(symbol)
        start[begin[:-1]] = True
        place, symbol = self.merge(symbol, start)
        plain = symbol < len(self.pieces)
        size = np.ones(len(symbol), np.int64)
        char = code[place[~plain]]
        size[~plain] = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        out = offsets_of(size)
        ids = np.empty(out[-1], np.int32)
        ids[out[:-1][plain]] = symbol[plain]
        raw = np.frombuffer(char.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(~plain, size)] = self.bytes_id[raw]
        return ids, np.r_[0, out[np.searchsorted(place, begin[1:])]]

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ragged ids."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id that the model does not have")
        data, at = gather(*self.shown, ids)
        ends = at[offsets]
        kind, row = self.kind_of[ids], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if self.add_prefix:                      # the space of the first piece that shows
            seen = np.flatnonzero(kind != CONTROL)
            lead = seen[np.r_[True, row[seen[1:]] != row[seen[:-1]]]] if len(seen) else seen
            lead = lead[self.spaced[ids[lead]]]
            drop = np.ones(len(data), bool)
            drop[at[lead]] = False
            data = data[drop]
            ends = ends - offsets_of(np.bincount(row[lead], minlength=len(offsets) - 1))
        # byte pieces may make no character: those rows one by one
        inner = (kind == CONTROL) & (np.r_[row[1:], -1] == row)
        odd = set(np.intersect1d(row[inner], row[kind == BYTE]).tolist())
        raw = np.isin(np.arange(len(offsets) - 1), row[kind == BYTE])
        for r in np.flatnonzero(raw).tolist():
            if r not in odd:
                try:
                    data[ends[r]:ends[r + 1]].tobytes().decode()
                except UnicodeDecodeError:
                    odd.add(r)
        whole = strings(data, ends) if not odd else None
        if whole is not None:
            return whole
        plain = [self._decode_row(ids[offsets[r]:offsets[r + 1]]) if r in odd else data[ends[r]:ends[r + 1]].tobytes().decode()
                 for r in range(len(offsets) - 1)]
        return pa.array(plain, pa.large_string())

    def _decode_row(self, ids: np.ndarray) -> str:
        out, run, first = [], bytearray(), True

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()
        for i in ids.tolist():
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            flush()
            if self.kinds[i] == CONTROL:
                continue
            text = UNKNOWN_TEXT if self.kinds[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ")
            out.append(text[1:] if first and self.add_prefix and self.spaced[i] else text)
            first = False
        flush()
        return "".join(out)


# ---------------------------------------------------------------- operator

_WORKER: dict[str, tuple[PieceModel, WordBook]] = {}     # a worker keeps the model from task to task


def _of(path: str) -> tuple[PieceModel, WordBook]:
    if path not in _WORKER:
        model = PieceModel.load(path)
        _WORKER[path] = model, WordBook(model.encode_words, KEPT_WORDS)
    return _WORKER[path]


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, and how many each text has up to its end.

    Cut at single spaces, which go; a space after a space or ``SPACE``, or the first
    of a text, stays with its word as ``SPACE``. An empty text has no word.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE + " ")), pc.starts_with(texts, " "))
    if pc.any(odd).as_py():
        import re

        spare = re.compile(f"(?:(?<=[ {SPACE}])|^) ")
        texts = pc.replace_with_mask(texts, odd, pa.array([spare.sub(SPACE, t) for t in texts.filter(odd).to_pylist()], pa.large_string()))
    data, offsets = text_buffer(texts)
    space = data == 0x20
    inner = np.flatnonzero(space)
    count = np.searchsorted(inner, offsets[1:]) - np.searchsorted(inner, offsets[:-1])
    words = np.where(offsets[1:] > offsets[:-1], count + 1, 0)
    # a word begins at each text's begin and after each space; it loses the space at its end
    begins = np.sort(np.concatenate([offsets[:-1][words > 0], inner + 1]), kind="stable")
    gone = np.r_[0, np.cumsum(space)]
    return strings(data[~space], np.r_[begins - gone[begins], len(data) - len(inner)]), np.cumsum(words)


def encode_batch(texts: pa.Array, model: PieceModel, book: WordBook, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ragged ids of whole texts."""
    words, upto = text_words(texts)
    ids, at = book.rows(words) if len(words) else (np.empty(0, np.int32), np.zeros(1, np.int64))
    offsets = at[np.r_[0, upto]]
    if not end:
        return ids, offsets
    return np.insert(ids, offsets[1:], model.end_id), offsets + np.arange(len(offsets))


def _int_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end: bool = True,
           with_decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>[, decoded])`` of every row; ``decoded`` is the text of the ids.

    A null or empty text has the end id only (nothing with ``end=False``). Every
    row is kept, equal rows get equal ids; an empty table gives an empty one;
    other columns are not read. Whole texts of any length are encoded.
    """
    path = model or model_path()

    def run(batches):
        pieces, book = _of(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = encode_batch(part.column(1), pieces, book, end)
                columns = [part.column(0), _int_lists(ids, offsets)]
                if with_decoded:
                    columns.append(pieces.decode(ids, offsets).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])
        book.clear()                # an idle worker holds no words

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * with_decoded
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` plus ``out_col``, the text of the ids; null ids give a null text, a null id inside a list fails."""
    path = model or model_path()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out_col}` string"])
    at = rows.columns.index(ids_col)

    def run(batches):
        pieces, _ = _of(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(at)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("null id")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = pieces.decode(flat.to_numpy(zero_copy_only=False), offsets_of(sizes))
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of an encoding with end id and its decoding."""
    done = encode(docs, id_col, text_col, model, with_decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
