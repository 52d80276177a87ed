"""Packing documents into fixed-length sequences (operator 5).

1. **Pieces.** A text becomes the ids of a public tokenizer plus an end id.
   Only documents longer than ``max_len`` are cut, from the back, into pieces of
   ``max_len``; the first piece may be shorter. Whole Arrow batches are cut into
   words; each task tokenizes a word with the white space before it once and
   keeps its ids (bounded cache).
2. **Histogram.** The lengths, at most ``max_len`` different ones, are counted
   by Spark. This histogram is all that reaches the driver.
3. **Configuration LP.** ``min sum x_c`` so that configurations (multisets of
   lengths that fit a sequence) cover every length's count. Solved by
   multiplicative weights: a length's price falls as it gets more cover than
   its share of the rounds so far and rises as it gets less. Prices enter a knapsack
   dynamic program over the capacity, whose table gives the best configuration
   around every length in one pass; these are the columns played.
4. **Rounding.** Whole parts of well-filled configurations are kept as far as
   pieces are left, and the program is solved once more for the remainder. The
   last rest is packed by the largest piece left plus the fullest filling a
   subset-sum program finds for it, as often as counts allow.
5. **Placement.** Pieces of a length are ranked (in hashed buckets, so that a
   length holding a third of all pieces is spread over many tasks) and a rank
   range of a length maps to sequences and offsets by arithmetic on the plan.
   The plan has as many rows as configurations, not as sequences.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise
from .words import WordBook, gather, offsets_of, slices, strings, text_buffer

MAX_LEN = 2048
END_ID = 0
ROUNDS = 20             # rounds of multiplicative weights
BLOCKS = 8              # price updates in a round
RATE = 1.0              # how fast prices follow cover
SOLVES = 2              # the program is solved again for what the first rounding leaves
FULL = 0.996            # configurations filled to this share are rounded; others wait for the rest
CACHE_WORDS = 300_000   # words whose ids a worker keeps
TOGETHER = 1 << 14      # new words encoded in one string
BUCKET_ROWS = 20_000    # pieces ranked together


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- pieces

ALNUM, PUNCTUATION = 1, 2
#: class of a byte: ASCII letter or digit, other visible ASCII, or neither
CLASS = np.array([ALNUM if chr(b).isascii() and chr(b).isalnum() else PUNCTUATION if 0x20 < b < 0x7F else 0 for b in range(256)], np.uint8)


class WordIds:
    """Token ids of whole texts, a batch at a time; ids of a word with the white space before it are computed once.

    Texts are cut before a space or line end that follows no white space, and before
    ASCII punctuation that follows a letter or digit. The tokenizer never joins
    across such a place, so words are encoded on their own: new ones together in
    one string, told apart by the bytes of their tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a byte-level vocabulary writes each byte as one character
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.book = WordBook(self._learn, CACHE_WORDS)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # those that begin and end at a cut can be encoded in one string, the others one by one
        joint = [i for i, w in enumerate(words) if w[0] in " \n" and not w[-1].isspace()]
        alone = sorted(set(range(len(words))).difference(joint))
        parts, sizes = self._whole([words[i] for i in alone]), np.zeros(len(words), np.int64)
        sizes[alone] = [len(p) for p in parts]
        for at in range(0, len(joint), TOGETHER):
            some = [words[i] for i in joint[at:at + TOGETHER]]
            ids, = self._whole(["".join(some)])
            ends = np.cumsum([len(w.encode()) for w in some])
            sizes[joint[at:at + TOGETHER]] = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.size[ids]), ends) + 1])
            parts.append(ids)
        rows = np.array(alone + joint, np.int64)
        values, place = np.concatenate([np.empty(0, np.uint32), *parts]), np.empty(len(words), np.int64)
        place[rows] = np.arange(len(rows))
        return gather(values, offsets_of(sizes[rows]), place)

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of words in the UTF-8 bytes of texts."""
        blank = (data == 0x20) | (data == 0x0A)
        blank[:1] = False
        before = np.r_[np.zeros(3, np.uint8), data][:len(data) + 2]      # data[i - 1] is before[i + 2]
        b1, b2, b3 = before[2:], before[1:-1], before[:-2]
        # the byte before may end a space of two (C2 ..) or three bytes (E1 .. E3 .. ..): no cut then
        blank &= (b1 > 0x20) & ~((b1 >= 0x80) & ((b2 == 0xC2) | ((b3 >= 0xE1) & (b3 <= 0xE3))))
        # a letter or digit: ASCII, or U+00C0 .. U+00FF but for the two signs among them
        sign = (CLASS[data] == PUNCTUATION) & ((CLASS[b1] == ALNUM) | ((b2 == 0xC3) & (b1 >= 0x80) & (b1 != 0x97) & (b1 != 0xB7)))
        blank |= sign
        blank[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(blank)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of ``texts``; null is empty."""
        data, offsets = text_buffer(texts)
        at = self.cuts(data, offsets)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ids, ends = self.book.rows(strings(data, np.r_[at, len(data)]))
        return ids, ends[np.searchsorted(at, offsets)]


_WORKER: dict[str, WordIds] = {}    # a worker keeps its tokenizer from task to task


def _words_of(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def cut_points(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of so many ids: ``(row, piece, start, length)``; the first piece takes the remainder."""
    first = np.where(lengths > max_len, (lengths - 1) % max_len + 1, lengths)
    count = 1 + (lengths - first) // max_len
    row = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, piece, np.where(piece > 0, first[row] + (piece - 1) * max_len, 0), np.where(piece > 0, max_len, first[row])


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; a null text is empty (its one id is ``end_id``)."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words_of(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = words.encode(part.column(1))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
                row, piece, start, length = cut_points(np.diff(offsets) + 1, max_len)
                raw, ends = ids.tobytes(), offsets_of(4 * length)          # the pieces follow each other
                view = memoryview(raw)
                crc = [zlib.crc32(view[a:b]) for a, b in pairwise(ends.tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
        words.book.clear()              # an idle worker holds no words

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# ---------------------------------------------------------------- configuration LP

def _knapsack(lens: np.ndarray, price: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for every capacity, and the length taken first (index, -1: none)."""
    best, take = np.zeros(cap + 1), np.full(cap + 1, -1)
    upto = np.searchsorted(lens, np.arange(cap + 1), "right")
    for j in range(1, cap + 1):
        best[j], take[j] = best[j - 1], -2                       # -2: leave one place empty
        if k := upto[j]:
            cand = price[:k] + best[j - lens[:k]]
            i = int(cand.argmax())
            if cand[i] > best[j]:
                best[j], take[j] = cand[i], i
    return best, take


def _trace(take: np.ndarray, lens: np.ndarray, j: int) -> list[int]:
    out = []
    while j > 0 and take[j] != -1:
        if take[j] == -2:
            j -= 1
        else:
            out.append(int(take[j]))
            j -= int(lens[take[j]])
    return out


def solve_lp(lens: np.ndarray, counts: np.ndarray, cap: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations (sorted indices into ``lens``) -> how often, covering ``counts`` fractionally.

    Round t brings every length to t / rounds of its count, in ``BLOCKS`` blocks
    with new prices before each.
    """
    cover, x, deal = np.zeros(len(lens)), {}, np.random.default_rng(0)
    for t in range(1, rounds + 1):
        due, order = counts * (t / rounds), deal.permutation(len(lens))
        for block in range(BLOCKS):
            ahead = np.clip((cover - due) / counts * rounds, -3, 3)
            _, take = _knapsack(lens, lens / cap * np.exp(-RATE * ahead), cap)
            for i in sorted(order[block::BLOCKS].tolist(), reverse=True):
                lack = due[i] - cover[i]
                if lack <= 1e-9 * counts[i]:
                    continue
                config = [i, *_trace(take, lens, cap - int(lens[i]))]
                amount = lack / config.count(i)
                for k in config:
                    cover[k] += amount
                key = tuple(sorted(config))
                x[key] = x.get(key, 0.0) + amount
    return x


def _fullest(lens: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Indices of lengths (each at most once) with the largest sum <= room, large ones preferred."""
    types = [int(i) for i in np.flatnonzero((left > 0) & (lens <= room))[::-1]]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, [1]
    for i in types:
        reach |= (reach << int(lens[i])) & mask
        steps.append(reach)
        if reach >> room:
            break
    j, out = reach.bit_length() - 1, []
    for s in range(len(steps) - 2, -1, -1):
        if not steps[s] >> j & 1:
            out.append(types[s])
            j -= int(lens[types[s]])
    return out


def plan(lens: np.ndarray, counts: np.ndarray, cap: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations (indices into ``lens``, any order) and how often; together exactly ``counts``."""
    left, out = counts.astype(np.int64).copy(), []

    def put(config, times):
        for i in config:
            left[i] -= times
        out.append((tuple(config), int(times)))

    for _ in range(SOLVES):
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        for picked, amount in sorted(solve_lp(lens[rest], left[rest].astype(float), cap, rounds).items(), key=lambda c: (-c[1], c[0])):
            config = [int(rest[i]) for i in picked]
            if sum(int(lens[i]) for i in config) >= FULL * cap:
                times = min(int(amount), *(int(left[i]) // config.count(i) for i in set(config)))
                if times > 0:
                    put(config, times)
    while left.any():
        i = int(np.flatnonzero(left)[-1])
        left[i] -= 1
        config = [i, *_fullest(lens, left, cap - int(lens[i]))]
        left[i] += 1
        used = {k: config.count(k) for k in config}
        put(config, min(int(left[k]) // n for k, n in used.items()))
    return out


def _rank_ranges(lens: np.ndarray, configs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces a sequence, first sequence, first offset), by first rank."""
    used, rows, seq = [0] * len(lens), {int(n): [] for n in lens}, 0
    for config, times in configs:
        off = 0
        for i in sorted(set(config), reverse=True):
            k, n = config.count(i), int(lens[i])
            rows[n].append((used[i], k, seq, off))
            used[i] += times * k
            off += k * n
        seq += times
    return {n: np.array(r, np.int64).reshape(-1, 4) for n, r in rows.items()}


# ---------------------------------------------------------------- placement

def pack(pieces: DataFrame, length_col: str = "length", max_len: int = MAX_LEN, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (two names it must not have).

    Lengths are 1 to ``max_len``. Equal rows are told apart by rank. An empty table stays empty.
    """
    pieces = materialise(pieces)
    hist = pieces.groupBy(length_col).count().orderBy(length_col).collect()      # at most max_len rows
    if any(r[0] is None or not 1 <= r[0] <= max_len for r in hist):
        raise ValueError(f"lengths must be 1 to {max_len}")
    lens, counts = np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64)
    ranges = _rank_ranges(lens, plan(lens, counts, max_len, rounds))

    bucket, rank, base = (fresh(pieces, c) for c in ("bucket", "rank", "base"))
    buckets = max(1, -(-int(counts.sum()) // BUCKET_ROWS))
    order = [c for c in pieces.columns if c != "ids"]
    spread = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(length_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = (spread.groupBy(length_col, bucket).agg(F.count("*").alias("n"))
             .withColumn(base, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy(length_col, bucket).orderBy(*order)
    ranked = spread.withColumn(rank, F.row_number().over(inside) - 1).join(bases, [length_col, bucket])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), at.to_numpy(np.int64)
        out = np.zeros((len(n), 2), np.int64)
        for v in np.unique(n):
            rows = np.flatnonzero(n == v)
            plan_rows = ranges[int(v)]
            first, k, seq, off = plan_rows[np.searchsorted(plan_rows[:, 0], r[rows], "right") - 1].T
            within = r[rows] - first
            out[rows, 0], out[rows, 1] = seq + within // k, off + within % k * v
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.withColumn(rank, place(F.col(length_col), F.col(rank) + F.col(base)))
    return placed.select(*pieces.columns, f"{rank}.sequence_id", f"{rank}.offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """All documents packed: ``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    Null and empty texts take one place (their end id); repeated rows are
    packed each; other columns are not read; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, id_col, text_col, tokenizer, max_len, end_id, with_ids), "length", max_len, rounds)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` with the ids of each sequence in order, from ``pack_documents(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # concat of binary: each sequence holds at most max_len ids
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
