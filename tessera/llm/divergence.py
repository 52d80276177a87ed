"""Source divergence audit by in-mapper stripes (operator 11).

How differently do the sources of a language use its terms? A term is a run of
ASCII letters and non-ASCII characters, A-Z lower-cased.

1. **Stripes.** A task folds the whole documents of its partition into hash
   stripes: term of a language -> documents that have it, occurrences in each
   source. A task that holds ``STRIPES`` entries spills them as rows and starts
   anew, so a key has one row a task and spill, however frequent it is.
2. **Merge.** Rows of a key meet in one task, sorted, and are added up. The
   merged stripes are written; terms in fewer than ``MIN_DOCS`` documents of the
   language are left out.
3. **Divergences.** With N occurrences in a group and V kept terms, a term has
   ``p = 1 + floor(UNIT * (count + 2) / (N + 2 V))`` and two shares differ by
   ``f = floor((p - q)^2 / (p + q))``. Merged stripes meet the totals of their
   language in shards of about ``SHARD_TERMS`` terms, so neither a language nor a source
   makes a hot task, and directly emit their part of each divergence. A source
   without the term has the constant share of count 0; stripes are sparse, and what two
   such shares give is counted, not listed.

Everything is exact integers. The totals, a row a (language, source), are joined
by language, not broadcast. Pairs of sources are the result itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .words import gather, offsets_of, slices, strings, text_buffer

MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
STRIPES = 1 << 20       # entries a task holds before it spills
NUMBERED = 1 << 15      # languages or sources a task holds; with those of a slice they fit 16 bits
SHARD_TERMS = 20_000
PAIR_CELLS = 1 << 20    # pairs of shares worked on together

#: separators become a space, A-Z a-z; bytes of non-ASCII characters stay
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def batch_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts in order, and the row of each."""
    raw, offsets = text_buffer(texts)
    data = np.frombuffer(raw.tobytes().translate(FOLD), np.uint8)
    letter = data != 0x20
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = letter[heads]                    # a term never spans two texts
    at = np.flatnonzero(begin)
    kept = np.r_[0, np.cumsum(letter)]
    return strings(data[letter], np.r_[kept[at], kept[-1]]), np.searchsorted(offsets, at, "right") - 1


class Stripes:
    """Hash stripes of a task: (language, term) -> documents, and occurrences in each source."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.langs: dict[str, int] = {}
        self.sources: dict[str, int] = {}
        self.terms: dict[str, int] = {}
        self.seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)]        # (term, lang) and how many documents
        self.found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]       # (term, lang, source) and how many occurrences
        self.size = 0

    @staticmethod
    def _numbers(values: list[str], known: dict[str, int]) -> np.ndarray:
        return np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values))

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        terms, row = batch_terms(texts)
        coded = terms.dictionary_encode()
        term = self._numbers(coded.dictionary.to_pylist(), self.terms)[coded.indices.to_numpy(zero_copy_only=False)]
        lang, source = self._numbers(langs, self.langs), self._numbers(sources, self.sources)
        docs = np.unique(row << 32 | term)                                  # each document counts once
        keys, n = np.unique((docs & 0xFFFFFFFF) << 16 | lang[docs >> 32], return_counts=True)
        self._put(self.seen, keys, n)
        keys, n = np.unique(term << 32 | lang[row] << 16 | source[row], return_counts=True)
        self._put(self.found, keys, n)
        self.size = sum(map(len, self.found[0]))

    @staticmethod
    def _put(table, keys, n) -> None:
        table[0].append(keys)
        table[1].append(n)

    def fold(self) -> None:
        """Adds up equal keys."""
        for table in (self.seen, self.found):
            keys, at = np.unique(np.concatenate(table[0]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate(table[1]))
            table[0][:], table[1][:] = [keys], [n]
        self.size = len(self.found[0][0])

    def full(self) -> bool:
        """True if the stripes should be spilled: too many sources to number, or still large once added up."""
        if self.size > self.most:
            self.fold()
            return self.size > self.most // 2
        return max(len(self.langs), len(self.sources)) > NUMBERED

    def spill(self) -> pa.RecordBatch | None:
        """All stripes as rows ``(lang, term, df, sources, counts)``."""
        self.fold()
        (seen,), (df,) = self.seen
        (found,), (n,) = self.found
        if not len(seen):
            return None
        lang, term = pa.array(list(self.langs)), pa.array(list(self.terms))
        at = np.searchsorted(found >> 16, seen)          # both are sorted by (term, lang)
        offsets = pa.array(np.r_[at, len(found)].astype(np.int32))
        out = pa.RecordBatch.from_arrays([
            lang.take(pa.array(seen & 0xFFFF)), term.take(pa.array(seen >> 16)), pa.array(df),
            pa.ListArray.from_arrays(offsets, pa.array(list(self.sources)).take(pa.array(found & 0xFFFF))), pa.ListArray.from_arrays(offsets, pa.array(n))],
            ["lang", "term", "df", "sources", "counts"])
        self.clear()
        return out


STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def _fold(most: int):
    def run(batches):
        stripes = Stripes(most)
        for batch in batches:
            for part in slices(batch, 2):
                stripes.add(part.column(2), part.column(0).to_pylist(), part.column(1).to_pylist())
                if stripes.full():
                    yield stripes.spill()
        if (rest := stripes.spill()) is not None:
            yield rest
    return run


def _added(rows: pa.Table) -> pa.Table:
    """One row for each run of equal keys."""
    rows = rows.combine_chunks()
    lang, term = (rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c) for c in ("lang", "term"))
    same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False).astype(bool)
    first = np.flatnonzero(np.r_[True, ~same])
    run = np.cumsum(np.r_[True, ~same]) - 1
    lists, n = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
    coded = lists.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key = np.repeat(run, pc.list_value_length(lists).to_numpy()) * width + coded.indices.to_numpy()
    entries, at = np.unique(key, return_inverse=True)
    counts = np.zeros(len(entries), np.int64)
    np.add.at(counts, at, n.flatten().to_numpy())
    offsets = pa.array(np.searchsorted(entries // width, np.arange(len(first) + 1)).astype(np.int32))
    keep = pa.array(first)
    return pa.table([lang.take(keep), term.take(keep), pa.array(np.add.reduceat(rows.column("df").to_numpy(), first)),
                     pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(entries % width))), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                    ["lang", "term", "df", "sources", "counts"])


def _merge(batches):
    """Rows sorted by (lang, term): one a key. The last key of a batch waits, added up, for the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        here = _added(here if rest is None else pa.concat_tables([rest.cast(here.schema), here]))
        yield from here.slice(0, here.num_rows - 1).to_batches()
        rest = here.slice(here.num_rows - 1)
    if rest is not None:
        yield from rest.to_batches()


def term_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = STRIPES) -> DataFrame:
    """``(lang, term, df, sources, counts)``: one merged stripe for each term of each language; nulls are empty strings."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    folded = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text")).mapInArrow(_fold(most), STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, STRIPE)


# ---------------------------------------------------------------- shares

def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 2) / total)`` by long division in steps of 1000, exact below 9e15."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, terms: int) -> np.ndarray:
    """Sums over ``terms`` terms of ``differ`` between all sources. Entries ``(term, source, p)`` are sorted by term; others have ``p0``."""
    n = len(p0)
    none = differ(p0[:, None], p0[None, :])
    out, half = none * terms, np.zeros((n, n), np.int64)
    # one of two has the term: equal shares of a source are worked out once
    order = np.lexsort((p, source))
    first = np.flatnonzero(np.r_[True, (source[order][1:] != source[order][:-1]) | (p[order][1:] != p[order][:-1])][:len(order)])
    times = np.diff(np.r_[first, len(order)])
    a, pa_ = source[order][first], p[order][first]
    for i in range(0, len(a), max(1, PAIR_CELLS // n)):
        rows = slice(i, i + max(1, PAIR_CELLS // n))
        np.add.at(half, a[rows], times[rows, None] * (differ(pa_[rows, None], p0[None, :]) - none[a[rows]]))
    out += half + half.T
    # both have it: what was added for each alone gives way to their own difference
    at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][:len(term)])
    size = np.diff(np.r_[at, len(term)])
    cells = offsets_of(size * size)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(cells, cells[i] + PAIR_CELLS, "right")) - 1)
        left = np.repeat(np.arange(at[i], at[i] + size[i:j].sum()), np.repeat(size[i:j], size[i:j]))
        right, _ = gather(np.arange(len(term)), np.r_[at, len(term)], np.repeat(np.arange(i, j), size[i:j]))
        x, y, px, py = source[left], source[right], p[left], p[right]
        np.add.at(out, (x, y), differ(px, py) - differ(px, p0[y]) - differ(p0[x], py) + none[x, y])
        i = j
    np.fill_diagonal(out, 0)
    return out


PARTS = "lang string, source string, part string, item string, value long"


def _emit(top: int):
    """A shard's stripes and its language's totals -> parts of pair sums, and the shard's strongest terms of each source."""
    def run(stripes: pa.Table, totals: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.string()) for n in ("lang", "source", "part", "item")] + [("value", pa.int64())])
        if not stripes.num_rows or not totals.num_rows:
            return schema.empty_table()
        lang = totals.column("lang")[0].as_py()
        names = totals.column("source").to_pylist()
        number = {s: i for i, s in enumerate(names)}
        total = totals.column("total").to_numpy().astype(np.int64)
        kept = int(totals.column("kept")[0].as_py())
        lists = stripes.column("sources").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        source = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        count = stripes.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        term = np.repeat(np.arange(stripes.num_rows), size)
        p = share(count, total[source] + 2 * kept)
        p0 = share(np.zeros(len(total), np.int64), total + 2 * kept)
        sums = pair_sums(term, source, p, p0, stripes.num_rows)
        a, b = np.nonzero(np.triu(sums, 1))
        # terms that a source uses more than its language does
        whole = np.add.reduceat(count, offsets_of(size)[:-1])
        q = share(whole, total.sum() + 2 * kept)[term]
        value = differ(p, q)
        words = stripes.column("term").combine_chunks()
        over = np.flatnonzero(p > q)
        by_word = np.argsort(np.argsort(np.array([w.encode() for w in words.to_pylist()], object), kind="stable"))
        order = over[np.lexsort((by_word[term[over]], -value[over], source[over]))]
        start = np.r_[True, source[order][1:] != source[order][:-1]][:len(order)]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        best = order[place < top]
        every = pa.array(names, pa.string())
        return pa.table([
            pa.array([lang] * (len(a) + len(best)), pa.string()),
            pa.concat_arrays([every.take(pa.array(a)), every.take(pa.array(source[best]))]),
            pa.array(["pair"] * len(a) + ["term"] * len(best), pa.string()),
            pa.concat_arrays([every.take(pa.array(b)), words.take(pa.array(term[best])).cast(pa.string())]),
            pa.array(np.r_[sums[a, b], value[best]], pa.int64())], schema=schema)
    return run


# ---------------------------------------------------------------- operator

def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS, stripes: int = STRIPES, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every (language, source) group.

    ``pair``: the divergence from each other source of the language (0 if no term
    is kept). ``term``: its strongest terms above the language's share, at most
    ``top_terms``. Nulls in any column read are empty strings; groups without
    terms count; repeated rows count each. An empty table gives an empty one;
    other columns are not read.
    """
    merged = materialise(term_stripes(docs, text_col, lang_col, source_col, stripes).where(F.col("df") >= min_docs))
    per_lang = merged.groupBy("lang").agg(F.count("*").alias("kept"))
    used = (merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
            .groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("total")))

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    totals = materialise(groups.join(used, ["lang", "source"], "left").join(per_lang, "lang", "left")
                         .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    shards = F.ceil(F.col("kept") / shard_terms).cast("long")
    salted = totals.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(shards, F.lit(1)) - 1)))
    placed = merged.join(per_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), shards).alias("shard"), "term", "sources", "counts")
    found = materialise(placed.groupBy("lang", "shard").cogroup(salted.groupBy("lang", "shard")).applyInArrow(_emit(top_terms), PARTS))

    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(terms)
