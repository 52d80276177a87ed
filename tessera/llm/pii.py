"""PII: base patterns and information-theoretic sanitisation (operator 8).

DataFrame functions only.

**Base spans** are e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers, found by regular expressions as leftmost non-overlapping
matches; matches that fail their check are dropped. The expressions are the
plain ones made linear: they only start where a run of their first characters
starts (or the last match ended) and never give characters back.

**Disclosure.** A protected entity is the normalised value of a base span; its
context are the terms (letters and digits, at least ``MIN_TERM`` characters) of
the whole texts it occurs in. Over the corpus of N different texts

* ``IC(e) = -log2(n(e) / N)``, n(e) texts that have the entity,
* ``PMI(t; e) = log2(n(t, e) N / (df(t) n(e)))``, n(t, e) of them with term t,
  df(t) texts of the corpus that have it,
* ``disclosure(t, e) = PMI(t; e) / IC(e)``: 1 if the term occurs with that
  entity only, 0 if it tells nothing.

All counts are of different texts, so copies neither prove nor hide anything. Near
copies prove nothing either, however many they are: a term counts for an entity if
at least ``MIN_SUPPORT`` texts have both, and each further text brings new words at
``FRESH`` of the four places beside the term, on average over the texts (of several
mentions in a text, the word of the least hash at a place counts). A term is *removed* if it discloses any entity beyond ``REMOVE`` and
*generalised* to its shape beyond ``GENERALISE``, wherever it occurs in the corpus,
with or without a base span beside it.

Entities that occur in the same texts share all figures and are counted as one
class. A term can only disclose at least g if ``df <= n(e)^g N^(1-g)``; others leave
before terms meet classes, so a long list of addresses in some versions makes
rows in proportion to its length. Texts are known by a 128-bit hash; what travels
are terms and spans, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: kinds in their order within a start
KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"     # a whole run of 14 to 19 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{3,}+"
MIN_TERM = 3
MIN_SUPPORT = 2
NEIGHBOURS = (-2, -1, 1, 2)
FRESH = 3               # of the neighbours' places, new words that a further text has to bring
REMOVE = 0.9
GENERALISE = 0.75


# ---------------------------------------------------------------- base spans

def _prefix_sums(a: Column) -> Column:
    """Running sums of an array, by doubling steps (n log n)."""
    steps = F.ceil(F.log2(F.size(a) + F.lit(1.0))).cast("int")

    def double(acc: Column, d: Column) -> Column:
        reach = F.pow(F.lit(2), d).cast("int")
        return F.transform(acc, lambda x, i: x + F.when(i >= reach, F.get(acc, i - reach)).otherwise(0))
    return F.when(F.size(a) == 0, a).otherwise(F.aggregate(F.sequence(F.lit(0), steps), a, double))


def matches(text: Column, pattern: str) -> Column:
    """array(struct(start, end, value)): leftmost non-overlapping matches, code points, end exclusive."""
    def located(values: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        ends = _prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: g + F.length(v)))
        return F.zip_with(ends, values, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
    # a one-element array binds the matches once
    found = F.flatten(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), located))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def weigh(d: Column, i: Column) -> Column:
        n = F.ascii(d) - 48
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)
    digits = F.filter(F.split(F.reverse(_digits(v)), ""), lambda d: d != "")
    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array(struct(start, kind, end, entity)), by start, then kind."""
    checks = [(EMAIL, None, F.lower), (IP, lambda m: m["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), lambda v: v),
              (CARD, lambda m: _luhn(m["value"]), _digits), (PHONE, lambda m: F.length(_digits(m["value"])).between(10, 15), _digits)]

    def of_kind(k: int) -> Column:
        pattern, good, plain = checks[k]
        found = matches(text, pattern)
        return F.transform(found if good is None else F.filter(found, good), lambda m: F.struct(
            m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), F.concat(F.lit(KINDS[k] + ":"), plain(m["value"])).alias("entity")))
    return F.array_sort(F.concat(*map(of_kind, range(len(checks)))))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


# ---------------------------------------------------------------- disclosure

def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, so that positions stay."""
    def step(acc: Column, s: Column) -> Column:
        ahead = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], ahead, blank).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _words(text: Column, spans: Column) -> Column:
    """array(struct(term, shape, start, end)): all words outside the spans."""
    def shape(v: Column) -> Column:
        return F.when(v.rlike("^[0-9]+$"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    # a one-element array binds the blanked text once
    found = F.flatten(F.transform(F.array(_blanked(text, spans)), lambda t: matches(t, TERM)))
    return F.transform(found, lambda m: F.struct(F.lower(m["value"]).alias("term"), shape(m["value"]).alias("shape"), m["start"].alias("start"), m["end"].alias("end")))


def _key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def texts_with_entities(texts: DataFrame) -> DataFrame:
    """``texts(key, text)`` -> ``(key, base, words)`` of each text that has a base span (copies a row each)."""
    # generating from a filtered one-element array finds the spans once
    found = texts.select("key", "text", F.explode(F.filter(F.array(base_spans(F.col("text"))), lambda b: F.size(b) > 0)).alias("base"))
    return found.select("key", "base", _words(F.col("text"), F.col("base")).alias("words"))


def entity_classes(found: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``(class, key, n_e)``: entities in the same at least ``min_support`` texts are one class."""
    held = found.select("key", F.explode(F.array_distinct("base.entity")).alias("entity")).distinct()
    classes = (held.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor("key.a").alias("a"), F.bit_xor("key.b").alias("b"))
               .where(F.col("n_e") >= min_support).select("entity", "n_e", F.struct("n_e", "a", "b").alias("class")))
    return held.join(classes, "entity").select("class", "key", "n_e").distinct()


def class_terms(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, term, most, at0 .. at3)``: terms of the texts that have a class, the largest n(e) there, hashes of their neighbours."""
    most = classes.groupBy("key").agg(F.max("n_e").alias("most"))
    words = F.transform("words", lambda w, i: F.struct(w["term"].alias("term"), *[
        F.xxhash64(F.coalesce(F.get("words", i + d)["term"], F.lit(""))).alias(f"at{k}") for k, d in enumerate(NEIGHBOURS)]))
    rows = found.join(most, "key").select("key", "most", F.explode(words).alias("w")).select("key", "most", "w.*")
    return rows.groupBy("key", "most", "term").agg(*[F.min(f"at{k}").alias(f"at{k}") for k in range(len(NEIGHBOURS))])


def document_frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, df)``: different texts of ``texts(key, text)`` that have each of ``terms(term)``."""
    seen = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(terms, "term", "left_semi")
    return seen.distinct().groupBy("term").agg(F.count("*").alias("df"))


def _rare(count: str, most: str, n_texts: int, least: float) -> Column:
    """Whether a term in so many texts can disclose an entity of at most so many texts by ``least``."""
    return F.col(count) <= F.pow(most, F.lit(least)) * F.pow(F.lit(float(n_texts)), F.lit(1 - least)) + 1e-6


def supported_pairs(classes: DataFrame, terms: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``(class, term, n_e, n_te)`` of terms that count for a class."""
    pair, places = ["class", "term", "n_e"], F.array(*[f"at{k}" for k in range(len(NEIGHBOURS))])
    beside = terms.join(classes, "key").select(*pair, F.posexplode(places).alias("place", "at")).groupBy(*pair, "place", "at").agg(F.count("*").alias("n"))
    # counts add up in two steps, so no pair gathers its texts
    by_place = beside.groupBy(*pair, "place").agg(F.sum("n").alias("n_te"), F.count("*").alias("words"))
    return (by_place.groupBy(*pair).agg(F.max("n_te").alias("n_te"), F.sum(F.col("words") - 1).alias("fresh"))
            .where((F.col("n_te") >= min_support) & (F.col("fresh") >= FRESH * (F.col("n_te") - 1))).drop("fresh"))


def disclosures(pairs: DataFrame, frequencies: DataFrame, n_texts: int, least: float = GENERALISE) -> DataFrame:
    """``(class, term, disclosure)`` of at least ``least``."""
    content = -F.log2(F.col("n_e") / n_texts)
    pmi = F.log2(F.col("n_te") * float(n_texts) / (F.greatest("df", "n_te") * F.col("n_e")))
    scored = pairs.join(frequencies, "term").select("class", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure"))
    return scored.where(F.col("disclosure") >= least - 1e-12)


def disclosing_terms(texts: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, least: float = GENERALISE) -> DataFrame:
    """``(term, disclosure)``: the strongest disclosure of each term that discloses any entity by ``least``."""
    classes = materialise(entity_classes(found, min_support))
    terms = materialise(class_terms(found, classes))
    n_texts = texts.select("key").distinct().count()
    # df is at least the number of these texts: what is too frequent in them needs no count over all texts
    often = terms.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most")).where(F.col("n") >= min_support)
    often = often.where(_rare("n", "most", n_texts, least)).select("term", "n")
    pairs = supported_pairs(classes, terms.join(often.select("term"), "term"), min_support).join(often, "term")
    # few terms are left to be counted over all texts
    pairs = materialise(pairs.where(_rare("n", "n_e", n_texts, least)).drop("n"))
    scored = disclosures(pairs, document_frequencies(texts, pairs.select("term").distinct()), n_texts, least)
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


# ---------------------------------------------------------------- operator

SPAN = "struct<start:int,kind:int,end:int,label:string>"


def text_spans(texts: DataFrame, min_support: int = MIN_SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``(key, base, added)`` of each different text of ``texts(key, text)`` that has any span; written once."""
    found = materialise(texts_with_entities(texts))
    least = min(remove, generalise)
    strong = materialise(disclosing_terms(texts, found, min_support, least))
    # texts without a base span that have such a term
    hits = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(strong, "term", "left_semi").select("key").distinct()
    hits = materialise(hits.join(found.select("key").distinct(), "key", "left_anti"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,entity:string>>")
    more = texts.join(hits, "key", "left_semi").select("key", _words(F.col("text"), none).alias("words"))
    # an outer explosion adds no filter on the words, which Spark would evaluate for all texts
    words = found.select("key", "words").unionByName(more).select("key", F.explode_outer("words").alias("w")).select("key", "w.*")
    label = F.when(F.col("disclosure") >= remove, "").otherwise(F.col("shape")).alias("label")
    one = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end", label)
    # copies give equal spans: told apart before a text's are gathered
    added = words.join(strong, "term").select("key", one.alias("one")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("added"))
    base = found.groupBy("key").agg(F.first("base").alias("base"))
    return materialise(base.join(added, "key", "full"))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(_key(text).alias("key"), text.alias("text"))


def _all_spans(base: Column, added: Column) -> Column:
    labels = F.array(*map(F.lit, LABELS))
    base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("label")))
    none = F.array().cast(f"array<{SPAN}>")
    return F.array_sort(F.concat(F.coalesce(base, none), F.coalesce(added, none)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, remove: float = REMOVE,
         generalise: float = GENERALISE) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans, ``base_sha256``, ``spans`` (all) and ``n_terms`` (added).

    Null and empty texts have no spans. Repeated rows get equal spans and count
    as one text. An empty table gives an empty one; other columns are not read.
    """
    spans = text_spans(_texts(docs, text_col), min_support, remove, generalise)
    both = docs.select(F.col(id_col).alias("doc_id"), _key(F.coalesce(F.col(text_col), F.lit(""))).alias("key")).join(spans, "key", "left")
    base = F.coalesce("base", F.array().cast(spans.schema["base"].dataType))

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(len(LABELS))]
    return both.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                       spans_text(_all_spans(F.col("base"), F.col("added"))).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_terms"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span (by start) replaced by its label; what overlaps goes with the first."""
    def step(acc: Column, s: Column) -> Column:
        ahead = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], ahead).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = None, min_support: int = MIN_SUPPORT, remove: float = REMOVE,
             generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with protected spans masked and disclosing terms generalised or removed; same columns, same rows.

    ``length_col`` names a column that holds the text's code points, to be kept right. Null texts stay null.
    """
    # only texts with spans meet a table; Spark decides whether it is small enough to be sent to the others
    key, hit = fresh(docs, "key"), fresh(docs, "hit")
    spans = text_spans(_texts(docs, text_col), min_support, remove, generalise)
    spans = spans.select(F.col("key").alias(key), _all_spans(F.col("base"), F.col("added")).alias(hit))
    both = docs.withColumn(key, _key(F.coalesce(F.col(text_col), F.lit("")))).join(spans, key, "left")
    is_hit = F.col(hit).isNotNull()
    masked = both.withColumn(text_col, F.when(is_hit, replaced(F.col(text_col), F.col(hit))).otherwise(F.col(text_col)))
    if length_col is not None:
        kind = docs.schema[length_col].dataType
        masked = masked.withColumn(length_col, F.when(is_hit, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return masked.select(*docs.columns)
