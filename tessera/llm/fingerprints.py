"""Document fingerprints by I-Match: hashes of a document's terms in randomised lexicons.  All JVM-side.

A term is a distinct word of the lower-cased text.  The lexicon keeps the terms whose inverse document
frequency lies in a band; document frequencies are counted over the whole corpus, each term by its 64-bit hash.  The
band is set by shares of documents, so the number of its terms is bounded by terms per document / least share at
every size of the corpus.  Terms in the band are kept as a Bloom filter of two bits a term, sized to their number, those above it as a
short list: so a term above the band is never taken for one in it, and one below it is with a chance of about 1/1000 with up to 2^17 terms in
the band, 1/64 with 2^19.

Each randomised lexicon is a random subset of the lexicon that keeps each term with a fixed chance.  There are families of
lexicons with chances of 1/4, 1/16, ... 1/4096 and the whole lexicon.  A component is the hash of all of the document's sorted
distinct terms that a lexicon keeps, or null if it keeps none.  Equal texts have equal fingerprints; a component of two documents
is equal if they differ in no term of its lexicon, so that larger lexicons tell copies from near copies, and smaller ones still agree on
texts that share half of their terms.  Likeness is the share of equal components among lexicons that keep a term of either document.

Defined results: a null text is empty; a text without words has the fingerprint ''; two of these are alike (1),
one of these and any other are not (0); if no term is in the band, all terms count; a very long text costs in proportion to its
terms; repeated rows and equal ids stand in the order of their text; a null id stands first; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Runs of ASCII characters other than digits and letters part words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), BETWEEN_WORDS))


#: Families of randomised lexicons are groups of a hash times windows of its bits; in each, lexicon k keeps a term with a chance of 4^-k.
GROUPS, WINDOWS, LEVELS = 4, 4, 6


#: A term's slots of the filter: two parts of its hash.
_PROBES = (lambda h, bits: h.bitwiseAND((1 << bits) - 1), lambda h, bits: F.shiftrightunsigned(h, 64 - bits))


@dataclass(frozen=True)
class Lexicon:
    """Terms of the band as a Bloom filter, comma-joined longs of 64 slots each, and hashes of the terms above it."""

    bitmap: str
    slot_bits: int
    frequent: tuple[int, ...]


def lexicon(docs: DataFrame, text_col: str, least_docs: int, least_share: float, most_share: float) -> Lexicon:
    """The band's terms: in at least ``least_docs`` documents and ``least_share`` of them, and in at most ``most_share``."""
    total = docs.count()
    least, most = max(least_docs, least_share * total), max(least_docs, most_share * total)
    words = docs.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("w")).where("w <> ''")
    counts = written(words.groupBy(F.xxhash64("w").alias("term")).count().where(F.col("count") >= least), "terms")
    frequent = tuple(sorted(r[0] for r in counts.where(F.col("count") > most).select("term").collect()))  # at most terms a document / most_share
    band = counts.where(F.col("count") <= most)
    slot_bits = min(23, max(16, (64 * band.count()).bit_length()))
    slot = F.explode(F.array(*(probe(F.col("term"), slot_bits) for probe in _PROBES))).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    longs = band.select(slot).groupBy(F.shiftright("slot", 6).cast("int").alias("k")).agg(F.bit_or(bit).alias("bits"))
    out = [0] * (1 << (slot_bits - 6))
    for r in longs.toLocalIterator():  # at most 2^17 rows
        out[r[0]] = r[1]
    return Lexicon(",".join(map(str, out)), slot_bits, frequent)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value found once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column, lex: Lexicon) -> Column:
    """Array of one hash a lexicon, null where it keeps no term: the whole lexicon's, then by family and level; empty if the text has no word."""
    bits = F.split(F.lit(lex.bitmap), ",").cast("array<bigint>")  # folded to one literal
    every = F.sort_array(F.transform(F.filter(_words(text), lambda w: w != ""), lambda w: F.xxhash64(w)))

    def banded(bitmap, h):
        inside = F.lit(True)
        for probe in _PROBES:
            slot = probe(h, lex.slot_bits)
            word = F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int"))
            inside = inside & (F.call_function("getbit", word, slot.bitwiseAND(63).cast("int")) == 1)
        return inside & ~h.isin(*lex.frequent) if lex.frequent else inside

    def component(terms):
        return F.when(F.size(terms) > 0, F.xxhash64(terms))

    def of_family(hashes, window):
        def kept(h, level):
            return F.filter(h, lambda x: F.shiftrightunsigned(x, 2 * LEVELS * window).bitwiseAND(4**level - 1) == 0)

        deeper = lambda h2: F.array(component(h2), *(component(kept(h2, k)) for k in range(3, LEVELS + 1)))
        return _let(kept(hashes, 1), lambda h1: F.concat(F.array(component(h1)), _let(kept(h1, 2), deeper)))

    def of_group(terms, group):
        return _let(F.transform(terms, lambda t: F.xxhash64(t, F.lit(group))), lambda h: F.concat(*(of_family(h, k) for k in range(WINDOWS))))

    def components(terms):
        return F.when(F.size(terms) == 0, F.array().cast("array<bigint>")).otherwise(F.concat(F.array(component(terms)), *(of_group(terms, k) for k in range(GROUPS))))

    return _let(every, lambda t: _let(_let(bits, lambda bitmap: F.filter(t, lambda h: banded(bitmap, h))), lambda b: components(F.when(F.size(b) > 0, b).otherwise(t))))


def as_text(components: Column) -> Column:
    """Four hexadecimal digits a lexicon, or dots."""
    return F.array_join(F.transform(components, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFF))), 4, "0"), F.lit("...."))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among lexicons that keep a term of either, 0 to 1."""
    # 1: equal; 0: not; null: neither keeps a term
    share = _let(F.array_compact(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).when(x.isNotNull() | y.isNotNull(), 0))), lambda p: F.size(F.array_remove(p, 0)) / F.size(p))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(share)


def _bucket_of(key: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of bounds at or below ``key``, plus ``low``: a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _bucket_of(key, bounds[:mid], low)).otherwise(_bucket_of(key, bounds[mid + 1 :], low + mid + 1))


def with_next(docs: DataFrame, columns: list[str], derive=lambda df: df, id_col: str = "doc_id", tie_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` with a struct ``next`` of ``columns`` of the document next by id; the first one after the last.

    ``derive`` may add columns once rows are dealt: what stands before that runs twice, as ranges are sampled.

    Ids are dealt into ranges by quantiles.  The rows at a range's lower bound also go to the range before it, and the
    first rows to the last, so one shuffle serves and no window spans more than a range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(key.alias("key"))
    least = keys.agg(F.min("key")).first()[0]
    # the quantile function keeps values of the data; doubles would blur large ids
    cuts = keys.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0] or []
    bounds = sorted(set(cuts) - {least})
    rows = docs.withColumn("__key", key).withColumn("__bucket", _bucket_of(F.col("__key"), bounds).cast("int"))
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("again"), F.lit(0).alias("wrap"))
    before = F.struct((F.col("__bucket") - 1).alias("bucket"), F.lit(1).alias("again"), F.lit(0).alias("wrap"))
    last = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(1).alias("again"), F.lit(1).alias("wrap"))
    lower = F.element_at(F.array(*(F.lit(b) for b in [0, *bounds])), F.col("__bucket") + 1) if bounds else F.lit(0)
    at_bound = (F.col("__bucket") > 0) & (F.col("__key") == lower)
    places = F.when(at_bound, F.array(own, before)).when(F.col("__key") == F.lit(least), F.array(own, last)).otherwise(F.array(own))
    dealt = rows.withColumn("__at", F.explode(places)).withColumn("__bucket", F.col("__at.bucket")).repartitionByRange(parts, "__bucket")
    from pyspark.sql import Window

    order = Window.partitionBy("__bucket").orderBy(F.col("__at.wrap"), "__key", F.col("__at.again"), F.col(tie_col).asc_nulls_first())
    led = derive(dealt).withColumn("next", F.lead(F.struct(*columns)).over(order)).where("__at.again = 0")
    return led.drop("__key", "__bucket", "__at")


def fingerprints(
    docs: DataFrame, least_docs: int = 2, least_share: float = 1e-5, most_share: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The band keeps terms of at least ``least_docs`` documents and ``least_share`` of all, and at most ``most_share`` of all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lex = lexicon(rows, "text", least_docs, least_share, most_share)
    led = with_next(rows, ["text", "own"], lambda df: df.withColumn("own", fingerprint(F.col("text"), lex)))
    half = F.floor(F.length("text") / 2).cast("int")
    led = led.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next.text", half)))
    led = led.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", F.col("next.own").alias("following"), fingerprint(F.col("edited"), lex).alias("other"))
    return led.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
