"""I-Match document fingerprints with randomised lexicons.  DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band.  A
document's terms in it, distinct and sorted, are hashed whole and in randomised lexicon
subsets: a family of nested subsets halves the lexicon level by level, and the
fingerprint holds the hash of the sparsest subset that the document still has
terms in.  The whole hash tells texts apart, sparse subsets survive edits.

The lower bound of the band is a share of the documents, so the lexicon has at
most (mean distinct terms per document) / LOW entries however many documents
there are; it is broadcast if a count confirms that, and shuffled otherwise.

Neighbours in id order are found without a global sort: ids are cut at
quantiles and evenly in between into buckets, each bucket is ordered in one
task, and gets the first row of the bucket that follows it as a guard row.
Texts are shuffled once, by bucket; fingerprints keep that partitioning.

Defined cases: null text is empty; a null id orders last; rows of one id are
ordered by text; equal texts have equal fingerprints; a text without lexicon
terms is fingerprinted by all of its terms, one without terms is "empty"; a
table of one row is its own neighbour; a text of any length is taken whole; of
columns that are named like the added one, that one stays, others are kept or
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

LOW, HIGH, MIN_DF = 0.001, 0.1, 2
FAMILIES, DEEPEST = 12, 40
#: Largest lexicon that is broadcast; documents of up to 2,000 distinct terms on average stay below it.
BROADCAST_TERMS = 2_000_000
QUANTILES, BUCKET_ROWS, BROADCAST_BUCKETS = 128, 4096, 100_000
#: Stands for the text itself, so that one without lexicon terms keeps its row.
MARK = -1


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    words = F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """h: terms in the band, and the mark."""
    n = docs.count()
    df = docs.select(F.explode(terms(text_of(docs))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= max(MIN_DF, math.ceil(low * n))) & (F.col("df") <= max(MIN_DF, math.floor(high * n)))).select("h")
    return materialize(band.union(docs.sparkSession.range(1).select(F.lit(MARK).cast("long"))), "imatch-lexicon")


def _depth(h: Column, family: int) -> Column:
    """How deep in the family's nested subsets a term is, as a power of two: each level keeps half of the one above."""
    g = F.xxhash64(h, F.lit(family)).bitwiseAND(F.lit((1 << DEEPEST) - 1)).bitwiseOR(F.lit(1 << DEEPEST))
    return g.bitwiseAND(-g)


def _deepest(arr: Column, family: int) -> Column:
    return F.array_max(F.transform(arr, lambda h: _depth(h, family)))


def _at_depth(arr: Column, family: int, depth: Column) -> Column:
    return F.filter(arr, lambda h: _depth(h, family) == depth)


def signatures(arr: Column, whole: Column, df: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the hash of the whole term list, then one of each family's sparsest subset that is not empty."""
    short = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    first = F.when(F.size(arr) > 0, short(F.xxhash64(arr))).when(whole.isNull(), F.lit("empty")).otherwise(F.concat(F.lit("~"), short(whole)))
    # The depth is a column of its own: inside the filter it would be computed again for each term.
    depth = {f: f"__{name}_{f}" for f in range(FAMILIES)}
    df = df.withColumns({c: _deepest(arr, f) for f, c in depth.items()})
    parts = [F.when(F.col(c).isNotNull(), short(F.xxhash64(F.col(c), _at_depth(arr, f, F.col(c))))).otherwise("") for f, c in depth.items()]
    return df.withColumn(name, F.array(first, *parts)).drop(*depth.values())


def likeness(a: Column, b: Column) -> Column:
    """1 for equal term lists, else the share of families whose sparsest subsets are equal.

    At the depth where either document still has a term there is mostly one, and
    it is in both as often as the documents share terms.
    """
    pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 2, FAMILIES)
    same = F.size(F.filter(pairs, lambda p: (p["a"] != "") & (p["a"] == p["b"])))
    return F.when(a[0] == b[0], 1.0).otherwise(same / float(FAMILIES))


def fingerprints(docs: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """All columns and ``fingerprint``, for tables that need no neighbours."""
    lex = lex if lex is not None else lexicon(docs)
    cols = [c for c in docs.columns if c != "fingerprint"]
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], *([] if "text" in cols else [F.lit("").alias("text")])).withColumn("__t", terms(text_of(docs))).withColumn("__rid", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("__whole", F.when(F.size("__t") > 0, F.xxhash64(F.array_sort("__t")))), "imatch-rows")
    got = rows.select("__rid", F.explode("__t").alias("h")).join(lex, "h").groupBy(F.col("__rid").alias("__r")).agg(F.array_sort(F.collect_list("h")).alias("__a"))
    out = rows.join(got, F.col("__rid") == F.col("__r"), "left").withColumn("__a", F.coalesce("__a", F.array().cast("array<bigint>")))
    return signatures(F.col("__a"), F.col("__whole"), out, "__fp").select(*[F.col(f"`{c}`") for c in cols], F.array_join("__fp", "-").alias("fingerprint"))


def _bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket (rising as ids fall), guard: rows and one guard row behind each bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 2000)).first()
    cuts = sorted(set(cuts or []))
    per = max(1, math.ceil(n / QUANTILES / BUCKET_ROWS))
    lows = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array(F.lit(0).cast("long"))
    at = F.greatest(F.lit(1), F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))))
    lo = F.element_at(lows, at)
    span = F.greatest(F.lit(1), F.coalesce(F.try_element_at(lows, at + 1), lo + 1) - lo)
    inner = F.least(F.lit(per - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - lo).cast("double") / span * per)))
    rows = rows.withColumn("bucket", F.coalesce(-(at.cast("long") * per + inner), F.lit(1)).cast("long"))
    key = F.struct("doc_id", F.xxhash64("text").alias("th"))
    firsts = materialize(rows.groupBy("bucket").agg(F.max(key).alias("k")), "imatch-buckets")
    w = Window.orderBy("bucket")
    lowest = F.first("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    highest = F.last("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guards = firsts.select(F.coalesce(F.lag("bucket").over(w), highest).alias("g_bucket"), F.col("k.doc_id").alias("g_id"), F.col("k.th").alias("g_th"), lowest.alias("lowest"))
    if firsts.count() <= BROADCAST_BUCKETS:
        guards = F.broadcast(guards)
    hit = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_th"))
    extra = rows.join(guards, hit).select("doc_id", "text", F.col("g_bucket").alias("bucket"), F.lit(1).alias("guard")).dropDuplicates(["bucket"])
    return rows.withColumn("guard", F.lit(0)).unionByName(extra)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_docs = docs.limit(1).count()
    lex = lexicon(docs)
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    rows = _bucketed(docs) if n_docs else docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("guard"))
    order = [F.col("guard"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumns({"rn": F.row_number().over(w), "nxt": F.lead("text").over(w)})
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("nxt", F.lit("")), F.lit(1), k))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "t0": terms(F.col("text")), "t1": terms(F.col("edited"))})
    whole = lambda c: F.when(F.size(c) > 0, F.xxhash64(F.array_sort(c)))
    keys = ["bucket", "rn", "guard", "doc_id", "n_chars", "edited_sha256", "w0", "w1"]
    rows = rows.withColumns({"w0": whole("t0"), "w1": whole("t1")}).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("which"), F.array_append("t1", F.lit(MARK).cast("long")).alias("t")))).alias("s"))
    hits = rows.select(*keys, F.col("s.which").alias("which"), F.explode("s.t").alias("h")).join(lex, "h")
    pick = lambda i: F.array_sort(F.collect_list(F.when((F.col("which") == i) & (F.col("h") != MARK), F.col("h"))))
    fp = hits.groupBy("bucket", "rn").agg(*[F.first(c).alias(c) for c in keys[2:]], pick(0).alias("a0"), pick(1).alias("a1"))
    fp = signatures(F.col("a0"), F.col("w0"), fp, "f0")
    fp = signatures(F.col("a1"), F.col("w1"), fp, "f1").drop("a0", "a1")
    w2 = Window.partitionBy("bucket").orderBy("rn")
    fp = fp.withColumn("f2", F.lead("f0").over(w2)).filter("guard = 0")
    return fp.select("doc_id", "n_chars", "edited_sha256", F.array_join("f0", "-").alias("fingerprint"), F.array_join("f1", "-").alias("edited_fingerprint"), likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("f2")).alias("near_next"))
