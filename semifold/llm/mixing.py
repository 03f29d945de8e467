"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only.

A source's documents are all wanted ``target / source_size`` times (at most 2).
The whole part is taken of each; the fractional part is rounded to 0 or 1 extra
copies so that the words add up: of a pair, words move from one document to the
other, either way with the odds that keep each document's expectation, until
one of them has 0 or all of its words.  The total stays as it was.  A chunk of
documents leaves one unfinished document, the unfinished ones of all chunks
form the next level's chunks, and the last one of a source is drawn alone, so a
source misses its target by less than one document.

Chunks are dealt by a hash of the document, with 64 expected in each, whatever
share of the rows a source holds; levels shrink 64-fold.  Rows equal in id,
source and size are one unit with a multiplicity, so repeats crowd no chunk.
All randomness is a hash, so reruns agree.

Defined cases: null or wordless text has size 0 and is never taken; a null
source is a source of its own, ranked last; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, materialize, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
CHUNK = 64
SEED = 20240501


def word_count(df: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(text_of(df, text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """sizes: source, source_size.  Adds target: min(cap * size, level * weight) with one level for all.

    That is where capping and resharing the excess by weight ends.  The level is
    found by one pass over the sources in order of cap / weight.  One row per
    source: the window holds no documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    s = s.withColumn("__pos", F.row_number().over(order))
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("__level", (F.lit(share) * F.sum("source_size").over(everything) - before) / left)
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    s = s.withColumn("__level", F.min(F.when(fits, F.struct("__pos", "__level"))).over(everything)["__level"])
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return s.select("source", "source_size", target.alias("target"))


def _unit(*cols) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _fold(arr: Column, level: int) -> Column:
    """Rounds a chunk in sequence; the result is the unfinished unit and the finished ones.

    A unit is struct(key, size, mass): mass is how many of its words are taken.
    """
    unit = "struct<key:bigint,size:double,mass:double>"
    zero = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        up, down = F.least(a["size"] - a["mass"], b["mass"]), F.least(a["mass"], b["size"] - b["mass"])
        rise = _unit(F.lit(level), a["key"], b["key"]) * (up + down) < down
        make = lambda u, mass: F.struct(u["key"].alias("key"), u["size"].alias("size"), mass.alias("mass"))
        a_full, b_empty = make(a, a["size"]), make(b, F.lit(0.0))
        a_empty, b_full = make(a, F.lit(0.0)), make(b, b["size"])
        done = F.when(rise, F.when(a["size"] - a["mass"] <= b["mass"], a_full).otherwise(b_empty)).otherwise(F.when(a["mass"] <= b["size"] - b["mass"], a_empty).otherwise(b_full))
        rest = F.when(rise, F.when(a["size"] - a["mass"] <= b["mass"], make(b, b["mass"] - (a["size"] - a["mass"]))).otherwise(make(a, a["mass"] + b["mass"]))).otherwise(
            F.when(a["mass"] <= b["size"] - b["mass"], make(b, b["mass"] + a["mass"])).otherwise(make(a, a["mass"] - (b["size"] - b["mass"])))
        )
        return F.when(a.isNull(), F.struct(b.alias("open"), acc["done"].alias("done"))).otherwise(F.struct(rest.alias("open"), F.concat(acc["done"], F.array(done)).alias("done")))

    return F.aggregate(arr, zero, step)


def pivotal_round(units: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """units: grp, key (bigint, unique in its grp), size, mass in (0, size).  Returns grp, key, taken (0 or 1).

    most: the number of units of the largest grp, from which the number of levels follows.
    """
    width = max(1, math.ceil(most / chunk))
    finished = []
    cur = units
    level = 0
    while True:
        # Each group is dealt to as many chunks as the largest needs at this level; smaller groups have emptier chunks.
        dealt = cur.withColumn("__chunk", F.pmod(F.xxhash64(F.lit(SEED + level), "grp", "key"), F.least(F.lit(width), F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))).cast("long")))
        arr = F.array_sort(F.collect_list(F.struct("key", "size", "mass")))
        folded = dealt.groupBy("grp", "n", "__chunk").agg(arr.alias("arr")).select("grp", "n", _fold(F.col("arr"), level).alias("r"))
        folded = materialize(folded, f"mix-level{level}")
        finished.append(folded.select("grp", F.explode("r.done").alias("u")).select("grp", F.col("u.key").alias("key"), (F.col("u.mass") > 0).cast("int").alias("taken")))
        cur = folded.select("grp", F.ceil(F.col("n") / chunk).alias("n"), "r.open.key", "r.open.size", "r.open.mass")
        level += 1
        if width == 1:
            break
        width = max(1, math.ceil(width / chunk))
    finished.append(cur.select("grp", "key", (_unit(F.lit(-1), F.col("grp"), F.col("key")) * F.col("size") < F.col("mass")).cast("int").alias("taken")))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, copies: how often all rows with these values are taken together."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(docs).alias("size"))
    groups = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("repeats")), "mix-rows")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share), "mix-targets")
    per = targets.select(F.col("source").alias("__s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__f"))
    wanted = join_small(groups, per, F.col("source").eqNullSafe(F.col("__s")), F.xxhash64("doc_id", "size")).drop("__s")
    total = F.col("repeats") * (F.col("__f") - F.floor("__f"))
    wanted = wanted.withColumns({"__key": F.xxhash64("doc_id", "size", "source"), "__whole": (F.col("repeats") * F.floor("__f") + F.floor(total)).cast("long"), "__part": total - F.floor(total)})
    wanted = materialize(wanted, "mix-wanted")
    units = wanted.filter((F.col("size") > 0) & (F.col("__part") > 0)).select(F.xxhash64("source").alias("grp"), F.col("__key").alias("key"), F.col("size").cast("double").alias("size"), (F.col("__part") * F.col("size")).alias("mass"))
    counts = materialize(units.groupBy("grp").agg(F.count("*").alias("n")), "mix-counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    if most:
        counts = counts.select(F.col("grp").alias("__g"), "n")
        rounded = pivotal_round(join_small(units, counts, F.col("grp") == F.col("__g"), F.col("key")).drop("__g"), most)
        extra = rounded.groupBy("key").agg(F.max("taken").cast("long").alias("__extra"))
        wanted = wanted.join(extra.withColumnRenamed("key", "__k"), F.col("__key") == F.col("__k"), "left")
    else:
        wanted = wanted.withColumn("__extra", F.lit(0).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("__whole") + F.coalesce("__extra", F.lit(0))).otherwise(0).cast("long")
    return wanted.select("doc_id", "source", "size", "source_size", "target", "repeats", copies.alias("copies"))


def per_row(mixed: DataFrame) -> DataFrame:
    """A row for each document row; repeats share their copies as evenly as whole numbers allow."""
    n = F.col("repeats")
    rows = mixed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("occurrence"))
    each = F.floor(F.col("copies") / n) + (F.col("occurrence") <= F.col("copies") % n).cast("long")
    return rows.withColumn("copies", each.cast("long"))


def taken(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, size, source_size, target, taken."""
    return per_row(mix(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with mix_size and mix_copies: how often each row is to be read.

    Columns of the documents that have these two names are replaced.  Texts are
    shuffled once, by one key that joins the decisions and numbers the repeats.
    """
    cols = [c for c in docs.columns if c not in ("mix_size", "mix_copies")]
    decided = mix(docs).filter("copies > 0").select(F.xxhash64("doc_id", "size", "source").alias("__key"), F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("mix_size"), F.col("repeats").alias("__repeats"), F.col("copies").alias("__copies"))
    source = F.col("source").cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in cols]).withColumn("__size", word_count(docs))
    rows = rows.withColumn("__key", F.xxhash64("doc_id", "__size", source))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & source.eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("mix_size"))
    hit = rows.join(decided, "__key").filter(on)
    w = Window.partitionBy("__key", "doc_id", "source", "mix_size").orderBy(F.xxhash64(*cols))
    each = F.floor(F.col("__copies") / F.col("__repeats")) + (F.row_number().over(w) <= F.col("__copies") % F.col("__repeats")).cast("long")
    return hit.withColumn("mix_copies", each.cast("long")).filter("mix_copies > 0").select(*[F.col(f"`{c}`") for c in cols], "mix_size", "mix_copies")
