"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same wanted number of copies, target / source size.
Its whole part is taken outright; the fractional parts are rounded dependently: two
units duel, one gets all the mass it can hold (or gives all it has), and the other
stays fractional and duels on. So the number of copies of a source is fixed up to the
last unit, and, as units duel with others of about their own size, so are its words.

The duels form a reduction tree. Leaves are blocks of about `block` units of one source
and one size class, dealt by hash; a block leaves at most one fractional unit. These
residuals meet in blocks of `block` on the next level, first within a size class, then
within a source. A level is one grouped fold, so no group exceeds a few blocks, however
large a source is. All random draws are hashes of doc_id and seed: reruns agree.

Defined cases: a null text has size 0; documents of size 0 take no part in duels and are
kept as often as the whole part of their source's factor says, but once at least. A null
source is the last source. An empty table, or one without words, gives targets of 0.
Rows that repeat doc_id, source and size are one unit and share its decision. Extra
columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import drop, materialize, n_words, packed


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # repeated along the sources in code point order, null last
    total_share: float = 1.5  # of all words
    cap: float = 2.0  # a source's target, as a multiple of its size
    block: int = 128
    seed: int = 17


def targets(sizes: DataFrame, c: MixConfig) -> DataFrame:
    """sizes(source, source_size), one row per source: adds target.

    With caps, resharing the excess by weight until no target is above its cap gives
    target = min(cap, level * weight) for one level; the level is found from the sources
    in order of cap / weight. The table has one row per source, and its windows run in
    one task: sources are names of collections, a few thousand of them, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(c.weights) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in c.weights]), turn.cast("int")))
    s = s.withColumn("bound", F.col("source_size") * c.cap).withColumn("fills_at", F.col("bound") / F.col("weight"))
    whole = Window.partitionBy()
    by_level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # if exactly the sources before this one are full, the level is what remains, shared among the rest by weight
    level = (F.sum("source_size").over(whole) * c.total_share - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # later sources give lower levels, so the first that isn't full has the highest
    right = F.max(F.when(F.col("level") <= F.col("fills_at") * (1 + 1e-12), F.col("level"))).over(whole)
    return s.withColumn("target", F.least("bound", F.coalesce(right, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


EPS = 1e-9  # mass this near to an integer is that integer: sums of fractions carry rounding errors


def _draw(c: MixConfig, *parts: Column) -> Column:
    """A number in [0, 1) from the hash of its parts."""
    return F.pmod(F.xxhash64(F.lit(c.seed), *parts), F.lit(1 << 53)) / float(1 << 53)


def _fold(units: Column, kind: str) -> Column:
    """Duel through a block: struct(open: the unit still fractional, if any; done: the units decided). kind: type of the ids."""
    unit = f"struct<id:{kind},size:bigint,p:double,u:double>"
    start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<struct<id:{kind},size:bigint,one:boolean>>").alias("done"))
    decided = lambda unit, one: F.array(F.struct(unit["id"].alias("id"), unit["size"].alias("size"), one.alias("one")))

    def duel(acc: Column, x: Column) -> Column:
        held = acc["open"]
        total = held["p"] + x["p"]
        # below 1, one of the two hands over its mass and is out; from 1 on, one of them becomes whole
        full = total >= 1 - EPS
        x_goes_on = F.when(full, x["u"] * (2 - total) < 1 - x["p"]).otherwise(x["u"] * total < x["p"])
        on, off = F.when(x_goes_on, x).otherwise(held), F.when(x_goes_on, held).otherwise(x)
        left = F.when(full, total - 1).otherwise(total)
        moved = F.struct(on["id"].alias("id"), on["size"].alias("size"), left.alias("p"), on["u"].alias("u"))
        done = F.concat(acc["done"], decided(off, full))
        first = F.struct(x.alias("open"), acc["done"].alias("done"))
        even = F.struct(F.lit(None).cast(unit).alias("open"), F.concat(done, decided(on, F.lit(False))).alias("done"))
        return F.when(held.isNull(), first).when(left < EPS, even).otherwise(F.struct(moved.alias("open"), done.alias("done")))

    return F.aggregate(units, start, duel)


def round_units(units: DataFrame, c: MixConfig, scratch: list[str] | None = None) -> DataFrame:
    """units(source, id, size, p) with p in (0, 1), id unique in its source: (source, id, size, one) by the reduction tree.

    scratch collects the paths of the tables that the result reads.
    """
    made: list[str] = []
    kind = units.schema["id"].dataType.simpleString()
    at = units.withColumn("class", F.floor(F.log2("size") * 8).cast("int"))
    blocks = at.groupBy("source", "class").agg(F.ceil(F.count(F.lit(1)) / c.block).cast("long").alias("blocks"))
    blocks = materialize(blocks, "blocks", made)
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    side = blocks.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "blocks")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))
    at = at.join(F.broadcast(side) if blocks.count() <= 20_000 else side, same)
    at = at.select("source", "class", F.pmod(F.xxhash64(F.lit(c.seed), "id"), F.col("blocks")).alias("block"), "id", "size", "p")
    done, level = [], 0
    while True:
        keys = ["source", "class", "block"] if most > 0 else ["source"]
        unit = F.struct("size", _draw(c, F.col("id"), F.lit(level)).alias("h"), "id", "p", _draw(c, F.lit(level), F.lit("duel"), F.col("id")).alias("u"))
        sorted_units = F.transform(F.sort_array(F.collect_list(unit)), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p"), x["u"].alias("u")))
        folded = at.groupBy(*keys).agg(sorted_units.alias("units")).select(*keys, _fold(F.col("units"), kind).alias("f"))
        folded = materialize(folded, "duels", scratch)
        done.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.size", "d.one"))
        open_units = folded.where("f.open is not null").select(*keys, "f.open.id", "f.open.size", "f.open.p")
        level += 1
        if most == 0:  # one unit a source at most is left: its mass is the chance of one more copy
            last = _draw(c, F.col("id"), F.lit("last")) < F.col("p")
            done.append(open_units.select("source", "id", "size", last.alias("one")))
            break
        at = open_units.withColumn("block", F.floor(F.col("block") / c.block))
        most = 0 if most == 1 else -(-most // c.block)
    drop(units.sparkSession, made)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def decide(docs: DataFrame, c: MixConfig, scratch: list[str] | None = None) -> DataFrame:
    """docs(doc_id, source, size): a row per distinct (doc_id, source, size) with rows, source_size, target and copies."""
    units = docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = materialize(units, "units", scratch)
    goals = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size")), c)
    goals = materialize(goals, "targets", scratch)
    factor = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(factor + EPS)).withColumn("p", F.greatest(factor - F.col("whole"), F.lit(0.0)))
    side = goals.select(F.col("source").alias("_s"), "source_size", "target", "whole", "p")
    side = F.broadcast(side) if side.count() <= 20_000 else side
    units = units.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # within its source a unit is told by its doc_id and size
    units = units.withColumn("id", F.struct(F.col("doc_id").alias("doc"), F.col("size").alias("words")))
    duelling = (F.col("size") > 0) & (F.col("p") > EPS)
    rounded = round_units(units.where(duelling).select("source", "id", (F.col("size") * F.col("rows")).alias("size"), "p"), c, scratch)
    extra = rounded.where("one").select(F.col("source").alias("_s"), F.col("id.doc").alias("_d"), F.col("id.words").alias("_w"), F.lit(1).alias("extra"))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_w"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.greatest(F.col("whole"), F.lit(1)))
    return units.join(extra, same, "left").select("doc_id", "source", "size", "rows", "source_size", "target", copies.cast("int").alias("copies"))


def mixture_table(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """One row per row of docs(doc_id, source, text): sizes, target and the words taken."""
    c = config or MixConfig()
    d = decide(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), c)
    each = d.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    c = config or MixConfig()
    scratch: list[str] = []
    d = decide(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), c, scratch)
    d = materialize(d.where("copies > 0").select("doc_id", "source", "size", "copies"), "copies")
    drop(docs.sparkSession, scratch)
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("_n") == F.col("size"))
    taken = packed(docs).withColumn("_n", n_words(F.col("row.text"))).join(d, same)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixture_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
