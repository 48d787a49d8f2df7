"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target amount of words; its documents are then wanted ``target / source size``
times each. The whole part of that is taken as it is; the fractional parts are rounded to 0 or 1 by
the pivotal method: two fractions meet, mass moves at random from one to the other until one of them
is integral, and the remaining fraction meets the next. Sums of fractions are kept, so the number of
copies of a source is right but for one, and as fractions meet in the order of their documents' sizes
the number of words is near its target as well.

The rounding is a reduction tree. A leaf holds some ``LEAF`` documents of one source and one class of
sizes (so a source or a size that holds most rows has many leaves) and leaves one fraction; leaves are
combined ``LEAF`` at a time within the class, and the classes of a source at the end. Only ids and
sizes are shuffled, never texts. The draws are hashes of the ids, so reruns agree.

The only global sort is of the table of sources (one row each), for the ranks of the weights: one task holds some 100 bytes a
source.

Defined results: a null or empty text has size 0 and takes 0 words; a source of size 0 has target 0
and takes no copies; a null source is a source, sorted last; repeated rows, and rows without an id of one size, are
counted and numbered first, then rounded each on its own, so that many of them have many leaves; a text of any length has its
words counted; documents of equal size meet in the order of their ids; an empty table gives no rows; other columns
are ignored unless they are named as keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS, MOST, LEAF, SEED = (1.0, 2.0, 3.0), 3.0, 256, 20_26
#: Equal rows that are told apart at once.
NUMBERED = 4096
WORD = r"[^\x20\x09-\x0D]+"

#: One meeting of the fraction that is carried (acc.held, acc.p) with the next one (x).
_MEET = """
aggregate(
  slice(items, 2, greatest(size(items) - 1, 0)),
  named_struct('held', items[0].item, 'p', items[0].p, 'done', cast(array() as array<struct<item:{item},extra:int>>)),
  (acc, x) -> transform(
    array(named_struct(
      's', acc.p + x.p,
      'u', pmod(xxhash64({seed}, to_json(acc.held), to_json(x.item)), 1073741824L) / 1073741824D)),
    m -> transform(
      array(CASE
        WHEN m.s < 1D THEN m.u * m.s < acc.p
        ELSE m.u * (2D - m.s) < 1D - x.p END),
      first -> named_struct(
        'held', CASE WHEN (m.s < 1D) = first THEN acc.held ELSE x.item END,
        'p', CASE WHEN m.s < 1D THEN m.s ELSE m.s - 1D END,
        'done', concat(acc.done, array(named_struct(
          'item', CASE WHEN (m.s < 1D) = first THEN x.item ELSE acc.held END,
          'extra', CASE WHEN m.s < 1D THEN 0 ELSE 1 END)))))[0])[0])
"""


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size: one row each) with weight and target.

    The sources, by code point and null last, take the weights in turn and share the sum of all sizes
    by them; no target is above ``most`` times its source's size. That is the level at which
    min(level * weight, limit) sums to the total: in order of limit / weight the sources below the
    level stop at their limits, so one pass of running sums finds it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(turn, (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_limit", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / weight_left)
    # of the sources that are not stopped the first has the right level; it only falls after that
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    return rows.withColumn("target", F.least(F.col("_limit"), F.coalesce(level * F.col("weight"), F.col("_limit")))).drop("_limit", "_ratio", "_level")


def _fold(groups: DataFrame, by: list[str], item_type: str, seed: int) -> DataFrame:
    """groups (``by``, p, item, _at) -> one row per group: held, p, done."""
    gathered = groups.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", "item", "p"))).alias("items"))
    return gathered.select(*by, F.expr(_MEET.format(item=item_type, seed=seed)).alias("f")).select(*by, "f.held", "f.p", "f.done")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``, the number of a row among equal ones. They are counted, then told apart again, in two
    steps so that no array is long."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    apart = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / NUMBERED))))
    each = F.sequence(F.lit(0).cast("long"), F.least(F.col("_n") - F.col("_block") * NUMBERED, F.lit(NUMBERED)) - 1)
    return apart.withColumn("_nth", F.explode(each)).withColumn("_nth", F.col("_nth") + F.col("_block") * NUMBERED).drop("_n", "_block")


def mix(docs: DataFrame, keys: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, most: float = MOST, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, the columns ``keys``, source, size, source_size, target (its
    source's), copies and taken (copies * size)."""
    sized = materialise(_numbered(docs.select("doc_id", *keys, "source", size_of(F.col("text")).alias("size"))), "sizes")
    sized = sized.withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    classes = materialise(sized.groupBy("source", "_class").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows")), "classes")
    wanted = targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = classes.withColumnRenamed("source", "_s").join(wanted, F.col("_s").eqNullSafe(F.col("source")))
    plan = materialise(plan.select(F.col("_s"), F.col("_class").alias("_c"), F.ceil(F.col("_rows") / leaf).cast("int").alias("_leaves"), "source_size", "target", rate.alias("_rate")), "plan")
    most_leaves = plan.agg(F.max("_leaves")).first()[0]
    if most_leaves is None:
        schema = sized.drop("_class", "_nth")
        return schema.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    item = F.struct("doc_id", *keys, "size", "_nth", F.floor("_rate").cast("int").alias("whole"))
    leaf_no = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", *keys, "_nth"), F.col("_leaves")).cast("int")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    rows = rows.select("source", "_class", leaf_no.alias("_at"), item.alias("item"), (F.col("_rate") - F.floor("_rate")).alias("p"))
    item_type = rows.schema["item"].dataType.simpleString()
    level = rows.select("source", "_class", F.col("_at").alias("_node"), F.struct(F.col("item.size").alias("a"), F.col("item.doc_id").alias("b"), F.col("item._nth").alias("c")).alias("_at"), "item", "p")
    done, nodes = [], most_leaves
    while True:
        folded = materialise(_fold(level, ["source", "_class", "_node"], item_type, seed), "fold")
        done.append(folded.select("source", F.explode("done").alias("d")))
        at = F.struct(F.col("_class").cast("long").alias("a"), F.col("_node").cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
        if nodes == 1:
            break
        nodes = -(-nodes // leaf)
        level = folded.select("source", "_class", F.floor(F.col("_node") / leaf).cast("int").alias("_node"), at.alias("_at"), F.col("held").alias("item"), "p")
    last = materialise(_fold(folded.select("source", at.alias("_at"), F.col("held").alias("item"), "p"), ["source"], item_type, seed), "fold")
    done.append(last.select("source", F.explode("done").alias("d")))
    end = F.pmod(F.xxhash64(F.lit(seed), F.to_json("held")), F.lit(1 << 30)) < F.col("p") * (1 << 30)
    out = last.select("source", F.struct(F.col("held").alias("item"), end.cast("int").alias("extra")).alias("d"))
    for part in done:
        out = out.union(part)
    per_source = plan.select("_s", "source_size", "target").distinct()
    out = out.join(per_source, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("d.item.whole") + F.col("d.extra")
    return out.select("d.item.doc_id", *[f"d.item.{k}" for k in keys], "source", "d.item.size", "source_size", "target", copies.alias("copies"), (copies * F.col("d.item.size")).alias("taken"))
