"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch, ranked, shuffle_key

#: Documents of a block at least, and the default weights: source sizes to this power.
BLOCK, POWER = 32, 0.8
#: Weights are whole parts of UNIT, so they are exact in 64 bits; blocks grow so that the schedule has about SLOTS slots at most.
UNIT, SLOTS = 1 << 40, 200_000
#: Slots whose order is one array while the schedule is made.
RUN = 512


def weighed(sizes: DataFrame, weights: dict[str, float] | None, power: float, block: int, slots: int) -> DataFrame:
    """``(source, k, n, a, block, blocks, slots)``: weight ``a / UNIT`` of each source, block size, and slots of the whole schedule.

    ``k`` numbers the sources by name, null first; sources without weight are left out. What rounding leaves of ``UNIT``, or takes too much, falls to the
    largest weight. The schedule is as long as the source that lasts longest for its weight needs for its last deadline.
    """
    if weights is None:
        w = F.pow(F.col("n"), F.lit(power))
    else:
        w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.coalesce("source", F.lit(""))], F.lit(0.0))
    every, by_name = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("source"))
    df = sizes.withColumn("w", w).where("w > 0")
    df = df.withColumn("a", F.floor(F.round(F.col("w") / F.sum("w").over(every), 9) * F.lit(float(UNIT))).cast("long"))
    df = df.where("a > 0").withColumn("k", F.row_number().over(by_name) - 1)
    largest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("a"), "k")) == 1
    df = df.withColumn("a", F.col("a") + F.when(largest, F.lit(UNIT) - F.sum("a").over(every)).otherwise(0))
    longest = F.max(F.ceil(F.col("n") * F.lit(float(UNIT)) / F.col("a") / slots)).over(every)
    df = df.withColumn("block", F.greatest(F.lit(block), longest).cast("long"))
    df = df.withColumn("blocks", F.ceil(F.col("n") / F.col("block")).cast("long"))
    end = F.max(F.expr(f"(blocks * {UNIT} + a - 1) div a")).over(every)
    return df.withColumn("slots", end.cast("long")).select("source", "k", "n", "a", "block", "blocks", "slots")


def schedule(plan: DataFrame) -> DataFrame:
    """Earliest deadline first over the whole mix: ``(k, i, slot)``, the i-th block of source ``k`` goes to ``slot``.

    Block i of a source with weight w is released at floor(i / w) and due at ceil((i + 1) / w). In every slot the released block with the earliest
    deadline goes first, ties to the earlier source. The weights add up to one, so all deadlines hold, and in every prefix of the mix a
    source is less than one block from its weight. A schedule is a sequence of decisions: it is one row's fold, over about ``SLOTS`` slots at
    most whatever the number of documents, or as many as the least weight needs for one block; a slot looks at every source once.
    """
    one = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"]).alias("a"), F.max("slots").alias("slots"))
    one = one.where("slots > 0")
    release = lambda i, a: F.call_function("div", i * F.lit(UNIT), a)
    due = lambda i, a: F.call_function("div", (i + 1) * F.lit(UNIT) + a - 1, a)

    def pick(state, t):
        # the key of a source's next block: its deadline, then the source; nothing if it is not released
        key = F.zip_with(state["next"], F.col("a"), lambda i, a: F.when(release(i, a) <= t, due(i, a)))
        best = F.array_position(key, F.array_min(key)).cast("int") - 1
        return F.struct(F.transform(state["next"], lambda i, k: F.when(k == best, i + 1).otherwise(i)).alias("next"),
                        F.array_append(state["order"], F.struct(best.alias("k"), F.get(state["next"], best).alias("i"))).alias("order"))

    def run(state, r):
        none = F.array().cast("array<struct<k:int,i:bigint>>")
        slots = F.sequence(r * RUN, F.least(r * RUN + RUN, F.col("slots")) - 1)
        done = F.aggregate(slots, F.struct(state["next"].alias("next"), none.alias("order")), pick)
        return F.transform(F.array(done), lambda d: F.struct(d["next"].alias("next"), F.array_append(state["runs"], d["order"]).alias("runs")))[0]

    start = F.struct(F.transform("a", lambda x: F.lit(0).cast("long")).alias("next"), F.array().cast("array<array<struct<k:int,i:bigint>>>").alias("runs"))
    runs = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("slots") - 1, F.lit(RUN)))
    order = one.select(F.aggregate(runs, start, run, lambda s: s["runs"]).alias("runs")).select(F.posexplode("runs").alias("r", "order"))
    return order.select("r", F.posexplode("order").alias("p", "o")).select("o.k", "o.i", (F.col("r").cast("long") * RUN + F.col("p")).alias("slot"))


def mix(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, power: float = POWER, block: int = BLOCK,
        slots: int = SLOTS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixed order: ``(row, key, k, epoch, slot, place)``, one row for each time that a document is used.

    Documents of a source are shuffled by a fixed hash and cut into blocks of ``block`` documents, or more where the schedule would have
    more than ``slots`` slots. The mix runs until every source has used its last block, so every document is used at least once; a source that ends
    earlier starts again, and ``epoch`` counts its rounds from 0. ``slot`` numbers the blocks of the mix, ``place`` the documents of a block. In every
    prefix of slots each source is less than one block from its weight.

    A null source is a source, named by "" in ``weights``; a source whose weight is missing, zero or below 1e-9 of all is not used. Repeated
    rows count as rows; a null id is shuffled like an empty one. An empty table gives no rows. ``row`` holds all columns of the document.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), shuffle_key(F.col(id_col)).alias("key"))
    sizes = scratch.keep(packed.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    plan = scratch.keep(weighed(sizes, weights, power, block, slots))
    order = scratch.keep(schedule(plan).select(F.col("k").alias("k2"), F.col("i").alias("i2"), "slot"))
    plan = plan.select(F.col("source").alias("s2"), "k", F.col("block").alias("per"), "blocks")
    # the mix ends when the last source has used its last block for the first time
    last = order.join(plan, (F.col("k") == F.col("k2")) & (F.col("i2") == F.col("blocks") - 1)).agg(F.max("slot").alias("last"))
    used = scratch.keep(order.join(F.broadcast(last), F.col("slot") <= F.col("last")).drop("last"))
    turns = used.groupBy("k2").agg(F.count(F.lit(1)).alias("turns"))
    plan = scratch.keep(plan.join(turns, F.col("k") == F.col("k2")).drop("k2"))
    rows = packed.join(plan, F.col("source").eqNullSafe(F.col("s2")))
    rows = ranked(rows, ["k"], "key", ["row.`%s`" % id_col], "rank")
    b = F.floor(F.col("rank") / F.col("per"))
    uses = F.sequence(F.lit(0).cast("long"), F.floor((F.col("turns") - 1 - b) / F.col("blocks")))
    rows = rows.withColumn("epoch", F.explode(uses)).withColumn("i", F.col("epoch") * F.col("blocks") + b)
    placed = rows.join(used, (F.col("k") == F.col("k2")) & (F.col("i") == F.col("i2")))
    return placed.select("row", "key", F.col("k").cast("int").alias("k"), "epoch", "slot", F.pmod("rank", F.col("per")).cast("int").alias("place"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 AS rank FROM d),
s AS (SELECT source, count(*) AS n, count(*) ** {POWER} AS w FROM d GROUP BY source),
g AS (SELECT source, n, CAST(floor(round(w / sum(w) OVER (), 9) * {float(UNIT)!r}) AS BIGINT) AS a, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM s),
p AS (SELECT source, n, k, CAST(a + CASE WHEN row_number() OVER (ORDER BY a DESC, k) = 1 THEN {UNIT} - sum(a) OVER () ELSE 0 END AS BIGINT) AS a,
  CAST(ceil(n / {BLOCK}) AS BIGINT) AS blocks FROM g),
t AS (SELECT list(a ORDER BY k) AS a, max((blocks * {UNIT} + a - 1) // a) AS slots FROM p),
e(t, nxt, k, i, a, slots) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), a, CAST(slots AS BIGINT) FROM t
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, j: CASE WHEN j = best THEN x + 1 ELSE x END), best, nxt[best], a, slots
  FROM (SELECT *, list_min(list_filter(list_transform(nxt, lambda x, j: CASE WHEN (x * {UNIT}) // a[j] <= t + 1
    THEN {{'due': ((x + 1) * {UNIT} + a[j] - 1) // a[j], 'j': j}} END), lambda v: v IS NOT NULL)).j AS best FROM e WHERE t + 1 < slots)),
z AS (SELECT max(e.t) AS last FROM p JOIN e ON p.k = e.k AND e.i = blocks - 1)
SELECT doc_id, r.source, i // blocks AS epoch, t AS slot, CAST(rank % {BLOCK} AS INTEGER) AS place
FROM e JOIN z ON t <= last JOIN p ON p.k = e.k JOIN r ON r.source IS NOT DISTINCT FROM p.source AND rank // {BLOCK} = i % blocks
"""
