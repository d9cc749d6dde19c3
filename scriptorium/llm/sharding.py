"""Sharding by balanced label propagation. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, ranked, shuffle_key

#: Shards, how far over its share a shard may be filled with linked rows between rounds, and rounds without gain after which they end.
SHARDS, SLACK, PATIENCE = 40, 0.25, 2
#: Rows of a group that share one salt in joins, and rows that one window ranks.
SALTED, RANKED = 256, 4096


def lookup(values: list[int], at: Column) -> Column:
    """The entry of a short list at an index."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)


def loads(state: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: as many numbers as shards."""
    got = dict(state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect())
    return [got.get(s, 0) for s in range(shards)]


def quotas(wishes: dict[tuple[int, int], int], load: list[int], most: int) -> list[int]:
    """How many rows may move from shard s to t, at place ``s * shards + t``, so that no shard ends with more than ``most``.

    All wishes are granted at first, so what leaves a shard makes room in it. Where a shard would still overflow, the moves into it
    are cut in proportion; that leaves more rows in other shards, so it is repeated until nothing changes. At most shards^2 numbers.
    """
    shards, flow, changed = len(load), dict(wishes), True
    while changed:
        changed = False
        for t in range(shards):
            into = [(s, n) for (s, x), n in flow.items() if x == t and n]
            over = load[t] + sum(n for _, n in into) - sum(n for (s, _), n in flow.items() if s == t) - most
            if over > 0 and into:
                total = sum(n for _, n in into)
                keep, given = max(0, total - over), 0
                for i, (s, n) in enumerate(sorted(into, key=lambda x: (-x[1], x[0]))):
                    flow[s, t] = min(n, -(-keep * n // total), keep - given)
                    given += flow[s, t]
                changed = True
    out = [0] * (shards * shards)
    for (s, t), n in flow.items():
        out[s * shards + t] = n
    return out


def propagate(linked: DataFrame, load: list[int], share: int, turn: int, bits: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """One round: linked rows wish to the shard that holds most of their group, and move as far as quotas allow; also the links kept before.

    A hash of the group, the shard and the round decides between shards that hold as many, so wishes point both ways between any two shards and
    change if they are refused. A group whose shard is full turns every other round to the fullest of its shards with room. A
    fixed random order decides whom a quota admits.
    """
    shards, room = len(load), [max(0, share - n) for n in load]
    held = scratch.keep(linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts")))
    kept = held.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0
    place = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)).alias("luck"), "shard")
    spare = F.max(F.when(lookup(room, F.col("shard")) > 0, place))
    best = held.groupBy(F.col("g").alias("g2")).agg(F.max(place).alias("best"), spare.alias("next"))
    full = (F.col("best.n") >= share) | ((lookup(room, F.col("best.shard")) == 0) & (F.pmod(F.xxhash64("g2", F.lit(turn)), F.lit(2)) == 1))
    best = best.select("g2", F.when(full, F.coalesce("next", "best")).otherwise(F.col("best")).alias("to"))
    own = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)).alias("luck"), "shard")
    wish = held.join(best, F.col("g") == F.col("g2")).where((F.col("n") < share) & (F.col("to") > own))
    wish = scratch.keep(wish.select(F.col("g").alias("g3"), F.col("shard").alias("s3"), F.col("to.shard").alias("target"), "n", "salts"))
    asked = wish.groupBy("s3", "target").agg(F.sum("n").alias("n")).collect()
    allowed = quotas({(r["s3"], r["target"]): r["n"] for r in asked}, load, share)
    # a hot group's rows are dealt over its salts, its one wish a shard goes to all of them
    copies = wish.select("g3", "s3", "target", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("t3"))
    on = (F.col("g") == F.col("g3")) & (F.col("shard") == F.col("s3")) & (F.col("salt") == F.col("t3"))
    rows = scratch.keep(linked.join(copies, on, "left").drop("g3", "s3", "t3"))
    moving = ranked(rows.where("target is not null"), ["shard", "target"], "key", ["doc_id", "size"], "turn", bits)
    admitted = F.col("turn") < lookup(allowed, F.col("shard") * shards + F.col("target"))
    moved = moving.withColumn("shard", F.when(admitted, F.col("target")).otherwise(F.col("shard")))
    cols = linked.columns
    done = scratch.keep(moved.select(*cols).union(rows.where("target is null").select(*cols)))
    scratch.drop(held, wish, rows)
    return done, int(kept)


def shard(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Law ``rows``: counts differ by at most one.

    Links join documents with equal texts; null texts count as empty. Shards start by hash. In each round linked rows
    move to the shard where most of their group is, within its quota; a group too large for a shard fills several. Rounds end when ``PATIENCE``
    of them have kept no more links. At the end shards above their exact share give rows away, unlinked ones first and a group's rows
    one after the other, and the others take them by rank. Repeated rows and null ids are rows like others; an empty table gives no rows;
    other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), shuffle_key(F.col(id_col)).alias("key"))
    rows = scratch.keep(rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.keep(groups.select(F.col("g").alias("g1"), F.ceil(F.col("n") / SALTED).cast("int").alias("salts")))
    rows = rows.join(groups, F.col("g") == F.col("g1"), "left").withColumn("linked", F.col("g1").isNotNull()).drop("g1")
    rows = scratch.keep(rows.withColumn("salt", F.pmod(F.xxhash64("key", "doc_id"), F.col("salts")).cast("int")))
    single, linked = rows.where("not linked"), rows.where("linked")
    alone = loads(single, shards)
    now = loads(linked, shards)
    total = sum(alone) + sum(now)
    bits = max(4, (total // (shards * RANKED)).bit_length())
    best, idle, turn = -1, 0, 0
    while sum(now) and idle < PATIENCE:
        after, kept = propagate(linked, now, int(total * (1 + SLACK) / shards) + 1, turn, bits, scratch)
        if turn:
            scratch.drop(linked)
        linked, now, turn = after, loads(after, shards), turn + 1
        best, idle = max(best, kept), 0 if kept > best else idle + 1
    # exact shares: the fullest shards keep the odd rows
    load = [a + b for a, b in zip(alone, now)]
    share = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-load[s], s))[:total % shards]:
        share[s] += 1
    # rows of large holdings first within a shard, unlinked ones last, so that what leaves cuts few links
    held = linked.groupBy("g", "shard").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("long").alias("level"), F.max("salts").alias("salts"))
    held = held.select("g", "shard", "level", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    cols = ["doc_id", "size", "text_crc32", "key", "g", "shard", "level"]
    state = single.withColumn("level", F.lit(0).cast("long")).select(*cols).union(linked.join(held, ["g", "shard", "salt"]).select(*cols))
    # a large holding is spread over the ranges of its level by row, a small one stays in one piece
    at = F.when(F.col("level") < 8, F.shiftrightunsigned(F.xxhash64("g"), 10)).otherwise(F.shiftright("key", 6))
    by = F.lit(63 << 54) - F.col("level") * F.lit(1 << 54) + at
    bits += 6
    state = scratch.keep(ranked(state.withColumn("by", by), ["shard"], "by", ["g", "doc_id", "size"], "rank", bits))
    stay = F.col("rank") < lookup(share, F.col("shard"))
    leave = ranked(state.where(~stay).withColumn("all", F.lit(0)), ["all"], "by", ["g", "doc_id", "size"], "turn", bits)
    need, ends = [max(0, share[s] - load[s]) for s in range(shards)], []
    for n in need:
        ends.append((ends[-1] if ends else 0) + n)
    target = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("turn")))
    start = F.col("turn") - lookup([0, *ends[:-1]], target)
    came = leave.select("doc_id", "size", "text_crc32", target.cast("int").alias("shard"), (start + lookup(load, target)).alias("slot"))
    out = state.where(stay).select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot")).union(came)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
