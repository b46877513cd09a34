"""Sharding by balanced label propagation.

Documents with the same text are linked, and shards are labels. Copies of a text under one
label are a parcel; they are alike, so only the numbers of parcels move until the end. In
every round a text's parcels are joined with its parcels under other labels, and wish to
go where most of their neighbours are. How many rows may go from each shard to each other one
is decided on the table of wishes by pairs of shards, so that no shard gets more linked
rows than its quota: shards exchange rows, and what room there is takes the rest
(Ugander and Backstrom, 2013). The parcels with most copies go first, and a parcel may go in part.
When nobody can follow most neighbours, parcels follow the largest one that has room; when
that moves nobody either, a text that is still in several shards moves to one with room
for all of it. Every move joins more linked documents than it parts, so the rounds end, when no
parcel moves. Documents without a copy cut no edge wherever they are; they even out
the shards, whose row counts end at most one apart.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvine.llm.common import text_of
from curvine.plans.join_hot import MAX_HOT_KEYS, join_lookup
from curvine.plans.ranking import rank_rows, running_totals
from curvine.session import checkpoint

SHARDS = 24
# Choices among equal parcels that are tried when none can move.
TURNS = 3
# Parcels (about 100 bytes each) that one task may move; a table of more stays spread over the shuffle partitions.
TASK_PARCELS = 1 << 17


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, copies)``, one row per input row.

    ``size`` is the UTF-8 length of the text plus 8, ``slot`` counts from 0 inside the
    shard, ``copies`` is the number of rows with the same text. Law ``rows``: row
    counts of shards differ by one at most. A null text equals the empty one; repeated
    ids, null ids and repeated rows are rows like any other, each with its own slot;
    an empty table gives no rows; other columns are not read.
    """
    rows = checkpoint(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text_of()) + F.lit(8)).cast("bigint").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
            F.sha2(text_of(), 256).alias("same"),
        )
    )
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    unique = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = checkpoint(rank_rows(rows, unique, ["same"], "copy", totals_too=True).withColumnRenamed("copy_total", "copies"))
    linked, lone = ranked.filter("copies > 1"), ranked.filter("copies = 1")
    label = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)).cast("int")
    # at most as many parcels of a text as there are shards
    parcels, room = propagate(linked.groupBy("same", label.alias("label")).agg(F.count(F.lit(1)).alias("n")), quota)
    sofar = Window.partitionBy("same").orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = parcels.withColumn("upto", F.sum("n").over(sofar)).groupBy("same").agg(F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("ends"), F.sum("n").alias("members"))
    dealt = join_lookup(linked, checkpoint(plan), "same", max(2, total // MAX_HOT_KEYS), "members")
    kept = ["doc_id", "size", "text_crc32", "copies"]
    placed = dealt.select(*kept, F.filter("ends", lambda e: e["upto"] >= F.col("copy"))[0]["label"].alias("shard"))
    filled = rank_rows(lone.select(*kept), [F.xxhash64("doc_id", "text_crc32"), *unique], rank="nth", settle=True)
    ends, upto = [], 0
    for s in range(shards):
        upto += room[s]
        ends.append(upto)
    # the first shard whose running room reaches the rank; 24 literals, not a join
    first = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e < F.col("nth")))
    everyone = placed.unionByName(filled.select(*kept, first.cast("int").alias("shard")))
    slotted = rank_rows(everyone, unique, ["shard"], "slot", settle=True)
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "copies",
    )


def cut_edges(parcels: DataFrame) -> DataFrame:
    """One row ``(edges, cut)``: pairs of linked documents, and those in two shards, of ``(same, label, n)``."""
    per_text = parcels.groupBy("same").agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("whole"))
    edges = F.col("t") * (F.col("t") - 1) / 2
    return per_text.agg(F.coalesce(F.sum(edges), F.lit(0)).cast("bigint").alias("edges"), F.coalesce(F.sum(edges - F.col("whole")), F.lit(0)).cast("bigint").alias("cut"))


def propagate(parcels: DataFrame, quota: list[int], task_parcels: int = TASK_PARCELS) -> tuple[DataFrame, list[int]]:
    """``(same, label, n)`` when no parcel moves any more, and the rows that each shard has left of its quota.

    There are many rounds, and parcels are few beside the rows: up to ``task_parcels`` of them
    are one task's work in every round, since a shuffle of so few costs more than the round.
    """
    parcels = _within_quota(checkpoint(parcels), quota)
    # rounds make no more parcels than there are
    few = parcels.count() <= task_parcels
    if few:
        parcels = checkpoint(parcels.coalesce(1))
    room = _room(parcels, quota)
    # among equals other aims are tried too, before anyone looks for room
    ways = [partial(_to_most, turn=turn) for turn in range(TURNS)] + [_to_most_with_room, partial(_to_one, few=few)]
    kind = 0
    while kind < len(ways):
        wishes = ways[kind](parcels.coalesce(1), room) if few else checkpoint(ways[kind](parcels, room))
        asked = [[0] * len(quota) for _ in quota]
        for r in wishes.groupBy("label", "to").agg(F.sum("n").alias("n")).collect():
            asked[r["label"]][r["to"]] = r["n"]
        # texts that move as wholes have checked their room themselves
        granted = asked if kind == len(ways) - 1 else grant(asked, room, exchange=kind < TURNS)
        if not any(map(any, granted)):
            kind += 1
            continue
        parcels = checkpoint(_moved(parcels, wishes, granted, few))
        room = [r + sum(granted[s]) - sum(row[s] for row in granted) for s, r in enumerate(room)]
        kind = 0
    return parcels, room


def _room(parcels: DataFrame, quota: list[int]) -> list[int]:
    """At most one row per shard."""
    used = {r["label"]: r["n"] for r in parcels.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return [q - used.get(s, 0) for s, q in enumerate(quota)]


def _within_quota(parcels: DataFrame, quota: list[int]) -> DataFrame:
    """The first labels come from a hash; rows above a shard's quota go where there is room, smallest parcels first."""
    room = _room(parcels, quota)
    if min(room, default=0) >= 0:
        return parcels
    over = [[0] * len(quota) for _ in quota]
    for s, r in enumerate(room):
        for t in range(len(quota)):
            if room[s] < 0 < room[t]:
                over[s][t] = d = min(-room[s], room[t])
                room[s] += d
                room[t] -= d
    ends = {s: [sum(over[s][: t + 1]) for t in range(len(quota))] for s in range(len(quota)) if any(over[s])}
    lined = running_totals(parcels.filter(F.col("label").isin(list(ends))), [F.col("n"), F.col("same")], {"upto": F.col("n")}, ["label"], settle=True)
    out = parcels.filter(~F.col("label").isin(list(ends)))
    for s, upto in ends.items():
        own = lined.filter(F.col("label") == s)
        low = [0, *upto[:-1]]
        # the rows of a parcel that fall into each stretch of the line
        parts = F.array(*[F.struct(F.lit(t).alias("to"), _overlap(low[t], upto[t]).alias("m")) for t in range(len(quota)) if upto[t] > low[t]])
        gone = own.select("same", "label", "n", F.explode(parts).alias("p")).filter("p.m > 0")
        stays = own.select("same", "label", (F.col("n") - _overlap(0, upto[-1])).alias("n"))
        out = out.unionByName(stays.select("same", "label", "n")).unionByName(gone.select("same", F.col("p.to").alias("label"), F.col("p.m").alias("n")))
    return checkpoint(out.filter("n > 0").groupBy("same", "label").agg(F.sum("n").alias("n")))


def _overlap(low: int, high: int):
    """How many rows of a parcel that ends at ``upto`` in a line lie behind place ``low``, up to place ``high``."""
    return F.greatest(F.least(F.col("upto"), F.lit(high)) - F.greatest(F.col("upto") - F.col("n"), F.lit(low)), F.lit(0).cast("bigint"))


def _to_most(parcels: DataFrame, room: list[int], turn: int) -> DataFrame:
    """Everyone wishes to go where most copies of the text are; among equals a hash decides, another one in each turn."""
    # a text has one parcel per shard at most
    of_text = Window.partitionBy("same")
    best = F.max(F.struct("n", F.xxhash64(F.lit(turn), "same", "label").alias("turn"), "label")).over(of_text)
    return parcels.withColumn("to", best["label"]).filter(F.col("label") != F.col("to")).select("same", "label", "to", "n")


def _to_most_with_room(parcels: DataFrame, room: list[int]) -> DataFrame:
    """Parcels wish to go to the largest one in a shard with room, if that is larger than they are."""
    own = F.struct("n", F.xxhash64("same", "label").alias("turn"))
    is_open = F.col("label").isin([s for s, r in enumerate(room) if r > 0])
    aim = F.max(F.when(is_open, F.struct(own.alias("own"), F.col("label")))).over(Window.partitionBy("same"))
    aimed = parcels.withColumns({"own": own, "aim": aim}).withColumn("to", F.col("aim.label"))
    return aimed.filter((F.col("label") != F.col("to")) & (F.col("own") < F.col("aim.own"))).select("same", "label", "to", "n")


def _to_one(parcels: DataFrame, room: list[int], few: bool = False) -> DataFrame:
    """Texts in several shards wish to go as wholes to one with room for what is elsewhere; as many as fit, the largest first."""
    rooms = F.array(*[F.lit(r).cast("bigint") for r in room])
    texts = parcels.groupBy("same").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("kinds"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("own")).filter("kinds > 1")
    missing = lambda s: F.col("t") - F.coalesce(F.element_at("own", s), F.lit(0).cast("bigint"))
    fits = F.filter(F.transform(F.array(*[F.lit(s) for s in range(len(room))]), lambda s: F.struct(missing(s).alias("m"), F.xxhash64("same", s).alias("turn"), s.alias("to"))), lambda x: x["m"] <= F.element_at(rooms, x["to"] + 1))
    # the fewest rows to move; ties go by the text's own hash, so that not all wish for one shard
    aims = texts.select("same", "t", "own", F.array_min(fits).alias("a")).filter("a IS NOT NULL").select("same", "t", "own", F.col("a.to").alias("to"), F.col("a.m").alias("m"))
    lined = running_totals(aims, [F.col("t").desc(), F.col("same")], {"upto": F.col("m")}, ["to"], settle=True, few=few)
    chosen = lined.filter(F.col("upto") <= F.element_at(rooms, F.col("to") + 1))
    return chosen.select("same", "to", F.explode("own").alias("label", "n")).filter(F.col("label") != F.col("to")).select("same", "label", "to", "n")


def grant(asked: list[list[int]], room: list[int], exchange: bool = True) -> list[list[int]]:
    """How many of the rows asked for may go from each shard to each other one: no shard ends with more than its room.

    What is asked along a ring of shards goes round it, which fills none, rings of two
    first; then the rest goes while there is room, also the room that those who leave make.
    """
    n = len(room)
    out = [[0] * n for _ in range(n)]
    for ring in _rings(asked, out) if exchange else ():
        least = min(asked[s][t] - out[s][t] for s, t in ring)
        for s, t in ring:
            out[s][t] += least
    changed = True
    while changed:
        changed = False
        for t in range(n):
            for s in sorted(range(n), key=lambda s: (out[s][t] - asked[s][t], s)):
                free = room[t] + sum(out[t]) - sum(row[t] for row in out)
                more = min(asked[s][t] - out[s][t], free) if s != t else 0
                if more > 0:
                    out[s][t] += more
                    changed = True
    return out


def _rings(asked: list[list[int]], out: list[list[int]]):
    """Shortest rings of shards along which something is still asked; ``out`` grows between them."""
    n = len(asked)
    for start in range(n):
        while True:
            # breadth first from the start back to it
            before, queue, end = {start: start}, [start], None
            while queue and end is None:
                s = queue.pop(0)
                for t in range(n):
                    if s != t and asked[s][t] > out[s][t]:
                        if t == start:
                            end = s
                            break
                        if t not in before:
                            before[t] = s
                            queue.append(t)
            if end is None:
                break
            ring = [(end, start)]
            while ring[-1][0] != start:
                ring.append((before[ring[-1][0]], ring[-1][0]))
            yield ring


def _moved(parcels: DataFrame, wishes: DataFrame, granted: list[list[int]], few: bool = False) -> DataFrame:
    """The parcels after the granted moves, those of most copies first, the last of a line in part."""
    lined = running_totals(wishes, [F.col("n").desc(), F.col("same")], {"upto": F.col("n")}, ["label", "to"], few=few)
    limit = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(g).cast("bigint") for g in row]) for row in granted]), F.col("label") + 1), F.col("to") + 1)
    went = F.greatest(F.least(F.col("n"), limit - F.col("upto") + F.col("n")), F.lit(0).cast("bigint"))
    moves = lined.select("same", "label", "to", went.alias("m")).filter("m > 0")
    gone = moves.select("same", "label", (-F.col("m")).alias("n"))
    come = moves.select("same", F.col("to").alias("label"), F.col("m").alias("n"))
    changed = parcels.unionByName(gone).unionByName(come)
    return (changed.coalesce(1) if few else changed).groupBy("same", "label").agg(F.sum("n").alias("n")).filter("n > 0")
