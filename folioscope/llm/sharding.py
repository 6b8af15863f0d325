"""Balanced sharding by label propagation (operator 2), with DataFrame functions only.

Documents are linked to those of equal text. Every document starts in the shard of its hashed place. In each round
every group of linked documents wants to be where most of it is; the rows that are elsewhere ask to move there. What
is granted keeps every shard's count as it is: requests that go round in circles between shards (swaps of two shards
first, longer circles then), and requests answered by a swap with documents that are content where they go, single
ones first, then groups that are whole, which move together. Every move joins more links than it parts and none parts
any whole group, so the rounds end, after ``IDLE`` in which nothing moves; ``ROUNDS`` bounds them. Only a group as large as a shard or
larger, which no shard can hold, is dealt out before, into as few shards as there is room for. Counts stay at most
one apart (law ``rows``).

Scale: no window or task holds a whole shard or a large group. Ranks are two-level (``prefix_sums``). Requests and
grants are counted for each pair of shards (at most 1,600 numbers, in the driver and broadcast), as are the groups of a
shard and more (at most one a shard); rows are only joined with their group's wish.

Ties between shards are broken by a hash, anew in each round, so that no shard is everybody's choice.

Cases: a null text has size 16, checksum 0 and no links; an empty text has the same size and checksum,
and is linked with other empty texts. Groups larger than a shard fill one after the other. Fewer
documents than shards leave shards empty. An empty table gives an empty result. Extra columns are
ignored. Null and repeated ids are rows like any other, with a shard and slot each. Texts of any length are read once, for
their size and digests.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prefix_sums

SHARDS = 40
ROUNDS = 30
IDLE = 3  # rounds without a move that end the propagation
ROWS_PER_SUB = 2000
GROUP_SUB = 200  # rows of a group that are ranked together


def _subs(n_rows: int) -> int:
    return max(1024, -(-n_rows // ROWS_PER_SUB))


def _sub(n_rows: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_subs(n_rows))).cast("int")


def deal(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(gid, lo, hi, shard): the ranks of each group that go to a shard, in as few shards as there is room
    for; ``room`` is lowered by them."""
    out = []
    for gid, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        lo = 0
        while lo < n:
            fits = [s for s, r in enumerate(room) if r >= n - lo]
            to = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            hi = min(n, lo + room[to])
            out.append((gid, lo, hi, to))
            room[to] -= hi - lo
            lo = hi
    return out


def circles(requests: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """How much of each request (from, to) can be granted so that as much enters every shard as leaves it. No circle is
    left among the rest."""
    rest = {k: n for k, n in requests.items() if n}
    granted: dict[tuple[int, int], int] = dict.fromkeys(requests, 0)

    def grant(path: list[tuple[int, int]]) -> None:
        n = min(rest[e] for e in path)
        for e in path:
            granted[e] += n
            rest[e] -= n
            if not rest[e]:
                del rest[e]

    for a, b in sorted(rest):
        if a < b and (a, b) in rest and (b, a) in rest:
            grant([(a, b), (b, a)])
    ended: set[int] = set()  # shards from which no circle can be reached any more
    for start in sorted({a for a, _ in rest}):
        path: list[int] = [start]
        while path:
            here = path[-1]
            nxt = next((b for a, b in sorted(rest) if a == here and b not in ended), None)
            if nxt is None:
                ended.add(path.pop())
            elif nxt in path:
                ring = [*path[path.index(nxt) :], nxt]
                grant(list(zip(ring, ring[1:], strict=False)))
                path = path[: path.index(nxt) + 1]
            else:
                path.append(nxt)
    return granted


def _pairs(rows: DataFrame, target: str) -> dict[tuple[int, int], int]:
    """Rows to be moved for each pair of shards."""
    return {(r["shard"], r[target]): r["n"] for r in rows.groupBy("shard", target).agg(F.sum("n").alias("n")).collect()}


def propagate(state: DataFrame, n_rows: int, ws: Workspace, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """``state(row, doc_id, gid, shard)`` with new shards, and the number of rounds in which rows moved; gid is null for
    rows without links. The number of rows of each shard stays the same."""
    spark = ws.spark
    by_gid = F.pmod(F.xxhash64("gid"), F.lit(_subs(n_rows))).cast("long")
    idle, name = 0, "state0"
    for i in range(rounds):
        parts = ws.keep(state.where("gid is not null").groupBy("gid", "shard").agg(F.count("*").alias("n")), f"parts{i}")
        # Ties are drawn anew in each round, so that a pair asks to meet now in one, now in the other shard.
        most = F.max(F.struct("n", F.xxhash64("gid", "shard", F.lit(i)).alias("tie"), "shard"))
        wishes = ws.keep(parts.groupBy("gid").agg(most.alias("most"), F.count("*").alias("places")).select("gid", F.col("most.shard").alias("target"), F.col("most.n").alias("held"), "places"), f"wishes{i}")
        apart = wishes.where((F.col("places") > 1) & (F.col("held") > (1 if idle else 0))).select("gid", "target")
        requests = _pairs(parts.join(apart, "gid").where("shard <> target"), "target")
        if not requests and not idle:
            return state, i
        granted = circles(requests)

        # What is left is offered to the documents that are content where it goes, those of the smallest groups first:
        # [lo, hi) of them for each shard, in multiples of the smallest group's size.
        single = state.where("gid is null").select("row", F.lit(None).cast("binary").alias("gid"), "shard", F.lit(1).cast("long").alias("n"))
        whole = parts.join(wishes.where("places = 1").select("gid"), "gid").select(F.lit(None).cast("long").alias("row"), "gid", "shard", "n")
        content = single.unionByName(whole)
        if idle:  # nothing else goes: a row that joins two and more may part a pair
            pairs = parts.where("n = 2").join(wishes.where("places = 1").select("gid"), "gid").select("gid")
            content = single.unionByName(state.join(pairs, "gid", "left_semi").select("row", F.lit(None).cast("binary").alias("gid"), "shard", F.lit(1).cast("long").alias("n")))
        least = {r["shard"]: r["n"] for r in content.groupBy("shard").agg(F.min("n").alias("n")).collect()}  # a row for each shard
        gaps, at = [], dict.fromkeys(range(shards), 0)
        for (a, b), n in sorted(requests.items(), key=lambda x: (granted[x[0]] - x[1], x[0])):
            n = (n - granted[a, b]) // least.get(b, n + 1) * least.get(b, 0)
            if n:
                gaps.append((b, a, at[b], at[b] + n))
                at[b] += n
        gaps = F.broadcast(spark.createDataFrame(gaps, "shard int, away int, lo long, hi long"))
        key = F.xxhash64("row", "gid", F.lit(i))
        content = content.join(gaps.select("shard").distinct(), "shard", "left_semi").withColumn("sub", F.col("n") * _subs(n_rows) + F.pmod(key, F.lit(_subs(n_rows))))
        ranked = prefix_sums(content, "shard", "sub", [key, F.col("row"), F.col("gid")], F.col("n"))
        swapped = ranked.join(gaps, (F.col("before") >= F.col("lo")) & (F.col("before") + F.col("n") <= F.col("hi")) & (ranked["shard"] == gaps["shard"])).select("row", "gid", ranked["shard"], "away", "n")
        swapped = ws.keep(swapped, f"swapped{i}")
        for (b, a), n in _pairs(swapped, "away").items():
            granted[a, b] += n
        idle = 0 if any(granted.values()) else idle + 1
        if idle == IDLE:
            return state, i
        if idle:
            continue

        limits = F.broadcast(spark.createDataFrame([(a * shards + b, n) for (a, b), n in sorted(granted.items()) if n], "pair int, most long"))
        asking = state.join(apart, "gid").where("shard <> target").withColumn("pair", (F.col("shard") * shards + F.col("target")).cast("int")).withColumn("sub", by_gid)
        movers = prefix_sums(asking, "pair", "sub", [F.col("gid"), F.col("row")]).join(limits, "pair").where("before < most").select("row", F.col("target").alias("to"))
        singly = ws.keep(movers.unionByName(swapped.where("gid is null").select("row", F.col("away").alias("to"))), f"rows{i}")
        together = swapped.where("gid is not null").select("gid", F.col("away").alias("whole_to"))
        moved, old = state.join(singly, "row", "left").join(together, "gid", "left"), name
        name = f"state{i + 1}"
        state = ws.keep(moved.select("row", "doc_id", "gid", F.coalesce("to", "whole_to", "shard").alias("shard")), name)
        for done in (old, f"parts{i}", f"wishes{i}", f"swapped{i}", f"rows{i}"):
            ws.drop(done)
    return state, rounds


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    ws = Workspace(docs.sparkSession, "sharding")
    spark = ws.spark
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("gid"),
    )
    facts = ws.keep(facts, "facts")
    n = facts.count()
    place = [F.col("doc_id"), F.col("row")]
    room = [n // shards + (s < n % shards) for s in range(shards)]

    # Written first: a join of two exchanged tables can be split at a hot group, one above an aggregate cannot.
    groups = ws.keep(facts.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1 and gid is not null"), "groups")
    least = max(2, room[0])
    linked = ws.keep(facts.select("row", "doc_id", "gid").join(groups, "gid"), "linked")
    part = F.pmod(F.xxhash64("doc_id", "row"), F.ceil(F.col("n") / GROUP_SUB))
    members = prefix_sums(linked.where(F.col("n") >= least).withColumn("sub", part), "gid", "sub", place)
    large = [(bytes(r["gid"]), r["n"]) for r in groups.where(F.col("n") >= least).collect()]  # at most one a shard
    ranges = F.broadcast(spark.createDataFrame(deal(large, room), "gid binary, lo long, hi long, shard int"))
    dealt = ws.keep(members.join(ranges, "gid").where("before >= lo and before < hi").select("row", "doc_id", "shard"), "dealt")

    # The others start in hashed places, as many in a shard as there is room for.
    own = facts.select("row", "doc_id").join(dealt.select("row"), "row", "left_anti").join(linked.where(F.col("n") < least).select("row", "gid"), "row", "left")
    key = F.xxhash64("row", "doc_id", F.lit(23))
    hashed = prefix_sums(own.withColumn("all", F.lit(0)).withColumn("sub", F.pmod(key, F.lit(_subs(n)))), "all", "sub", [key, F.col("row")])
    first = sum(((F.col("before") >= end).cast("int") for end in accumulate(room[:-1])), F.lit(0))
    state = ws.keep(hashed.select("row", "doc_id", "gid", first.cast("int").alias("shard")), "state0")
    state, _ = propagate(state, n, ws, shards)

    both = state.select("row", "doc_id", "shard").unionByName(dealt)
    slots = prefix_sums(both.withColumn("sub", _sub(n)), "shard", "sub", place)
    slots = slots.select("row", "shard", F.col("before").alias("slot"))
    return facts.join(slots, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
