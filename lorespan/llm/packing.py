"""Filling containers of several capacities with texts measured in tokens.

Only the histogram of sizes is planned on the driver: it has at most as many
entries as the capacities have tokens, however many documents there are.  The
plan says how many containers of each pattern of sizes to make.  Documents are
numbered within their size by a distributed ranking and look up their container
by that number, so nothing about single documents is gathered anywhere.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.operators.ranking import number_within
from lorespan.session import stash

#: Most capacities, and largest sum of capacities: the bound of the histogram and of the plan.
MAX_KINDS, MAX_CAPACITY_SUM = 64, 1 << 21
#: Containers of one kind in a step group.
STEP_SIZE = 8
#: Most rows of the plan that are broadcast; a larger plan is joined without a hint.
MAX_BROADCAST = 500_000
#: Hash slices in which the documents of one size are numbered.
SLICES = 1024


@dataclass
class Sizes:
    """Remaining pieces by size, with the largest size that fits a room found by bisection."""

    counts: dict[int, int]
    order: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.order = sorted(s for s, n in self.counts.items() if n > 0)

    def largest(self, room: int) -> int:
        k = bisect.bisect_right(self.order, room)
        return self.order[k - 1] if k else 0

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            self.order.pop(bisect.bisect_left(self.order, size))


def _fill(capacity: int, pools: list[Sizes]) -> list[tuple[int, int, int]]:
    """One container: (pool, size, pieces) taken from the first pool, its gap from the next ones, largest that fits first."""
    room, made = capacity, []
    for k, pool in enumerate(pools):
        top = room
        while size := pool.largest(min(room, top)):
            n = min(pool.counts[size], room // size)
            made.append((k, size, n))
            room -= n * size
            top = size - 1
    # One piece more fits exactly if a placed piece and the rest of the room equal a waiting size.
    if room and made:
        for at, (k, size, n) in enumerate(made):
            for j, pool in enumerate(pools):
                better = pool.largest(size + room)
                taken = sum(m for kk, ss, m in made if (kk, ss) == (j, better))
                if better > size and j >= made[0][0] and at and pool.counts[better] > taken:
                    made[at : at + 1] = ([(k, size, n - 1)] if n > 1 else []) + [(j, better, 1)]
                    merged: dict[tuple[int, int], int] = {}
                    for kk, ss, m in made:
                        merged[kk, ss] = merged.get((kk, ss), 0) + m
                    return [(kk, ss, m) for (kk, ss), m in merged.items()]
    return made


def plan(histograms: list[dict[int, int]], capacities: list[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Blocks (tier of container, tier of piece, size, first rank, pieces a container, first container, containers, offset).

    Tiers are given from the largest capacity to the smallest; each is packed in
    turn, largest pieces first, and gaps of longer windows take pieces of the
    shorter tiers.  Every container pattern is repeated as often as all its
    sizes last, so each uses up a size.
    """
    pools = [Sizes(dict(h)) for h in histograms]
    ranks: dict[tuple[int, int], int] = {}
    blocks = []
    for tier, capacity in enumerate(capacities):
        container = 0
        while pools[tier].order:
            made = _fill(capacity, pools[tier:])
            times = min(pools[tier + k].counts[size] // n for k, size, n in made)
            offset = 0
            for k, size, n in made:
                first = ranks.get((tier + k, size), 0)
                blocks.append((tier, tier + k, size, first, n, container, times, offset))
                ranks[tier + k, size] = first + n * times
                pools[tier + k].take(size, n * times)
                offset += n * size
            container += times
    return blocks


def pack(sizes: DataFrame, kinds: list[tuple[str, int]], doc_id: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """(kind, container_no, offset, doc_id, part, start_token, n_tokens, step) of every piece.

    A document goes to the smallest capacity that holds it; one larger than all
    capacities is split into full containers and a rest, no other is split.
    Documents without tokens take no room: one row with a null container.
    Containers are dealt into step groups by the work they make, so each group
    has about the same.  A null size counts as 0; repeated documents are packed each.
    """
    kinds = sorted(kinds, key=lambda k: (-k[1], k[0]))
    if not kinds or len(kinds) > MAX_KINDS or sum(c for _, c in kinds) > MAX_CAPACITY_SUM or min(c for _, c in kinds) < 1:
        raise ValueError("capacities must be positive, and few enough to be planned")
    spark, largest = sizes.sparkSession, kinds[0][1]
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    pieces = sizes.select(F.col(doc_id).alias("doc_id"), n.alias("total"))
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("total") - 1) / largest), F.lit(0)))))
    pieces = pieces.withColumns({"start_token": F.col("part") * largest, "n_tokens": F.least(F.col("total") - F.col("part") * largest, F.lit(largest)).cast("bigint")})
    tier = F.lit(0)
    for k, (_, capacity) in enumerate(kinds):
        tier = F.when(F.col("n_tokens") <= capacity, k).otherwise(tier) if k else F.lit(0)
    pieces = stash(pieces.withColumn("tier", tier.cast("int")).drop("total"), "pieces")

    histograms: list[dict[int, int]] = [{} for _ in kinds]
    for r in pieces.where("n_tokens > 0").groupBy("tier", "n_tokens").count().collect():
        histograms[r.tier][r.n_tokens] = r["count"]
    blocks = plan(histograms, [c for _, c in kinds])
    names = [k for k, _ in kinds]
    width = bucket_widths(blocks)
    places = balanced_places(blocks)
    rows = [(names[t], p, s, bucket, a, a + n * m, n, c, o, places[t, c]) for t, p, s, a, n, c, m, o in blocks for bucket in range(a // width[p, s], (a + n * m - 1) // width[p, s] + 1)]
    schema = "kind string, b_tier int, b_size bigint, b_bucket bigint, b_first bigint, b_end bigint, b_n int, b_container bigint, b_offset bigint, b_place bigint"
    table = sized_broadcast(spark.createDataFrame(rows, schema), len(rows))
    widths = sized_broadcast(spark.createDataFrame([(*k, w) for k, w in width.items()], "w_tier int, w_size bigint, width bigint"), len(width))

    slice_by = F.pmod(F.xxhash64("doc_id", "part"), F.lit(SLICES))
    ranked = number_within(pieces.where("n_tokens > 0"), ["tier", "n_tokens"], slice_by, [F.col("doc_id"), F.col("part")], "rank").withColumn("rank", F.col("rank") - 1)
    ranked = ranked.join(widths, (F.col("tier") == F.col("w_tier")) & (F.col("n_tokens") == F.col("w_size")))
    bucket = F.floor(F.col("rank") / F.col("width"))
    on = (F.col("tier") == F.col("b_tier")) & (F.col("n_tokens") == F.col("b_size")) & (bucket == F.col("b_bucket")) & (F.col("rank") >= F.col("b_first")) & (F.col("rank") < F.col("b_end"))
    placed = ranked.join(table, on)
    within = F.col("rank") - F.col("b_first")
    nth = F.floor(within / F.col("b_n"))
    placed = placed.select("kind", (F.col("b_container") + nth).alias("container_no"), (F.col("b_offset") + within % F.col("b_n") * F.col("n_tokens")).alias("offset"), "doc_id", "part", "start_token", "n_tokens", (F.col("b_place") + nth).alias("place"))
    none = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens = 0").select(F.lit(names[-1]).alias("kind"), none.alias("container_no"), none.alias("offset"), "doc_id", "part", "start_token", "n_tokens", none.alias("place"))
    out = placed.union(empty)
    steps = spark.createDataFrame([(names[t], (max(c + m for tt, *_, c, m, _ in blocks if tt == t) + STEP_SIZE - 1) // STEP_SIZE) for t in {b[0] for b in blocks}], "kind string, steps bigint")
    turn, seat = F.floor(F.col("place") / F.col("steps")), F.col("place") % F.col("steps")
    step = F.when(turn % 2 == 0, seat).otherwise(F.col("steps") - 1 - seat)
    return out.join(F.broadcast(steps), "kind", "left").select(*[c for c in out.columns if c != "place"], step.alias("step"))


def bucket_widths(blocks: list[tuple]) -> dict[tuple[int, int], int]:
    """Width of the rank buckets of each (tier, size), so that a size has about as many buckets as blocks and a rank meets few blocks."""
    last: dict[tuple[int, int], int] = {}
    count: dict[tuple[int, int], int] = {}
    for _, p, s, a, n, _, m, _ in blocks:
        last[p, s] = max(last.get((p, s), 0), a + n * m)
        count[p, s] = count.get((p, s), 0) + 1
    return {k: -(-last[k] // count[k]) for k in last}


def balanced_places(blocks: list[tuple]) -> dict[tuple[int, int], int]:
    """Place of the first container of each pattern when the containers of a kind are sorted by the work they make.

    Attention costs the square of a piece's length, so full containers differ in work.  Sorted by it and dealt to the
    steps to and fro, every step group gets about the same work.
    """
    work: dict[tuple[int, int], int] = {}
    times: dict[tuple[int, int], int] = {}
    for t, _, s, _, n, c, m, _ in blocks:
        work[t, c] = work.get((t, c), 0) + n * s * s
        times[t, c] = m
    at: dict[int, int] = {}
    places: dict[tuple[int, int], int] = {}
    for t, c in sorted(work, key=lambda k: (k[0], -work[k], k[1])):
        places[t, c] = at.get(t, 0)
        at[t] = places[t, c] + times[t, c]
    return places


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most MAX_BROADCAST rows, else as it is."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df
