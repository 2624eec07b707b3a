"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree (by default domain, language, source) hold records with
sizes. The target share of a source is spread over its leaves by their sizes;
the weight of an inner node is the sum of its leaves. A leaf can give at most
its size times the repeats its source allows. What a leaf can't give goes to
its siblings first, in proportion to their weights, then to the siblings of its
parent, and so on up to the root; each step is a pass over the leaves, whose
number doesn't grow with the records. As a source's target is spread by the
sizes of its leaves, a source that falls short does so in all of them.

Each leaf is then read in seeded epochs, every epoch in an order of its own:
whole epochs first, then a prefix of the next one up to the budget, the last
record cut to the unit. `at` is a record's place in its epoch: an epoch is read
in the order of `at` (as an unsigned number), then id. The prefix is found without sorting a leaf: records are spread
over hash buckets, bucket sizes are summed up per leaf, the bucket in which the
budget ends is spread again, and only a bucket of that is put in order.

Defined cases: sources are compared after trimming, lower-casing and writing
`-` as `_`; records with a null id, source or size, or a size below one, or of a
source without target are left out; null languages and domains are nodes of
their own (`none`). A target without records gets nothing, and the others share
its part. Targets that sum to nothing give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import cut

BUCKETS = 4096
#: A total of as many tokens as the sources with a target hold.
HELD = "held"


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "-", "_")


def budgets(leaves: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[str, ...], int]:
    """The budget of each leaf; the last name of a leaf's path is its source.

    Without a `total`, it is the largest at which no source that has records
    falls short of its share.
    """
    held: dict[str, int] = defaultdict(int)
    for path, size in leaves.items():
        held[path[-1]] += size
    share = {s: max(0.0, targets[s][0]) for s in held if s in targets and held[s] > 0}
    share = {s: x for s, x in share.items() if x > 0 and targets[s][1] > 0}
    if not share:
        return {path: 0 for path in leaves}
    weight = sum(share.values())
    room = {p: size * targets[p[-1]][1] if p[-1] in share else 0 for p, size in leaves.items()}
    if total is None:
        total = min(int(held[s] * targets[s][1] * weight / x) for s, x in share.items())
    wanted = {p: total * share[p[-1]] / weight * leaves[p] / held[p[-1]] if p[-1] in share else 0.0 for p in leaves}
    given = {p: min(wanted[p], room[p]) for p in leaves}

    # Siblings first, then ever larger subtrees around the leaf.
    depth = max(map(len, leaves))
    for up in range(1, depth + 1):
        nodes = defaultdict(list)
        for p in leaves:
            nodes[p[: len(p) - up]].append(p)
        for inside in nodes.values():
            for _ in range(len(inside)):
                lack = sum(wanted[p] for p in inside) - sum(given[p] for p in inside)
                free = [p for p in inside if given[p] < room[p] - 1e-6 and wanted[p] > 0]
                if lack < 1e-6 or not free:
                    break
                parts = sum(wanted[p] for p in free)
                for p in free:
                    given[p] = min(room[p], given[p] + lack * wanted[p] / parts)
            # Settled here: what the subtree can't give is wanted of the next larger one.
    return _rounded(given, room)


def _rounded(given: dict, room: dict) -> dict:
    """Whole units with the same sum: the largest fractions are rounded up."""
    out = {p: min(math.floor(x + 1e-9), room[p]) for p, x in given.items()}
    spare = round(sum(given.values())) - sum(out.values())
    for p in sorted(given, key=lambda p: (out[p] - given[p], p)):
        if spare <= 0:
            break
        if out[p] < room[p]:
            out[p], spare = out[p] + 1, spare - 1
    return out


def mix(sizes: DataFrame, targets: DataFrame, *, levels: tuple[str, ...] = ("domain", "lang", "source"), total: int | str | None = None, seed: int = 0) -> DataFrame:
    """(id, the levels, epoch from 0, at, tokens, taken): what the mix takes of each record in each epoch.

    `sizes` has id, tokens and the levels, the last being the source; `targets`
    has source, target_share and max_repeats. A `total` of HELD is the tokens
    that the sources with a target hold.
    """
    spark = sizes.sparkSession
    names = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("none")).alias(c) for c in levels[:-1]]
    usable = sizes.select("id", F.col("tokens").cast("long").alias("tokens"), *names, canonical(F.col(levels[-1])).alias(levels[-1]))
    usable = usable.where(f"id is not null and tokens >= 1 and {levels[-1]} is not null")
    # Targets and leaves are names of sources, languages and domains: few, whatever the number of records.
    rows = targets.where("source is not null and target_share > 0").groupBy(canonical(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    wanted = {r.source: (float(r.share), int(r.repeats or 0)) for r in rows.toLocalIterator() if not math.isnan(r.share)}
    usable = usable.where(F.col(levels[-1]).isin(list(wanted)))
    sums = usable.groupBy(*levels).agg(F.sum("tokens").alias("n")).collect()
    held = {tuple(r[c] for c in levels): int(r.n) for r in sums}
    budget = budgets(held, wanted, sum(held.values()) if total == HELD else total) if held else {}
    plan = [(*p, b // held[p], b % held[p]) for p, b in budget.items() if b > 0]
    fields = ", ".join([*(f"{c} string" for c in levels), "whole long", "rest long"])
    placed = usable.join(F.broadcast(spark.createDataFrame(plan, fields)), list(levels))

    order = lambda epoch: F.xxhash64("id", F.lit(seed), epoch)
    kept = ["id", *levels, "epoch", "at", "tokens"]
    whole = placed.where("whole > 0").select("id", *levels, F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch"), "tokens", F.col("tokens").alias("taken"))
    parts = [whole.withColumn("at", order("epoch")).select(*kept, "taken")]
    last = placed.where("rest > 0").select("id", *levels, F.col("whole").alias("epoch"), order("whole").alias("at"), "tokens", "rest")
    for shift in (52, 40):  # of each leaf one bucket is cut, then one of 4,096 in it
        last = last.withColumn("bucket", F.pmod(F.shiftrightunsigned("at", shift), F.lit(BUCKETS)))
        filled = last.groupBy(*levels, "bucket", "rest").agg(F.sum("tokens").alias("n"))
        upto = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = filled.select(*levels, "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), "n", "rest").where("start < rest")
        last = last.join(starts.select(*levels, "bucket", "start", "n"), [*levels, "bucket"])
        parts.append(last.where("start + n <= rest").select(*kept, F.col("tokens").alias("taken")))
        last = last.where("start + n > rest").withColumn("rest", F.col("rest") - F.col("start")).drop("bucket", "start", "n")
    # Unsigned order of `at`, as the buckets are in.
    within = Window.partitionBy(*levels).orderBy(F.shiftrightunsigned("at", 1), "at", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("before < rest")
    parts.append(edge.select(*kept, F.least("tokens", F.col("rest") - F.col("before")).alias("taken")))
    return reduce(DataFrame.unionByName, parts)


def mix_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, source: str = "source", total: int | str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, held, wanted, taken, unused, wanted_share, actual_share, repeats) of every target, absent ones too.

    `wanted` is what the source's share of the total comes to, among the sources
    that can give anything; without a `total`, of what was taken. `unused` are
    the tokens held that no epoch takes.
    """
    held = sizes.where("id is not null and tokens >= 1").groupBy(canonical(F.col(source)).alias("source")).agg(F.sum("tokens").alias("held"))
    first = F.sum(F.when(F.col("epoch") == 0, F.col("taken")))
    taken = mixed.groupBy(F.col(source).alias("source")).agg(F.sum("taken").alias("taken"), first.alias("first"), (F.max("epoch") + 1).alias("repeats"))
    shares = targets.groupBy(canonical(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    none = F.lit(0).cast("long")
    rows = shares.join(held, "source", "left").join(taken, "source", "left")
    # A row for each target, few whatever the number of records.
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("held", "taken", "first", "repeats")})
    targeted = F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share")
    rows = rows.withColumn("part", F.when(targeted & (F.col("held") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0))
    whole = F.sum("taken") if total is None else F.sum(F.when(targeted, F.col("held"))) if total == HELD else F.lit(total)
    sums = rows.agg(whole.alias("total"), F.sum("part").alias("parts"), F.sum("taken").alias("mixed"))
    wanted_share = F.col("part") / F.nullif("parts", F.lit(0.0))
    return (
        rows.crossJoin(F.broadcast(sums))
        .select("source", "target_share", "max_repeats", "held", F.round(wanted_share * F.col("total")).cast("long").alias("wanted"), "taken", (F.col("held") - F.col("first")).alias("unused"),
                wanted_share.alias("wanted_share"), (F.col("taken") / F.nullif("mixed", none)).alias("actual_share"), "repeats")
    )
