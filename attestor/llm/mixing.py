"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources that they
belong to.  Tokens flow from patterns to sources; the first pass over a
pattern's tokens is free, each further one costs more than the one before, so
repetition is spread as thin as the quotas let it.  The flow has a node for
each pattern and source, not for documents, and is solved on the driver.  Each
pattern's flow is then made up of whole documents in the order of a seeded
hash: a cut on the hash, found by histograms of two levels, takes the part of a
pass that the flow asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_rows, space_words, stored, table, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most rows of the plan that are broadcast; longer ones are joined as Catalyst sees fit.
BROADCAST_ROWS = 100_000
BITS = 10


def targets(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """Shares of total by weight; what goes over `most` times a source's size is reshared among the others by weight until none is above."""
    capped: dict = {}
    free = dict(sizes)
    while free:
        left, mass = total - sum(capped.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / mass for s in free}
        over = [s for s in free if share[s] > most * free[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * free.pop(s)
    return capped


def route(patterns: list[tuple[tuple, int]], quotas: dict, passes: int = 2) -> list[list[float]]:
    """Minimum-cost flow from patterns (members, tokens) to quotas: for each pattern the tokens taken in each pass.

    Pass number i costs i a token, and all of a pass costs the same, so a cheaper
    pass is filled, with rerouting along residual edges, before a dearer one is
    used.  A pass is a maximum flow on top of the one before: what can go straight
    to a quota does, the rest by blocking flows over the levels of a breadth-first
    search.  Capacities are the tokens of a pattern in a pass and the quotas.
    """
    least = 1e-9
    flow = [dict.fromkeys(members, 0.0) for members, _ in patterns]
    taken = [[0.0] * passes for _ in patterns]
    need = dict(quotas)
    of: dict = {}
    for i, (members, _) in enumerate(patterns):
        for s in members:
            of.setdefault(s, []).append(i)

    def send(i, s, amount: float) -> None:
        flow[i][s] += amount
        room[i] -= amount
        need[s] -= amount

    for p in range(passes):
        room = [float(size) if members else 0.0 for members, size in patterns]
        for i, (members, _) in enumerate(patterns):
            for s in members:
                if room[i] > least and need.get(s, 0) > least:
                    send(i, s, min(room[i], need[s]))
        while True:
            # levels: patterns with room, their sources, patterns that feed these, and so on up to a source in need
            level_p, level_s = {i: 0 for i, r in enumerate(room) if r > least}, {}
            edge, depth, ends = list(level_p), 0, []
            while edge and not ends:
                fresh = []
                for i in edge:
                    for s in patterns[i][0]:
                        if s not in level_s:
                            level_s[s] = depth
                            fresh.append(s)
                ends = [s for s in fresh if need.get(s, 0) > least]
                depth += 1
                edge = []
                for s in fresh:
                    for i in of[s]:
                        if i not in level_p and flow[i][s] > least:
                            level_p[i] = depth
                            edge.append(i)
            if not ends:
                break
            out = {i: iter(patterns[i][0]) for i in level_p}
            back = {s: iter(of[s]) for s in level_s}
            for first in [i for i, d in level_p.items() if d == 0]:
                path = [first]  # pattern, source, pattern, ..., each a level on
                while path and room[first] > least:
                    if len(path) % 2:
                        i = path[-1]
                        s = next((s for s in out[i] if level_s.get(s) == level_p[i]), None)
                    else:
                        s = path[-1]
                        if need.get(s, 0) > least:
                            amount = min([room[first], need[s], *(flow[path[j + 1]][path[j]] for j in range(1, len(path) - 1, 2))])
                            for j in range(0, len(path), 2):
                                flow[path[j]][path[j + 1]] += amount
                                if j:
                                    flow[path[j]][path[j - 1]] -= amount
                            room[first] -= amount
                            need[s] -= amount
                            path, out[first] = [first], iter(patterns[first][0])
                            continue
                        s = next((i for i in back[s] if level_p.get(i) == level_s[s] + 1 and flow[i][s] > least), None)
                    if s is None:
                        path.pop()
                    else:
                        path.append(s)
        for i, (members, size) in enumerate(patterns):
            if members:
                taken[i][p] = size - room[i]
    return taken


#: Prefixes of members' keys: a source, and the null one, which so is unlike any string and comes last.
NAMED, NULL = "s", "t"


def added(docs: DataFrame) -> list[str]:
    """Names of the columns that mix() adds: _size, _copies, _target and _source_size, with underscores after them where docs has such a column."""
    return unused(docs, "_size", "_copies", "_target", "_source_size")


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights: tuple = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = 42) -> DataFrame:
    """All columns of docs and those named by added(): its size, how often the mix takes the row, and the target and size of its source (null for a row of several sources).

    sources is an array of strings, the sources that a row belongs to (null
    stands for a source of its own, last in order); a row without any is not
    taken.  Sources by code point weigh `weights`, repeating, and share `share`
    times all sizes.  Rows of size 0 go with the documents around them in hash
    order.  Rows with the same id and size stand and fall together.  The driver
    holds a row for each distinct set of sources and for each source.
    """
    keys = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.when(s.isNull(), NULL).otherwise(F.concat(F.lit(NAMED), s)))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.array_sort(F.array_distinct(keys)).alias("_sources"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size")), F.lit(1 << 2 * BITS))).drop("_id")
    small = stored(rows.select("_sources", "_size", "_u"), "mix")
    level1 = small.groupBy("_sources", F.shiftright("_u", BITS).alias("_b")).agg(F.sum("_size").alias("_t"))
    totals = sorted(level1.groupBy("_sources").agg(F.sum("_t").alias("_t")).collect(), key=lambda r: r["_sources"])
    sizes: dict = {}
    for r in totals:
        for s in r["_sources"]:
            sizes[s] = sizes.get(s, 0) + r["_t"]
    order = sorted(sizes)
    goals = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share * sum(r["_t"] for r in totals), passes)
    taken = route([(tuple(r["_sources"]), r["_t"]) for r in totals], goals, passes)
    spark = docs.sparkSession
    few = F.broadcast if len(totals) + len(order) <= BROADCAST_ROWS else (lambda df: df)
    # a part of a pass: a cut on the hash; whole passes count beforehand
    plan = []
    for r, t in zip(totals, taken, strict=True):
        whole = sum(1 for x in t if r["_t"] and x >= r["_t"] - 0.5)
        part = next((x for x in t if 0.5 < x < r["_t"] - 0.5), 0.0)
        own = r["_sources"][0] if len(r["_sources"]) == 1 else None
        plan.append((r["_sources"], whole, float(part), float(goals[own]) if own else None, int(sizes[own]) if own else None))
    plan_df = few(local_rows(spark, plan, "_sources array<string>, _whole int, _part double, _target double, _source_size long"))
    by = Window.partitionBy("_sources").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = level1.join(plan_df, "_sources").withColumn("_before", F.coalesce(F.sum("_t").over(by), F.lit(0)))
    edge = bins.filter((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_t") >= F.col("_part"))).groupBy("_sources").agg(F.min(F.struct("_b", "_before", "_part")).alias("_e"))
    edge = edge.select("_sources", "_e.*")
    fine = small.join(few(edge), "_sources").filter(F.shiftright("_u", BITS) == F.col("_b"))
    fine = fine.groupBy("_sources", "_u", "_before", "_part").agg(F.sum("_size").alias("_t"))
    by2 = Window.partitionBy("_sources").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("_upto", F.col("_before") + F.sum("_t").over(by2))
    # the last hash value whose documents bring the total nearer to the part asked for
    cut = fine.filter(F.col("_upto") - F.col("_t") / 2 <= F.col("_part")).groupBy("_sources").agg(F.max("_u").alias("_cut"))
    cut = edge.join(cut, "_sources", "left").select("_sources", F.coalesce("_cut", (F.col("_b") * (1 << BITS) - 1)).alias("_cut"))
    decided = plan_df.join(cut, "_sources", "left").select("_sources", "_whole", "_cut", "_target", "_source_size")
    out = rows.join(few(decided), "_sources", "left")
    copies = F.coalesce(F.col("_whole") + F.when(F.col("_u") <= F.col("_cut"), 1).otherwise(0), F.lit(0))
    own = dict(zip(("_size", "_copies", "_target", "_source_size"), added(docs), strict=True))
    return out.select("_row.*", F.col("_size").alias(own["_size"]), copies.alias(own["_copies"]), F.col("_target").alias(own["_target"]), F.col("_source_size").alias(own["_source_size"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents, each of one source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", space_words(F.col("text")).alias("size"))
    mixed = mix(docs, F.array("source"), F.col("size"))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))
