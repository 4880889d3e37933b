"""Job graphs: closures, cycles, schedules, role plans and lineage."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators.lineage import TASK_ROWS, cut, dealt

#: Jobs of a group that is a row of a task; a larger one must be one chain.
MOST_JOBS = 200_000


def ready(jobs: DataFrame, edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Jobs that are not closed and all of whose dependencies are."""
    unmet = edges.join(closed.select(F.col("job").alias("needs")), "needs", "left_anti").select("job").distinct()
    return jobs.select("job").join(closed.select("job"), "job", "left_anti").join(unmet, "job", "left_anti")


def closure(edges: DataFrame, start: DataFrame, most: int = 64) -> DataFrame:
    """(job, depth) of all jobs that start jobs depend on, themselves at depth 0, each at its smallest depth.

    A round follows one more edge from what was new in the last one; each round is checkpointed, so that lineage stays short.
    """
    found = start.select("job", F.lit(0).alias("depth")).distinct()
    new, depth = found, 0
    while depth < most:
        depth += 1
        step = new.select(F.col("job").alias("j")).join(edges, F.col("j") == F.col("job")).select(F.col("needs").alias("job")).distinct()
        new = step.join(found, "job", "left_anti").select("job", F.lit(depth).alias("depth"))
        new = cut(new)
        if new.isEmpty():
            return found
        found = cut(found.union(new))
    raise ValueError(f"deeper than {most}")


def cyclic(edges: DataFrame, most: int = 64) -> bool:
    """Whether there is a cycle: jobs without unmet dependencies are taken away until none is left or none can go."""
    left = edges
    for _ in range(most):
        if left.isEmpty():
            return False
        sources = left.select(F.col("needs").alias("job")).join(left.select("job"), "job", "left_anti").distinct()
        if sources.isEmpty():
            return True
        left = cut(left.join(sources.select(F.col("job").alias("needs")), "needs", "left_anti"))
    raise ValueError(f"deeper than {most}")


def cycles(edges: DataFrame) -> DataFrame:
    """(job, cycle): the jobs that need themselves, directly or by others; jobs that need each other have one cycle, named by the smallest.

    Jobs without dependents or dependencies are trimmed, round by round. Of the others each takes the largest job that reaches it as its
    colour, a colour's cycle being what reaches its job within the colour; it is taken out, until no job is left.
    """
    loops = edges.where("job = needs").select("job").distinct()
    left = cut(edges.where("job <> needs").select("job", "needs").distinct())
    found = loops.select("job", F.col("job").alias("cycle"), F.lit(0).alias("rank"))
    while True:
        while True:  # trim
            keep = left.join(left.select(F.col("job").alias("needs")).distinct(), "needs", "left_semi").join(left.select(F.col("needs").alias("job")).distinct(), "job", "left_semi")
            keep = cut(keep.select("job", "needs"))
            if keep.count() == left.count():
                break
            left = keep
        if left.isEmpty():
            break
        colour = cut(left.select("job").union(left.select("needs")).distinct().select("job", F.col("job").alias("colour")))
        while True:  # the largest job that a job's chain of dependents comes from
            came = left.join(colour, "job").groupBy(F.col("needs").alias("n")).agg(F.max("colour").alias("c"))
            step = cut(colour.join(came, F.col("job") == F.col("n"), "left").select("job", F.greatest("colour", F.coalesce("c", "colour")).alias("new"), "colour"))
            moved = not step.where("new <> colour").isEmpty()
            colour = step.select("job", F.col("new").alias("colour"))
            if not moved:
                break
        of = colour.select(F.col("job").alias("j"), F.col("colour").alias("k"))
        own = cut(left.join(of, F.col("job") == F.col("j")).drop("j").join(of.toDF("j", "l"), F.col("needs") == F.col("j")).where("k = l").select("job", "needs", "k"))
        new = members = cut(colour.where("job = colour").select("job", "colour"))
        while True:  # backwards from the colour's job
            step = own.join(new.select(F.col("job").alias("needs"), F.col("colour").alias("k")), ["needs", "k"]).select("job", F.col("k").alias("colour")).distinct()
            new = cut(step.join(members, "job", "left_anti"))
            if new.isEmpty():
                break
            members = cut(members.union(new))
        sizes = members.groupBy("colour").agg(F.count("*").alias("n"), F.min("job").alias("cycle")).where("n > 1")
        found = found.union(members.join(sizes, "colour").select("job", "cycle", F.lit(1).alias("rank")))
        left = cut(left.join(members.select("job"), "job", "left_anti").join(members.select(F.col("job").alias("needs")), "needs", "left_anti").select("job", "needs"))
    return found.groupBy("job").agg(F.max_by("cycle", "rank").alias("cycle"))


def fair_schedule(nodes: Sequence[tuple[str, str]], edges: Sequence[tuple[str, str]]) -> list[str]:
    """A topological order for the driver, of up to some ten thousand nodes (job, group) and edges (job, needs).

    Groups take turns in the order of their SHA-256; a group's turn goes to its ready job with the smallest SHA-256.
    """
    digest = lambda x: sha256(x.encode()).hexdigest()
    group = dict(nodes)
    waits = dict.fromkeys(group, 0)
    after = defaultdict(list)
    for job, needs in edges:
        waits[job] += 1
        after[needs].append(job)
    heaps = defaultdict(list)
    for job, n in waits.items():
        if not n:
            heapq.heappush(heaps[group[job]], (digest(job), job))
    order, out = sorted(set(group.values()), key=digest), []
    while len(out) < len(group):
        turn = [g for g in order if heaps[g]]
        if not turn:
            raise ValueError("a cycle")
        for g in turn:
            _, job = heapq.heappop(heaps[g])
            out.append(job)
            for x in after[job]:
                waits[x] -= 1
                if not waits[x]:
                    heapq.heappush(heaps[group[x]], (digest(x), x))
    return out


def batches(order: Sequence[str], edges: Sequence[tuple[str, str]], most: int) -> dict[str, int]:
    """A batch number per job: batches hold at most `most` jobs, in order, and no job with a dependency in its own batch."""
    needs = defaultdict(set)
    for job, x in edges:
        needs[job].add(x)
    out, left, batch = {}, list(order), 0
    while left:
        own = [j for j in left if all(out.get(x, batch) < batch for x in needs[j])][:most]
        if not own:
            raise ValueError("a cycle")
        out |= dict.fromkeys(own, batch)
        left = [j for j in left if j not in out]
        batch += 1
    return out


def depths(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs (job, group) with depth, the number of jobs before a job in its chain.

    Each job may need one other of its group and be needed by one, and a group is one chain; else ValueError. A round
    doubles the steps that each job has looked back, so that a chain takes as many rounds as its length has binary digits.
    """
    e = edges.select(F.col("job").alias("j"), "needs").distinct()
    known = jobs.select(F.col("job").alias("needs"), F.col("group").alias("of"))
    back = cut(jobs.join(e, F.col("job") == F.col("j"), "left").join(known, "needs", "left").select("job", "group", F.col("needs").alias("to"), (F.col("of") == F.col("group")).alias("own")))
    several = [back.groupBy("job"), back.where("to is not null").groupBy("to"), back.where("to is null").groupBy("group")]
    if not back.where("to is not null and not coalesce(own, false)").isEmpty() or any(not x.count().where("count > 1").isEmpty() for x in several):
        raise ValueError("not one chain a group")
    back = back.select("job", "group", "to", F.when(F.col("to").isNull(), 0).otherwise(1).alias("depth"))
    done, left = back.where("to is null"), back.where("to is not null")
    for _ in range(back.count().bit_length() + 1):
        if left.isEmpty():
            return done.select("job", "group", "depth")
        far = done.union(left).select(F.col("job").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        step = cut(left.join(far, "to").select("job", "group", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth")))
        done, left = done.union(step.where("to is null")), step.where("to is not null")  # who has reached its chain's start is not joined again
    raise ValueError("a cycle")


def _hashed(kind: str, of: Column, seed: str | None) -> Column:
    """SHA-256 of a job or group; with a seed, of seed, kind and name between zero characters."""
    text = of if seed is None else F.concat(F.lit(f"{seed}\0{kind}\0"), of)
    return F.sha2(text.cast("binary"), 256)


def _in_turn(jobs: pa.Array, needs: pa.Array) -> pa.Array:
    """Of each group's jobs by digest, and what each needs, the jobs in the order in which a heap of ready ones gives them; null where a cycle or another group's job leaves some or one is repeated.

    A group whose jobs all come after what they need has this order already, so that only the others need the heap. Jobs are told apart by number.
    """
    sizes, names, lists = pc.list_value_length(jobs).to_numpy(), jobs.flatten(), needs.flatten()
    counts = pc.list_value_length(lists).to_numpy()
    first, edge = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)])
    group, job = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(names)), counts)
    at = pc.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy()
    own = (at >= 0) & (group[at] == group[job]) if len(names) else at >= 0
    order, bad = np.arange(len(names)), np.zeros(len(sizes), bool)
    bad[group[job[~own]]] = True
    bad[group[pc.index_in(names, value_set=names).to_numpy() != order]] = True
    later = np.zeros(len(sizes), bool)
    later[group[job[own & (at >= job)]]] = True
    lows, edges, waiting = first.tolist(), edge.tolist(), counts.tolist()
    for g in np.flatnonzero(later & ~bad).tolist():
        low, high = lows[g], lows[g + 1]
        begin, end = edges[low], edges[high]
        after, out = defaultdict(list), []
        for j, x in zip(job[begin:end].tolist(), at[begin:end].tolist(), strict=True):
            after[x].append(j)
        heap = [j for j in range(low, high) if not waiting[j]]  # in order, so a heap
        while heap:
            j = heapq.heappop(heap)
            out.append(j)
            for x in after.get(j, ()):
                waiting[x] -= 1
                if not waiting[x]:
                    heapq.heappush(heap, x)
        if len(out) == high - low:
            order[low:high] = out
        else:
            bad[g] = True
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), names.take(pa.array(order)), mask=pa.array(bad))


def _long_chains(known: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, group, turn) of known (job, group, needs), groups of more than MOST_JOBS of all jobs, which must be chains."""
    of = jobs.select(F.col("job").alias("x"), F.col("group").alias("of"))
    links = cut(known.select("job", "group", F.explode_outer("needs").alias("x")).join(of, "x", "left").withColumnRenamed("x", "needs"))
    if not links.where("needs is not null and of is null").isEmpty():
        raise ValueError("an unknown dependency")
    if not links.where("of <> group").isEmpty():
        raise ValueError("a dependency of another group")
    used = links.where("needs is not null").groupBy("group", "needs").count().where("count > 1")
    starts = links.groupBy("group").agg(F.count_if(F.col("needs").isNull()).alias("n")).where("n <> 1")
    if not known.where(F.size("needs") > 1).isEmpty() or not used.isEmpty() or not starts.isEmpty():
        raise ValueError(f"a group of more than {MOST_JOBS} jobs that is no chain")
    return depths(links.where("needs is not null").select("job", "needs"), known.select("job", "group")).withColumnRenamed("depth", "turn")


def _ordered(groups: DataFrame, seed: str | None) -> DataFrame:
    """groups with the order of their rows' jobs in place of the rows; null where there is none."""
    by_digest = F.sort_array(F.transform("rows", lambda r: F.struct(_hashed("call", r.job, seed).alias("digest"), r.job.alias("job"), r.needs.alias("needs"))))
    groups = groups.withColumn("rows", by_digest)
    return cut(groups.withColumn("order", F.arrow_udf(_in_turn, "array<string>")("rows.job", "rows.needs")).drop("rows"))


def _flat(ordered: DataFrame) -> DataFrame:
    return ordered.select("group", F.posexplode("order").alias("turn", "job")).select("job", "group", "turn")


def turns_of(groups: DataFrame, seed: str | None = None) -> DataFrame:
    """turns() of groups that lie together already, (group, rows), its rows being an array of (job, needs), needs an array of jobs of the group, each once.

    No row is shuffled. Groups are to be named once, and their jobs too; within a group a repeated job is an error, as is a cycle or a dependency that isn't the group's.
    """
    ordered = _ordered(groups.select("group", "rows"), seed)
    if not ordered.where("order is null").isEmpty():
        raise ValueError("a cycle, a repeated job or a dependency that is not of the group")
    return _flat(ordered)


def turns(jobs: DataFrame, edges: DataFrame, seed: str | None = None) -> DataFrame:
    """(job, group, turn): the order, from 0, in which a group's jobs come up if its turn always goes to the ready job of smallest SHA-256.

    Jobs are (job, group), edges (job, needs); repeated edges count once. A group is one row of a task if it has MOST_JOBS jobs at
    most; larger ones must be one chain and may be of any length: their order is found by rounds of doubling. A repeated
    job, a dependency that isn't a job or is of another group, a cycle and a larger group that is no chain raise ValueError.

    Jobs meet their edges in parts by job, and then their group in parts by group, that don't grow with the tables.
    """
    sizes = jobs.groupBy("group").agg(F.count("*").alias("n"))
    n, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    none = F.lit(None).cast("string")
    flat = jobs.select("job", "group", none.alias("needs"), F.lit(1).alias("n")).unionByName(edges.select("job", none.alias("group"), "needs", F.lit(0).alias("n")))
    known = dealt(flat, n, "job").groupBy("job").agg(F.max("group").alias("group"), F.collect_set("needs").alias("needs"), F.sum("n").alias("n"))
    chains = None
    if most > MOST_JOBS:
        large = cut(sizes.where(F.col("n") > MOST_JOBS).select(F.col("group").alias("g")))  # a row per MOST_JOBS jobs at most
        known = cut(known)
        if not known.where("n > 1").isEmpty():
            raise ValueError("a repeated job")
        if not known.where("n < 1").isEmpty():
            raise ValueError("an unknown dependency")
        is_large = F.col("group").eqNullSafe(F.col("g"))
        chains, known = known.join(F.broadcast(large), is_large, "left_semi"), known.join(F.broadcast(large), is_large, "left_anti")
    rows = dealt(known, n, "group").groupBy("group").agg(F.collect_list(F.struct("job", "needs")).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"))
    fault = F.when(F.col("most") > 1, "a repeated job").when(F.col("least") < 1, "an unknown dependency")
    ordered = _ordered(rows.select("group", "rows", fault.alias("fault")), seed)
    wrong = ordered.where("order is null or fault is not null")
    if not wrong.isEmpty():
        fault = wrong.agg(F.min("fault")).first()[0]  # a repeated job comes first
        raise ValueError(fault or _fault(jobs, edges))
    small = _flat(ordered)
    return small if chains is None else small.union(_long_chains(chains, jobs))


def _fault(jobs: DataFrame, edges: DataFrame) -> str:
    """What is wrong with graphs of which some group has no order."""
    of = jobs.select(F.col("job").alias("x"), F.col("group").alias("of"))
    links = edges.where("needs is not null").join(jobs, "job").join(of, F.col("needs") == F.col("x"), "left")
    if not links.where("x is null").isEmpty():
        return "an unknown dependency"
    return "a cycle" if links.where(~F.col("of").eqNullSafe(F.col("group"))).isEmpty() else "a dependency of another group"


def places(turned: DataFrame, seed: str | None = None) -> DataFrame:
    """turned (job, group, turn) with place, from 0: all groups' first turns by the groups' SHA-256, then their second ones, and so on.

    As a group has a ready job until it ends, this is the order that taking turns gives. Places are counted by partition of
    the sorted jobs, so that no task sees them all. Jobs are sorted by a number, of turn and first digits; only where that is equal is a digest made and compared.
    """
    digest = _hashed("group", F.col("group"), seed)
    key = F.shiftleft(F.col("turn").cast("long"), 32).bitwiseOR(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    parts = max(1, -(-turned.count() // TASK_ROWS))
    keyed = turned.withColumn("key", F.coalesce(key, F.shiftleft(F.col("turn").cast("long"), 32)))
    ordered = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key", digest).select(*turned.columns, F.monotonically_increasing_id().alias("id"))
    ordered = cut(ordered).withColumn("part", F.shiftright("id", 33).cast("int"))
    starts, n = [], 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        starts.append((r.part, n))
        n += r.n
    start = ordered.sparkSession.createDataFrame(starts, "part int, start long")
    return ordered.join(F.broadcast(start), "part").select(*turned.columns, (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("place"))


def _tail(most: int, first: int, room: int):
    """Batches of what fewer than `most` groups have left, `room` of them in batch `first`: the ready ones first by place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        waits, after, soonest = {}, defaultdict(list), {}
        jobs = set(pdf.job)
        for r in pdf.itertuples(index=False):
            inner = [x for x in r.needs if x in jobs]
            waits[r.job], soonest[r.job] = len(inner), first if r.needed < first else first + 1
            for x in inner:
                after[x].append(r.job)
        place, out = dict(zip(pdf.job, pdf.place, strict=True)), {}
        coming = defaultdict(list)
        for j, n in waits.items():
            if not n:
                coming[soonest[j]].append(j)
        heap, batch = [], first
        while len(out) < len(jobs):
            for j in coming.pop(batch, []):
                heapq.heappush(heap, (place[j], j))
            for _ in range(min(len(heap), room if batch == first else most)):
                _, j = heapq.heappop(heap)
                out[j] = batch
                for x in after[j]:
                    waits[x] -= 1
                    soonest[x] = max(soonest[x], batch + 1)
                    if not waits[x]:
                        coming[soonest[x]].append(x)
            batch += 1
        return pd.DataFrame({"job": list(out), "batch": list(out.values())})

    return run


def schedule(jobs: DataFrame, edges: DataFrame, most: int, seed: str | None = None) -> DataFrame:
    """(job, group, turn, place, batch): turns(), places() and batches of at most `most` jobs, none with a dependency in its own batch.

    A batch holds the first ready jobs by place. While a turn has `most` groups or more, what a job needs lies `most` places or more before
    it, so that batches are full and a job's is its place divided by `most`. What the fewer groups that last longer have
    left is dealt out by one task; it is less than `most` groups' jobs, and chains among them may be long.
    """
    placed = cut(places(turns(jobs, edges, seed), seed))
    few = placed.groupBy("turn").agg(F.count("*").alias("n")).where(F.col("n") < most).agg(F.min("turn")).first()[0]
    full = F.floor(F.col("place") / most).cast("int")
    early = placed.withColumn("batch", full)
    if few is None:
        return early
    early, late = early.where(F.col("turn") < few), placed.where(F.col("turn") >= few)
    before = early.count()
    first = max(0, (before - 1) // most)
    room = (first + 1) * most - before
    e = edges.select(F.col("job").alias("j"), F.col("needs").alias("x")).distinct()
    done = early.select(F.col("job").alias("d"), F.col("batch").alias("needed"))
    left = late.select("job", "place").join(e, F.col("job") == F.col("j"), "left").join(done, F.col("x") == F.col("d"), "left")
    left = left.groupBy("job", "place").agg(F.collect_list("x").alias("needs"), F.coalesce(F.max("needed"), F.lit(-1)).alias("needed"))
    dealt = left.groupBy().applyInPandas(_tail(most, first, room), "job string, batch int").withColumnRenamed("job", "j")
    return early.union(late.join(dealt, F.col("job") == F.col("j")).drop("j"))


def chain_schedule(jobs: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(job, place, batch) of schedule(), for groups that are one chain each; else ValueError."""
    depths(edges, jobs)
    return schedule(jobs, edges, most).select("job", F.col("place").cast("int"), "batch")


def role_plan(blocks: DataFrame, roles: Sequence[tuple[str, int]]) -> DataFrame:
    """One row per block, role and index, with the stage and the ids of all jobs of earlier roles as dependencies."""
    plan = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(r).alias("role"), F.lit(n).alias("n")) for s, (r, n) in enumerate(roles)])
    jobs = blocks.select("block", F.explode(plan).alias("p")).select("block", "p.*").select("block", "stage", "role", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("role_index"))
    jobs = jobs.withColumn("job", F.concat_ws("-", "block", "role", F.lpad(F.col("role_index").cast("string"), 2, "0")))
    earlier = jobs.select(F.col("block").alias("b"), F.col("stage").alias("s"), F.col("job").alias("needs"))
    both = jobs.join(earlier, (F.col("block") == F.col("b")) & (F.col("s") < F.col("stage")), "left")
    return both.groupBy("block", "stage", "role", "role_index", "job").agg(F.array_sort(F.collect_list("needs")).alias("dependencies"))


def locus_changes(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, changed): in how many loci a child's genes differ from its parent's; both are (id, genes), the child with parent."""
    own = children.select(F.col("id").alias("child"), "parent", F.posexplode("genes").alias("locus", "gene"))
    of = parents.select(F.col("id").alias("parent"), F.posexplode("genes").alias("locus", "parent_gene"))
    return own.join(of, ["parent", "locus"]).groupBy("child", "parent").agg(F.count_if(F.col("gene") != F.col("parent_gene")).alias("changed"))
