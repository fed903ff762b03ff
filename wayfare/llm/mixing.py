"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only on the rows.

A source of share w gets its i-th block (from 1) released at floor((i - 1) / w) and due at
ceil(i / w). Earliest deadline first among the released blocks fills every slot and meets every
deadline, so after any number of slots a source is less than one block from its share.

Weights are exact: each is a whole multiple of one fraction. A source's ideal share flows evenly; when
it has given all its blocks in the ideal flow, a new phase starts with the weights of those that are
left, and windows go by the time at which the flow reaches a block. Nothing is dropped or repeated.
The driver goes over blocks once, never over rows, and writes the plan in slices as a table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import free_prefix, ranked, read_slices, written

#: Blocks of the plan that the driver holds at once.
PLAN_SLICE = 200_000
#: Bytes of text to a range of places.
RANGE_BYTES = 32 << 20


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers in exactly the same proportion."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def edf(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """By slot from 0: (source, block from 0, phase, release, deadline). Equal deadlines: first source.

    In the ideal flow source s has given i blocks at virtual time i / weights[s]; the slot reached at virtual time v
    is the blocks of all sources that ended before v, and v times the weights of the others.
    """
    ends = [Fraction(n, w) for n, w in zip(blocks, weights, strict=True)]
    order = sorted(range(len(blocks)), key=ends.__getitem__)
    # by phase: when it ends, the blocks of sources that ended before it, the weights of the others
    until: list[Fraction] = []
    gone, live = [0], [sum(weights)]
    for s in order:
        if until and until[-1] == ends[s]:
            gone[-1], live[-1] = gone[-1] + blocks[s], live[-1] - weights[s]
        else:
            until.append(ends[s])
            gone.append(gone[-1] + blocks[s])
            live.append(live[-1] - weights[s])
    # a source mostly stays in its phase, so the phase is searched from where it was
    phase_of = [0] * len(blocks)

    def window(s: int, i: int) -> tuple[int, int, int]:
        w, k = weights[s], phase_of[s]
        release = gone[k] + i * live[k] // w
        at = k
        if (i + 1) * until[k].denominator > until[k].numerator * w:
            at = bisect_left(until, Fraction(i + 1, w), k)
        deadline = gone[at] - (-(i + 1) * live[at] // w)
        phase_of[s] = at
        return release, deadline, k

    waiting = [(0, s, 0, *window(s, 0)[1:]) for s in range(len(blocks))]
    ready: list[tuple[int, int, int, int, int]] = []
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            release, s, i, deadline, phase = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, phase, release))
        deadline, s, i, phase, release = heapq.heappop(ready)
        assert deadline > t
        yield s, i, phase, release, deadline
        if i + 1 < blocks[s]:
            release, deadline, phase = window(s, i + 1)
            heapq.heappush(waiting, (release, s, i + 1, deadline, phase))


def plan_blocks(rows: dict[str, int], weights: dict[str, float], block: int) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot, first row's place): sources with a weight, then the others evenly."""
    slot = phase0 = place = 0
    some = sorted(s for s, n in rows.items() if n and weights.get(s, 0) > 0)
    for group in (some, sorted(s for s, n in rows.items() if n and not weights.get(s, 0) > 0)):
        start, phase = slot, phase0
        shares = whole([weights[s] if group is some else 1 for s in group]) if group else []
        for k, i, p, release, deadline in edf([-(-rows[s] // block) for s in group], shares):
            s = group[k]
            phase = max(phase, phase0 + p)
            yield s, i, phase0 + p, start + release, start + deadline, slot, place
            slot += 1
            place += min(block, rows[s] - i * block)
        phase0 = phase + 1 if group else phase0


PLAN = "p_src string, p_block long, phase int, release long, deadline long, slot long, place long"


def written_plan(spark: SparkSession, plan: Iterator[tuple]) -> DataFrame:
    """The plan as a table; the driver holds PLAN_SLICE blocks of it."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PLAN.split(", "))])

    def slices() -> Iterator[DataFrame]:
        part = list(islice(plan, PLAN_SLICE))
        while True:
            cols = list(zip(*part, strict=True)) or [()] * len(schema)
            yield spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema))
            if not (part := list(islice(plan, PLAN_SLICE))):
                return

    return read_slices(spark, slices(), PLAN, "mix-plan")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, block: int = 32, temperature: float = 0.5) -> DataFrame:
    """doc_id, source, block_no, phase, release, deadline, slot, position: the mixed order of all rows.

    Rows of a source keep a fixed pseudo-random order (by a hash of doc_id), `block` rows to a block.
    weights: target weight by source, a null source under the name "" ; sources without one, or with
    0, come after those with one. None: each source's number of rows to the power `temperature`.
    Weights hold exactly, over any number of slots.
    release and deadline are the window of the block in slots; slot is where it went; position is
    the row's place in the mix, gapless from 0. Any number of sources; the driver holds one entry for each.
    Null and repeated doc_ids are kept as rows; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")), "mix-rows")
    counts = rows.groupBy("src").count().collect()
    if weights is None:
        weights = {r["src"]: float(r["count"]) ** temperature for r in counts}
    plan = written_plan(spark, plan_blocks({r["src"]: r["count"] for r in counts}, weights, block))
    at = ranked(rows, "src", [F.xxhash64("doc_id"), F.col("doc_id")], "idx").withColumn("block_no", F.floor(F.col("idx") / block).cast("long"))
    # merged at every size, since the plan grows with the corpus; a key has at most `block` rows
    placed = at.join(plan.hint("merge"), (F.col("src") == F.col("p_src")) & (F.col("block_no") == F.col("p_block")))
    return placed.select("doc_id", "source", "block_no", "phase", "release", "deadline", "slot", (F.col("place") + F.col("idx") % block).cast("long").alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """All rows of docs, all columns as they are, sorted by their place in the mix.

    Rows that share a doc_id and source stand together at the first one's place. Partitions are equal ranges of places, each
    of about RANGE_BYTES of text or less where that gives every core one, so files read in order give the mix; a hot source is spread over all of them.
    """
    key = [F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(""))]
    placed = mix_sources(docs, weights, **options)
    size = F.octet_length(F.col("text").cast("string")) if "text" in docs.columns else F.lit(1 << 10)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(size)).first()
    # a place for each distinct (doc_id, source); rows that repeat it follow one another
    own = free_prefix(docs.columns)
    place = placed.groupBy(F.col("doc_id").alias(f"{own}id"), F.coalesce("source", F.lit("")).alias(f"{own}source")).agg(F.min("position").alias(f"{own}position"))
    place = written(place, "mix-places")
    # places are gapless, so a row's range is known without sampling the joined texts
    n = max(1, rows)
    parts = min(n, max(-(-(size or 0) // RANGE_BYTES), docs.sparkSession.sparkContext.defaultParallelism))
    # merged at every size, since places grow with the corpus
    joined = docs.join(place.hint("merge"), key[0].eqNullSafe(F.col(f"{own}id")) & (key[1] == F.col(f"{own}source")))
    dealt = joined.repartitionById(parts, F.expr(f"cast({own}position * {parts} div {n} as int)"))
    return dealt.sortWithinPartitions(f"{own}position").select(*docs.columns)
