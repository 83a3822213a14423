"""Ordered funnels over events: how far each attempt comes, and how long its steps take.

An attempt starts at each row of the first step's kind. Its next step is the client's earliest row of the next kind that is
later (strictly), reached unless it is more than ``within`` later, or an excluded row lies after the step before and not after it.

Rows are dealt into ranges of (client, time) of about ``ROWS`` rows, so a client with a third of all rows has many ranges. A
range gets a halo: the later rows that a chain of steps from inside it can touch. As every step takes the *first* row of a
kind after another, these are few however dense the client is: the first row of each kind after the range's end, the
first of each kind after those, and so on for each step (at most k + k^2 + k^3 rows for k kinds and four steps). Each
range finds the first rows after its own start; ranges whose end lies less than all steps' time before take them over by
a join. Within a range, one ASOF join of DuckDB for each step and one for each exclusion finds the rows; Spark sums
attempts and their times, and ranks times by counts in two levels, each of a bounded number of rows.

Rows with a null client, kind or time are left out, as repeated ones are; so are kinds that no funnel names. Ties in time
aren't later than each other. No rows, or no first steps, give no result. Columns besides ``client_id``, ``kind`` and ``ts``
are ignored, whatever their names. ``ts`` may have a zone or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm import grouped, work

#: Rows of a range, some 24 bytes each in a task.
ROWS = 500_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...]
    within: int = 15 * 60 * 1_000_000  # microseconds


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)

_EVENTS = "part int, client long, ts long, kind int, first boolean"


def events(clicks: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct (client, ts, kind): ts in microseconds of the written time, kind as its place in ``kinds``."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    rows = clicks.filter(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(kinds))
    return rows.select(F.col("client_id").cast("long").alias("client"), at.alias("ts"), kind.alias("kind")).distinct()


def first_rows(ts: np.ndarray, kind: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Indexes of the rows, sorted by ts, that ``depth`` steps from before them can touch: the first of each kind, then the first of each kind strictly later than those, and so on."""
    places = [np.flatnonzero(kind == j) for j in range(k)]
    times = [ts[p] for p in places]
    seen, now = set(), {int(p[0]) for p in places if len(p)}
    for _ in range(depth):
        seen |= now
        now = {int(p[n]) for i in now for p, t in zip(places, times) if (n := int(np.searchsorted(t, ts[i], "right"))) < len(p)} - seen
    return np.array(sorted(seen), np.int64)


def _ranged(rows: DataFrame, parts: int, k: int, depth: int, reach: int) -> DataFrame:
    """Rows with their range ``part``, in order of client and time; ``first`` marks those of the range's first client that earlier ranges need."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, done = TaskContext.get().partitionId(), [], False

        def out(batch: pa.Table | pa.RecordBatch, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = batch.num_rows
            own = pa.table({"part": np.full(n, part, np.int32), "client": batch.column("client"), "ts": batch.column("ts"), "kind": batch.column("kind"), "first": marks})
            yield from own.to_batches()

        def headed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(head)
            marks = np.zeros(table.num_rows, bool)
            marks[first_rows(table.column("ts").to_numpy(), table.column("kind").to_numpy(), k, depth)] = True
            yield from out(table, marks)

        for batch in batches:
            if not done and batch.num_rows:
                client, ts = batch.column("client").to_numpy(), batch.column("ts").to_numpy()
                start = head[0] if head else batch
                late = np.flatnonzero((client != start.column("client")[0].as_py()) | (ts > start.column("ts")[0].as_py() + reach))
                cut = int(late[0]) if len(late) else batch.num_rows
                if cut:
                    head.append(batch.slice(0, cut))
                if not len(late):
                    continue
                done = True
                yield from headed()
                batch = batch.slice(cut)
            if batch.num_rows:
                yield from out(batch, np.zeros(batch.num_rows, bool))
        if head and not done:
            yield from headed()

    return rows.repartitionByRange(parts, "client", "ts").sortWithinPartitions("client", "ts").mapInArrow(mark, _EVENTS)


def _halos(ranged: DataFrame, reach: int) -> DataFrame:
    """Rows of later ranges that a range needs, with that range's ``part``.

    Ranges' ends and first rows meet by client and cell of time, so the many ranges of one client don't all meet each other.
    """
    ends = ranged.groupBy("part").agg(F.max(F.struct("client", "ts")).alias("end")).select(F.col("part").alias("to"), F.col("end.client").alias("client"), F.col("end.ts").alias("end"))
    cell = F.floor(F.col("end") / reach).cast("long")
    ends = ends.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    firsts = ranged.filter("first").select("part", "client", "ts", "kind").withColumn("cell", F.floor(F.col("ts") / reach).cast("long"))
    met = firsts.join(ends, ["client", "cell"]).filter((F.col("part") > F.col("to")) & (F.col("ts") <= F.col("end") + reach))
    return met.select(F.col("to").alias("part"), "client", "ts", "kind", F.lit(False).alias("own"))


def _sql(funnel: Funnel, kinds: list[str], n: int) -> str:
    """Attempts of one funnel over table ``r`` (client, ts, kind, own), counted by their step's time: one ASOF join a step and one a step's exclusion."""
    of = lambda names: ", ".join(str(kinds.index(x)) for x in names)
    out = [f"a1 AS (SELECT client, ts AS t FROM r WHERE own AND kind = {of(funnel.steps[:1])})"]
    for s, kind in enumerate(funnel.steps[1:], 2):
        out += [
            f"n{s} AS (SELECT a.client, a.t AS before, k.ts AS t FROM a{s - 1} a ASOF JOIN (SELECT client, ts FROM r WHERE kind = {of([kind])}) k ON a.client = k.client AND a.t < k.ts WHERE k.ts - a.t <= {funnel.within})",
            f"a{s} AS (SELECT n.client, n.before, n.t FROM n{s} n ASOF LEFT JOIN (SELECT client, ts FROM r WHERE kind IN ({of(funnel.excluded) or -1})) x ON n.client = x.client AND n.before < x.ts WHERE x.ts IS NULL OR x.ts > n.t)",
        ]
    counts = ["SELECT client, 1 AS step, 0 AS took, count(*) AS n FROM a1 GROUP BY client"]
    counts += [f"SELECT client, {s} AS step, t - before AS took, count(*) AS n FROM a{s} GROUP BY client, took" for s in range(2, len(funnel.steps) + 1)]
    return f"WITH {', '.join(out)} SELECT CAST({n} AS INTEGER) AS funnel, client, CAST(step AS INTEGER) AS step, CAST(took AS BIGINT) AS took, CAST(n AS BIGINT) AS n FROM ({' UNION ALL '.join(counts)})"


def attempts(clicks: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS) -> DataFrame:
    """(funnel, client_id, step, took, n): how many attempts reached a step with this time since the step before; step 1 has time 0."""
    kinds = sorted({x for f in funnels for x in (*f.steps, *f.excluded)})
    depth = max(len(f.steps) for f in funnels) - 1
    reach = max(f.within for f in funnels) * max(1, depth)
    texts = [_sql(f, kinds, n) for n, f in enumerate(funnels)]
    rows = work.put(events(clicks, kinds), "events")
    parts = max(work.partitions(clicks.sparkSession), -(-rows.count() // ROWS))
    ranged = work.put(_ranged(rows, parts, len(kinds), max(1, depth), reach), "ranges")
    work.drop(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for group in grouped.groups(batches, ["part"], 1):
                db.register("r", group if isinstance(group, pa.Table) else pa.Table.from_batches([group]))
                for text in texts:
                    yield from db.sql(text).to_arrow_table().to_batches()
                db.unregister("r")

    both = ranged.select("part", "client", "ts", "kind", F.lit(True).alias("own")).unionByName(_halos(ranged, reach))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part")
    names = F.array(*[F.lit(f.name) for f in funnels])
    return dealt.mapInArrow(count, "funnel int, client long, step int, took long, n long").select(F.get(names, F.col("funnel")).alias("funnel"), F.col("client").alias("client_id"), "step", "took", "n")


#: Bits of the lower level of a time's rank: a second level of at most 2^20 times, and a first of (time / 2^20).
LOW = 20


def _ranked(counts: DataFrame, key: list[str], at: str, target: Column) -> DataFrame:
    """For each key the value of ``at`` whose running count reaches the target, and the rank left within it."""
    w = Window.partitionBy(*key).orderBy(at)
    over = counts.withColumn("upto", F.sum("n").over(w)).withColumn("rank", target)
    return over.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*key, at, (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))


def medians(times: DataFrame, key: list[str]) -> DataFrame:
    """The ceil(n / 2)-th smallest time of each key, from rows (key, took, n).

    First by ``took`` / 2^20 (some 900 values in 15 minutes), then among the times of the one value that holds it.
    """
    high = times.withColumn("high", F.shiftright("took", LOW))
    coarse = high.groupBy(*key, "high").agg(F.sum("n").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy(*key))
    found = _ranked(coarse, key, "high", F.ceil(all_ / 2))
    inside = high.join(found, [*key, "high"]).groupBy(*key, "took").agg(F.sum("n").alias("n"), F.first("rank").alias("asked"))
    return _ranked(inside, key, "took", F.col("asked")).select(*key, F.col("took").alias("median"))


def report(clicks: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS) -> DataFrame:
    """A row for each funnel and client with attempts: attempts reaching each step, the last step reached, each step's median time, and how many clients of the funnel came as far."""
    steps = max(len(f.steps) for f in funnels)
    key = ["funnel", "client_id"]
    counted = work.put(attempts(clicks, funnels), "attempts")
    reached = [F.coalesce(F.sum(F.when(F.col("step") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in range(1, steps + 1)]
    totals = work.put(counted.groupBy(*key).agg(*reached, F.max("step").alias("deepest")), "totals")
    middle = medians(counted.filter("step > 1"), [*key, "step"]).groupBy(*key).agg(*[F.max(F.when(F.col("step") == s, F.col("median"))).alias(f"t{s}") for s in range(2, steps + 1)])
    same = totals.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # funnels x steps rows at most
    return totals.join(middle, key, "left").join(F.broadcast(same), ["funnel", "deepest"]).select(*key, *[f"n{s}" for s in range(1, steps + 1)], "deepest", *[f"t{s}" for s in range(2, steps + 1)], "same_depth")
