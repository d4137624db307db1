"""Mixing of sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates from 0 to MOST that give every source
its target of words, entropy balancing takes those closest to "one copy each": the rate is an exponential tilt of
the document's size class; in its bounded form

    rate = MOST / (1 + (MOST - 1) * exp(-lambda[source] * x)),   x = size class / mean size class of the source

and the dual in lambda is convex. Newton's method solves it for all sources at once, each step one Spark
aggregation over counts by source and size class; a bracket guards the steps. Rates become copies by systematic
rounding: within a source, in order of size, running sums of the fractional parts decide who gets one copy more. What
a source then lacks or has too much is at most about its largest document; some copies of single documents settle it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedprofile.llm.storage import fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more than MOST times, so no source exceeds MOST times its size.
MOST = 3
#: Size classes of an octave; a class is what a document's rate depends on, so a source has some 64 * 40 at most.
CLASSES_PER_OCTAVE = 64
#: Ranks within a size class are taken in so many parts, or one for each PART_ROWS rows of the table if these are more.
PARTS, PART_ROWS = 64, 1 << 18
#: Fractional parts of rates are counted in units of 1 / UNIT copies.
UNIT_BITS = 26
UNIT = 1 << UNIT_BITS
#: How often two documents' copies are changed at once to bring a source nearer its target.
EXCHANGES = 32
#: Where two do not help, a third is tried, one of so many along the sizes.
THIRDS = 64
NEWTON_STEPS, STEPS_A_JOB, TOLERANCE = 48, 6, 1e-10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without one sort in one task."""
    spread = materialize(sources.repartitionByRange("s").withColumn("p", F.spark_partition_id()))
    sizes = spread.groupBy("p").count()
    before = sizes.join(sizes.select(F.col("p").alias("q"), F.col("count").alias("m")), F.col("q") < F.col("p"), "left").groupBy("p").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    within = Window.partitionBy("p").orderBy("s")
    return spread.join(before, "p").select("s", "source_size", (F.col("before") + F.row_number().over(within) - 1).alias("k"))


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: by code point, the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Share the sum of ``source_size`` by weight; what exceeds ``most`` times a source's size is shared anew."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    rows = materialize(
        _ranked(sources)
        .withColumn("w", F.element_at(ws, (F.col("k") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .drop("k")
    )
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # sources that stay under their caps at this level share what the others leave
        free = F.col("w") * F.lit(level) < F.col("cap")
        weight, capped = rows.agg(F.sum(F.when(free, F.col("w"))), F.sum(F.when(~free, F.col("cap")))).first()
        now = (total - (capped or 0.0)) / weight if weight else level
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(F.col("w") * F.lit(level), F.col("cap"))).drop("w", "cap")


def _rate(lam: Column, x: Column) -> Column:
    return F.lit(float(MOST)) / (F.lit(1.0) + F.lit(MOST - 1.0) * F.exp(-lam * x))


def _solve(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Lambda and mean class of each source, from its size classes ``(s, c, words)`` and its target."""
    # sums of counts and decimals do not depend on their order, so that reruns agree
    exact = lambda x: F.sum(x.cast("decimal(38,10)")).cast("double")
    mean = classes.groupBy("s").agg((F.sum((F.col("c") * F.col("words")).cast("decimal(38,0)")) / F.sum("words")).cast("double").alias("mean"))
    points = materialize(classes.join(mean, "s").select("s", (F.col("c") / F.col("mean")).alias("x"), "words"))
    state = materialize(targets.join(mean, "s").select("s", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-40.0).alias("lo"), F.lit(40.0).alias("hi"), F.lit(1.0).alias("off")))
    for step in range(1, NEWTON_STEPS + 1):
        rate = _rate(F.col("lam"), F.col("x"))
        low = F.col("got") < F.col("target")
        moved = (
            points.join(state, "s")
            .groupBy("s", "target", "mean", "lam", "lo", "hi")
            .agg(exact(rate * F.col("words")).alias("got"), exact(rate * (F.lit(1.0) - rate / MOST) * F.col("x") * F.col("words")).alias("slope"))
            .select("s", "target", "mean", "lam", "got", F.when(low, F.col("lam")).otherwise(F.col("lo")).alias("lo"), F.when(low, F.col("hi")).otherwise(F.col("lam")).alias("hi"), (F.col("lam") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))).alias("to"))
        )
        inside = F.col("to").between(F.col("lo"), F.col("hi"))
        state = moved.select(
            "s", "target", "mean", F.when(inside, F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi",
            F.abs(F.try_divide(F.col("got"), F.col("target")) - 1).alias("off"),
        )
        if step % STEPS_A_JOB == 0:
            state = materialize(state)
            worst = state.where(F.col("hi") - F.col("lo") > 1e-9).agg(F.max("off")).first()[0]
            if worst is None or worst < TOLERANCE:
                break
    return state.select("s", "mean", "lam")


def _two_steps(doc: np.ndarray, words: np.ndarray, gap: float, but: int) -> tuple[float, int, int]:
    """What is left of ``gap`` after the best two steps of different documents, neither that of ``but``, and these steps."""
    at = np.searchsorted(words, gap - words)
    near = np.clip(np.stack([at - 2, at - 1, at, at + 1]), 0, len(words) - 1)
    # -1 stands for no step and may come twice
    taken = ((doc[near] == doc) | (doc == but)) & (doc >= 0) | (doc[near] == but) & (but >= 0)
    left = np.where(taken, np.inf, np.abs(gap - words - words[near]))
    k, one = np.unravel_index(left.argmin(), left.shape)
    return float(left[k, one]), int(one), int(near[k, one])


def settle(size: np.ndarray, held: np.ndarray, gap: float) -> np.ndarray:
    """Copies to add to, or take from, documents of these sizes that have ``held`` copies, so that words near ``gap`` are added.

    Sizes fall. Large documents take what they can, smaller ones what is left; then copies of two at a time are changed.
    """
    move = np.zeros(len(size), np.int64)
    for k in range(len(size)):
        step = int(np.clip(round(gap / size[k]), -held[k], MOST - held[k]))
        move[k] = step
        gap -= step * int(size[k])
    for _ in range(EXCHANGES):
        up, down = np.flatnonzero(held + move < MOST), np.flatnonzero(held + move > 0)
        # one copy more or less of a document, or none
        doc, sign = np.concatenate(([-1], up, down)), np.concatenate(([0], np.ones(len(up), np.int64), -np.ones(len(down), np.int64)))
        words = sign * np.concatenate(([0], size[up], size[down]))
        order = np.argsort(words, kind="stable")
        doc, sign, words = doc[order], sign[order], words[order]
        least, steps = abs(gap), ()
        none = int(np.flatnonzero(doc < 0)[0])
        for third in (none, *range(0, len(doc), 1 + len(doc) // THIRDS)):
            left, one, two = _two_steps(doc, words, gap - words[third], doc[third])
            if left < least:
                least, steps = left, (one, two, third)
            if third == none and steps:
                break
        if not steps or abs(gap) < 0.5:
            break
        for step in steps:
            move[max(doc[step], 0)] += sign[step]
            gap -= float(words[step])
    return move


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["first", "c", "part"], ascending=[False, True, True])
    move = settle(rows["first"].to_numpy(), rows["held"].to_numpy(), float(rows["gap"].iloc[0]))
    return rows[["s", "c", "part"]].assign(move=move).loc[move != 0]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id") -> DataFrame:
    """Copies of each document for the target mix: ``docs`` plus ``size, source_size, target, rate, copies, taken``.

    ``size`` counts words; sources in order of code point, null last (null is a source of its own), take the weights
    in turn and share the total. ``copies`` is 0 to 3 and the same in each run. Empty and null texts have size 0 and
    are kept once (rate 1, taken 0). The first document of each of up to PARTS parts of a size class may be given other
    copies than rounding gives, to bring its source to its target as near as whole copies allow. Rows with repeated or null ids are documents like any other. Columns of ``docs``
    with the names of the new ones are replaced. An empty table gives no rows.
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    own, kind, part_, mark, rank = (fresh(x, [*docs.columns, *made]) for x in ("_s", "_class", "_part", "_hash", "_rank"))
    key = [own, kind, part_]
    rows = docs.drop(*[c for c in made if c in docs.columns]).withColumn("size", word_count(F.col("text")))
    rows = rows.withColumn(own, source_key(F.col("source")))
    rows = rows.withColumn(kind, F.floor(F.log2(F.col("size") + 1.0) * CLASSES_PER_OCTAVE).cast("long"))
    rows = rows.withColumn(mark, F.xxhash64(F.col(id_col), "text"))
    slim = materialize(rows.select(own, kind, "size", id_col, mark))
    parts = max(PARTS, slim.count() // PART_ROWS)
    in_parts = lambda x: x.withColumn(part_, F.pmod(F.xxhash64(mark), F.lit(parts)))
    slim, rows = in_parts(slim), in_parts(rows)
    groups = materialize(
        slim.groupBy(F.col(own).alias("s"), F.col(kind).alias("c"), F.col(part_).alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("first"))
    )
    targets = materialize(source_targets(groups.groupBy("s").agg(F.sum("words").alias("source_size")), weights))
    classes = groups.where("c > 0").groupBy("s", "c").agg(F.sum("words").alias("words"))
    known = targets.join(_solve(classes, targets), "s", "left")
    full = F.col("target") >= F.col("source_size") * (MOST - 1e-9)
    rate = (
        F.when((F.col("c") == 0) | F.col("lam").isNull(), F.lit(1.0))
        .when(full, F.lit(float(MOST)))
        .otherwise(_rate(F.col("lam"), F.col("c") / F.col("mean")))
    )
    part = groups.join(known, "s").select("s", "c", "part", "n", "first", "source_size", "target", rate.alias("rate"))
    # fractional parts are whole numbers of UNIT, whose running sums are exact
    part = part.withColumn("extra", F.floor((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    ahead = Window.partitionBy("s").orderBy(F.desc("c"), "part").rowsBetween(Window.unboundedPreceding, -1)
    part = materialize(part.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("extra")).over(ahead), F.lit(0).cast("long"))))
    extra, before, move = (fresh(x, rows.columns) for x in ("_extra", "_before", "_move"))
    order = Window.partitionBy(*key).orderBy(F.desc("size"), id_col, mark)

    def rounded(before: Column, extra: Column, rank: Column) -> Column:
        upto = before + rank * extra + UNIT // 2
        steps = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - extra, UNIT_BITS)
        return F.least(F.floor("rate") + steps, F.lit(MOST)).cast("long")

    dealt = part.select(F.col("s").alias(own), F.col("c").alias(kind), F.col("part").alias(part_), "source_size", "target", "rate", F.col("extra").alias(extra), F.col("before").alias(before))
    counted = rounded(F.col(before), F.col(extra), F.col(rank))
    ranked = slim.withColumn(rank, F.row_number().over(order)).join(dealt, key)
    gaps = ranked.groupBy(F.col(own).alias("s"), "target").agg(F.sum(counted * F.col("size")).alias("got")).select("s", (F.col("target") - F.col("got")).alias("gap"))
    # a source has some thousands of these rows at most, whatever its size
    firsts = part.where((F.col("c") > 0) & (F.col("part") < PARTS)).join(gaps, "s")
    firsts = firsts.select("s", "c", "part", "first", rounded(F.col("before"), F.col("extra"), F.lit(1)).alias("held"), "gap")
    moves = firsts.groupBy("s").applyInPandas(_settled, "s string, c long, part long, move long")
    moves = moves.select(F.col("s").alias(own), F.col("c").alias(kind), F.col("part").alias(part_), F.col("move").alias(move))
    part = materialize(dealt.join(moves, key, "left").fillna(0, [move]))
    return (
        rows.withColumn(rank, F.row_number().over(order))
        .join(part, key)
        .withColumn("copies", counted + F.when(F.col(rank) == 1, F.col(move)).otherwise(F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[c for c in docs.columns if c not in made], *made)
    )
