"""Parameter sweeps: thresholds in one job, successive halving over scenes, brackets of drawn trials, the best trial."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import evaluation
from ..operators.images import POINT
from ..operators import refinement
from ..params import DYNAMIC, UNDETERMINED, Params
from ..session import saved


def sweep_geometric(coarse: DataFrame, gt: DataFrame, votes: Sequence[int]) -> DataFrame:
    """tp, fp, fn, tn, iou of every vote threshold, from one pass over the votes."""
    counted = coarse.groupBy(*POINT).agg(F.count_if(F.col("label") == DYNAMIC).alias("votes"), F.max(F.when(F.col("k") == 1, F.col("label"))).alias("previous"))
    trials = F.explode(F.array(*[F.struct(F.lit(i).alias("trial_id"), F.lit(v).alias("vote")) for i, v in enumerate(votes)]))
    label = F.when(F.col("votes") >= F.col("t.vote"), DYNAMIC).otherwise(F.coalesce("previous", F.lit(UNDETERMINED)))
    matched = evaluation.match_gt(counted, gt).withColumn("t", trials).select("t.trial_id", "t.vote", *POINT, "is_gt", label.alias("label"))
    return evaluation.with_iou(evaluation.confusion(matched, ("trial_id", "vote")))


def _below_critical(critical: DataFrame, gt: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """tp, fp, fn, tn, iou of every value of a parameter, where a point is dynamic for the values below its own ``critical`` (never, if null).

    Points are counted once, by how many values their critical one exceeds; the rest are running sums over that few rows.
    """
    order = sorted(range(len(values)), key=lambda i: values[i])
    ascending = F.array(*[F.lit(float(values[i])) for i in order])
    exceeds = F.coalesce(F.size(F.filter(ascending, lambda v: v < F.col("critical"))), F.lit(0))
    counts = evaluation.match_gt(critical, gt).groupBy(exceeds.alias("b")).agg(F.count_if("is_gt").alias("g"), F.count_if(~F.col("is_gt")).alias("o"))
    every = critical.sparkSession.range(len(values) + 1).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("o"))
    per = counts.unionByName(every).groupBy("b").agg(F.sum("g").alias("g"), F.sum("o").alias("o"))  # a row for each value
    down, whole = Window.orderBy(F.desc("b")), Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = per.select("b", F.sum("g").over(down).alias("tp"), F.sum("o").over(down).alias("fp"), F.sum("g").over(whole).alias("gs"), F.sum("o").over(whole).alias("os")).where("b > 0")
    trial, value = F.get(F.array(*[F.lit(i) for i in order]), F.col("b") - 1), F.get(ascending, F.col("b") - 1)
    return evaluation.with_iou(sums.select(trial.alias("trial_id"), value.alias(name), "tp", "fp", (F.col("gs") - F.col("tp")).alias("fn"), (F.col("os") - F.col("fp")).alias("tn")))


def sweep_epsilon(margins: DataFrame, points: DataFrame, gt: DataFrame, vote: int, epsilons: Sequence[float]) -> DataFrame:
    """Every tolerance of the coarse pass at once: a point is dynamic while the tolerance is below its ``vote``-th greatest margin.

    ``points`` are all that are scored, also those without any margin.
    """
    ranked = F.sort_array(F.collect_list("margin"), asc=False)  # at most as many as past images
    critical = margins.groupBy(*POINT).agg(F.get(ranked, F.lit(vote - 1)).alias("critical"))
    return _below_critical(points.select(*POINT).join(critical, POINT, "left"), gt, epsilons, "epsilon")


def sweep_mcc(labels: DataFrame, scores: DataFrame, gt: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Every threshold of map consistency at once: a dynamic point stays so while the threshold is above its score."""
    critical = F.when(F.col("label") == DYNAMIC, -F.col("score"))
    out = _below_critical(labels.join(scores.select(*POINT, "score"), POINT, "left").select(*POINT, critical.alias("critical")), gt, [-t for t in thresholds], "threshold")
    return out.withColumn("threshold", -F.col("threshold"))


def scene_trials(coarse: DataFrame, gt: DataFrame, votes: Sequence[int]) -> DataFrame:
    """The same per scene: the input of successive halving."""
    counted = coarse.groupBy(*POINT).agg(F.count_if(F.col("label") == DYNAMIC).alias("votes"))
    trials = F.explode(F.array(*[F.struct(F.lit(i).alias("trial_id"), F.lit(v).alias("vote")) for i, v in enumerate(votes)]))
    matched = evaluation.match_gt(counted, gt).withColumn("t", trials).select("t.trial_id", *POINT, "is_gt", F.when(F.col("votes") >= F.col("t.vote"), DYNAMIC).otherwise(UNDETERMINED).alias("label"))
    return evaluation.confusion(matched, ("trial_id", "scene_id"))


def successive_halving(per_scene: DataFrame, factor: int = 3) -> DataFrame:
    """After each scene the running IoU ranks the trials that are left; the best share 1/factor (rounded up) goes on.

    Returns the trials that saw each rung: rung, trial_id, iou, survives.  Running sums are one window; as many rounds are
    needed as it takes to come down to one trial, however many scenes follow.
    """
    running = Window.partitionBy("trial_id").orderBy("scene_id")
    sums = evaluation.with_iou(per_scene.select("trial_id", (F.row_number().over(running) - 1).alias("rung"), *[F.sum(c).over(running).alias(c) for c in ("tp", "fp", "fn", "tn")]))
    sums = saved(sums.select("rung", "trial_id", "iou"))
    left, last = sums.agg(F.count_distinct("trial_id"), F.coalesce(F.max("rung"), F.lit(-1))).first()
    seen, rungs = sums, sums.limit(0).withColumn("survives", F.lit(True))
    for rung in range(last + 1):
        left = -(-left // factor)
        # trials are few: a rung's ranks are one small window
        ranked = saved(seen.where(F.col("rung") == rung).withColumn("survives", F.row_number().over(Window.orderBy(F.desc("iou"), "trial_id")) <= left))
        rungs = rungs.unionByName(ranked)
        seen = saved(seen.where(F.col("rung") > rung).join(ranked.where("survives").select("trial_id"), "trial_id", "left_semi").select("rung", "trial_id", "iou"))
        if left == 1:  # the last one sees all the rest
            return rungs.unionByName(seen.withColumn("survives", F.lit(True)))
    return rungs


class Bracket(NamedTuple):
    """How many trials start, and after which budgets how many of them are left."""

    trials: int
    budgets: tuple[int, ...]
    keeps: tuple[int, ...]


def brackets(budget: int, factor: int = 3) -> list[Bracket]:
    """From many trials that start with little to few that get all of ``budget`` at once.

    Bracket b of s + 1 starts at budget / factor^(s - b), s being the greatest power of ``factor`` within the budget; at each of its
    budgets the best share 1/factor (rounded down, one at least) goes on, and after the last one the best trial alone.
    """
    if budget < 1 or factor < 2:
        raise ValueError("a budget of at least 1 and a factor of at least 2")
    s = 0
    while factor ** (s + 1) <= budget:
        s += 1
    out = []
    for steps in range(s, -1, -1):
        n = -(-(s + 1) * factor**steps // (steps + 1))
        out.append(Bracket(n, tuple(budget // factor ** (steps - i) for i in range(steps + 1)), tuple(max(1, n // factor ** (i + 1)) for i in range(steps)) + (1,)))
    return out


def drawn(seed: int, trial: int, name: str) -> float:
    """A number in [0, 1) that depends on its arguments alone, so that a study is the same on every cluster."""
    return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) / 2**32


def draw_trials(n: int, ranges: Mapping[str, tuple[float, float] | Sequence[int]], seed: int = 0) -> list[dict]:
    """``n`` trials: a pair of floats is a range to draw from evenly, anything else a list to choose from."""
    trials = []
    for t in range(n):
        values = {}
        for name, given in ranges.items():
            u = drawn(seed, t, name)
            if len(given) == 2 and all(isinstance(v, float) for v in given):
                values[name] = given[0] + u * (given[1] - given[0])
            else:
                values[name] = given[int(u * len(given))]
        trials.append({"trial_id": t, **values})
    return trials


def tolerance_trials(margins: DataFrame, points: DataFrame, gt: DataFrame, trials: Sequence[Mapping], unit: str = "scene_id") -> DataFrame:
    """trial_id, ``unit``, tp, fp, fn, tn of trials with an ``epsilon`` and a ``vote`` each: a point is dynamic while its
    ``vote``-th greatest margin is above ``epsilon``.

    A point gives one row a vote, with the number of that vote's tolerances that it is above, and is counted before anything is
    shuffled; trials then sum the few counts.  ``points`` are all that are scored.
    """
    by_vote: dict[int, list[float]] = {}
    for t in trials:
        by_vote.setdefault(t["vote"], []).append(t["epsilon"])
    by_vote = {v: sorted(set(e)) for v, e in by_vote.items()}
    if not trials:
        return points.sparkSession.createDataFrame([], f"trial_id int, {unit} {dict(points.dtypes)[unit]}, tp long, fp long, fn long, tn long")
    ranked = margins.groupBy(*POINT).agg(F.sort_array(F.collect_list("margin"), asc=False).alias("ranked"))  # at most as many as past images

    def above(vote: int, tolerances: list[float]):
        array, critical = F.array(*[F.lit(float(e)) for e in tolerances]), F.get("ranked", F.lit(vote - 1))
        return F.struct(F.lit(vote).alias("vote"), F.coalesce(F.size(F.filter(array, lambda e: e < critical)), F.lit(0)).alias("b"))

    matched = evaluation.match_gt(points.select(*POINT).join(ranked, POINT, "left"), gt)
    asked = matched.select(unit, "is_gt", F.explode(F.array(*[above(v, e) for v, e in by_vote.items()])).alias("v"))
    counts = asked.groupBy(unit, "v.vote", "v.b").agg(F.count_if("is_gt").alias("g"), F.count_if(~F.col("is_gt")).alias("o"))
    rows = [(t["trial_id"], t["vote"], by_vote[t["vote"]].index(t["epsilon"])) for t in trials]
    few = F.broadcast(points.sparkSession.createDataFrame(rows, "trial_id int, vote int, place int"))  # a row a trial
    dynamic = F.col("b") > F.col("place")
    total = lambda name, cond: F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0)).alias
    return counts.join(few, "vote").groupBy("trial_id", unit).agg(total("g", dynamic)("tp"), total("o", dynamic)("fp"), total("g", ~dynamic)("fn"), total("o", ~dynamic)("tn"))


def hyperband(per_unit: DataFrame, budget: int, factor: int = 3, unit: str = "scene_id") -> DataFrame:
    """Successive halving in ``brackets`` of different first budgets, a budget being a number of units in order.

    Trials are dealt to the brackets in order of trial_id.  Returns bracket, rung, budget, trial_id, iou and survives, a row for each
    trial that came as far.  Where there are fewer units than a budget asks for, all there are count.  Ties go to the smaller trial_id.
    """
    plan = brackets(budget, factor)
    starts = [sum(b.trials for b in plan[:i]) for i in range(len(plan))]
    rungs = [(i, r, b.budgets[r], b.keeps[r], starts[i], starts[i] + b.trials) for i, b in enumerate(plan) for r in range(len(b.budgets))]
    schedule = F.broadcast(per_unit.sparkSession.createDataFrame(rungs, "bracket int, rung int, budget int, keeps int, low int, high int"))
    order = Window.partitionBy("trial_id").orderBy(unit)
    deal = per_unit.select("trial_id").distinct().withColumn("n", F.row_number().over(Window.orderBy("trial_id")) - 1)  # trials are few
    numbered = per_unit.select("trial_id", "tp", "fp", "fn", F.row_number().over(order).alias("at")).join(F.broadcast(deal), "trial_id")
    sums = numbered.join(schedule, (F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")) & (F.col("at") <= F.col("budget")))
    sums = sums.groupBy("bracket", "rung", "budget", "keeps", "trial_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    seen, out = saved(evaluation.with_iou(sums).select("bracket", "rung", "budget", "keeps", "trial_id", "iou")), None
    best = Window.partitionBy("bracket").orderBy(F.desc("iou"), "trial_id")
    for rung in range(1 + max(r[1] for r in rungs)):  # all brackets side by side
        ranked = saved(seen.where(F.col("rung") == rung).withColumn("survives", F.row_number().over(best) <= F.col("keeps")).drop("keeps"))
        out = ranked if out is None else out.unionByName(ranked)
        seen = seen.where(F.col("rung") > rung).join(F.broadcast(ranked.where("survives").select("bracket", "trial_id")), ["bracket", "trial_id"], "left_semi")
    return out


def sweep_refinement(labels: DataFrame, gpoints: DataFrame, gt: DataFrame, p: Params, trials: Sequence[tuple[float, int]]) -> DataFrame:
    """tp, fp, fn, tn, iou of every (cluster_epsilon, cluster_least) over stored labels: trial_id, cluster_epsilon, cluster_least.

    All trials are one chain of jobs: a sweep in a trial is a sweep of its own, and radius and least number are columns that depend on it.
    So the driver plans, broadcasts and keeps as much as for a single trial.  The hierarchy ("hdbscan") has no such columns; its trials follow each other.
    """
    if not trials:
        return labels.sparkSession.createDataFrame([], "trial_id int, cluster_epsilon double, cluster_least int, tp long, fp long, fn long, tn long, iou double")
    labels, n = saved(labels), len(trials)
    epsilons, leasts = [float(e) for e, _ in trials], [least for _, least in trials]
    of = lambda trial, values: F.get(F.array(*map(F.lit, values)), trial)

    def tried(df: DataFrame) -> DataFrame:
        """The rows once a trial, with numbers of sweeps that tell the trials apart."""
        return df.withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sweep_idx", F.col("sweep_idx").cast("long") * n + F.col("_trial")).drop("_trial")

    def scored(refined: DataFrame, i: Column, epsilon: Column, least: Column) -> DataFrame:
        named = evaluation.match_gt(refined.withColumns({"trial_id": i, "cluster_epsilon": epsilon, "cluster_least": least}), gt)
        return saved(evaluation.with_iou(evaluation.confusion(named, ("trial_id", "cluster_epsilon", "cluster_least"))))

    if p.refine == "hdbscan":
        one_by_one = [scored(refinement.refine(labels, gpoints, p.with_(cluster_epsilon=e, cluster_least=least)), F.lit(i), F.lit(float(e)), F.lit(least)) for i, (e, least) in enumerate(trials)]
        return reduce(DataFrame.unionByName, one_by_one)
    trial = F.pmod("sweep_idx", F.lit(n))
    refined = refinement.refine(tried(labels), tried(gpoints), p.with_(cluster_epsilon=of(trial, epsilons), cluster_least=of(trial, leasts)))
    i = F.col("_trial")
    told = refined.withColumn("_trial", trial.cast("int")).withColumn("sweep_idx", F.floor(F.col("sweep_idx") / n).cast("int"))
    return scored(told, i, of(i, epsilons), of(i, leasts))


def trial_results(trials: DataFrame) -> DataFrame:
    """The trials with their rank by IoU (ties: the first) and what they lack to the best one."""
    order = Window.orderBy(F.desc("iou"), "trial_id")  # trials are few
    return trials.withColumns({"rank": F.row_number().over(order), "behind": F.first("iou").over(order) - F.col("iou")})


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of greatest IoU (ties: the first)."""
    return trials.orderBy(F.desc("iou"), "trial_id").limit(1)


def export_best(trials: DataFrame, path: str) -> None:
    """The best trial as one JSON document; dotted names become nested fields."""
    best = best_trial(trials)
    groups: dict[str, list] = {}
    for c in best.columns:
        head, _, tail = c.partition(".")
        groups.setdefault(head, []).append((tail, F.col(f"`{c}`")))
    nested = [F.struct(*[col.alias(t) for t, col in cols]).alias(h) if cols[0][0] else cols[0][1].alias(h) for h, cols in groups.items()]
    best.select(*nested).write.mode("overwrite").json(path)
