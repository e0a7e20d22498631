"""The whole configuration search: skeleton contexts, a probe, search, refinement, calibration, roles.

Skeletons of different sizes are contexts; targets that lead to the same nodes share one.
A probe with one configuration each decides which contexts are searched in full; the
search runs on a part of the queries, and its best and most different candidates are
measured again on all of them before roles are given out. Everything on the driver is a
table of candidates; contexts, trainings and measurements are Spark jobs.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklore.operators import graphs as G
from ranklore.operators import selector as SEL
from ranklore.operators.selector import Config, Metrics, Options, Weights

#: Weights by dataset size (from so many rows on), balanced and for recall.
ADAPTIVE_WEIGHTS = {
    0: Weights(),
    100_000: Weights(0.68, 0.10, 0.14, 0.05, 0.03),
    500_000: Weights(0.75, 0.10, 0.10, 0.03, 0.02),
    2_000_000: Weights(0.78, 0.10, 0.09, 0.02, 0.01),
}
RECALL_WEIGHTS = {0: Weights(0.88, 0.08, 0.03, 0.01, 0.0), 500_000: Weights(0.90, 0.07, 0.02, 0.01, 0.0)}
#: The profile that "auto" stands for, by dataset size (from so many rows on).
AUTO_PROFILES = {0: "exhaustive", 500_000: "balanced", 3_000_000: "fast"}
#: Contexts searched in full, by profile; None: all.
CONTEXT_LIMITS = {"fast": 2, "balanced": 4, "exhaustive": None}
ROLES = ("peak_recall", "knee", "fast", "small")


def _by_size(table: dict, n: int):
    return table[max(start for start in table if start <= n)]


def effective_profile(profile: str, n: int) -> str:
    name = (profile or "auto").lower()
    if name not in ("auto", *SEL.TIME_BUDGETS):
        raise ValueError(f"unknown profile {profile!r}")
    return _by_size(AUTO_PROFILES, n) if name == "auto" else name


def effective_weights(options: Options, n: int) -> Weights:
    """The caller's weights; where those are the defaults, what suits a dataset of this size."""
    if options.weights != Weights():
        return options.weights
    return _by_size(RECALL_WEIGHTS if options.for_recall else ADAPTIVE_WEIGHTS, n)


@dataclass
class Context:
    """A skeleton: its nodes and links, and the targets that lead to it."""

    targets: tuple[int, ...]
    size: int
    nodes: DataFrame
    edges: DataFrame
    score: float = -math.inf

    @property
    def target(self) -> int:
        return self.targets[0]


def build_contexts(df: DataFrame, m: int, targets: list[int], seed: int = 0) -> list[Context]:
    """One context for each different skeleton, smallest first."""
    out = []
    for row in sorted(G.contexts(df, m, targets, seed).collect(), key=lambda r: r["nodes"]):  # one row a skeleton
        nodes, edges = G.skeleton(df, m, row["targets"][0], seed)
        out.append(Context(tuple(row["targets"]), row["nodes"], nodes, edges))
    return out


def evenly_spaced(n: int, m: int) -> list[int]:
    """``m`` of the places 0 to n - 1, the first and the last among them."""
    if m >= n:
        return list(range(n))
    return sorted({round(i * (n - 1) / max(m - 1, 1)) for i in range(m)})


def scaled_to(options: Options, context: Context, n: int, largest: int) -> Options:
    """Ladders thinned to what a context's skeleton can carry."""
    full = SEL.resolved(options, n, context.size)
    scale = SEL.capacity_scale(context.size, largest)

    def thin(values: tuple[int, ...], least: int, anchor: int) -> tuple[int, ...]:
        return tuple(SEL.capacity_values(list(values), context.size, scale, least, anchor)) if scale < 1 else values

    k_values = thin(full.k_values, 3, SEL.k_anchor(full, n))
    return replace(
        full,
        k_values=k_values,
        knn_values=thin(full.knn_values, 2, SEL.target_knn(max(k_values), options.for_recall)),
        branches=thin(full.branches, 2, SEL.target_branch(max(k_values), options.for_recall)),
    )


def choose_contexts(contexts: list[Context], keep: int | None, probe: Callable[[Context], Metrics]) -> list[Context]:
    """The contexts to search in full, best first. Where there are more than ``keep``, evenly spaced ones are
    probed; the smallest and the largest stay in any case (of ``keep`` one, the best alone), the rest by score."""
    if not keep or keep >= len(contexts):
        return contexts
    for place in evenly_spaced(len(contexts), min(len(contexts), max(2 * keep, keep + 2))):
        m = probe(contexts[place])
        contexts[place].score = m.quality if m.ok else -math.inf
    order = sorted(contexts, key=lambda c: (-c.score, -c.size))
    sure = [order[0]] if keep == 1 else [contexts[0], contexts[-1]]
    chosen = sure + [c for c in order if all(c is not s for s in sure)][: keep - len(sure)]
    return sorted(chosen, key=lambda c: (-c.score, -c.size))


def recall_anchor(metrics: list[Metrics]) -> Metrics:
    return min((m for m in metrics if m.ok), key=lambda m: (-m.recall, -m.quality, -m.objective, m.latency_ms))


def quality_anchor(metrics: list[Metrics]) -> Metrics:
    return min((m for m in metrics if m.ok), key=lambda m: (-m.quality, -m.recall, -m.objective, m.latency_ms))


def within_reach(config: Config, options: Options, skeleton: int, radius: int) -> list[Config]:
    """Configurations at most ``radius`` single steps away, nearest first."""
    seen, rim = {config}, [config]
    for _ in range(radius):
        rim = [c for r in rim for c in SEL.neighbours_of(r, options, skeleton) if c not in seen and not seen.add(c)]
    return [c for c in seen if c != config]


def refine_for_recall(trials: SEL.Trials, options: Options, skeleton: int, rounds: int = 3, limit: int = 12, least_gain: float = 0.002) -> int:
    """Search around the best recall, wider each round, as long as a round raises it by ``least_gain``; rounds done."""
    done = 0
    while done < rounds and not trials.exhausted():
        anchor = recall_anchor(list(trials.done.values()))
        fresh = [c for c in within_reach(anchor.config, options, skeleton, min(4, 2 + done)) if c not in trials.done and not c.graph_order]
        if not fresh:
            break
        found = trials.run_all(fresh[:limit])
        done += 1
        if max((m.recall for m in found if m.ok), default=0.0) <= anchor.recall + least_gain:
            break
    return done


def explore_after(trials: SEL.Trials, options: Options, skeleton: int, limit: int = 8) -> int:
    """Candidates near the best ones that no round has come to; how many were tried."""
    now = list(trials.done.values())
    SEL.assign_objectives(now, options.weights)
    fresh: dict[Config, None] = {}
    for m in SEL.ranked(now, options.kept, None, options.recall_target):
        for c in within_reach(m.config, options, skeleton, 3 if options.for_recall else 2):
            if c not in trials.done and not c.graph_order and len(fresh) < limit:
                fresh[c] = None
    return len(trials.run_all(list(fresh)))


Tried = tuple[Context, Metrics]


def calibration_seeds(pool: list[Tried], limit: int, target: float | None = None) -> list[Tried]:
    """Candidates worth a second measurement: the best of each context first, then the best of all."""
    order = {id(m): i for i, m in enumerate(SEL.ranked([m for _, m in pool], len(pool), None, target))}
    held = sorted((t for t in pool if id(t[1]) in order), key=lambda t: order[id(t[1])])
    firsts, rest, seen = [], [], set()
    for tried in held:
        (rest if id(tried[0]) in seen else firsts).append(tried)
        seen.add(id(tried[0]))
    return (firsts + rest)[:limit]


def role_seeds(pool: list[Tried], seeds: list[Tried], limit: int, budget: int | None = None, target: float | None = None) -> list[Tried]:
    """Those that hold a role now, then the best by recall within the budget, then ``seeds``; each once."""
    metrics = [m for _, m in pool]
    holders = [m for name in ROLES if (m := SEL.roles(metrics, budget, target).get(name))]
    by_recall = sorted(
        SEL.affordable(metrics, budget),
        key=lambda m: (*SEL._target_key(m, target), -m.recall, -m.auc, m.rank_distance, -m.quality, m.latency_ms, m.size_bytes),
    )
    of = {id(m): t for t in pool for m in [t[1]]}
    wanted = [of[id(m)] for m in [*holders, *by_recall]] + seeds
    return list({id(t[1]): t for t in wanted}.values())[:limit]


def graph_order_evidence(metrics: list[Metrics]) -> dict[str, dict]:
    """Best figures of the candidates with and without the graph's part in the centroid order."""
    out = {}
    for name, flag in (("enabled", True), ("disabled", False)):
        own = [m for m in metrics if m.ok and m.config.graph_order == flag]
        best = {"candidates": len(own)}
        if own:
            best |= {"quality": max(m.quality for m in own), "recall": max(m.recall for m in own), "rank_distance": min(m.rank_distance for m in own)}
        out[name] = best
    return out


@dataclass
class Outcome:
    """What a search found: the candidates of the search, the calibrated ones with their roles, and how it went."""

    candidates: list[Tried]
    calibrated: list[Tried]
    roles: dict[str, Metrics]
    profile: str
    weights: Weights
    contexts: int
    searched: int
    refine_rounds: int
    explored: int
    seconds: float
    evidence: dict = field(default_factory=dict)

    def as_dict(self, compact: bool = False) -> dict:
        """For JSON; ``compact`` leaves out all candidates but the calibrated."""

        def one(tried: Tried) -> dict:
            return {"target_skeleton": tried[0].target, "skeleton": tried[0].size, **asdict(tried[1])}

        told = {
            "version": 2 if compact else 1,
            "profile": self.profile,
            "weights": asdict(self.weights),
            "telemetry": {k: getattr(self, k) for k in ("contexts", "searched", "refine_rounds", "explored", "seconds")},
            "front": [asdict(m) for m in SEL.front([m for _, m in self.calibrated])],
            "roles": {name: asdict(m) for name, m in self.roles.items()},
            "calibrated": [one(t) for t in self.calibrated],
            "graph_order": self.evidence,
        }
        return told if compact else told | {"candidates": [one(t) for t in self.candidates]}


def coarse_part(queries: DataFrame, share: float = 0.5) -> DataFrame:
    """About ``share`` of the queries, by a hash of their id."""
    return queries.filter(F.pmod(F.xxhash64("vec_id", F.lit("coarse")), F.lit(1000)) < int(1000 * share))


def search(df: DataFrame, queries: DataFrame, options: Options, targets: list[int] | None = None, m: int = 16, calibrate: int = 6, share: float = 0.5) -> Outcome:
    """Search for configurations over skeletons of ``targets`` nodes (unset: by dataset size)."""
    begun, n = time.monotonic(), df.count()
    SEL.checked_options(options)
    profile = effective_profile(options.profile, n)
    options = replace(options, profile=profile, weights=effective_weights(options, n))
    contexts = build_contexts(df, m, targets or SEL.skeleton_targets(n, options.for_recall))
    largest = max(c.size for c in contexts)
    some = coarse_part(queries, share)
    some = queries if some.isEmpty() else some
    trials: dict[int, SEL.Trials] = {}

    def tried_in(context: Context) -> SEL.Trials:
        if id(context) not in trials:
            trials[id(context)] = SEL.Trials(df, some, scaled_to(options, context, n, largest), context.edges, context.nodes)
        return trials[id(context)]

    def probe(context: Context) -> Metrics:
        own = tried_in(context)
        return own.run(SEL.phase_one(own.options, n, context.size)[0])

    chosen = choose_contexts(contexts, CONTEXT_LIMITS[profile], probe)
    rounds = explored = 0
    pool: list[Tried] = []
    for context in chosen:
        own = tried_in(context)
        SEL.climb(own, context.size)
        if options.for_recall:
            rounds += refine_for_recall(own, own.options, context.size)
        explored += explore_after(own, own.options, context.size)
        pool += [(context, metric) for metric in own.done.values()]
    SEL.assign_objectives([metric for _, metric in pool], options.weights)
    seeds = role_seeds(pool, calibration_seeds(pool, calibrate, options.recall_target), calibrate, options.size_budget, options.recall_target)
    final: list[Tried] = []
    for context in chosen:
        wanted = [metric.config for c, metric in seeds if c is context]
        if wanted:
            whole = SEL.Trials(df, queries, replace(tried_in(context).options, max_trains=0, seconds=0), context.edges, context.nodes)
            whole.clusters = tried_in(context).clusters
            final += [(context, metric) for metric in whole.run_all(wanted)]
    SEL.assign_objectives([metric for _, metric in final], options.weights)
    told = [metric for _, metric in final]
    return Outcome(
        pool, final, SEL.roles(told, options.size_budget, options.recall_target), profile, options.weights, len(contexts), len(chosen), rounds, explored,
        time.monotonic() - begun, graph_order_evidence([metric for _, metric in pool]),
    )


def quality_status(metrics: list[Metrics], target: float | None = None) -> dict:
    """Whether all figures are finite shares and, where asked for, whether the recall was reached."""
    shares = [v for m in metrics if m.ok for v in (m.quality, m.recall, m.auc, m.rank_distance)]
    sound = bool(shares) and all(math.isfinite(v) and 0.0 <= v <= 1.0 for v in shares)
    reached = target is None or any(SEL.meets(m, target) for m in metrics if m.ok)
    return {"sound": sound, "recall_reached": reached, "ok": sound and reached}


#: Least seconds of a search by dataset size (from so many rows on), for smoke, baseline and deep runs.
BUDGET_FLOORS = {0: (60, 180, 300), 1_000_000: (180, 180, 300), 10_000_000: (600, 1200, 3600)}


def effective_budget(kind: str, seconds: int, n: int) -> int:
    """Seconds for a validation run: those asked for, at least what the dataset's size needs."""
    return max(seconds, _by_size(BUDGET_FLOORS, n)[("smoke", "baseline", "deep").index(kind)])
