"""Several runs: one target after another from one table, and the controlled loop over parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.numeric import to_number
from ..operators import control, evaluate
from .run import report


def targets_of(columns: list[str], reserved: list[str], wanted: str = "all") -> list[str]:
    """Targets named in a comma-separated list, or all analysis columns; an unknown name is an error."""
    own = [c for c in columns if c not in reserved]
    if wanted.strip().lower() in ("", "all"):
        return own
    asked = [t.strip() for t in wanted.split(",") if t.strip()]
    if missing := [t for t in asked if t not in own]:
        raise ValueError(f"no columns {', '.join(missing)}")
    return asked


def batch(points: DataFrame, targets: list[str], predictors: list[str], cfg: Config = DEFAULT, dry_run: bool = False) -> list[dict]:
    """A record for each target: status, and the report's row where it ran. A failing target does not stop the others."""
    out, known = [], evaluate.profiles()
    match = {r["t"]: r["profile"] for r in evaluate.match_profiles(points.sparkSession.createDataFrame([(t,) for t in targets], "t string"), "t").collect()}
    for t in targets:
        rows = points.withColumn(t, to_number(t)) if dict(points.dtypes)[t] == "string" else points
        rows = rows.where(F.col(t).isNotNull())
        n = rows.count()
        row = {"target": t, "profile": match[t], "n_valid": n}
        if dry_run or n < 5:
            out.append(row | {"status": "dry_run" if dry_run else "too_few_rows"})
            continue
        try:
            out.append(row | {"status": "completed"} | report(rows, t, predictors, cfg, known[match[t]]).first().asDict(recursive=True))
        except Exception as e:
            out.append(row | {"status": "failed", "error": str(e)[:500]})
    return out


def loop(run: Callable[[dict], dict], first: dict, max_iterations: int = 5, decide: Callable[[dict, dict, int], dict | None] | None = None, cumulative: bool = True) -> tuple[list[dict], str, str]:
    """Rerun with validated parameters until accepted or stopped: (iterations, stop reason, final decision).

    run(parameters) gives a record: status, r2, rmse, grade, hint, warnings, and what next_parameters reads. decide may
    give an external decision; without one the heuristic does.
    """
    done: list[dict] = []
    params, stale = dict(first), 0
    for i in range(1, max_iterations + 1):
        r = run(params)
        done.append(r | {"iteration": i, "parameters": dict(params)})
        if r.get("status", "completed") != "completed":
            return done, "RUN_FAILED_NO_RESULT", "MANUAL_REVIEW"
        severe = bool({"r2_negative", "range_hits_max", "in_sample", "no_candidate"} & set(r.get("warnings") or ()))
        if r.get("grade") in ("A", "B") and r.get("hint") == "ACCEPTABLE" and (r.get("r2") or 0) > 0 and not severe:
            return done, "ACCEPTABLE_RESULT", "FINAL_ACCEPT"
        if i == max_iterations:
            return done, "MAX_ITERATIONS_REACHED", "MANUAL_REVIEW"
        if len(done) > 1:
            before = done[-2]
            if all(x.get("r2") is not None and x["r2"] < 0 for x in (before, r)):
                return done, "R2_PRED_REMAINS_NEGATIVE", "MANUAL_REVIEW"
            if before.get("rmse") is not None and r.get("rmse") is not None:
                gain = (before["rmse"] - r["rmse"]) / max(before["rmse"], 1e-9) * 100
                fewer = len(r.get("warnings") or ()) < len(before.get("warnings") or ())
                stale = stale + 1 if gain < 3 and not fewer and not better(before, r) else 0
                if stale >= 2:
                    return done, "NO_MEANINGFUL_IMPROVEMENT", "MANUAL_REVIEW"
        decision = decide(r, params, i) if decide else None
        if decide and decision is None:
            return done, "WAITING_FOR_AI_DECISION", "MANUAL_REVIEW"
        if decision is None:
            nxt = control.next_parameters(r, params, r.get("best_variogram"), r.get("best_neighbours"))
            decision = {"decision": "RERUN" if nxt else "MANUAL_REVIEW", "confidence": "medium", "next_parameters": nxt}
        v = control.validate_decision(decision)
        if not v["valid"]:
            return done, "VALIDATOR_REJECTED_DECISION", "MANUAL_REVIEW"
        if v["decision"] == "ACCEPT":
            return done, "AI_ACCEPTED_RESULT", "FINAL_ACCEPT"
        if v["decision"] != "RERUN":
            return done, f"AI_{v['decision']}", "REJECT" if v["decision"] == "REJECT" else "MANUAL_REVIEW"
        params = {**(params if cumulative else first), **v["accepted_parameters"]}
    return done, "LOOP_ENDED", "MANUAL_REVIEW"


def better(before: dict, now: dict) -> list[str]:
    """Which diagnostics improved."""
    pair = lambda k: (before.get(k), now.get(k))
    both = lambda k, f: None not in pair(k) and f(*pair(k))
    rules = {"nugget_sill_ratio": lambda a, b: b <= a - 0.05, "class_accuracy": lambda a, b: b >= a + 0.03, "severe_rate": lambda a, b: b <= a - 0.03, "high_uncertainty_percent": lambda a, b: b <= a - 5, "r2": lambda a, b: b >= a + 0.05}
    out = [k for k, f in rules.items() if both(k, f)]
    return out + (["range_hit_max"] if before.get("range_hit_max") and not now.get("range_hit_max") else [])
