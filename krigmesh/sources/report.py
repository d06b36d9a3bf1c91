"""Reports of one run: HTML, plot data, templates. All of it small tables."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shown(v) -> str:
    if v is None:
        return "NA"
    if isinstance(v, float):
        return "NA" if v != v or v in (float("inf"), float("-inf")) else f"{round(v, 3):g}"
    return str(v)


SECTIONS = (
    ("Summary", ("final_grade", "final_score", "decision_hint", "transform")), ("Data quality", ("n_valid", "outlier_count", "n_outside_valid", "n_outside_soft", "skewness")), ("Trend", ("trend_r2",)),
    ("Variogram", ("model", "nugget", "psill", "range", "practical_range", "nugget_sill_ratio", "quality_label", "low_pair_bins")), ("Cross-validation", ("rk_rmse", "rk_mae", "rk_me", "cv_r2", "nrmse_mean", "rpd")), ("Baselines", ("regression_rmse", "ok_rmse")),
    ("Component scores", ("score_data_quality", "score_regression_trend", "score_residual_variogram", "score_cross_validation", "score_uncertainty", "score_class_evaluation")), ("Classes", ("class_enabled", "class_accuracy")), ("Warnings", ("warnings",)), ("Recommendations", ("recommendations",)),
)


def report_html(report: DataFrame, title: str) -> str:
    """A page of ten sections from a report of one row."""
    row = report.first().asDict()
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, keys in SECTIONS:
        cells = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape('; '.join(map(shown, v)) if isinstance(v := row.get(k), list) else shown(v))}</td></tr>" for k in keys)
        parts.append(f"<h2>{html.escape(name)}</h2><table>{cells}</table>")
    return "".join(parts) + "</body></html>"


def variogram_html(bins: DataFrame, model: dict, title: str) -> str:
    """A page with the bins, the model and a curve that follows the sliders. Bins are few by their width."""
    rows = [[r["dist"], r["gamma"], r["np"]] for r in bins.orderBy("dist").collect()]
    data = json.dumps({"bins": rows, "model": model})
    script = (
        "const d=DATA,c=document.querySelector('canvas'),g=c.getContext('2d'),q=n=>+document.getElementById(n).value;"
        "function shape(m,h,a){if(m==='Sph'){return h>=a?1:1.5*h/a-.5*Math.pow(h/a,3)}return m==='Gau'?1-Math.exp(-h*h/a/a):1-Math.exp(-h/a)}"
        "function draw(){const mx=Math.max(...d.bins.map(b=>b[0])),my=1.2*Math.max(...d.bins.map(b=>b[1]));g.clearRect(0,0,600,300);"
        "d.bins.forEach(b=>g.fillRect(b[0]/mx*580,300-b[1]/my*300,4,4));g.beginPath();"
        "for(let i=1;i<=580;i++){const h=i/580*mx,y=q('nugget')+q('psill')*shape(d.model.model,h,q('range'));g.lineTo(i,300-y/my*300)}g.stroke()}"
        "document.querySelectorAll('input').forEach(e=>e.oninput=draw);draw();"
    ).replace("DATA", data)
    fields = "".join(f"<label>{k} <input id='{k}' type='number' step='any' value='{model[k]}'></label>" for k in ("nugget", "psill", "range"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{fields}<br><canvas width='600' height='300'></canvas><script>{script}</script></body></html>"


def histogram(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """bin, low, high, n: equal bins between the extremes."""
    box = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / n
    k = F.least(F.lit(n), F.when(w > 0, F.floor((F.col(value) - F.col("_lo")) / w) + 1).otherwise(1)).cast("int")
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(box))  # one row
    g = rows.groupBy(k.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("_lo") + (F.col("bin") - 1) * w).alias("low"), (F.col("_lo") + F.col("bin") * w).alias("high"), "n")


def profile_template(spark: SparkSession) -> DataFrame:
    """The built-in profiles as a table to edit."""
    from ..operators.evaluate import profiles

    rows = [(p.name, p.unit, ";".join(p.aliases), p.transform, p.nonnegative, *(p.hard or (None, None)), *(p.soft or (None, None)), ";".join(b[0] for b in p.bins)) for p in profiles().values()]
    rows = [tuple(float(v) if i in (5, 6, 7, 8) and v is not None else v for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, "name string, unit string, aliases string, default_transform string, transform_requires_nonnegative boolean, hard_min double, hard_max double, soft_min double, soft_max double, labels string")


def point_template(spark: SparkSession) -> DataFrame:
    """An empty sample table: code, lat, lon and a column for each profile."""
    from ..operators.evaluate import profiles

    names = [n for n in profiles() if n != "generic_continuous"]
    return spark.createDataFrame([], ", ".join(["code string", "lat double", "lon double", *[f"`{n}` double" for n in names]]))
