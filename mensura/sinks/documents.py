"""Documents out of tables: plan JSON, schema, summaries, reports, floor plans as SVG, calibration versions."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = {"string": "string", "double": "number", "float": "number", "int": "integer", "bigint": "integer", "smallint": "integer", "boolean": "boolean", "timestamp": "string", "date": "string", "binary": "string"}


def plan_documents(captures: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """One nested row per capture: its rooms, each with its walls and openings, in order of id."""
    w = walls.groupBy("capture", "room").agg(F.sort_array(F.collect_list(F.struct("id", "length", "lo", "hi"))).alias("walls"))
    o = openings.groupBy("capture", "room").agg(F.sort_array(F.collect_list(F.struct("id", "kind", "width"))).alias("openings"))
    r = rooms.join(w, ["capture", "room"], "left").join(o, ["capture", "room"], "left")
    own = [c for c in rooms.columns if c not in ("capture", "room")]
    nested = r.groupBy("capture").agg(F.sort_array(F.collect_list(F.struct("room", "walls", "openings", *own))).alias("rooms"))
    return captures.join(nested, "capture", "left")


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.partitionBy("capture").mode("overwrite").json(path)


def json_schema(kind: T.DataType, title: str | None = None) -> dict:
    """A closed JSON Schema of a Spark type."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    else:
        out = {"type": _JSON[kind.simpleString()]}
    return ({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} if title else {}) | out


def markdown(rows: DataFrame, order: list[str]) -> str:
    """A table of all rows, which the driver takes a partition at a time."""
    found = rows.orderBy(*order).toLocalIterator()
    show = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in found]) + "\n"


def report(title: str, parts: dict[str, DataFrame]) -> str:
    """An HTML page of small tables; all text is escaped."""
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in parts.items():
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{html.escape(str(v))}</td>' for v in r)}</tr>" for r in df.toLocalIterator()]
        out.append("</table>")
    return "".join(out)


def svg(outlines: dict[str, list[tuple[float, float]]], names: dict[str, str] | None = None, scale: float = 50.0, margin: float = 20.0) -> str:
    """A floor plan: outlines in metres with a label and the length of each side."""
    xs, ys = [x for p in outlines.values() for x, _ in p] or [0.0], [y for p in outlines.values() for _, y in p] or [0.0]
    px = lambda x: (x - min(xs)) * scale + margin
    py = lambda y: (max(ys) - y) * scale + margin
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{px(max(xs)) + margin:.0f}" height="{py(min(ys)) + margin:.0f}">']
    for key in sorted(outlines):
        p = outlines[key]
        out.append('<polygon fill="none" stroke="black" points="' + " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in p) + '"/>')
        cx, cy = sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)
        out.append(f'<text x="{px(cx):.1f}" y="{py(cy):.1f}">{html.escape((names or {}).get(key, key))}</text>')
        for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]):
            out.append(f'<text x="{px((x0 + x1) / 2):.1f}" y="{py((y0 + y1) / 2):.1f}">{((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5:.2f}</text>')
    return "".join(out) + "</svg>"


def folded_calibration(document: str, factors: dict[tuple[str, str], float], source: str, date: str, depth_scale: float | None = None) -> str:
    """The next calibration document: multipliers times the fitted factors, and LiDAR depths by the fitted scale, if one was adopted. What was in
    force goes to the history, whole. With nothing fitted it's a copy that says so."""
    d = json.loads(document)
    past = d.pop("history", [])
    past.append({k: d.get(k) for k in ("version", "source", "tiers", "corrections")})
    d["tiers"] = json.loads(json.dumps(d["tiers"]))
    for (tier, kind), k in factors.items():
        held = d["tiers"].setdefault(tier, {})
        base = dict(held.get(kind, held.get("default", {"abs_mult": 1.0, "log_mult": 1.0, "abs_floor": 0.0, "log_floor": 0.0})))
        held[kind] = {n: v * k if n in ("abs_mult", "log_mult", "abs_floor", "log_floor") else v for n, v in base.items()}
    if depth_scale is not None:
        fixes = json.loads(json.dumps(d.get("corrections", {})))
        lidar = fixes.setdefault("lidar", {})
        lidar["depth_scale"] = lidar.get("depth_scale", 1.0) * depth_scale
        d["corrections"] = fixes
    d |= {"fitted": bool(factors) or depth_scale is not None, "source": source, "version": f"fit-{date}", "history": past}
    return json.dumps(d, indent=2)


def benchmark_report(title: str, gates: DataFrame, tables: dict[str, DataFrame], notes: list[str] | None = None) -> str:
    """A benchmark's report in Markdown: gates (name, tier, n, within, passed), then a table for each further part."""
    verdict = F.when(F.col("passed"), "PASS").when(~F.col("passed"), "FAIL").otherwise("n/a")
    shown = gates.select("name", "tier", F.format_string("%d of %d", F.coalesce("within", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0)).cast("long")).alias("within"), verdict.alias("result"))
    parts = [f"# {title}", "## Gates", markdown(shown, ["name", "tier"])]
    for name, df in tables.items():
        parts += [f"## {name}", markdown(df, df.columns[:1])]
    return "\n\n".join(parts + [f"- {n}" for n in notes or []]) + "\n"


def truth_document(site: str, rooms: DataFrame, walls: DataFrame, openings: DataFrame, adjacency: DataFrame) -> str:
    """A site's ground truth as YAML, in the form that `sources.captures.truth` reads. Sites are measured by hand, or room by room, and are small."""
    import yaml

    own = lambda df: [r.asDict() for r in df.where(F.col("site") == site).orderBy(*df.columns).toLocalIterator()]
    by_room: dict = {}
    for name, df in (("walls", walls), ("openings", openings)):
        for r in own(df):
            by_room.setdefault(r["room"], {}).setdefault(name, []).append({k: v for k, v in r.items() if k not in ("site", "room") and v is not None})
    listed = []
    for r in own(rooms):
        entry = {"name": r["room"]} | {k: v for k, v in r.items() if k not in ("site", "room") and v is not None}
        listed.append(entry | {"walls": [], "openings": []} | by_room.get(r["room"], {}))
    return yaml.safe_dump({"site": site, "rooms": listed, "adjacency": [[r["a"], r["b"]] for r in own(adjacency)]}, sort_keys=False, allow_unicode=True)


def manifest_document(captures: DataFrame) -> str:
    """A manifest as YAML, in the form that `sources.captures.manifest` reads."""
    import yaml

    rows = [{k: dict(v) if isinstance(v, dict) else v for k, v in r.asDict().items() if v not in (None, {})} for r in captures.orderBy("id").toLocalIterator()]
    return yaml.safe_dump({"captures": rows}, sort_keys=False, allow_unicode=True)


def head_to_head_files(rows: DataFrame, path: str) -> str:
    """Writes the dimensions as CSV with a header, and gives the result's summary in Markdown: how many are beaten or tied, of those that the app has."""
    rows.write.mode("overwrite").option("header", "true").csv(path)
    counts = {r[0]: r[1] for r in rows.groupBy("verdict").count().collect()}
    n = sum(v for k, v in counts.items() if k != "missing")
    good = counts.get("beat", 0) + counts.get("tie", 0)
    return f"# Head to head\n\nBeat or tie: {good} of {n}" + (f" ({100 * good / n:.0f} %)" if n else "") + "\n\n" + markdown(rows.groupBy("verdict").agg(F.count("*").alias("n")), ["verdict"])


def evidence_crops(pixels: DataFrame, regions: DataFrame, margin: int = 8) -> DataFrame:
    """(region, png): the grey pixels (surface, r, c, l) around each region (region, surface, r0, r1, c0, c1), with a margin, as a picture."""
    import numpy as np
    import pandas as pd

    from ..sources.binary import write_png

    wide = regions.select("region", "surface", *[(F.col(k) + d * margin).alias(k) for k, d in (("r0", -1), ("r1", 1), ("c0", -1), ("c1", 1))])
    inside = wide.join(pixels, "surface").where("r between r0 and r1 and c between c0 and c1").select("region", "r", "c", "l")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"] - pdf["r"].min(), pdf["c"] - pdf["c"].min()
        grid = np.zeros((r.max() + 1, c.max() + 1), np.uint8)
        grid[r, c] = pdf["l"].clip(0, 255).round().astype(np.uint8)
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "png": [write_png(grid)]})

    return inside.groupBy("region").applyInPandas(run, f"region {regions.schema['region'].dataType.simpleString()}, png binary")


def odometry_csv(poses: DataFrame, path: str) -> None:
    poses.select(*[F.format_string("%.8f", c).alias(c) if t == "double" else F.col(c) for c, t in poses.dtypes]).write.mode("overwrite").option("header", "true").csv(path)
