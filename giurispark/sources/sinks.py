"""Writers for corpora, tasks, scores, summaries, reports and bundles."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a model call that shared scores leave out.
CALL_COLUMNS = (
    "model_call_provider", "model_call_latency_ms", "model_call_input_tokens", "model_call_output_tokens", "model_call_total_tokens",
    "model_call_cached_input_tokens", "model_call_reasoning_tokens", "model_call_estimated_cost_usd", "model_call_usage", "model_call_error",
)


def jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, a file for each task of the cluster."""
    df.write.mode("overwrite").json(path)


def tasks(df: DataFrame, path: str) -> None:
    """Tasks by area, without their source."""
    df.drop("source_ecli").withColumn("area", F.substring_index("task_id", "/", 1)).write.mode("overwrite").partitionBy("area").json(path)


def scores(df: DataFrame, path: str, with_calls: bool = True) -> None:
    (df if with_calls else df.drop(*CALL_COLUMNS)).write.mode("overwrite").json(path)


#: Rows of a report, at most; more is no aggregated table.
REPORT_ROWS = 200_000


def _bounded(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows: write the table instead")
    return rows


def _placed(text: str, path: str, encoding: str = "utf-8") -> None:
    """A file put in place whole."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    part = out.with_suffix(out.suffix + ".part")
    part.write_text(text, encoding=encoding, newline="")
    os.replace(part, out)


def report(df: DataFrame, path: str, order: list[str], bom: bool = False) -> None:
    """One CSV file of an aggregated table in a stated order, of at most REPORT_ROWS rows."""
    frame = pd.DataFrame([tuple(r) for r in _bounded(df.orderBy(*order))], columns=df.columns)
    _placed(frame.to_csv(index=False), path, "utf-8-sig" if bom else "utf-8")


def summary(row: DataFrame, path: str) -> dict:
    """A one-row table as a JSON file, put in place whole."""
    data = json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    _placed(json.dumps(data, ensure_ascii=False, indent=2), path)
    return data


def markdown(df: DataFrame, title: str) -> str:
    """An aggregated table as Markdown, of at most REPORT_ROWS rows."""
    rows = _bounded(df)
    line = lambda cells: "| " + " | ".join("n.d." if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]]) + "\n"


def markdown_file(df: DataFrame, title: str, path: str) -> None:
    _placed(markdown(df, title), path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in the place of those of equal key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def manifest(folder: str) -> dict[str, dict]:
    """Size and SHA-256 of every file below a folder."""
    out = {}
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file():
            digest = hashlib.sha256()
            with p.open("rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            out[p.relative_to(folder).as_posix()] = {"bytes": p.stat().st_size, "sha256": digest.hexdigest()}
    return out


def bundle(folder: str, path: str) -> dict[str, dict]:
    """A folder with its manifest as one zip file."""
    listed = manifest(folder)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in listed:
            z.write(Path(folder) / name, name)
        z.writestr("manifest.json", json.dumps(listed, indent=2))
    return listed


def run_folder(root: str, model: str, stamp: str, family: str = "standard") -> Path:
    """results/[bullshit/]<model>/<stamp>, made if absent."""
    safe = "".join(c if c.isalnum() or c in "._-" else "-" for c in model.replace("/", "-").replace(":", "-"))
    out = Path(root) / ("bullshit" if family == "bullshit" else "") / safe / stamp
    out.mkdir(parents=True, exist_ok=True)
    return out
