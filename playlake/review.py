"""A folder with the review of a run: documents, tables, reports, a manifest of digests and a bundle of all.

These are small results of one run, written by the driver. The folder must not exist before, and a failure removes it.
"""

from __future__ import annotations

import csv
import hashlib
import html
import json
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.operators import events, play, segments

#: Columns of the metric table.
COLUMNS = ("run_id", "play_id", "metric", "value")


def guarded(value):
    """A text that a spreadsheet won't read as a formula; other values stay."""
    return "'" + value if isinstance(value, str) and value.lstrip().startswith(("=", "+", "-", "@")) else value


def _shown(value) -> str:
    return "Unavailable" if value is None else str(value)


def markdown_table(columns: tuple[str, ...], rows: list[dict]) -> str:
    """A Markdown table whose cells can't break it; missing values are named as such."""
    def cell(v) -> str:
        return html.escape(_shown(v)).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")

    lines = [columns, ["---"] * len(columns), *([cell(r[c]) for c in columns] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def html_table(columns: tuple[str, ...], rows: list[dict]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_shown(r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_json(path: Path, value) -> None:
    """A new JSON file without infinities; an existing one is never replaced."""
    with path.open("x") as f:
        json.dump(value, f, indent=2, allow_nan=False)


def write_csv(path: Path, columns: tuple[str, ...], rows: list[dict]) -> None:
    """A new table; missing values are blank."""
    with path.open("x", newline="") as f:
        writer = csv.DictWriter(f, columns)
        writer.writeheader()
        writer.writerows([{c: guarded(r[c]) for c in columns} for r in rows])


def digests(folder: Path) -> dict[str, str]:
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.iterdir())}


def bundle(folder: Path, name: str = "bundle.zip") -> None:
    """All files of a folder in one archive."""
    members = sorted(folder.iterdir())
    with zipfile.ZipFile(folder / name, "x", zipfile.ZIP_DEFLATED) as z:
        for p in members:
            z.write(p, p.name)


def write_review(spark: SparkSession, samples: DataFrame, labels: DataFrame, run_id, output: str, fps: float, automatic_end: bool = False) -> dict:
    """Segment a run's plays, measure them, and write what was found and refused; returns the document."""
    folder = Path(output)
    own, named = samples.where(F.col("run_id") == run_id), labels.where(F.col("run_id") == run_id)
    found = segments.segment_plays(own, named, automatic_end=automatic_end)

    def rows(df: DataFrame, *order: str) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]  # of one run's plays

    folder.mkdir()
    try:
        metrics = rows(play.play_metrics(own, found.select("run_id", "play_id", "start_frame", "snap_frame", "end_frame"), fps), "play_id", "metric")
        document = {
            "schema_version": 1, "run_id": str(run_id), "fps": fps, "segments": rows(found, "play_id"), "refusals": rows(segments.refusals(found), "play_id", "scope"),
            "events": rows(events.timeline(own, found), "play_id", "place"), "unavailable_events": list(events.UNAVAILABLE), "metrics": metrics, "diagnostics": rows(segments.review_diagnostics(own), "run_id"),
        }
        write_json(folder / "analysis.json", document)
        write_csv(folder / "metrics.csv", COLUMNS, metrics)
        told = json.dumps(document["refusals"], indent=2)
        (folder / "report.md").write_text(f"# Review of run {html.escape(str(run_id))}\n\n## Play metrics\n\n{markdown_table(COLUMNS, metrics)}\n\n## Refusals\n\n```json\n{told.replace('`', chr(92) + 'u0060')}\n```\n")
        (folder / "report.html").write_text(
            f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Review</title><h1>Review of run {html.escape(str(run_id))}</h1><h2>Play metrics</h2>{html_table(COLUMNS, metrics)}<h2>Refusals</h2><pre>{html.escape(told)}</pre></html>'
        )
        write_json(folder / "manifest.json", digests(folder))
        bundle(folder)
    except BaseException:
        shutil.rmtree(folder)
        raise
    return document


def write_annotation_template(path: Path, video_sha256: str, source_kind: str, split: str, frames: list[int]) -> None:
    """A new document to be filled in by hand: chosen frames without players, none of them exhaustive yet."""
    if len(video_sha256) != 64 or source_kind not in ("real", "synthetic") or split not in ("dev", "test") or not frames or min(frames) < 0:
        raise ValueError("template: a video digest, source_kind, split and frames from 0 are needed")
    head = {"schema_version": 1, "video_sha256": video_sha256, "source_kind": source_kind, "split": split, "annotation_method": "independent_manual"}
    write_json(path, {**head, "frames": [{"frame_id": f, "exhaustive": False, "players": []} for f in sorted(set(frames))]})


def write_tables(path: Path, title: str, sections: dict[str, DataFrame], most_rows: int = 1000) -> None:
    """A new Markdown report of small tables, such as scores per split; a longer one is refused, not cut."""
    parts = [f"# {html.escape(title)}"]
    for name, table in sections.items():
        rows = [r.asDict() for r in table.limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"report: {name} has more than {most_rows} rows")
        parts += [f"## {html.escape(name)}", markdown_table(tuple(table.columns), rows)]
    with path.open("x") as f:
        f.write("\n\n".join(parts) + "\n")
