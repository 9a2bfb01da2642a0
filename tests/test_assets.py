"""Assets, detectors and templates."""

from __future__ import annotations

import json

import pytest

from playlake.folds.calibration import CalibrationConfig
from playlake.review import write_annotation_template, write_tables
from playlake.sources import assets, images


def test_assets_are_found_or_named(tmp_path, monkeypatch):
    (tmp_path / "a.png").write_text("x")
    assert assets.find_asset("a.png", "PLAYLAKE_TEST_ASSETS", tmp_path) == (tmp_path / "a.png").resolve()
    assert assets.find_asset("../a.png", "PLAYLAKE_TEST_ASSETS", tmp_path / "none") is None
    monkeypatch.setenv("PLAYLAKE_TEST_ASSETS", str(tmp_path / "other"))
    assert "other" in assets.skip_reason("a.png", "PLAYLAKE_TEST_ASSETS", tmp_path)
    with pytest.raises(FileNotFoundError, match="other"):
        assets.need_asset("a.png", "PLAYLAKE_TEST_ASSETS", tmp_path)


def test_detectors_run_by_name_only(spark, tmp_path):
    images.register_detector("by-length", lambda scale: lambda content, frame: [(len(content) * scale, 0.0, 50.0, 9.0, 0.9), (1.0, 0.0, 5.0, 9.0, 0.8), (0.0, 0.0, 1.0, 1.0, 0.1)])
    for frame, size in ((3, 10), (4, 20)):
        (tmp_path / f"frame_{frame}.png").write_bytes(b"x" * size)
    (tmp_path / "other.png").write_bytes(b"")
    table = images.read_images(spark, str(tmp_path)).selectExpr("0 as run_id", "frame_id", "content")
    found = images.detect(table, images.make_detector("by-length", scale=2.0), "by-length", 0.5).orderBy("frame_id", "box_id")
    assert [(r["frame_id"], r["box_id"], r["x1"]) for r in found.collect()] == [(3, 0, 1.0), (3, 1, 20.0), (4, 0, 1.0), (4, 1, 40.0)]
    assert images.given_boxes(table.where("frame_id = 3"), found).count() == 2
    for bad in (lambda: images.make_detector("none"), lambda: images.register_detector("by-length", None)):
        with pytest.raises(ValueError, match="detector"):
            bad()


def test_templates_and_reports_are_new_files(spark, tmp_path):
    write_annotation_template(tmp_path / "t.json", "a" * 64, "real", "dev", [5, 1, 5])
    assert [f["frame_id"] for f in json.loads((tmp_path / "t.json").read_text())["frames"]] == [1, 5]
    with pytest.raises(FileExistsError):
        write_annotation_template(tmp_path / "t.json", "a" * 64, "real", "dev", [1])
    with pytest.raises(ValueError, match="template"):
        write_annotation_template(tmp_path / "u.json", "a", "real", "dev", [1])
    write_tables(tmp_path / "r.md", "Scores", {"dev": spark.range(2)})
    assert "| id |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError, match="more than"):
        write_tables(tmp_path / "q.md", "Scores", {"dev": spark.range(3)}, 2)


def test_calibration_parameters_have_ranges():
    for bad in ({"decay": 1.2}, {"max_age": -1}, {"max_jump_yd": 0}):
        with pytest.raises(ValueError, match="calibration"):
            CalibrationConfig(**bad)
