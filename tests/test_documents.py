"""Readers of documents and the store, with what they must refuse."""

from __future__ import annotations

import copy
import io
import json
import zipfile

import pytest

from playlake.sources import documents
from playlake.storage.store import Store, canonical, open_store, run_id_of

PLAYER = {"track_id": 1, "bbox": [0, 0, 10, 20], "observed": True, "detection_confidence": 0.5, "field_position": [3.0, 4.0], "x_coord_mode": "absolute", "coordinate_frame_id": "c", "coordinate_segment": 0}
DOCUMENT = {
    "schema_version": 1, "video_sha256": "a" * 64, "fps": 30.0, "source_kind": "real",
    "frames": [{"frame_id": 0, "players": [PLAYER]}, {"frame_id": 1, "players": [{"track_id": 1, "bbox": [0, 0, 10, 20], "observed": False}]}, {"frame_id": 2, "players": []}],
    "plays": [{"play_id": "p", "segment": {"start_frame": 0, "snap_frame": 1, "end_frame": 2}}],
}


def _texts(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "text string")


def test_import_is_idempotent_and_reports_follow(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    other = {**DOCUMENT, "package_version": "2"}
    got = {r["run_id"]: r["inserted"] for r in store.import_documents(_texts(spark, DOCUMENT, other, DOCUMENT)).collect()}
    assert got == {run_id_of(DOCUMENT): True, run_id_of(other): True}
    again = store.import_documents(_texts(spark, dict(reversed(DOCUMENT.items())))).collect()
    assert [(r["run_id"], r["inserted"]) for r in again] == [(run_id_of(DOCUMENT), False)]
    assert (store.runs().count(), store.videos().count(), store.table("frames").count(), store.table("observations").count(), store.table("tracks").count()) == (2, 1, 6, 4, 2)
    reader = open_store(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in reader.report(run_id_of(DOCUMENT), "coverage").collect()] == [(2, 1, 1, 1.0)]
    runs = reader.report(run_id_of(DOCUMENT), "runs").collect()
    assert [(r["run_id"], r["frames_processed"], r["track_count"]) for r in runs] == sorted((run_id_of(d), 3, 1) for d in (DOCUMENT, other))
    track = reader.report(run_id_of(DOCUMENT), "tracks").collect()[0]
    assert (track["n_observed"], track["n_coasted"], track["mean_confidence"]) == (1, 1, 0.5)
    assert json.loads(reader.runs().first()["analysis_json"])["schema_version"] == 1
    with pytest.raises(ValueError, match="unknown run_id"):
        reader.report("x", "tracks")
    with pytest.raises(ValueError, match="unknown report"):
        reader.report(run_id_of(DOCUMENT), "others")


def _changed(change):
    d = copy.deepcopy(DOCUMENT)
    change(d)
    return d


BROKEN = [
    lambda d: d["frames"].append({"frame_id": 0, "players": []}),
    lambda d: d["frames"][0]["players"].append(PLAYER),
    lambda d: d["frames"][1]["players"][0].update(field_position=[1, 2], x_coord_mode="absolute", coordinate_frame_id="c"),
    lambda d: d["frames"][0]["players"][0].update(bbox=[0, 0, -1, 5]),
    lambda d: d["frames"][1]["players"][0].pop("observed"),
    lambda d: d["plays"][0]["segment"].update(end_frame=9),
    lambda d: d["plays"][0]["segment"].update(snap_frame=2, end_frame=1),
    lambda d: d.update(fps=True),
    lambda d: d.update(schema_version=True),
    lambda d: d.update(video_sha256="A" * 64),
    lambda d: d.update(frames=[]),
]


def test_a_broken_document_leaves_no_trace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="import"):
        store.import_documents(_texts(spark, DOCUMENT, _changed(BROKEN[0])))
    assert store.runs().count() == store.table("frames").count() == 0
    from playlake.storage.store import rows_of

    for change in BROKEN:
        with pytest.raises((ValueError, KeyError)):
            rows_of(_changed(change))
    assert canonical({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


def test_stores_of_others_are_refused_and_old_ones_rewritten(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f").write_text("")
    with pytest.raises(ValueError, match="unrelated"):
        Store(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="store"):
        open_store(spark, str(tmp_path / "none"))
    store = Store(spark, str(tmp_path / "s"))
    store.import_documents(_texts(spark, DOCUMENT))
    old = store.table("observations").drop("coordinate_segment").collect()
    schema = store.table("observations").drop("coordinate_segment").schema
    spark.createDataFrame(old, schema).write.mode("overwrite").partitionBy("run_id").parquet(f"{store.path}/observations")
    store._set_meta(1)
    migrated = Store(spark, store.path)
    assert migrated._meta()[1] == 2 and migrated.table("observations").count() == 2
    assert {r["coordinate_segment"] for r in migrated.table("observations").collect()} == {None}
    store._set_meta(7)
    with pytest.raises(ValueError, match="version"):
        Store(spark, store.path)


def _write(path, document):
    path.write_text(json.dumps(document))
    return str(path)


TRUTH = {**{k: v for k, v in DOCUMENT.items() if k != "plays"}, "split": "dev", "annotation_method": "independent_manual", "frames": [{**f, "exhaustive": True} for f in DOCUMENT["frames"]]}


def test_scored_documents_keep_empty_frames_and_refuse(spark, tmp_path):
    frames, players = documents.read_scored(spark, _write(tmp_path / "a.json", TRUTH), True)
    assert frames.count() == 3 and players.count() == 2
    for i, change in enumerate(
        (
            lambda d: d["frames"][0].update(exhaustive=False),
            lambda d: d.update(annotation_method="predicted"),
            lambda d: d["frames"][0]["players"][0].update(coordinate_frame_id=None),
            lambda d: d["frames"][0]["players"].append(PLAYER),
            lambda d: d["frames"][0]["players"][0].update(bbox=[0, 0, 0, 1]),
            lambda d: d["frames"][1].update(frame_id=0),
        )
    ):
        d = copy.deepcopy(TRUTH)
        change(d)
        with pytest.raises(ValueError, match="analysis documents"):
            documents.read_scored(spark, _write(tmp_path / f"bad{i}.json", d), True)
    assert documents.read_rendered(spark, str(tmp_path / "a.json"), "a" * 64).count() == 2
    with pytest.raises(ValueError, match="another video"):
        documents.read_rendered(spark, str(tmp_path / "a.json"), "b" * 64)


def test_manifests_and_sensor_tracks(spark, tmp_path):
    m = {"schema_version": 1, "source_kind": "real", "split": "dev", "videos": [{"path": "a/x.mp4"}, {"path": "y.mp4"}]}
    assert {r["name"] for r in documents.read_manifest(spark, _write(tmp_path / "m.json", m)).collect()} == {"x.mp4", "y.mp4"}
    for bad in ({"split": "train"}, {"videos": []}, {"videos": [{"path": "a/x"}, {"path": "b/x"}]}, {"videos": [{"path": " "}]}):
        with pytest.raises(ValueError):
            documents.read_manifest(spark, _write(tmp_path / "bad.json", {**m, **bad}))
    seq = {"sequences": [{"sequence_id": "s", "fps": 30.0}]}
    assert documents.read_benchmark_manifest(spark, _write(tmp_path / "b.json", seq), "sequence_id: STRING, fps: DOUBLE", "sequences").count() == 1
    head = "gameKey,playID,player,time,x,y,event\n"
    plays = spark.createDataFrame([(1, 7)], "game_key int, play_id int")
    (tmp_path / "s.csv").write_text(head + "1,0007,A,2020-01-01T00:00:00.1Z,1,2,\n1,8,,bad,x,y,\n")
    assert [(r["play_id"], r["player"], r["x"]) for r in documents.read_sensor_tracks(spark, str(tmp_path / "s.csv"), plays).collect()] == [(7, "A", 1.0)]
    row = "1,7,A,2020-01-01T00:00:00Z,1,2,\n"
    for bad in ("1,7,A,2020-01-01T00:00:00,1,2,\n", "1,7, ,2020-01-01T00:00:00Z,1,2,\n", "1,7,A,2020-01-01T00:00:00Z,NaN,2,\n", row + row, "1,9,A,2020-01-01T00:00:00Z,1,2,\n"):
        (tmp_path / "t.csv").write_text(head + bad)
        with pytest.raises(ValueError):
            documents.read_sensor_tracks(spark, str(tmp_path / "t.csv"), plays)


XML = '<annotations><version>1.1</version><image id="0" name="a.png" width="50" height="40"><box label="player" source="manual" xtl="1" ytl="2" xbr="11" ybr="22"/></image><image id="1" name="b.png" width="50" height="40"/></annotations>'


def _archive(path, xml, name="annotations.xml"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(name, xml)
    path.write_bytes(data.getvalue())
    return str(path)


def test_image_annotations(spark, tmp_path):
    got = documents.read_annotations(spark, _archive(tmp_path / "a.zip", XML)).orderBy("image").collect()
    assert [(r["image"], r["box_id"], r["x2"]) for r in got] == [("a.png", 0, 11.0), ("b.png", None, None)]
    for old, new in (('xbr="11"', 'xbr="99"'), ("manual", "auto"), ('name="b.png"', 'name="a.png"'), ("<version>1.1", "<version>1.0"), ("a.png", "../a.png"), ("<annotations>", "<!DOCTYPE x><annotations>"), ("</image>", "")):
        with zipfile.ZipFile(_archive(tmp_path / "b.zip", XML.replace(old, new, 1))) as z, pytest.raises(ValueError, match="annotations"):
            documents._annotations(open(z.filename, "rb").read())
