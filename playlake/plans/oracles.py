"""DuckDB SQL of the registered tracking queries."""

from __future__ import annotations

from playlake.domain import LABELS_SQL, PLAYS_SQL, SAMPLES_SQL

_ACCEPTED = "(position_source = 'measured_smoothed' AND is_measurement_used AND NOT is_outlier_rejected AND track_state = 'observed' AND x_yd IS NOT NULL)"
_PLACED = f"({_ACCEPTED} AND geometry_state <> 'unknown' AND x_coord_mode <> 'uncalibrated')"
_USABLE = f"({_PLACED} AND coordinate_frame_id IS NOT NULL)"
_BUCKET = f"""CASE WHEN is_outlier_rejected THEN 'rejected' WHEN position_source = 'predicted_dead_reckoning' THEN 'dead_reckoning'
    WHEN position_source = 'none' OR x_yd IS NULL THEN 'unprojected' WHEN track_state <> 'observed' THEN 'coasted' WHEN NOT {_ACCEPTED} THEN 'unprojected' ELSE 'usable' END"""
_S = f"WITH {SAMPLES_SQL}"
_SP = f"{_S}, {PLAYS_SQL}"
_OBS = f"{_S}, obs AS (SELECT run_id, track_id, frame_id, (track_state = 'observed')::INT AS observed, k / 100.0::DOUBLE AS confidence, x_yd, y_yd FROM samples)"

_LAST = "LEFT JOIN (SELECT run_id, max(frame_id) AS last_frame FROM samples GROUP BY 1) l USING (run_id)"
_WINDOWS = f"windows AS (SELECT p.run_id, play_id, start_frame, coalesce(end_frame, greatest(start_frame, last_frame)) AS end_frame FROM plays p {_LAST})"
_COUNTED = f"""counted AS (
    SELECT run_id, frame_id, count(*) FILTER (b = 'usable') AS n_usable, count(*) FILTER (b = 'usable' AND speed_yd_s >= 1.0) AS n_moving,
           CASE WHEN count(DISTINCT coordinate_frame_id) FILTER (b = 'usable') = 1 THEN max(coordinate_frame_id) FILTER (b = 'usable') END AS coordinate_frame_id,
           CASE WHEN count(DISTINCT coordinate_segment) FILTER (b = 'usable') = 1 THEN max(coordinate_segment) FILTER (b = 'usable') END AS coordinate_segment
    FROM (SELECT *, {_BUCKET} AS b FROM samples) GROUP BY 1, 2
)"""
_EVIDENCE = f"""{_SP}, {_WINDOWS}, {_COUNTED}, evidence AS (
    SELECT w.run_id, w.play_id, w.frame_id, coalesce(n_usable, 0) AS n_usable, coalesce(n_moving, 0) AS n_moving,
           CASE WHEN coalesce(n_usable, 0) >= 6 THEN n_moving::DOUBLE / n_usable END AS moving_fraction, coordinate_frame_id, coordinate_segment
    FROM (SELECT run_id, play_id, unnest(generate_series(start_frame, end_frame)) AS frame_id FROM windows WHERE end_frame >= start_frame) w
    LEFT JOIN counted USING (run_id, frame_id)
)"""


def _snaps(evidence: str) -> str:
    """The candidate loop in full, not the shortcut that the query uses, over the evidence of `windows`."""
    return f"""{evidence}, numbered AS (
    SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, play_id) AS n FROM evidence WINDOW w AS (PARTITION BY run_id, play_id ORDER BY frame_id)
), prefixed AS (
    SELECT *, count(moving_fraction) OVER b AS defined_before, max(moving_fraction) OVER b AS behind,
           CASE WHEN count(moving_fraction) OVER a = 3 THEN min(moving_fraction) OVER a END AS low
    FROM numbered
    WINDOW b AS (PARTITION BY run_id, play_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           a AS (PARTITION BY run_id, play_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), bases AS (
    SELECT run_id, play_id, n, min(i) FILTER (i >= 10 AND defined_before = i AND behind <= 0.15) AS base,
           bool_or(i >= 10 AND defined_before < i) AS gap, count(moving_fraction) AS n_defined,
           count(DISTINCT coalesce(coordinate_frame_id, '')) FILTER (moving_fraction IS NOT NULL) AS n_ids,
           min(coalesce(coordinate_frame_id, '')) FILTER (moving_fraction IS NOT NULL) AS least_id
    FROM prefixed GROUP BY ALL
), onsets AS (
    SELECT b.run_id, b.play_id, min(p.i) AS onset FROM bases b JOIN prefixed p ON p.run_id = b.run_id AND p.play_id = b.play_id AND p.i >= b.base AND p.low >= 0.45 GROUP BY ALL
), snaps AS (
    SELECT w.run_id, w.play_id, frame_id, low, behind, coalesce(n_defined, 0) AS n_defined, coalesce(n, 0) AS n, coalesce(n_tracks, 0) AS n_tracks,
           CASE WHEN n_tracks IS NULL THEN 'no_trajectories' WHEN coalesce(n, 0) < 13 THEN 'window_too_short' WHEN n_tracks < 6 THEN 'insufficient_tracks' WHEN n_defined = 0 THEN 'insufficient_measured_samples'
                WHEN n_ids > 1 OR least_id = '' THEN 'coordinate_frame_change' WHEN base IS NULL AND gap THEN 'baseline_evidence_gaps' WHEN base IS NULL THEN 'no_quiescent_baseline'
                WHEN onset IS NULL THEN 'no_sustained_onset' END AS reason
    FROM windows w LEFT JOIN bases USING (run_id, play_id) LEFT JOIN onsets USING (run_id, play_id)
    LEFT JOIN (SELECT v.run_id, play_id, count(DISTINCT track_id) AS n_tracks FROM windows v JOIN samples s ON s.run_id = v.run_id AND frame_id BETWEEN start_frame AND end_frame GROUP BY ALL) USING (run_id, play_id)
    LEFT JOIN (SELECT run_id, play_id, i AS onset, frame_id, low, behind FROM prefixed) USING (run_id, play_id, onset)
)"""


_SNAP_CONFIDENCE = "CASE WHEN reason IS NULL THEN round(least(0.99::DOUBLE, greatest(0.0::DOUBLE, (low - behind) / 0.5::DOUBLE * n_defined / n)), 4) ELSE 0.0 END"
_TIMED = f"""{_SP}, timed AS (SELECT *, CASE WHEN run_id % 3 <> 2 THEN 20 END AS snap FROM plays WHERE play_id = 'p1')"""


def _ends(head: str) -> str:
    """Cessation of motion in the plays of `timed` (run_id, play_id, start_frame, snap, end_frame), given `counted`."""
    return f"""{head}, frames AS (
    SELECT run_id, play_id, snap, frame_id - snap - 1 AS i, frame_id AS f, CASE WHEN n_usable >= 6 THEN n_moving::DOUBLE / n_usable END AS x, coalesce(coordinate_frame_id, '') AS cid
    FROM (SELECT run_id, play_id, snap, unnest(generate_series(snap + 1, coalesce(end_frame, greatest(snap + 1, last_frame)))) AS frame_id FROM timed {_LAST} WHERE snap IS NOT NULL) LEFT JOIN counted USING (run_id, frame_id)
), runs AS (
    SELECT *, CASE WHEN count(x) OVER a = 3 THEN min(x) OVER a END AS low, CASE WHEN count(x) OVER q = 6 THEN max(x) OVER q END AS high FROM frames
    WINDOW a AS (PARTITION BY run_id, play_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), q AS (PARTITION BY run_id, play_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
), acts AS (SELECT run_id, play_id, min(i) FILTER (low >= 0.45) AS a, count(*) AS n, count(x) AS d, count(DISTINCT cid) FILTER (x IS NOT NULL) AS ids, min(cid) FILTER (x IS NOT NULL) AS least_id FROM runs GROUP BY ALL
), quiets AS (SELECT run_id, play_id, min(i) AS q FROM runs JOIN acts USING (run_id, play_id) WHERE i >= greatest(5, a + 1) AND high <= 0.15 GROUP BY ALL
), ends AS (
    SELECT t.run_id, t.play_id, n, d, a, q, snap, (SELECT max(x) FROM runs r WHERE r.run_id = t.run_id AND r.play_id = t.play_id AND i >= a AND i < q) AS act,
           (SELECT max(high) FROM runs r WHERE r.run_id = t.run_id AND r.play_id = t.play_id AND i = q) AS rest,
           CASE WHEN snap IS NULL THEN 'snap_unavailable' WHEN n_tracks IS NULL THEN 'no_trajectories' WHEN coalesce(n, 0) < 12 THEN 'window_too_short' WHEN n_tracks < 6 THEN 'insufficient_tracks' WHEN d = 0 THEN 'insufficient_measured_samples'
                WHEN ids > 1 OR least_id = '' THEN 'coordinate_frame_change' WHEN a IS NULL THEN 'no_prior_sustained_motion' WHEN q IS NULL THEN 'no_motion_cessation' END AS reason
    FROM timed t LEFT JOIN acts USING (run_id, play_id) LEFT JOIN quiets USING (run_id, play_id)
    LEFT JOIN (SELECT v.run_id, play_id, count(DISTINCT track_id) AS n_tracks FROM timed v JOIN samples s ON s.run_id = v.run_id AND frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame) GROUP BY ALL) USING (run_id, play_id)
)"""


_END_CONFIDENCE = "CASE WHEN reason IS NULL THEN round(least(0.99::DOUBLE, greatest(0.0::DOUBLE, (act - rest) / 0.5::DOUBLE * d / n)), 4) ELSE 0.0 END"

_SEGMENTS = f"""{_ends(f"""{_snaps(f"""{_S}, {LABELS_SQL}, windows AS (
    SELECT p.run_id, play_id, start_frame, coalesce(end_frame, greatest(start_frame, last_frame)) AS end_frame FROM labels p {_LAST} WHERE snap_frame IS NULL
), {_COUNTED}, evidence AS (
    SELECT w.run_id, w.play_id, w.frame_id, CASE WHEN coalesce(n_usable, 0) >= 6 THEN n_moving::DOUBLE / n_usable END AS moving_fraction, coordinate_frame_id
    FROM (SELECT run_id, play_id, unnest(generate_series(start_frame, end_frame)) AS frame_id FROM windows WHERE end_frame >= start_frame) w LEFT JOIN counted USING (run_id, frame_id)
)""")}, resolved AS (
    SELECT l.run_id, l.play_id, start_frame, l.end_frame, l.snap_frame AS manual, coalesce(l.snap_frame, CASE WHEN reason IS NULL THEN s.frame_id END) AS snap, s.reason AS snap_reason, {_SNAP_CONFIDENCE} AS snap_confidence
    FROM labels l LEFT JOIN snaps s USING (run_id, play_id)
), timed AS (SELECT run_id, play_id, start_frame, snap, end_frame FROM resolved WHERE end_frame IS NULL)""")}, segments AS (
    SELECT r.run_id, r.play_id, start_frame, r.snap AS snap_frame, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN r.snap IS NOT NULL THEN 'collective_motion_onset' ELSE 'unavailable' END AS snap_source,
           CASE WHEN manual IS NOT NULL THEN 1.0 WHEN r.snap IS NOT NULL THEN snap_confidence ELSE 0.0 END AS snap_confidence, CASE WHEN r.snap IS NULL THEN snap_reason END AS snap_reason,
           coalesce(end_frame, CASE WHEN reason IS NULL THEN r.snap + 1 + q END) AS end_frame, CASE WHEN end_frame IS NOT NULL THEN 'manual' WHEN e.run_id IS NOT NULL AND reason IS NULL THEN 'motion_cessation' ELSE 'unavailable' END AS end_source,
           CASE WHEN end_frame IS NOT NULL THEN 1.0 ELSE {_END_CONFIDENCE} END AS end_confidence, CASE WHEN end_frame IS NULL THEN reason END AS end_reason
    FROM resolved r LEFT JOIN ends e USING (run_id, play_id)
)"""
_PROVENANCE = """touched AS (
    SELECT g.run_id, g.play_id, count(DISTINCT track_id) AS n_tracks,
           CASE WHEN count(DISTINCT x_coord_mode) FILTER (x_coord_mode <> 'uncalibrated') = 1 THEN max(x_coord_mode) FILTER (x_coord_mode <> 'uncalibrated') ELSE 'uncalibrated' END AS x_coord_mode,
           CASE WHEN count(DISTINCT coordinate_frame_id) = 1 THEN max(coordinate_frame_id) END AS coordinate_frame_id, array_to_string(list_sort(list(DISTINCT coordinate_segment)), ',') AS coordinate_segments
    FROM segments g JOIN samples s ON s.run_id = g.run_id AND frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame) GROUP BY ALL
)"""
_PHASED = """closed AS (SELECT run_id, play_id, start_frame, snap_frame, end_frame, coalesce(end_frame, greatest(start_frame, last_frame)) AS hi FROM segments LEFT JOIN (SELECT run_id, max(frame_id) AS last_frame FROM samples GROUP BY 1) USING (run_id)
), phased AS (
    SELECT run_id, play_id, f AS frame_id, CASE WHEN snap_frame IS NULL THEN 'snap_unknown' WHEN f < snap_frame THEN 'pre_snap' WHEN f = snap_frame THEN 'snap' WHEN f = end_frame THEN 'play_end' ELSE 'play' END AS phase
    FROM (SELECT *, unnest(generate_series(start_frame, hi)) AS f FROM closed)
)"""

_ISLANDS = f"""{_S}, u AS (
    SELECT *, coalesce(lag(frame_id) OVER w + 1 = frame_id AND lag(coordinate_frame_id) OVER w = coordinate_frame_id AND lag(coordinate_segment) OVER w = coordinate_segment AND lag(x_coord_mode) OVER w = x_coord_mode
                       AND lag(timestamp_s) OVER w < timestamp_s, false) AS joined,
           sqrt((x_yd - lag(x_yd) OVER w) * (x_yd - lag(x_yd) OVER w) + (y_yd - lag(y_yd) OVER w) * (y_yd - lag(y_yd) OVER w)) AS d
    FROM samples WHERE {_USABLE} WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame_id)
), islands AS (
    SELECT *, CASE WHEN joined THEN d END AS edge_yd, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, track_id ORDER BY frame_id) AS island FROM u
)"""

_FORMATION = f"""{_S}, forms AS (
    SELECT run_id, frame_id, count(*) FILTER ({_PLACED}) AS n, count(DISTINCT (coalesce(coordinate_frame_id, ''), x_coord_mode)) FILTER ({_PLACED}) AS refs, min(coalesce(coordinate_frame_id, '')) FILTER ({_PLACED}) AS cid,
           min(x_coord_mode) FILTER ({_PLACED}) AS mode, count(DISTINCT coordinate_segment) FILTER ({_PLACED}) AS segs, min(coordinate_segment) FILTER ({_PLACED}) AS seg, count(*) FILTER ({_PLACED} AND team <> 'UNKNOWN') AS n_assigned,
           coalesce(string_agg(track_id::VARCHAR, ',' ORDER BY track_id) FILTER (NOT {_PLACED}), '') AS excluded, coalesce(string_agg(track_id::VARCHAR, ',' ORDER BY track_id) FILTER ({_PLACED} AND team = 'UNKNOWN'), '') AS unassigned
    FROM samples GROUP BY ALL
), judged AS (
    SELECT *, CASE WHEN n = 0 THEN 'no_measured_positions' WHEN refs > 1 OR cid = '' THEN 'ambiguous_coordinate_frame' WHEN n_assigned = 0 THEN 'no_team_assignments' END AS reason FROM forms
), s AS (SELECT * FROM samples SEMI JOIN (SELECT * FROM judged WHERE reason IS NULL) USING (run_id, frame_id) WHERE {_PLACED} AND team <> 'UNKNOWN')"""
_NEAR = f"""{_FORMATION}, near AS (
    SELECT a.run_id, a.frame_id, a.team, a.track_id, round(min(CASE WHEN a.track_id <> b.track_id THEN sqrt((a.x_yd - b.x_yd) * (a.x_yd - b.x_yd) + (a.y_yd - b.y_yd) * (a.y_yd - b.y_yd)) END), 6) AS nearest
    FROM s a JOIN s b ON a.run_id = b.run_id AND a.frame_id = b.frame_id AND a.team = b.team GROUP BY ALL
)"""

SQL: dict[str, str] = {
    "motion_evidence": f"{_EVIDENCE} SELECT run_id, play_id, frame_id, n_usable, n_moving, round(moving_fraction, 6) AS moving_fraction, coordinate_frame_id, coordinate_segment FROM evidence",
    "exclusion_totals": f"""{_SP} SELECT p.run_id, play_id, count(DISTINCT track_id) AS n_tracks, count(*) AS n_samples, count(*) FILTER (b = 'usable') AS n_usable, count(*) FILTER (b = 'dead_reckoning') AS n_dead_reckoning,
        count(*) FILTER (b = 'rejected') AS n_rejected, count(*) FILTER (b = 'coasted') AS n_coasted, count(*) FILTER (b = 'unprojected') AS n_unprojected
        FROM (SELECT *, {_BUCKET} AS b FROM samples) s JOIN plays p ON p.run_id = s.run_id AND frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame) GROUP BY ALL""",
    "evidence_totals": f"""{_EVIDENCE}, c AS (SELECT run_id, play_id, coalesce(coordinate_frame_id, 'none') AS cid, min(frame_id) AS f FROM evidence WHERE moving_fraction IS NOT NULL GROUP BY ALL)
        SELECT run_id, play_id, count(*) AS n_frames, count(moving_fraction) AS n_defined, count(*) - count(moving_fraction) AS n_undefined, sum(n_usable)::BIGINT AS n_usable,
               coalesce(array_to_string(list_sort(list(DISTINCT coordinate_segment) FILTER (moving_fraction IS NOT NULL AND coordinate_segment IS NOT NULL)), ','), '') AS segments,
               coalesce((SELECT string_agg(cid, ',' ORDER BY f, cid) FROM c WHERE c.run_id = e.run_id AND c.play_id = e.play_id), '') AS coordinate_frames FROM evidence e GROUP BY ALL""",
    "evidence_buckets": f"{_S} SELECT run_id, {_BUCKET} AS bucket, count(*) AS n FROM samples GROUP BY ALL",
    "snap_onset": f"""{_snaps(_EVIDENCE)} SELECT run_id, play_id, CASE WHEN reason IS NULL THEN frame_id END AS snap_frame, CASE WHEN reason IS NULL THEN round(low, 6) END AS onset_fraction,
        CASE WHEN reason IS NULL THEN round(behind, 6) END AS baseline_fraction, {_SNAP_CONFIDENCE} AS confidence, reason, n_tracks, n - n_defined AS n_undefined FROM snaps""",
    "play_end": f"""{_ends(f"{_TIMED}, {_COUNTED}")}
        SELECT run_id, play_id, CASE WHEN reason IS NULL THEN snap + 1 + q END AS end_frame, CASE WHEN reason IS NULL THEN round(act, 6) END AS active_fraction,
               CASE WHEN reason IS NULL THEN round(rest, 6) END AS quiet_fraction, {_END_CONFIDENCE} AS confidence, reason FROM ends""",
    "play_segments": f"""{_SEGMENTS}, {_PROVENANCE} SELECT g.*, coalesce(n_tracks, 0) AS n_tracks, coalesce(x_coord_mode, 'uncalibrated') AS x_coord_mode, coordinate_frame_id, coalesce(coordinate_segments, '') AS coordinate_segments
        FROM segments g LEFT JOIN touched USING (run_id, play_id)""",
    "segment_refusals": f"""{_SEGMENTS} SELECT run_id, play_id, 'snap' AS scope, snap_reason AS reason FROM segments WHERE snap_frame IS NULL UNION ALL SELECT run_id, play_id, 'play_end', end_reason FROM segments WHERE end_frame IS NULL""",
    "segment_counters": f"""{_SEGMENTS} SELECT run_id, count(*) AS plays_segmented, count(*) FILTER (snap_source = 'manual') AS snaps_from_manual, count(*) FILTER (snap_source = 'collective_motion_onset') AS snaps_from_motion_onset,
        count(*) FILTER (snap_frame IS NULL) AS snaps_refused, count(*) FILTER (end_source = 'manual') AS play_ends_from_manual, count(*) FILTER (end_source = 'motion_cessation') AS play_ends_from_motion_cessation,
        count(*) FILTER (end_frame IS NULL) AS play_ends_refused, 0::BIGINT AS fabricated_snap_frames, 0::BIGINT AS fabricated_play_ends FROM segments GROUP BY ALL""",
    "segment_durations": f"""{_SEGMENTS} SELECT run_id, play_id, end_frame - start_frame + 1 AS n_frames, round(start_frame / 10.0::DOUBLE, 6) AS start_s, round(snap_frame / 10.0::DOUBLE, 6) AS snap_s, round(end_frame / 10.0::DOUBLE, 6) AS end_s FROM segments""",
    "segment_of_frames": f"""{_SEGMENTS}, {_PHASED} SELECT f.run_id, f.frame_id, play_id, coalesce(phase, 'outside_play') AS phase FROM (SELECT DISTINCT run_id, frame_id FROM samples) f LEFT JOIN phased USING (run_id, frame_id)""",
    "trajectory_counters": f"""{_S} SELECT run_id, track_id, count(*) AS n_samples, count(*) FILTER (position_source = 'measured_smoothed') AS n_measured, count(*) FILTER (position_source = 'predicted_dead_reckoning') AS n_predicted,
        count(*) FILTER (track_state = 'observed') AS n_observed, count(*) FILTER (track_state = 'coasted') AS n_coasted, count(*) FILTER (geometry_state = 'calibrated') AS n_calibrated,
        count(*) FILTER (geometry_state = 'propagated') AS n_propagated, count(*) FILTER (geometry_state = 'unknown') AS n_unknown FROM samples GROUP BY ALL""",
    "review_diagnostics": f"""{_S}, fr AS (SELECT run_id, frame_id, count(*) FILTER (track_state = 'observed') AS n, bool_or(geometry_state <> 'unknown') AS p FROM samples GROUP BY ALL)
        SELECT run_id, count(*) AS n_frames, max(n) AS max_observed, count(*) FILTER (p) AS projectable_frames, (SELECT count(DISTINCT track_id) FROM samples s WHERE s.run_id = fr.run_id AND track_state = 'observed') AS observed_tracks,
               (SELECT count(DISTINCT coordinate_frame_id) FROM samples s WHERE s.run_id = fr.run_id) AS coordinate_frames FROM fr GROUP BY run_id""",
    "play_metrics": f"""{_SP}, timed AS (SELECT *, CASE WHEN run_id % 3 <> 2 THEN start_frame + 15 END AS snap FROM plays), w AS (
            SELECT s.*, play_id, snap, end_frame, {_USABLE} AS ok FROM samples s JOIN timed USING (run_id) WHERE frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame)
        ), u AS (
            SELECT *, coalesce(lag(frame_id) OVER v + 1 = frame_id AND lag(coordinate_frame_id) OVER v = coordinate_frame_id AND lag(coordinate_segment) OVER v = coordinate_segment AND lag(x_coord_mode) OVER v = x_coord_mode, false) AS j,
                   sqrt((x_yd - lag(x_yd) OVER v) * (x_yd - lag(x_yd) OVER v) + (y_yd - lag(y_yd) OVER v) * (y_yd - lag(y_yd) OVER v)) AS d
            FROM w WHERE ok AND snap IS NOT NULL AND end_frame IS NOT NULL WINDOW v AS (PARTITION BY run_id, play_id, track_id ORDER BY frame_id)
        ), k AS (SELECT *, CASE WHEN j THEN d END AS e, sum((NOT j)::INT) OVER (PARTITION BY run_id, play_id, track_id ORDER BY frame_id) AS island FROM u
        ), pre AS (SELECT run_id, play_id, track_id, island, sum(e) AS d FROM k WHERE frame_id < snap GROUP BY ALL HAVING sum(e) IS NOT NULL
        ), sep AS (SELECT a.run_id, a.play_id, a.track_id, a.frame_id, round(min(sqrt((a.x_yd - b.x_yd) * (a.x_yd - b.x_yd) + (a.y_yd - b.y_yd) * (a.y_yd - b.y_yd))), 6) AS d
            FROM u a JOIN u b ON a.run_id = b.run_id AND a.play_id = b.play_id AND a.frame_id = b.frame_id AND a.coordinate_frame_id = b.coordinate_frame_id AND a.x_coord_mode = b.x_coord_mode AND a.team = 'TEAM_A' AND b.team = 'TEAM_B' GROUP BY ALL
        ), m1 AS (SELECT run_id, play_id, count(DISTINCT track_id) FILTER (track_state = 'observed') AS o, count(DISTINCT track_id) FILTER (ok) AS mt, count(*) FILTER (ok) AS ms, avg(ok::INT) AS c FROM w GROUP BY ALL
        ), m2 AS (SELECT run_id, play_id, sum(e) AS p FROM k GROUP BY ALL), m3 AS (SELECT run_id, play_id, count(DISTINCT track_id) FILTER (d >= 1.0) AS n FROM pre GROUP BY ALL), m4 AS (SELECT run_id, play_id, avg(d) AS a FROM sep GROUP BY ALL
        ), m AS (
            SELECT run_id, play_id, coalesce(o, 0)::DOUBLE AS observed_track_count, coalesce(mt, 0)::DOUBLE AS measured_track_count, coalesce(ms, 0)::DOUBLE AS measured_sample_count, c AS position_sample_coverage,
                   (end_frame - start_frame) / 10.0::DOUBLE AS play_duration_s, (end_frame - snap) / 10.0::DOUBLE AS post_snap_duration_s, p AS observed_path_length_sum_yd, n::DOUBLE AS presnap_motion_track_count,
                   a AS mean_observed_defender_separation_yd
            FROM timed LEFT JOIN m1 USING (run_id, play_id) LEFT JOIN m2 USING (run_id, play_id) LEFT JOIN m3 USING (run_id, play_id) LEFT JOIN m4 USING (run_id, play_id))
        SELECT run_id, play_id, metric, round(value, 4) AS value FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN (observed_track_count, measured_track_count, measured_sample_count,
            position_sample_coverage, play_duration_s, post_snap_duration_s, observed_path_length_sum_yd, presnap_motion_track_count, mean_observed_defender_separation_yd))""",
    "frame_phase_counts": f"""{_SEGMENTS}, {_PHASED} SELECT run_id, play_id, phase, count(p.phase) AS n_frames FROM (SELECT DISTINCT run_id, play_id FROM phased)
        CROSS JOIN (VALUES ('outside_play'), ('pre_snap'), ('snap'), ('play'), ('play_end'), ('snap_unknown')) n(phase) LEFT JOIN phased p USING (run_id, play_id, phase) GROUP BY ALL""",
    "play_records": f"""{_SEGMENTS}, {_PROVENANCE} SELECT run_id, play_id, start_frame, snap_frame, coalesce(end_frame, -1)::BIGINT AS end_frame, coalesce(x_coord_mode, 'uncalibrated') AS x_coord_mode,
        concat_ws('; ', 'snap refused: ' || snap_reason, 'play_end refused: ' || end_reason, CASE WHEN end_frame IS NULL THEN 'end_frame unresolved: exported as sentinel -1' END) AS notes,
        1 + (end_frame IS NOT NULL)::INT AS n_events FROM segments LEFT JOIN touched USING (run_id, play_id)""",
    "timeline": f"""{_SEGMENTS}, inside AS (SELECT s.*, play_id FROM samples s JOIN segments g ON g.run_id = s.run_id AND frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame)
        ), l AS (SELECT *, lag(struct_pack(f := frame_id, y := y_yd, v := cov_yy, ok := {_USABLE} AND coalesce(cov_xx >= 0 AND cov_yy >= 0 AND cov_xx * cov_yy >= cov_xy * cov_xy, false), c := coordinate_frame_id, s := coordinate_segment, m := x_coord_mode, t := timestamp_s)) OVER w AS b,
            {_USABLE} AND coalesce(cov_xx >= 0 AND cov_yy >= 0 AND cov_xx * cov_yy >= cov_xy * cov_xy, false) AS ok FROM inside WINDOW w AS (PARTITION BY run_id, play_id, track_id ORDER BY frame_id)
        ), ev AS (
            SELECT run_id, play_id, 'snap' AS kind, snap_frame AS frame_id, snap_source AS source, snap_confidence AS confidence, NULL::BIGINT AS track_id FROM segments WHERE snap_frame IS NOT NULL
            UNION ALL SELECT run_id, play_id, 'play_end', end_frame, end_source, end_confidence, NULL FROM segments WHERE end_frame IS NOT NULL
            UNION ALL SELECT run_id, play_id, 'sideline_exit_candidate', frame_id, 'observed_footpoint_geometry', NULL, track_id FROM l
            WHERE ok AND b.ok AND b.f + 1 = frame_id AND b.c = coordinate_frame_id AND b.s = coordinate_segment AND b.m = x_coord_mode AND b.t < timestamp_s
              AND b.y > 2 * sqrt(b.v) AND b.y + 2 * sqrt(b.v) < 160.0::DOUBLE / 3 AND (y_yd + 2 * sqrt(cov_yy) < 0 OR y_yd - 2 * sqrt(cov_yy) > 160.0::DOUBLE / 3))
        SELECT *, row_number() OVER (PARTITION BY run_id, play_id ORDER BY frame_id, kind, CASE WHEN coalesce(track_id, 0) = 0 THEN -1 ELSE track_id END, track_id NULLS FIRST)::INT AS place FROM ev""",
    "unavailable_kinds": f"""{_SEGMENTS} SELECT run_id, play_id, unnest(['pass', 'run', 'catch', 'incomplete', 'tackle']) AS kind, 'requires validated ball/possession evidence' AS reason FROM segments""",
    "label_violations": f"""{_S}, {LABELS_SQL}, broken AS (SELECT run_id, play_id || CASE run_id % 5 WHEN 4 THEN 'x' ELSE '' END AS play_id, start_frame - CASE WHEN run_id % 5 = 1 THEN 40 ELSE 0 END AS start_frame,
            snap_frame + CASE WHEN run_id % 5 = 2 THEN 90 ELSE 0 END AS snap_frame, end_frame - CASE WHEN run_id % 5 = 3 THEN 50 ELSE 0 END AS end_frame FROM labels
            UNION ALL SELECT run_id, 'p1', 5, NULL, 20 FROM labels WHERE run_id % 5 = 0 AND play_id = 'p1'),
        o AS (SELECT *, lag(end_frame) OVER w AS b, lead(start_frame) OVER w AS n FROM broken WINDOW w AS (PARTITION BY run_id ORDER BY start_frame, play_id)), v AS (
            SELECT run_id, play_id, CASE WHEN start_frame < 0 THEN 'negative_start' WHEN end_frame < start_frame THEN 'end_before_start' WHEN snap_frame < start_frame THEN 'snap_before_start' WHEN snap_frame > end_frame THEN 'snap_after_end' END AS violation FROM broken
            UNION ALL SELECT run_id, play_id, 'duplicate_play_id' FROM broken GROUP BY ALL HAVING count(*) > 1
            UNION ALL SELECT run_id, play_id, CASE WHEN b >= start_frame THEN 'overlap' WHEN end_frame IS NULL AND n IS NOT NULL THEN 'open_not_last' END FROM o)
        SELECT * FROM v WHERE violation IS NOT NULL""",
    "route_segments": f"""{_ISLANDS}, x AS (SELECT run_id, track_id, island, frame_id, sign(y_yd - 26) AS side, lag(sign(y_yd - 26)) OVER (PARTITION BY run_id, track_id, island ORDER BY frame_id) AS b FROM islands WHERE y_yd <> 26
        ), c AS (SELECT run_id, track_id, island, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS crossings FROM x WHERE side <> b GROUP BY ALL
        ), g AS (
            SELECT run_id, track_id, island, count(*) AS n_observations, count(edge_yd) AS n_edges, min(frame_id) AS first_frame, max(frame_id) AS last_frame,
                   arg_min(coordinate_frame_id, frame_id) AS coordinate_frame_id, arg_min(coordinate_segment, frame_id) AS coordinate_segment, arg_min(x_coord_mode, frame_id) AS x_coord_mode,
                   arg_max(timestamp_s, frame_id) - arg_min(timestamp_s, frame_id) AS duration, arg_max(x_yd, frame_id) - arg_min(x_yd, frame_id) AS dx,
                   arg_max(y_yd, frame_id) - arg_min(y_yd, frame_id) AS dy, coalesce(sum(edge_yd), 0) AS distance, max(-x_yd) + arg_min(x_yd, frame_id) AS depth,
                   count(edge_yd) FILTER (frame_id < 20) AS presnap_n_edges, coalesce(sum(edge_yd) FILTER (frame_id < 20), 0) AS presnap_distance
            FROM islands GROUP BY ALL)
        SELECT run_id, track_id, island::BIGINT AS island, n_observations, n_edges, first_frame, last_frame, coordinate_frame_id, coordinate_segment, x_coord_mode, round(duration, 6) + 0.0 AS duration, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy,
               round(-dx, 6) + 0.0 AS forward, round(distance, 6) + 0.0 AS distance, round(depth, 6) + 0.0 AS depth, presnap_n_edges, round(presnap_distance, 6) + 0.0 AS presnap_distance, coalesce(crossings, '') AS crossings,
               CASE WHEN n_observations < 2 THEN 'unknown' WHEN greatest(abs(dx), abs(dy)) < 1 THEN 'stationary' WHEN abs(dx) >= 2 * abs(dy) THEN 'longitudinal'
                    WHEN abs(dy) >= 2 * abs(dx) THEN 'lateral' ELSE 'mixed' END AS stem FROM g LEFT JOIN c USING (run_id, track_id, island)""",
    "route_status": f"""{_ISLANDS}, g AS (SELECT run_id, track_id, island, count(edge_yd) AS n FROM islands GROUP BY ALL) SELECT run_id, track_id, CASE WHEN max(n) > 0 THEN 'available' ELSE 'unavailable' END AS status,
        CASE WHEN max(n) = 0 THEN 'no_consecutive_measured_positions' END AS reason, count(*) AS n_islands FROM g GROUP BY ALL""",
    "line_crossings": f"""{_ISLANDS}, o AS (SELECT run_id, track_id, frame_id, sign(y_yd - 26) AS side, lag(sign(y_yd - 26)) OVER (PARTITION BY run_id, track_id, island ORDER BY frame_id) AS b,
        island FROM islands WHERE y_yd <> 26) SELECT run_id, track_id, island::BIGINT AS island, frame_id FROM o WHERE side <> b""",
    "presnap_motion": f"{_ISLANDS} SELECT run_id, track_id, count(*) AS n_edges, round(sum(edge_yd), 6) AS distance FROM islands WHERE frame_id < 20 AND edge_yd IS NOT NULL GROUP BY ALL",
    "nearest_defender": f"""{_S}, s AS (SELECT * FROM samples WHERE {_USABLE}), p AS (
            SELECT a.run_id, a.frame_id, a.track_id, b.track_id AS defender_id, sqrt((a.x_yd - b.x_yd) * (a.x_yd - b.x_yd) + (a.y_yd - b.y_yd) * (a.y_yd - b.y_yd)) AS d
            FROM (SELECT * FROM s WHERE team = 'TEAM_A') a LEFT JOIN (SELECT * FROM s WHERE team = 'TEAM_B') b USING (run_id, frame_id, coordinate_frame_id, x_coord_mode))
        SELECT run_id, frame_id, track_id, round(d, 6) AS separation, defender_id FROM p QUALIFY row_number() OVER (PARTITION BY run_id, frame_id, track_id ORDER BY d, defender_id) = 1""",
    "sideline_exits": f"""{_S}, q AS (SELECT *, {_USABLE} AND coalesce(cov_xx >= 0 AND cov_yy >= 0 AND cov_xx * cov_yy >= cov_xy * cov_xy, false) AS ok FROM samples), l AS (
            SELECT *, lag(frame_id) OVER w AS bf, lag(y_yd) OVER w AS y0, lag(cov_yy) OVER w AS v0, lag(ok) OVER w AS ok0, lag(coordinate_frame_id) OVER w AS c0,
                   lag(coordinate_segment) OVER w AS s0, lag(x_coord_mode) OVER w AS m0, lag(timestamp_s) OVER w AS t0 FROM q WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame_id))
        SELECT run_id, track_id, frame_id, CASE WHEN y_yd + 2 * sqrt(cov_yy) < 0 THEN 'low' ELSE 'high' END AS sideline FROM l
        WHERE ok AND ok0 AND bf + 1 = frame_id AND t0 < timestamp_s AND c0 = coordinate_frame_id AND s0 = coordinate_segment AND m0 = x_coord_mode
          AND y0 - 2 * sqrt(v0) > 0 AND y0 + 2 * sqrt(v0) < 160.0::DOUBLE / 3 AND (y_yd + 2 * sqrt(cov_yy) < 0 OR y_yd - 2 * sqrt(cov_yy) > 160.0::DOUBLE / 3)""",
    "formation_status": f"""{_FORMATION} SELECT run_id, frame_id, CASE WHEN reason IS NULL THEN 'available' ELSE 'unavailable' END AS status, reason,
        CASE WHEN n > 0 AND refs = 1 AND cid <> '' THEN cid END AS coordinate_frame_id, CASE WHEN n > 0 AND refs = 1 AND cid <> '' THEN mode END AS x_coord_mode,
        CASE WHEN n > 0 AND refs = 1 AND cid <> '' AND segs = 1 THEN seg END AS coordinate_segment, excluded, CASE WHEN n > 0 AND refs = 1 AND cid <> '' THEN unassigned ELSE '' END AS unassigned FROM judged""",
    "formation_shape": f"""{_NEAR} SELECT run_id, frame_id, team, count(*) AS n_players, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS track_ids, round(max(y_yd) - min(y_yd), 6) AS width,
        round(max(x_yd) - min(x_yd), 6) AS depth, round(avg(x_yd), 6) AS centre_x, round(avg(y_yd), 6) AS centre_y, round(avg(nearest), 4) AS mean_nearest
        FROM s JOIN near USING (run_id, frame_id, team, track_id) GROUP BY ALL""",
    "nearest_teammate": f"{_NEAR} SELECT * FROM near",
    "box_count": f"""{_FORMATION} SELECT run_id, frame_id, CASE WHEN count(*) FILTER (team = 'TEAM_B') > 0 THEN
        count(*) FILTER (team = 'TEAM_B' AND x_yd - 35 BETWEEN 0 AND 8 AND abs(y_yd - 26) <= 12) END AS box_count FROM s GROUP BY ALL""",
    "report_tracks": f"""{_OBS} SELECT run_id, track_id, min(frame_id) AS first_frame, max(frame_id) AS last_frame, sum(observed)::BIGINT AS n_observed, (count(*) - sum(observed))::BIGINT AS n_coasted,
        (max(frame_id) - min(frame_id) + 1 - sum(observed))::BIGINT AS n_unobserved, round(avg(confidence) FILTER (observed = 1), 6) AS mean_confidence FROM obs GROUP BY ALL""",
    "report_coverage": f"""{_OBS} SELECT count(*) AS n_rows, coalesce(sum(observed), 0)::BIGINT AS n_observed, count(*) FILTER (observed = 1 AND x_yd IS NOT NULL) AS n_positioned,
        round(count(*) FILTER (observed = 1 AND x_yd IS NOT NULL)::DOUBLE / nullif(sum(observed), 0), 6) AS coverage FROM obs""",
    "report_runs": f"""{_S}, runs AS (SELECT DISTINCT run_id, (run_id // 3)::VARCHAR AS video_sha256 FROM samples) SELECT r.run_id, r.video_sha256, (SELECT count(DISTINCT frame_id) FROM samples s WHERE s.run_id = r.run_id) AS frames_processed,
        (SELECT count(DISTINCT track_id) FROM samples s WHERE s.run_id = r.run_id) AS track_count FROM runs r WHERE r.video_sha256 = (SELECT video_sha256 FROM runs WHERE run_id = 0)""",
    "missing_frames": f"""{_OBS}, s AS (SELECT run_id, track_id, unnest(generate_series(min(frame_id), max(frame_id))) AS frame_id FROM obs GROUP BY run_id, track_id)
        SELECT run_id, track_id, frame_id FROM s ANTI JOIN (SELECT * FROM obs WHERE observed = 1) USING (run_id, track_id, frame_id)""",
    "label_overlap": f"""{_SP}, l AS (SELECT *, lag(end_frame) OVER w AS b, lead(start_frame) OVER w AS n FROM plays WINDOW w AS (PARTITION BY run_id ORDER BY start_frame, play_id)), v AS (
        SELECT run_id, play_id, CASE WHEN b >= start_frame THEN 'overlap' WHEN end_frame IS NULL AND n IS NOT NULL THEN 'open_not_last' END AS violation FROM l) SELECT * FROM v WHERE violation IS NOT NULL""",
    "window_semi": f"{_SP} SELECT run_id, play_id, count(DISTINCT track_id) AS n_tracks FROM samples JOIN plays USING (run_id) WHERE frame_id >= start_frame AND (end_frame IS NULL OR frame_id <= end_frame) GROUP BY ALL",
    "longest_observed_run": f"""{_OBS}, r AS (SELECT run_id, track_id, frame_id - row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame_id) AS g FROM obs WHERE observed = 1),
        n AS (SELECT run_id, track_id, g, count(*) AS n FROM r GROUP BY ALL) SELECT run_id, track_id, max(n) AS longest_run FROM n GROUP BY ALL""",
    "recovery_latency": f"""{_OBS}, l AS (SELECT run_id, track_id, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY run_id, track_id ORDER BY frame_id) - 1 AS latency FROM obs WHERE observed = 1)
        SELECT * FROM l WHERE latency > 0""",
    "csv_guard": """WITH c AS (SELECT n_nationkey, ['=', '+', '-', '@', ' =', 'x'][n_nationkey % 6 + 1] || n_name AS cell FROM nation)
        SELECT n_nationkey, CASE WHEN left(ltrim(cell), 1) IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM c""",
    "homography_project": f"""{_S}, j AS (
            SELECT run_id, track_id, frame_id, x_yd AS u, y_yd AS v, n_nationkey::DOUBLE AS a, 1 + 2.5::DOUBLE * (1 - least(greatest(k / 100.0::DOUBLE, 0.45::DOUBLE), 1.0::DOUBLE)) AS f
            FROM samples JOIN nation ON n_nationkey = run_id % 25 WHERE x_yd IS NOT NULL
        ), p AS (
            SELECT *, a / 10000 * u + a / 20000 * v + 1 AS w FROM j
        ), q AS (
            SELECT *, ((1 + a / 100) * u + a / 50 * v + a) / w AS fx, (a / 200 * u + (1 - a / 100) * v - a) / w AS fy FROM p
        ), d AS (
            SELECT *, (1 + a / 100 - fx * a / 10000) / w AS ja, (a / 50 - fx * a / 20000) / w AS jb, (a / 200 - fy * a / 10000) / w AS jc, (1 - a / 100 - fy * a / 20000) / w AS jd FROM q
        ), c AS (
            SELECT *, (ja * ja * 0.01 + 2 * ja * jb * 0.001 + jb * jb * 0.02) * f * f + 0.0025 AS xx, (ja * jc * 0.01 + (ja * jd + jb * jc) * 0.001 + jb * jd * 0.02) * f * f AS xy,
                   (jc * jc * 0.01 + 2 * jc * jd * 0.001 + jd * jd * 0.02) * f * f + 0.0025 AS yy FROM d
        )
        SELECT run_id, track_id, frame_id, round(fx, 6) AS fx, round(fy, 6) AS fy, round(xx, 10) AS cov_xx, round(xy, 10) AS cov_xy, round(yy, 10) AS cov_yy,
               round((yy * 0.01 + 2 * xy * 0.02 + xx * 0.04) / (xx * yy - xy * xy), 4) AS d2 FROM c""",
}
