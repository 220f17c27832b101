"""Sources on small written files."""

import json

from larkspur.sources import listens as L


def _line(user, ts, artist="A", title="T", mbid=None):
    return json.dumps({"user_name": user, "listened_at": ts, "track_metadata": {"artist_name": artist, "track_name": title, "additional_info": {"recording_mbid": mbid}}})


def test_strict_and_lenient_scans(spark, tmp_path):
    good = "0f0e0d0c-0b0a-0908-0706-050403020100"
    lines = [_line("u", 5), _line("u", 5, mbid=good.upper()), _line("u", 5, mbid="bad"), _line("", 5), _line("u", 0), "{broken", _line("v", 9, title="")]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    raw = L.scan(spark, str(tmp_path / "l.jsonl"))
    rows = L.strict(raw)
    assert L.counts(rows).first().asDict() == {"parsed": 7, "valid": 2, "rejected": 5}
    ids = sorted(r.identity for r in rows.where("valid").collect())
    assert ids[0].startswith("fallback:") and ids[1] == f"mbid:{good}"
    assert L.lenient(raw).count() == 6


def test_radio_and_library(spark):
    plays = spark.createDataFrame([(1, "trackplay", "A", "S", 3), (1, "airbreak", None, None, 4), (2, "trackplay", "", "S", 5)], "show long, play_type string, artist string, song string, airdate long")
    assert [r.user for r in L.radio_plays(plays).collect()] == ["show-1"]
    lib = spark.createDataFrame([("Song", "A;B"), ("Song", "A;C"), (None, "A")], "`Track Name` string, `Artist Name(s)` string")
    assert [(r.artist, r.title) for r in L.library(lib).collect()] == [("A", "Song")]
