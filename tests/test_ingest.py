from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from furlong.sources import files as fs
from furlong.sources.fixed_width import (file_lines, first_errors, ingest, list_files, load_log, parse_lines, read_text_auto,
                                         scan_lines, split_required)
from furlong.sources.layouts import LAYOUTS
from furlong.sources.odds import explode_odds, to_odds_table
from furlong.sources.schemas import TABLE_SPECS, TABLES, struct_from_spec, table_schema

TS = datetime(2026, 1, 4, 12)
PROGRAMME = "06261101202601041005120021112A30223" + " " * 59 + "16 1　　　　        "


def parse(spark, line, kind, **extra):
    df = spark.createDataFrame([(line,)], "line string").withColumns({k: F.lit(v) for k, v in extra.items()})
    return parse_lines(df, kind, TS).first()


def place(length, cells):
    text = [" "] * 1000
    for at, value in cells.items():
        text[at:at + len(value)] = list(value)
    return "".join(text)[:length]


def test_programme_line(spark):
    assert len(PROGRAMME) == 110
    row = parse(spark, PROGRAMME, "BAA")
    assert row.reject_reason is None
    assert (row.race_id, row.race_date, row.venue_code, row.venue_name) == ("06261101", date(2026, 1, 4), "06", "中山")
    assert (row.race_number, row.distance, row.course_type, row.direction) == (1, 1200, "dirt", "right")
    assert (row.race_class, row.num_horses, row.age_condition) == ("A3", 16, "12")
    assert row.weather is None and row.prize_1st is None and row.created_at == TS


@pytest.mark.parametrize("line, reason", [
    (PROGRAMME[:89], "line too short"), ("0626110a" + PROGRAMME[8:], "bad race key"),
    (" 6261101" + PROGRAMME[8:], "bad race key"), (PROGRAMME[:8] + "20260230" + PROGRAMME[16:], "missing race_date")])
def test_programme_rejects(spark, line, reason):
    assert parse(spark, line, "BAA").reject_reason == reason


def test_guard_needs_a_character_beyond_the_field(spark):
    cells = {0: "06261101", 8: "07", 10: "23107385", 251: "4"}
    assert parse(spark, place(252, cells), "KYF").bracket_number is None
    assert parse(spark, place(253, cells), "KYF").bracket_number == 4


def test_entry_constant_nulls_and_overlaps(spark):
    row = parse(spark, place(400, {0: "06261101", 8: "07", 10: "23107385", 86: "8.613", 363: "2", 18: "馬　名"}), "KYF")
    assert row.base_place_odds == 8.613 and row.base_place_popularity == 13
    assert row.development_code == "2" and row.sex_code == 2 and row.horse_name == "馬名"
    names = table_schema("horse_results").names
    covered = {f.name for f in LAYOUTS["KYF"].fields} | {"created_at", "updated_at"}
    assert len(names) == 120 and all(row[n] is None for n in names if n not in covered)


def test_result_tail_depends_on_length(spark):
    cells = {0: "06261101", 8: "07", 10: "23107385", 51: "10", 61: "5", 96: "1345", 190: "000", 219: "  12.5",
             261: "480", 264: "+10", 267: "1"}
    full = parse(spark, place(270, cells), "SEC")
    assert (full.finish_time, full.winner_time_diff, full.grade, full.track_condition) == (134.5, None, "Listed", "良")
    assert (full.horse_weight, full.horse_weight_diff, full.weather_code, full.odds_10am_win) == (480, 10, 1, 12.5)
    cut = parse(spark, place(269, cells), "SEC")
    assert cut.horse_weight is None and cut.odds_10am_win == 12.5
    assert parse(spark, place(259, cells), "SEC").odds_10am_win is None
    assert parse(spark, place(200, cells | {51: "1 "}), "SEC").track_condition is None


def test_condition_record(spark):
    line = place(306, {0: "06261101", 8: "07", 10: "  1  2  3 40", 274: "  9  8  7  6", 286: " 35"})
    row = parse(spark, line, "KKA", file_date=date(2026, 1, 4))
    assert (row.jra_win, row.jra_place, row.jra_show, row.jra_out) == (1, 2, 3, 40)
    assert (row.trainer_owner_win, row.trainer_owner_out, row.sire_turf_place_rate) == (9, 6, 35)
    assert row.race_date == date(2026, 1, 4)
    short = parse(spark, line[:285], "KKA")
    assert short.trainer_owner_win is None and short.jra_win == 1
    assert parse(spark, "06x61101" + line[8:], "KKA").reject_reason == "bad race key"


def test_meeting(spark):
    row = parse(spark, place(46, {0: "06261a20260104", 14: "1", 16: "　　", 45: "3"}), "KAA")
    assert (row.venue_id, row.venue_name, row.kai, row.day, row.year) == ("06261a", "中山", 1, "a", 2026)
    assert row.data_category == 3
    assert parse(spark, place(46, {0: "0626 a20260104"}), "KAA").reject_reason == "missing venue_id"
    assert parse(spark, place(45, {0: "99261a20260104"}), "KAA").venue_name == ""


def test_horse(spark):
    row = parse(spark, place(169, {0: "23107385", 8: "名　馬", 26: "3", 85: "20230401", 160: "1101"}), "UKC")
    assert (row.horse_name, row.sex, row.sex_code, row.birth_date) == ("名馬", "セン", 3, date(2023, 4, 1))
    assert row.sire_line_code == "1101" and row.breeder_name is None


def test_odds_record(spark):
    cells = {0: "06261101", 8: "18", 10: "  1.5", 95: " 99.9", 100: "  1.1", 190: " 10.0", 950: "123.4"}
    lines = spark.createDataFrame([(place(955, cells),), (place(954, cells),)], "line string")
    got = {(r.odds_type, r.first_number, r.second_number): r.odds_value for r in explode_odds(lines).collect()}
    assert got == {("win", 1, None): 1.5, ("win", 18, None): 99.9, ("place", 1, None): 1.1,
                   ("quinella", 1, 2): 10.0, ("quinella", 17, 18): 123.4}
    entries = spark.createDataFrame([("06261101", 18, "23107385")], "race_id string, horse_number long, horse_id string")
    rows = to_odds_table(explode_odds(lines), entries, TS, TS).collect()
    assert [(r.horse_id, r.odds_type, r.odds_value) for r in rows] == [("23107385", "win", 99.9)]


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    (folder / "Baa").mkdir()
    bad = "0626110X" + PROGRAMME[8:]
    (folder / "Baa" / "BAA260104.csv").write_bytes(
        "\r\n".join([PROGRAMME, "", bad, PROGRAMME.replace("06261101", "06261102")]).encode("utf-8"))
    (folder / "Baa" / "bab260105.CSV").write_bytes(PROGRAMME.replace("06261101", "06261103").encode("cp932"))
    (folder / "Baa" / "BAC260106.csv").write_bytes(PROGRAMME.replace("06261101", "06261104").encode("utf-8") + b"\xff")
    (folder / "BAA260107.csv").write_bytes(b"short\n\n")
    (folder / "invalid.csv").write_bytes(b"x")
    (folder / "ZZ260104.csv").write_bytes(b"x")
    (folder / "notes.txt").write_bytes(b"x")
    return str(folder)


def test_encodings_and_log(spark, landing):
    files = read_text_auto(spark, landing)
    names = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert "notes.txt" not in names and len(names) == 6
    assert names["bab260105.CSV"].data_type == "BAB" and "　" in names["bab260105.CSV"].text
    assert not names["bab260105.CSV"].lossy and names["BAC260106.csv"].lossy
    lines = file_lines(files)
    log = {r.path.rsplit("/", 1)[1]: r for r in load_log(files, parse_lines(lines, "BAA")).collect()}
    assert (log["BAA260104.csv"].status, log["BAA260104.csv"].records, log["BAA260104.csv"].rejected) == ("success", 2, 1)
    assert log["BAA260107.csv"].error == "No data parsed"
    assert log["invalid.csv"].error == "Invalid filename format"
    assert log["ZZ260104.csv"].error == "Unsupported data type: ZZ"


def test_ingest_one_type(spark, landing):
    ok, rejects = ingest(spark, landing, "BAA", TS)
    assert sorted(r.race_id for r in ok.collect()) == ["06261101", "06261102"]
    assert ok.columns == table_schema("race_info").names
    got = first_errors(rejects).collect()
    assert [(r.line_no, r.reject_reason) for r in got] == [(1, "line too short"), (3, "bad race key")]


def test_text_reader_keeps_the_carriage_return(spark, landing):
    lines = scan_lines(spark, landing + "/Baa/BAA260104.csv").collect()
    assert len(lines) == 3 and sum(r.line.endswith("\r") for r in lines) == 2
    assert {r.data_type for r in lines} == {"BAA"}


def test_strict_mode_refuses_the_whole_file(spark):
    missing = PROGRAMME[:8] + " " * 8 + PROGRAMME[16:]
    df = spark.createDataFrame([("a", PROGRAMME), ("a", missing), ("b", PROGRAMME)], "path string, line string")
    parsed = parse_lines(df, "BAA", TS)
    assert split_required(parsed)[0].count() == 2
    assert [r.path for r in split_required(parsed, strict=True)[0].collect()] == ["b"]


@pytest.mark.parametrize("path, want", [
    ("BAA260104.csv", "BAA"), ("KYF260104.csv", "KYF"), ("Baa/BAA260104.csv", "BAA"), ("Kyf/kyf260110.csv", "KYF"),
    ("subfolder/nested/BAC260112.csv", "BAC"), ("invalid.csv", None), ("BAA26010.csv", None), ("BAAX260104.csv", None)])
def test_data_type(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(fs.data_type(F.col("p"))).first()[0] == want


def test_routes():
    assert fs.ROUTES["BAB"] == "race_info" and fs.ROUTES["KYH"] == "horse_results"
    assert fs.ROUTES["SEC"] == "race_results" and "INVALID" not in fs.ROUTES


def test_files_since(spark):
    names = [(f"KAA{s}.lzh",) for s in ("260104", "260104", "251231", "981225", "891225")]
    got = fs.file_dates_since(spark.createDataFrame(names, "path string"), "260101").collect()
    assert [r.stamp for r in got] == ["260104", "891225"]


def test_manifest(spark, tmp_path):
    (tmp_path / "Baa").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, text in (("Baa/file1.csv", "one"), ("Baa/file2.txt", "two"), ("Baa/file3.json", "x"), (".hidden/f.csv", "x")):
        (tmp_path / name).write_text(text)
    now = fs.file_digests(spark, str(tmp_path)).cache()
    assert {r.path: r.md5 for r in now.collect()}["Baa/file1.csv"] == "f97c5d29941bfb1b2fdab0874906ab82"
    assert now.count() == 2
    before = now.where("path = 'Baa/file1.csv'").select("path", "md5")
    totals = {r.data_type: r for r in fs.manifest_summary(fs.manifest_diff(now, before)).collect()}
    assert (totals["total"].total_files, totals["total"].loaded_files, totals["total"].skipped_files) == (2, 1, 1)
    assert totals["Baa"].loaded_bytes == 3
    forced = fs.manifest_summary(fs.manifest_diff(now, before, force=True)).where("data_type = 'total'").first()
    assert (forced.loaded_files, forced.skipped_files) == (2, 0)


def test_schemas():
    sizes = {"race_info": 20, "horse_results": 120, "race_results": 67, "horse_master": 23, "horse_extended": 103,
             "venue_info": 28, "pedigree": 16, "odds": 7, "training_data": 41}
    assert {n: len(table_schema(n)) for n in TABLE_SPECS} == sizes
    for name, table in TABLES.items():
        assert set(table.key) <= set(table_schema(name).names)
    schema = struct_from_spec('[{"name": "a", "type": "INT64", "mode": "REQUIRED", "description": "x"},'
                              ' {"name": "b", "type": "BOOL"}]')
    assert schema.simpleString() == "struct<a:bigint,b:boolean>"
    assert not schema["a"].nullable and schema["b"].nullable and schema["a"].metadata["comment"] == "x"


def test_large_files_are_numbered_and_decoded_block_by_block(spark, tmp_path):
    import os

    rows = [f"{i:08d}馬名{i}" if i % 3 else "" for i in range(3000)]
    for name, charset in (("BAA260101.csv", "utf-8"), ("BAA260102.csv", "cp932")):
        with open(os.path.join(tmp_path, name), "wb") as file:
            file.write("\n".join(rows).encode(charset))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = scan_lines(spark, str(tmp_path))
        got = sorted((os.path.basename(r.path), r.line_no, r.line) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, i + 1, row) for name in ("BAA260101.csv", "BAA260102.csv") for i, row in enumerate(rows) if row)


def small_blocks(spark, size=4096):
    """Files are cut into blocks of so many bytes inside the ``with``."""
    from contextlib import contextmanager

    @contextmanager
    def setting():
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            yield
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    return setting()


def test_reading_in_blocks_and_whole_agree(spark, landing):
    for kind in ("BAA", "KYF"):
        lines = file_lines(read_text_auto(spark, landing).where(F.col("data_type") == kind))
        whole = split_required(parse_lines(lines, kind, TS))
        with small_blocks(spark, 64):
            ok, rejects = ingest(spark, landing, kind, TS)
            got = sorted(map(str, ok.collect())), sorted(map(str, rejects.collect()))
        assert got[0] == sorted(map(str, whole[0].select(*ok.columns).collect()))
        assert got[1] == sorted(map(str, whole[1].select(*rejects.columns).collect()))


def test_names_with_blanks_and_signs_are_found_again(spark, tmp_path):
    folder = tmp_path / "a b+c%20ü"
    folder.mkdir()
    (folder / "BAA260104.csv").write_text(PROGRAMME + "\n" + PROGRAMME[:50])
    listed = list_files(spark, str(tmp_path)).select("path").collect()
    assert [r.path for r in scan_lines(spark, str(tmp_path)).select("path").distinct().collect()] == [r.path for r in listed]


@pytest.mark.parametrize("stream", [False, True])
def test_files_of_many_blocks_are_loaded_with_numbers_and_log(spark, tmp_path, stream):
    """Both charsets, far more blocks than files, a blank file, a wrong name: through the loader and through the stream."""
    import os

    from furlong.sources.tables import read_table
    from furlong.streaming.ingest import ingest_files, ingest_stream

    landing = tmp_path / "in"
    landing.mkdir()
    keys = [f"06{y:02d}11{r:02d}" for y in range(26) for r in range(1, 13)]
    for day, charset in ((1, "utf-8"), (2, "cp932")):
        lines = [k[:5] + f"{day}" + k[6:] + PROGRAMME[8:] + "レース" for k in keys]
        lines[7], lines[-3] = "short", ""
        (landing / f"BAA26010{day}.csv").write_bytes("\r\n".join(lines).encode(charset))
    (landing / "BAA260103.csv").write_bytes(b"\n \n")
    (landing / "other.csv").write_text("x")
    root = str(tmp_path / "out")
    with small_blocks(spark, 8192):
        if stream:
            ingest_stream(spark, str(landing), root, str(tmp_path / "checkpoint"), clock=lambda: TS).awaitTermination()
        else:
            ingest_files(spark, str(landing), root, TS)
    log = {os.path.basename(r.path): (r.status, r.records, r.rejected, r.error) for r in spark.read.parquet(f"{root}/_log").collect()}
    good = len(keys) - 2
    assert log == {"BAA260101.csv": ("success", good, 1, None), "BAA260102.csv": ("success", good, 1, None),
                   "BAA260103.csv": ("failed", 0, 0, "No data parsed"), "other.csv": ("failed", 0, 0, "Invalid filename format")}
    assert read_table(spark, root, "race_info").count() == 2 * good
    rejects = spark.read.parquet(f"{root}/_rejects").collect()
    assert sorted((os.path.basename(r.path), r.line_no, r.reject_reason) for r in rejects) == [
        ("BAA260101.csv", 8, "line too short"), ("BAA260102.csv", 8, "line too short")]


def test_the_stream_does_not_read_contents_into_rows(spark, tmp_path, monkeypatch):
    from furlong.streaming import ingest as module

    seen = []
    monkeypatch.setattr(module, "load_files", lambda spark, files, *rest: seen.append(files.columns))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "BAA260104.csv").write_text(PROGRAMME)
    module.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert seen == [["path", "modificationTime", "length", "data_type", "file_date", "table", "error"]]


def test_blank_required_text_is_kept(spark):
    blank = " " * 8 + PROGRAMME[8:]
    parsed = parse_lines(spark.createDataFrame([("a", PROGRAMME[:8] + PROGRAMME[8:])], "path string, line string"), "BAA", TS)
    assert parsed.where("reject_reason IS NULL").count() == 1
    entry = spark.createDataFrame([("a", "06261101" + "01" + " " * 500)], "path string, line string")
    kept = split_required(parse_lines(entry, "KYF", TS))[0].collect()
    assert len(kept) == 1 and kept[0].horse_id == "" and blank


def test_staging_is_freed_and_strictness_reaches_the_loader(spark, tmp_path):
    import os

    from furlong.sources.tables import read_table
    from furlong.streaming.ingest import ingest_files

    bad = PROGRAMME[:8] + " " * 8 + PROGRAMME[16:]
    other = PROGRAMME[:6] + "09" + PROGRAMME[8:]
    landing = tmp_path / "in"
    landing.mkdir()
    for name, text in (("BAA260101.csv", f"{PROGRAMME}\n{bad}"), ("BAA260102.csv", other)):
        (landing / name).write_text(text)
    for strict, expected in ((True, 1), (False, 2)):
        root = str(tmp_path / f"out-{strict}")
        ingest_files(spark, str(landing), root, TS, strict=strict)
        assert read_table(spark, root, "race_info").count() == expected
        log = {os.path.basename(r["path"]): (r["status"], r["records"]) for r in spark.read.parquet(f"{root}/_log").collect()}
        assert log == {"BAA260101.csv": ("failed", 0) if strict else ("success", 1), "BAA260102.csv": ("success", 1)}
        for folder in ("lines", "parsed"):
            staged = f"{root}/_staging/{folder}/{os.listdir(f'{root}/_staging/{folder}')[0]}"
            assert spark.read.schema("line string").parquet(staged).count() == 0
