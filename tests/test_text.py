"""Raw text fixtures, files on disk, registry."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from laminaflow.functions.journal import parse_messages, plain_number
from laminaflow.operators import features
from laminaflow.functions.logtext import guess_encoding, header_names, is_header, looks_binary, name_date, split_cells, stamp
from laminaflow.registry import default_registry
from laminaflow.sources import files, logs, tables

T = dt.datetime


def lines(spark, text, file="f", day=None):
    rows = [(file, i + 1, l, dt.date.fromisoformat(day) if day else None) for i, l in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source_file_id string, line_no long, line string, day date")


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,day,want", [
    ("2026-04-27 10:00:00 Старт", None, (T(2026, 4, 27, 10), "2026-04-27 10:00:00", 0.0)),
    ("27.04.2026_10:00:00,5 x", None, (T(2026, 4, 27, 10, 0, 0, 500000), "27.04.2026_10:00:00,5", 0.0)),
    ("10:00:00.25 x", "2026-04-27", (T(2026, 4, 27, 10, 0, 0, 250000), "10:00:00.25", 86400.0)),
    ("10:00:00 x", None, (None, None, 0.0)), ("2026-13-45 10:00:00", "2026-01-01", (T(2026, 1, 1, 10), "10:00:00", 86400.0)), ("none", "2026-01-01", (None, None, 0.0))])
def test_stamp(spark, text, day, want):
    got = spark.createDataFrame([(text, day)], "x string, d string").select(stamp(F.col("x"), F.col("d").cast("date")).alias("s")).first().s
    assert (got.ts, got.raw, got.uncertainty) == want


@pytest.mark.parametrize("name,want", [("log_20260427.log", "2026-04-27"), ("2026.04.27_x.log", "2026-04-27"), ("27-04-2026.log", "2026-04-27"), ("plain.log", None), ("20260231.log", None)])
def test_name_date(spark, name, want):
    got = one(spark, name, name_date)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("line,want", [
    ("a|b |c|", ["a", "b ", "c"]), ("|", [""]), ("a;b;", ["a", "b", ""]), ("a\tb", ["a", "b"]), ("1,5 2", ["1,5", "2"]), ("1,2,3", ["1", "2", "3"]), ("  x   y ", ["x", "y"]),
    ('a|"b|c"|d', ["a", "b|c", "d"]), ('"say ""hi"""|x', ['say "hi"', "x"])])
def test_split_cells(spark, line, want):
    assert one(spark, line, split_cells) == want


def test_headers(spark):
    assert one(spark, ["Layer", "", "SO1"], header_names, "array<string>") == ["Layer", "col_1", "SO1"]
    assert [one(spark, c, is_header, "array<string>") for c in (["a", "1"], ["1", "2", "3", "x"], ["1"], ["x"])] == [True, False, False, True]


def test_encodings(spark):
    cases = [(b"", "utf-8"), ("слой".encode(), "utf-8"), (b"\xef\xbb\xbfx", "utf-8-sig"), ("слой 1".encode("cp1251"), "cp1251"), (b"\xff\x98\xe0abc", "latin-1"), (b"\xff\x98\xe0", "latin-1"), (("a" * 65535 + "я").encode(), "utf-8"), (b"a" * 70000 + "слой".encode("cp1251"), "cp1251")]
    for raw, want in cases:
        assert one(spark, bytearray(raw), guess_encoding, "binary") == want, raw[:10]
    assert [one(spark, bytearray(b), looks_binary, "binary") for b in (b"", b"text\n", b"a\x00b", b"\x01\x02\x03a")] == [False, False, True, True]


def test_event_log(spark, heat):
    ev = logs.parse_event_log(lines(spark, "2026-04-27 10:00:00 Старт печати\n\n2026-04-27 10:01:00 слой 12 LIR=0,45\n2026-04-27 10:02:00 ожидание старта прожига\nбез времени\n2026-04-27 10:03:00 -45878 2 Прожиг"))
    got = [(r.source_line, r.event_type, r.phase, r.layer, r.confidence) for r in ev.orderBy("source_line").collect()]
    assert got == [(1, "start", "init", None, .95), (3, "layer_reference", None, 12, .95), (4, "wait_for_burn", None, None, .95), (5, "log_message", None, None, .75), (6, "burn_event", "burn", 2, .95)]
    assert ev.where("source_line = 3").first().payload["vertical_position"] == "0.45"
    assert ev.where("source_line = 6").first().payload["table_position"] == "-45878"
    assert logs.missing_stamp_diagnostics(ev).first()["count"] == 1


def test_rollover_inside_a_log(spark, heat):
    ev = logs.parse_event_log(lines(spark, "23:59:59 Пауза\n00:00:02 Пауза\nтекст\n00:10:00 конец", day="2026-04-27")).orderBy("source_line").collect()
    assert [r.ts for r in ev] == [T(2026, 4, 27, 23, 59, 59), T(2026, 4, 28, 0, 0, 2), None, T(2026, 4, 28, 0, 10)]


def test_glued_monitor_line(spark):
    ev = logs.parse_monitor_log(lines(spark, "2026-04-27 10:00:00 A1=0 2026-04-27 10:00:01 A1=1\n10:00:02 |S|7|1|door| 10:00:03 |R|1.5| 2 |\nplain", day="2026-04-27"))
    got = [(r.source_line, r.entry_no, r.ts and r.ts.second, r.event_type) for r in ev.orderBy("source_line", "entry_no").collect()]
    assert got == [(1, 0, 0, "monitor_code:A1"), (1, 1, 1, "monitor_code:A1"), (2, 0, 2, "monitor_state_change"), (2, 1, 3, "monitor_reading"), (3, 0, None, "monitor_transition")]
    pay = {(r.source_line, r.entry_no): r.payload for r in ev.collect()}
    assert pay[(1, 1)]["value"] == "1" and pay[(2, 0)]["signal_name"] == "door" and pay[(2, 1)]["values"] == "1.5|2"


def test_timing_log(spark):
    src = lines(spark, "  N|  poor|  burn|make layer|OLD_STATS:  2|  8829| 40218| 49250|\nNEW_STATS: L3_detailed|Pour_Start:10|Burn_End:30|Odd:1|\nOLD_STATS: x\nNEW_STATS: L3_detailed|none")
    got = [(r.source_line, r.layer, r.event_type, r.phase, r.burn_ms, r.abs_ms) for r in logs.parse_timing_log(src).orderBy("source_line", "entry_no").collect()]
    assert got == [(1, 2, "layer_timing_summary", "layer", 40218, None), (2, 3, "pour_start", "pour", None, 10), (2, 3, "burn_end", "burn", None, 30), (2, 3, "time_odd", "layer", None, 1)]
    assert logs.timing_malformed(src).first().malformed == 2


def test_state_log(spark, heat):
    head = "Timestamp;State;Failure;ChamberDoor\n"
    body = "2026-04-27 10:00:00;1;0;0\n2026-04-27 10:00:01;1.0;0;0\n2026-04-27 10:00:05;2;0;0\n2026-04-27 10:00:06;2;3;1\n"
    got = logs.parse_state_log(lines(spark, head + body)).orderBy("source_line").collect()
    assert [(r.changed_columns, r.duration_sec, r.subsystem, r.ts_start.second) for r in got] == [(["State"], 5.0, "automation", 0), (["Failure", "ChamberDoor"], 1.0, "failure", 5)]
    assert got[1].previous_state == {"Failure": "0.0", "ChamberDoor": "0.0"}
    bare = logs.parse_state_log(lines(spark, "5 0 0\n5 1 0")).first()
    assert bare.changed_columns == ["col_1"] and bare.subsystem == "stateflow" and bare.duration_sec is None


def test_error_log(spark):
    got = logs.parse_error_log(lines(spark, "fault\n\n27.04.2026 10:00:00 x")).collect()
    assert [(r.source_line, r.severity, r.confidence) for r in got] == [(1, "warning", .5), (3, "warning", .5)]


def test_repeated_header_and_malformed_row(spark):
    t = tables.parse_table(lines(spark, "Layer;SO1;Mystery\n1;10;abc\nLayer;SO1;Mystery\nbad;row"))
    s = tables.table_summary(t, ["Layer", "SO1"]).first()
    assert (s.total_rows, s.malformed_rows, s.repeated_headers, s.unknown_columns) == (2, 1, 1, ["Mystery"])
    assert tables.table_diagnostics(t).first().message == "Expected 3 columns, found 2."
    assert tables.table_sample(t, 1).count() == 1
    r = tables.unknown_fields(t, "burn_log", ["Layer", "SO1"]).first()
    assert (r.occurrence_count, r.examples) == (2, ["abc", "None"])


def test_startup_garbage(spark, heat):
    t = tables.parse_table(lines(spark, "t;SO1\n0;999999999\n1;12\n2;-5000000"))
    assert tables.startup_garbage(t).first().startup_bad_rows == 2
    assert tables.startup_garbage(t, 2).first().startup_bad_rows == 1


def test_sensor_readings(spark):
    got = tables.sensor_readings(lines(spark, "Time|SO1 | Junk|Flow H|\n1|0,5|9|18.5|\n2|x|9|\nTime|SO1 | Junk|Flow H|\n3| 7 ||1e1|")).collect()
    assert sorted((r.idx, r.signal, r.value) for r in got) == [(1, "Flow H", 18.5), (1, "SO1", .5), (4, "Flow H", 10.0), (4, "SO1", 7.0)]


@pytest.mark.parametrize("text,want", [
    ("Баллон A1 потрачено 150 бар", dict(event_type="gas_consumption_recorded", value="150", unit="bar", gas_cylinder_id="A1", action="consumed")),
    ("аргон остаток: 12,5", dict(event_type="gas_consumption_recorded", value="12.5", unit="bar_remaining", gas_type="argon")),
    ("Поставили новый баллон B-7 200 атм", dict(event_type="gas_cylinder_replaced", value="200", unit="атм", gas_cylinder_id="B-7")),
    ("газ шипит", dict(event_type="gas_pressure_issue", value=None, verification_status="unverified")),
    ("Порошок batch123 использовано 2.5 кг", dict(event_type="powder_consumption_recorded", value="2.5", unit="kg", powder_batch="batch123")),
    ("Использовано 500 грамм порошка", dict(event_type="powder_consumption_recorded", value="0.5", unit="kg")),
    ("порошок просеян через сито", dict(event_type="powder_sieved")), ("порошок, цикл 4", dict(event_type="powder_reused", value="4", unit="reuse_cycle")),
    ("Рестарт на слое 50", dict(event_type="restart_attempt", layer=50, action="manual_restart")), ("Фильтр заменён", dict(event_type="filter_replaced", component="filter")),
    ("деталь принята, Ti6Al4V", dict(event_type="part_accepted", material="Ti6Al4V", verification_status="draft")), ("забраковано: поры", dict(event_type="part_rejected", action="porosity_observed")),
    ("просто текст", dict(event_type="operator_observation", needs_confirmation=True))])
def test_operator_text(spark, text, want):
    got = parse_messages(spark.createDataFrame([(text,)], "text string")).first().asDict()
    assert {k: got[k] for k in want} == want


def test_plain_number(spark):
    assert [one(spark, v, plain_number) for v in ("150", "2,50", "10.0", "0.125", None)] == ["150", "2.5", "10", "0.125", None]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    put = lambda n, b: (tmp_path / n).write_bytes(b)
    put("x_2026.04.27.log", "10:00:00 слой 1\r\n10:00:01 слой 2\n".encode("cp1251"))
    put("sub/p_sensors.log", b"Time|SO1|\n1|2|\n")
    put("p_error.log", b"")
    put("p_burn.log", b"1;2\n")
    put("._junk.log", b"\x00")
    put("p_bin.log", b"\x00\x01\x02")
    put("note.txt", b"hi")
    return tmp_path


def test_folder_scan(spark, folder):
    ls = {r.name: r for r in files.list_files(spark, str(folder)).collect()}
    assert {n: ls[n].family for n in ("x_2026.04.27.log", "p_sensors.log", "p_error.log", "note.txt")} == {"x_2026.04.27.log": "main_event_log", "p_sensors.log": "sensors_log", "p_error.log": "error_log", "note.txt": "unsupported"}
    assert ls["p_burn.log"].skip_reason and not ls["p_error.log"].skip_reason and ls["p_sensors.log"].relative_path == "sub/p_sensors.log"
    got = {r.name: r for r in files.inspect_files(spark, str(folder)).collect()}
    assert "p_burn.log" not in got
    assert "p_burn.log" in {r.name for r in files.inspect_files(spark, str(folder), skip=()).collect()}
    assert {n: (r.quality_status, r.encoding) for n, r in got.items()} == {
        "x_2026.04.27.log": ("ok", "cp1251"), "p_sensors.log": ("ok", "utf-8"), "p_error.log": ("zero_byte", None), "p_bin.log": ("binary_or_unknown", None), "note.txt": ("ok", "utf-8")}
    assert got["note.txt"].checksum == hashlib.sha256(b"hi").hexdigest()
    diag = {r.code for r in default_registry().diagnose(files.inspect_files(spark, str(folder))).collect()}
    assert diag == {"zero_byte", "unsupported_file_family"}
    assert logs.empty_file_diagnostics(files.inspect_files(spark, str(folder))).count() == 1


def test_lines_with_offsets(spark, folder, heat):
    got = files.read_lines(spark, str(folder), glob="x_*.log").orderBy("line_no").collect()
    assert [(r.line_no, r.offset, r.line, r.day.isoformat()) for r in got] == [(1, 0, "10:00:00 слой 1", "2026-04-27"), (2, 17, "10:00:01 слой 2", "2026-04-27")]
    ev = logs.parse_event_log(files.read_lines(spark, str(folder), glob="x_*.log")).orderBy("source_line").collect()
    assert [(r.layer, r.ts, r.source_offset) for r in ev] == [(1, T(2026, 4, 27, 10), 0), (2, T(2026, 4, 27, 10, 0, 1), 17)]


def test_big_file_is_numbered_across_splits(spark, tmp_path, heat):
    body = "\n".join(f"line {i}" for i in range(20000)) + "\n"
    (tmp_path / "big.log").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.laminaflow.hotRows", "3000" if heat == "hot" else "4000000")
    try:
        df = files.read_lines(spark, str(tmp_path))
        assert df.where(F.col("line") != F.concat(F.lit("line "), (F.col("line_no") - 1).cast("string"))).count() == 0
        assert df.count() == 20000 and df.agg(F.max(F.col("offset"))).first()[0] == len(body) - len("line 19999\n")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def test_stability(spark):
    now = F.lit("2026-01-01 01:00:00").cast("timestamp")
    snap = lambda *rows: spark.createDataFrame([(n, s, T(2026, 1, 1, 0, m)) for n, s, m in rows], "relative_path string, size_bytes long, mtime timestamp")
    a, b = snap(("x", 1, 0)), snap(("x", 2, 0))
    reason = lambda cur, prev: files.stability(cur, prev, now).first().reason
    assert [reason(a, None), reason(a, a), reason(b, a), reason(snap(("x", 1, 59)).withColumn("mtime", now), a), reason(a.limit(0), a)] == ["stable", "stable", "file_snapshot_changed", "files_too_recent", "source_missing_or_empty"]


def test_registry_survives_a_bad_parser(spark):
    reg = default_registry()
    reg.register("error_log", lambda df: df.select("no_such_column"))
    src = lines(spark, "x").withColumn("family", F.lit("error_log"))
    out = reg.parse(src)["error_log"].first()
    assert out.code == "parser_exception" and "main_event_log" in reg.families()


def test_equal_heads_are_different_lines(spark):
    """Lines without a stamp whose first 500 characters agree stay apart."""
    head = "x" * 500
    lines = spark.createDataFrame([("f", k + 1, head + tail) for k, tail in enumerate(("a", "b", "c", "a"))], "source_file_id string, line_no long, line string")
    events = logs.parse_event_log(lines).withColumn("session_id", F.lit("s"))
    assert sorted(r.copies for r in features.deduplicate(events, ["source_line"]).collect()) == [1, 1, 2]
