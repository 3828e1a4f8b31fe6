"""Message files in, tables and reports out."""

import zipfile

import pytest
from helpers import RAW_SCHEMA, TESTDATA, depart, park, payload, raw_messages, rows
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V
from parkpulse.operators.parse import parse_guarded, with_names
from parkpulse.operators.stays import enrich_stays
from parkpulse.plans import pipeline as P
from parkpulse.plans.batch import run_batch
from parkpulse.sources.events import messages_from_events
from parkpulse.sources.messages import COLUMNS, read_messages
from parkpulse.sources.sinks import write_table

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(ref, value, shared):
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if shared is None:
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    shared.append(value)
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def write_workbook(path, header, data, inline=False, date1904=False):
    shared = None if inline else []
    lines = []
    for r, row in enumerate([header, *data], 1):
        cells = [_cell(f"{chr(65 + c)}{r}", v, shared) for c, v in enumerate(row) if v is not None]
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {NS} xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/>'
            '<sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Target="worksheets/data.xml"/></Relationships>',
        )
        book.writestr(
            "xl/worksheets/data.xml",
            f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData></worksheet>',
        )
        if shared is not None:
            strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
            book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")


HEADER = ["번호", "센서", "센서값", "송신일시(sendDate)"]
SENSOR = "주차센서_대신졸음쉼터_#01"


def test_workbooks_with_text_and_serial_times(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", HEADER, [
        [1, SENSOR, payload(V.PARK, V.EVENT), "2022-03-01 10:00:00"],
        [2, SENSOR, payload(V.DEPART, V.EVENT), 44621.4375],
    ])
    write_workbook(tmp_path / "b.xlsx", HEADER, [
        [1, "주차센서_옥천졸음쉼터_#02", payload(V.PARK, V.EVENT), 44621.5 - 1462],
        [2, "주차센서_옥천졸음쉼터_#02", payload(V.DEPART, V.EVENT), 44621.51 - 1462],
    ], inline=True, date1904=True)
    raw = read_messages(spark, str(tmp_path / "*.xlsx"))
    assert raw.columns == ["row_id", "sensor", "payload", "send_ts"]
    stays = P.guarded_stays(raw).orderBy("sensor").collect()
    assert [(r.sensor, r.dwell_sec) for r in stays] == [("대신#01", 1800), ("옥천#02", 864)]


def test_workbook_without_a_column_fails(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", HEADER[:3], [[1, SENSOR, "x"]])
    with pytest.raises(Exception, match="columns missing"):
        read_messages(spark, str(tmp_path / "a.xlsx")).collect()


def test_empty_cells_become_null(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", HEADER, [[1, SENSOR, None, "2022-03-01 10:00:00"]])
    assert read_messages(spark, str(tmp_path / "a.xlsx")).first().payload is None


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_same_messages_from_any_format(spark, tmp_path, fmt):
    raw = messages_from_events(spark, f"{TESTDATA}/sf0.001")
    named = raw.orderBy("row_id").select(*[F.col(n).alias(c) for c, n in COLUMNS.items()])
    if fmt == "csv":
        write_table(named.coalesce(1), str(tmp_path / "m"), "csv")
    else:
        # Parquet column names may not hold brackets in every reader; Spark accepts them.
        write_table(named.coalesce(1), str(tmp_path / "m"), "parquet")
    back = read_messages(spark, str(tmp_path / "m"), fmt)
    assert rows(P.guarded_stays(back)) == rows(P.guarded_stays(raw))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ties_across_files_follow_the_files(spark, tmp_path, fmt):
    """Equal times in several files: one answer, however the files are split and packed."""
    raw = messages_from_events(spark, f"{TESTDATA}/sf0.001")
    tied = raw.withColumn("send_ts", F.concat(F.substring("send_ts", 1, 8), F.lit("01 10:00:00")))
    named = tied.select(*[F.col(n).alias(c) for c, n in COLUMNS.items()])
    write_table(named.repartition(4), str(tmp_path / "m"), fmt)
    answers = []
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("10000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = read_messages(spark, str(tmp_path / "m"), fmt)
            assert back.count() == back.select("row_id").distinct().count() == 1000
            answers.append((rows(P.precedence_stays(back)), rows(P.guarded(back).drop("row_id"))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert answers[0] == answers[1]


def test_refuses_unknown_files_and_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        read_messages(spark, "messages.txt")
    with pytest.raises(ValueError, match="no message file"):
        read_messages(spark, "")
    spark.range(1).write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(ValueError, match="columns missing"):
        read_messages(spark, str(tmp_path / "p.parquet"))


def test_sample_is_used_without_a_path(spark, tmp_path):
    write_workbook(tmp_path / "def.xlsx", HEADER, [[1, SENSOR, "x", "2022-03-01 10:00:00"]])
    assert read_messages(spark, "", sample=str(tmp_path / "def.xlsx")).count() == 1


# ---- parsing


def _parsed(spark, *payloads):
    data = [(i, SENSOR, p, "2022-03-01 10:00:00") for i, p in enumerate(payloads)]
    return with_names(spark.createDataFrame(data, RAW_SCHEMA), "full")


def test_payload_shapes(spark):
    good = payload(V.PARK, V.EVENT)
    short = good.rsplit(",", 1)[0]
    named = _parsed(spark, good, short, good + ", 추가", None, good.replace(", ", ","),
                    payload(V.PARK, V.EVENT, battery=""), payload(V.PARK, V.EVENT, battery="?"))
    got = {r.row_id: r for r in parse_guarded(named).collect()}
    assert set(got) == {0, 2, 4, 6}
    assert got[2].action == "주차이벤트, 추가"
    assert got[0].asDict() | {"row_id": 4} == got[4].asDict()
    assert (got[0].battery, got[0].rssi, got[0].snr, got[0].fault) == (3.6, -70.0, 5.0, "0.0")
    assert got[6].battery is None


def test_recodes(spark):
    named = _parsed(spark, payload(V.PARK, "2.0", fault="51.0"), payload(V.PARK, "3.0"),
                    payload(V.PARK, "오류"))
    got = [(r.fault, r.action) for r in parse_guarded(named).orderBy("row_id").collect()]
    assert got[0] == ("리셋 발생", "LoRa Reset 수신 후 부팅")
    assert got[1][1] == "LoRa 전송오류 등으로 인한 자체 시스템 Reset"
    assert got[2][1] == "LoRa Reset 수신 후 부팅"


def test_precedence_keeps_short_payloads_as_normal(spark):
    raw = raw_messages(spark, [park("2022-03-01 10:00:00"), depart("2022-03-01 11:00:00")])
    short = raw.withColumn("payload", F.expr("substring_index(payload, ',', 6)"))
    assert [r.status_code for r in P.precedence(short).collect()] == [0, 0]
    assert P.guarded(short).count() == 0


@pytest.mark.parametrize("style,name", [
    ("full", "대신졸음쉼터_#01"), ("short", "대신#01"), ("charclass", "대신#01"),
])
def test_sensor_styles(spark, style, name):
    raw = raw_messages(spark, [park("2022-03-01 10:00:00")])
    assert with_names(raw, style).first().sensor == name


# ---- the whole batch


def test_batch_run(spark, tmp_path):
    raw = messages_from_events(spark, f"{TESTDATA}/sf0.001")
    chosen = ("대신졸음쉼터_#00003",)
    sites = ("대신", "영천", "옥천")
    run_batch(raw, str(tmp_path / "a"), chosen, sites)
    run_batch(raw, str(tmp_path / "b"), chosen, slice_rows=40)
    with pytest.raises(Exception, match="already exists"):
        run_batch(raw, str(tmp_path / "a"))
    read = lambda run, name: spark.read.parquet(str(tmp_path / run / name))
    for name in ("messages", "coded_messages", "stays", "occupancy"):
        assert rows(read("a", name)) == rows(read("b", name)), name
    csv = lambda name: spark.read.csv(str(tmp_path / "a" / name), header=True)
    for name in ("error_summary", "sequence_errors_daily", "stay_summary", "error_rates_monthly",
                 "error_rates_selected", "error_rates_wide", "occupancy_wide", "occupancy_profile", "occupancy_summary", "manova", "anova", "tukey_dwell_sec"):
        assert csv(name).count() > 0, name
    assert read("a", "coded_messages").count() == 1000
    assert read("a", "stays").count() == 133
    assert csv("error_rates_monthly").columns == ["site", "month", "error_rate"]
    assert csv("error_rates_wide").columns == ["month", *sites, *chosen]
    assert csv("occupancy_wide").columns == ["hour", *chosen]


# ---- names


def test_sensor_numbers_are_never_cut(spark, tmp_path):
    events = spark.range(99_998, 100_003).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    names = {r.sensor.rpartition("#")[2] for r in messages_from_events(spark, str(tmp_path)).collect()}
    assert names == {"99998", "99999", "100000", "100001", "100002"}


def test_site_is_the_whole_name_before_the_separator(spark):
    names = ["주차센서_대신졸음쉼터_#01", "주차센서_대신동졸음쉼터_#01", "주차센서_대신동북졸음쉼터_#01"]
    raw = raw_messages(spark, [
        m for n in names for m in (park("2022-03-01 10:00:00", V.EVENT, n), depart("2022-03-01 11:00:00", V.EVENT, n))
    ])
    for style in ("full", "short", "charclass"):
        stays = P.precedence_stays(raw) if style == "charclass" else P.guarded_stays(raw, style=style)
        assert sorted(r.site for r in stays.collect()) == ["대신", "대신동", "대신동북"], style
    full = P.guarded_stays(raw, style="full")
    assert rows(full.select("sensor", "site")) == rows(enrich_stays(full).select("sensor", "site"))
