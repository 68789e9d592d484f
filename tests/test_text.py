"""Literal edge cases of the display and export text."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kairoscope.functions import text as X
from kairoscope.sources import sinks

INF, NAN = float("inf"), float("nan")


def values(spark, fn, cases, kind):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "fn, kind, cases",
    [
        (X.format_bytes, "double", {0.0: "0 B", -1.0: "0 B", 1.0: "1 B", 1023.0: "1023 B", 1024.0: "1.00 KB",
                                    1048575.0: "1024.00 KB", 1024.0**5 * 3: "3072.00 TB", NAN: "0 B", INF: "0 B"}),
        (X.format_hms, "double", {None: "—", NAN: "—", -3.0: "00:00", 59.5: "01:00", 3599.6: "01:00:00",
                                  3600.0: "01:00:00", 360000.0: "100:00:00", 65.2: "01:05"}),
        (X.format_eta, "double", {None: "—", -1.0: "—", 0.0: "0 sec", 59.2: "60 sec", 119.5: "1m 60s", 3600.0: "1h 0m",
                                  7325.0: "2h 2m"}),
        (X.format_speed, "double", {0.0: "—", -5.0: "—", 2048.0: "2.00 KB/s", NAN: "—"}),
        (X.format_percent, "double", {12.5: "13%", 0.4: "0%"}),
        (X.title_case, "string", {"extracting_frames": "Extracting Frames", "a-b c": "A-B C", "mP4 x": "MP4 X", "": "",
                                  "don't": "Don'T", "école x": "éCole X"}),
        (X.safe_file_name, "string", {"": "export", "???": "_", "a b/c": "a_b_c", "x" * 200: "x" * 80}),
        (X.csv_escape, "string", {None: "", "": "", "a,b": '"a,b"', 'q"': '"q"""', "a\nb": '"a\nb"', "a\rb": "a\rb",
                                  " lead": " lead"}),
        (X.js_number, "double", {1.0: "1", 0.5: "0.5", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 12345678.5: "12345678.5",
                                 1e21: "1e+21", 1e20: "100000000000000000000", -2.25: "-2.25", 0.0: "0",
                                 1.2345678901234567e-6: "0.0000012345678901234567", NAN: "NaN", None: None}),
        (X.format_date, "string", {None: "—", "": "—", "2024-03-07T15:04:05Z": "Mar 7, 2024", "soon": "soon"}),
        (X.format_date_time, "string", {"2024-03-07 15:04:05": "Mar 7, 2024, 03:04 PM", "x": "x"}),
    ],
)
def test_formats(spark, fn, kind, cases):
    assert values(spark, fn, list(cases), kind) == list(cases.values())


def test_to_fixed(spark):
    got = values(spark, lambda c: X.to_fixed(c, 2), [1.005, 0.0, -1.239, 2.5, 0.999], "double")
    assert got == ["1.00", "0.00", "-1.24", "2.50", "1.00"]


def result_row(**changes):
    row = {
        "query_id": "q", "query": 'a "dog", red', "video_id": "v", "video_name": "clip.mp4", "media_type": "video",
        "timestamp": 12.0, "timestamp_hms": "00:12", "context_start": 4.0, "context_end": 20.5,
        "context_start_hms": None, "context_end_hms": None, "similarity": 0.756, "frame_id": "f1",
        "retrieval_stage": "coarse", "context_reason": "why", "context_text": None, "context_summary": None,
        "context_frames": [("f1", 12.0, "00:12", "u")], "rank": 1,
    }
    return {**row, **changes}


SCHEMA = (
    "query_id string, query string, video_id string, video_name string, media_type string, timestamp double, "
    "timestamp_hms string, context_start double, context_end double, context_start_hms string, context_end_hms string, "
    "similarity double, frame_id string, retrieval_stage string, context_reason string, context_text string, "
    "context_summary string, context_frames array<struct<frame_id:string,timestamp:double,timestamp_hms:string,frame_url:string>>, rank int"
)


def rows(spark, *dicts):
    names = [f.strip().split()[0] for f in SCHEMA.replace("array<struct<", "array ").split(", ")]
    names = [n for n in names if n in result_row()]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in dicts], SCHEMA)


def test_evidence_block(spark):
    df = rows(spark, result_row(context_summary="A dog."))
    text = sinks.export_lines(df, "txt").first()["line"]
    assert text == "\n".join(
        [X.RULE, "RETRIEVED EVIDENCE", "", "Media: clip.mp4", "", 'Query: "a "dog", red"', "Match: 00:12",
         "Segment: 4.00 - 20.50", "Relevance: 0.76", "Representative frames:", "  00:12", "Reason: why",
         "Source: clip.mp4", X.RULE, "", X.RULE, "AI SUMMARY", "", "A dog.", X.RULE]
    )
    bare = rows(spark, result_row(context_start=None, context_frames=[], context_reason=""))
    text = sinks.export_lines(bare, "txt").first()["line"]
    assert "Segment" not in text and "frames:" not in text and "Reason" not in text and "SUMMARY" not in text


def test_json_keys_and_nulls(spark):
    line = sinks.export_lines(rows(spark, result_row(context_start=None, context_text="T")), "json").first()["line"]
    parsed = json.loads(line)
    assert list(parsed) == ["query", "media", "media_type", "timestamp", "start", "end", "score", "frame_id",
                            "retrieval_stage", "context_frames", "reason", "context"]
    assert parsed["start"] is None and parsed["context"] == "T" and parsed["context_frames"][0]["frame_id"] == "f1"


def test_csv_line_and_file(spark, tmp_path):
    df = rows(spark, result_row(), result_row(context_start=None, context_reason=None, query="x"))
    lines = [r["line"] for r in sinks.export_lines(df, "csv").select("line").collect()]
    assert '"a ""dog"", red",clip.mp4,video,12,4,20.5,0.756,why' in lines
    assert "x,clip.mp4,video,12,,20.5,0.756," in lines
    sinks.export_contexts(df.coalesce(1), "csv", str(tmp_path / "out"))
    written = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert written[0] == X.CSV_HEADER and sorted(written[1:]) == sorted(lines)
    for name, part in {"many": df.repartition(3), "none": df.limit(0)}.items():
        for fmt in ("csv", "json", "txt"):
            place = tmp_path / f"{name}-{fmt}"
            sinks.export_contexts(part, fmt, str(place))
            whole = "".join(file.read_text() for file in sorted(place.glob("part-*")))
            records = [r["line"] for r in sinks.export_lines(part, fmt).select("line").collect()]
            head = f"{X.CSV_HEADER}\n" if fmt == "csv" else ""
            assert whole.startswith(head) and len(whole) == len(head) + sum(len(r) + 1 for r in records)
            assert all(r in whole for r in records)


def test_copy_all_numbers_by_rank(spark):
    df = rows(spark, result_row(rank=2, context_text="B"), result_row(rank=1, context_text="A"))
    assert sinks.copy_all(df).first()["copied_text"] == "# Result 1\nA\n\n# Result 2\nB"


def test_saved_text_without_segment(spark):
    saved = spark.createDataFrame(
        [("c.mp4", "q", "00:01", None, 2.0, 0.5)],
        "filename string, query string, timestamp_hms string, context_start double, context_end double, score double",
    )
    text = saved.select(X.saved_context_text()).first()[0]
    assert text == "\n".join([X.RULE, "Media: c.mp4", 'Query: "q"', "Match: 00:01", "Relevance: 0.50", X.RULE])


def test_iso_dates(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 1),)], "t timestamp")
    got = df.select(X.to_iso_date(F.col("t")), X.days_ago(F.col("t"), 1)).first()
    assert tuple(got) == ("2024-03-01", "2024-02-29")
