import json

import pytest
from fixtures import bars, walk

from tidemark.operators import validate
from tidemark.operators.features import compute_features
from tidemark.schema import OHLCV, FeatureParams
from tidemark.sources import bars as B
from tidemark.sources import download as D
from tidemark.sources import sinks, storage

HEAD = ",".join(OHLCV)
GOOD = "2024-01-02,10,11,9,10.5,1000\n2024-01-03,10.5,12,10,11,0\n"


def load(spark, tmp_path, text, name="b.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return B.read_ohlcv_csv(spark, str(path))


def test_good_file_with_mark_crlf_and_blank_lines(spark, tmp_path):
    rows = load(spark, tmp_path, f"{HEAD}\n{GOOD}").orderBy("day").collect()
    assert [(r["day"], str(r["date"]), r["close"], r["volume"]) for r in rows] == [(0, "2024-01-02", 10.5, 1000.0), (1, "2024-01-03", 11.0, 0.0)]
    odd = "﻿" + f"{HEAD}\n\n{GOOD}\n".replace("\n", "\r\n")
    assert load(spark, tmp_path, odd, "odd.csv").orderBy("day").collect() == rows


@pytest.mark.parametrize(
    "text, reason",
    [
        ("date,open,low,high,close,volume\n" + GOOD, "header"),
        (f"{HEAD}\n2024-01-03,1,1,1,1,1\n2024-01-02,1,1,1,1,1\n", "3: date doesn't increase"),
        (f"{HEAD}\n2024-01-03,1,1,1,1,1\n2024-01-03,1,1,1,1,1\n", "3: date doesn't increase"),
        (f"{HEAD}\n2024-01-02,1,1,1,-1,1\n", "2: close isn't positive"),
        (f"{HEAD}\n2024-01-02,1,1,1,1\n", "2: needs six fields"),
        (f"{HEAD}\n2024-01-02,1,1,1,1,1,1\n", "2: needs six fields"),
        (f"{HEAD}\n2024-01-02,1, 1,1,1,1\n", "2: high is no number"),
        (f"{HEAD}\n2024-01-02,+1,1,1,1,1\n", "2: open is no number"),
        (f"{HEAD}\n2024-01-02,1,1,1,nan,1\n", "2: close is no number"),
        (f"{HEAD}\n2024-01-02,1,1,1,,1\n", "2: close is no number"),
        (f"{HEAD}\n2024-01-02,1,1,1,1,-5\n", "2: volume is negative"),
        (f"{HEAD}\n\n2024-01-02,1,1,1,1,1\n\n2024-01-01,1,1,1,1,1\n", "5: date doesn't increase"),
        (f'{HEAD}\n2024-01-02,"1",1,1,1,1\n', "2: open is no number"),
        (f"{HEAD}\n2024-13-02,1,1,1,1,1\n", "2: date missing"),
        (f"{HEAD}\n", "has no rows"),
    ],
)
def test_bad_files_fail_with_line_and_reason(spark, tmp_path, text, reason):
    with pytest.raises(B.ContractError, match=reason):
        load(spark, tmp_path, text)


def test_feature_and_label_files_read_back(spark, tmp_path):
    rows = compute_features(bars(spark, walk(40)))
    columns = FeatureParams().columns
    sinks.write_csv(sinks.features_csv(rows, columns), str(tmp_path / "f"))
    back = sinks.read_features_csv(spark, str(tmp_path / "f"), columns)
    assert back.orderBy("row").collect() == rows.select("series_id", "row", "date", *columns).orderBy("row").collect()
    labels = rows.selectExpr("series_id", "row", "date", "row % 3 - 1 as label")
    sinks.write_csv(sinks.labels_csv(labels), str(tmp_path / "l"))
    found = sinks.read_labels_csv(spark, str(tmp_path / "l"))
    assert found.orderBy("row").collect() == labels.orderBy("row").collect()
    with pytest.raises(Exception):
        sinks.read_features_csv(spark, str(tmp_path / "l"), columns).collect()
    assert {r["label"] for r in validate.only_labels(found, [1]).collect()} == {1}
    assert {r["label"] for r in validate.only_labels(found, [0], noise=True).collect()} == {-1, 0}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("sc", (), {"getCheckpointDir": lambda self: type("none", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(type("session", (), {"sparkContext": Context()})())


def test_merge_takes_equal_bars_once_and_refuses_others(spark):
    b = bars(spark, walk(10)).drop("day")
    assert B.merge_chunks(b.unionByName(b.limit(4))).count() == 10
    other = b.limit(1).selectExpr("series_id", "date", "open", "high", "low", "close + 1 as close", "volume")
    with pytest.raises(Exception, match="two different bars"):
        B.merge_chunks(b.unionByName(other)).collect()


def test_history(spark):
    r = B.history(bars(spark, walk(10))).first()
    assert r["bars"] == 10 and not r["deep"]


def test_empty_tables(spark):
    none = bars(spark, walk(3)).limit(0)
    assert compute_features(none).count() == 0
    assert B.violations(none).count() == 0
    assert B.merge_chunks(none.drop("day")).count() == 0


def test_sinks(spark, tmp_path):
    b = bars(spark, walk(40))
    rows = compute_features(b)
    columns = FeatureParams().columns
    sinks.write_csv(sinks.features_csv(rows, columns), str(tmp_path / "f"))
    back = spark.read.csv(str(tmp_path / "f"), header=True, inferSchema=True).orderBy("date").collect()
    assert [r["skewness"] for r in back] == [r["skewness"] for r in rows.orderBy("row").collect()]
    sinks.write_csv(sinks.bars_csv(b), str(tmp_path / "b"))
    part = next((tmp_path / "b").glob("part-*.csv"))
    assert B.read_ohlcv_csv(spark, str(part)).count() == 40
    labels = rows.selectExpr("series_id", "row", "row % 2 as label")
    charts = sinks.chart_json(b, rows, labels, labels, columns)
    blob = json.loads(charts.first()["json"])
    page = sinks.chart_pages(charts, "<script>x = @@;</script>", "@@").first()["html"]
    assert json.loads(page.removeprefix("<script>x = ").removesuffix(";</script>")) == blob
    with pytest.raises(ValueError):
        sinks.chart_pages(charts, "nothing", "@@")
    with pytest.raises(Exception, match="no label"):
        sinks.chart_json(b, rows, labels.limit(3), labels, columns).collect()
    assert blob["offset"] == 20 and len(blob["dates"]) == 40 and len(blob["features"]) == 20 and blob["fine"][:3] == [0, 1, 0]


def test_download_goes_back_waits_and_merges(spark):
    every = [(f"2024-01-{d:02d}", "10", "11", "9", str(10 + d / 10), "5") for d in range(1, 24)]
    refusals, waits = [2], []

    def fetch(end, limit):
        if refusals[0]:
            refusals[0] -= 1
            raise D.Busy()
        upto = [b for b in every if end is None or b[0] <= end]
        return upto[-limit:]

    got = D.download(spark, fetch, limit=6, wait=waits.append).orderBy("day").collect()
    assert [str(r["date"]) for r in got] == [b[0] for b in every] and waits == [1.0, 2.0]
    refusals[0] = 99
    with pytest.raises(D.Busy):
        list(D.chunks(fetch, 6, wait=waits.append))
    with pytest.raises(B.ContractError, match="isn't positive"):
        D.download(spark, lambda end, limit: [("2024-01-01", "1", "1", "1", "-1", "0")])
    with pytest.raises(B.ContractError, match="nothing"):
        D.download(spark, lambda end, limit: [])
