import pytest

from panelforge.sources import configs, panels
from panelforge.streaming.bars import stream_bars


def test_config_reader():
    p = configs.read_config('{"penalty": 1.0, "lookback": 60}')
    assert p.lookback == 60 and configs.identity(p) != configs.identity(configs.read_config("{}"))
    with pytest.raises(ValueError):
        configs.read_config('{"nope": 1}')


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,A,B\n2020-01-01,1,2\n2020-01-02,2,NaN\n")
    p = panels.read_prices_csv(spark, str(tmp_path / "p.csv"), ["A", "B"])
    assert sorted((r.asset, r.price) for r in p.collect() if r.date.day == 2) == [("A", 2.0), ("B", None)]
    panels.write_panel(p, str(tmp_path / "out"), "json")
    with pytest.raises(ValueError):
        panels.write_panel(spark.sql("SELECT double('NaN') AS x"), str(tmp_path / "bad"), "json")
    assert panels.until(p, "2020-01-01").count() == 2
    assert "A" in configs.text_report(p.orderBy("date", "asset"))


def test_stream_equals_table(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 0, int(id) * 20) AS ts, 'A' AS asset, double(id % 5) AS price, 1.0D AS quantity FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("bars")) == key(stream_bars(rows)) and spark.table("bars").count() == 4
