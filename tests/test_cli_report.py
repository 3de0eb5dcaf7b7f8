"""compute without a limit prints every name."""

from __future__ import annotations

from pyspark.sql import functions as F

from vialect.plans import cli


def test_all_names_are_printed(spark, monkeypatch, capsys):
    n = (1 << 20) + 3
    rows = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("name"), F.lit(1.0).alias("total_m"), F.lit(1).alias("segments_count"), F.lit(1).alias("street_count"))
    monkeypatch.setattr(cli.files, "read_lines", lambda *_: None)
    monkeypatch.setattr(cli.files, "write_csv", lambda *_: None)
    monkeypatch.setattr(cli.lengths, "untagged", lambda *_: None)
    monkeypatch.setattr(cli.lengths, "street_lengths", lambda _: rows)
    cli.compute(spark, "lines", "", "untagged", None)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == n and lines[-1].endswith(f"| {n - 1}")
    cli.compute(spark, "lines", "", "untagged", 2)
    assert capsys.readouterr().out.splitlines() == ["1.000 m | 1 segments | 1 streets | 0", "1.000 m | 1 segments | 1 streets | 1"]
