"""Every query against its DuckDB SQL on the smallest tables; those without SQL must run and give rows."""

from __future__ import annotations

from decimal import Decimal

import pytest

from inkgrid import queries as own


def rows(found, order):
    def value(v):
        return round(float(v), 7) + 0.0 if isinstance(v, float | Decimal) else v

    return sorted([tuple(value(r[i]) for i in order) for r in found], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = rows(df.collect(), [df.columns.index(c) for c in names])
    if name not in own.ORACLES:
        assert got
        return
    rel = duck.sql(own.ORACLES[name])
    columns = list(rel.columns)
    assert sorted(columns) == names
    assert got == rows(rel.fetchall(), [columns.index(c) for c in names])


@pytest.mark.parametrize("name", "s4_poly_bbox s7_interval_gap g1_a5_stitch_lines g2_l2_stitch_blocks a6_matches_per_page io8_export_pages j9_collisions".split())
def test_long_texts(spark, tmp_path, name):
    import duckdb

    texts = [(0, " ".join(f"w{i * i % 9999}é{i}"[: i % 9 + 2] for i in range(3000))), (1, "one two"), (2, ""), (3, "x " * 450), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = own.QUERIES[name](spark, str(tmp_path))
    names = sorted(df.columns)
    got = rows(df.collect(), [df.columns.index(c) for c in names])
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = duck.sql(own.ORACLES[name])
    assert got == rows(rel.fetchall(), [list(rel.columns).index(c) for c in names])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(own.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
