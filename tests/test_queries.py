"""Every registered query against its SQL, where DuckDB is at hand."""

import pytest

duckdb = pytest.importorskip("duckdb")

from threadloom.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert norm(rows) == norm(con.execute(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall())


def test_listings_go_on_in_further_documents(spark, con, sf_dir, monkeypatch):
    from threadloom.plans import rendered

    monkeypatch.setattr(rendered, "LISTED_ROWS", 3)
    sizes, real = [], rendered.extract.listing_from_html
    monkeypatch.setattr(rendered.extract, "listing_from_html", lambda pages: sizes.append(pages.groupBy("forum").count().first()["count"]) or real(pages))
    test_query(spark, con, sf_dir, "rendered_listings")
    assert sizes[0] > 40  # more documents than pages


def test_entry_points_import_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
