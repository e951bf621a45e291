"""Registered queries against their SQL on the smallest tables."""

import decimal

import pytest

from tidemark.plans import catalogue, research

DATA = "/root/testdata/sf0.01"

@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Steps that many queries begin with are taken once: their tables stay as long as the session."""
    held = {}

    def once(f, *which):
        def g(*args):
            key = (f.__name__, *(args[k] if isinstance(args[k], str) else id(args[k]) for k in which))
            if key not in held:
                held[key] = f(*args)
            return held[key]

        return g

    with pytest.MonkeyPatch.context() as patch:
        for name, which in (("_replayed", (1,)), ("_shape_replayed", (1,)), ("_aged_states", (1,))):
            patch.setattr(research, name, once(getattr(research, name), *which))
        for name, which in (("_predicted", (1,)), ("hourly", (1,)), ("blocked", (0,)), ("traced", (0,)), ("_observed", (0,)), ("_touched", (0,)), ("_soft_matched", (0,)), ("_neighbours", (1, 2)), ("Study", (1,))):
            patch.setattr(catalogue, name, once(getattr(catalogue, name), *which))
        yield


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    number = lambda v: isinstance(v, (float, decimal.Decimal))
    # rows by what is not a float, then floats within a tolerance
    key = lambda row: tuple((v is None, "" if number(v) else str(v)) for v in row) + tuple(round(float(v), 3) if number(v) else 0.0 for v in row)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for w, g in zip(want, got):
        assert all(g_ == pytest.approx(float(w_), rel=1e-6, abs=2e-5) if number(w_) else g_ == w_ for w_, g_ in zip(w, g)), (w, g)


def test_flagship_counts(spark):
    assert {r.status: r.signals for r in catalogue.flagship(spark, "/root/testdata/sf0.001").collect()} == {"filled_before_departure": 17, "filled": 9, "unfilled": 1, "right_censored": 1}


def test_every_oracle_belongs_to_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.ORACLE_SQL) > 80
