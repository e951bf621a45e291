"""Growing files, archives, artifacts, sinks that set bad series aside, forests, stacks, caps and weights."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import RELAXED, candles, walk
from tidemark.functions.columns import age_bucket, age_support
from tidemark.operators import folds, forests, signals, stats, trace, windows
from tidemark.sources import artifacts, growing
from tidemark.sources.candles import ContractError
from tidemark.streaming import candles as stream

def lines(begin, end):
    return "".join(f"{k * 60_000},1,2,0.5,1.5,{k},{k * 60_000 + 59_999},0,0,0,0,0\n" for k in range(begin, end))


@pytest.mark.parametrize("part", (7, 64, 10_000))
def test_growing_file_is_read_from_a_byte_on(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(growing, "PART_BYTES", part)
    path = f"{tmp_path}/a.csv"
    assert growing.read_new(spark, path)[1] == 0
    with open(path, "w") as f:
        f.write("open_time,open,high,low,close,volume,close_time,q,n,b,t,i\n" + lines(0, 10) + "600000,1,2")
    rows, at = growing.read_new(spark, path)
    assert sorted(r.open_time for r in rows.collect()) == [k * 60_000 for k in range(10)]
    with open(path, "a") as f:
        f.write(",0.5,1.5,10,659999,0,0,0,0,0\n" + lines(11, 14))
    new, end = growing.read_new(spark, path, at)
    assert sorted((r.open_time, r.volume) for r in new.collect()) == [(k * 60_000, float(k)) for k in range(10, 14)]
    assert growing.read_new(spark, path, end)[0].count() == 0
    with pytest.raises(ContractError):
        growing.read_new(spark, path, end + 1)


def test_growing_file_as_a_stream(spark, tmp_path):
    spark.dataSource.register(growing.TailSource)
    path = f"{tmp_path}/a.csv"
    open(path, "w").write(lines(0, 5))
    for end in (5, 9, 9):
        if end > 5:
            open(path, "a").write(lines(5, end) if sum(1 for _ in open(path)) == 5 else "")
        got = stream.run_available(spark, spark.readStream.format("tail").load(path).select("open_time"), f"{tmp_path}/out")
        assert sorted(r.open_time for r in got.collect()) == [k * 60_000 for k in range(end)]


def test_archives(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(f"{tmp_path}/{k}.zip", "w") as z:
            z.writestr("a.csv", ("open_time,open\n" if k else "") + lines(k * 10, k * 10 + 10))
            z.writestr("note.txt", "not a candle")
    got = growing.read_archives(spark, str(tmp_path))
    assert sorted(r.open_time for r in got.collect()) == [k * 60_000 for k in range(30)] and got.select("archive").distinct().count() == 3


def test_artifact_belongs_to_its_source(spark, tmp_path):
    source, root = f"file://{tmp_path}/source", f"file://{tmp_path}/artifact"
    spark.range(5).write.parquet(source)
    one = artifacts.fingerprint(spark, source)
    assert one == artifacts.fingerprint(spark, source)
    built = []

    def build():
        built.append(1)
        return {"scales": spark.range(3), "history": spark.range(4)}

    with pytest.raises(ContractError):
        artifacts.load(spark, root, one)
    assert {n: t.count() for n, t in artifacts.load_or_build(spark, root, one, build).items()} == {"scales": 3, "history": 4}
    artifacts.load_or_build(spark, root, one, build)
    assert len(built) == 1 and artifacts.load(spark, root, one)["history"].count() == 4
    spark.range(1).write.mode("append").parquet(source)
    other = artifacts.fingerprint(spark, source)
    with pytest.raises(ContractError):
        artifacts.load(spark, root, other)
    artifacts.load_or_build(spark, root, other, build)
    assert other != one and len(built) == 2


def test_bad_series_are_set_aside(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = stream.isolated(path, 60_000)
    good = candles(spark, walk(30, 1))
    series = lambda name, first, last: good.withColumn("asset", F.lit(name)).where(F.col("bar_index").between(first, last))
    bars = lambda: {r.asset: r.n for r in spark.read.parquet(f"{path}/bars").groupBy("asset").agg(F.count("*").alias("n")).collect()}
    first = series("a", 0, 9).unionByName(series("b", 0, 9).where("bar_index <> 4")).unionByName(series("c", 0, 9)).unionByName(series("c", 3, 3))
    for _ in range(2):
        write(first, 0)
        assert bars() == {"a": 10}
    reasons = {r.asset: r.reason for r in spark.read.parquet(f"{path}/quarantine").select("asset", "reason").distinct().collect()}
    assert reasons == {"b": "a gap inside the batch", "c": "a repeated bar"}
    # b comes whole, a leaves a gap, d has a high below its low
    second = series("b", 0, 9).unionByName(series("a", 11, 19)).unionByName(series("d", 0, 3).withColumn("high", F.lit(-1.0)))
    write(second, 1)
    assert bars() == {"a": 10, "b": 10}
    write(series("a", 8, 19), 2)
    write(series("a", 8, 19), 2)
    assert bars() == {"a": 20, "b": 10}
    versions = {(r.asset, r.batch): r.bars for r in spark.read.parquet(f"{path}/versions").collect()}
    assert versions == {("a", 0): 10, ("b", 1): 10, ("a", 2): 10}


def test_stream_with_a_long_look_back_and_quiet_series(spark, tmp_path):
    c = candles(spark, walk(420, 3))
    other = candles(spark, walk(160, 5)).withColumn("asset", F.lit("quiet"))
    # a watermark begins at 1970: a bar of that moment would be late
    both = c.unionByName(other).withColumns({n: F.col(n) + 86_400_000 for n in ("open_time", "close_time")})
    both.limit(0).write.parquet(f"{tmp_path}/in")
    for a in range(0, 420, 140):
        both.where((F.col("bar_index") >= a) & (F.col("bar_index") < a + 140)).write.mode("append").parquet(f"{tmp_path}/in")
        out = stream.follow(spark.readStream.schema(both.schema).parquet(f"{tmp_path}/in"), 30, 100, RELAXED, quiet_ms=60 * 60_000)
        got = stream.run_available(spark, out, f"{tmp_path}/q")
    want = trace.trace(signals.detect(both, 100, RELAXED), both, 30)
    key = lambda df: sorted(tuple(r) for r in df.select("asset", "signal_id", "status").collect())
    # the series that went on is not censored yet, the quiet one is
    assert key(got) == key(want.where("status <> 'right_censored' OR asset = 'quiet'"))
    assert want.where("status = 'right_censored' AND asset = 'quiet'").count() > 0 and got.count() > 15


def test_forest_quantiles_equal_plain_weights(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(300, 2))
    rows = spark.createDataFrame([(k, float(a), float(b), float(np.round(3 * a + rng.normal() * b, 1))) for k, (a, b) in enumerate(x)], "id long, a double, b double, y double")
    train, asked = rows.where("id < 240"), rows.where("id >= 240").withColumnRenamed("id", "query_id")
    model = forests.fit_forest(train, ["a", "b"], "y", trees=7, depth=4)
    own, theirs = forests.leaves(model, train, "id", "y"), forests.leaves(model, asked, "query_id")
    got = {r.query_id: (r.q10, r.q50, r.q90) for r in forests.forest_quantiles(theirs, forests.leaf_values(own, "y"), (0.1, 0.5, 0.9)).collect()}
    held = {}
    for r in own.collect():
        held.setdefault((r.tree, r.leaf), []).append(r.y)
    for q in {r.query_id for r in theirs.collect()}:
        weight = {}
        for r in theirs.where(F.col("query_id") == q).collect() if q < 246 else ():
            for y in held[r.tree, r.leaf]:
                weight[y] = weight.get(y, 0.0) + 1 / len(held[r.tree, r.leaf]) / 7
        if weight:
            ys = sorted(weight)
            upto = np.cumsum([weight[y] for y in ys])
            assert upto[-1] == pytest.approx(1) and got[q] == tuple(ys[int(np.searchsorted(upto, p - 1e-9))] for p in (0.1, 0.5, 0.9))
    assert len(got) == 60 and forests.fit_forest(train.limit(0), ["a"], "y") is None


def test_stack_learns_out_of_fold(spark):
    rng = np.random.default_rng(2)
    data = []
    for g in range(80):
        # the label follows the group alone, and a column tells the groups apart: only a model that saw the group knows it
        for k in range(5):
            data.append((g * 10 + k, f"g{g}", float(g), float(rng.normal()), float(g % 2)))
    rows = spark.createDataFrame(data, "id long, grp string, a double, b double, y double")
    told = forests.out_of_fold(rows, {"one": ["a", "b"]}, {"y": "chance"}, "grp", folds=3, trees=8, depth=8).toPandas()
    seen = forests.predict_stack(rows, forests.fit_stack(rows, {"one": ["a", "b"]}, {"y": "chance"}, "grp", folds=2, trees=8, depth=8, rounds=3), ["one"], {"y": "chance"}).toPandas()
    assert ((seen.one_y - seen.y) ** 2).mean() < 0.18 < 0.22 < ((told.one_y - told.y) ** 2).mean()
    assert told.groupby("grp").id.count().eq(5).all() and seen.stacked_y.between(0, 1).all()


def test_stack_is_no_worse_than_its_base(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    chance = 1 / (1 + np.exp(-1.5 * x[:, 0] - 1.5 * x[:, 1]))
    data = [(k, f"g{k // 2}", *map(float, x[k]), float(rng.uniform() < chance[k]), float(np.abs(x[k, 2]) * 5 + rng.uniform()), 1.0) for k in range(900)]
    rows = spark.createDataFrame(data, "id long, grp string, a double, b double, c double, y double, loss double, support double")
    train, test = rows.where("id < 600"), rows.where("id >= 600")
    systems, targets = {"one": ["a", "c"], "two": ["b", "c"]}, {"y": "chance", "loss": "amount"}
    stack = forests.fit_stack(train, systems, targets, "grp", support=["support"], folds=2, rounds=15)
    told = forests.predict_stack(test, stack, list(systems), targets).toPandas()
    brier = lambda c: ((told[c] - told.y) ** 2).mean()
    assert brier("stacked_y") < min(brier("one_y"), brier("two_y")) and (told.stacked_loss >= 0).all()
    attached = forests.attach_support(test.select("id"), test.select("id", "support"), "id")
    assert attached.count() == 300
    with pytest.raises(Exception, match="no single support row"):
        forests.attach_support(test.select("id"), test.where("id > 700").select("id", "support"), "id").collect()


def test_caps_weights_and_guards(spark):
    rows = spark.createDataFrame([(k, f"e{k % 7}", "ab"[k % 11 == 0], k) for k in range(100)], "id long, episode string, kind string, at long")
    picked = folds.spread(rows, 5, ["kind"], ["at"]).collect()
    for kind in "ab":
        own = [r.at for r in rows.where(F.col("kind") == kind).orderBy("at").collect()]
        assert sorted(r.at for r in picked if r.kind == kind) == [own[i] for i in sorted({int(np.floor(k * (len(own) - 1) / 4)) for k in range(5)})]
    assert [r.at for r in folds.spread(rows, 1, [], ["at"]).collect()] == [0]
    assert folds.stratified_cap(rows, 30, ["kind"], ["at"], ["id"]).count() == 30 and folds.stratified_cap(rows, 100, ["kind"], ["at"], ["id"]).count() == 100
    assert folds.stratified_cap(rows, 1, ["kind"], ["at"], ["id"]).count() == 1
    weights = folds.age_balanced_weights(rows, "episode", "kind").toPandas()
    assert weights.weight.mean() == pytest.approx(1) and weights.groupby("kind").weight.sum().round(9).nunique() == 1
    assert weights.groupby(["kind", "episode"]).weight.sum().groupby("kind").nunique().max() <= 2
    folds.require_disjoint(rows.where("id < 5"), rows.where("id > 5"), "id")
    folds.require_known(rows, "kind", ["a", "b"])
    with pytest.raises(ContractError, match="in both"):
        folds.require_disjoint(rows, rows.where("id = 3"), "id")
    with pytest.raises(ContractError, match="unknown kind"):
        folds.require_known(rows, "kind", ["a"])


def test_age_support(spark):
    rows = spark.createDataFrame([(k,) for k in (1, 2, 4, 6, 9)], "a int")
    got = {r.a: (r.s.status, r.s.lower, r.s.upper) for r in rows.select("a", age_support(F.col("a"), (2, 6)).alias("s")).collect()}
    assert got == {1: ("outside_sampled_age", None, 2), 2: ("exact_sampled_age", 2, 2), 4: ("between_sampled_ages", 2, 6), 6: ("exact_sampled_age", 6, 6), 9: ("outside_sampled_age", 6, None)}
    assert rows.select(age_support(F.col("a"), ()).status.alias("s")).distinct().first().s == "unknown"
    assert [r.b for r in rows.orderBy("a").select(age_bucket(F.col("a"), ((1, 4, "early"), (5, 9, "late"))).alias("b")).collect()] == ["early"] * 3 + ["late"] * 2
    with pytest.raises(Exception, match="no bucket for the age 9"):
        rows.select(age_bucket(F.col("a"), ((1, 8, "early"),))).collect()


@pytest.mark.parametrize("block", (4, 7, 64))
def test_windows_at_block_edges(spark, block):
    c = candles(spark, walk(60, 2))
    closes = {r.bar_index: r.close for r in c.collect()}
    asked = [(f"r{a}-{b}", "A", "1m", a, b) for a, b in ((0, 0), (3, 4), (6, 20), (0, 59), (58, 70), (70, 80), (5, 4))]
    name = c.first()
    requests = spark.createDataFrame([(r, name.asset, name.timeframe, a, b) for r, _, _, a, b in asked], "rid string, asset string, timeframe string, first long, last long")
    got = {r.rid: [(b.i, b.close) for b in r.bars] for r in windows.sliced(requests, windows.written(c, block), block).collect()}
    assert got == {r: want for r, _, _, a, b in asked if (want := [(i, closes[i]) for i in range(a, b + 1) if i in closes])}


def test_short_windows_are_padded_in_front(spark):
    bars = F.array(*(F.struct(F.lit(k).alias("i"), *(F.lit(float(10 + k)).alias(c) for c in windows.BAR)) for k in range(3)))
    row = spark.range(1).select(windows.raw_window(bars, 5, F.lit(10.0), F.lit(1), F.lit(2.0), F.lit(1)).alias("w")).first().w
    assert [p.present for p in row] == [0, 0, 1, 1, 1] and [p.after_signal for p in row] == [0, 0, 0, 1, 1] and row[2].change == 0 and row[3].change == pytest.approx(np.log(1.1) * 100)
    assert stats.MAD_TO_STD == 1.4826


def test_more_columns_and_most_bars(spark, tmp_path):
    open(f"{tmp_path}/a.csv", "w").write("open_time,open,high,low,close,volume,close_time,q,n,b,t,i\n" + "".join(f"{k * 60_000},1,2,0.5,1.5,{k},{k * 60_000 + 59_999},{k * 2},3,4,5,0\n" for k in range(9)))
    from tidemark.sources import candles as C

    got = C.read_csv(spark, f"{tmp_path}/a.csv", "A", "1m", 60_000, begin_ms=60_000, more=["quote_asset_volume", "number_of_trades"], most=3)
    assert [(r.bar_index, r.quote_asset_volume, r.number_of_trades) for r in got.orderBy("bar_index").collect()] == [(0, 2.0, 3), (1, 4.0, 3), (2, 6.0, 3)]


def test_reports(spark, tmp_path):
    import gzip
    import json

    from tidemark.sources import reports

    rows = spark.createDataFrame([(1, float("nan"), "x"), (2, float("inf"), None), (3, 0.5, "y")], "k int, v double, s string").coalesce(1)
    for _ in range(2):
        reports.write_json(rows, f"{tmp_path}/j")
        reports.write_csv(rows, f"{tmp_path}/c")
    (one,), (two,) = list((tmp_path / "j").glob("part*")), list((tmp_path / "c").glob("*.csv.gz"))
    assert [json.loads(x) for x in one.read_text().splitlines()] == [{"k": 1, "v": None, "s": "x"}, {"k": 2, "v": None, "s": None}, {"k": 3, "v": 0.5, "s": "y"}]
    assert gzip.decompress(two.read_bytes()).decode().splitlines()[0] == "k,v,s"


def test_states_that_cannot_be_observed(spark):
    from tidemark.operators import library

    schema = "asset string, direction string, elapsed_bars double, current_move_pct double, peak_move_pct double, drawdown_pct double, volume_ratio_to_signal double"
    good = ("A", "lower_wick", 3.0, 1.0, 2.0, 1.0, 0.5)
    row = library.observable_state(spark.createDataFrame([good], schema), ["A", "B"]).first()
    assert row.elapsed_log_bars == pytest.approx(np.log(4)) and (row.asset_A, row.asset_B, row.direction_is_lower) == (1, 0, 1)
    for at, value, name in ((0, "C", "asset"), (1, None, "direction"), (2, -1.0, "elapsed_bars"), (3, 0.0, "current_move_pct"), (4, float("nan"), "peak_move_pct"), (5, -0.1, "drawdown_pct"), (6, None, "volume_ratio_to_signal")):
        with pytest.raises(Exception, match=f"not an observable state: {name}"):
            library.observable_state(spark.createDataFrame([(*good[:at], value, *good[at + 1 :])], schema), ["A", "B"]).collect()


def test_too_few_neighbours_are_an_error(spark):
    from tidemark.operators import knn

    found = spark.createDataFrame([("q", k) for k in range(3)], "query_id string, place int")
    assert knn.require_k(found, 3).count() == 3
    with pytest.raises(Exception, match="fewer neighbours than wanted: q"):
        knn.require_k(found, 4).collect()
