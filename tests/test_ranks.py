import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldscope.operators import profile, ranks


@pytest.fixture(scope="module")
def skewed(build):
    """Ties everywhere; a third of the first column is one value."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 60, size=(900, 3)).astype(float)
    x[:300, 0] = 11.0
    return build(x, draw.integers(0, 40, 900).astype(float)), x


def expected(x, y):
    both = np.column_stack([y, x])
    return np.column_stack([pd.Series(c).rank().to_numpy() for c in both.T])


@pytest.mark.parametrize("range_rows", [None, 100])
@pytest.mark.parametrize("cells", [None, 0, 100])
def test_rank_spots_match_pandas(skewed, monkeypatch, range_rows, cells):
    obs, x = skewed
    if cells is not None:                      # forces the hot / cold join, salted or broadcast
        monkeypatch.setattr(ranks, "BROADCAST_CELLS", cells)
        monkeypatch.setattr(ranks, "HOT_SHARE", 10)
    got = ranks.rank_spots(obs, 900, range_rows).orderBy("row_id").toPandas()
    y = obs.df.orderBy("row_id").toPandas()["y"]
    spots = np.array(got["spots"].tolist())
    assert len(got) == 900
    assert np.allclose((spots + 1) / 2, expected(x, y))
    assert np.allclose(((spots + 1) / 2).sum(axis=0), 900 * 901 / 2)


@pytest.mark.parametrize("range_rows", [None, 50])
def test_quartiles_are_interpolated(skewed, range_rows, monkeypatch):
    obs, x = skewed
    if range_rows:
        monkeypatch.setattr(ranks, "RANGE_ROWS", range_rows)
    got = profile.quartiles(obs.long(), "idx", 900).orderBy("idx").toPandas()
    want = np.quantile(x, [0.25, 0.5, 0.75], axis=0).T
    assert np.allclose(got[["q25", "q50", "q75"]], want)


@pytest.mark.parametrize("accuracy", [20, 60])
def test_quartiles_from_brackets(skewed, accuracy, monkeypatch):
    obs, x = skewed
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    got = profile.quartiles(obs.long(), "idx", 900).orderBy("idx").toPandas()
    assert np.allclose(got[["q25", "q50", "q75"]], np.quantile(x, [0.25, 0.5, 0.75], axis=0).T)


def test_bracketed_quantiles_of_uneven_keys(spark):
    """Nulls, keys of few rows and none, outer and overlapping shares, values that fill a bracket."""
    draw = np.random.default_rng(2)
    columns = {0: draw.normal(size=30_000), 1: draw.integers(0, 50, 25_000).astype(float),
               2: draw.normal(size=7), 3: np.where(draw.random(40_000) < 0.6, 1.5, draw.normal(size=40_000)), 4: np.array([3.0])}
    frame = pd.DataFrame([(k, float(v)) for k, c in columns.items() for v in c], columns=["idx", "value"])
    long = spark.createDataFrame(frame).repartition(6).unionByName(
        spark.sql("SELECT 1L AS idx, CAST(NULL AS DOUBLE) AS value UNION ALL SELECT 5L, NULL"))
    shares = {"top": 1.0, "low": 0.0, "a": 0.3, "b": 0.3005, "c": 0.95, "edge": 0.0005}
    got = profile.quantiles(long, "idx", 40_000, shares).orderBy("idx").toPandas()
    assert list(got.columns) == ["idx", *shares] and list(got["idx"]) == [0, 1, 2, 3, 4]
    for k, c in columns.items():
        assert np.allclose(got.loc[k, list(shares)].astype(float), np.quantile(c, list(shares.values())))


def test_only_values_in_brackets_are_kept(spark):
    long = spark.range(200_000).select((F.col("id") % 2).alias("idx"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"))
    cells, totals = profile._bracketed(long, "idx", 100_000, [0.25, 0.5, 0.75])
    assert cells.count() < 2_000 and totals.count() == 2
    assert cells.agg(F.sum("cnt")).first()[0] == 200_000
    want = long.toPandas().groupby("idx")["value"].quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose(profile.quartiles(long, "idx", 100_000).orderBy("idx").toPandas()[["q25", "q50", "q75"]], want)


def test_describe_exact_and_approximate(skewed):
    obs, x = skewed
    got = profile.describe(obs, 900).toPandas().set_index("feature").loc[list(obs.names)]
    assert np.allclose(got["std"], x.std(axis=0, ddof=1)) and np.allclose(got["max"], x.max(axis=0))
    near = profile.describe(obs, 900, approximate=True).toPandas().set_index("feature")
    assert np.allclose(near.loc[list(obs.names), "q50"], got["q50"], atol=1)


def test_ranked_averages_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0)], "f string, v double")
    up = {r["f"]: r["rank"] for r in ranks.ranked(df, "v").collect()}
    down = {r["f"]: r["rank"] for r in ranks.ranked(df, "v", descending=True).collect()}
    assert up == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
    assert down == {"a": 4.0, "b": 2.5, "c": 2.5, "d": 1.0}


def test_positions_do_not_depend_on_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 10007).alias("k"))
    plain = {r["k"]: r["position"] for r in ranks.row_positions(df, "k", 500).collect()}
    cut = {r["k"]: r["position"] for r in ranks.row_positions(df, "k", 500, range_rows=40).collect()}
    assert plain == cut == {k: i for i, k in enumerate(sorted(plain))}


def test_a_key_of_several_rows_is_an_error(build):
    from pyspark.sql import functions as F

    from yieldscope.operators.ranks import rank_spots

    obs = build([[1.0], [2.0], [3.0]], [1.0, 2.0, 3.0])
    twice = obs.with_df(obs.df.withColumn("row_id", F.least("row_id", F.lit(1))))
    assert rank_spots(obs, 3).count() == 3
    with pytest.raises(Exception, match="not unique"):
        rank_spots(twice, 3).collect()


def test_textual_keys_are_hashed(spark):
    from yieldscope.sources.observations import from_wide

    wide = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "unit string, y double, `s.p` double")
    keys = [r.row_id for r in from_wide(wide, "y", row_id="unit").df.collect()]
    assert len(set(keys)) == 2 and None not in keys


def test_text_ranks_in_range_partitions(spark, monkeypatch):
    """One group holds half the rows, a value a third of them; ties, nulls, several partitions."""
    draw = np.random.default_rng(5)
    rows = [("a" if i % 2 else f"g{i % 7}", "same" if i % 3 == 0 else f"w{draw.integers(0, 400):03d}", i) for i in range(1500)]
    frame = pd.DataFrame(rows, columns=["g", "t", "i"])
    frame.loc[[4, 8], "t"] = None
    frame.loc[[9, 12], "g"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, t string, i int")
    want = frame.groupby("g")["t"].rank(method="average")
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", 1000)
    for range_rows in (None, 60):
        got = ranks.average_ranks(df, "t", ["g"], range_rows=range_rows).toPandas().set_index("i")["rank"].sort_index()
        assert len(got) == 1500 and np.allclose(got, want, equal_nan=True)
    placed = ranks.counts_before(df, ["g"], "t", 1500, range_rows=60)
    plain = ranks.counts_before(df, ["g"], "t", 1500)
    assert sorted(map(str, placed.collect())) == sorted(map(str, plain.select(*placed.columns).collect()))
    largest = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < placed.count() / 2
    empty = ranks.average_ranks(df.filter("i < 0"), "t", ["g"], range_rows=60)
    assert empty.count() == 0 and empty.columns == ["g", "t", "i", "rank"]


def test_many_classes_are_joined_with_hot_ones_apart(spark, monkeypatch):
    from yieldscope.operators import scale

    texts = [None if i % 50 == 0 else "hot" if i % 2 else f"c{i * 7919 % 311:03d}" for i in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    codes = {t: k for k, t in enumerate(sorted(set(texts) - {None}))}
    plain = {r["i"]: r["label"] for r in scale.label_encode(df, "t").collect()}
    monkeypatch.setattr(scale, "CLASS_LIMIT", 10)
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", 100)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    cut = {r["i"]: r["label"] for r in scale.label_encode(df, "t").collect()}
    assert plain == cut == {i: codes[t] for i, t in enumerate(texts) if t is not None}


def test_hot_values_of_many_features_are_dealt_evenly(build, monkeypatch):
    """1,200 features, one value on half the rows of each."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 1000, size=(200, 1200)).astype(float)
    x[::2] = 500.0
    obs = build(x, draw.normal(size=200))
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", 100_000)
    got = ranks.rank_spots(obs, 200).orderBy("row_id").toPandas()
    y = obs.df.orderBy("row_id").toPandas()["y"]
    assert np.allclose((np.array(got["spots"].tolist()) + 1) / 2, expected(x, y))
    shares = ranks.salted(obs.long()).filter("value = 500").groupBy("idx", "__salt").count()
    assert shares.agg(F.max("count")).first()[0] < 25          # 100 or more without salt
    assert shares.select("__salt").distinct().count() == ranks.SALTS


def test_ranges_are_counted_from_the_plain_rows(spark):
    draw = np.random.default_rng(21)
    value = np.where(draw.random(2000) < 0.3, 5.0, draw.integers(0, 700, 2000))
    plain = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(value)], "idx int, value double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    dear = plain.mapInArrow(counted, "idx int, value double")
    want = ranks.counts_before(plain, ["idx"], "value", 2000).orderBy("idx", "value").collect()
    got = ranks.counts_before(dear, ["idx"], "value", 2000, range_rows=150, n_keys=2, plain=plain).orderBy("idx", "value")
    got = [tuple(r) for r in got.select("idx", "value", "cnt", "before").collect()]
    assert got == [tuple(r) for r in want]
    assert read.value <= 2 * 2000       # once for the table, once more for the order asked for here


def test_the_table_of_values_is_worked_out_once(spark, monkeypatch):
    """Hot and other values are read from one written table."""
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(ranks, "HOT_SHARE", 10)
    worked_out = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked_out.add(len(batch))
            yield batch

    rows = spark.range(400).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).cast("double").alias("value"))
    table = rows.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).mapInPandas(counted, "value double, cnt bigint")
    for share in (1, 10):  # 1: hot values are too few to tell, 10: those of a tenth are told apart
        worked_out.value = 0
        monkeypatch.setattr(ranks, "HOT_SHARE", share)
        assert ranks.attach_by_value(rows, table, ["value"], 400, 400).selectExpr("sum(cnt)").first()[0] == 200 * 200 + 200
        assert worked_out.value == 201
