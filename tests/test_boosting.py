import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.models import boosting, histogram, samme
from plantpulse.models.boosting import (
    Head, HistogramRegressor, Rules, SoftmaxClassifier, boost, gradients, grid_errors, root_cells,
)
from plantpulse.models.catalog import assemble
from plantpulse.models.forest import BINS, BalancedForest, MeanForest, bootstrap, counted_out
from plantpulse.models.histogram import TreeModel, bin_edges, binned, fixed_point_bits, row_draw, uniform
from plantpulse.models.samme import fit_samme

DRIVERS = ["a", "b", "c"]


def table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float), "c": rng.uniform(size=n), "seq": range(n),
    })
    pdf["y"] = np.sin(2 * pdf.a) + 0.3 * (pdf.b > 4) + 0.1 * rng.normal(size=n)
    pdf["label"] = np.select([pdf.a + 0.2 * pdf.b < 0.4, pdf.a + 0.2 * pdf.b < 1.6], [0.0, 1.0], 2.0)
    pdf["weight"] = np.where(pdf.label == 2, 2.0, 1.0)
    return pdf


@pytest.fixture(scope="module")
def rows(spark):
    pdf = table()
    return pdf, assemble(spark.createDataFrame(pdf), DRIVERS)


def plain_tree(bins, g, h, use, features, depth, penalty, least, width):
    """The same tree with float sums: (feature, cut, value) by heap node."""
    out, todo = {}, [(1, use, 0)]
    while todo:
        node, mask, level = todo.pop()
        gs, hs = g[mask].sum(), h[mask].sum()
        out[node] = (-1, 0, -gs / (hs + penalty))
        best = (1e-9, None)
        for f in features if level < depth else []:
            for cut in range(width):
                left = mask & (bins[:, f] <= cut)
                right = mask & ~left
                if left.any() and right.any() and h[left].sum() >= least and h[right].sum() >= least:
                    gain = (g[left].sum() ** 2 / (h[left].sum() + penalty) + g[right].sum() ** 2 / (h[right].sum() + penalty)
                            - gs**2 / (hs + penalty))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
        if best[1]:
            f, cut = best[1]
            out[node] = (f, cut, out[node][2])
            left = mask & (bins[:, f] <= cut)
            todo += [(2 * node, left, level + 1), (2 * node + 1, mask & ~left, level + 1)]
    return out


def plain_value(tree, row):
    node = 1
    while tree[node][0] >= 0:
        node = 2 * node + int(row[tree[node][0]] > tree[node][1])
    return tree[node][2]


def draws_of(df, seed):
    found = df.select("seq", row_draw(["seq"], seed).alias("d")).orderBy("seq").collect()
    return np.array([r["d"] for r in found], dtype=np.int64)


def test_regression_equals_plain_boosting(spark, rows):
    """Row draws, column draws, gains and leaves against loops over all cuts."""
    pdf, df = rows
    model = HistogramRegressor("y", ["seq"], maxIter=5, maxDepth=3, stepSize=0.3, columnRate=0.7).fit(df.repartition(3))
    x = pdf[DRIVERS].to_numpy()
    edges = bin_edges(df, 256)
    bins, y, draw = binned(x, edges), pdf.y.to_numpy(), draws_of(df, 42)
    assert [len(e) for e in edges][1] == 8 and len(model.rounds) == 5
    margin = np.full(len(y), y.mean())
    for at in range(5):
        features = sorted(np.random.default_rng([42, at]).choice(3, 2, replace=False).tolist())
        use = uniform(draw, at) < 0.85
        assert 0.75 < use.mean() < 0.95
        tree = plain_tree(bins, margin - y, np.ones(len(y)), use, features, 3, 1.0, 1.0, max(map(len, edges)) + 1)
        margin = margin + 0.3 * np.array([plain_value(tree, row) for row in bins])
    assert np.allclose(model.predict(x), margin, atol=1e-6)
    got = model.transform(df).orderBy("seq").toPandas()
    assert np.allclose(got.prediction, margin, atol=1e-6)
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-12
    again = TreeModel.from_json(model.to_json())
    assert np.array_equal(again.predict(x), model.predict(x))


def test_softmax_trees_share_one_scale_and_the_loss_falls(rows):
    pdf, df = rows
    y, w = pdf.label.to_numpy(), pdf.weight.to_numpy()
    x = pdf[DRIVERS].to_numpy()
    for newton in (True, False):
        model = SoftmaxClassifier("label", "weight", 3, ["seq"], maxIter=6, maxDepth=2, stepSize=0.3, newton=newton).fit(df)
        losses = []
        for n in range(len(model.rounds) + 1):
            part = TreeModel(model.edges, model.base, model.rounds[:n], model.gains, True)
            m = part.margins(x)
            p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
            losses.append(-(w * np.log(p[np.arange(len(y)), y.astype(int)])).sum())
        assert all(b < a for a, b in zip(losses, losses[1:])) and losses[0] == pytest.approx(w.sum() * np.log(3))
        assert all(len(trees) == 3 for trees in model.rounds)
        called = model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert called > 0.8
    g, h = gradients(np.zeros((1, 3)), np.array([1.0]), np.array([2.0]), Rules(1, softmax=True, curvature=2.0))
    assert np.allclose(g, [[2 / 3, -4 / 3, 2 / 3]]) and np.allclose(h, 2 * 2 * 2 / 9)


def test_fits_do_not_depend_on_partitions(rows, monkeypatch):
    """Two and sixteen partitions with a shuffle a level, and few rows in one without any."""
    _, df = rows
    for make in (
        lambda: BalancedForest("label", 3, ["seq"], numTrees=6, maxDepth=4),
        lambda: HistogramRegressor("y", ["seq"], maxIter=3, maxDepth=3),
    ):
        few = make().fit(df).to_json()
        with monkeypatch.context() as m:
            m.setattr(histogram, "FEW_ROWS", 0)
            assert few == make().fit(df.repartition(2)).to_json() == make().fit(df.repartition(16)).to_json()


def test_a_level_shuffles_once_at_most(rows, monkeypatch):
    _, df = rows
    for few, shuffles in ((histogram.FEW_ROWS, 0), (0, 1)):
        monkeypatch.setattr(histogram, "FEW_ROWS", few)
        held = histogram.training_rows(df, bin_edges(df, 8), {"y": F.col("y")}, ["seq"], 1, "t")
        asked = []
        monkeypatch.setattr(type(df), "collect", lambda self: asked.append(self) or [])
        histogram.best_splits(
            histogram.partial_cells(held, lambda b: iter(()), ["n"]), ["n"], lambda left, right, total: left("n"), "n", 1
        )
        monkeypatch.undo()
        assert asked[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == shuffles
        held.drop()


def test_forest_root_equals_plain_gini_on_its_bootstrap(rows):
    pdf, df = rows
    model = BalancedForest("label", 3, ["seq"], numTrees=4, maxDepth=1, minInstancesPerNode=5).fit(df)
    bins, draw, y = binned(pdf[DRIVERS].to_numpy(), bin_edges(df, BINS)), draws_of(df, 42), pdf.label.to_numpy().astype(int)
    for number, (tree,) in enumerate(model.rounds):
        count = bootstrap(draw, number)
        assert 0.8 < count.mean() < 1.2
        n = np.bincount(y, count, 3)
        mass = count * (n.sum() / (3 * n))[y]
        f = int(tree.feature[1])

        def purity(use):
            m = np.bincount(y[use], mass[use], 3)
            return (m**2).sum() / m.sum()

        gains = {}
        for cut in range(BINS):
            left = bins[:, f] <= cut
            if min((count[left] > 0).sum(), (count[~left] > 0).sum()) >= 5:
                gains[cut] = purity(left) + purity(~left)
        assert gains[int(tree.cut[1])] == pytest.approx(max(gains.values()))
        left = np.bincount(y[bins[:, f] <= tree.cut[1]], mass[bins[:, f] <= tree.cut[1]], 3)
        assert tree.value[2] * 4 == pytest.approx(left / left.sum())
        assert np.allclose(np.bincount(y, mass, 3), n.sum() / 3)  # every class weighs the same in each bootstrap


def test_forest_learns_the_classes(rows):
    _, df = rows
    model = BalancedForest("label", 3, ["seq"], numTrees=25, maxDepth=8).fit(df)
    assert model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.8


def test_grid_cells_equal_separate_fits(rows):
    """All cells grown together, and one cell grown alone on its fold."""
    pdf, df = rows
    block = F.when(F.col("seq") < 200, 0).when(F.col("seq") < 350, 1).otherwise(2)
    settings = [{"maxDepth": 2, "stepSize": 0.3}, {"maxDepth": 3, "stepSize": 0.5}]
    found = grid_errors(df, "y", ["seq"], block, settings, 2, 3, 42)
    rules = Rules(3, row_share=0.85, column_share=0.85, seed=42)
    for setting, row in zip(settings, found):
        alone = boost(df, F.col("y"), [Head(setting["maxDepth"], setting["stepSize"], 1)], rules, ["seq"], block=block)
        error = alone.rows.rows.filter("block = 2").agg(F.avg(F.abs(F.col("y") - F.col("margins")[0]))).first()[0]
        alone.rows.drop()
        both = boost(df, F.col("y"), [Head(setting["maxDepth"], setting["stepSize"], 0)], rules, ["seq"], block=block)
        first = both.rows.rows.filter("block = 1").agg(F.avg(F.abs(F.col("y") - F.col("margins")[0]))).first()[0]
        both.rows.drop()
        assert row["mae_cv"] == pytest.approx((error + first) / 2, rel=1e-6)


def test_levels_of_drawn_rounds_run_over_cells(rows, monkeypatch):
    """Rows of equal bins go through the levels as one, whose sums are those of the drawn rows; in any parts the same trees."""
    pdf, df = rows
    few = assemble(df.select("seq", "y", "b"), ["b"])
    seen, first, plain = [], [], boosting.settled

    def watched(blocks, *rest):
        seen.append(blocks.map(lambda b: len(b["bins"])).sum())
        found = plain(blocks, *rest)
        first.extend(sums for (_, node), (sums, _) in found if node == 1)
        return found

    make = lambda: HistogramRegressor("y", ["seq"], maxIter=6, maxDepth=2)
    with monkeypatch.context() as m:
        m.setattr(boosting, "settled", watched)
        model = make().fit(few)
    assert set(seen) == {9}
    draws = draws_of(df, 42)
    assert [s[2] for s in first] == [(uniform(draws, at) < 0.85).sum() for at in range(6)]
    y, use = pdf.y.to_numpy(), uniform(draws, 0) < 0.85
    assert first[0][0] / first[0][1] == pytest.approx((y.mean() - y[use]).mean(), abs=1e-6)
    with monkeypatch.context() as m:
        m.setattr(boosting, "PACKED_ROWS", 50)
        m.setattr(histogram, "FEW_ROWS", 0)
        assert model.to_json() == make().fit(few.repartition(7)).to_json()
        m.setattr(histogram, "DIRECT_BYTES", 0)
        assert model.to_json() == make().fit(few.repartition(3)).to_json()


def test_cells_add_up_and_bits_leave_room(rows):
    pdf, df = rows
    cells = root_cells(df, "y", ["seq"], Rules(1)).toPandas()
    for f, part in cells.groupby("feature"):
        assert part.n.sum() == len(pdf) and part.h.sum() == pytest.approx(len(pdf))
        assert abs(part.g.sum()) < 1e-5
    assert fixed_point_bits(500) == 30 and fixed_point_bits(2**40) == 22


def test_constant_target_and_missing_values(spark):
    df = spark.createDataFrame([(n, float(n % 5), None if n % 7 == 0 else 1.0) for n in range(50)], "seq long, a double, y double")
    flat = assemble(df.withColumn("y", F.lit(2.0)).withColumn("a", F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(F.col("a"))),
                    ["seq"])
    model = HistogramRegressor("y", ["seq"], maxIter=2, maxDepth=2).fit(flat)
    assert {r["prediction"] for r in model.transform(flat).collect()} == {2.0}
    with pytest.raises(ValueError):
        HistogramRegressor("y", ["seq"]).fit(flat.limit(0))
    with pytest.raises(ValueError):
        HistogramRegressor("y").setParams(depth=3)


def test_rows_of_one_partition_are_dealt_out(rows, monkeypatch):
    """A small file is one partition of the scan; its rows use the cores, and a node's sums are one row a task."""
    _, df = rows
    monkeypatch.setattr(histogram, "FEW_ROWS", 100)
    held = histogram.training_rows(df.coalesce(1), bin_edges(df, 8), {"y": F.col("y")}, ["seq"], 1, "t")
    assert held.rows.rdd.getNumPartitions() == 4 and held.rows.count() == df.count()
    held.drop()


def test_best_splits_add_up_whole_nodes(rows):
    """Cells of one node from several tasks, of equal gains the lowest variable and bin, and a node without a split."""
    _, df = rows
    held = histogram.training_rows(df, bin_edges(df, 8), {"y": F.col("y")}, ["seq"], 1, "t")

    def add_up(batches):
        for _ in batches:
            for _ in range(2):
                code = np.array([0, 2, histogram.CODES, histogram.CODES + 5, 3])
                n = np.array([3, 1, 3, 1, 4])
                yield histogram.node_rows(0, np.array([2, 2, 2, 2, 3]), code, {"n": n})

    found = histogram.best_splits(
        histogram.partial_cells(held, add_up, ["n"]), ["n"], lambda left, right, total: 1.0 * left("n"), "n", 2
    )
    held.drop()
    assert [(r["tree"], r["node"], r["n"]) for r in sorted(found)] == [(0, 2, 8), (0, 3, 8)]
    assert sorted(found)[0]["best"].asDict() == {"feature": 0, "bin": 0, "gain": 6.0, "l_n": 6} and sorted(found)[1]["best"] is None


def test_value_forest_equals_plain_variance_on_its_bootstraps(rows, monkeypatch):
    """Roots against loops over all cuts; the same trees from counted cells of any partitions."""
    pdf, df = rows
    make = lambda depth: MeanForest("y", ["seq"], numTrees=4, maxDepth=depth, minInstancesPerNode=5)
    model = make(1).fit(df)
    bins, draw, y = binned(pdf[DRIVERS].to_numpy(), bin_edges(df, 256)), draws_of(df, 42), pdf.y.to_numpy()
    for number, (tree,) in enumerate(model.rounds):
        count = bootstrap(draw, number)
        gains = {}
        for f in range(3):
            for cut in range(256):
                left = bins[:, f] <= cut
                if min(count[left].sum(), count[~left].sum()) >= 5:
                    shifted = y - (count * y).sum() / count.sum()
                    gains[f, cut] = sum((count[u] * shifted[u]).sum() ** 2 / count[u].sum() for u in (left, ~left))
        f, cut = int(tree.feature[1]), int(tree.cut[1])
        assert gains[f, cut] == pytest.approx(max(gains.values()))
        left = bins[:, f] <= cut
        assert tree.value[2, 0] * 4 == pytest.approx((count[left] * y[left]).sum() / count[left].sum(), abs=1e-6)
    deep = make(6).fit(df)
    assert deep.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0] < 0.3 * pdf.y.var()
    assert deep.featureImportances.toArray().argmax() == 0 and deep.featureImportances.toArray().sum() == pytest.approx(1)
    twice = df.withColumn("seq", F.col("seq") + 500).union(df)
    with monkeypatch.context() as m:
        m.setattr(histogram, "FEW_ROWS", 0)
        assert deep.to_json() == make(6).fit(df.repartition(3)).to_json()
        many = make(6).fit(twice).to_json()
    assert many == make(6).fit(twice).to_json() != deep.to_json()


def test_rows_of_the_same_bins_become_one_cell(rows):
    """Levels of the value forest run over cells, whose number does not grow with the rows."""
    _, df = rows
    few = assemble(df.select("seq", "y", F.col("b")), ["b"])
    edges = bin_edges(few, 256)
    held = histogram.training_rows(few, edges, {"y": F.col("y")}, ["seq"], 1, "t")
    cells = counted_out(held.rows, [0, 1], 0.0, 2.0**20, [len(e) + 1 for e in edges]).collect()
    draws = np.array([r["draw"] for r in held.rows.select("draw").collect()])
    held.drop()
    assert len(cells) == 9
    assert [sum(r["n"][i] for r in cells) for i in (0, 1)] == [bootstrap(draws, i).sum() for i in (0, 1)]


def test_a_round_is_one_short_job_a_level(spark, rows):
    """Further rounds of softmax boosting and SAMME: no second job, checkpoint or extra pass for a level."""
    _, df = rows

    def jobs(fit):
        group = f"fit-{uuid.uuid4()}"
        spark.sparkContext.setJobGroup(group, group)
        fit()
        spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    softmax = lambda n: SoftmaxClassifier("label", "weight", 3, ["seq"], maxIter=n, maxDepth=2, stepSize=0.1).fit(df)
    adaptive = lambda n: fit_samme(df, 3, rounds=n)
    for fit, first, last in ((softmax, 1, 3), (adaptive, 1, 3)):
        assert jobs(lambda: fit(last)) - jobs(lambda: fit(first)) == 2 * (last - first)


def test_sums_of_many_parts_are_shuffled_to_the_same_trees(rows, monkeypatch):
    """Equal rows counted out, in one part or many, added up by the driver or in a shuffle."""
    _, df = rows
    few = assemble(df.select("seq", "label", "weight", F.round("a", 1).alias("a"), "b"), ["a", "b"])
    many = few.union(few).union(few)
    for fit in (
        lambda d: SoftmaxClassifier("label", "weight", 3, ["seq"], maxIter=2, maxDepth=2, stepSize=0.3).fit(d),
        lambda d: fit_samme(d, 3, rounds=2),
    ):
        one = fit(many).to_json()
        with monkeypatch.context() as m:
            m.setattr(histogram, "PACKED_ROWS", 50)
            assert one == fit(many.repartition(7)).to_json()
            m.setattr(histogram, "DIRECT_BYTES", 0)
            assert one == fit(many.repartition(7)).to_json()
    held = histogram.training_rows(many, bin_edges(many, 256), {"y": F.col("label")}, ["seq"], 1, "t")
    cells = histogram.counted(held.rows.drop("draw"))
    assert cells.agg(F.sum("n")).first()[0] == 3 * df.count() and cells.count() < df.count()
    held.drop()


def test_samme_equals_plain_weighted_gini_trees(rows, monkeypatch):
    """Trees, votes and weights against loops over all cuts; the loop goes on past the kept rounds."""
    pdf, df = rows
    monkeypatch.setattr(samme, "KEEP_EVERY", 1)
    rounds = 4
    model = fit_samme(df, 3, rounds=rounds)
    bins, y, w = binned(pdf[DRIVERS].to_numpy(), bin_edges(df, 256)), pdf.label.to_numpy().astype(int), pdf.weight.to_numpy()
    w = w * len(w) / w.sum()

    def mass(use):
        return np.bincount(y[use], w[use], 3)

    def purity(use):
        return (mass(use) ** 2).sum() / max(mass(use).sum(), 1e-300)

    assert len(model.rounds) == rounds
    for (tree,) in model.rounds:
        at = {1: np.ones(len(y), bool)}
        for node in (1, 2, 3):
            f, cut = int(tree.feature[node]), int(tree.cut[node])
            if node not in at or f < 0:
                continue
            use = at.pop(node)
            best = max(purity(use & (bins[:, j] <= b)) + purity(use & (bins[:, j] > b)) for j in range(3) for b in range(256))
            at[2 * node], at[2 * node + 1] = use & (bins[:, f] <= cut), use & (bins[:, f] > cut)
            assert purity(at[2 * node]) + purity(at[2 * node + 1]) == pytest.approx(best, rel=1e-6)
        called = np.select([at[n] for n in at], [mass(at[n]).argmax() for n in at])
        error = w[called != y].sum() / w.sum()
        alpha = 0.8 * (np.log((1 - error) / error) + np.log(2))
        assert np.allclose(tree.values(bins)[np.arange(len(y)), called], alpha, rtol=1e-5)
        assert np.count_nonzero(tree.values(bins)) == len(y)
        w = w * np.where(called != y, np.exp(alpha), 1.0)
        w = w * len(w) / w.sum()
    votes = model.margins(pdf[DRIVERS].to_numpy())
    got = model.transform(df).orderBy("seq").toPandas().prediction
    assert np.array_equal(got, votes.argmax(axis=1)) and (got == y).mean() > 0.8
