"""Learning, scaling, linkage and the training fold against plain versions written from their definitions."""

import itertools

import numpy as np
import pytest

from undula import cli
from undula.functions import kernels
from undula.operators import agreement, art, summaries
from undula.sources import mat5


def straight(values, at):
    """Linear interpolation, a position at a time."""
    out = []
    for x in at:
        k = min(int(x), len(values) - 2)
        out.append(values[k] + (values[k + 1] - values[k]) * (x - k))
    return out


def even(first, last, n):
    return [first + (last - first) * k / (n - 1) if n > 1 else first for k in range(n)]


def plain_update(contour, weight, rate, warp, fixed):
    own = [x for x in weight if x > 0 and x != float("inf")]
    new = [c + rate * (contour[j] - c) for c, j in zip(own, warp, strict=True)]
    if fixed:
        return new
    size = len(own)
    target = max(1, int(round(size + rate * (len(contour) - size))))
    back = []
    for i in range(warp[-1] + 1):
        at = [k for k, j in enumerate(warp) if j == i]
        back.append(at[0] if at else back[-1] if back else 0)
    if len(back) > 1:
        stretched = straight(back, even(0, len(back) - 1, target))
        at = [min(max(w - (w - s) * rate, 0), size - 1) for w, s in zip(even(0, size - 1, target), stretched, strict=True)]
    else:
        at = [0.0] * target
    return straight(new, at) if len(new) > 1 else [new[0]] * target


def test_update_values():
    rng = np.random.default_rng(1)
    seen = set()
    for _ in range(400):
        m, n = rng.integers(1, 30, 2)
        weight = rng.uniform(1, 9, m)
        weight[rng.random(m) < 0.1] = rng.choice([0.0, np.nan, np.inf, -1.0])
        own = int(((weight > 0) & np.isfinite(weight)).sum())
        if not own:
            continue
        contour, warp = rng.uniform(1, 9, n), np.sort(rng.integers(0, n, own))
        rate, fixed = rng.choice([0.1, 0.5, 1.0]), bool(rng.random() < 0.3)
        got = kernels.update(contour, weight, rate, warp, fixed)
        want = plain_update(contour.tolist(), weight.tolist(), rate, warp.tolist(), fixed)
        assert got.tolist() == pytest.approx(want, rel=1e-12)
        seen.add((own == 1, n == 1, warp[-1] == 0, fixed))
    assert len(seen) > 6


def plain_average(weight, lengths):
    v = [x for x in weight if x > 0 and np.isfinite(x)]
    size = max(1, int(round(sum(lengths) / len(lengths))))
    return straight(v, even(0, len(v) - 1, size)) if len(v) > 1 else v * size


def test_average_values(spark):
    from undula.operators import weights

    rng = np.random.default_rng(2)
    p = [(k, rng.uniform(1, 9, n).tolist() + [float("nan")] * (k % 2)) for k, n in enumerate((1, 2, 5, 9, 30, 4))]
    c = [(i, rng.uniform(1, 9, int(n)).tolist(), i % 5) for i, n in enumerate(rng.integers(1, 40, 37))]
    df = spark.createDataFrame(c, "contour_id long, freq array<double>, category int")
    got = {r.category: r.weight for r in weights.average(spark.createDataFrame(p, "category int, weight array<double>"), df.select("contour_id", "freq"), df.select("contour_id", "category")).collect()}
    for k, w in p[:5]:
        assert got[k] == pytest.approx(plain_average(w, [len(f) for _, f, x in c if x == k]))
    assert repr(got[5]) == repr(p[5][1])


class Plain:
    """The training fold, one contour and one prototype at a time."""

    def __init__(self, contours, p):
        self.c, self.p, self.rng = contours, p, np.random.RandomState(p.seed)
        self.category, self.match, self.weights, self.history, self.converged = [None] * len(contours), [0.0] * len(contours), [], [], False

    def tried(self, i):
        """(activation, match, warp) of each prototype."""
        out = []
        for w in self.weights:
            v = kernels.valid(w)
            s, warp = kernels.dtw(v, self.c[i], self.p.warp_factor_level)
            out.append((s * (1 - self.p.bias), kernels.match(self.c[i][warp], v) if len(warp) else None, warp))
        return out

    def learn(self, i, k, warp):
        self.weights[k] = kernels.update(self.c[i], self.weights[k], self.p.learning_rate, warp, self.p.compare_warped)

    def present(self, i):
        old, found = self.category[i], self.tried(i)
        order = sorted(range(len(found)), key=lambda k: (-found[k][0], k))
        if self.p.deprioritize_lone and old is not None and self.category.count(old) == 1:
            order = [k for k in order if k != old] + [old]
        top = 0.0
        for k in order:
            _, m, warp = found[k]
            if m is None:
                continue
            top = max(top, m)
            if m > self.p.vigilance:
                self.learn(i, k, warp)
                self.category[i], self.match[i] = k, m
                break
        else:
            if len(self.weights) < self.p.max_categories:
                self.weights.append(self.c[i].copy())
                self.category[i], self.match[i] = len(self.weights) - 1, 100.0
            else:
                self.category[i], self.match[i] = None, top
        return self.category[i] != old

    def drop(self, k):
        del self.weights[k]
        self.category = [c - 1 if c is not None and c > k else c for c in self.category]

    def recat(self):
        lone = [i for i, c in enumerate(self.category) if c is not None and self.category.count(c) == 1]
        for i in (lone[k] for k in np.argsort(self.rng.randn(len(lone)))):
            own, found = self.category[i], self.tried(i)
            others = [k for k in range(len(found)) if k != own]
            if not others:
                continue
            k = max(others, key=lambda k: (found[k][0], -k))
            _, m, warp = found[k]
            if m is None or m <= self.p.vigilance:
                continue
            self.learn(i, k, warp)
            for j, c in enumerate(self.category):
                if c == own:
                    self.category[j], self.match[j] = k, m
            self.drop(own)

    def fit(self):
        for round_ in range(1, self.p.max_iterations + 1):
            changed = sum([self.present(i) for i in self.rng.permutation(len(self.c))])
            if self.p.recat_single:
                self.recat()
            if self.p.compare_warped:
                for k in range(len(self.weights)):
                    lengths = [len(self.c[i]) for i, c in enumerate(self.category) if c == k]
                    if lengths:
                        self.weights[k] = np.array(plain_average(self.weights[k], lengths))
            if self.p.purge_empty:
                for k in sorted(set(range(len(self.weights))) - set(self.category), reverse=True):
                    self.drop(k)
            self.history.append((round_, changed, len(self.weights)))
            if not changed:
                self.converged = True
                break
        return self


@pytest.mark.parametrize("flags", [dict(zip(("purge_empty", "recat_single", "compare_warped", "deprioritize_lone"), x, strict=True)) for x in itertools.product((False, True), repeat=4)])
def test_fold_equals_a_plain_fold(flags):
    rng = np.random.default_rng(9)
    base = [rng.random(n) * 200 + 50 for n in (7, 9, 14, 16, 25)]
    contours = [base[i % 5] * (1 + rng.normal(0, 0.07, len(base[i % 5]))) for i in range(34)] + [np.array([5.0]), np.array([5.0, 6.0])]
    for more in ({"vigilance": 93, "max_categories": 9}, {"vigilance": 90, "bias": 0.3, "learning_rate": 0.5}):
        p = art.Params(seed=3, max_iterations=6, **more, **flags)
        got, want = art.Fold([c.tolist() for c in contours], p).fit(), Plain(contours, p).fit()
        assert got.history == want.history and got.converged == want.converged
        assert [None if c < 0 else int(c) for c in got.category] == want.category
        assert list(got.match) == pytest.approx(want.match, rel=1e-9)
        assert len(got.weights) == len(want.weights)
        for a, b in zip(got.weights, want.weights, strict=True):
            assert kernels.valid(a).tolist() == pytest.approx(kernels.valid(b).tolist(), rel=1e-9)


def test_scaling_recovers_distances(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 30, (9, 2))
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    rows = [(i, j, 100 - float(d[i, j])) for i in range(9) for j in range(9)]
    got = summaries.mds(spark.createDataFrame(rows, "i int, j int, similarity double")).toPandas().sort_values("category")[["x", "y"]].to_numpy()
    assert np.linalg.norm(got[:, None] - got[None], axis=2) == pytest.approx(d, abs=1e-6)


def test_linkage_is_the_mean_over_members(spark):
    rng = np.random.default_rng(6)
    n = 11
    d = rng.uniform(1, 60, (n, n))
    rows = [(i, j, 100 - float(d[i, j])) for i in range(n) for j in range(n) if i < j]
    got = summaries.dendrogram(spark.createDataFrame(rows, "i int, j int, similarity double")).orderBy("step").collect()
    groups = {k: [k] for k in range(n)}
    for r in got:
        mean = {(a, b): np.mean([d[min(x, y), max(x, y)] for x in groups[a] for y in groups[b]]) for a, b in itertools.combinations(sorted(groups), 2)}
        assert r.height == pytest.approx(min(mean.values())) and mean[r.a, r.b] == pytest.approx(r.height)
        groups[n + r.step] = groups.pop(r.a) + groups.pop(r.b)
        assert r["size"] == len(groups[n + r.step]) and r.colour_cut == pytest.approx(0.7 * got[-1].height)


def test_counts_of_sides(spark):
    left = spark.createDataFrame([("a.csv",), ("a",), ("b.CTR",), ("c",)], "contour_name string")
    right = spark.createDataFrame([("a.txt",), ("a",), ("a ",), ("d",)], "contour_name string")
    assert tuple(agreement.sides(left, right).first()) == (4, 4, 6, -2, -2, 2, 1)
    assert tuple(agreement.sides(left.limit(0), right.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_stability_counts_prototypes_and_used_ones(spark):
    meta = spark.createDataFrame([("a", 5), ("b", 5), ("c", 7)], "run_id string, n_categories int")
    assigned = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", None)], "run_id string, category int")
    rows = summaries.run_stability(meta, assigned).collect()
    count = lambda side, x: sum(r.n for r in rows if r.counted == side and r.lo <= x and (x < r.hi or x == r.hi == max(q.hi for q in rows if q.counted == side)))
    assert [count("all", x) for x in (5, 7)] == [2, 1] and [count("used", x) for x in (0, 1, 2)] == [1, 1, 1]


def test_strict(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0]), (7, [1.0, 0.0]), (9, [])], "contour_id long, freq array<double>")
    with pytest.raises(ValueError, match="contour 7: not_positive"):
        art.fit(df, {"r": art.Params(seed=1)}, strict=True)
    assert art.assignments(art.fit(df.filter("contour_id = 4"), {"r": art.Params(seed=1)}, strict=True)).count() == 1


def test_report_has_all_tables(spark):
    c = spark.createDataFrame([(i, [float(i + k + 1) for k in range(i % 3 + 3)], 0.01) for i in range(9)], "contour_id long, freq array<double>, tempres double")
    named = spark.createDataFrame([(i, f"n{i}", None if i == 4 else i % 2, 90.0 + i) for i in range(9)], "contour_id long, name string, category int, match double")
    p = spark.createDataFrame([(0, [2.0, 3.0, 4.0]), (1, [5.0, 6.0, 7.0, 8.0])], "category int, weight array<double>")
    h = spark.createDataFrame([("r", 1, 9, 2), ("r", 2, 0, 2)], "run_id string, iteration int, reclassified long, n_categories int")
    tables = summaries.report(c, named, prototypes=p, history=h, labels=named.select("contour_id", "name").withColumnRenamed("name", "label"), raw=c)
    assert {"members", "alignment", "bands", "before_after", "convergence", "references", "confusion", "label_proportion", "resampling"} <= set(tables)
    assert all(t.count() for t in tables.values())
    assert {(r.category, r.contour_id) for r in tables["alignment"].collect()} == {(i % 2, i) for i in range(9) if i != 4}
    assert tables["before_after"].filter("side = 'before'").count() == tables["before_after"].filter("side = 'after'").count()


def test_extract_command(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(mat5.write({"NET": {"weight": np.array([[1.0], [2.0]])}, "DATA": [{"name": "x", "contour": [1, 2], "category": 1.0, "match": 0.5}]}))
    assert cli.main(["extract", "--input", f"file://{tmp_path}/a.mat", "--output-dir", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o/a_assignments.csv").read_text().splitlines()[1] == "x,1,50.0"
