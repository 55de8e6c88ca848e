"""Learners (V6-V10, E12). Naive Bayes is additive counts, so that training over folds is one aggregation
and prediction a join; the order-dependent learners run per (learner, held-out fold) in Arrow Python, folds
in order and rows by id, over samples whose size is a parameter of the experiment. A task holds one fold at
a time, sparse.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

SEED = 123456789
#: Rows made dense at once.
DENSE = 256
#: Parts that a held-out fold's combinations are trained in, at most.
BLOCKS = 4

# Learners and their default parameter grids.
LEARNERS = {
    "mbkm": "MiniBatchKMeans",
    "bnb": "BernoulliNB",
    "mnb": "MultinomialNB",
    "perc": "Perceptron",
    "pagr": "PassiveAggressiveRegressor",
    "pagc": "PassiveAggressiveClassifier",
    "sgdc": "SGDClassifier",
}
GRIDS = {
    "mbkm": {"n_clusters": [3, 5, 10], "init": ["k-means++", "random"]},
    "bnb": {"alpha": [0.1, 0.25, 0.5], "fit_prior": [True, False]},
    "mnb": {"alpha": [0.1, 0.25, 0.5], "fit_prior": [True, False]},
    "perc": {"penalty": [None, "l2", "l1", "elasticnet"], "alpha": [0.0001, 0.001, 0.01, 0.1], "n_iter": [5, 10], "eta0": [0.5, 1, 2]},
    "pagr": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "n_iter": [5, 10], "loss": ["epsilon_insensitive", "squared_epsilon_insensitive"]},
    "pagc": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "n_iter": [5, 10], "loss": ["hinge", "squared_hinge"]},
    "sgdc": {
        "loss": ["hinge", "huber", "log", "epsilon_insensitive"],
        "penalty": ["l1", "l2", "elasticnet"],
        "n_iter": [5, 10],
        "eta0": [0.0, 0.001, 0.01, 0.1],
        "alpha": [0.000001, 0.00001, 0.0001, 0.001],
        "average": [True],
    },
}


def grid_rows(learner: str) -> list[dict]:
    """Every combination of a learner's default grid."""
    if learner not in GRIDS:
        raise ValueError(f"unknown learner: {learner!r}")
    g = GRIDS[learner]
    return [dict(zip(g, v)) for v in itertools.product(*g.values())]


def grid_table(spark) -> DataFrame:
    """(learner, combination, params json) of all learners."""
    rows = [(k, i, json.dumps(p)) for k in LEARNERS for i, p in enumerate(grid_rows(k))]
    return spark.createDataFrame(rows, "learner string, combination int, params string")


# ---- naive Bayes ---------------------------------------------------------------------------------


def nb_counts(long: DataFrame, labels: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics (feature, y, value sum, records) and (y, records), additive over batches."""
    by = by or []
    j = long.join(labels, "id")
    feats = j.groupBy(*by, "feature", "y").agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("records"))
    return feats, labels.groupBy(*by, "y").agg(F.count("*").alias("n"))


def _priors(classes: DataFrame, fit_prior: bool) -> DataFrame:
    w = Window.partitionBy()
    p = F.ln(F.col("n") / F.sum("n").over(w)) if fit_prior else -F.ln(F.count("*").over(w).cast("double"))
    return classes.select("y", "n", p.alias("prior"))


def mnb_weights(feats: DataFrame, classes: DataFrame, alpha: float = 0.1, fit_prior: bool = True) -> tuple[DataFrame, DataFrame]:
    """Multinomial: weights(feature, y, weight = ln (N_cf + a) / (N_c + a V)), base(y, prior, unseen)."""
    v = feats.agg(F.countDistinct("feature")).scalar()
    per = feats.groupBy("y").agg(F.sum("total").alias("nc"))
    base = _priors(classes, fit_prior).join(per, "y", "left").fillna(0.0, ["nc"]).withColumn("den", F.ln(F.col("nc") + alpha * v))
    base = base.select("y", "prior", (F.ln(F.lit(alpha)) - F.col("den")).alias("unseen"), "den")
    w = feats.join(F.broadcast(base.select("y", "den")), "y").select("feature", "y", (F.ln(F.col("total") + alpha) - F.col("den")).alias("weight"))
    return w, base.select("y", "prior", "unseen")


def mnb_predict(long: DataFrame, ids: DataFrame, weights: DataFrame, base: DataFrame) -> DataFrame:
    """(id, p): highest score; ties: the smallest class; features outside the vocabulary do not count."""
    vocab = weights.select("feature").distinct()
    known = long.join(vocab, "feature")
    seen = known.join(weights, "feature").groupBy("id", "y").agg(F.sum(F.col("value") * F.col("weight")).alias("s"), F.sum("value").alias("k"))
    total = known.groupBy("id").agg(F.sum("value").alias("t"))
    classes = base.agg(F.array_sort(F.collect_list(F.struct("y", "prior", "unseen")))).scalar()
    cells = ids.select("id", F.explode(classes).alias("c")).select("id", "c.y", "c.prior", "c.unseen")
    j = cells.join(total, "id", "left").join(seen, ["id", "y"], "left").fillna(0, ["s", "k", "t"])
    score = F.round(F.col("prior") + F.col("s") + (F.col("t") - F.col("k")) * F.col("unseen"), 9)
    return j.groupBy("id").agg(F.max_by("y", F.struct(score, -F.col("y"))).alias("p"))


def mnb_grid(long: DataFrame, labels: DataFrame, params: list[dict]) -> DataFrame:
    """V6, V7: (combination, fold, id, p): multinomial naive Bayes for every combination of ``params`` and every
    fold of ``labels(fold, id, y)`` held out, in one plan: counts are kept per held-out fold, combinations
    (a handful) are exploded beside the counts, and predictions are joins on fold and feature."""
    k = labels.select(F.col("fold").alias("_f")).distinct()
    train = labels.join(k, F.col("fold") != F.col("_f")).select(F.col("_f").alias("fold"), "id", "y")
    feats, classes = nb_counts(long, train, ["fold"])
    feats = cut(feats)
    combos = F.array(*[F.struct(F.lit(i).alias("combination"), F.lit(float(p["alpha"])).alias("alpha"), F.lit(bool(p["fit_prior"])).alias("fit")) for i, p in enumerate(params)])
    size = feats.groupBy("fold").agg(F.countDistinct("feature").alias("v"))
    per = feats.groupBy("fold", "y").agg(F.sum("total").alias("nc"))
    w = Window.partitionBy("fold")
    base = classes.withColumn("fitted", F.ln(F.col("n") / F.sum("n").over(w))).withColumn("flat", -F.ln(F.count("*").over(w).cast("double")))
    base = base.join(size, "fold").join(per, ["fold", "y"], "left").fillna(0.0, ["nc"]).select("*", F.inline(combos))
    den = F.ln(F.col("nc") + F.col("alpha") * F.col("v"))
    base = cut(base.select("combination", "fold", "y", "alpha", F.when(F.col("fit"), F.col("fitted")).otherwise(F.col("flat")).alias("prior"), den.alias("den"), (F.ln("alpha") - den).alias("unseen")))
    test = labels.select("fold", "id")
    known = long.join(test, "id").join(feats.select("fold", "feature").distinct(), ["fold", "feature"])
    total = known.groupBy("fold", "id").agg(F.sum("value").alias("t"))
    hit = known.join(feats, ["fold", "feature"]).join(F.broadcast(base), ["fold", "y"])
    seen = hit.groupBy("combination", "fold", "id", "y").agg(F.sum(F.col("value") * (F.ln(F.col("total") + F.col("alpha")) - F.col("den"))).alias("s"), F.sum("value").alias("k"))
    cells = test.join(F.broadcast(base.select("combination", "fold", "y", "prior", "unseen")), "fold")
    j = cells.join(total, ["fold", "id"], "left").join(seen, ["combination", "fold", "id", "y"], "left").fillna(0, ["s", "k", "t"])
    score = F.round(F.col("prior") + F.col("s") + (F.col("t") - F.col("k")) * F.col("unseen"), 9)
    return j.groupBy("combination", "fold", "id").agg(F.max_by("y", F.struct(score, -F.col("y"))).alias("p"))


def bnb_predict(long: DataFrame, ids: DataFrame, feats: DataFrame, classes: DataFrame, alpha: float = 0.1, fit_prior: bool = True) -> DataFrame:
    """Bernoulli: score = prior + sum over present f of ln p - ln(1 - p), plus the sum over the whole
    vocabulary of ln(1 - p), computed once a class. p = (n_cf + a) / (n_c + 2a)."""
    pri = _priors(classes, fit_prior)
    vocab = feats.select("feature").distinct()
    arr = pri.agg(F.array_sort(F.collect_list(F.struct("y", "n", "prior")))).scalar()
    cell = vocab.select("feature", F.explode(arr).alias("c")).select("feature", "c.y", "c.n")
    cell = cell.join(feats.select("feature", "y", "records"), ["feature", "y"], "left").fillna(0, ["records"])
    p = (F.col("records") + alpha) / (F.col("n") + 2 * alpha)
    cell = cell.select("feature", "y", (F.ln(p) - F.ln(1 - p)).alias("w"), F.ln(1 - p).alias("no"))
    none = cell.groupBy("y").agg(F.sum("no").alias("none"))
    base = pri.join(none, "y").agg(F.array_sort(F.collect_list(F.struct("y", "prior", "none")))).scalar()
    present = long.join(cell.select("feature", "y", "w"), "feature").groupBy("id", "y").agg(F.sum("w").alias("s"))
    rows = ids.select("id", F.explode(base).alias("c")).select("id", "c.y", "c.prior", "c.none").join(present, ["id", "y"], "left").fillna(0.0, ["s"])
    score = F.round(F.col("prior") + F.col("none") + F.col("s"), 9)
    return rows.groupBy("id").agg(F.max_by("y", F.struct(score, -F.col("y"))).alias("p"))


# ---- order-dependent learners --------------------------------------------------------------------


class Online:
    """Perceptron, passive-aggressive classifier and regressor, SGD classifier and mini-batch k-means with
    ``partial_fit`` on sparse rows [(indices, values)]; one-versus-rest for several classes."""

    def __init__(self, kind: str, params: dict, dim: int, classes: np.ndarray):
        self.kind, self.p, self.dim, self.classes = kind, params, dim, classes
        rows = {"mbkm": int(params.get("n_clusters", 3)), "pagr": 1}.get(kind, len(classes))
        self.w = np.zeros((rows, dim))
        self.b = np.zeros(rows)
        self.sum_w, self.sum_b, self.t = np.zeros_like(self.w), np.zeros_like(self.b), 0
        self.counts = np.zeros(rows)
        self.rng = np.random.default_rng(SEED)

    def partial_fit(self, rows, y) -> None:
        if self.kind == "mbkm":
            return self._kmeans(rows)
        for _ in range(int(self.p.get("n_iter", 5))):
            for (ix, v), target in zip(rows, y):
                self.t += 1
                score = self.w[:, ix] @ v + self.b
                if self.kind == "pagr":
                    err = target - score[0]
                    loss = max(0.0, abs(err) - 0.1)
                    step = np.array([np.sign(err) * self._pa(loss, v, "squared" in str(self.p.get("loss")))])
                else:
                    sign = np.where(self.classes == target, 1.0, -1.0)
                    margin = sign * score
                    if self.kind == "perc":
                        step = np.where(margin <= 0, sign * self.p.get("eta0", 1), 0.0)
                        self._penalty(self.p.get("eta0", 1))
                    elif self.kind == "pagc":
                        loss = np.maximum(0.0, 1 - margin)
                        step = sign * self._pa(loss, v, self.p.get("loss") == "squared_hinge")
                    else:
                        step = self._sgd(sign, margin, score)
                self.w[:, ix] += step[:, None] * v
                self.b += step
                if self.p.get("average"):
                    self.sum_w += self.w
                    self.sum_b += self.b

    def _pa(self, loss, v, squared):
        sq = float(v @ v) + 1.0
        c = float(self.p.get("C", 1.0))
        return loss / (sq + 1 / (2 * c)) if squared else np.minimum(c, loss / sq)

    def _sgd(self, sign, margin, score):
        alpha = float(self.p.get("alpha", 1e-4))
        eta = 1 / (alpha * (self.t + 1 / alpha))
        self._penalty(eta)
        loss = self.p.get("loss", "hinge")
        if loss == "log":
            g = sign / (1 + np.exp(np.clip(margin, -30, 30)))
        elif loss == "huber":
            g = np.clip(sign - score, -0.1, 0.1)
        elif loss == "epsilon_insensitive":
            g = np.where(np.abs(sign - score) > 0.1, np.sign(sign - score), 0.0)
        else:
            g = np.where(margin < 1, sign, 0.0)
        return eta * g

    def _penalty(self, eta):
        kind, alpha = self.p.get("penalty"), float(self.p.get("alpha", 1e-4))
        if kind in ("l2", "elasticnet"):
            self.w *= max(0.0, 1 - eta * alpha * (1.0 if kind == "l2" else 0.85))
        if kind in ("l1", "elasticnet"):
            cut = eta * alpha * (1.0 if kind == "l1" else 0.15)
            self.w = np.sign(self.w) * np.maximum(0.0, np.abs(self.w) - cut)

    def _dense(self, rows):
        """Blocks of dense rows: the whole of them need not fit into memory."""
        for at in range(0, len(rows), DENSE):
            part = [rows[i] for i in range(at, min(at + DENSE, len(rows)))]
            x = np.zeros((len(part), self.dim))
            for i, (ix, v) in enumerate(part):
                x[i, ix] = v
            yield x

    def _kmeans(self, rows):
        if not len(rows):
            return
        if not self.counts.any():
            first, near = [int(self.rng.integers(len(rows)))], np.full(len(rows), np.inf)
            centre = lambda i: next(self._dense([rows[i]]))[0]
            while len(first) < min(len(self.w), len(rows)):
                c = centre(first[-1])
                near = np.minimum(near, np.concatenate([((x - c) ** 2).sum(axis=1) for x in self._dense(rows)]))
                p = near / near.sum() if self.p.get("init") == "k-means++" and near.sum() else None
                first.append(int(self.rng.choice(len(rows), p=p)))
            self.w[: len(first)] = [centre(i) for i in first]
        for x in self._dense(rows):
            for r in x:
                k = int(((self.w - r) ** 2).sum(axis=1).argmin())
                self.counts[k] += 1
                self.w[k] += (r - self.w[k]) / self.counts[k]

    def predict(self, rows) -> np.ndarray:
        if self.kind == "mbkm":
            return np.array([float(((self.w - r) ** 2).sum(axis=1).argmin()) for x in self._dense(rows) for r in x])
        w, b = (self.sum_w / self.t, self.sum_b / self.t) if self.p.get("average") and self.t else (self.w, self.b)
        s = np.array([w[:, ix] @ v + b for ix, v in rows]).reshape(len(rows), -1)
        return s[:, 0] if self.kind == "pagr" else self.classes[s.argmax(axis=1)]


class Perceptrons:
    """``Online``'s perceptron for several combinations of one ``n_iter`` over the same rows. A column is a
    combination and a class. Weights are ``w`` times their column's ``scale``, so that shrinking all of them
    is one product; what was cut from all of them adds up in ``owed``, and a feature's weights are cut by
    what has come since they were last seen (``paid``) when they are seen again. Equal to ``Online`` but for rounding."""

    CHECK = 256

    def __init__(self, combinations: list[dict], dim: int, classes: np.ndarray):
        order = {None: 0, "l2": 1, "elasticnet": 2, "l1": 3}
        self.order = sorted(range(len(combinations)), key=lambda i: order[combinations[i].get("penalty")])
        p, k = [combinations[i] for i in self.order], len(classes)
        kinds = np.repeat([order[x.get("penalty")] for x in p], k)
        each = lambda f: np.repeat([float(f(x)) for x in p], k)
        self.n_iter, self.classes, self.eta = int(p[0].get("n_iter", 5)), classes, each(lambda x: x.get("eta0", 1))
        rate = self.eta * each(lambda x: x.get("alpha", 1e-4))
        self.shrink, self.scale = 1 - rate * np.array([0.0, 1.0, 0.85, 0.0])[kinds], np.ones(len(kinds))
        self.first = int(np.searchsorted(kinds, 2))  # columns from here on are cut
        self.cut = (rate * np.where(kinds == 3, 1.0, 0.15))[self.first :]
        self.owed, self.b, self.t = np.zeros(len(self.cut)), np.zeros(len(kinds)), 0
        self.plain, self.sparse, self.paid = np.zeros((dim, self.first)), np.zeros((dim, len(self.cut))), np.zeros((dim, len(self.cut)))
        self.sign = np.where(classes[:, None] == np.tile(classes, len(p)), 1.0, -1.0)

    @staticmethod
    def fits(combinations: list[dict]) -> bool:
        """Whether no step shrinks the weights to almost nothing."""
        return all(float(p.get("eta0", 1)) * float(p.get("alpha", 1e-4)) < 0.95 for p in combinations)

    def partial_fit(self, rows, y) -> None:
        n = self.first
        for _ in range(self.n_iter):
            for (ix, v), target in zip(rows, np.searchsorted(self.classes, y)):
                x, owes = self.sparse.take(ix, axis=0), self.paid.take(ix, axis=0)
                owes -= self.owed
                within = np.maximum(x, owes)
                np.negative(owes, out=owes)
                x -= np.minimum(within, owes, out=within)
                score = np.concatenate([v @ self.plain.take(ix, axis=0), v @ x]) * self.scale + self.b
                sign = self.sign[target]
                wrong = sign * score <= 0
                self.scale *= self.shrink
                now = self.cut / self.scale[n:]
                self.owed += now
                np.maximum(x, -now, out=within)
                x -= np.minimum(within, now, out=within)
                if wrong.any():
                    step = sign * self.eta * wrong
                    self.b += step
                    step /= self.scale
                    if wrong[:n].any():
                        self.plain[ix] += np.dot(v[:, None], step[None, :n])
                    x += np.dot(v[:, None], step[None, n:], out=within)
                self.sparse[ix], self.paid[ix] = x, self.owed
                self.t += 1
                if self.t % self.CHECK == 0 and self.scale.min() < 1e-40:
                    self._rescaled()

    def _rescaled(self) -> None:
        """All weights cut by what they owe, and a scale of one."""
        owes = self.owed - self.paid
        self.sparse -= np.clip(self.sparse, -owes, owes)
        self.sparse *= self.scale[self.first :]
        self.plain *= self.scale[: self.first]
        self.paid[:], self.owed[:], self.scale[:] = 0, 0, 1

    def predict(self, rows) -> list[np.ndarray]:
        """One array for each combination, in their order."""
        self._rescaled()
        w = np.concatenate([self.plain, self.sparse], axis=1)
        s = np.array([v @ w[ix] + self.b for ix, v in rows]).reshape(len(rows), len(self.order), len(self.classes))
        best = self.classes[s.argmax(axis=2)]
        out: list = [None] * len(self.order)
        for j, i in enumerate(self.order):
            out[i] = best[:, j]
        return out


class Each:
    """Learners of any combinations over the same rows, with the methods of ``Perceptrons``."""

    def __init__(self, learner: str, combinations: list[dict], dim: int, classes: np.ndarray):
        self.models = [Online(learner, p, dim, classes) for p in combinations]

    def partial_fit(self, rows, y) -> None:
        for m in self.models:
            m.partial_fit(rows, y)

    def predict(self, rows) -> list[np.ndarray]:
        return [m.predict(rows) for m in self.models]


def same_model(learner: str, params: dict) -> tuple:
    """Combinations of equal key make the same predictions: without penalty a perceptron's alpha says nothing,
    and where ``eta0`` (a power of two, so that nothing is rounded) multiplies all that changes the weights it
    does not either."""
    p = dict(params)
    if learner == "perc":
        if p.get("penalty") is None:
            p.pop("alpha", None)
        if p.get("penalty") in (None, "l1") and np.frexp(p.get("eta0", 1))[0] == 0.5:
            p["eta0"] = 1
    return tuple(sorted((k, str(float(v) if isinstance(v, (int, float)) else v)) for k, v in p.items()))


def _blocks(learner: str, combinations: list[dict]) -> list[list[list[int]]]:
    """Blocks of models, a model being the numbers of the combinations that it stands for. The models of a
    block are trained in one task a held-out fold; perceptrons of a block have one ``n_iter``."""
    models: dict[tuple, list[int]] = {}
    for i, p in enumerate(combinations):
        models.setdefault(same_model(learner, p), []).append(i)
    of = list(models.values())
    if learner == "perc" and len(of) > 1:
        by: dict[int, list] = {}
        for m in of:
            by.setdefault(int(combinations[m[0]].get("n_iter", 5)), []).append(m)
        return list(by.values())
    return [of[k::BLOCKS] for k in range(min(BLOCKS, len(of)))]


class Rows:
    """Sparse rows of Arrow batches, as a sequence of (indices, values)."""

    def __init__(self, batches: list[pa.RecordBatch]):
        col = lambda name: pa.chunked_array([b.column(b.schema.get_field_index(name)) for b in batches]).combine_chunks()
        slots, vals = col("slots"), col("vals")
        self.start = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)))
        self.ix, self.v = slots.flatten().to_numpy(zero_copy_only=False), vals.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        self.y, self.ids = col("y").to_numpy(zero_copy_only=False).astype(float, copy=False), col("id")

    def __len__(self):
        return len(self.y)

    def __getitem__(self, i):
        if i >= len(self):
            raise IndexError(i)
        a, b = self.start[i], self.start[i + 1]
        return self.ix[a:b], self.v[a:b]


def cross_validated(points: DataFrame, learner: str, params: dict, dim: int) -> DataFrame:
    """V7: (learner, fold, id, y, p). ``points(fold, id, y, slots array<int>, vals array<double>)``, hashed to
    ``dim``. For every held-out fold one task trains on the others, fold by fold, rows by id. The sample
    an experiment trains on is bounded by folds x size, parameters of the plan."""
    return _each_combination(_written(points), learner, [params], dim).drop("combination")


def _written(points: DataFrame) -> DataFrame:
    columns = [F.col("fold"), F.col("id").cast("string").alias("id"), F.col("y").cast("double").alias("y"), F.col("slots"), F.col("vals")]
    return cut(points.where("fold is not null").select(*columns))


def _each_combination(points: DataFrame, learner: str, combinations: list[dict], dim: int) -> DataFrame:
    """``cross_validated`` of ``_written`` points with a column combination. Every held-out fold and block of combinations has a
    partition of its own, which the other folds, in order, and then the held-out one are streamed through:
    rows are copied once a block, not once a combination."""
    has = points.agg(F.array_sort(F.collect_set("fold")).alias("fold"), F.array_sort(F.collect_set("y")).alias("y")).first()
    folds, classes, blocks = has["fold"], np.array(has["y"], float), _blocks(learner, combinations)

    def run(batches):
        job, model, fold, held = -1, None, None, []

        def learned():
            if held:
                rows = Rows(held)
                model.partial_fit(rows, rows.y)
                held.clear()

        for b in batches:
            jobs, of = (b.column(k).to_numpy() for k in range(2))
            cuts = np.flatnonzero((np.diff(jobs) != 0) | (np.diff(of) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if jobs[lo] != job:
                    job, fold = int(jobs[lo]), None
                    out, block = folds[job // len(blocks)], blocks[job % len(blocks)]
                    chosen = [combinations[m[0]] for m in block]
                    together = learner == "perc" and len(combinations) > 1 and Perceptrons.fits(chosen)
                    model = Perceptrons(chosen, dim, classes) if together else Each(learner, chosen, dim, classes)
                    held.clear()
                if of[lo] != fold:
                    learned()
                    fold = of[lo]
                if fold != out:
                    held.append(part)
                    continue
                rows = Rows([part])
                for numbers, p in zip(block, model.predict(rows)):
                    for number in numbers:
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, number, np.int32)), pa.array([learner] * n), pa.array(np.full(n, out, np.int32)), rows.ids, pa.array(rows.y), pa.array(p)],
                            ["combination", "learner", "fold", "id", "y", "p"],
                        )

    if not folds:
        return points.select(F.lit(0).alias("combination"), F.lit(learner).alias("learner"), "fold", "id", "y", F.col("y").alias("p"))
    numbers = F.sequence(F.lit(0), F.lit(len(folds) * len(blocks) - 1))
    last = F.col("fold") == F.get(F.lit(folds), F.floor(F.col("job") / len(blocks)).cast("int"))
    jobs = points.select(F.explode(numbers).alias("job"), "fold", "id", "y", "slots", "vals").repartitionById(len(folds) * len(blocks), "job")
    return jobs.sortWithinPartitions("job", last, "fold", "id").mapInArrow(run, "combination int, learner string, fold int, id string, y double, p double")


def grid_search(points: DataFrame, learner: str, combinations: list[dict], dim: int, objective) -> tuple[dict, DataFrame]:
    """V6: every combination over the grid folds; best by the mean objective over folds (ties: the first).
    ``objective(predictions) -> (fold, score)``; it sees each combination's folds as folds of their own. At
    least two folds are needed. The scores are written, so that every model is trained once."""
    points = _written(points)
    if points.select("fold").distinct().count() < 2:
        raise ValueError("grid search needs at least two folds")
    n = len(combinations)
    p = _each_combination(points, learner, combinations, dim)
    folds = objective(p.withColumn("fold", F.col("fold") * n + F.col("combination")).drop("combination"))
    scored = cut(folds.groupBy(F.pmod("fold", F.lit(n)).cast("int").alias("combination")).agg(F.avg("score").alias("score")))
    best = scored.orderBy(F.desc_nulls_last("score"), "combination").first()
    return combinations[best["combination"]], scored


def majority_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """V8: the training rows' majority label for every test row."""
    m = train.groupBy("y").agg(F.count("*").alias("n")).agg(F.max_by("y", F.struct(F.col("n"), -F.col("y")))).scalar()
    return test.withColumn("p", m)
