"""Toxicity by weak supervision.

Voters are words and word beginnings, mined from all labelled rows because they point to toxic or to clean texts; each
votes for its side or abstains. A generative label model estimates by expectation maximisation, over the vote patterns of
all rows, labelled or not, how often each voter fires on toxic and on clean texts, how right given labels are, and how
strongly voters are correlated within a class (a word and its beginnings are); correlated voters count for less. The
posterior labels of a bounded sample of labelled rows, of toxic and clean ones alike, then train a linear classifier; features
that the sample hardly holds keep the weight that all rows' votes give.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedprofile.llm.bytestext import LOWER, Slice, distinct_sorted, mix, prefix_hashes, range_hashes, slices
from feedprofile.llm.storage import mapped, materialize

#: Labelled rows of the training sample, about; voters for toxic and for clean; features of the classifier.
LABELLED, VOTERS, CLEAN_VOTERS, FEATURES = 12_000, 256, 64, 4096
#: Word beginnings of so many bytes are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
#: Correlations within a class below this, or below so many standard errors, are noise; rounds of their estimation.
CORRELATED, SURE_CORRELATED, CORRELATION_ROUNDS = 0.5, 4.0, 2
#: What is known of given labels beforehand: as if so many had been seen right and wrong.
LABEL_RIGHT, LABEL_WRONG = 95.0, 5.0
LEAST_SUPPORT, EM_STEPS, FIT_STEPS = 3, 30, 300
#: Labels are broadcast up to this number and joined by shuffle beyond it.
BROADCAST_LABELS = 1_000_000
#: Features whose log odds are less than so many standard errors from 0 are noise; voters' log odds exceed
#: LEAST_ODDS for toxic, CLEAN_ODDS for clean.
LEAST_SURE, LEAST_ODDS, CLEAN_ODDS = 3.0, 1.5, 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def feature_hashes(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters) and word beginnings of a slice, and the text of each."""
    data, offsets = piece.data, piece.offsets
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = prefix_hashes(LOWER[data])
    owner = np.searchsorted(offsets, starts, "right") - 1
    hashes, owners = [range_hashes(sums, starts, ends)], [owner]
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        hashes.append(mix(range_hashes(sums, starts[at], starts[at] + k) + np.uint64(k)))
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def text_features(piece: Slice) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    hashes, owner = feature_hashes(piece)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(piece.offsets) - 1))
    return [distinct_sorted(h) for h in np.split(hashes[order], cuts)]


class Matrix:
    """Sparse 0/1 rows over a list of feature hashes."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray) -> None:
        self.shape = (len(rows), len(columns))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(columns, flat), max(len(columns) - 1, 0))
        hit = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        self.rows, self.cols = owner[hit], at[hit]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, v[self.rows], self.shape[1])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, np.float32)
        out[self.rows, self.cols] = 1
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class LabelModel:
    """Rates at which voters fire on toxic and on clean rows, their correlations, and the share of toxic rows.

    A voter that fires votes for its side (1: toxic, -1: clean), else it abstains. Given labels are a voter too, right as
    often as ``trust`` says. Voters that fire together more than their rates within a class explain are correlated: a vote
    counts 1 / (1 + its correlations with the others that fire), so that k copies of a voter speak with one voice.
    """

    def __init__(self, side: np.ndarray, share: float) -> None:
        self.side, self.share, self.trust = side, share, LABEL_RIGHT / (LABEL_RIGHT + LABEL_WRONG)
        self.on = self.off = None
        self.rho, self.weights = np.zeros((len(side), len(side)), np.float32), np.ones(len(side))

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Posterior probability of "toxic", from 0/1 firings of voters and given labels (-1: none)."""
        known = given >= 0
        if self.on is None:
            return np.where(known, given, self.share).astype(np.float64)
        quiet = self.weights * (np.log1p(-self.on) - np.log1p(-self.off))
        score = (votes / (1 + votes @ self.rho)) @ (np.log(self.on) - np.log(self.off)) + (1 - votes) @ quiet + np.log(self.share / (1 - self.share))
        return _sigmoid(score + np.where(known, np.where(given == 1, 1, -1) * np.log(self.trust / (1 - self.trust)), 0.0))

    def odds(self) -> np.ndarray:
        """Log odds that each voter's firing adds, with as many of its correlated voters as then fire usually."""
        return self.weights * (np.log(self.on) - np.log(self.off))

    def counted(self, given: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Rows that count: until rates are known, those with a label."""
        return times if self.on is not None else times * (given >= 0)

    def sums(self, votes: np.ndarray, given: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What ``update`` needs of some rows, as one line; those of several lots add up."""
        toxic, times = self.posterior(votes, given), self.counted(given, times)
        known = times * (given >= 0)
        agreed = known * np.where(given == 1, toxic, 1 - toxic)
        return np.concatenate([votes.T @ (toxic * times), votes.T @ ((1 - toxic) * times), [(toxic * times).sum(), times.sum(), agreed.sum(), known.sum()]])[None, :]

    def update(self, sums: np.ndarray) -> float:
        """Take rates, trust and share from all rows' sums; the largest change of a log rate."""
        on, off = np.split(sums[0, :-4], 2)
        positive, total, agreed, known = sums[0, -4:]
        before = self.on
        self.on, self.off = (on + 0.5) / (positive + 1), (off + 0.5) / (total - positive + 1)
        # a voter does not speak against its own side
        against = self.side * (self.on - self.off) < 0
        self.on[against] = self.off[against] = ((on + off + 0.5) / (total + 1))[against]
        self.share = float(np.clip(positive / total, 1e-4, 1 - 1e-4))
        self.trust = float((agreed + LABEL_RIGHT) / (known + LABEL_RIGHT + LABEL_WRONG))
        return np.inf if before is None else float(np.abs(np.log(self.on / before)).max())

    def together(self, votes: np.ndarray, given: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each voter a line with the toxic, then the clean rows in which it fires with each voter; all rows' lines at the end."""
        toxic, times = self.posterior(votes, given), self.counted(given, times)
        sides = [toxic * times, (1 - toxic) * times]
        every = np.concatenate([votes, np.ones((len(votes), 1), np.float32)], axis=1)
        return np.concatenate([(every * w[:, None]).T @ votes for w in sides] + [(every * w[:, None]).sum(axis=0)[:, None] for w in sides], axis=1)

    def correlate(self, together: np.ndarray) -> None:
        """Correlations within classes from all rows' ``together``, averaged by how often the voters fire in a class."""
        n = len(self.side)
        rho, fires = np.zeros((n, n)), np.full((n, n), 1e-9)
        sides = np.stack([together[:n, :n], together[:n, n : 2 * n]])
        for both, rows in zip(sides, together[n, -2:], strict=True):
            if rows <= 0:
                continue
            fired = np.diag(both)
            rate = fired / rows
            spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
            phi = (both / rows - rate[:, None] * rate[None, :]) / (spread[:, None] * spread[None, :])
            weight = fired[:, None] + fired[None, :]
            rho += np.where(phi >= max(CORRELATED, SURE_CORRELATED / np.sqrt(rows)), np.minimum(phi, 1.0), 0.0) * weight
            fires += weight
        rho /= fires
        np.fill_diagonal(rho, 0.0)
        both = sides.sum(axis=0)
        self.rho = rho.astype(np.float32)
        self.weights = 1 / (1 + (rho * both).sum(axis=1) / np.maximum(np.diag(both), 1e-9))


def _unpacked(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes, given labels and numbers of rows of a batch of vote patterns."""
    packed = np.frombuffer(b"".join(batch.column("votes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return np.unpackbits(packed, axis=1, count=n).astype(np.float32), batch.column("toxic").to_numpy(), batch.column("n").to_numpy().astype(np.float64)


def _voted(voters: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column("text")):
                votes = Matrix(text_features(piece), voters).dense().astype(bool)
                packed = [r.tobytes() for r in np.packbits(votes, axis=1)]
                yield pa.RecordBatch.from_pydict({"votes": pa.array(packed, pa.binary()), "toxic": batch.column("toxic").slice(piece.first, len(packed))})

    return run


def _summed(what: str, model: LabelModel):
    """One of the model's statistics over a task's rows, a row for each of its lines."""

    def run(batches):
        out = None
        for batch in batches:
            more = getattr(model, what)(*_unpacked(batch, len(model.side)))
            out = more if out is None else out + more
        if out is not None:
            yield pa.RecordBatch.from_pydict({"line": pa.array(np.arange(len(out))), "m": pa.array([x.tobytes() for x in out], pa.binary())})

    return run


def _added(lines: pd.DataFrame) -> pd.DataFrame:
    out = np.sum([np.frombuffer(x) for x in lines["m"]], axis=0)
    return pd.DataFrame({"line": lines["line"].iloc[:1], "m": [out.tobytes()]})


def _statistic(what: str, model: LabelModel, patterns: DataFrame) -> np.ndarray:
    """One of the model's statistics over all rows; tasks' lines are added up in Spark, so the driver gets each once."""
    added = mapped(patterns, _summed(what, model), "line long, m binary").groupBy("line").applyInPandas(_added, "line long, m binary")
    return np.stack([np.frombuffer(r["m"]) for r in sorted(added.collect())])


def label_model(rows: DataFrame, voters: np.ndarray, side: np.ndarray, share: float) -> LabelModel:
    """Label model of all ``rows(text, toxic)``, by expectation maximisation that starts from the given labels.

    Rows are brought down to their distinct vote patterns once; each step is one aggregation over these. Correlations
    come from the given labels first, and once more from the posteriors that the first run ends with.
    """
    patterns = materialize(mapped(rows, _voted(voters), "votes binary, toxic int").groupBy("votes", "toxic").agg(F.count("*").alias("n")))
    model = LabelModel(side, share)
    for _ in range(CORRELATION_ROUNDS):
        model.correlate(_statistic("together", model, patterns))
        for _ in range(EM_STEPS):
            if model.update(_statistic("sums", model, patterns)) < 1e-3:
                break
    return model


class Classifier:
    def __init__(self, rows: list[np.ndarray], given: np.ndarray, weights: np.ndarray, columns: np.ndarray, voters: np.ndarray, model: LabelModel | None) -> None:
        """``rows`` hold the features of the sample that are among ``columns`` (ascending); ``voters`` are some of these."""
        known = given >= 0
        start = np.zeros(len(columns))
        if model:
            labels = model.posterior(Matrix(rows, voters).dense(), given)
            start[np.searchsorted(columns, voters)] = model.odds()
        else:
            labels = np.where(known, given, (weights * (given == 1)).sum() / max((weights * known).sum(), 1e-9))
        self.columns = columns
        self._fit(Matrix(rows, columns), labels, weights, start)

    def _fit(self, x: Matrix, y: np.ndarray, weights: np.ndarray, start: np.ndarray) -> None:
        """Logistic regression on soft labels, with decay to ``start``, by accelerated steps scaled by feature counts."""
        seen = x.t_dot(weights)
        n, decay, mean = weights.sum(), 0.1, (weights * y).sum() / weights.sum()
        w, bias = start.copy(), float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        speed, rest = np.zeros(x.shape[1]), 0.0
        for _ in range(FIT_STEPS):
            gap = weights * (_sigmoid(x.dot(w) + bias) - y)
            slope, tilt = x.t_dot(gap) + decay * (w - start), gap.sum()
            speed = 0.9 * speed - 0.05 * slope / np.sqrt(seen + 1)
            rest = 0.9 * rest - 0.2 * tilt / n
            w, bias = w + speed, bias + rest
        self.weights, self.bias = w, bias

    def score(self, piece: Slice) -> np.ndarray:
        n = len(piece.offsets) - 1
        hashes, owner = feature_hashes(piece)
        if len(self.columns) == 0 or len(hashes) == 0:
            return np.full(n, _sigmoid(np.array(self.bias)))
        spot = (hashes & np.uint64(self.mask)).astype(np.int64)
        near = self.slots[spot]
        hit = np.flatnonzero(near)
        found, who = hashes[hit], owner[hit]
        at = np.minimum(np.searchsorted(self.columns, found), len(self.columns) - 1)
        good = self.columns[at] == found
        pair = distinct_sorted(who[good] * len(self.columns) + at[good])
        return _sigmoid(np.bincount(pair // len(self.columns), self.weights[pair % len(self.columns)], n) + self.bias)

    def ready(self) -> Classifier:
        """Add the table by which most features are passed over quickly."""
        self.mask = (1 << 20) - 1
        self.slots = np.zeros(self.mask + 1, bool)
        self.slots[(self.columns & np.uint64(self.mask)).astype(np.int64)] = True
        return self


def _counted(batches):
    """Texts and toxic texts with each feature, summed within a batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        hashes, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in slices(batch.column("text")):
            for k, row in enumerate(text_features(piece)):
                hashes.append(row)
                marks.append(np.full(len(row), toxic[piece.first + k]))
        codes, distinct = pd.factorize(np.concatenate(hashes))
        yield pa.RecordBatch.from_pydict({
            "f": pa.array(distinct.view(np.int64)), "n": pa.array(np.bincount(codes, minlength=len(distinct))),
            "pos": pa.array(np.bincount(codes, np.concatenate(marks), len(distinct)).astype(np.int64)),
        })


def _matched(columns: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column("text")):
                rows = [r[np.isin(r, columns)].tobytes() for r in text_features(piece)]
                yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").slice(piece.first, len(rows)), "w": batch.column("w").slice(piece.first, len(rows)), "f": pa.array(rows, pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, labelled: int = LABELLED) -> Classifier | None:
    """Fit on rows of ``docs(doc_id, text)`` that ``learn`` allows, with ``labels(doc_id, toxic)`` where they have one.

    Features are counted over all labelled rows, and the label model's votes over all rows. The driver sees FEATURES of
    the features and, of each text in the sample for the linear fit, those. The sample takes toxic and clean rows alike,
    weighted back to their shares; rows without a label teach through the label model.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = materialize(marks)
    told = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    rows = docs.where(learn).select("doc_id", "text").join(told, "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    known = rows.where("toxic >= 0")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, n = sizes.get(1, 0), sizes.get(0, 0) + sizes.get(1, 0)
    if not n:
        return None
    counts = mapped(known.select("text", "toxic"), _counted, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST_SUPPORT)
    neg = F.col("n") - F.col("pos")
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((neg + 0.5) / (n - toxic + 1))
    sure = F.abs(odds) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (neg + 0.5))
    chosen = counts.select("f", "n", "pos", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") >= LEAST_SURE).orderBy(F.desc("sure"), "f").limit(FEATURES).collect()
    leads = [
        *sorted((r for r in chosen if r["odds"] > LEAST_ODDS), key=lambda r: -r["odds"] * r["pos"] ** 0.5)[:VOTERS],
        *sorted((r for r in chosen if r["odds"] < -CLEAN_ODDS), key=lambda r: r["odds"] * (r["n"] - r["pos"]) ** 0.5)[:CLEAN_VOTERS],
    ]
    columns, voters = (np.array([r["f"] for r in some], np.int64).view(np.uint64) for some in (chosen, leads))
    order = np.argsort(voters)
    columns, voters, side = np.sort(columns), voters[order], np.array([1 if r["odds"] > 0 else -1 for r in leads])[order]
    model = label_model(rows.select("text", "toxic"), voters, side, (toxic + 1) / (n + 2)) if len(voters) else None
    shares = {c: min(1.0, most / max(sizes.get(c, 0), 1)) for c, most in ((1, labelled / 2), (0, labelled / 2))}
    level = max(shares[0], shares[1]) if min(shares[0], shares[1]) < 1 else 1.0
    share, weight = (F.when(F.col("toxic") == 1, F.lit(a)).otherwise(F.lit(b)) for a, b in ((shares[1], shares[0]), (level / shares[1], level / shares[0])))
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(u < share).select("text", "toxic", weight.alias("w"))
    got = mapped(drawn, _matched(columns), "toxic int, w double, f binary").collect()
    given, weights = np.array([r["toxic"] for r in got]), np.array([r["w"] for r in got])
    return Classifier([np.frombuffer(r["f"], np.uint64) for r in got], given, weights, columns, voters, model) if got else None


def _scored(model: bytes, keep: list[str]):
    def run(batches):
        classifier = pickle.loads(model)
        classifier = classifier and classifier.ready()
        for batch in batches:
            scores = [classifier.score(p) if classifier else np.zeros(len(p.offsets) - 1) for p in slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*keep, "score"]
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5 on).

    Labels come only from rows that ``learn`` allows; scores use the text alone. Null, empty and very short texts have the
    score of a text without features. Several labels of an id count as toxic if one is; labels other than 0 and 1 are
    ignored; without any label all scores are 0. Repeated rows are scored each; columns of ``docs`` named as the new ones
    are replaced; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    model = pickle.dumps(fit(docs, labels, learn))
    keep = [c for c in docs.columns if keep is None or c in keep]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("score", DoubleType())])
    scored = mapped(docs.select(*{*keep, "text"}), _scored(model, keep), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
