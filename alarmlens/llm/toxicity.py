"""Toxicity by non-negative positive-unlabelled learning over hashed words."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.common import crc_of_id

POSITIVES, UNLABELLED = 6_000, 12_000  # bounds of the training sample
BITS = 20
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: its lower-cased words, and the first five letters of long ones."""
    words = {w.encode() for w in set(_WORD.findall((text or "").lower()))}
    starts = {b"^" + w.decode()[:5].encode() for w in words if len(w) > 5}
    both = [zlib.crc32(w) for w in words] + [zlib.crc32(w) for w in starts]
    return np.unique(np.array(both, np.int64) & ((1 << BITS) - 1))


@dataclass(frozen=True)
class Model:
    """Weights of the features that matter, in ascending order of their number."""

    bias: float
    number: np.ndarray
    weight: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        if not len(self.number) or not len(found):
            return self.bias
        place = np.minimum(np.searchsorted(self.number, found), len(self.number) - 1)
        return self.bias + float(self.weight[place][self.number[place] == found].sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    *,
    steps: int = 200,
    rate: float = 0.1,
    ridge: float = 1e-4,
    least: int = 5,
    z: float = 3.5,
) -> Model:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` of the logistic loss by Adam.

    Where the second term turns negative, the step goes against its gradient, which keeps the risk from being
    fitted below zero. Features that are not clearly commoner in either set (``z`` standard errors) are left out first.
    """
    if not positive or not unlabelled:
        return Model(-4.0, np.empty(0, np.int64), np.empty(0))
    size = 1 << BITS
    np_, nu = len(positive), len(unlabelled)
    cp = np.bincount(np.concatenate(positive), minlength=size)
    cu = np.bincount(np.concatenate(unlabelled), minlength=size)
    share = (cp + cu) / (np_ + nu)
    error = np.sqrt(share * (1 - share) * (1 / np_ + 1 / nu)) + 1e-12
    number = np.flatnonzero((np.abs(cp / np_ - cu / nu) > z * error) & (cp + cu >= least))
    column = np.full(size, -1, np.int64)
    column[number] = np.arange(len(number))

    def rows(sets):
        cols = [column[s] for s in sets]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)

    (rp, kp), (ru, ku) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(number)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
    for step in range(1, steps + 1):
        zp = b + np.bincount(rp, w[kp], np_)
        zu = b + np.bincount(ru, w[ku], nu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Gradients by margin of each term.
        plus = -prior * _sigmoid(-zp) / np_
        minus_p, minus_u = -prior * _sigmoid(zp) / np_, _sigmoid(zu) / nu
        if negative >= 0:
            gp, gu = plus + minus_p, minus_u
        else:
            gp, gu = -minus_p, -minus_u
        grad = np.bincount(kp, gp[rp], len(number)) + np.bincount(ku, gu[ru], len(number)) + ridge * w
        grad = np.append(grad, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), number, w)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on confirmed toxic documents and on unlabelled texts, none of them held out.

    Both samples are bounded and take the lowest md5 of the id; the class prior is the share of toxic rows among
    all labels. Features of the sampled texts go to the driver, of no other text. Without toxic labels the model is a constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    draw = F.md5(F.col("doc_id").cast("string").cast("binary"))
    marked = known.where("toxic = 1").orderBy(draw, "doc_id").limit(positives)
    ids = docs.select("doc_id").where("doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    plain = ids.orderBy(F.md5(F.concat(F.lit("u"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(unlabelled)
    wanted = marked.select("doc_id", F.lit(True).alias("positive")).unionByName(
        plain.select("doc_id", F.lit(False).alias("positive"))
    )

    @F.arrow_udf("array<bigint>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int64()))

    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    sample = texts.select("doc_id", "positive", found(F.col("text")).cast("array<int>").alias("x"))
    sample = sample.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).orderBy("positive", "doc_id").toArrow()
    flags = sample["positive"].to_pylist()
    sets = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in sample["x"]] if len(sample) else []
    prior = min(max((toxic or 0) / total, 0.001), 0.5) if total else 0.001
    return fit_nnpu([s for s, f in zip(sets, flags) if f], [s for s, f in zip(sets, flags) if not f], prior)


def score(text: Column, model: Model) -> Column:
    """Probability of toxicity of a whole text; NULL and empty texts get that of a text without known words."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_sigmoid(np.array([model.margin(features(t.as_py())) for t in texts], float)))

    return run(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more."""
    return docs.where(score(F.col("text"), model) < 0.5)
