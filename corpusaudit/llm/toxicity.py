"""Toxicity from confirmed toxic texts and unlabelled ones, without trusting any text to be clean."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import rebatched, texts_of
from corpusaudit.llm.hashing import NO_LETTER, lowered, span_hashes, word_spans

BUCKETS = 1 << 20
#: Confirmed toxic and unlabelled rows that the classifiers are fitted on, at most about so many.
POSITIVES, UNLABELLED = 4000, 12000
#: Words that a classifier looks at: those that tell toxic from unlabelled texts best.
WORDS = 1500
MEMBERS = 3
BLOCK = 1 << 18


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word of every text: lower case, letters only."""
    body, at = texts_of(column)
    body = lowered(body)
    row, start, stop = word_spans(body, at, NO_LETTER)
    return row, (span_hashes(body, start, stop) >> np.uint64(44)).astype(np.int64)


@dataclass
class Classifier:
    """A weight for each bucket (most are 0), and a bias."""

    weights: np.ndarray
    bias: float


def _rows(sets: list[np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the chosen buckets in sets of buckets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    feature = index[np.concatenate(sets)] if sets else np.zeros(0, np.int64)
    return row[feature >= 0], feature[feature >= 0]


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, seed: int = 1) -> Classifier:
    """Minimise the non-negative risk of positive-unlabelled learning, with the sigmoid loss.

    The risk of the negatives is that of the unlabelled less what the positives among them, by the
    class prior, put there. Where it falls under zero the step goes the other way, so that the
    classifier does not learn single texts by heart.
    """
    seen_p = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    seen_u = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS)
    share_p, share_u = seen_p / len(positive), seen_u / len(unlabelled)
    spread = np.sqrt((share_u + 1e-4) / len(positive) + (share_u + 1e-4) / len(unlabelled))
    z = np.where(seen_p >= 3, (share_p - share_u) / spread, 0)
    chosen = np.argsort(-np.abs(z), kind="stable")[:WORDS]
    chosen = chosen[np.abs(z[chosen]) > 3]
    index = np.full(BUCKETS, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    k = len(chosen)
    rp, fp = _rows(positive, index)
    ru, fu = _rows(unlabelled, index)
    np_, nu = len(positive), len(unlabelled)
    # Start from naive log ratios, then follow the risk (Adam).
    w = np.clip(np.log((share_p[chosen] + 1e-4) / (share_u[chosen] + 1e-4)), -1, 3)
    b = float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(np.clip(-x, -30, 30)))
    for t in range(1, rounds + 1):
        gp = sigmoid(np.bincount(rp, w[fp], np_) + b)
        gu = sigmoid(np.bincount(ru, w[fu], nu) + b)
        negative = gu.mean() - prior * gp.mean()
        slope_p, slope_u = gp * (1 - gp) / np_, gu * (1 - gu) / nu
        down = np.append(np.bincount(fu, slope_u[ru], k), slope_u.sum()) - prior * np.append(
            np.bincount(fp, slope_p[rp], k), slope_p.sum()
        )
        up = -prior * np.append(np.bincount(fp, slope_p[rp], k), slope_p.sum())
        grad = up + down if negative >= 0 else -down
        grad[:k] += 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k], b - step[k]
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w
    return Classifier(weights, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, key="doc_id", text="text", toxic="toxic", positives=POSITIVES, unlabelled=UNLABELLED, prior=None
) -> list[Classifier]:
    """Fit on a bounded sample: documents with label 1 are confirmed toxic, all others unlabelled.

    ``prior`` is the share of toxic texts; where it is not given, it is the share of 1 among the
    labels 0 and 1. Rows are chosen by a hash of their key before any text is read, so the chosen
    keys are a table of about ``positives + unlabelled`` rows. A key with several labels is toxic if
    one says so; null keys and null texts teach nothing. An empty list: no confirmed toxic text, or
    no other, to learn from.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(toxic).cast("int")).alias("mark"))
    known = (
        docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().join(marks, "key", "left")
        .select("key", "mark", F.coalesce(F.col("mark") == 1, F.lit(False)).alias("yes"))
    )
    n = known.agg(F.count_if("yes").alias("p"), F.count_if(~F.col("yes")).alias("u"), F.count_if(F.col("mark") == 0).alias("clean")).first()
    if not n["p"] or not n["u"]:
        return []
    if prior is None:
        prior = n["p"] / (n["p"] + n["clean"]) if n["clean"] else n["p"] / (n["p"] + n["u"])
    prior = min(max(prior, 1e-4), 0.9)
    dice = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("yes"), min(1.0, positives / n["p"])).otherwise(min(1.0, unlabelled / n["u"]))
    # Bounded by the two parameters, whatever the corpus holds: of a key that repeats one text is taken.
    chosen = F.broadcast(known.filter(dice < share).groupBy("key").agg(F.max("yes").alias("yes")))
    sample = (
        docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(chosen, "key").groupBy("key").agg(F.min("text").alias("text"), F.first("yes").alias("yes")).select("text", "yes")
    )

    def work(batches):
        for batch in rebatched(batches, "text", BLOCK):
            row, bucket = word_buckets(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = [np.unique(bucket[cut[i] : cut[i + 1]]).astype(np.uint32).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("yes"), pa.array(sets, pa.binary())], names=["yes", "x"])

    got = sorted((not r["yes"], bytes(r["x"])) for r in sample.mapInArrow(work, "yes boolean, x binary").collect())
    p = [np.frombuffer(x, np.uint32).astype(np.int64) for no, x in got if not no]
    u = [np.frombuffer(x, np.uint32).astype(np.int64) for no, x in got if no]
    if not p or not u:
        return []
    # The confirmed texts were taken out of the whole: with as many of them in proportion put back,
    # the unlabelled side is the whole corpus, whose share of toxic texts is the prior.
    out = []
    for k in range(MEMBERS):
        dealt = np.random.default_rng(k).permutation(len(u))
        part = [u[i] for i in dealt[: max(1, len(u) * 2 // 3)]]
        again = np.random.default_rng(k + 50).permutation(len(p))[: round(len(part) * n["p"] / n["u"])]
        out.append(fitted(p, part + [p[i] for i in again], prior, seed=k))
    return out


def scores(column: pa.Array, model: list[Classifier]) -> np.ndarray:
    """Mean score of the classifiers; each word of a text counts once."""
    n = len(column)
    if not model:
        return np.zeros(n)
    row, bucket = word_buckets(column)
    total = np.zeros(n)
    for c in model:
        w = c.weights[bucket]
        hit = np.flatnonzero(w)
        cell = np.unique(row[hit] * BUCKETS + bucket[hit])
        f = np.bincount(cell // BUCKETS, c.weights[cell % BUCKETS], n) + c.bias
        total += 1 / (1 + np.exp(np.clip(-f, -30, 30)))
    return total / len(model)


def toxicity(docs: DataFrame, model: list[Classifier], text="text", *keep: str) -> DataFrame:
    """The columns ``keep`` of each row, with score and predicted, of whole texts and nothing else.

    Null and empty texts have the score of a text without any telling word; with nothing learned all
    scores are 0. Each row gives one row; an empty table gives an empty one.
    """
    keep = list(keep)
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)

    def work(batches):
        for batch in rebatched(batches, text, BLOCK):
            s = scores(batch.column(text), model)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(work, f"{fields}, score double, predicted int")
