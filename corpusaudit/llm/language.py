"""Language identification in two steps: the family of a language, then the language in it."""

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import rebatched, release, texts_of
from corpusaudit.llm.hashing import SPACE, gram_counts, lowered

#: Families of languages, by code; a language of no family here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
GRAMS, BUCKETS = (2, 3), 2048
#: Texts of each language that the classifiers are fitted on, at most, and languages that are learned.
PER_LANGUAGE, LANGUAGES = 800, 128
UNKNOWN = "und"
BLOCK, ROWS = 1 << 19, 250


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, each row of length one."""
    plain = lowered(body)
    plain = np.where(SPACE[plain], np.uint8(32), plain)
    x = np.sqrt(gram_counts(plain, at, GRAMS, BUCKETS))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Margin:
    """One linear machine: over 0 speaks for ``yes``; ``scale`` turns margins into chances."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float
    scale: float


def machine(x: np.ndarray, y: np.ndarray, yes: str, no: str, cost: float = 10.0, rounds: int = 150) -> Margin:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    n, d = x.shape
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, vw, vb = np.zeros(d, np.float32), np.float32(0), np.zeros(d, np.float32), np.float32(0)
    step = np.float32(1.0 / (1.0 / cost + 4.0))
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        nw, nb = vw + step * (2 * (slack @ x) - vw * np.float32(0.1 / cost)), vb + step * 2 * slack.sum()
        m = np.float32(t / (t + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    margins = (y * (x @ w + b)).astype(np.float64)
    scale = 1.0
    for _ in range(30):  # one figure that makes margins likeliest, kept from running off
        p = 1 / (1 + np.exp(np.clip(scale * margins, -30, 30)))
        scale = float(np.clip(scale + (weight @ (margins * p)) / max(1e-6, weight @ (margins**2 * p * (1 - p)) + 1e-3), 0.5, 20))
    return Margin(yes, no, w.astype(np.float32), float(b), scale)


@dataclass
class Model:
    """Machines between families, and between the languages of each family."""

    between: list[Margin]
    inside: dict[str, list[Margin]]
    members: dict[str, list[str]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = _voted(sorted(self.members), self.between, x)
        label, score = np.empty(len(x), object), sure.copy()
        for name, languages in self.members.items():
            mine = np.flatnonzero(family == name)
            if len(mine):
                label[mine], within = _voted(languages, self.inside[name], x[mine])
                score[mine] = np.minimum(score[mine], within)
        return label, score


def _voted(names: list[str], machines: list[Margin], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name with most one-versus-one votes (then the larger sum of chances), and its least chance."""
    if len(names) == 1:
        return np.full(len(x), names[0], object), np.ones(len(x))
    place = {n: i for i, n in enumerate(names)}
    votes, least = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
    for m in machines:
        p = 1 / (1 + np.exp(np.clip(-m.scale * (x @ m.weights + m.bias), -30, 30)))
        for name, chance in ((m.yes, p), (m.no, 1 - p)):
            k = place[name]
            votes[:, k] += (chance > 0.5) + 1e-3 * chance
            least[:, k] = np.minimum(least[:, k], chance)
    won = votes.argmax(1)
    return np.array(names, object)[won], least[np.arange(len(x)), won]


def sampled(docs: DataFrame, text: str, lang: str, per_language: int, languages: int) -> DataFrame:
    """(lang, text): different texts of the commonest languages, exactly bounded for each.

    Copies of a text are one before the dice are thrown, so that how often a text occurs plays no part.
    The dice leave about a fifth more than wanted, of which those of least hash stay.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit("sample")).alias("hash")
    )
    # Estimates of how many different texts there are decide the dice only, never who is in.
    counts = (
        known.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(languages).collect()
    )
    if not counts:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.2 * (per_language + 20) / max(r["n"], 1)))])
    dice = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(dice < F.element_at(share, F.col("lang"))).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    least = Window.partitionBy("lang").orderBy("hash")
    return drawn.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= per_language).select("lang", "text")


def fit(
    docs: DataFrame, text="text", lang="lang", per_language: int = PER_LANGUAGE, families=None, languages: int = LANGUAGES
) -> Model | None:
    """Fit on a bounded sample: at most ``per_language`` different texts of each language, by a hash of the text.

    At most ``languages`` languages are learned, those with most texts. Rows without text or language
    teach nothing, copies of a text no more than one. None: there is nothing to learn from. The driver
    gets one short row of features for each sampled text, never texts.
    """
    family_of = {x: name for name, members in (families or FAMILIES).items() for x in members}
    sample = sampled(docs, text, lang, per_language, languages)

    def work(batches):
        for batch in batches:
            for small in rebatched([batch], "text", BLOCK):
                for start in range(0, small.num_rows, ROWS):
                    part = small.slice(start, ROWS)
                    x = features(*texts_of(part.column("text"))).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"]
                    )

    # As Arrow and at half precision, so that the driver holds the sample about once.
    found = sample.mapInArrow(work, "lang string, x binary").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    found = found.sort_by([("lang", "ascending"), ("x", "ascending")]).combine_chunks()
    labels = np.array(found.column("lang").to_pylist(), object)
    x = np.frombuffer(texts_of(found.column("x"))[0], np.float16).reshape(len(labels), -1)
    del found
    group = np.array([family_of.get(v, v) for v in labels], object)
    members = {f: sorted(set(labels[group == f])) for f in sorted(set(group))}

    def pairs(names, of):
        out = []
        for a, b in itertools.combinations(names, 2):
            use = (of == a) | (of == b)
            out.append(machine(x[use].astype(np.float32), np.where(of[use] == a, 1.0, -1.0), a, b))
        return out

    model = Model(pairs(list(members), group), {f: pairs(m, labels) for f, m in members.items()}, members)
    del x
    release()
    return model


def predicted(column: pa.Array, model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text of an Arrow column."""
    lang, score = [], []
    letters = [has_letter(t) for t in column.to_pylist()]
    if model is None:
        return [UNKNOWN] * len(letters), [0.0] * len(letters)
    for start in range(0, len(letters), ROWS):
        a, b = model.predict(features(*texts_of(column.slice(start, ROWS))))
        lang += a.tolist()
        score += b.tolist()
    return [v if ok else UNKNOWN for v, ok in zip(lang, letters, strict=True)], [
        float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)
    ]


def identify(docs: DataFrame, model: Model | None, text="text", *keep: str) -> DataFrame:
    """The columns ``keep`` of each row, with lang_pred and score, of whole texts and nothing else.

    Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing
    was learned. Each row gives one row; an empty table gives an empty one.
    """
    keep = list(keep)
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)

    def work(batches):
        for batch in rebatched(batches, text, BLOCK):
            lang, score = predicted(batch.column(text), model)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(work, f"{fields}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None, least: float = 0.5, text="text") -> DataFrame:
    """The documents, with all their columns, of which a language is known with ``least`` score or more."""

    def work(batches):
        for batch in rebatched(batches, text, BLOCK):
            lang, score = predicted(batch.column(text), model)
            yield batch.filter(pa.array([v != UNKNOWN and s >= least for v, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
