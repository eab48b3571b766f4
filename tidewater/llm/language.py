"""Language identification in two steps: the language family first, then one-versus-one linear SVMs inside it.

Features are hashed character n-grams and words of the lower-cased letters of the whole text, as shares. The family
step is one linear machine per family against the rest; inside a family every pair of languages has its own machine,
and the language that wins most pairs (then by margin, then by name) is the prediction. All machines are linear, so
a text needs one table row per feature occurrence. They are fitted by stochastic subgradient descent in numpy on a
bounded sample that executors have turned into feature counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import encoded, fixed_sample, list_rows, offsets, slices, smallest_text, span_hashes, word_spans

BUCKETS = 1 << 15
SAMPLE_PER_LANGUAGE = 500
EPOCHS = 4
CHUNK_BYTES = 1 << 18

# Which closely related languages share a family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
}

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True
HAS_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.lower().split("-")[0] in members), f"only {lang}")


def features(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature per occurrence, first occurrence of each text): words, then byte 2-, 3- and 4-grams of words.

    Everything but letters counts as one blank, so digits and punctuation carry no language.
    """
    raw = [f" {x.lower()} ".encode() for x in texts]
    bounds = offsets(map(len, raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, words = word_spans(data, bounds, LETTER)
    part = buckets // 4
    yield (span_hashes(data, starts, ends) % np.uint64(part)).astype(np.int32), words
    inside = LETTER[data]
    data = np.where(inside, data, 32).astype(np.uint32)
    for i, k in enumerate((2, 3, 4)):
        n = max(0, len(data) - k + 1)
        g = np.zeros(n, np.uint32)
        useful = np.zeros(n, bool)
        for j in range(k):
            g = g * np.uint32(0x01000193) + data[j : j + n]
            useful |= inside[j : j + n]
        for end in range(1, k):  # not from one text into the next
            useful[(bounds[1:-1] - end)[(bounds[1:-1] >= end) & (bounds[1:-1] - end < n)]] = False
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(13)
        kept = np.concatenate([[0], np.cumsum(useful)])
        yield (g[useful] % np.uint32(part) + np.uint32(part * (1 + i))).astype(np.int32), kept[np.minimum(bounds, n)]


def counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares of all occurrences of their kind."""
    ids, share = [], []
    for feature, _ in features([text], buckets):
        if len(feature):
            u, n = np.unique(feature, return_counts=True)
            ids.append(u)
            share.append(n / len(feature))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0)
    return np.concatenate(ids), np.concatenate(share)


def svm(samples, target: np.ndarray, buckets: int, epochs: int = EPOCHS, seed: int = 11, decay: float = 1e-4):
    """Linear machine (weights, bias) for targets +1 and -1 (0: not used); both sides weigh the same."""
    r = np.random.default_rng(seed)
    use = np.flatnonzero(target)
    weights, bias, scale = np.zeros(buckets), 0.0, 1.0
    positive = max(1, int((target > 0).sum()))
    negative = max(1, len(use) - positive)
    step = 0
    for _ in range(epochs):
        for i in r.permutation(use):
            step += 1
            rate = 1.0 / (decay * (step + 1 / decay / 50))
            feature, x = samples[i]
            y = target[i]
            margin = y * (scale * (x @ weights[feature]) + bias)
            scale *= max(1e-9, 1 - rate * decay)
            if margin < 1:
                side = len(use) / (2 * (positive if y > 0 else negative))
                weights[feature] += rate * y * side * x / scale
                bias += 0.01 * rate * y * side
    return weights * scale, bias


@dataclass
class Model:
    """Columns of ``table``: one per family (if there are several), then one per pair of languages of a family."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]
    table: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs = ["und"] * len(texts)
        score = np.zeros(len(texts))
        letters = [bool(HAS_LETTER.search(x)) for x in texts]
        if not self.members:
            return langs, score
        total = np.repeat(self.bias[None, :], len(texts), axis=0)
        for feature, at in features(texts, len(self.table)):
            n = np.diff(at)
            full = np.flatnonzero(n)
            if len(full):
                for c in range(self.table.shape[1]):
                    run = np.add.reduceat(self.table[:, c][feature], at[:-1][full])
                    total[full, c] += run / n[full]
        many = len(self.families) > 1
        top = np.argmax(total[:, : len(self.families)], axis=1) if many else np.zeros(len(texts), np.int64)
        sure = np.ones(len(texts))
        if many:
            rest = total[:, : len(self.families)].copy()
            best = rest[np.arange(len(texts)), top]
            rest[np.arange(len(texts)), top] = -np.inf
            sure = _sigmoid(best - rest.max(axis=1))
        first = len(self.families) if many else 0
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(top == f)
            votes, margins = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            worst = np.full((len(rows), len(names)), np.inf)
            for c, (of, a, b) in enumerate(self.pairs):
                if of == f:
                    m = total[rows, first + c]
                    for side, v in ((a, m), (b, -m)):
                        votes[:, side] += v > 0
                        margins[:, side] += np.tanh(v)
                        worst[:, side] = np.minimum(worst[:, side], v)
            pick = np.argmax(votes * 2 * len(names) + margins, axis=1) if len(names) > 1 else np.zeros(len(rows), np.int64)
            inner = _sigmoid(worst[np.arange(len(rows)), pick]) if len(names) > 1 else np.ones(len(rows))
            for row, p, s in zip(rows.tolist(), pick.tolist(), (inner * sure[rows]).tolist()):
                if letters[row]:
                    langs[row], score[row] = names[p], s
        return langs, score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -500, 500)))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, **fitting) -> Model:
    names = sorted(set(langs))
    families = sorted({family_of(x) for x in names})
    members = [[x for x in names if family_of(x) == f] for f in families]
    lang = np.array(langs)
    family = np.array([family_of(x) for x in langs])
    machines = []
    if len(families) > 1:
        machines += [svm(samples, np.where(family == f, 1, -1), buckets, **fitting) for f in families]
    pairs = []
    for f, own in enumerate(members):
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                pairs.append((f, a, b))
                target = np.where(lang == own[a], 1, np.where(lang == own[b], -1, 0))
                machines.append(svm(samples, target, buckets, **fitting))
    table = np.stack([w for w, _ in machines], axis=1) if machines else np.zeros((buckets, 0))
    return Model(families, members, pairs, table, np.array([b for _, b in machines]))


def _texts(column) -> list[str]:
    return [x.decode() for x in encoded(column)]


def _counted(buckets: int):
    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text"))):
                ids, share = counts(text, buckets)
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang], pa.string()),
                        "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                        "shares": pa.array([share.astype(np.float32)], pa.list_(pa.float32())),
                    }
                )

    return run


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
    buckets: int = BUCKETS,
    **fitting,
) -> Model:
    """Fit on at most ``per_language`` rows of each language, those with the smallest hash of their key.

    Rows without a key or language are left out, texts without words too; of several texts of one key and
    language the one with the smallest hash counts. The set of languages must be small (it is
    collected); the driver gets at most ``buckets`` counts per sample row. Without any row every prediction is
    ``und``.
    """
    own = labelled.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = fixed_sample(own, "_key", "lang", per_language)
    got = (
        smallest_text(own.join(F.broadcast(chosen), ["_key", "lang"]), ["_key", "lang"])
        .select("lang", "text")
        .repartition(24)
        .mapInArrow(_counted(buckets), "lang string, ids array<int>, shares array<float>")
        .toArrow()
    )
    found = sorted(
        (x for x in zip(got["lang"].to_pylist(), list_rows(got["ids"]), list_rows(got["shares"])) if len(x[1])),
        key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()),
    )
    return fit([(i, s) for _, i, s in found], [c for c, _, _ in found], buckets, **fitting)


def predicted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1); ``und`` and 0 for a null text or one without letters.

    Columns of ``df`` with these names, in any case, are replaced. Whole texts are read, in slices of documents.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(text))
            langs, scores = [], []
            for a, b in slices(texts, CHUNK_BYTES):
                own, score = shared.value.predict([x.decode() for x in texts[a:b]])
                langs += own
                scores += score.tolist()
            columns = {c: batch.column(c) for c in batch.schema.names if c.lower() not in ("lang_pred", "score")}
            columns |= {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.record_batch(columns)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() not in ("lang_pred", "score"))
    return df.mapInArrow(run, f"{kept}, lang_pred string, score double")
