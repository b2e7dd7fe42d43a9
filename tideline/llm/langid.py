"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, give_back, lean

DIMS = 2048
#: Rows judged at once.
BLOCK = 256
UNDETERMINED = "und"
#: Families of common ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "da de en fy is nb nl nn no sv".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "turkic": "az kk ky tr uz".split(),
    "semitic": "am ar he mt".split(),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only-{lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte pair and triple counts (square roots) of the whole lowered text."""
    out = np.zeros(DIMS, np.float64)
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(1, len(raw) - 1), 1 << 16):  # in blocks: a long text needs no more memory than a short one
        b = raw[at : at + (1 << 16) + 2].astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        two = two[: 1 << 16]
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) | np.uint32(1 << 24)
        for code in (two, three):
            out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=DIMS)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Squared-hinge linear SVM (last weight: bias) by accelerated gradient descent; y is -1 or 1, classes weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = look = np.zeros(x.shape[1])
    rate = 1 / (2 * 2.0 + reg)  # rows have norm below the root of 2
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (reg * look - 2 * x.T @ (weight * y * slack))
        look, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    """Weights by family, and by pair of languages of a family. Its size depends on the number of languages only."""

    families: dict[str, list[str]]
    by_family: dict[str, np.ndarray]
    by_pair: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a score from 0 to 1: the family's probability times the winner's weakest duel."""
        langs, scores = self.predict_all(x[None, :])
        return langs[0], float(scores[0])

    def predict_all(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """predict() of all rows of x: one product for the families, one a pair for the rows of its family."""
        if not self.families or not len(x):
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
        names = sorted(self.families)
        margins = x @ np.stack([self.by_family[f] for f in names]).T if len(names) > 1 else np.zeros((len(x), 1))
        best, rows = margins.argmax(axis=1), np.arange(len(x))
        scores = np.ones(len(x))
        if len(names) > 1:
            other = margins.copy()
            other[rows, best] = -np.inf
            scores = 1 / (1 + np.exp(-2 * (margins[rows, best] - other.max(axis=1))))
        out = np.empty(len(x), object)
        for f, name in enumerate(names):
            at, langs = np.flatnonzero(best == f), self.families[name]
            won, total, weakest = (np.full((len(at), len(langs)), v) for v in (0.0, 0.0, np.inf))
            for a, b in itertools.combinations(range(len(langs)), 2):
                m = x[at] @ self.by_pair[langs[a], langs[b]]
                for side, value in ((a, m), (b, -m)):
                    won[:, side] += (value >= 0) if side == a else (value > 0)
                    total[:, side] += value
                    weakest[:, side] = np.minimum(weakest[:, side], value)
            # Most duels won, then the largest sum of margins, then the first name.
            choice = np.array([max(range(len(langs)), key=lambda k, r=r: (won[r, k], total[r, k], -k)) for r in range(len(at))], int) if len(langs) > 2 else (won.argmax(axis=1) if len(at) else np.empty(0, int))
            out[at] = [langs[k] for k in choice]
            if len(langs) > 1:
                scores[at] /= 1 + np.exp(-2 * weakest[np.arange(len(at)), choice])
        return out.tolist(), scores


#: Languages a model can tell apart: it holds a weight vector each, and one a pair of one family.
MAX_LANGUAGES = 4096


def train(rows: DataFrame, per_lang: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about per_lang rows of each language (a bounded sample, taken by a hash of the id; languages with fewer rows give all).

    Rows with a null language, a null text or no letter teach nothing. A table with more
    than MAX_LANGUAGES languages is refused, not cut; with per_lang that bounds what reaches the driver.
    """
    known = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({}, {}, {})
    spark = rows.sparkSession
    share = spark.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in sorted(counts)], "lang string, share double")
    known = known.join(F.broadcast(share), "lang")  # at most MAX_LANGUAGES rows
    draw = F.pmod(F.xxhash64(F.lit(10), "id", F.xxhash64("text")), F.lit(1 << 30)) < F.col("share") * float(1 << 30)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [bool(_LETTER.search(t)) for t in b["text"]]
            b = b[ok]
            yield pd.DataFrame({"lang": b["lang"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    got = sorted((r["lang"], bytes(r["x"])) for r in known.where(draw).select("text", "lang").mapInPandas(lean(run), "lang string, x binary").collect())
    langs = np.array([r[0] for r in got])
    x = np.stack([np.frombuffer(r[1], np.float16).astype(np.float32) for r in got]) if got else np.empty((0, DIMS), np.float32)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        groups.setdefault(family(lang), []).append(lang)
    fam = np.array([family(lang) for lang in langs.tolist()])
    one = {f: _svm(x, np.where(fam == f, 1.0, -1.0)) for f in groups} if len(groups) > 1 else {}
    two = {}
    for members in groups.values():
        for a, b in itertools.combinations(members, 2):
            pick = (langs == a) | (langs == b)
            two[a, b] = _svm(x[pick], np.where(langs[pick] == a, 1.0, -1.0))
    return Model(groups, one, two)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced); a map without shuffle.

    The whole text is read, nothing else. Null texts and texts without a letter (Unicode category L; digits
    and numerals are none): 'und'
    with score 0. Repeated rows get equal answers, an empty table none. A model without
    languages answers 'und'.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        read = np.flatnonzero([bool(t and _LETTER.search(t)) for t in texts])
        for at in range(0, len(read), BLOCK):
            some = read[at : at + BLOCK]
            langs[some], scores[some] = cast.value.predict_all(np.stack([features(t) for t in texts.iloc[some]]))
        give_back()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    plain = docs.drop("lang_pred", "score")
    (name,) = free(plain, "judged")
    return plain.withColumn(name, judge(F.col(text_col))).select(*plain.columns, f"{name}.lang_pred", f"{name}.score")
