"""Language identification by rank-order n-gram profiles.

Training counts the 1- to 3-grams of labelled texts in Spark (each task sends one row per language and n-gram
it saw, which are summed by key) and keeps each language's PROFILE most frequent ones, ranked. A document's
own most frequent n-grams are ranked the same way; its distance to a language is the sum of how far each is
out of place, PROFILE for one that the language doesn't rank. The nearest language wins, the first by name on
a tie; ties of frequency are broken by the n-gram's code points.

Texts are lower-cased; a run of characters that aren't letters is one blank, which n-grams may start or end
with but not contain in the middle.

score is 1 - distance / largest possible distance, so it compares across lengths: near 0 means a text that
no learned language resembles.

Cases: a null text, an empty one and one without a letter are `und` with score 0; with nothing to learn from,
every text is; rows with a null id are predicted but never learned from; repeated rows get equal answers;
the driver holds PROFILE n-grams per language only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
#: Below this closeness to every profile a document is in no language that was learned, however few labelled rows there are.
LEAST_SCORE = 0.05
#: A document must come to this share of the score that all but LOW of its language's labelled rows of its size reach.
SHARE, LOW = 2 / 3, 0.01
#: Labelled rows from which a language's rows of a size have a limit of their own.
LIMIT_ROWS = 100


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of a text as integers (21 bits a code point); none if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, 32).astype(np.int64)
    code = np.concatenate([[32], code, [32]])
    blank = code == 32
    code = code[~(blank & np.concatenate([[False], blank[:-1]]))]
    blank = code == 32
    two = (code[:-1] << 21 | code[1:]) + (1 << 42)
    three = (code[:-2] << 42 | code[1:-1] << 21 | code[2:]) | (1 << 62)
    return np.concatenate([code[~blank], two, three[~blank[1:-1]]])


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over a table of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for lang, parts in waiting.items():
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n, pa.int64())], ["lang", "gram", "n"])
                waiting.clear()

            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                got = grams(text.as_py())
                waiting.setdefault(lang.as_py(), []).append(got)
                size += len(got)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
            yield from flush()

    return labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, most frequent first."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (where if where is not None else F.lit(True)))
    counts = count_grams(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "rank", "gram").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64) for lang, g in out.items()}


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs, self.worst = sorted(profiles), profile
        self.known = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and class of size: the binary digits of the number of ranked n-grams."""
        got = grams(text) if text else np.zeros(0, np.int64)
        if not len(got) or not self.langs:
            return UNKNOWN, 0.0, 0
        gram, n = np.unique(got, return_counts=True)
        top = gram[np.argsort(-n, kind="stable")[: self.worst]]
        at = np.searchsorted(self.known, top)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == top[found]
        rank = self.rank[np.where(found, at, len(self.known))]
        away = np.where(rank < 0, self.worst, np.abs(rank - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.worst * len(top))), len(top).bit_length()


def language(profiles: dict[str, np.ndarray], text_col: str = "text", profile: int = PROFILE) -> Column:
    """struct(lang, score) of the text column."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        ranker = Ranker(profiles, profile)
        return pd.DataFrame([ranker.predict(t) for t in texts], columns=["lang", "score"])

    return predict(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose id's CRC isn't held out."""
    profiles = learn(docs, text_col, lang_col, F.col(id_col).isNotNull() & ~held_out(id_col))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), language(profiles, text_col).alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def limits(labelled: DataFrame, profiles: dict[str, np.ndarray], least: float = LEAST_SCORE, text_col: str = "text", lang_col: str = "lang") -> dict[tuple[str, int], float]:
    """The least score by language and class of size, and under ("", 0) that of all others, from every labelled row.

    Scores are counted in thousandths, so the driver holds 1000 counts per language and class at most.
    """

    @F.pandas_udf("size int, mille int")
    def scored(texts: pd.Series) -> pd.DataFrame:
        ranker = Ranker(profiles)
        return pd.DataFrame([(size, int(score * 1000)) for _, score, size in map(ranker.judge, texts)], columns=["size", "mille"])

    counts: dict[tuple[str, int], list] = {}
    for r in labelled.select(F.col(lang_col).alias("lang"), scored(F.col(text_col)).alias("p")).groupBy("lang", "p.size", "p.mille").count().orderBy("mille").collect():
        if r["size"]:
            counts.setdefault((r["lang"], r["size"]), []).append((r["mille"], r["count"]))
    out = {}
    for at, rows in counts.items():
        mille, n = np.array(rows).T
        if n.sum() >= LIMIT_ROWS:
            out[at] = max(least, SHARE * float(mille[np.searchsorted(np.cumsum(n), LOW * n.sum())]) / 1000)
    return out | {("", 0): min(out.values(), default=least)}


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that have no language: no letter, or less close to their nearest profile than limits() asks."""
    learned = F.col(id_col).isNotNull() & ~held_out(id_col)
    profiles = learn(docs, text_col, lang_col, learned)
    low = limits(docs.where(learned & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), profiles, least, text_col, lang_col)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        ranker = Ranker(profiles)
        return pd.Series([lang != UNKNOWN and score >= low.get((lang, size), low["", 0]) for lang, score, size in map(ranker.judge, texts)], dtype=bool)

    return docs.select(F.struct("*").alias("row"), known(F.col(text_col)).alias("known")).where("known").select("row.*")
