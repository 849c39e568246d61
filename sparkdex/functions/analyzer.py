"""Text analysis for full-text indexes: folding, tokens, stop-words, stems."""

from __future__ import annotations

import unicodedata
import zipfile
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import regex
from pyspark import SparkContext

from sparkdex.functions.spanish_stemmer import stem

_RUNS = regex.compile(r"\p{L}+")
_PEEL = regex.compile(r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$")


@lru_cache(maxsize=8)
def stop_words(language: str = "spanish") -> frozenset[str]:
    """The stop-words of a language that Spark ships, as written there, accents included."""
    sc = SparkContext._active_spark_context
    if sc is not None:
        return frozenset(sc._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords(language))
    from pyspark.find_spark_home import _find_spark_home

    jar = next(Path(_find_spark_home(), "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return frozenset(z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8").split())


def fold(text: str) -> str:
    """Lower case, NFKD, combining marks removed."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Analyzer:
    """profile "simple": runs of letters. profile "spanish": blank-split tokens with outer
    punctuation peeled off, kept only if all letters (a token with a digit, hyphen or
    apostrophe inside vanishes), stop-words dropped, Spanish stems. Accents go before the
    stop-word test, so accented stop-words stay. The stop-words travel with the analyzer."""

    profile: str = "spanish"
    stops: frozenset[str] | None = None

    def __post_init__(self) -> None:
        if self.stops is None:
            object.__setattr__(self, "stops", frozenset() if self.profile == "simple" else stop_words(self.profile))

    def terms(self, text: str | None) -> list[str]:
        if not text:
            return []
        folded = fold(text)
        if self.profile == "simple":
            return _RUNS.findall(folded)
        tokens = (_PEEL.sub("", t) for t in folded.split())
        return [stem(t) for t in tokens if t.isalpha() and t not in self.stops]
