"""The matcher as SQL functions, for lateral joins and projections.

    register(spark)
    spark.sql("SELECT d.doc_id, s.* FROM docs d, LATERAL spans(d.text, d.own) s")
    spark.sql("SELECT scrub(text, own) FROM docs")
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.operators.matcher import Matcher, placeholders, splice

#: Dictionaries of which a worker keeps the automaton, as neighbouring rows often share one.
KEPT = 16


class _Matchers:
    """The automata of the last dictionaries of this worker."""

    def __init__(self) -> None:
        self.known: dict[tuple, Matcher] = {}

    def of(self, values: tuple[str, ...], protected: tuple[str, ...] = ()) -> Matcher:
        key = (values, protected)
        found = self.known.pop(key, None) or Matcher(values, protected)
        self.known[key] = found  # the newest stands last
        while len(self.known) > KEPT:
            del self.known[next(iter(self.known))]
        return found


class Spans:
    """The chosen occurrences of an array of values in a text: a row each, none for null or empty ones."""

    def __init__(self) -> None:
        self.matchers = _Matchers()

    def eval(self, text: str, values: list[str]) -> Iterator[tuple[int, int, str]]:
        some = tuple(sorted({v for v in (values if values is not None else ()) if v}))
        if text and some:
            yield from self.matchers.of(some).find(text)


def _replaced(texts: pa.Array, owns: pa.Array, matchers: _Matchers) -> list[str | None]:
    out = []
    for text, own in zip(texts.to_pylist(), owns.to_pylist(), strict=True):
        own = {k: v for k, v in own or () if k and v is not None}
        if text and own:
            text = splice(text, ((a, b, own[v]) for a, b, v in matchers.of(tuple(sorted(own)), tuple(sorted(placeholders(own.values())))).find(text)))
        out.append(text)
    return out


def scrub_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A text with every occurrence of a map's keys replaced by its values; without a text or map, as it is."""
    matchers = _Matchers()
    for texts, owns in batches:
        yield pa.array(_replaced(texts, owns, matchers), pa.string())


def register(spark: SparkSession) -> None:
    """``spans(text, array of values)`` as a table function and ``scrub(text, map)`` as a scalar one, for this session."""
    spark.udtf.register("spans", F.udtf(Spans, returnType="start int, end int, value string", useArrow=True))
    spark.udf.register("scrub", F.arrow_udf(scrub_text, "string"))
