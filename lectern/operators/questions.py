"""A catalogue of named questions: query texts with parameters, answered and counted on a graph."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparql import answer


@dataclass(frozen=True)
class Question:
    """An id, a wording, a select text with $parameters, and the nodes that an answer is drawn around."""

    id: str
    wording: str
    text: str
    seeds: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)

    def compiled(self, **parameters: str) -> str:
        """The query text; a parameter without a value is an error, and none may hold what ends an IRI or a literal."""
        values = self.defaults | parameters
        for name, value in values.items():
            if any(c in value for c in "<>\"'\\{}\n"):
                raise ValueError(f"parameter {name} may not hold {value!r}")
        return string.Template(self.text).substitute(values)

    def fingerprint(self) -> str:
        """Changes with the text alone, not with parameters."""
        return hashlib.sha256(self.text.encode()).hexdigest()[:16]


def ask(graph: DataFrame, question: Question, **parameters: str) -> DataFrame:
    return answer(graph, question.compiled(**parameters))


def row_counts(graph: DataFrame, questions: Iterable[Question]) -> DataFrame:
    """(question, fingerprint, n): the number of rows of every question, in one job."""
    counts = [ask(graph, q).agg(F.count("*").alias("n")).select(F.lit(q.id).alias("question"), F.lit(q.fingerprint()).alias("fingerprint"), "n") for q in questions]
    return reduce(DataFrame.unionByName, counts)
