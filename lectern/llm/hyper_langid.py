"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is the product
of its letters' vectors, rotated by their place; a text is the sum of its
trigrams, a language the sum of its training texts.  A text gets the language
whose prototype has the largest cosine with it.

Letter vectors derive from the code point alone, so every worker makes the same
ones.  Training counts trigrams per language in each task and bundles once per
task; what is summed across tasks is one integer vector per language.
Prototypes (languages x DIM numbers) are the only thing sent to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

DIM = 1024
#: Trigram vectors a worker keeps (bounded memory: CACHE x DIM bytes).
CACHE = 40_000
#: Texts are worked through in pieces of so many characters, so memory does not follow a text's length.
PIECE = 1 << 18


class _Space:
    """Letter and trigram vectors of one worker."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.known: dict[int, int] = {}
        self.rows = np.empty((1024, DIM), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([77, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def bind(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Rows for the distinct grams, as float32 (all sums stay exact integers)."""
        if len(self.known) + len(grams) > CACHE:
            self.known.clear()
        if len(grams) > CACHE:
            return np.stack([self.bind(g) for g in grams.tolist()]).astype(np.float32)
        at = np.empty(len(grams), dtype=np.int64)
        for i, g in enumerate(grams.tolist()):
            k = self.known.get(g)
            if k is None:
                k = self.known[g] = len(self.known)
                if k >= len(self.rows):
                    self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
                self.rows[k] = self.bind(g)
            at[i] = k
        return self.rows[at].astype(np.float32)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIM, dtype=np.float64)
        for lo in range(0, len(grams), 4096):
            part = counts[lo : lo + 4096]
            total += part.astype(np.float64) @ self.vectors(grams[lo : lo + 4096]) if part.max() > 4096 else (
                part.astype(np.float32) @ self.vectors(grams[lo : lo + 4096])
            )
        return total


_IS_LETTER = np.zeros(0x110000, dtype=bool)
_BLOCK_DONE = np.zeros(0x1100, dtype=bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; the table is filled block by block as code points occur."""
    for block in np.unique(codes >> 8):
        if not _BLOCK_DONE[block]:
            lo = int(block) << 8
            _IS_LETTER[lo : lo + 256] = [chr(c).isalpha() for c in range(lo, lo + 256)]
            _BLOCK_DONE[block] = True
    return _IS_LETTER[codes]


_BLANK = np.array([32], dtype=np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and sums of their counts."""
    names, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return names, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters within words, with one blank before and after, and their counts.

    Pieces overlap by the last two signs, and letters are lower-cased without
    regard to their neighbours (a final sigma too), so cuts change nothing.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    last = _BLANK
    for lo in range(0, len(text), PIECE):
        raw = text[lo : lo + PIECE].replace("\u03a3", "\u03c3").lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
        codes = np.concatenate((last, np.where(_letters(codes), codes, 32), _BLANK if lo + PIECE >= len(text) else _BLANK[:0]))
        blank = codes == 32
        codes = codes[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        found.append(np.unique(grams[codes[1:-1] != 32], return_counts=True))
        if len(found) > 8:
            found = [_merged(found)]
        last = codes[-2:]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _merged(found)


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text, lang -> lang, sum (one row per language and task)."""
    space, sums, pending = _Space(), {}, {}

    def flush(lang: str) -> None:
        grams = np.concatenate([g for g, _ in pending[lang]])
        counts = np.concatenate([c for _, c in pending[lang]])
        names, at = np.unique(grams, return_inverse=True)
        total = space.bundle(names, np.bincount(at, counts).astype(np.int64))
        sums[lang] = sums.get(lang, 0) + total
        pending[lang] = []

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            grams, counts = trigrams(text or "")
            if len(grams):
                pending.setdefault(lang, []).append((grams, counts))
                if len(pending[lang]) >= 500:
                    flush(lang)
    for lang in list(pending):
        if pending[lang]:
            flush(lang)
    for lang, total in sums.items():
        yield pd.DataFrame({"lang": [lang], "sum": [np.rint(total).astype(np.int64)]})


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes; train: text, lang."""
    partial = train.where("lang is not null and text is not null").select("text", "lang").mapInPandas(trimmed(_train), "lang string, sum array<long>")
    summed = (
        partial.select("lang", F.posexplode("sum").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", F.transform("v", lambda z: z["x"]).alias("v"))
    )
    rows = sorted((r["lang"], r["v"]) for r in summed.collect())  # one row per language
    if not rows:
        return [], np.zeros((0, DIM))
    m = np.array([v for _, v in rows], dtype=np.float64)
    return [lang for lang, _ in rows], m / np.maximum(1e-300, np.linalg.norm(m, axis=1, keepdims=True))


def _predict(langs: list[str], unit: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = _Space()
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            for text in batch["text"]:
                grams, counts = trigrams(text or "")
                if not len(grams) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                v = space.bundle(grams, counts)
                norm = float(np.sqrt(v @ v))
                cos = (unit @ v) / norm if norm else np.zeros(len(langs))
                best = int(cos.argmax())
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield batch[["doc_id", "held_out"]].assign(lang_pred=pred, score=score)

    return run


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows whose lang is not null and that are not held out.  A null
    text, one without a letter, and any text if nothing could be learnt gets
    ``und`` and score 0; otherwise score is the cosine, cut to 0..1.  Equal
    cosines go to the first language in code point order.  Rows without a doc_id
    are not held out.  Repeated rows are ordinary rows, an empty table gives an
    empty result, further columns are ignored.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id"), parts, part).alias("held_out"),
    )
    langs, unit = prototypes(own.where("not held_out"))
    return own.select("doc_id", "text", "held_out").mapInPandas(
        trimmed(_predict(langs, unit)), "doc_id long, held_out boolean, lang_pred string, score double"
    )
