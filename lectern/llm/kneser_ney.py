"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as
sorted hash arrays, memory-mapped by the workers that score.

Counting: a task turns chunks of text into distinct word pairs with counts and
sends them as packed arrays to the slice of the pair.  That is the slice of the
first word's hash; the followers of a frequent first word are spread over as
many slices as its share of the text asks for.  Shares come from a sample of
SAMPLE_BYTES and only balance the slices: whatever they are, every pair has one
slice and all counts are those of the whole text.  A slice merges its arrays and
writes a sorted array of pair hashes with counts.  What it learnt about words
(counts, distinct predecessors and followers) adds up in the slice of the word,
which writes the sorted array of word hashes with their facts.  Slices follow
the amount of text, so memory per task is bounded; rows between the steps are
never more than the pairs they carry.  Slices of at most PARTS tasks lie behind
one another in the same files, so files grow with the corpus and their number
does not.  Only sums go to the driver.

Scoring: workers map the files read-only (page cache, not heap) and look up the
distinct words and pairs of a megabyte of text at a time.

The files lie in the folder that all executors share (spark.checkpoint.dir),
which has to be mounted; a file is renamed into place once complete, so a task
that is run again rewrites it and a reader never sees half of one.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hyper_langid import held_out
from .shared import groups, shared_dir, table, trimmed
from .wordhash import mix64, words_of

BEGIN, END = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
#: Tokens of a counting chunk, and bytes of text per slice.
CHUNK_TOKENS, SLICE_BYTES = 1_000_000, 12_000_000
#: Tasks, and files of a kind, at most; beyond, a task takes several slices one after another.
PARTS = 4096
#: Text whose words tell which are frequent, and the most frequent words looked after.
SAMPLE_BYTES, FREQUENT = 8_000_000, 65_536
#: Part of a slice beyond which one word's followers go to a further slice.
EIGHTH = 8
_FACTS = ("cnt", "cont", "ctx", "n1", "n2", "n3")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mounted(path: str) -> str:
    """The local path of a shared folder."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model's files need a mounted shared folder, not {path}")
    return at.path


def sequence(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a piece, every text as BEGIN, words, END, and the position of each BEGIN."""
    size = len(offsets) - 1
    begins = offsets[:-1] + 2 * np.arange(size)
    out = np.empty(len(words) + 2 * size, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    ends = np.append(begins[1:], len(out)) - 1
    inner[begins] = inner[ends] = False
    out[begins], out[ends] = BEGIN, END
    out[inner] = words[offsets[0] : offsets[-1]]
    return out, begins


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a word hash: slices are consecutive ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


class Layout:
    """Where pairs and words lie: slices, parts, and the frequent words with the slices they are spread over."""

    def __init__(self, slices: int, names: np.ndarray, spread: np.ndarray) -> None:
        self.slices, self.parts = slices, min(slices, PARTS)
        self.names, self.spread = names, spread  # names in order

    def of_pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slice of a pair."""
        place = np.zeros(len(first), dtype=np.uint64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, first), len(self.names) - 1)
            hot = np.flatnonzero(self.names[at] == first)
            place[hot] = (second[hot] >> np.uint64(32)) * self.spread[at[hot]] >> np.uint64(32)
        return slice_of(mix64(first ^ place * _SPREAD), self.slices)

    def part(self, slices: np.ndarray | int) -> np.ndarray | int:
        return slices * self.parts // self.slices

    def first_slice(self, part: int) -> int:
        return -(-part * self.slices // self.parts)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text -> first words of pairs (as signed integers) and how often they stand in the task's texts."""
    found: Counter = Counter()
    for batch in batches:
        for _, offsets, words in words_of(batch["text"].tolist()):
            tokens, _ = sequence(offsets, words)
            names, counts = np.unique(tokens[tokens != END], return_counts=True)
            found.update(dict(zip(names.view(np.int64).tolist(), counts.tolist(), strict=True)))
    yield pd.DataFrame({"word": np.array(list(found), dtype=np.int64), "n": np.array(list(found.values()), dtype=np.int64)})


def layout(texts: DataFrame) -> Layout:
    """Slices by the size of the text, and the words to spread by a sample of it."""
    size = int(texts.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0)
    slices = max(1, -(-size // SLICE_BYTES))
    sample = texts.select("text").where(F.rand(5) < min(1.0, SAMPLE_BYTES / max(1, size)))
    counted = sample.mapInPandas(trimmed(_sampled), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = table(counted, "sampled")  # the words of SAMPLE_BYTES of text
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * (slices * EIGHTH) > total).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    names = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    spread = np.array([min(slices, -(-r["n"] * slices * EIGHTH // total)) for r in rows], dtype=np.uint64)
    order = np.argsort(names)
    return Layout(slices, names[order], spread[order])


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _SPREAD ^ second)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where their runs begin."""
    begin = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[begin], begin


def _count(lay: Layout):
    """text -> slice, packed first words, numbers of followers, followers, counts."""

    def flush(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        tokens = np.concatenate(parts)
        names, rank = np.unique(tokens, return_inverse=True)
        real = tokens[:-1] != END
        code = rank[:-1][real].astype(np.uint64) * np.uint64(len(names)) + rank[1:][real].astype(np.uint64)
        pairs, counts = np.unique(code, return_counts=True)
        first, second = pairs // np.uint64(len(names)), pairs % np.uint64(len(names))
        own = lay.of_pair(names[first], names[second])
        order = np.argsort(own, kind="stable")
        own, first, second, counts = own[order], first[order], second[order], counts[order]
        found, begins = _runs(own)
        rows = []
        for s, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True):
            heads, begin = _runs(first[a:b])
            followers = np.diff(np.append(begin, b - a)).astype(np.uint32)
            rows.append((s, names[heads].tobytes(), followers.tobytes(), names[second[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=["slice", "h", "f", "w", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, offsets, words in words_of(batch["text"].tolist()):
                tokens, _ = sequence(offsets, words)
                parts.append(tokens)
                held += len(tokens)
                if held >= CHUNK_TOKENS:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


class _Files:
    """A part's files of several kinds, written piece by piece and named once all are whole."""

    def __init__(self, folder: str, *kinds: str) -> None:
        self.folder, self.mark = folder, uuid.uuid4().hex
        self.open = {k: open(f"{folder}/{k}.{self.mark}", "wb") for k in kinds}

    def add(self, kind: str, values: np.ndarray) -> None:
        self.open[kind].write(np.ascontiguousarray(values).data)

    def name(self, part: int) -> None:
        for kind, f in self.open.items():
            f.close()
            os.replace(f.name, f"{self.folder}/{kind}-{part}")


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _merge_pairs(folder: str, lay: Layout):
    """Packed pairs of a part's slices -> its files; and what they tell about words, by the words' slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, part, offset, ends = None, 0, 0, {}
        for g in groups(batches, ["slice"]):
            s = int(g["slice"].iloc[0])
            if files is None:
                files, part = _Files(folder, "keys", "counts", "large", "ends"), lay.part(s)
            h = np.repeat(_joined(g["h"], np.uint64), _joined(g["f"], np.uint32))
            w, c = _joined(g["w"], np.uint64), _joined(g["c"], np.uint32).astype(np.int64)
            key = pair_key(h, w)
            order = np.argsort(key)
            key, begin = _runs(key[order])
            count = np.add.reduceat(c[order], begin)
            first = order[begin]  # one row of every pair
            del order, c
            h, w = h[first], w[first]
            del first
            files.add("keys", key)
            # nearly all counts fit a byte; the others stand in a list of their own
            large = np.flatnonzero(count >= 255)
            files.add("counts", np.minimum(count, 255).astype(np.uint8))
            files.add("large", np.stack((large + offset, count[large]), axis=1).astype(np.int64))
            offset += len(key)
            ends[s] = offset
            heads, at = np.unique(h, return_inverse=True)
            size = len(heads)
            context = np.stack(
                (
                    np.zeros(size), np.zeros(size), np.bincount(at, count, size), np.bincount(at[count == 1], minlength=size),
                    np.bincount(at[count == 2], minlength=size), np.bincount(at[count > 2], minlength=size),
                ), axis=1,
            ).astype(np.int64)
            names, at = np.unique(w, return_inverse=True)
            seen = np.zeros((len(names), len(_FACTS)), dtype=np.int64)
            seen[:, 0], seen[:, 1] = np.bincount(at, count), np.bincount(at)
            rows = [(s, b"", b"", [int((count == k).sum()) for k in (1, 2, 3, 4)])]
            for words, facts in ((heads, context), (names, seen)):
                found, begins = _runs(slice_of(words, lay.slices))
                for t, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(words)], strict=True):
                    rows.append((t, words[a:b].tobytes(), facts[a:b].tobytes(), [0, 0, 0, 0]))
            yield pd.DataFrame(rows, columns=["slice", "names", "facts", "stats"])
        if files is not None:
            own, at = [], 0
            for s in range(lay.first_slice(part), lay.first_slice(part + 1)):  # a slice may be empty
                at = ends.get(s, at)
                own.append(at)
            files.add("ends", np.array(own, dtype=np.int64))
            files.name(part)

    return run


def _merge_words(folder: str, lay: Layout):
    """Facts of the words of a part's slices -> its files; sums over its words, then those over its pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, part = None, 0
        for g in groups(batches, ["slice"]):
            if files is None:
                files, part = _Files(folder, "names", "facts"), lay.part(int(g["slice"].iloc[0]))
            names = _joined(g["names"], np.uint64)
            facts = _joined(g["facts"], np.int64).reshape(len(names), len(_FACTS))
            order = np.argsort(names, kind="stable")
            names, begin = _runs(names[order])
            facts = np.add.reduceat(facts[order], begin, axis=0) if len(names) else facts
            files.add("names", names)  # slices are ranges of hashes, so the file is in order
            files.add("facts", facts)
            cnt, cont = facts[:, 0], facts[:, 1]
            sums = [int((cnt > 0).sum()), int(cnt.sum()), int(cont.sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())]
            sums += [int(x) for x in np.stack(g["stats"].to_list()).sum(axis=0)]
            yield pd.DataFrame({"sums": [sums]})
        if files is not None:
            files.name(part)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more out of the numbers of items counted 1 to 4 times."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] > 0 and n[0] + 2 * n[1] > 0:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] > 0 and n[k] > 0:
                out[k] = k - (k + 1) * y * n[k] / n[k - 1]
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


class Model:
    """A trained model: folder, layout and global sums; arrays are mapped on first use."""

    def __init__(self, folder: str, lay: Layout, stats: list[int], sums: list[int]) -> None:
        self.folder, self.lay = folder, lay
        self.types, self.tokens, self.continued = sums[:3]
        self.pair_d, self.word_d = discounts(stats), discounts(sums[3:7])
        d, n = self.word_d, sums
        freed = d[1] * n[3] + d[2] * n[4] + d[3] * n[7]
        self.floor = (freed / self.continued if self.continued else 1.0) / (self.types + 1)
        self._maps: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": {}}

    def _map(self, name: str, kind: type) -> np.ndarray:
        if name not in self._maps:
            path = f"{self.folder}/{name}"
            if not os.path.exists(path) or not os.path.getsize(path):
                self._maps[name] = np.zeros(0, dtype=kind)
            else:
                with open(path, "rb") as f:
                    try:  # no file descriptor is held for a map
                        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
                    except TypeError:
                        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                self._maps[name] = np.frombuffer(m, dtype=kind)
        return self._maps[name]

    def words(self, names: np.ndarray) -> np.ndarray:
        """Facts of sorted distinct word hashes, zeros for unknown ones."""
        out = np.zeros((len(names), len(_FACTS)), dtype=np.int64)
        found, begins = _runs(self.lay.part(slice_of(names, self.lay.slices)))
        for p, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(names)], strict=True):
            have = self._map(f"names-{p}", np.uint64)
            if len(have):
                at = np.minimum(np.searchsorted(have, names[a:b]), len(have) - 1)
                facts = self._map(f"facts-{p}", np.int64).reshape(-1, len(_FACTS))
                out[a:b] = facts[at] * (have[at] == names[a:b])[:, None]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of pairs, 0 for unknown ones."""
        out = np.zeros(len(first), dtype=np.int64)
        own = self.lay.of_pair(first, second)
        order = np.argsort(own, kind="stable")
        key = pair_key(first, second)
        found, begins = _runs(own[order])
        for s, a, b in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            part, p = order[a:b], self.lay.part(s)
            ends, k = self._map(f"ends-{p}", np.int64), s - self.lay.first_slice(p)
            if not len(ends):
                continue
            lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
            if lo == hi:
                continue
            have = self._map(f"keys-{p}", np.uint64)[lo:hi]
            at = np.minimum(np.searchsorted(have, key[part]), hi - lo - 1)
            counts = self._map(f"counts-{p}", np.uint8)[lo:hi]
            got = counts[at].astype(np.int64)
            over = np.flatnonzero(got == 255)
            if len(over):
                large = self._map(f"large-{p}", np.int64).reshape(-1, 2)
                got[over] = large[np.searchsorted(large[:, 0], at[over] + lo), 1]
            out[part] = got * (have[at] == key[part])
        return out

    def probabilities(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per adjacent pair of tokens: probability of the second, and its count as a word."""
        names, rank = np.unique(tokens, return_inverse=True)
        facts = self.words(names).astype(np.float64)
        cont = facts[:, 1]
        d = self.word_d[np.minimum(cont, 3).astype(np.int64)]
        low = np.maximum(cont - d, 0) / max(1, self.continued) + self.floor
        ctx = facts[:, 2]
        d1, d2, d3 = self.pair_d[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(ctx > 0, (d1 * facts[:, 3] + d2 * facts[:, 4] + d3 * facts[:, 5]) / ctx, 1.0)
        code = rank[:-1].astype(np.uint64) * np.uint64(len(names)) + rank[1:].astype(np.uint64)
        pairs, at = np.unique(code, return_inverse=True)
        h, w = (pairs // np.uint64(len(names))).astype(np.int64), (pairs % np.uint64(len(names))).astype(np.int64)
        c = self.pairs(names[h], names[w]).astype(np.float64)
        high = np.maximum(c - self.pair_d[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(ctx[h], 1)
        return (high + back[h] * low[w])[at], facts[rank[1:], 0]


def train(texts: DataFrame) -> Model:
    """Learns from the column text (null: empty); the model's files stay in the shared folder."""
    spark = texts.sparkSession
    folder = f"{mounted(shared_dir(spark))}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    lay = layout(texts)
    packed = texts.select("text").mapInPandas(trimmed(_count(lay)), "slice int, h binary, f binary, w binary, c binary")
    part = F.expr(f"int(bigint(slice) * {lay.parts} div {lay.slices})")
    by_part = lambda df: df.repartitionById(lay.parts, part).sortWithinPartitions("slice")
    learnt = by_part(packed).mapInPandas(trimmed(_merge_pairs(folder, lay)), "slice int, names binary, facts binary, stats array<long>")
    merged = table(by_part(learnt).mapInPandas(trimmed(_merge_words(folder, lay)), "sums array<long>"), "sums")
    sums = _sums(merged, 12)
    return Model(folder, lay, sums[8:], sums[:8])


def _sums(rows: DataFrame, n: int) -> list[int]:
    """Sums of the places of the array in the column sums."""
    found = rows.agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in found]


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = np.log10(model.tokens + model.types + 1)
        for batch in batches:
            for first, offsets, words in words_of(batch["text"].tolist()):
                tokens, begins = sequence(offsets, words)
                p, c = model.probabilities(tokens)
                # the step from one text's end to the next one's begin is no token
                p, c = np.append(p, 1.0), np.append(c, 0.0)
                step = np.append(begins[1:], len(tokens)) - 1
                p[step], c[step] = 1.0, 0.0
                own = np.log10(c + 1) - base
                own[step] = 0.0
                out = batch[["doc_id", "held_out"]].iloc[first : first + len(begins)].copy()
                out["n_tokens"] = np.diff(offsets) + 1
                out["n_known"] = np.add.reduceat((c > 0).astype(np.int64), begins)
                out["train_tokens"] = model.tokens
                out["base_score"] = np.add.reduceat(own, begins)
                out["score"] = np.add.reduceat(np.log10(p), begins)
                yield out

    return run


def score_documents(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out; rows without a doc_id are not.
    Null and empty texts are one token, the end.  Words are hashed to 64 bits;
    unknown words share the model's floor.  Without anything to learn from all
    scores are 0.  Repeated rows are ordinary rows, an empty table gives an
    empty result, further columns are ignored.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        held_out(F.col("doc_id"), parts, part).alias("held_out"),
    )
    model = train(own.where("not held_out"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.mapInPandas(trimmed(_score(model)), schema)
