"""SentencePiece BPE encoding and decoding with a prefix table.

For every prefix of a segment the last token of its encoding is unique.  An
automaton lists the pieces that end at a position; the longest one that starts
the segment, or that may follow the last token of the prefix before it, is that
token.  Whether two tokens may stand side by side is a test on the pair alone:
merging their joined text must give just these two.  The ids are then read off
backwards.  Work is linear in the text, also for a text without a blank.

Pieces never hold a blank mark after another character, nor a line's end, so a
text falls into segments (blank marks, then other characters; or a line's end and
what follows) that are encoded independently; this is checked when the model is
loaded.  Segments repeat, so a worker keeps a
bounded table of those it has seen.  Only the model (its size is fixed) is sent
to the workers.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

MARK = "▁"
#: Entries of the segment and pair tables of a worker.
SEGMENTS, PAIRS = 400_000, 300_000
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Pieces, ids and scores of a BPE model with byte fallback."""

    def __init__(self, serialized: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model's normalisation is not the plain one")
        if proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("the model's decoder changes characters")
        kinds = proto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if sum(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces) < len(self.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        self.score = {p: proto.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.end_text = str(self.end)
        self.lines = not any("\n" in p for p in self.ids)  # then nothing merges across a line's end
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a blank after another character")
        # scores order the merges; where several pieces share one, order also depends on the place
        seen: dict[float, int] = {}
        for s in self.score.values():
            seen[s] = seen.get(s, 0) + 1
        self.tied = {p for p, s in self.score.items() if seen[s] > 1 and len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.id_texts = [str(i) for i in range(len(self.pieces))]
        spoken = set(self.ids.values())
        self.texts = [p.replace(MARK, " ") if i in spoken else None for i, p in enumerate(self.pieces)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges by definition: best score first, then leftmost; a heap over linked symbols."""
        n, score = len(text), self.score
        part: list[str | None] = list(text)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if part[i] is None or (j := nxt[i]) >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j], nxt[i] = joined, None, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (p := joined + part[nxt[i]]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            if prv[i] >= 0 and (p := part[prv[i]] + joined) in score:
                heapq.heappush(heap, (-score[p], prv[i], p))
        return [p for p in part if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when they meet; left '' asks about right alone."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def tokens(self, segment: str) -> list[str]:
        """The tokens of a segment; characters without a piece stay as they are."""
        if segment in self.ids and self.fits("", segment):
            return [segment]
        if MARK + MARK in segment and any(MARK + MARK in p for p in self.tied):
            return self.merge(segment)  # ties: the order of merges depends on the place
        pairs, fits = self.pairs, self.fits
        last: list[str] = [""] * len(segment)  # last[i]: the last token of segment[:i + 1]; '' so far
        # matches with one end come longest first
        for at, (piece, size) in self.automaton.iter(segment):
            if last[at]:
                continue
            if at < size:
                left = ""
            else:
                left = last[at - size]
                if not left:  # a character without a piece is a token of its own
                    left = last[at - size] = segment[at - size]
            ok = pairs.get((left, piece))
            if ok or (ok is None and fits(left, piece)):
                last[at] = piece
        out, i = [], len(segment) - 1
        while i >= 0:
            token = last[i] or segment[i]
            out.append(token)
            i -= len(token)
        return out[::-1]

    def segment(self, segment: str) -> tuple[str, int, str]:
        """Ids joined by blanks, their number, and the text they decode to (marks as blanks); not in young."""
        found = self.old.get(segment)
        if found is None:
            ids: list[int] = []
            known = self.ids
            for t in self.tokens(segment if segment[0] in "\n" + MARK else MARK + segment):
                i = known.get(t)
                if i is None:
                    ids.extend([self.bytes[b] for b in t.encode()])
                else:
                    ids.append(i)
            names = self.id_texts
            found = (" ".join([names[i] for i in ids]), len(ids), self.text_of(ids))
        if len(segment) <= 64:
            if len(self.young) >= SEGMENTS // 2:
                self.old, self.young = self.young, {}
            self.young[segment] = found
        return found

    def text_of(self, ids: list[int]) -> str:
        """Text of ids before the leading blank is taken off: pieces, and runs of byte tokens as UTF-8."""
        texts = self.texts
        plain = [texts[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out, run = [], bytearray()
        for i, piece in zip(ids, plain, strict=True):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(piece or "")
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids of the whole text with the end id, their number, and the decoded text."""
        if not text:
            return self.end_text, 1, ""
        # a word's key is the word, that of a word after a line's end begins with it
        parts = text.replace("\n", " \n").split(" ") if self.lines and MARK not in text else [""]
        if "" in parts:  # runs of blanks belong to one segment
            parts = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.young.get, parts))
        for at in [i for i, f in enumerate(found) if f is None] if None in found else ():
            found[at] = self.segment(parts[at])
        ids, counts, decoded = zip(*found, strict=True)
        return f"{' '.join(ids)} {self.end}", sum(counts) + 1, "".join(decoded)[1:]


_LOADED: dict[str, PieceModel] = {}


def model_of(serialized: bytes) -> PieceModel:
    key = hashlib.sha256(serialized).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(serialized)
    return _LOADED[key]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    more: "ids" (array<int>) and "decoded", in this order, as further columns.  Null and empty texts have the
    end id alone and decode to the empty text.  Any character is encoded (bytes
    where the model has no piece).  Null or repeated doc_ids are ordinary rows,
    an empty table gives an empty result, further columns are ignored.
    """
    with open(model_path, "rb") as f:  # on the driver; workers get the bytes
        serialized = f.read()
    PieceModel(serialized)
    step = 256 if more else 1 << 20
    sent = docs.sparkSession.sparkContext.broadcast(serialized)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(sent.value)
        for whole in batches:
            for lo in range(0, len(whole), step):  # ids and texts of few rows are held at once
                batch, rows = whole.iloc[lo : lo + step], []
                for text in batch["text"]:
                    ids, n, decoded = model.encode(text or "")
                    found = {"n_tokens": n, "ids_sha256": _sha(ids), "decoded_sha256": _sha(decoded)}
                    if "ids" in more:
                        found["ids"] = np.array(ids.split(), dtype=np.int32)
                    if "decoded" in more:
                        found["decoded"] = decoded
                    rows.append(tuple(found.values()))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *more])
                out.insert(0, "doc_id", batch["doc_id"].to_numpy())
                yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[m] for m in more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(trimmed(run), schema)
