"""Fixtures and brute-force twins shared by the tests of the training-data operators."""

from __future__ import annotations

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER) if lower else (text or ""))


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 5, n: int = 40) -> list[tuple]:
    """Documents with copies, near copies, nulls, empties, one long text, and repeated rows."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        text = "\n".join(prose(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6)))
        rows.append((i, text, rng.choice(["aa", "bb"]), f"s{i % 4}"))
    for i in range(5):  # copies and copies with one word changed
        rows.append((100 + i, rows[i][1], "aa", "s1"))
        changed = rows[i][1].split(" ")
        changed[-1] = "changed"
        rows.append((200 + i, " ".join(changed), "bb", None))
    rows += [
        (300, None, "aa", "s0"), (301, "", "aa", "s1"), (302, " \n\t ", None, "s2"), (303, "one", "aa", "s3"),
        (304, "one two three", None, None), (305, "one two three", "bb", "s0"), (None, prose(rng, 60), "aa", "s1"),
        (306, prose(rng, 9000, 3000), "aa", "s2"), (307, "É à ñ ünï 日本 😀 A B C", "bb", "s0"),
    ]
    rows += [rows[3], rows[3]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
