"""A small corpus with copies, near copies, shared passages, benchmark windows, nulls and odd texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ter", "sun", "po", "rel"], "bb": ["zü", "gra", "ñe", "wix", "hoo", "ply", "dra"]}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passage = " ".join(words(rng, "aa", 55))
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        text = words(rng, lang, rng.randint(12, 120))
        if i % 10 == 4:
            text[len(text) // 2 : len(text) // 2] = passage.split()
        if i % 12 == 5:
            text = rows[i - 3][1].split()
            text[len(text) // 2] = "changed"
        rows.append((i, " ".join(text) + ".", lang, f"s{i % 4}", 0))
    rows += [(n, rows[7][1], "aa", "s0", 0), (n + 1, rows[7][1], "aa", "s0", 0)]
    rows += [(n + 2, None, "aa", None, None), (n + 3, "", "bb", "s1", 0), (n + 4, "  \n\t ", None, "s1", 0), (n + 5, "12 34 !!", None, "s2", 8)]
    rows += [(n + 6, "x" * 5000, "aa", "s2", 5000), (n + 7, "one", "aa", "s3", 3), (n + 8, "one", "aa", "s3", 3)]
    return [(*r[:4], len(r[1]) if r[1] else r[4]) for r in rows]


#: The odd rows that every operator must take: nulls in all columns, empty texts, repeated rows.
ODD = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "aa", "s", 0), (2, "", "aa", "s", 0), (3, "la la la", None, None, 8), (3, "la la la", None, None, 8), (None, "a b c d e f", "aa", "s", 11)]
