"""Small tables with nulls, empty and long texts, ties, copies and odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string, h string, n string, label string, rep string, pivot string"
EXTRA = ("x", "y", "z", "n", "l", "r", "p")


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    stems = {"en": "the of and that with from have been were would there".split(), "de": "der die und nicht über für müssen werden straße grün".split(), "fr": "le la être où très après même ça forêt élève".split()}[lang]
    return " ".join(rng.choice(stems) + str(rng.randrange(60)) * (rng.random() < 0.5) for _ in range(n))


def documents(spark, extra_rows=()):
    """Odd rows first, then prose with near copies, exact copies and a long text."""
    rng = random.Random(7)
    rows = [
        (0, None, None, None),
        (1, "", "en", ""),
        (2, "   \n\t ", "en", "a"),
        (3, "one", "en", "a"),
        (4, "One two", None, "b"),
        (5, "<|endoftext|> a  b\n\n c", "en", "b"),
        (6, "é 漢字 \U0001f600 x\x1cy   z", "fr", None),
        (7, "!!! 123 ###", "de", "ä"),
    ]
    base = [words(rng, rng.randrange(20, 160), rng.choice(["en", "de", "fr"])) for _ in range(25)]
    for i, t in enumerate(base):
        rows.append((100 + i, t, "en", rng.choice(["a", "b", "ä", None])))
    for i in range(40):  # near and exact copies
        w = base[i % 6].split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(1000)}"
        rows.append((200 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "en", "a"))
    rows.append((300, words(rng, 30_000), "en", "long"))
    rows.append((300, rows[-1][1], "en", "long"))  # a repeated row
    rows += list(extra_rows)
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
