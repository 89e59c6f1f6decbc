"""Rows for the tests."""

import random


def doc(i, text, lang="en", source="s1"):
    return (i, text, lang, source, len(text or ""), *["x"] * 11)


def prose(n, seed):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("lo", "rem", "ip", "su", "mdo", "lor") for b in ("sit", "am", "et", "con", "sec", "te")]
    return " ".join(r.choice(vocabulary) for _ in range(n))
