"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = [a + b for a in ("an", "ber", "con", "de", "er", "lo", "mi", "que", "th", "un") for b in ("da", "er", "ing", "ly", "mo", "ra", "st", "ti", "us", "ve")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark, extra="text string, score string"):
    """doc_id, text, source, lang, n_chars and clashing extra columns: nulls, empty and long texts, ties, repeats."""
    rng = random.Random(4)
    base = [text(rng, 80) for _ in range(12)]
    rows = [(i, base[i], f"s{i % 3}", "en", len(base[i])) for i in range(12)]
    rows += [(20, base[0], "s0", "en", 1), (21, base[1] + " tail", "s1", None, 1), (22, base[2].upper(), "s1", "de", 1)]
    rows += [(30, None, "s0", "en", None), (31, "", None, "en", 0), (32, " \n\t ", "s2", "en", 4), (33, "one two", "s2", "en", 7), (34, "a\x00b \U0001f600 é\u0301 <|endoftext|>", "s2", "en", 9)]
    rows += [(40, text(rng, 9000), "s0", "en", 1), (50, base[3], None, "en", 1), (50, base[3], None, "en", 1), (None, base[4], "s1", "en", 1), (None, None, None, None, None)]
    rows += [(60 + i, f"{text(rng, 60)}!!!", "hot", "en", 1) for i in range(6)]
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, node string, id string, size int")
    return df


def empty(df):
    return df.limit(0)
