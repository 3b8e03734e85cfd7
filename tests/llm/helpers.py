from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, rows, schema: str = DOC):
    """rows of (doc_id, text), or whole rows."""
    full = [(*r, "en", "s", len(r[1] or ""))[:5] if len(r) < 5 else r for r in rows]
    return spark.createDataFrame(full, schema)


def result(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
