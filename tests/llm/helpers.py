"""Small tables and plain-Python versions that the operators are held against."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, extra=()):
    """documents of (id, text) pairs or texts, ids from 0; ``extra`` rows are appended whole."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def clashing(docs):
    """With extra columns named like results and inner columns."""
    from pyspark.sql import functions as F

    names = ("_id", "_text", "_row", "key", "a", "b", "node", "component", "rep", "n", "score", "kept", "lang_pred", "home", "start")
    return docs.withColumns({c: F.lit("x") for c in names})


def same_beside(one, two, names):
    """Whether ``two`` holds the columns ``names`` of ``one`` untouched, row by row of doc_id."""
    rows = [{(str(r.doc_id), *[str(r[c]) for c in names]) for r in df.select("doc_id", *names).collect()} for df in (one, two)]
    return bool(rows[1]) and rows[1] <= rows[0]


def prose(rnd: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
