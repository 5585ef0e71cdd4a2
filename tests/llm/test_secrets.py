"""Secret spans against Python patterns, ownership counts, and redaction."""

import hashlib
import random
import re

from tests.llm.helpers import SCHEMA, clashing, same_beside
from touchline.llm import secrets
from touchline.llm.queries import QUERIES

KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({KEYWORDS}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def base(text):
    spans = [(m.start(), k, name, m.end()) for k, (name, regex, group, least) in enumerate(KINDS)
             for m in regex.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))


def test_base_spans_equal_python(spark, tmp_path):
    rnd = random.Random(5)
    parts = ["password", "token=", "secret: ", "Token=tok", " = ", '"', "'", "abcdef", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "\n", " ",
             "é", "😀", "api_key", "APIKEY", "x", "ghp_" + "aB3" * 12, "=", ":", "Kk", "ſecret=abcdefgh", "\\Q", "$1"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))), "en", f"s{i % 7}", i) for i in range(400)]
    rows += [(None, None, None, None, None), (5, "", "en", None, 1), (6, "token=abcdefg", "en", None, 2), (6, "token=abcdefg", "en", None, 2),
             (7, "x" * 200000 + " token=abcdefgh " + "0" * 5000, "en", "s", 1)]
    clashing(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_owned_secrets"](spark, str(tmp_path)).collect()
    want = [(r[0], base(r[1])) for r in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=key) == sorted(
        ((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want), key=key)
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))


def test_examples_are_told_by_their_owners(spark):
    shared, own = "ghp_" + "aB3dE6gH" * 5, "ghp_" + "Zx9Yw8Vu" * 5
    rows = [(i, f"see {shared} here", "en", f"owner{i}", 1) for i in range(6)] + [(10, f"key {own}", "en", "me", 1), (11, f"key {own}", "en", "me", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r.spans for r in secrets.scan(df, "doc_id", "text", "source", "doc_id").collect()}
    assert all(found[i] == [] for i in range(6))
    assert [(s.kind, s.start, s.n_owners, s.n_repositories, s.live) for s in found[10]] == [("service", 4, 1, 2, True)]


def test_redaction_keeps_rows_and_examples(spark):
    shared = "AKIA" + "EXAMPLE1" * 2
    rows = [(i, f"id {shared} end", "en", f"owner{i}", 1) for i in range(6)]
    rows += [(10, "é token = 'abcd1234efgh' tail " + "0a1b2c3d" * 4 + "!", "en", "me", 1), (11, None, "en", "me", None), (11, "clean", None, None, 5)]
    names = ["_row", "_row2", "_hits", "_other", "_id", "_new", "_text", "_rest", "spans", "found", "at"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names])
    out = secrets.redact(df, "doc_id", "text", "source", "doc_id", "n_chars")
    assert out.columns == df.columns and same_beside(df, out, names)
    got = {(r.doc_id, r.lang): (r.text, r.n_chars) for r in out.collect()}
    assert len(got) == 9 and got[0, "en"][0] == rows[0][1]
    assert got[10, "en"] == ("é [SECRET]' tail [SECRET]!", 26)
    assert got[11, "en"] == (None, None) and got[11, None] == ("clean", 5)


def test_empty_table_and_native_plan(spark, small):
    df = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(df, "doc_id", "text", "source", "doc_id").count() == 0
    assert secrets.redact(df, "doc_id", "text", "source", "doc_id").count() == 0
    plan = QUERIES["op4_owned_secrets"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
