"""Entity resolution against brute force."""

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from touchline.functions.text import _foldings, _ranges, normalize_person
from touchline.operators import resolve
from touchline.operators.resolve import Rule

WORDS = ["ana", "bo", "cruz", "da", "eli", "fox", "gil", "han", "io", "jan", "a", "anab", "o", "cruzda", "lifo", "hani", "janana", "nab"]


def people(spark, rng, n, longest):
    names = [" ".join(rng.choice(WORDS, rng.integers(1, longest + 1), replace=True)) for _ in range(n)]
    pdf = pd.DataFrame({"id": range(n), "name": names, "dob": rng.choice(["d1", "d2", None], n, p=[.6, .3, .1]), "nat": "n"})
    return pdf, spark.createDataFrame(pdf)


def test_token_overlap_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    for longest in (1, 4, 15):
        lp, l = people(spark, rng, 40, longest)
        rp, r = people(spark, rng, 60, longest)
        got = resolve.best_token_overlap(
            l.withColumn("tok", resolve.name_tokens(F.col("name"))), r.selectExpr("id as seq", "dob", "nat", "name as rname").withColumn("rtok", resolve.name_tokens(F.col("rname"))),
            "id", "tok", "rtok", ["dob", "nat"], "seq", ["seq"])
        want = {}
        for a in lp.dropna().itertuples():
            scores = [(-len(set(a.name.split()) & set(b.name.split())), b.id) for b in rp.dropna().itertuples() if b.dob == a.dob]
            if scores and min(scores)[0] < 0:
                want[a.id] = min(scores)[1]
        assert {x.id: x.seq for x in got.collect()} == want


def test_fuzzy_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    for longest in (1, 4, 15):
        lp, l = people(spark, rng, 40, longest)
        rp, r = people(spark, rng, 60, longest)
        left = l.withColumn("names", F.array("name", F.concat_ws(" ", F.reverse(F.split("name", " ")))))
        got = resolve.fuzzy_block_match(left, r.selectExpr("id as seq", "dob", "nat", "name as rname"), "id", "names", "rname", ["dob", "nat"], "seq", ["seq"])
        want = {}
        for a in lp.dropna().itertuples():
            best = (0.0, None, 0)
            for b in rp.dropna().itertuples():
                for name in (a.name, " ".join(reversed(a.name.split()))):
                    if b.dob != a.dob:
                        continue
                    x, y = set(b.name.split()), set(name.split())
                    score = len(x & y) / min(len(x), len(y))
                    u, v = b.name.replace(" ", ""), name.replace(" ", "")
                    if u in v or v in u:
                        score = max(score, 0.92)
                    if score > best[0]:
                        best = (score, b.id, min(len(x), len(y)))
            if best[0] >= 0.67 and best[2] >= 2:
                want[a.id] = best[1]
        assert {x.id: x.seq for x in got.collect()} == want


def test_ladder_order_and_nulls(spark):
    left = spark.createDataFrame([(1, ["x y", "y x"], "d"), (2, ["p q"], None), (3, ["none"], "d")], "id int, names array<string>, dob string")
    right = spark.createDataFrame([(1, "y x", "d"), (2, "x y", "d"), (3, "x y", "d"), (4, "p q", None)], "seq int, rname string, rdob string")
    rules = [Rule("name_dob", 1, ["name", "dob"], ["rname", "rdob"])]
    strict = {r.id: r.seq for r in resolve.ladder(left, right, "id", "names", rules, "seq", ["seq"]).collect()}
    assert strict == {1: 3}  # the first name wins, of its copies the last
    safe = {r.id: r.seq for r in resolve.ladder(left, right, "id", "names", rules, "seq", ["seq"], null_safe=True).collect()}
    assert safe == {1: 3, 2: 4}


def test_normalize_person_equals_unicode_rules(spark):
    names = ["DŽEKO Edin", "Łukasz Øre", "İbrahim Şahin", "Ångström", "ﬁn ½ ⑫", "O'Neill-Smith", "  ", "김민재", "Ǆ Ⅳ ｆｕｌｌ", "né", None]
    def plain(s):
        d = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower()
        return " ".join("".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in d).split())
    got = [r.n for r in spark.createDataFrame(list(enumerate(names)), "i int, s string").orderBy("i").select(normalize_person("s").alias("n")).collect()]
    assert got == [plain(s) if s else "" for s in names]




def test_hot_block_of_copies(spark):
    """Thousands of copies and of names with one frequent token: candidates stay few, results exact."""
    left = spark.range(3000).selectExpr("id", "'d' as dob", "'n' as nat", "array(concat('ana w', id, ' x', id)) as names")
    right = spark.range(6000).selectExpr("id as seq", "'d' as dob", "'n' as nat", "if(id < 3000, 'ana', concat('x', id - 3000, ' ana w', id - 3000)) as rname")
    got = resolve.fuzzy_block_match(left, right, "id", "names", "rname", ["dob", "nat"], "seq", ["seq"])
    # The one-token name scores 1.0 as well and comes first, so nothing has enough tokens.
    assert got.count() == 0
    got = resolve.fuzzy_block_match(left, right.where("seq >= 3000"), "id", "names", "rname", ["dob", "nat"], "seq", ["seq"])
    assert {(r.id, r.seq) for r in got.collect()} == {(k, k + 3000) for k in range(3000)}
    tokens = left.withColumn("t", resolve.name_tokens(F.col("names")[0]))
    got = resolve.best_token_overlap(tokens, right.withColumn("rt", resolve.name_tokens(F.col("rname"))), "id", "t", "rt", ["dob", "nat"], "seq", ["seq"])
    assert {(r.id, r.seq) for r in got.collect()} == {(k, k + 3000) for k in range(3000)}


def test_only_spread_characters_look_in_the_second_table():
    """Letters without a decomposition (Ł, ø, ı) are no reason to look; ligatures and fractions are."""
    class_ = re.compile(_ranges(json.loads(_foldings()[2])))
    assert not any(class_.search(c) for c in "aZ09 łøđıßжא漢é")
    assert all(class_.search(c) for c in json.loads(_foldings()[2]))


def test_stored_names_are_joined_by_key(spark):
    """A small file of repeated names may hold millions of rows: none is broadcast for its size on disk."""
    df = spark.createDataFrame([(i, "ana bo", "d", "n") for i in range(50)], "id int, name string, dob string, nat string")
    stored = resolve._stored(df)
    plan = stored.join(stored.groupBy("name").count(), "name")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
