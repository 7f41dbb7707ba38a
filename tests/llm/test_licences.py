import math
import re
from collections import Counter

from laketide.llm import licences


def brute(rows, cosine=licences.COSINE):
    """Own licence of each text by comparing every line and the whole with every template."""
    bag = lambda t: Counter(re.findall(r"[a-z0-9]+", t.lower()))
    vocabulary = {w for t in licences.TEMPLATES.values() for w in bag(t)}
    df = Counter(w for _, text, _ in rows for w in vocabulary & set(bag(text or "")))
    weight = lambda w: math.log((1 + len(rows)) / (1 + (df[w] if w in vocabulary else 0))) + 1

    def cos(a, b):
        dot = sum(n * b[w] * weight(w) ** 2 for w, n in a.items())
        norm = lambda x: math.sqrt(sum((n * weight(w)) ** 2 for w, n in x.items()))
        return round(dot / (norm(a) * norm(b)), 9) if a else 0

    out = []
    for i, text, _ in rows:
        units = [*(text or "").split("\n"), text or ""]
        best = min(((-cos(bag(u), bag(t)), name) for u in units for name, t in licences.TEMPLATES.items()))
        out.append((i, best[1] if -best[0] >= cosine else None))
    return out


ROWS = [
    (1, "Released under the MIT License.\nhello there", "a/b/1"),
    (2, "hello", "a/b/2"),
    (3, "x\nlicensed under  CC BY-NC 4.0!", "a/c/3"),
    (4, "All rights reserved.", "a/LICENSE"),
    (5, "foo bar", "a/c/d/5"),
    (6, None, None),
    (7, "", "top"),
    (8, "Licensed under the\nApache License,\nVersion 2.0.", "z/COPYING.txt"),
    (9, "the license of this text is not known", "z/q/w/e/r/9"),
    (9, "the license of this text is not known", "z/q/w/e/r/9"),
    (None, "This work is licensed under the GNU General Public License, version 3.", "g/x"),
    (11, "All rights reserved by the public and the license of the form " * 5, "h/1"),
]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, path string, hit string, dir int")
    got = licences.scan(df, licences.learn(df))
    assert got.columns == [*df.columns, "licence"]
    rows = got.collect()
    assert sorted(((r["doc_id"], r["licence"]["own_licence"]) for r in rows), key=repr) == sorted(brute(ROWS), key=repr)
    inherited = {r["doc_id"]: (r["licence"]["inherited_licence"], r["licence"]["inherited_from"]) for r in rows}
    assert inherited[2] == ("MIT", "a/b") and inherited[5] == inherited[3] == ("Proprietary", "a")
    assert inherited[9] == ("Apache-2.0", "z") and inherited[6] == inherited[7] == (None, None)
    assert {r["doc_id"]: r["licence"]["licence"] for r in rows}[3] == "CC-BY-NC-4.0"
    anywhere = {r["doc_id"]: r["licence"]["inherited_licence"] for r in licences.scan(df, licences.learn(df), any_speaks=True).collect()}
    assert anywhere[5] == "CC-BY-NC-4.0"
    empty = df.where("false")
    assert licences.scan(empty, licences.learn(empty)).count() == 0


def test_counted(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("b a b c a b",), ("",), ("x",)], "t string")
    got = [dict((x["w"], x["n"]) for x in r[0]) for r in df.select(licences._counted(licences._terms(F.col("t")))).collect()]
    assert got == [{"a": 2, "b": 3, "c": 1}, {}, {"x": 1}]
