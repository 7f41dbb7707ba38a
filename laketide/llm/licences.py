"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A unit of text is a line, or the whole text of a file. Units and templates are bags of words
(lower-cased runs of ASCII letters and digits), weighted by count times log((1 + N) / (1 + df)) + 1; df
is counted over all N documents. Words outside the templates weigh as if never seen, so foreign
text lowers the cosine. A unit matches its most similar template if the cosine is at least
``COSINE``; ties go to the smaller name. A document's own licence is its best unit.

Units are not compared blindly: for each template the heaviest words are picked until the other
words cannot reach ``COSINE`` by themselves (by the inequality of Cauchy and Schwarz). A unit without
any such word cannot match, so only units with one are taken apart. No unit that could match
is lost.

A document whose licence stands in its first line, or that is named like a licence file, speaks
for its directory. Every directory then gets the licence of the nearest directory at or above it
that has one: directories are joined with all their ancestors, documents only with their own
directory. In one directory the best match speaks, then the smaller name.

Everything is a DataFrame expression. Only template words and their counts reach the driver.

Defined results: null or empty text has no licence of its own; a null path has no directory, so
it inherits nothing; repeated rows are judged alike.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.llm.common import packed, stored

COSINE = 0.75
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"

#: Short headers of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}


def _bag(text: str) -> Counter:
    return Counter(re.findall(r"[a-z0-9]+", text.lower()))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


class Templates:
    """Templates with the weights of a corpus."""

    def __init__(self, templates: dict[str, str], documents: int, df: dict[str, int], cosine: float):
        self.cosine = cosine
        self.unseen = math.log(1 + documents) + 1
        bags = {name: _bag(text) for name, text in sorted(templates.items())}
        self.weight = {w: math.log((1 + documents) / (1 + df.get(w, 0))) + 1 for bag in bags.values() for w in bag}
        self.vectors = {name: {w: n * self.weight[w] for w, n in bag.items()} for name, bag in bags.items()}
        self.keys: set[str] = set()
        for vector in self.vectors.values():
            left = sum(v * v for v in vector.values())
            limit = (cosine * 0.999) ** 2 * left
            for w in sorted(vector, key=lambda w: (-vector[w], w)):
                if left < limit:
                    break
                self.keys.add(w)
                left -= vector[w] ** 2
        self.pattern = r"(?i)(?<![a-z0-9])(" + "|".join(sorted(self.keys)) + r")(?![a-z0-9])"

    def best(self, unit: Column) -> Column:
        """struct(cosine, name) of the most similar template."""
        rows = [{"name": name, "norm": math.sqrt(sum(v * v for v in vec.values())), "w": vec} for name, vec in self.vectors.items()]
        table = F.from_json(F.lit(json.dumps(rows)), "array<struct<name string, norm double, w map<string,double>>>")
        weight = F.from_json(F.lit(json.dumps(self.weight)), "map<string,double>")

        def compare(bag: Column) -> Column:
            # bag: distinct words with their counts
            norm = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, x: a + F.pow(x["n"] * F.coalesce(weight[x["w"]], F.lit(self.unseen)), F.lit(2.0))))

            def score(t: Column) -> Column:
                dot = F.aggregate(bag, F.lit(0.0), lambda a, x: a + F.coalesce(t["w"][x["w"]], F.lit(0.0)) * x["n"] * F.coalesce(weight[x["w"]], F.lit(0.0)))
                return F.struct((-F.round(dot / (t["norm"] * norm), 9)).alias("far"), t["name"].alias("name"))

            return F.array_min(F.transform(table, score))

        return F.transform(F.array(_counted(_terms(unit))), compare)[0]


def _counted(terms: Column) -> Column:
    """Distinct words and their counts, by sorting and keeping the last of each run with its place."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        last = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == n - 1) | (s[F.least(x["i"] + 1, n - 1)] != x["w"]))

        def lengths(e: Column) -> Column:
            return F.transform(e, lambda x, k: F.struct(x["w"].alias("w"), (x["i"] - F.when(k == 0, F.lit(-1)).otherwise(e[F.greatest(k - 1, F.lit(0))]["i"])).cast("double").alias("n")))

        return F.transform(F.array(last), lengths)[0]

    return F.transform(F.array(F.array_sort(terms)), runs)[0]


def learn(docs: DataFrame, templates: dict[str, str] | None = None, cosine: float = COSINE) -> Templates:
    """Document frequencies of the templates' words over all of ``docs``."""
    templates = templates or TEMPLATES
    words = sorted({w for t in templates.values() for w in _bag(t)})
    # one aggregate: how many documents have each word; the word is looked for in the distinct words of a text
    listed = F.from_json(F.lit(json.dumps(words)), "array<string>")
    got = docs.select(F.explode(F.array_intersect(_terms(F.coalesce("text", F.lit(""))), listed)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return Templates(templates, docs.count(), {r["w"]: r["n"] for r in got}, cosine)


def scan(docs: DataFrame, model: Templates, path: str = "path", into: str = "licence", any_speaks: bool = False) -> DataFrame:
    """Every row of ``docs`` (``text`` and a path) with a struct: own and inherited licence, cosine, governing directory.

    With ``any_speaks`` every licence that is found speaks for its directory.
    """
    row = docs.select(packed(docs).alias("row"), F.col(path).alias("path"))
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def own(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(model.pattern)))
        matched = F.transform(lines, lambda x: model.best(x))
        return F.array_min(F.concat(matched, F.array(model.best(t))))

    first = F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1)
    hit = F.when(F.rlike(text, F.lit(model.pattern)), own(text))
    # exploded arrays of one: filters stay above, so a text is compared once
    row = row.select("*", F.explode(F.array(hit)).alias("hit"))
    row = row.select("row", "path", F.explode(F.array(F.when(-F.col("hit.far") >= model.cosine, F.col("hit")))).alias("hit"))
    head = F.when(F.col("hit").isNotNull() & F.rlike(first, F.lit(model.pattern)), model.best(first))
    name = F.element_at(F.split("path", "/"), -1)
    row = row.withColumn("speaks", F.col("hit").isNotNull() & (F.rlike(name, F.lit(FILE_NAME)) | F.coalesce(-head["far"] >= model.cosine, F.lit(False)) | F.lit(any_speaks)))
    row = row.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    spoken = row.where("speaks AND dir IS NOT NULL").groupBy("dir").agg(F.min("hit").alias("h"))
    spoken = stored(spoken.select(F.col("dir").alias("at"), F.col("h.name").alias("inherited")), "licence-dirs")
    dirs = row.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    climb = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.at").join(spoken, "at")
    nearest = climb.groupBy("dir").agg(F.max_by("inherited", "depth").alias("inherited"), F.max_by("at", "depth").alias("at"))
    out = row.join(nearest.withColumnRenamed("dir", "d"), F.col("dir") == F.col("d"), "left")
    return out.select(
        "row.*",
        F.struct(
            F.col("hit.name").alias("own_licence"),
            (-F.col("hit.far")).alias("cosine"),
            F.col("inherited").alias("inherited_licence"),
            F.col("at").alias("inherited_from"),
            F.coalesce("hit.name", "inherited").alias("licence"),
        ).alias(into),
    )
