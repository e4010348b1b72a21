"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import cut, prepare

# Notices by which licences ask to be named, and the first words of their texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Statements less similar than this to every template name no licence.
LEAST_COSINE = 0.7
#: A document of whose words statements make up this share is a licence file, as is one so named.
FILE_SHARE = 0.5
#: Terms of most documents, whose counts are sent to every task; other counts are joined by term.
COMMON_TERMS = 10_000
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.(txt|md|rst))?$"

_TERM = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_BREAK = re.compile(rb"(?<=[.!?;])\s+|[\r\n]+")
#: Terms that a task counts at once.
COUNTED_TERMS = 500_000


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, A-Z folded; dots and hyphens join, as in 2.0 and by-nc."""
    return _TERM.findall(text.lower())


def statements(text: bytes) -> list[bytes]:
    """Sentences and lines of a whole text."""
    return _BREAK.split(text)


class Templates:
    """The templates' vectors under the weights of a corpus."""

    def __init__(self, count: int, df: dict[str, int]):
        self.idf: dict[bytes, float] = {}
        self.vectors, self.of = [], {}
        for name, text in TEMPLATES:
            own = Counter(terms(text.encode()))
            self.idf |= {t: math.log((1 + count) / (1 + df.get(t.decode(), 0))) + 1 for t in own}
            vector = {t: n * self.idf[t] for t, n in own.items()}
            size = sum(x * x for x in vector.values()) ** 0.5
            self.vectors.append((name, {t: x / size for t, x in vector.items()}))
        for i, (_, vector) in enumerate(self.vectors):
            # By Cauchy and Schwarz a statement of LEAST_COSINE shares terms of LEAST_COSINE of the template's length,
            # and so one at least of any terms without which the template is shorter than that.
            left = 1.0
            for t in sorted(vector, key=lambda t: -self.idf[t]):
                if left < (LEAST_COSINE - _SLACK) ** 2:
                    break
                self.of.setdefault(t, []).append(i)
                left -= vector[t] ** 2

    def near(self, text: bytes) -> dict[tuple, int]:
        """Statements of a text that may be similar enough, and how many terms they have together.

        A statement is ``(dot, license, square, others)``: the product with the best template, the template's name, the
        squared length of what it shares with any template's terms, and ``(term, number)`` of its other terms.
        Other terms weigh 1 each at least, which bounds the cosine from above.
        """
        found: dict[tuple, int] = {}
        for s in statements(text):
            said = terms(s)
            if self.of.keys().isdisjoint(said):
                continue
            counts = Counter(said)
            mine = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
            square = sum(sorted(x * x for x in mine.values()))
            asked = {i for t in mine for i in self.of.get(t, ())}
            dots = {i: sum(sorted(mine[t] * x for t, x in self.vectors[i][1].items() if t in mine)) for i in asked}
            _, name, dot = max((round(d, 9), self.vectors[i][0], d) for i, d in dots.items())
            others = [(t.decode(), n) for t, n in sorted(counts.items()) if t not in self.idf]
            if dot >= (LEAST_COSINE - _SLACK) * (square + sum(n * n for _, n in others)) ** 0.5:
                key = (dot, name, square, tuple(others))
                found[key] = found.get(key, 0) + len(said)
        return found


_SLACK = 1e-9
_STATEMENT = T.StructType([T.StructField("dot", T.DoubleType()), T.StructField("license", T.StringType()), T.StructField("square", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("others", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])))])


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``(term, df)`` of the column ``text``: in how many rows a term is; each task adds up its rows first."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    counts.update(set(terms(text.as_py())))
                if len(counts) > COUNTED_TERMS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["term", "df"])

    return texts.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def scan_statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``(id, path, license, cosine, words, licensed_words)`` for every row: its best statement, and how many of its terms are in such.

    Terms weigh log((1 + documents) / (1 + documents with the term)) + 1, counted over all documents. Every
    sentence and line of every text is compared with every template; what can't reach ``LEAST_COSINE`` by bounds on
    the vectors goes early, whatever its terms are and however common. Only template terms' weights are sent to
    tasks; those of the other terms of what is left are joined, the most common ones by broadcast.
    Cosines are rounded to nine decimals; of equal ones the name last in the alphabet counts. Rows are told apart
    whatever their ids.
    """
    prepare(docs.sparkSession)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    light = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    vocabulary = sorted({t.decode() for _, text in TEMPLATES for t in terms(text.encode())})
    held = cut(document_frequencies(light).where((F.col("df") > 1) | F.col("term").isin(vocabulary)))  # a term of a statement is in one document at least
    count, df = light.count(), dict(held.where(F.col("term").isin(vocabulary)).collect())  # as many rows as template terms
    templates = Templates(count, df)
    schema = T.StructType([*light.schema.fields[:2], T.StructField("words", T.LongType()), T.StructField("near", T.ArrayType(_STATEMENT))])
    kind = to_arrow_type(T.ArrayType(_STATEMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, near = [], []
            for text in batch.column(2).cast(pa.binary()):
                own = terms(text.as_py()) if text.is_valid else []
                words.append(len(own))
                hit = not templates.of.keys().isdisjoint(own)
                near.append([{"dot": d, "license": a, "square": q, "size": n, "others": [{"term": t, "n": k} for t, k in o]} for (d, a, q, o), n in templates.near(text.as_py()).items()] if hit else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(near, kind)], ["id", "path", "words", "near"])

    rows = cut(light.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id()))
    said = rows.where(F.size("near") > 0).select("key", F.posexplode("near").alias("at", "s"))
    met = said.select("key", "at", F.explode("s.others").alias("o")).select("key", "at", "o.term", "o.n")
    common = held.orderBy(F.desc("df"), "term").limit(COMMON_TERMS)
    met = met.join(F.broadcast(common), "term", "left")
    met = met.where("df is not null").unionByName(met.where("df is null").drop("df").join(held, "term", "left"))
    idf_of = F.log(F.lit(1.0 + count) / (1 + F.coalesce("df", F.lit(1)))) + 1
    more = met.groupBy("key", "at").agg(F.sum(F.pow(F.col("n") * idf_of, F.lit(2))).alias("more"))
    scored = said.join(more, ["key", "at"], "left").withColumn("cosine", F.round(F.col("s.dot") / F.sqrt(F.col("s.square") + F.coalesce("more", F.lit(0.0))), 9)).where(F.col("cosine") >= LEAST_COSINE)
    found = scored.groupBy("key").agg(F.max(F.struct("cosine", "s.license")).alias("best"), F.sum("s.size").alias("licensed_words"))
    return rows.drop("near").join(found, "key", "left").select("id", "path", "best.license", "best.cosine", "words", F.coalesce("licensed_words", F.lit(0)).alias("licensed_words"))


def licenses(docs: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, path, license, cosine, origin, from_dir)`` for every row.

    A document's own statement comes first (``own``); without one it inherits from the licence file in the
    nearest directory above (``inherited``), found by joining its ancestors to the directories with such a
    file. Where a directory has several, those so named come first, then the most similar counts, ties going to
    the first name. Null and repeated ids, of any type, are carried along, each row having its own statement. Null texts are empty; null paths
    inherit nothing; an empty table gives no row; other columns aren't read.
    """
    rows = cut(scan_statements(docs, id_col, text_col, path_col).withColumnRenamed("id", "doc_id"))
    folder = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    named = F.col("path").rlike(FILE_NAME)
    files = rows.where("license is not null").where((F.col("licensed_words") >= FILE_SHARE * F.col("words")) | named)
    above = files.where("path is not null").groupBy(folder.alias("from_dir")).agg(F.min(F.struct((~named).alias("other"), (-F.col("cosine")).alias("x"), F.col("license").alias("license"))).alias("best"))
    above = cut(above.select("from_dir", F.col("best.license").alias("given"), (-F.col("best.x")).alias("given_cosine")))
    bare = rows.where("license is null and path is not null").withColumn("folder", folder)
    parts = F.split("folder", "/")
    ancestors = bare.select("folder").distinct().select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("from_dir"))
    nearest = ancestors.join(above, "from_dir").groupBy("folder").agg(F.max_by(F.struct("given", "given_cosine", "from_dir"), F.length("from_dir")).alias("up"))
    heirs = bare.join(nearest, "folder", "left").select("doc_id", "path", "up.given", "up.given_cosine", F.when(F.col("up").isNotNull(), "inherited").alias("origin"), "up.from_dir")
    own = rows.where("license is not null or path is null").select("doc_id", "path", "license", "cosine", F.when(F.col("license").isNotNull(), "own").alias("origin"), F.lit(None).cast("string").alias("from_dir"))
    return own.union(heirs)
