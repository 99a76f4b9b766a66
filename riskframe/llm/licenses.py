"""Licence scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest
ancestor directory that declares a licence."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, strings, text_or_empty, with_arrow, written

GNU = {"GPL": ("General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.0", "2.1", "3.0")),
       "AGPL": ("Affero General Public License", ("1.0", "3.0")), "GFDL": ("Free Documentation License", ("1.2", "1.3"))}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def notices() -> dict[str, list[str]]:
    """Notices by SPDX identifier (short forms of public licence notices)."""
    out = {
        "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
                "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files"],
        "ISC": ["Released under the ISC License.", "ISC License (ISC)",
                "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                "hereby granted"],
        "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
                       "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                       "compliance with the License."],
        "CC0-1.0": ["Released under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"],
        "LicenseRef-all-rights-reserved": ["All rights reserved."],
    }
    for n in ("2", "3"):
        out[f"BSD-{n}-Clause"] = [
            "Redistribution and use in source and binary forms, with or without modification, are permitted",
            f"Licensed under the BSD {n}-Clause License.", f"BSD {n}-Clause License"]
    for v in ("1.1", "2.0"):
        out[f"MPL-{v}"] = [f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.",
                           f"Mozilla Public License Version {v}"]
    redistribute = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as "
                    "published by the Free Software Foundation")
    for short, (name, versions) in GNU.items():
        thing = "library" if short == "LGPL" else "program"
        for v in versions:
            v2 = v.removesuffix(".0")
            out[f"{short}-{v}"] = [f"This work is licensed under the GNU {name}, version {v2}.", f"GNU {name} version {v2}",
                                   f"Licensed under the GNU {name} v{v2}.", f"Licensed under the {short} {v2}.",
                                   f"Licensed under the {short}v{v2}.", f"GNU {short} v{v2}"]
            if short != "GFDL":
                out[f"{short}-{v}"] += [redistribute.format(thing, name) + f"; either version {v2} of the License, or (at your "
                                        "option) any later version.", redistribute.format(thing, name)]
    for short, first in (("GPL", "1.0"), ("LGPL", "2.0")):  # any version, where none is stated
        name = GNU[short][0]
        out[f"{short}-{first}-or-later"] = [f"This work is licensed under the GNU {name}.", f"GNU {name}",
                                            redistribute.format("program", name)]
    for short, name in CC.items():
        for v, port in (("4.0", "International"), ("3.0", "Unported")):
            out[f"CC-{short}-{v}"] = [f"This work is licensed under a Creative Commons {name} {v} {port} License.",
                                      f"Licensed under CC {short} {v}.", f"Creative Commons {name} {v} {port} Public License"]
    return out


def templates_table(spark: SparkSession) -> DataFrame:
    """(license, text): the notices and the texts of the folder license_texts, by SPDX identifier."""
    rows = [(name, text) for name, texts in notices().items() for text in texts]
    rows += [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return spark.createDataFrame(rows, "license string, text string")


BODY_WORDS = 60  #: templates of more words are compared with whole texts alone
CONTEXT_LINES = 3  #: where a line states no version, these after it may
NAMED = (r"(?:general public licen[cs]e|documentation licen[cs]e|(?<![a-z])(?:a|l)?gpl|(?<![a-z])gfdl|mozilla public licen[cs]e|"
         r"(?<![a-z])mpl|(?<![a-z])apache(?: software)?(?: licen[cs]e)?|(?<![a-z])cc0|(?<![a-z])cc[\s-]by(?:[\s-](?:nc|sa|nd))*|"
         r"attribution(?:[\s-]*(?:non-?commercial|share-?alike|no-?deriv(?:ative)?s))*)")
VERSION = re.compile(NAMED + r"[\s,;:()*#/-]*(?:as published by the free software foundation[\s,;*#/]*)?(?:either\s+)?"
                     r"(?:v(?:ersion)?(?![a-z])[\s.]*)?(\d{1,2}(?:\.\d+)*)(?![\d-])"
                     r"|version\s+(\d{1,2}(?:\.\d+)*)\s+of\s+(?:the\s+)?(?:gnu|licen[cs]e|[al]?gpl)")
#: Words that tell the licences of a family apart.
MARKS = {
    "gnu": {"lesser": r"(?:lesser|library) general public|(?<![a-z])lgpl", "affero": r"affero general public|(?<![a-z])agpl"},
    "cc": {"nc": r"non-?commercial|by[\s-]nc(?![a-z])", "sa": r"share-?alike|by[\s-](?:nc[\s-])?sa(?![a-z])",
           "nd": r"no-?deriv|by[\s-](?:nc[\s-])?nd(?![a-z])"},
}
GNU_NAME = re.compile(r"(?:(?:lesser|library|affero)\s+)?general\s+public\s+licen[cs]e|(?<![a-z])[al]gpl")
SPDX = re.compile(r"spdx-license-identifier:\s*\(?([a-z0-9.+-]+(?:\s+(?:or|and|with)\s+[a-z0-9.+-]+)*)")

NAME_WORD = re.compile(r"(?<![a-z0-9])(mit|isc|apache|mozilla|mpl|bsd|creative commons|cc0|cc(?=[\s-]by)|[al]?gpl|gnu|"
                       r"gfdl)(?![a-z])|(?:general|affero) (public) licen[cs]e")
SAME = {"gnu": {"gpl", "lgpl", "agpl", "gnu", "public", "gfdl"}, "mozilla": {"mozilla", "mpl"}, "cc": {"cc", "creative commons"}}


def names_in(text: str) -> set[str]:
    """The licence families that a text names."""
    words = {m[1] or m[2] for m in NAME_WORD.finditer(text)}
    return {next((k for k, v in SAME.items() if w in v), w) for w in words}


def plain(version: str) -> str:
    while version.endswith(".0"):
        version = version[:-2]
    return version


def family(name: str) -> str:
    return {"GPL": "gnu", "LGPL": "gnu", "AGPL": "gnu", "CC": "cc", "BSD": "bsd"}.get(name.split("-")[0], "")


def expected(name: str) -> tuple[set[str], set[str] | None]:
    """(marks, versions) of a licence; versions are None where the licence has none."""
    parts = name.split("-")
    marks = {"LGPL": {"lesser"}, "AGPL": {"affero"}, "CC": {p.lower() for p in parts} & {"nc", "sa", "nd"},
             "BSD": set(parts[1:2])}.get(parts[0], set())
    if name.endswith("-or-later"):
        return marks, set()
    return marks, {plain(parts[-1])} if re.fullmatch(r"\d+(\.\d+)*", parts[-1]) else None


def versions(text: str, first: bool) -> set[str]:
    found = [plain(m[1] or m[2]) for m in VERSION.finditer(text)]
    return set(found[:1] if first else found)


def marks_of(kind: str, text: str, whole: str, first: bool) -> set[str]:
    if kind == "bsd":
        stated = set(re.findall(r"(\d)[\s-]clause", text))
        if stated or "redistribution and use" not in text:
            return stated
        return {"4"} if "advertising materials" in whole else {"3"} if "endorse or" in whole else {"2"}
    if kind == "gnu" and first:  # a body names other licences later on
        m = GNU_NAME.search(text)
        text = " ".join(m[0].split()) if m else ""
    return {mark for mark, pattern in MARKS.get(kind, {}).items() if re.search(pattern, text)}


WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


FLUSH = 200_000  # words a task holds before it sends their counts on
FOUND = "array<struct<line:int,rank:int,name:string,dot:double,known:double,rest:array<struct<word:string,n:long>>>>"
FOUND_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("rank", pa.int32()), ("name", pa.string()), ("dot", pa.float64()), ("known", pa.float64()),
                                  ("rest", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]))


def line_frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how many lines of all files hold each word; '' counts all lines."""
    small_batches(files.sparkSession)

    def sums(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                          names=["word", "n"])

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                for line in text.lower().split("\n"):
                    seen.update(("", *set(WORD.findall(line))))
                if len(seen) > FLUSH:
                    yield sums(seen)
                    seen = Counter()
        yield sums(seen)

    counts = files.select(text_or_empty(text_col)).mapInArrow(count, "word string, n long")
    return written(counts.groupBy("word").agg(F.sum("n").alias("n")), "line_frequencies")


class Matcher:
    """Cosine of lines to notices and of whole texts to notices and licence texts, as far as the template words alone tell
    it.  A line that holds no word of any notice's prefix cannot reach the threshold: the words beyond a prefix, the rarest
    first, have too little weight together.  The other words of a line only add to its norm, each at least its count; a
    line that fails with that is dropped, the rest wait for the frequencies of their other words.  A template counts only
    if the words and versions that tell its licence from those near to it are those of the line."""

    def __init__(self, templates: list[tuple[str, str]], lines: int, seen: dict[str, int], threshold: float):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.spelling = {name.lower(): name for name in self.names}
        self.expected = [(family(name), *expected(name)) for name in self.names]
        self.named = [names_in(text.lower()) for _, text in templates]
        self.body = [len(WORD.findall(text.lower())) > BODY_WORDS for _, text in templates]
        counted = [Counter(WORD.findall(text.lower())) for _, text in templates]
        self.idf = {w: math.log((lines + 1) / (seen.get(w, 0) + 1)) + 1.0 for c in counted for w in c}
        self.notices, self.all, self.prefix = defaultdict(list), defaultdict(list), set()  # word: (template, weight)
        for i, counts in enumerate(counted):
            w = {t: n * self.idf[t] for t, n in counts.items()}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
            w = {t: x / norm for t, x in w.items()}
            notice = not self.body[i]
            for t, x in w.items():
                self.all[t].append((i, x))
                if notice:
                    self.notices[t].append((i, x))
            rest = 1.0
            for word, x in sorted(w.items(), key=lambda i: (-i[1], i[0])) if notice else ():
                if math.sqrt(max(rest, 0.0)) < threshold:
                    break
                self.prefix.add(word)
                rest -= x * x

    def fits(self, i: int, text: str, after: str, whole: str, first: bool) -> bool:
        """Whether the distinguishing words of template ``i``'s licence are those that the text states."""
        kind, marks, wanted = self.expected[i]
        if not self.body[i] and self.named[i] and self.named[i].isdisjoint(names_in(text)):
            return False
        if kind and marks_of(kind, text, whole or text, first) != marks:
            return False
        return wanted is None or (versions(text, first) or versions(f"{text}\n{after}", True)) == wanted

    def best(self, at: int, line: str, after: str, whole: str) -> dict | None:
        """The best template of a line with the line's dot product, the squared norm of its template words and its
        other words."""
        words, first = WORD.findall(line), line is whole
        if not first and self.prefix.isdisjoint(words):
            return None
        counts = Counter(words)
        w = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        known = sum(x * x for x in w.values())
        rest = {t: n for t, n in counts.items() if t not in self.idf}
        least = self.threshold * (1 - 1e-9) * math.sqrt(known + sum(n * n for n in rest.values()))
        if math.sqrt(known) < least:
            return None
        dots = defaultdict(float)
        for t, x in w.items():
            for i, y in (self.all if first else self.notices).get(t, ()):
                dots[i] += x * y
        likely = sorted(((d, self.names[i], i) for i, d in dots.items() if d >= least and d > 0), reverse=True)
        for dot, name, i in likely:
            if name.split("-")[0] != likely[0][1].split("-")[0] and (self.expected[i][0] or "-") != self.expected[likely[0][2]][0]:
                continue  # the nearest licence is another one, of which a distinguishing word differs
            if self.fits(i, line, after, whole, first):
                rank = 2 if self.body[i] else 0 if name.endswith(("-or-later", "-reserved")) else 1
                return {"line": at, "rank": rank, "name": name, "dot": dot, "known": known,
                        "rest": [{"word": t, "n": rest[t]} for t in sorted(rest)]}
        return None

    def tag(self, at: int, line: str, original: str) -> dict | None:
        """What an SPDX tag states; the table does not tell -only and -or-later apart."""
        m = SPDX.search(line)
        if m is None or m[1] in ("none", "noassertion"):
            return None
        start = m.start(1)
        said = (original[start:start + len(m[1])] if len(original) == len(line) else m[1]).split()
        names = [re.sub(r"(?i)(-only|-or-later|\+)$", "", w) for w in said]
        names = [self.spelling.get(w.lower(), self.spelling.get(n.lower(), w)) for w, n in zip(said, names)]
        names = [w.upper() if w.lower() in ("or", "and", "with") else w for w in names]
        return {"line": at, "rank": 1, "name": " ".join(names), "dot": 1.0, "known": 1.0, "rest": []}

    def scan(self, original: str) -> list[dict]:
        """What the lines of a whole text, and the text as one after them, may match."""
        text = original.lower()
        found = []
        if not self.prefix.isdisjoint(WORD.findall(text)) or "spdx-license-identifier" in text:
            lines, originals = text.split("\n"), original.split("\n")
            for i, line in enumerate(lines):
                if "spdx-license-identifier" in line:
                    found.append(self.tag(i, line, originals[i]))
                else:
                    found.append(self.best(i, line, "\n".join(lines[i + 1:i + 1 + CONTEXT_LINES]), text if len(lines) > 1 else ""))
            found.append(self.best(len(lines), text, "", text))
        else:
            found.append(self.best(0, text, "", text))
        return [f for f in found if f]


def best_lines(found: DataFrame, frequencies: DataFrame, lines: int, threshold: float) -> DataFrame:
    """(row, own_score, own_license) of the best line of every row of ``found`` that reaches the threshold: a whole licence
    text before a line, a licence before a mere reservation or one without a version, ties to the earlier line.  Equal sets of other words are weighed once."""
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    words = (each.where(F.size("rest") > 0).select("rest").distinct()
             .select("rest", F.explode("rest").alias("r")).select("rest", "r.word", F.col("r.n").alias("times")))
    idf = F.log(F.lit(lines + 1.0) / (F.col("n") + 1)) + 1.0
    weight = words.join(frequencies, "word").groupBy("rest").agg(F.sum(F.pow(F.col("times") * idf, 2)).alias("other"))
    scored = each.join(weight, "rest", "left").withColumn(
        "score", F.round(F.col("dot") / F.sqrt(F.col("known") + F.coalesce("other", F.lit(0.0))), 9))
    top = F.max_by(F.struct("score", "name"), F.struct("rank", "score", -F.col("line")))
    return (scored.where(F.col("score") >= threshold).groupBy("row").agg(top.alias("top"))
            .select("row", F.col("top.score").alias("own_score"), F.col("top.name").alias("own_license")))


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the root ('') included."""
    parts = F.split(folder, "/")
    return F.array_union(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
                                     lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))


def license_scan(files: DataFrame, id_col: str, path_col: str = "path", text_col: str = "text",
                 threshold: float = 0.6, templates: DataFrame | None = None) -> DataFrame:
    """One row per file: ``id_col``, path, own_license, own_score, license, inherited_from.

    A file's own licence is its best line at ``threshold`` or above; every word weighs by the lines of the table that
    hold it.  ``templates`` (license, text) names the notices and licence texts by SPDX identifier, by default those of
    ``templates_table``; a small table.  A line whose version, or word such as 'Lesser', is another licence's has none.
    An SPDX tag counts as it stands.  Files named LICENSE, COPYING or NOTICE declare
    their folder's licence (best score, then first path).  A file without its own takes that of the nearest folder at
    or above its own that declares one; ``inherited_from`` names it.  Folders are resolved once each, however many
    files they hold.  Null texts are empty and null paths lie in the root.  Rows repeat as given; empty tables give an
    empty result.
    """
    base = files.select(F.col(id_col), F.coalesce(F.col(path_col), F.lit("")).alias("path"),
                        text_or_empty(text_col).alias("text"))
    given = templates_table(files.sparkSession) if templates is None else templates
    templates = [tuple(r) for r in given.select("license", "text").dropna().distinct().sort("license", "text").collect()]
    frequencies = line_frequencies(base, "text")
    vocabulary = sorted({w for _, text in templates for w in WORD.findall(text.lower())} | {""})
    known = files.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    seen = {r["word"]: r["n"] for r in frequencies.join(known, "word").collect()}  # template words only
    lines = seen.pop("", 0)
    matcher = Matcher(templates, lines, seen, threshold)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([matcher.scan(t) for t in strings(batch.column(2))], FOUND_ARROW)]

    found = with_arrow(base, run, f"found {FOUND}", ["found"]).drop("text")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "license_lines")
    own = (found.drop("found").join(best_lines(found, frequencies, lines, threshold), "row", "left").drop("row")
           .withColumn("own_score", F.coalesce("own_score", F.lit(0.0))))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    own = written(own.withColumn("folder", folder), "licenses")
    name = F.element_at(F.split("path", "/"), -1)
    declared = (own.where(name.rlike(LICENSE_FILE) & F.col("own_license").isNotNull()).groupBy(F.col("folder").alias("above"))
                .agg(F.min_by("own_license", F.struct(-F.col("own_score"), "path", "own_license")).alias("folder_license")))
    folders = own.where("own_license is null").select("folder").distinct()
    up = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("distance", "above"))
    nearest = (up.join(declared, "above").groupBy("folder")
               .agg(F.min(F.struct("distance", "above", "folder_license")).alias("at")))
    out = own.join(nearest, "folder", "left")
    inherits = F.col("own_license").isNull()
    return out.select(id_col, "path", "own_license", "own_score",
                      F.coalesce("own_license", "at.folder_license").alias("license"),
                      F.when(inherits, F.col("at.above")).alias("inherited_from"))
