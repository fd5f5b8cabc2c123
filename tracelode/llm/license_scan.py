"""License scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance by directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Names, families and reference wordings of common licenses.
#: Headers and title lines.
HEADERS = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "permissive", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "permissive", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3"),
    ("AGPL-3.0", "copyleft", "Licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-3.0", "copyleft", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "permissive", "Released under the MIT License"),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "restricted", "Copyright. All rights reserved"),
    ("Apache-2.0", "permissive", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "copyleft", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "copyleft", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "copyleft", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "copyleft", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "copyleft", "Mozilla Public License Version 2.0"),
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole license files.
FILES = (
    ("MIT", "permissive", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "permissive", "ISC License Copyright Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "permissive", f"Copyright {_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", "permissive", f"Copyright {_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Identifiers after ``SPDX-License-Identifier:``.
SPDX = tuple(dict.fromkeys((name, family, name) for name, family, _ in (*HEADERS, *FILES) if name != "proprietary")) + tuple(
    (name, "copyleft", f"{name}-{tail}") for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0") for tail in ("only", "or-later")
)
TEMPLATES = (*(("header", *t) for t in HEADERS), *(("file", *t) for t in FILES), *(("spdx", *t) for t in SPDX))
#: Least cosine of a part of a text to a template.
THRESHOLD = 0.7
#: Characters of a short notice: whether a longer part may state a license is asked of all its terms, too.
HEADER_CHARS = 2000
#: Words that prose of all kinds is full of: the gate goes without them where it can.
COMMON = frozenset("a all and any are by for form free from in is it of on or that the this to under with work".split())
#: Basenames of files that state the license of their directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
#: A file with this share of its words in license lines states its directory's license too.
LICENSE_SHARE = 0.5
_TERM, _SPDX_TAG = r"[\p{L}\p{N}]+(?:[.+][\p{L}\p{N}]+)*", "SPDX-License-Identifier:"


def terms_of(text: Column) -> Column:
    """Lower-cased terms: letters and digits, joined by inner dots or plus signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def weigh(templates: Sequence[tuple[str, str, str, str]]) -> list[tuple[str, str, str, dict[str, float], dict[str, float]]]:
    """Of each (kind, license, family, text): kind, license, family, unit TF-IDF weights, and the idf of its kind's terms."""
    out = []
    counts = [Counter(re.findall(r"[^\W_]+(?:[.+][^\W_]+)*", t[3].lower())) for t in templates]
    kinds = [t[0] for t in templates]
    for (kind, name, family, _), tf in zip(templates, counts, strict=True):
        df = Counter(w for k, c in zip(kinds, counts, strict=True) if k == kind for w in c)
        idf = {w: log((kinds.count(kind) + 1) / (n + 1)) + 1 for w, n in df.items()}
        own = {w: (1 + log(n)) * idf[w] for w, n in tf.items()}
        norm = sqrt(sum(x * x for x in own.values()))
        out.append((kind, name, family, {w: x / norm for w, x in own.items()}, idf))
    return out


def rarest_idf(kind: str, templates: Sequence[tuple[str, str, str, str]]) -> float:
    """What a term of no template weighs: as much as one of a single template."""
    return log((sum(t[0] == kind for t in templates) + 1) / 2) + 1


def needed_terms(weights: dict[str, float], threshold: float) -> list[str]:
    """Terms of which any part that reaches the threshold must hold one.

    What a part shares with a template bounds its cosine: the length of the template's vector on the
    shared terms. The terms not listed here are too short a vector. Common words come last.
    """
    left, out = 1.0, []
    for w in sorted(weights, key=lambda w: (w in COMMON, -weights[w], w)):
        if left < threshold * threshold - 1e-9:
            break
        out.append(w)
        left -= weights[w] ** 2
    return out


def header_gate(templates: Sequence[tuple[str, str, str, str]], threshold: float) -> str:
    """A pattern that every text with a header in it matches."""
    words = sorted({w for kind, _, _, v, _ in weigh(templates) if kind == "header" for w in needed_terms(v, threshold)})
    first = {w[0]: [x[1:] for x in words if x[0] == w[0]] for w in words}  # a branch a first letter
    branches = [re.escape(c) + "(?:" + "|".join(map(re.escape, rest)) + ")" for c, rest in first.items()]
    return ("(?i)" if all(map(str.isascii, words)) else "(?iu)") + r"(?<![\p{L}\p{N}])(?:" + "|".join(branches) + r")(?![\p{L}\p{N}])"


def may_be_header(found: Column, templates: Sequence[tuple[str, str, str, str]], threshold: float) -> Column:
    """Whether a part with these terms of the gate in it may reach some header template: its other terms are taken as there."""
    out = F.lit(False)
    for kind, _, _, weights, _ in weigh(templates):
        if kind == "header":
            needed = needed_terms(weights, threshold)
            missing = [F.when(F.array_contains(found, w), F.lit(0.0)).otherwise(F.lit(weights[w] ** 2)) for w in needed]
            out = out | (sum(missing[1:], missing[0]) <= F.lit(1 - threshold * threshold + 1e-6))
    return out


def may_reach(shared: Column, templates: Sequence[tuple[str, str, str, str]], threshold: float) -> Column:
    """Whether the terms that a part shares with some header template are a long enough vector: they bound its cosine."""
    out = F.lit(False)
    for kind, _, _, weights, _ in weigh(templates):
        if kind == "header":
            squares = [F.when(F.array_contains(shared, w), F.lit(x * x)).otherwise(F.lit(0.0)) for w, x in weights.items()]
            out = out | (sum(squares[1:], squares[0]) >= F.lit(threshold * threshold - 1e-6))
    return out


def may_outweigh(terms: Column, shared: Column, idf: Column, templates: Sequence[tuple[str, str, str, str]], threshold: float) -> Column:
    """Whether a part's terms of header templates, with their counts, are long enough beside its other terms: these lengthen its vector only.

    The cosine to any template is at most the length of the part on templates' terms (``shared``, by
    ``idf``) over its whole length; each other distinct term adds the square of the rarest idf or more.
    """
    count = lambda w: F.size(F.filter(terms, lambda x: x == w)).cast("double")
    known = F.aggregate(F.transform(shared, lambda w: F.pow((1 + F.log(count(w))) * F.element_at(idf, w), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    others = (F.size(F.array_distinct(terms)) - F.size(shared)) * F.lit(rarest_idf("header", templates) ** 2)
    return known * F.lit(1 - threshold * threshold) + F.lit(1e-6) >= others * F.lit(threshold * threshold)


def license_parts(text: Column, named: Column, templates: Sequence[tuple[str, str, str, str]], threshold: float) -> Column:
    """Parts of a text that may state a license, as an array of (kind, level, part), null where there are none.

    Header parts are the text's lines (level 0) and paragraphs (1) of any length; in longer prose the
    rest outweighs a notice, which is told from all their terms. Of a license file the whole text is a part (2) to be held against whole files; what follows an SPDX tag in its
    line is one (3).
    """
    gate = header_gate(templates, threshold)
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for kind, _, _, v, _ in weigh(templates) if kind == "header" for w in v})])
    idf = F.create_map(*[F.lit(x) for pair in next((idf for kind, _, _, _, idf in weigh(templates) if kind == "header"), {"": 0.0}).items() for x in pair])
    of = lambda kind, level, parts: F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), p.alias("part")))
    nothing = of("header", 0, F.array().cast("array<string>"))

    def headers(level: int, pattern: str) -> Column:
        marked = F.transform(F.array_distinct(F.split(F.lower(text), pattern)), lambda p: F.struct(p.alias("part"), F.regexp_extract_all(p, F.lit(gate), F.lit(0)).alias("found")))
        some = F.transform(F.filter(marked, lambda x: may_be_header(x["found"], templates, threshold)), lambda x: x["part"])
        held = F.transform(some, lambda p: F.struct(p.alias("part"), terms_of(p).alias("all")))
        shared = F.transform(held, lambda x: F.struct(x["part"], x["all"], F.array_intersect(x["all"], vocabulary).alias("terms")))
        near = F.filter(shared, lambda x: may_reach(x["terms"], templates, threshold))
        near = F.filter(near, lambda x: (F.length(x["part"]) <= HEADER_CHARS) | may_outweigh(x["all"], x["terms"], idf, templates, threshold))
        return of("header", level, F.transform(near, lambda x: x["part"]))

    notices = F.when(text.rlike(gate), F.concat(headers(0, "\n"), headers(1, r"\n[ \t\r]*\n")))
    whole = F.when(named & text.isNotNull(), of("file", 2, F.array(text)))
    tags = F.when(F.contains(text, F.lit(_SPDX_TAG)), of("spdx", 3, F.regexp_extract_all(text, F.lit(_SPDX_TAG + r"[ \t]*([^\n]*)"), F.lit(1))))
    parts = F.concat(*[F.coalesce(x, nothing) for x in (notices, whole, tags)])
    return F.when(F.size(parts) > 0, parts)


def part_licenses(parts: DataFrame, templates: Sequence[tuple[str, str, str, str]], threshold: float) -> DataFrame:
    """``kind, part, license, family, score``: the nearest template of its kind for each distinct part that reaches the threshold.

    A part's vector is 1 + log of its term counts, times the templates' idf; terms of no template weigh like the
    rarest and lengthen the vector, so that a license named inside other prose scores less. Terms
    meet the templates' (a fixed list, broadcast) on the term.
    """
    spark = parts.sparkSession
    weighed = weigh(templates)
    entries = [(i, kind, name, family, w, x) for i, (kind, name, family, v, _) in enumerate(weighed) for w, x in v.items()]
    vectors = spark.createDataFrame(entries, "template int, kind string, license string, family string, term string, t double")
    idfs = {kind: idf for kind, _, _, _, idf in weighed}
    idf = spark.createDataFrame([(kind, w, x) for kind, own in idfs.items() for w, x in own.items()], "kind string, term string, idf double")
    rarest = F.coalesce(*[F.when(F.col("kind") == k, F.lit(rarest_idf(k, templates))) for k in idfs])
    distinct = parts.select("kind", "part").distinct().withColumn("key", F.sha2("part", 256))
    tf = distinct.select("kind", "key", F.explode(terms_of(F.col("part"))).alias("term")).groupBy("kind", "key", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), ["kind", "term"], "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", rarest))
    norms = tf.groupBy("kind", "key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(vectors), ["kind", "term"]).groupBy("kind", "key", "template", "license", "family").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scores = dots.join(norms, ["kind", "key"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = scores.groupBy("kind", "key").agg(F.max_by(F.struct("license", "family", "score"), F.struct(F.col("score"), -F.col("template"))).alias("best"))
    return distinct.join(best, ["kind", "key"]).select("kind", "part", "best.*")


def scan_licenses(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD, templates: Sequence[tuple[str, str, str, str]] = TEMPLATES
) -> DataFrame:
    """``id, path, header_license, score, license, inherited_from, family`` for every file.

    A file's own license decides: the template nearest to any line, paragraph or SPDX identifier of
    its whole text, or to the whole text of a license file. Without one, the license file of the
    nearest ancestor directory does, found by joins on directory paths: each distinct directory, not
    each file, meets its ancestors. License files are those named so, and files with at least half of
    their words in parts that state a license; where a directory has several, the best score, then
    the first name, counts. ``templates`` are (kind, license, family, text) of any number of licenses.

    Null and empty texts have no license of their own; texts of any length are read whole; a null
    path is in no directory and inherits nothing; what a text states does not depend on its id, which
    may be null or repeated; an empty table gives an empty result. Extra columns, whatever their
    names, are not read.
    """
    path = F.col("path")
    base = F.element_at(F.split(path, "/"), -1)
    folder = F.when(path.contains("/"), F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).when(path.isNotNull(), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    rows = rows.withColumn("named", F.coalesce(base.rlike(LICENSE_FILE), F.lit(False))).withColumn("folder", folder)
    rows = rows.withColumn("parts", license_parts(F.col("text"), F.col("named"), templates, threshold))
    some = F.col("parts").isNotNull()
    rows = rows.select("id", "path", "folder", "named", "parts", F.when(some, F.size(terms_of(F.col("text")))).alias("words"), F.when(some, F.sha2("text", 256)).alias("text_key"))
    rows = materialize(rows, "license_rows")  # one pass over the texts; few have parts
    parts = rows.where(some).select("text_key", "named", "words", F.explode("parts").alias("p")).select("text_key", "named", "words", "p.*").distinct()
    found = parts.join(part_licenses(parts, templates, threshold), ["kind", "part"])
    order = F.struct(F.col("score"), F.col("license"))
    found = found.groupBy("text_key", "named", "words", "level").agg(F.max_by(F.struct("license", "family", "score"), order).alias("best"), F.sum(F.size(terms_of(F.col("part")))).alias("terms"))
    found = found.groupBy("text_key", "named").agg(F.max_by("best", F.struct("best.score", "best.license")).alias("best"), F.max(F.col("terms") >= LICENSE_SHARE * F.col("words")).alias("mostly"))
    found = found.select("text_key", "named", F.col("best.license").alias("header_license"), F.col("best.family").alias("family"), F.col("best.score").alias("score"), "mostly")
    found = materialize(found, "header_licenses")
    own = rows.where(some).join(found, ["text_key", "named"], "left")
    marked = own.where("header_license is not null and folder is not null and (named or mostly)")
    per_folder = marked.groupBy(F.col("folder").alias("source")).agg(F.max_by(F.struct("header_license", "family"), F.struct(F.col("score"), F.col("header_license"))).alias("best"))
    folders = rows.select("folder").where("folder is not null").distinct()
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split(F.col("folder"), "/")))
    chain = folders.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    chain = chain.withColumn("source", F.array_join(F.slice(F.split(F.col("folder"), "/"), 1, F.col("depth")), "/"))
    nearest = chain.join(per_folder, "source").groupBy("folder").agg(F.max_by(F.struct("source", "best"), F.col("depth")).alias("near"))
    nearest = nearest.select("folder", F.col("near.source").alias("inherited_from"), F.col("near.best.header_license").alias("i_license"), F.col("near.best.family").alias("i_family"))
    names = ["id", "path", "folder", "header_license", "family", "score"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("header_license", "string"), ("family", "string"), ("score", "double"))]
    every = own.select(*names).unionByName(rows.where(~some).select("id", "path", "folder", *none))
    out = every.join(materialize(nearest, "nearest"), "folder", "left")
    has = F.col("header_license").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", "header_license", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("header_license", "i_license").alias("license"), F.when(~has, F.col("inherited_from")).alias("inherited_from"),
        F.when(has, F.col("family")).otherwise(F.col("i_family")).alias("family"),
    )


def document_path(documents: DataFrame) -> Column:
    """The query's tree: source, language, blocks of a thousand ids, id."""
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat_ws("/", part("source"), part("lang"), F.coalesce(block, F.lit("none")), F.concat(part("doc_id"), F.lit(".txt")))
