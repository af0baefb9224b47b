"""License scan: canonical digest lookup.

A text is brought to a canonical form (case, punctuation, white space, copyright lines and equivalent spellings
made alike) and its SHA-256 is joined with the digests of known licence texts in the same form. The lookup takes
entire texts: the whole document, and each of its lines as a text of its own, which finds notices inside other
matter. Whole licences are known as published, with the title lines that files carry and without; a document that
starts with copyright lines of neither year nor sign, after a title or not, is looked up without them too.

A text is rewritten once, with its line ends kept; lines and the whole are both taken from that. Only lines as long as
some known text are hashed. Digests go to a small table in the shared folder, from which they join the known ones;
these are broadcast if there are no more than MOST_KNOWN.

Defined results: null and empty texts, and texts of copyright lines alone, match nothing. Of several known texts
with one canonical form the least name is reported. Repeated rows are judged alike, an empty table gives an empty
result, extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import ascii_lower, written

#: Known digests that are broadcast.
MOST_KNOWN = 1_000_000
#: Rewrites on lower-case text, in order; regular expressions that Java and RE2 read alike.
REWRITES = (
    (r"(^|\n)[^\n\w]*(copyright|\(c\)|©)[^\n]*(\(c\)|©|[0-9]{4})[^\n]*", "\n"),
    (r"(^|\n)[^\n\w]*all rights reserved[^\n\w]*", "\n"),
    (r"[‘’“”`´]", "'"),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"merchantibility", "merchantability"),
    (r"organisation", "organization"),
    (r"https?://", ""),
    (r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " "),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Known texts by SPDX name: whole licences, and the notices by which texts refer to one. Fixed values.
KNOWN = (
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}'),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_END}"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "MIT", "MPL-2.0", "Unlicense")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
)

#: Title lines of licence files whose known text starts after them.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "BSD License", "The BSD License"),
    "ISC": ("ISC License", "ISC License (ISC)", "The ISC License", "The ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: A title, if any, and after it copyright lines at the start of a document.
HEAD = r"^(\W*+(?:[^\n]{0,80}(?i:licen[sc]e|bsd)[^\n]{0,80}\n\W*+)?)(?:(?i:copyright)\b[^\n]*\n\W*+)+"


@cache
def published() -> tuple[tuple[str, str], ...]:
    """Whole licences in the forms in which files carry them. The texts of license_texts are named by licence."""
    own = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files("vecloom.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    bodies = [(name, text) for name, text in KNOWN if name in TITLES and len(text) > 200] + list(own.items())
    two = own["BSD-2-Clause"]
    for holder in ("the copyright holder", "copyright holder", "the copyright holders", "the University", "the author", "the organization", "the <organization>", "[project]"):
        third = f"3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS"
        bodies.append(("BSD-3-Clause", two.replace("THIS SOFTWARE IS", third, 1)))
    bodies += [(name, text.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")) for name, text in bodies if name.startswith("BSD")]
    regents = lambda text: text.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS")
    bodies += [(name, regents(text)) for name, text in bodies if name.startswith("BSD")]
    apache = own["Apache-2.0"]
    bodies.append(("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "")))  # filled in, the line has a year
    bodies.append(("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "{yyyy} {name of copyright owner}")))
    ending = "END OF TERMS AND CONDITIONS"
    for name, text in own.items():
        if ending in text:
            before = text[: text.index(ending)]
            bodies += [(name, before), (name, before + ending)]
    return tuple(bodies) + tuple((name, f"{title}\n\n{text}") for name, text in bodies for title in TITLES.get(name, ()))


def rewritten(text: Column) -> Column:
    """The text after all rewrites, with its line ends; a line's canonical form is its line, trimmed."""
    out = ascii_lower(F.coalesce(text, F.lit("")))
    for pattern, new in REWRITES:
        out = F.regexp_replace(out, pattern, new)
    return out


def joined(text: Column) -> Column:
    """The canonical form of a whole rewritten text."""
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    return joined(rewritten(text))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, name (the least) and size of each known canonical text."""
    texts = spark.createDataFrame(list(known), "name string, text string").withColumn("text", canonical(F.col("text")))
    return texts.where("text <> ''").groupBy(F.sha2("text", 256).alias("digest"), F.length("text").alias("size")).agg(F.min("name").alias("name"))


def scan_licenses(docs: DataFrame, known=None) -> DataFrame:
    """doc_id, text_sha256 (of the canonical text), license (of the whole text, or null) and line_licenses (names
    found on single lines, sorted) of docs (doc_id, text). known: names and texts; if not given, KNOWN and published()."""
    known = (*KNOWN, *published()) if known is None else known
    digests = written(known_digests(docs.sparkSession, known))
    sizes = sorted({r[0] for r in digests.select("size").distinct().collect()})  # no more than there are known texts
    names = digests.select("digest", "name")
    names = F.broadcast(names) if len(known) <= MOST_KNOWN else names
    fitting = lambda x: F.length(x).isin(*sizes) if sizes else F.lit(False)
    lines = F.transform(F.filter(F.transform(F.split("plain", "\n"), lambda x: F.trim(x)), fitting), lambda x: F.sha2(x, 256))
    headless = F.when(F.col("text").rlike(HEAD), F.sha2(canonical(F.regexp_replace("text", HEAD, "$1")), 256))
    df = docs.select("doc_id", "text", rewritten(F.col("text")).alias("plain")).select("doc_id", F.sha2(joined(F.col("plain")), 256).alias("text_sha256"), headless.alias("headless"), F.array_distinct(lines).alias("lines"))
    rows = written(df.withColumn("rid", F.monotonically_increasing_id()))
    named = lambda column, out: names.select(F.col("digest").alias(column), F.col("name").alias(out))
    some = rows.where(F.size("lines") > 0).select("rid", F.explode("lines").alias("line")).join(named("line", "name"), "line")
    some = some.groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("found"))  # at most as many names as are known
    out = rows.join(named("text_sha256", "whole"), "text_sha256", "left").join(named("headless", "rest"), "headless", "left").join(some, "rid", "left")
    return out.select("doc_id", "text_sha256", F.coalesce("whole", "rest").alias("license"), F.coalesce("found", F.lit("")).alias("line_licenses"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _op6_sql() -> str:
    def norm(column: str) -> str:
        out = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, new in REWRITES:
            pattern, new = (x.replace("'", "''").replace("\n", "'||chr(10)||'") for x in (pattern.replace(r"\n\x{80}", r"\x{80}"), new))
            out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
        return f"sha256(trim({out}))"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH known AS (SELECT {norm("text")} AS digest, min(name) AS name FROM (VALUES {values}) v(name, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
found AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM lines JOIN known ON {norm("line")} = digest GROUP BY rid)
SELECT doc_id, {norm("text")} AS text_sha256, known.name AS license, coalesce(names, '') AS line_licenses
FROM d LEFT JOIN known ON {norm("text")} = digest LEFT JOIN found USING (rid)
"""


OP6_SQL = _op6_sql()
