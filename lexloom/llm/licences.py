"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, without copyright lines, every run of
punctuation and white space one blank, equivalent spellings made one. Its SHA-256 is joined
with the digests of known licences, so only entire texts match. Each document is looked up
as a whole, and each of its lines, since a notice is an entire text on a line of its own.

Defined cases: a null text has the digest of the empty text and no licence; texts without a
letter or digit have no licence either; repeated rows get the same answer; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that state a copyright, in lower case.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|[<\[])|\(c\)|©|all rights reserved)[^\n]*$"

#: Spellings that licence matching treats as equal; fixed values.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("modelled", "modeled"), ("noncommercial", "non  commercial"), ("noninfringement", "non  infringement"), ("organisation", "organization"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("https", "http"),
]

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)

#: Known licence texts and notices; fixed values.
KNOWN = [
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        f"Software. {_AS_IS}"
    )),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_TAIL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE} {_BSD_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def with_digest(rows: DataFrame, text: str, name: str = "digest") -> DataFrame:
    """Adds the SHA-256 of the text's canonical form, in which equal licences are equal; null is empty.

    A blank on both sides of every word lets plain replacements act on whole words. They are
    run only on texts that hold one of the spellings.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    spaced = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    common = F.col(name)
    for spelling, usual in SPELLINGS:
        common = F.replace(common, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    odd = F.col(name).rlike(" (?:" + "|".join(s for s, _ in SPELLINGS) + ") ")
    rows = rows.withColumn(name, spaced)
    rows = rows.withColumn(name, F.when(odd, common).otherwise(F.col(name)))
    return rows.withColumn(name, F.sha2(F.trim(F.regexp_replace(name, " +", " ")), 256))


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and licence of every known text; texts without a letter or digit are left out."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "licence string, text string")
    rows = rows.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return with_digest(rows, "text").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, licence (of the whole text, or null), n_notices and notices (licences of its lines, sorted)."""
    name = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2")]
    rows = with_digest(docs.select(F.col(key), *name, F.col(text).alias("text")), "text").select(key, "t1", "t2", "digest")
    lines = with_digest(docs.select(*name, F.posexplode(F.split(text, "\n")).alias("at", "line")), "line").select("t1", "t2", "at", "digest")
    # Equal texts have equal lines: distinct before the count.
    hits = lines.join(known, "digest").select("t1", "t2", "at", "licence").distinct()
    notices = hits.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("notices"))
    return rows.join(known, "digest", "left").join(notices, ["t1", "t2"], "left").select(
        key, "digest", "licence", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    spaced = "' ' || regexp_replace(regexp_replace(lower(coalesce(x, '')), {c}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '".format(c=quoted(COPYRIGHT))
    for spelling, common in SPELLINGS:
        spaced = f"replace({spaced}, ' {spelling} ', ' {common} ')"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
CREATE OR REPLACE TEMP MACRO canon(x) AS trim(regexp_replace({spaced}, ' +', ' ', 'g'));
WITH known AS MATERIALIZED (SELECT sha256(canon(t)) AS digest, min(n) AS licence FROM (VALUES {rows}) v(n, t) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT l.doc_id, known.licence FROM l JOIN known ON sha256(canon(l.line)) = known.digest),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM h GROUP BY doc_id),
d AS (SELECT doc_id, sha256(canon(text)) AS digest FROM documents)
SELECT d.doc_id, d.digest, known.licence, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
"""


def sql() -> str:
    """One statement: the macro's body is put in place of its calls."""
    head, _, rest = _sql().partition(";\n")
    body = head.partition(" AS ")[2]
    for call in ("t", "l.line", "text"):
        rest = rest.replace(f"canon({call})", "(" + body.replace("coalesce(x, '')", f"coalesce({call}, '')") + ")")
    return rest
