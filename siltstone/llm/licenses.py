"""Licence scans by canonical digest lookup.

A text is brought to a canonical form - lower case, copyright lines out, equivalent spellings
unified, everything but letters and digits collapsed to single spaces - and its digest is
joined with those of known licences.  Each line is a unit of the same join, as a text of its
own, since documents carry one-line notices.  Everything runs in DataFrame functions.  Known are
the whole texts in ``spdx/`` and a list of notices, or a table that the caller gives.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, small

#: One-line notices with their SPDX names.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
]
#: The first lines that whole texts are known to have instead of the stored one.
TITLES: dict[str, list[str]] = {
    "MIT": ["", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["", "The BSD 2-Clause License", "BSD License"],
    "BSD-3-Clause": ["", "The BSD 3-Clause License", "BSD License", "New BSD License"],
    "Zlib": ["", "The zlib License", "zlib/libpng License"],
}
#: Spellings that mean the same, as (plain text, unified form), on words with
#: a space at either side; then the forms of version numbers, as patterns.
SPELLINGS: list[tuple[str, str]] = [
    (" licence", " license"),
    (" sub license", " sublicense"),
    (" non infringement ", " noninfringement "),
    (" creative commons attribution ", " cc by "),
    (" gpl ", " gnu general public license "),
]
VERSION = r" (?:version|v) ([0-9])"
#: A line that is a copyright notice: it says (c) or a year, or has a place for one.
_COPYRIGHT = r"(?s)^[^\p{L}\p{N}(©]*(copyright([^\p{L}\p{N}]|[^\p{L}\p{N}].*[^\p{L}\p{N}])((c|19[0-9][0-9]|20[0-9][0-9])([^\p{L}\p{N}].*)?|[©<\[].*)|copyright[^\p{L}\p{N}]*[©<\[].*|\(c\).*|©.*|all rights reserved[^\p{L}\p{N}]*)$"
_GAP = r"[^\p{L}\p{N}]+"


def _words(line: Column) -> Column:
    """One line without its copyright notice, as lower-case words with one space between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), _COPYRIGHT, " "), _GAP, " "))


def _unified(words: Column) -> Column:
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(out, VERSION, " v$1"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _words), lambda x: x != "")


def canonical(text: Column) -> Column:
    """The canonical form: words of letters and digits with one space between them."""
    return _unified(F.array_join(_lines(text), " "))


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def known_texts() -> list[tuple[str, str]]:
    """(SPDX name, text) of the whole licences in ``spdx/``, under each of their titles, and of
    the one-line notices."""
    out = list(NOTICES)
    for path in sorted((Path(__file__).parent / "spdx").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        first, _, rest = text.partition("\n")
        out += [(path.stem, text), *((path.stem, f"{title}\n{rest}") for title in TITLES.get(path.stem, ()))]
    return out


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of ``known`` (license, text), one row a digest; nulls are left out."""
    rows = known.where("license IS NOT NULL AND text IS NOT NULL")
    return rows.select(_digest(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices) for every row of ``docs``.

    ``known``: (license, text) of whole licences and notices; :func:`known_texts` if not given.
    ``digest``: of the whole canonical text; ``license``: the known licence that the whole text
    is, else null; ``notices``: sorted distinct licences that single lines are.  Whole texts
    and lines are units of one join on the digest.  Null and empty texts have the digest of the
    empty form; texts are read whole, however long.  Ids may be null, strings or repeated: rows
    that share an id are told apart by their texts.  Other columns are not used, so their names
    may clash.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.createDataFrame(known_texts(), "license string, text string") if known is None else known
    known = materialize(known_digests(known), "lic-known")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), _lines(F.col("text")).alias("lines"))
    # The outer form keeps the optimizer from making the lines twice more to test their number.
    units = rows.select("doc_id", "tag", F.posexplode_outer(F.concat(F.array(F.array_join("lines", " ")), F.col("lines"))).alias("unit", "form"))
    units = units.select("doc_id", "tag", "unit", _digest(_unified(F.col("form"))).alias("digest"))
    met = materialize(units.join(small(known), "digest", "left").where("unit = 0 OR license IS NOT NULL"), "lic-met")
    notices = met.where("unit > 0").groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    notices = notices.withColumnsRenamed({"doc_id": "d", "tag": "t"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))
    none = F.expr("cast(array() as array<string>)")
    return met.where("unit = 0").join(notices, same, "left").select("doc_id", "digest", "license", F.coalesce("notices", none).alias("notices"))


def canonical_text(text: str) -> str:
    """The canonical form in plain Python, for the SQL's digests and for tests."""
    import regex

    lines = [regex.sub(_GAP, " ", regex.sub(_COPYRIGHT, " ", x.lower())).strip(" ") for x in text.split("\n")]
    out = f" {' '.join(x for x in lines if x)} "
    for one, other in SPELLINGS:
        out = out.replace(one, other)
    return regex.sub(VERSION, r" v\1", out).strip(" ")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unified_sql(words: str) -> str:
    out = f"concat(' ', {words}, ' ')"
    for one, other in SPELLINGS:
        out = f"replace({out}, {_quoted(one)}, {_quoted(other)})"
    return f"trim(regexp_replace({out}, {_quoted(VERSION)}, ' v\\1', 'g'))"


_LINES_SQL = f"""list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: trim(regexp_replace(regexp_replace(lower(x), {_quoted(_COPYRIGHT)}, ' '), {_quoted(_GAP)}, ' ', 'g'))), lambda x: x <> '')"""
_KNOWN = {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in sorted(known_texts(), reverse=True)}
ORACLE = f"""
WITH known AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in sorted(_KNOWN.items()))}) t(digest, license)),
d AS (SELECT doc_id, {_LINES_SQL} AS lines FROM documents),
w AS (SELECT doc_id, lines, sha256({_unified_sql("array_to_string(lines, ' ')")}) AS digest FROM d),
n AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, sha256({_unified_sql("line")}) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM d)) JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, known.license, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id
"""
