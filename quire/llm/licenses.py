"""Licence scan by canonical digest: whole texts against known licence texts.

Both sides go through the same expression: letters in lower case, copyright lines out,
equivalent spellings made equal, every run of anything but letters and digits one blank.
Texts whose canonical forms have the same SHA-256 are the same licence, so the scan is a
hash join on digests; the known side is the fixed list below (or the caller's): whole texts
with and without their title, their appendix and the numbers of their clauses, and short
notices.

Defined results: a null text is the empty text; a text with nothing left (only blanks,
punctuation or copyright lines) has the digest of the empty string and no licence; every
row gives one row, repeated or not; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import license_texts as texts

#: A line that only states a copyright, from the line break before it.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(portions )?(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)|©|all rights reserved)[^\n]*"

#: A paragraph of lines that all begin with the word, such as "Copyright Jane Doe".
COPYRIGHT_PARAGRAPH = r"(^|\n[ \t\r]*\n)([ \t]*copyright[ \t][^\n]*(\n|\z))+([ \t\r]*\n|\z)"

#: As many known digests go to every task (some 16 MB); a longer list is joined like any table.
MOST_BROADCAST = 100_000

#: Spellings that licence texts use alike, by what they become.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("initialis", "initializ"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("whilst", "while"),
)

#: Short licences without their titles, and the notices that stand for a licence.
SHORT = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: The clause that BSD-3-Clause has besides those of BSD-2-Clause, in its common wordings.
BSD_CLAUSES = tuple(f"3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" for holder in ("the copyright holder", "the copyright holders", "the copyright owner", "the author", "the organization", "the <organization>", "[project]", "[name of copyright holder]", "the {organization}"))

#: Title lines of the short licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "(The MIT License)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "BSD 0-Clause License", "Free Public License 1.0.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "FreeBSD License", "BSD License", "The BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
}

#: Whole licences as published, and where their text goes on after the title.
LONG = (
    ("Apache-2.0", texts.APACHE_2, "TERMS AND CONDITIONS FOR USE"),
    ("GPL-1.0-only", texts.GPL_1, "Copyright (C)"),
    ("GPL-2.0-only", texts.GPL_2, "Copyright (C)"),
    ("GPL-3.0-only", texts.GPL_3, "Copyright (C)"),
    ("LGPL-2.0-only", texts.LGPL_2, "Copyright (C)"),
    ("LGPL-2.1-only", texts.LGPL_2_1, "Copyright (C)"),
    ("LGPL-3.0-only", texts.LGPL_3, "Copyright (C)"),
    ("MPL-1.1", texts.MPL_1_1, "1. Definitions"),
    ("MPL-2.0", texts.MPL_2, "1. Definitions"),
    ("CC0-1.0", texts.CC0_1, "CC0 1.0 Universal"),
    ("CC0-1.0", texts.CC0_1, "CREATIVE COMMONS CORPORATION"),
    ("CC0-1.0", texts.CC0_1, "Statement of Purpose"),
    ("Artistic-1.0", texts.ARTISTIC_1, "Preamble"),
    ("GFDL-1.2-only", texts.GFDL_1_2, "Copyright (C)"),
    ("GFDL-1.3-only", texts.GFDL_1_3, "Copyright (C)"),
    ("BSL-1.0", texts.BSL_1, "Permission is hereby granted"),
)

#: Where the terms of a text end and an appendix may follow.
TERMS_END = "END OF TERMS AND CONDITIONS"

#: The addresses that texts of the Free Software Foundation give, the first as in the published texts.
ADDRESSES = (r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301\s+USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def _short() -> list[tuple[str, str]]:
    """Short licences also with their titles, and those with clauses also without the numbers."""
    bsd = dict(SHORT)["BSD-2-Clause"]
    at = bsd.index("THIS SOFTWARE IS PROVIDED")
    bodies = [*SHORT[:5], *[("BSD-3-Clause", bsd[:at] + clause + bsd[at:]) for clause in BSD_CLAUSES], ("Unlicense", texts.UNLICENSE), ("Unlicense", texts.UNLICENSE.replace("http://", "https://"))]
    bodies += [(name, re.sub(r"(?m)^[0-9]\. ", "", body)) for name, body in bodies if name.startswith(("BSD", "Zlib"))]
    return [(name, text) for name, body in bodies for text in (body, *[f"{title}\n\n{body}" for title in TITLES[name]])]


def _long() -> list[tuple[str, str]]:
    """Whole licences with and without title and appendix, in the links and addresses that are about."""
    out = []
    for name, whole, anchor in LONG:
        forms = [whole, whole[whole.index(anchor) :]]
        forms += [f[: f.index(TERMS_END)] + end for f in forms if TERMS_END in f for end in (TERMS_END, "")]
        forms += [re.sub(r"\[(yyyy|name of copyright owner)\]", r"{\1}", f) for f in forms]
        forms += [re.sub(ADDRESSES[0], other, f) for f in forms for other in ADDRESSES[1:]]
        forms += [f.replace("https://", "http://") for f in forms] + [re.sub("http://", "https://", f) for f in forms]
        out += [(name, f) for f in forms]
    return out


#: The known side, each text once.
KNOWN = tuple(dict.fromkeys((*SHORT, *_short(), *_long())))


def canonical(text: Column) -> Column:
    """The form in which texts of one licence are equal."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, COPYRIGHT_PARAGRAPH, "\n\n")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelling, becomes in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(becomes))
    return out


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(canon_sha256, license_id), a row for each digest; the first id of a digest wins."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(known)], "k int, license_id string, text string")
    rows = rows.select("k", "license_id", F.sha2(canonical(F.col("text")), 256).alias("canon_sha256"))
    return rows.groupBy("canon_sha256").agg(F.min_by("license_id", "k").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canon_chars, canon_sha256 and license_id (null: none) for every document.

    The fixed list goes to every task, as it is short; a table of the caller's is joined by
    whatever its size allows.
    """
    if known is None:
        known = known_digests(docs.sparkSession)
        known = F.broadcast(known) if len(KNOWN) <= MOST_BROADCAST else known
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    canon = canon.select("doc_id", F.length("canon").cast("long").alias("canon_chars"), F.sha2("canon", 256).alias("canon_sha256"))
    return canon.join(known, "canon_sha256", "left").select("doc_id", "canon_chars", "canon_sha256", "license_id")


def _sql() -> str:
    def canon(column: str) -> str:
        out = f"regexp_replace(lower(coalesce({column}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
        out = f"regexp_replace({out}, '{COPYRIGHT_PARAGRAPH}', chr(10) || chr(10), 'g')"
        out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for spelling, becomes in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{becomes}')"
        return out

    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(KNOWN))
    return f"""
WITH k AS (SELECT sha256({canon("t")}) AS h, arg_min(id, n) AS license_id FROM (VALUES {values}) v(n, id, t) GROUP BY 1),
d AS (SELECT doc_id, {canon("text")} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS canon_chars, sha256(c) AS canon_sha256, license_id FROM d LEFT JOIN k ON h = sha256(c)
"""


SQL = _sql()
