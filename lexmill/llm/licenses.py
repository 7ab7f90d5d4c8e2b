"""License scan: canonical digests of whole texts, looked up in a table of known licences.

The canonical form drops copyright lines, folds case, spells equivalent words
one way and turns every run of other characters than letters and digits into
one space. Two texts with the same form are the same licence. The lookup is a
hash join of SHA-256 digests of entire texts with the table of known licences.

A document may also quote a licence's short notice as a line of its own; the
same digest is taken of each line, and the ids found are listed as notices.

Edge cases: null or empty texts, and texts of copyright lines only, have an
empty form, which matches nothing. The table of known licences is one row per
form of a licence; equal forms give the smallest id. Repeated rows are looked
up each on its own.
"""

from __future__ import annotations

import json
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import table

# Equivalent spellings, as (pattern on folded words, replacement).
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("analogue", "analog"), ("judgement", "judgment"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https", "http"))

# The published bodies of short permissive licences, and four notices.
SHORT = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

COPYRIGHT_LINE = r"(?m)^[^A-Za-z0-9\n]*(copyright|\(c\)|©)( |\()[^\n]*$"

# Lines that usually stand above the short texts, and published files beside this module.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"),
}
FILES = ("Apache-2.0", "BSL-1.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")

# How notices begin, and the names that licences have in them.
LEADS = ("Licensed under ", "Released under ", "Distributed under ", "Available under ", *(f"This {x} is licensed under " for x in ("work", "project", "software", "program", "file")), "This work is released under ", "This software is released under ")
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}


def _names() -> dict[str, list[str]]:
    out = {
        "MIT": ["MIT License", "MIT"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")"],
        "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "2-clause BSD License", "Simplified BSD License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-clause BSD License", "New BSD License", "Modified BSD License"],
        "ISC": ["ISC License", "ISC"],
        "Zlib": ["zlib License", "Zlib"],
        "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
        "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
        "Unlicense": ["Unlicense"],
        "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal"],
    }
    for short, versions in (("GPL", ("2", "3")), ("LGPL", ("2.1", "3")), ("AGPL", ("3",))):
        for v in versions:
            dotted, name = v if "." in v else f"{v}.0", f"GNU {GNU[short]}"
            more = [f"{name}, version {v}", f"{name} version {v}", f"{name} v{v}", f"{name} v{dotted}", f"{name}, version {v} or later", f"{name}, version {v} or any later version", f"{short} v{v}", f"{short}v{v}", f"GNU {short} v{v}", f"GNU {short}v{v}", f"{short} {dotted}"]
            out[f"{short}-{dotted}"] = [*more, *(f"{short}-{dotted}{x}" for x in ("", "-only", "-or-later", "+"))]
    for code, words in CC.items():
        for v in ("3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported"
            out[f"CC-{code}-{v}"] = [f"CC {code} {v}", f"CC-{code}-{v}", f"CC {code} {v} {kind}", *(f"Creative Commons {words} {v}{x}" for x in ("", f" {kind}", " License", f" {kind} License")), f"Creative Commons {words} {v} {kind} License (CC {code} {v})"]
    return out


def _notices(names: list[str]) -> list[str]:
    names = [*names, *(f"{x} license" for x in names if "licen" not in x.lower() and "later" not in x)]
    articles = {x: ("", "a " if x.startswith("Creative") else "the ") for x in names}
    return [f"{lead}{a}{x}" for lead in LEADS for x in names for a in articles[x]] + [f"SPDX-License-Identifier: {x}" for x in names if " " not in x]


def _unwrapped(text: str) -> str:
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def _published(name: str) -> list[str]:
    text = resources.files("lexmill.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    texts = [text]
    # the terms also circulate without the appendix that says how to apply them
    head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    texts += [head + end, head] if end else []
    old = [re.sub(r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301(,?)\s+USA", r"59 Temple Place, Suite 330, Boston, MA 02111-1307\1 USA", t) for t in texts]
    texts = [*texts, *old]
    # a line that begins with the word copyright is no part of the form, so wrapping counts
    return [*texts, *map(_unwrapped, texts)]


def _titled(name: str) -> list[str]:
    body = SHORT[name]
    heads = ["", *TITLES[name]]
    return [body, *(f"{h}\n\n{r}{body}" for h in heads for r in ("", "All rights reserved.\n\n"))]


def _known() -> dict[str, str]:
    """All forms by id: a licence's first has its id, further ones have a number after it; notices have -notice."""
    out = dict(SHORT)
    forms = {n: _titled(n) for n in TITLES} | {n: _published(n) for n in FILES} | {f"{n}-notice": _notices(x) for n, x in _names().items()} | {"All-rights-reserved-notice": ["All rights reserved."]}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", re.sub(COPYRIGHT_LINE, " ", t.lower())))
    seen = set(map(words, out.values()))
    for name, texts in forms.items():
        new = list({words(t): t for t in reversed(texts) if words(t) not in seen}.values())[::-1]
        keys = (f"{name}-{i}" if i else name for i in range(len(new) + 1))
        out |= dict(zip((k for k in keys if k not in SHORT), new, strict=False))
        seen.update(map(words, new))
    return out


KNOWN = _known()


def _wide(words: str) -> str:
    return words.replace(" ", "  ")


def _folded(c: Column) -> Column:
    # every word has blanks of its own, so that neighbours are both replaced
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {_wide(a)} "), F.lit(f" {_wide(b)} "))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def canonical(c: Column) -> Column:
    """The canonical form of a whole text."""
    return _folded(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), COPYRIGHT_LINE, " "))


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """doc_id, canon_sha256, license_id (whole text, null if none) and notices (ids of quoted lines, in order, comma-joined).

    ``licenses`` has license_id and text; it is broadcast up to
    ``max_broadcast`` rows and shuffle-joined beyond, by digest.
    """
    known = licenses.select(F.sha2(canonical(F.col("text")), 256).alias("k"), "license_id", canonical(F.col("text")).alias("form")).where("form <> ''").groupBy("k").agg(F.min("license_id").alias("license_id"))
    n_known = known.count()
    known = F.broadcast(known) if n_known <= max_broadcast else known
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    form = canonical(F.col("t"))
    lines = F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), "\n"), lambda x: x != "")
    rows = rows.select("doc_id", F.sha2(form, 256).alias("canon_sha256"), F.transform(lines, lambda x: F.sha2(_folded(x), 256)).alias("lines"))
    whole = rows.join(known.withColumnRenamed("k", "canon_sha256"), "canon_sha256", "left")
    if n_known > max_broadcast:
        # what is quoted depends on the lines alone, so they are the key
        whole = whole.withColumn("by", F.sha2(F.array_join("lines", ","), 256))
        quoted = whole.where(F.size("lines") > 0).select("by", "lines").dropDuplicates(["by"]).select("by", F.explode(F.array_distinct("lines")).alias("k"))
        found = quoted.join(known.select("k", F.col("license_id").alias("n")), "k").groupBy("by").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("notices"))
        return whole.join(found, "by", "left").select("doc_id", "canon_sha256", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
    pairs = {r["k"]: r["license_id"] for r in known.collect()}
    ids = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")
    # the set is hashed; looking up in a map walks it
    named = F.array_sort(F.array_distinct(F.transform(F.filter("lines", lambda x: x.isin(*pairs)), lambda x: F.try_element_at(ids, x))))
    return whole.select("doc_id", "canon_sha256", "license_id", F.array_join(named, ",").alias("notices"))


def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_folded(x: str) -> str:
    x = f"' ' || trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', '  ', 'g')) || ' '"
    for a, b in SPELLINGS:
        x = f"replace({x}, ' {_wide(a)} ', ' {_wide(b)} ')"
    return f"trim(replace({x}, '  ', ' '))"


def _sql_canonical(x: str) -> str:
    return _sql_folded(f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', ' ', 'g')")


OP3_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical("text")}) AS k, min(license_id) AS license_id
           FROM (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN.items())}) v(license_id, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_sql_canonical("text")}) AS canon_sha256 FROM documents),
l AS (SELECT rid, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM (SELECT rid, sha256({_sql_folded("line")}) AS k FROM l) JOIN k USING (k) GROUP BY rid)
SELECT doc_id, canon_sha256, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON d.canon_sha256 = k.k LEFT JOIN n USING (rid)
"""
