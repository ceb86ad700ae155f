"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences; each is normalised and looked up among the known licence sentences. The identifiers found, in order, form a sequence,
and the licence rules are matched against it in their order: a rule is a run of identifiers, its licence is reported where the run occurs, and the run is
taken out, so that a later and more general rule cannot use it again.

Normal form: lower case, everything but letters and digits becomes one space. Then what differs between copies of one sentence is evened out: the
holder's name in the sentences that hold one becomes a fixed word (HOLDERS), and "this software is licensed under the terms of the X license, see FILE" becomes "under X license" (the same for released,
distributed, made available ...), so that one name of a licence in REFERENCES stands for all these ways of referring to it.

Texts wrap lines in two ways, so a text is cut at ends of sentences and paragraphs, and again at every line; the cut with more known sentences counts.

Defined results: no licences and no sentences for null, empty or unknown texts; a rule that occurs twice is reported once; sentences of no full rule are listed
but give no licence; repeated rows get equal rows; a null doc_id is a row like any other; very long texts are cut whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known sentences of public licences, by identifier.
SENTENCES = {
    "Apache2NoUse": ['you may not use this file except in compliance with the License'],
    "Apache2Copy": ['You may obtain a copy of the License at', 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0'],
    "Apache2AsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "Apache2See": ['See the License for the specific language governing permissions and limitations under the License'],
    "MITPermission": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "MITNotice": ['The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'],
    "MITAsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "MITLiability": ['IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE'],
    "BSDRedistribution": ['Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'],
    "BSDSource": ['Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer', 'Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer', 'Redistributions of source code must retain the above copyright notice'],
    "BSDBinary": ['Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution', 'Redistributions in binary form must reproduce the above copyright notice'],
    "BSDEndorse": ['Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission'],
    "BSDAsIs": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "GPL2Later": ['This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version', 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version'],
    "GPL3Later": ['you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version'],
    "GPLNoWarranty": ['This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY', 'without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE'],
    "GPLSee": ['See the GNU General Public License for more details'],
    "ISCPermission": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies', 'Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies'],
    "AllRights": ['All rights reserved'],
    "BSDLiability": ['IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES'],
    "GPL3Only": ['you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3'],
    "GPL2Only": ['This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License', 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation'],
    "AGPL3Later": ['you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version', 'you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation'],
    "LGPL3Later": ['you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version'],
    "LGPL21Later": ['This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version'],
    "LGPLSee": ['See the GNU Lesser General Public License for more details'],
    "AGPLSee": ['See the GNU Affero General Public License for more details'],
    "Version21Later": ['either version 2.1 of the License, or (at your option) any later version'],
    "Version2Later": ['either version 2 of the License, or (at your option) any later version'],
    "Version3Later": ['either version 3 of the License, or (at your option) any later version'],
    "GPLTerms": ['This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation'],
    "LGPLTerms": ['This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation'],
    "MPL2Notice": ['This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v', 'This Source Code Form is subject to the terms of the Mozilla Public License'],
    "MPL2Obtain": ['If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/', 'If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/'],
    "EPLNotice": ['All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution', 'This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at'],
    "EPL2Notice": ['This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at', 'This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution'],
    "BoostPermission": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZlibLiable": ['In no event will the authors be held liable for any damages arising from the use of this software'],
    "ZlibPermission": ['Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions'],
    "ZlibOrigin": ['The origin of this software must not be misrepresented; you must not claim that you wrote the original software', 'The origin of this software must not be misrepresented'],
    "UnlicenseFree": ['This is free and unencumbered software released into the public domain'],
    "UnlicenseAnyone": ['Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means'],
    "ISCAsIs": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "PostgreSQLPermission": ['Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies'],
    "WTFPLTerms": ['DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE', 'You just DO WHAT THE FUCK YOU WANT TO'],
    "CC0Waiver": ['To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work', 'To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work'],
    "GFDLPermission": ['Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation', 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License'],
    "OFLPermission": ['Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions', 'This Font Software is licensed under the SIL Open Font License, Version 1.1'],
    "PublicDomain": ['This work is in the public domain', 'This software is released into the public domain', 'This file is in the public domain', 'This code is in the public domain', 'This program is in the public domain', 'Released into the public domain'],
}

#: Licences that are referred to by name, with their names as they stand after "under" (without "the", and without "license" where a name may also end so).
REFERENCES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v2", "apache 2 0", "apache 2", "apache software license version 2 0", "apache version 2 0"],
    "Apache-1.1": ["apache license version 1 1", "apache software license version 1 1"],
    "MIT": ["mit", "expat", "x11 mit", "mit x11", "mit expat"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"],
    "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd", "original bsd"],
    "0BSD": ["0bsd", "bsd zero clause", "zero clause bsd"],
    "BSD": ["bsd", "bsd style"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gpl version 3 or later", "gplv3 or later", "gpl 3 0 or later", "gnu gpl v3 or later"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gpl version 2 or later", "gplv2 or later", "gpl 2 0 or later", "gnu gpl v2 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license version 3 0", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license version 2 0", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2"],
    "GPL": ["gnu general public license", "gnu gpl", "gpl"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license v3 0", "affero general public license version 3", "gnu agpl v3", "agpl v3", "agplv3", "agpl 3 0", "gnu affero general public license"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL": ["gnu lesser general public license", "gnu lgpl", "lgpl"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl version 2 0", "mpl v2 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0", "epl v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0", "epl v1 0"],
    "EUPL-1.2": ["european union public license version 1 2", "european union public license v 1 2", "european union public license 1 2", "eupl 1 2", "eupl v1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0", "cddl"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software", "bsl 1 0"],
    "Zlib": ["zlib", "zlib libpng"],
    "Unlicense": ["unlicense"],
    "ISC": ["isc"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0", "artistic 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "open font license", "ofl 1 1"],
    "PostgreSQL": ["postgresql"],
    "PSF-2.0": ["python software foundation license version 2", "psf", "python software foundation"],
    "AFL-3.0": ["academic free license version 3 0", "academic free license 3 0", "afl 3 0"],
    "MS-PL": ["microsoft public", "ms pl"],
    "GFDL-1.3": ["gnu free documentation license version 1 3", "gnu free documentation license", "gfdl"],
    "ODbL-1.0": ["open database license", "open data commons open database license", "odbl"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international", "creative commons attribution noncommercial noderivs 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international", "creative commons attribution non commercial 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported", "creative commons attribution sharealike 3 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported", "creative commons attribution 3 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international", "creative commons attribution 4 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero", "creative commons zero v1 0 universal"],
}
#: Headings that stand alone and name a licence.
HEADINGS = {"MIT": ["MIT License", "The MIT License (MIT)", "The MIT License"], "ISC": ["ISC License"], "BSL-1.0": ["Boost Software License - Version 1.0"], "MPL-2.0": ["Mozilla Public License Version 2.0"], "Apache-2.0": ["Apache License, Version 2.0"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "Unlicense": ["The Unlicense"]}

#: Beginning and end of the sentences that hold the holder's name, in normal form; the name between them becomes "holder".
HOLDERS = [
    ("neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("the name of", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("this software is provided by", "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("in no event shall", "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("in no event shall", "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("to the extent possible under law", "waived all copyright and related or neighboring rights to this work"),
]
#: The ways of referring to a licence, and what may follow its name.
LEAD = "^(?:(?:this|the|all|these)(?: [a-z0-9]+){1,6} (?:is|are|was|were) )?(?:also |dual |hereby )*(?:released|licensed|licenced|distributed|made available|available|published|provided|covered|offered|shared|redistributable)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )?"
TAIL = "(?: (?:see|refer to|read) (?:the )?(?:accompanying |included |attached )?(?:file )?(?:license|copying|notice|readme)(?: [a-z0-9]+){0,8}| the license| for (?:more )?details)$"

#: Licence and run of sentence identifiers, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["Ref Apache-2.0", "Apache2NoUse", "Apache2Copy", "Apache2AsIs", "Apache2See"]),
    ("Apache-2.0", ["Ref Apache-2.0", "Apache2NoUse"]),
    ("MIT", ["Ref MIT", "MITPermission", "MITNotice", "MITAsIs", "MITLiability"]),
    ("MIT", ["MITPermission", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITPermission", "MITNotice"]),
    ("BSD-3-Clause", ["BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDRedistribution", "BSDSource", "BSDBinary"]),
    ("AGPL-3.0-or-later", ["AGPL3Later"]),
    ("LGPL-3.0-or-later", ["LGPL3Later"]),
    ("LGPL-2.1-or-later", ["LGPL21Later"]),
    ("LGPL-2.1-or-later", ["LGPLTerms", "Version21Later"]),
    ("LGPL-3.0-or-later", ["LGPLTerms", "Version3Later"]),
    ("GPL-3.0-or-later", ["GPL3Later"]),
    ("GPL-2.0-or-later", ["GPL2Later"]),
    ("GPL-2.0-or-later", ["GPLTerms", "Version2Later"]),
    ("GPL-3.0-or-later", ["GPLTerms", "Version3Later"]),
    ("GPL-3.0", ["GPL3Only"]),
    ("GPL-2.0", ["GPL2Only"]),
    ("AGPL", ["GPLNoWarranty", "AGPLSee"]),
    ("LGPL", ["GPLNoWarranty", "LGPLSee"]),
    ("GPL", ["GPLNoWarranty", "GPLSee"]),
    ("MPL-2.0", ["MPL2Notice", "MPL2Obtain"]),
    ("MPL-2.0", ["MPL2Notice"]),
    ("EPL-2.0", ["EPL2Notice"]),
    ("EPL-1.0", ["EPLNotice"]),
    ("BSL-1.0", ["BoostPermission"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiable", "ZlibPermission", "ZlibOrigin"]),
    ("Zlib", ["ZlibPermission"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("ISC", ["ISCPermission"]),
    ("PostgreSQL", ["PostgreSQLPermission"]),
    ("WTFPL", ["WTFPLTerms"]),
    ("CC0-1.0", ["CC0Waiver"]),
    ("GFDL-1.3", ["GFDLPermission"]),
    ("OFL-1.1", ["OFLPermission"]),
    ("public-domain", ["PublicDomain"]),
] + [(licence, [f"Ref {licence}"]) for licence in REFERENCES]

#: Every known sentence holds one of these (which no end of a line can part), so texts without any need no cutting.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "permission", "liab", "domain", "reserved", "cc0", "compliance", "endorse", "misrepresented", "anyone", "mozilla", "fuck")
#: What names of licences begin with that stand after "under" without any of them, as a pattern for the text.
NAMES = r"(?<![a-z0-9])(?:mit(?![a-z0-9])|expat|a?l?gpl|gnu|0?bsd|[23]|two|three|new|modified|revised|simplified|original|zero|apache|cc[^a-z0-9]+by|creative|mpl|epl|eupl|cddl|common|boost|bsl|zlib|isc(?![a-z0-9])|wtfpl|do[^a-z0-9]+what|artistic|ofl|open|postgresql|psf|python|afl|academic|microsoft|ms[^a-z0-9]+pl|gfdl|odbl|freebsd|eclipse|european|affero|sil|x11)"

#: Ends of sentences and paragraphs; ends of lines.
BY_SENTENCE = r"[.!?;:]+[\"')]*\s+|\n\s*\n"
BY_LINE = r"[.!?;:]+[\"')]*\s+|\n+"


def _evened(text: str) -> str:
    """The same in Python, to put the table into normal form."""
    for begin, end in HOLDERS:
        if text.startswith(begin) and text.endswith(end):
            text = f"{begin} holder {end}"
    if re.search(LEAD, text):
        text = re.sub(LEAD, "under ", re.sub("licence", "license", re.sub(TAIL, "", text)))
    return text


def normalise(sentence: str) -> str:
    return _evened(re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip())


def known() -> dict[str, str]:
    found = {normalise(s): i for i, forms in SENTENCES.items() for s in forms}
    for licence, names in REFERENCES.items():
        for name in names:
            for whole in (name,) if name.endswith("license") else (name, f"{name} license"):
                found[f"under {whole}"] = f"Ref {licence}"
    return found | {normalise(h): f"Ref {licence}" for licence, forms in HEADINGS.items() for h in forms}


def run_of(ids: list[str]) -> str:
    return "".join(f",{i}," for i in ids)


def _ids(text: Column, cut: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    plain = F.transform(F.split(text, cut), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))

    def evened(s):
        held = s
        for begin, end in HOLDERS:
            held = F.when(F.startswith(s, F.lit(begin)) & F.endswith(s, F.lit(end)), F.lit(f"{begin} holder {end}")).otherwise(held)
        refers = F.contains(s, F.lit("under ")) & s.rlike(LEAD)
        return F.when(refers, F.regexp_replace(F.regexp_replace(F.regexp_replace(s, TAIL, ""), "licence", "license"), LEAD, "under ")).otherwise(held)

    return F.filter(F.transform(plain, lambda s: table[evened(s)]), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences (their identifiers in order), licences (distinct, by rule order), both comma-joined."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    hit = F.contains(low, F.lit(ANCHORS[0]))
    for a in ANCHORS[1:]:
        hit = hit | F.contains(low, F.lit(a))
    hit = hit | (F.contains(low, F.lit("under")) & low.rlike(NAMES))
    none = F.array().cast("array<string>")
    ids = docs.select("doc_id", F.when(hit, _ids(text, BY_SENTENCE)).otherwise(none).alias("s"), F.when(hit, _ids(text, BY_LINE)).otherwise(none).alias("l"))
    ids = ids.select("doc_id", F.when(F.size("l") > F.size("s"), F.col("l")).otherwise(F.col("s")).alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(run_of(run)).alias("run")) for name, run in RULES])
    start = F.struct(F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "").alias("left"), none.alias("found"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["run"]), F.struct(F.replace(acc["left"], r["run"], F.lit("|")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found"))).otherwise(acc)
    matched = ids.withColumn("found", F.when(F.size("ids") > 0, F.aggregate(rules, start, step, lambda acc: acc["found"])).otherwise(none))
    return matched.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), F.array_join(F.array_distinct("found"), ",").alias("licences"))


def sql() -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known().items()) + "}"
    held = "CASE " + " ".join(f"WHEN starts_with(s, {quote(b)}) AND ends_with(s, {quote(e)}) THEN {quote(f'{b} holder {e}')}" for b, e in reversed(HOLDERS)) + " ELSE s END"
    evened = f"CASE WHEN contains(s, 'under ') AND regexp_matches(s, {quote(LEAD)}) THEN regexp_replace(replace(regexp_replace(s, {quote(TAIL)}, ''), 'licence', 'license'), {quote(LEAD)}, 'under ') ELSE {held} END"
    ids = lambda cut: f"list_filter(list_transform(list_transform(list_transform(string_split_regex(t, {quote(cut)}), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: {evened}), lambda s: k.m[s]), lambda x: x IS NOT NULL)"
    steps, at = [], "s0"
    for i, (name, run) in enumerate(RULES):
        steps.append(f"s{i + 1} AS (SELECT doc_id, ids, replace(seq, {quote(run_of(run))}, '|') AS seq, CASE WHEN contains(seq, {quote(run_of(run))}) AND NOT list_contains(found, {quote(name)}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM {at})")
        at = f"s{i + 1}"
    return f"""
WITH k AS (SELECT {table} AS m),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {ids(BY_SENTENCE)} AS a, {ids(BY_LINE)} AS b FROM d, k),
i AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM c),
s0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: ',' || x || ','), ''), '') AS seq, []::VARCHAR[] AS found FROM i),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(array_to_string(found, ','), '') AS licences FROM {at}
"""
