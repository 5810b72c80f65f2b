"""License scans by recognised sentences.

A text's sentences are normalised (lower case, letters and digits only, British
spelling folded) and looked up among the known license sentences, which gives a
sequence of sentence identifiers; ordered rules over such sequences then name the
licenses, the first rule that fits at a place winning. Wrapped sentences are
recognised over line ends: known sentences form a trie over words, walked from
every place where a line or sentence begins.

All in Arrow batches, with no shuffle; a task holds one batch.

Defined results: a null or empty text has no sentences; equal texts give equal
rows; a license found twice is listed twice, in the order of the text; an empty
table gives no rows; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import keyed_text

# Sentences of public licenses and of the usual notices that name them.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache2-line", "Licensed under the Apache License, Version 2.0"),
    ("apache2-use", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-line", "Released under the MIT License"),
    ("mit-line", "Licensed under the MIT License"),
    ("mit-line", "This project is licensed under the MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("gpl2-line", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl3-line", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-line", "Licensed under the GNU General Public License, version 3"),
    ("lgpl3-line", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl3-line", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-nowarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-see", "See the GNU General Public License for more details"),
    ("cc-by-line", "Licensed under CC BY 4.0"),
    ("cc-by-sa-line", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-nd-line", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0-line", "Released under CC0 1.0"),
    ("bsd-redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-line", "Licensed under the BSD License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("rights-reserved", "All rights reserved"),
    ("asis-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("mit0-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("bsd-asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("isc-liability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("boost-line", "Distributed under the Boost Software License, Version 1.0"),
    ("boost-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("epl1-terms", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-nowarranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl-see", "See the GNU Lesser General Public License for more details"),
    ("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-see", "See the GNU Affero General Public License for more details"),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("classpath-exception", "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules, and to copy and distribute the resulting executable under terms of your choice, provided that you also meet, for each linked independent module, the terms and conditions of the license of that module"),
    ("unlicense-free", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0-waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("apache-asf", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("apache2-asf-use", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache2-title", "Apache License Version 2.0, January 2004"),
    ("apache2-definitions", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("artistic2-title", "The Artistic License 2.0"),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache2", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-bsd2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("spdx-bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdx-isc", "SPDX-License-Identifier: ISC"),
    ("spdx-mpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("spdx-gpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("spdx-gpl2-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("spdx-gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("spdx-gpl3-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
)

#: Ordered: at a place the first rule whose sentences follow one another there names the license.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-asf", "apache2-asf-use", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache2-asf-use",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-definitions",)),
    ("Apache-2.0", ("apache2-use", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache2-use", "apache-copy")),
    ("Apache-2.0", ("apache2-use",)),
    ("Apache-2.0", ("apache2-line",)),
    ("MIT", ("mit-line", "mit-grant", "mit-notice", "asis", "asis-liability")),
    ("MIT", ("mit-grant", "mit-notice", "asis", "asis-liability")),
    ("MIT-0", ("mit0-grant", "asis", "asis-liability")),
    ("MIT-0", ("mit0-grant", "asis")),
    ("MIT", ("mit-line", "mit-grant", "mit-notice", "asis")),
    ("MIT", ("mit-grant", "mit-notice", "asis")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-line",)),
    ("ISC", ("isc-grant", "isc-asis", "isc-liability")),
    ("ISC", ("isc-grant", "asis")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-asis", "isc-liability")),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-redistribute",)),
    ("BSD", ("bsd-line",)),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-line",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ("gpl2-only", "gpl-nowarranty", "gpl-see", "classpath-exception")),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ("gpl2-free", "gpl-nowarranty", "gpl-see", "classpath-exception")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-nowarranty", "gpl-see")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-nowarranty", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-nowarranty", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-nowarranty", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-nowarranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-nowarranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0", ("gpl3-line",)),
    ("GPL-2.0", ("gpl2-line",)),
    ("LGPL-3.0", ("lgpl3-line",)),
    ("AGPL-3.0", ("agpl3-line",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("ISC", ("spdx-isc",)),
    ("MPL-2.0", ("spdx-mpl2",)),
    ("GPL-2.0-only", ("spdx-gpl2",)),
    ("GPL-2.0-or-later", ("spdx-gpl2-later",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("Proprietary", ("rights-reserved",)),
)
# End of the fixed values.

#: Rows that a table of sentences or rules may have: they are sent to every task.
MAX_KNOWLEDGE = 100_000

_WORD = re.compile(r"[a-z0-9]+")
_GAP, _STOP, _SOLID = re.compile(r"[^a-z0-9\n]*"), re.compile(r"[.!?;:]"), re.compile(r"[^\W_]")


def words_of(text: str) -> list[str]:
    """Normalised words of a sentence."""
    return _WORD.findall(text.lower().replace("licence", "license"))


class SentenceRules:
    """Known sentences as a trie over words, and ordered rules over their identifiers."""

    def __init__(self, sentences: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> None:
        self.trie: dict = {}
        firsts: set[str] = set()
        for name, sentence in sentences:
            at, words = self.trie, words_of(sentence)
            for word in words:
                at = at.setdefault(word, {})
            at[""] = name
            firsts.add(words[0])
        known = {name for name, _ in sentences}
        if missing := {i for _, ids in rules for i in ids} - known:
            raise ValueError(f"rules name unknown sentences: {sorted(missing)}")
        self.rules = rules
        #: every known sentence begins with one of few words: where none does, nothing can match
        self.begins = re.compile(r"(?:^|(?<=[^a-z0-9]))(?:" + "|".join(sorted(map(re.escape, firsts))) + r")(?=[^a-z0-9]|$)")

    def sentence_ids(self, text: str) -> list[str | None]:
        """Identifiers of the sentences in order; None stands for unknown text between known ones."""
        low = text.lower().replace("licence", "license")
        out: list[str | None] = []
        done = 0
        for hit in self.begins.finditer(low):
            at = hit.start()
            if at < done or not self._opens(low, at):
                continue
            found = self._walk(low, at)
            if found:
                if _SOLID.search(low, done, at):
                    out.append(None)
                out.append(found[0])
                done = found[1]
        return out

    @staticmethod
    def _opens(low: str, at: int) -> bool:
        """Whether a line or sentence begins here, but for marks such as # or *."""
        k = at
        while k and not low[k - 1].isalnum() and low[k - 1] != "\n":
            k -= 1
            if low[k] in ".!?;:":
                return True
        return not k or low[k - 1] == "\n"

    def _walk(self, low: str, at: int) -> tuple[str, int] | None:
        """The longest known sentence that begins here and ends where a line or sentence does."""
        node, best = self.trie, None
        for word in _WORD.finditer(low, at):
            node = node.get(word[0])
            if node is None:
                break
            if "" in node:
                end = word.end()
                stop = _GAP.match(low, end).end()
                if stop == len(low) or low[stop] == "\n" or _STOP.search(low, end, stop):
                    best = (node[""], end)
        return best

    def licenses(self, ids: list[str | None]) -> list[str]:
        out, k = [], 0
        while k < len(ids):
            for name, sequence in self.rules:
                if tuple(ids[k : k + len(sequence)]) == tuple(sequence):
                    out.append(name)
                    k += len(sequence)
                    break
            else:
                k += 1
        return out


def _listed(table: DataFrame, *cols: str) -> list[tuple]:
    """The rows of a table of knowledge, in order of its columns; its size is checked."""
    rows = table.select(*cols).limit(MAX_KNOWLEDGE + 1).collect()
    if len(rows) > MAX_KNOWLEDGE:
        raise ValueError(f"more than {MAX_KNOWLEDGE} sentences or rules")
    return [tuple(r) for r in rows]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Sequence[tuple[str, str]] | DataFrame = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] | DataFrame = RULES,
) -> DataFrame:
    """(doc_id, sentence_ids, licenses) of every document. The knowledge may come as tables:
    sentences (identifier, sentence) and rules (place, license, identifiers), the first place first."""
    if isinstance(sentences, DataFrame):
        sentences = _listed(sentences, "identifier", "sentence")
    if isinstance(rules, DataFrame):
        rules = [(name, tuple(ids)) for _, name, ids in sorted(_listed(rules, "place", "license", "identifiers"))]
    schema = pa.schema([("doc_id", pa.int64()), ("sentence_ids", pa.list_(pa.string())), ("licenses", pa.list_(pa.string()))])

    def run(batches):
        scanner = SentenceRules(sentences, rules)
        for batch in batches:
            ids = [[x for x in scanner.sentence_ids(t)] for t in batch.column(1).to_pylist()]
            named = [scanner.licenses(x) for x in ids]
            known = [[i for i in x if i] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, schema.field(1).type), pa.array(named, schema.field(2).type)], schema=schema)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, sentence_ids array<string>, licenses array<string>")
