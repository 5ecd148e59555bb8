import re

from lavka.llm import licenses


def test_texts(spark):
    grant, condition = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-condition"]
    words = grant.split()
    wrapped = "\n".join(" ".join(words[n : n + 9]) for n in range(0, len(words), 9))
    texts = {
        1: "a table | of words |\nReleased under the MIT License.\nmore words",
        2: f"Some title\n\n{wrapped.capitalize()}:\n\n" + condition.upper() + ". The end.",
        3: "Licensed under the Apache License, Version 2.0. All rights reserved.",
        4: "not licensed under the MIT licence at all; we license nothing",
        5: None,
        6: "",
        7: "Released under the MIT License. " * 3,
        8: "no terminator " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
        9: "SPDX-License-Identifier: Apache-2.0",
    }
    rows = [(n, t, "own", 5) for n, t in texts.items()] + [(None, texts[1], None, None), (1, texts[1], "own", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, licence string, other int")
    frame = licenses.licences(docs)
    assert frame.columns == ["doc_id", "text", "other", "licence_no", "licence", "sentences"]
    found = sorted((r.doc_id or 0, r.licence_no, r.licence, r.sentences) for r in frame.collect())
    assert found == [
        (0, 1, "MIT", "mit-notice"),
        (1, 1, "MIT", "mit-notice"),
        (1, 1, "MIT", "mit-notice"),
        (2, 1, "MIT", "mit-grant mit-condition"),
        (3, 1, "Apache-2.0", "apache-notice"),
        (3, 2, "proprietary", "reserved"),
        (7, 1, "MIT", "mit-notice"),
        (7, 2, "MIT", "mit-notice"),
        (7, 3, "MIT", "mit-notice"),
        (8, 1, "GPL-3.0-only", "gpl3-notice"),
        (9, 1, "Apache-2.0", "spdx-apache"),
    ]
    assert licenses.licences(docs.filter("false")).count() == 0


MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2021, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
GPL = """# This program is free software%s you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation%s either version %d of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
APACHE = """ * Copyright 2021 Some One
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_unaltered_public_texts(spark):
    texts = {
        "MIT": MIT, "BSD-2-Clause": BSD % "", "BSD-3-Clause": BSD % THIRD, "GPL-3.0-or-later": GPL % (":", ",", 3),
        "GPL-2.0-or-later": GPL % (";", ";", 2), "MPL-2.0": MPL, "ISC": ISC, "Apache-2.0": APACHE,
    }
    rows = [(name, shape(text)) for name, text in texts.items() for shape in (str, lambda t: t.replace("\n", "\r\n"), one_word_a_line)]
    found = licenses.licences(spark.createDataFrame(rows, "name string, text string"))
    assert sorted((r.name, r.licence) for r in found.collect()) == sorted((name, name) for name, _ in rows)


def one_word_a_line(text):
    """As narrow as it can be wrapped, paragraphs kept, comment marks dropped."""
    text = re.sub(r"(?m)^ ?[#*] ?", "", text)
    return "\n\n".join("\n".join(p.split()) for p in text.split("\n\n"))


def test_rules_name_known_sentences_and_every_sentence_is_telling():
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)
    assert all(re.search(licenses.TELLING, s) for s in licenses.SENTENCES.values())
