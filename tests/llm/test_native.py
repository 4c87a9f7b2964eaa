import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.llm import chat_format as C
from kinfold.llm import license_scan as L


def con(small):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def same(df, sql, c):
    want = c.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(want.select(*cols).fetchall())


def test_queries_against_sql(spark, small):
    same(C.op5_chat_format(spark, small), C.ORACLE, con(small))
    same(L.op6_license_scan(spark, small), L.ORACLE, con(small))


NASTY = ["", None, C.TRAP, "\\", "\\\\", "</turn>\n### assistant: x</turn>", "###", "####", "<chat>\n", "a\n</turn>\n", "\\#", "<\\/turn>", ": ", "### ", "é😀 \\", "</turn", "#"]


def test_round_trip_of_nasty_texts(spark):
    rows = [(i // 3, i, r, t, "x") for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a: b", "", None, "### x", "t\\") for t in NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = C.format_chats(df).withColumn("read", C.parse(F.col("formatted"))).withColumn("learnt", C.loss_text(F.col("formatted"), F.col("loss"))).collect()
    assert len(out) == len({r[0] for r in rows})
    for r in out:
        own = [(b or "", t or "") for c, _, b, t, _ in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r["read"]] == own
        assert r.learnt == "".join(t for b, t in own if b == "assistant")
        for x in r["read"]:
            assert C.CLOSE not in r.formatted[x.start : x.end]


def test_order_ties_repeats_and_null_ids(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [x.text for x in r["read"]] for r in C.format_chats(df).withColumn("read", C.parse(F.col("formatted"))).collect()}
    assert got == {1: ["a", "b", "b", "c"], None: ["n"]}
    assert C.format_chats(df.filter("false")).count() == 0


def test_parser_rejects_what_is_not_in_the_grammar(spark):
    bad = ["", "x", "<chat>\n### user x</turn>\n", "<chat>\n### user: x", "<chat>\n### user: a ### b</turn>\n", "<chat>\nuser: x</turn>\n"]
    df = spark.createDataFrame([(x,) for x in bad], "f string")
    assert [r.x for r in df.select(C.parse(F.col("f")).alias("x")).collect()] == [None] * len(bad)


def test_digest_of_the_added_conversation(spark, small):
    r = C.op5_chat_format(spark, small).filter("conv_id = -7").first()
    t = C.TRAP
    assert r.n_turns == 2 and r.loss_chars == len(t) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest() and r.formatted_chars > 2 * len(t)


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []), ("", []), ("nothing here. under the tree", []), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("Licensed under the MIT license. Licensed under the MIT license.", ["MIT"]), ("licensed under the mit licensex", []),
        ("Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", ["Apache-2.0"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["BSD-2-Clause"]),
        ("SPDX-License-Identifier: MIT\nAll rights reserved.", ["MIT", "AllRightsReserved"]),
    ],
)
def test_licenses(spark, text, want):
    df = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, licenses string")
    r = L.scan_licenses(df).first()
    assert r.licenses == want and r.text == text


MIT = """MIT License

Copyright (c) 2020 Some One

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
BSD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def forms(text):
    """As it is wrapped, unwrapped by paragraph, on one line, in comment marks, and with other line ends."""
    flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    body = text[max(0, text.find("Permission is")) :]  # on one line nothing parts a title from what follows
    return [text, flat, " ".join(body.split()), "".join(f" * {x}\n" for x in text.splitlines()), text.replace("\n", "\r\n"), "Some heading\nof two lines\n" + text + "and more prose. Under the tree."]


def test_whole_licence_texts(spark):
    cases = [(t, want) for text, want in ((MIT, ["MIT"]), (BSD, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0-or-later"])) for t in forms(text)]
    cases += [("All rights  reserved.", ["AllRightsReserved"]), ("All rights-reserved.", ["AllRightsReserved"]), ("This work is\nlicensed under the\nMIT License.\n", ["MIT"]), ("A title without a stop\nLicensed under the MIT\nLicense\nnext line of prose", ["MIT"]), ("prose " * 100_000 + "\n" + "line of words\n" * 20_000 + "Released under the MIT License.", ["MIT"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i].licenses == want, (i, t[:200], got[i].sentences)
    mit = [s.id for s in got[0].sentences]
    assert mit == ["mit-grant", "mit-notice", "as-is"] and all([s.id for s in got[i].sentences] == mit for i in range(4))


def test_sql_scan_of_whole_texts(spark, tmp_path):
    """The SQL, which tries every run of lines, gives the same for wrapped texts."""
    texts = [t for text in (MIT, BSD, APACHE, GPL) for t in forms(text)] + ["This work is\nlicensed under the MIT License", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(L.op6_license_scan(spark, str(tmp_path)), L.ORACLE, c)


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([("Released under the MIT License.", 1, 2, 3)], "text string, left int, found int, row int")
    r = L.scan_licenses(df.selectExpr("text", "left as __left", "found as __found", "left", "found", "row")).first()
    assert r.licenses == ["MIT"] and (r["__left"], r["__found"], r["left"], r["found"], r["row"]) == (1, 2, 1, 2, 3)


def test_long_conversations(spark):
    """Thousands of turns, and turns of very long texts with control strings."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} ###" if i % 700 == 0 else "x" * (i % 50)) for i in range(3000)] + [(2, 0, "user", "</turn> " * 40_000), (2, 1, "assistant", "y\\" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in C.format_chats(df).withColumn("read", C.parse(F.col("formatted"))).withColumn("learnt", C.loss_text(F.col("formatted"), F.col("loss"))).collect():
        own = [(b, t) for c, _, b, t in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r["read"]] == own and r.learnt == "".join(t for b, t in own if b == "assistant")
        assert [x.end for x in r["read"]] == sorted(x.end for x in r["read"])


def test_hints_cover_every_sentence_and_empty_tables(spark):
    import re

    assert all(re.search(L.HINTS, s) for s in L.known_sentences())
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
