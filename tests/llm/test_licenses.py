import textwrap

from routeloom.llm import licenses


def scan(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_rules int")
    return {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses, r.n_rules) for r in licenses.scan(df).collect()}


def test_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nSome words. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    got = scan(spark, [(1, "Words.\nLICENSED under the Apache License,  Version 2.0.\nReleased under the MIT License."), (2, mit), (3, None), (4, ""), (5, "Released under the MIT License? Released under the MIT License!")])
    assert got[1] == (3, ["apache-line", "mit-line"], ["Apache-2.0", "MIT"], 2)
    assert got[2] == (3, ["mit-1", "mit-2"], ["MIT"], 1)
    assert got[3] == got[4] == (0, [], [], 0)
    assert got[5] == (2, ["mit-line", "mit-line"], ["MIT"], 1)


def test_order_matters(spark):
    a = "You may obtain a copy of the License at. You may not use this file except in compliance with the License."
    assert scan(spark, [(1, a)])[1][2] == []


def test_no_rows_and_no_python(spark):
    df = licenses.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """MIT License

Copyright (c) 2024 A. Person

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
SOFTWARE."""
BSD = """Copyright (c) 2024, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND MORE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""


BSD3 = BSD.replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS""")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright 2024 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2 of the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software."""


def test_an_earlier_rule_takes_its_sentences(spark):
    got = scan(spark, [(1, BSD3), (2, BSD), (3, BSD3 + "\n\n" + BSD), (4, MIT)])
    assert (got[1][2], got[1][3]) == (["BSD-3-Clause"], 1) and (got[2][2], got[2][3]) == (["BSD-2-Clause"], 1)
    assert (got[3][2], got[3][3]) == (["BSD-2-Clause", "BSD-3-Clause"], 2) and got[4][3] == 1


def test_a_very_long_text(spark):
    got = scan(spark, [(1, "Some words of a line.\n" * 100_000 + "Released under the MIT License.")])
    assert got[1] == (100_001, ["mit-line"], ["MIT"], 1)


def test_verbatim_texts_wrapped_and_not(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD, "GPL-3.0-or-later": GPL, "Apache-2.0": APACHE, "BSD-3-Clause": BSD3, "MPL-2.0": MPL, "ISC": ISC, "LGPL-2.1-or-later": LGPL, "GPL-2.0-only": GPL2, "Unlicense": UNLICENSE}
    ways = {
        "wrapped": lambda t: t,
        "windows": lambda t: t.replace("\n", "\r\n"),
        "comment": lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint main;",
        "unwrapped": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
        "narrow": lambda t: "\n\n".join(textwrap.fill(" ".join(p.split()), 41) for p in t.split("\n\n")),
    }
    rows = [((name, way), f(t)) for name, t in texts.items() for way, f in ways.items()]
    got = scan(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    missed = [k for i, (k, _) in enumerate(rows) if got[i][2] != [k[0]]]
    assert missed == []
    assert got[0][1] == ["mit-1", "mit-2", "mit-3"] and got[5][1] == ["bsd-1", "bsd-2", "bsd-3"]
    heading = scan(spark, [(1, "Copyright 2024 A. Person\n" + BSD.split("\n\n", 1)[1]), (2, "A title\n" + MIT.split("\n\n", 2)[2])])
    assert (heading[1][2], heading[2][2]) == (["BSD-2-Clause"], ["MIT"])
