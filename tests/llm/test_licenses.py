"""Licence paragraphs: templates and edits are found, ordinary text is not."""

import re
import textwrap

from qaspark.llm import licenses as L
from qaspark.llm.queries import QUERIES
from qaspark.sources.tables import table

SF = "/root/testdata/sf0.01"
#: The notices that the table's documents hold, and their families.
NOTICES = {"GNU General Public License, version 3": "gpl", "Apache License, Version 2.0": "apache", "MIT License": "mit",
           "CC BY-NC 4.0": "cc-by-nc", "All rights reserved": "proprietary"}


def test_query_finds_every_notice_and_nothing_else(spark):
    want = {}
    for r in table(spark, SF, "documents").collect():
        found = {f for n, f in NOTICES.items() if re.search(re.escape(n), r["text"] or "")}
        if found:
            want[r["doc_id"]] = ",".join(sorted(found))
    got = {r["doc_id"]: r["families"] for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    assert got == want and len(want) > 20


def test_edits_long_lines_and_odd_inputs(spark):
    words = [f"w{i}" for i in range(900)]
    scanner = L.fit([" ".join(words[i:i + 20]) for i in range(0, 880, 3)])
    long = " ".join(words[:500]) + " Licensed under the Apache License, Version 2.0. " + " ".join(words[500:])
    docs = [(1, "Text.\nreleased under the MIT license\nmore", 0), (2, long, 0), (3, None, 0), (4, "", 0), (None, "All rights reserved.", 0),
            (5, "the license plate of a car was reserved under a name", 0), (6, "\n".join(words), 0),
            (7, "Permission is hereby granted, free of charge, to any persons obtaining a copy of this software and documentation files (the \"Software\"), to deal in the Software without any restriction", 0),
            (8, "SPDX-License-Identifier: MPL-2.0", 0), (8, "SPDX-License-Identifier: MPL-2.0", 0)]
    df = spark.createDataFrame(docs, "k long, body string, family int")
    got = sorted((r["doc_id"] or 0, r["family"]) for r in L.find_licenses(df, "k", "body", scanner).collect())
    assert [g for g in got if g[0] != 2] == [(0, "proprietary"), (1, "mit"), (7, "mit"), (8, "mpl"), (8, "mpl")]
    assert {f for d, f in got if d == 2} == {"apache"}
    assert L.find_licenses(df.limit(0), "k", "body", scanner).collect() == []
    assert L.scan_licenses(df.limit(0), "k", "body").collect() == []


#: Notices as file headers and licence files wrap them.
WRAPPED = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": L.TEMPLATES["gpl"][1], "agpl": L.TEMPLATES["agpl"][0], "lgpl": L.TEMPLATES["lgpl"][0], "cc-by-nc": L.TEMPLATES["cc-by-nc"][0],
}


def test_notices_wrapped_over_lines(spark):
    words = [f"w{i}" for i in range(900)]
    scanner = L.fit([" ".join(words[i:i + 20]) for i in range(0, 880, 3)])
    docs, want = [], set()
    for k, (family, text) in enumerate(WRAPPED.items()):
        for m, mark in enumerate(("", " * ", "# ", "// ")):
            for w, width in enumerate((48, 60, 72)):
                doc = 100 * k + 10 * m + w
                lines = textwrap.wrap(text, width)
                code = [" ".join(words[i:i + 8]) for i in range(0, 80, 8)]
                body = [mark + x for x in ["Copyright 2020 Somebody", "", *lines, ""]] + code
                docs += [(doc, "\n".join(body)), (5000 + doc, "\n".join(code + [mark + x for x in lines] + code))]
                want |= {(doc, family), (5000 + doc, family)}
    docs += [(9000, "All rights reserved.\n" + "\n".join(textwrap.wrap(WRAPPED["bsd"], 72))),
             (9001, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."),
             (9002, "\n".join(words)), (9003, "Licensed under the\n\nwords of another paragraph\n\nMIT License")]
    want |= {(9000, "bsd"), (9000, "proprietary"), (9001, "mit"), (9001, "apache")}
    rows = L.find_licenses(spark.createDataFrame(docs, "doc_id long, text string"), scanner=scanner).collect()
    assert {(r["doc_id"], r["family"]) for r in rows} == want
    text = dict(docs)
    assert all(text[r["doc_id"]].encode()[r["start"]:r["end"]].decode().split() for r in rows)


def test_unknown_class_is_sampled_from_whole_texts(spark):
    docs = [(1, "\n".join(f"line {i}" for i in range(100)) + "\n" + " ".join(f"w{i}" for i in range(200)))]
    got = set(L.sample_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"))
    assert {f"line {i}" for i in range(100)} <= got
    assert {w for p in got for w in p.split() if w[0] == "w"} == {f"w{i}" for i in range(200)}
