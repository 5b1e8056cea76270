import duckdb

from tidemark.llm import licenses

ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "UNDER-the\nmit;license cc by nc cc by nc"), (5, "understand the mit license"),
    (6, "This work is licensed\nunder the GNU General Public License, version 3! Other."), (7, "Released. Under the MIT. License"), (7, "cc_by_nc"), (8, "apache license version 2"), (None, "plain"), (None, "plain"),
    (9, "released under the bsd license"), (10, "x " * 30000 + "apache license version 2"), (11, "École under the MIT licenseé"),
]


def test_places_and_labels(spark):
    out = licenses.scan(spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, h int"))
    got = sorted([tuple(r)[:8] for r in out.collect()], key=repr)
    want = [
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 5, 1, 1, 1, "mit", "mit", 1.0), (4, 10, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0),
        (5, 4, 0, None, None, "", "", 0.0), (6, 13, 0, None, None, "", "gpl-3", 1.0), (7, 5, 1, 1, 1, "mit", "mit", 1.0), (7, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0),
        (8, 4, 1, 0, 0, "apache-2", "apache-2", 1.0), (None, 1, 0, None, None, "", "", 0.0), (None, 1, 0, None, None, "", "", 0.0), (9, 5, 0, None, None, "", "", 0.0),
        (10, 30004, 1, 30000, 30000, "apache-2", "apache-2", 1.0), (11, 5, 0, None, None, "", "", 0.0),
    ]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mpl_notice_is_one_block(spark):
    notice = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    rows = [(1, notice), (2, notice.replace("v. 2.0", "v. Two")), (3, notice.replace("v. 2.0", "\n\n2.0"))]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()} == {1: ("mpl-2", 1.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_notices_and_the_sql(spark):
    notices = [
        ("mit", "Released under the MIT License."), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
        ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
        ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3"), ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"),
    ]
    rows = [*ROWS, *((100 + i, f"Some words before. {t}\n\nAnd after.") for i, (_, t) in enumerate(notices)), (200, "See v. 2 and V! 3. Under v.\n4 it ends."), (201, "v. 2 the terms"), (202, "rev. 2.0 x v.2 y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:8] for r in licenses.scan(docs).collect()]
    assert {r[0]: r[6] for r in got if r[0] is not None and 100 <= r[0] < 200} == {100 + i: label for i, (label, _) in enumerate(notices)}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(licenses.OP4_SQL).select(*names).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
