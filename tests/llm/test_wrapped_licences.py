"""Notices over several lines, two in one line, and single words of licence wording."""

from voltfleet.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
GPL = """it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that"""


def test_wrapped_dual_and_single_words(spark):
    blank = MIT.replace("copy\n", "copy\n\n")
    dual = "Licensed under the Apache License, Version 2.0 or released under the MIT License"
    texts = [MIT, GPL, BSD, "# " + MIT.replace("\n", "\n# "), blank, dual, GPL + "\n\nand\n" + MIT, "free text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [found[i]["families"] for i in range(8)] == [
        ["mit"], ["gpl"], ["bsd"], ["mit"], [], ["apache", "mit"], ["gpl", "mit"], [],
    ]
    assert [found[i]["n_licence"] for i in (0, 1, 2, 3, 5, 6)] == [2, 2, 2, 2, 1, 4]
    assert [found[i]["n_unknown"] for i in (0, 1, 2, 3, 5, 6, 7)] == [0] * 7


def test_a_single_word_of_licence_wording_is_classified(spark):
    docs = spark.createDataFrame([(0, "SPDX-License-Identifier: MIT"), (1, "plain words here")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert found[0]["n_unknown"] == 1 and found[1]["n_unknown"] == 0
