import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specton.llm import decontaminate, langid, licences, lm, quality, topk


# --- licences ---------------------------------------------------------------------------------------------------------

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"


@pytest.mark.parametrize(("text", "names", "kinds"), [
    (MIT, "MIT", "permissive"), ("Some words. Licensed under CC BY-NC 4.0.\nMore.", "CC-BY-NC-4.0", "restricted"),
    ("This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", "GPL-3.0,MIT", "copyleft,permissive"),
    ("The software is licensed to thrill.", "", ""), ("", "", ""), (None, "", ""),
    (MIT.split("\n\n")[1] + "\n" + MIT.split("\n\n")[0], "", ""),  # out of order
    ("Distributed under the MIT License.", "MIT", "permissive"), ("This software is available under the Apache License 2.0.", "Apache-2.0", "permissive"), ("This file is released under CC BY 4.0", "CC-BY-4.0", "permissive"),
    ("# SPDX-License-Identifier: MIT\nimport os", "MIT", "permissive"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", "copyleft"), ("x\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0", "permissive"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "GPL-3.0", "copyleft"),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n", "BSL-1.0", "permissive"), ("The code is provided under\nthe terms of the\nBSD 3-Clause License", "BSD-3-Clause", "permissive"), ("He was released under the bridge. Distributed under the table", "", ""), ("Apache License 2.0, MIT License and others are compared", "", ""),
])
def test_licence_rules(spark, text, names, kinds):
    row = licences.scan(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, kinds string")).first()
    assert (row.licences, row.kinds) == (names, kinds)


BSD = "Copyright (c) 2020, A. Person. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n(2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software is made."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See more."


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join("\n".join(mark + x for x in textwrap.wrap(p, width) or [""]) if p else mark.rstrip() for p in text.split("\n"))


def test_wrapped_licences_equal_their_sql(spark):
    import duckdb

    whole = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0")]
    rows = [(t, n) for text, n in whole for t in (text, wrapped(text, 78), wrapped(text, 40), wrapped(text, 30), wrapped(text, 24), wrapped(text, 18), wrapped(text, 20, "// "), wrapped(text, 70, " * "), wrapped(text, 70, "# "), wrapped(text, 60, "// ").replace("\n", "\r\n"), text.upper().replace(" ", "  "))]
    rows += [("MIT License\n\n" + wrapped(MIT, width), "MIT") for width in (30, 24, 18)] + [(MIT.replace(" ", "\n"), "MIT"), ("SPDX-License-Identifier:   Apache-2.0", "Apache-2.0")]
    rows += [("MIT License\n" + wrapped(MIT, 60), "MIT"), ("Some words\nReleased under the MIT License\nmore words without an end", "MIT"), ("THE  SOFTWARE IS\tPROVIDED as a gift", ""), ("(c) me. All rights reserved.", "Proprietary"), ("", ""), (None, ""), ("word " * 300_000 + ". Licensed under CC BY 4.0.", "CC-BY-4.0")]
    rows += rows[:1]
    docs = [(k, t) for k, (t, _) in enumerate(rows)]
    names = ["_ids", "ids", "rules", "names", "kept"]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in names])
    scanned = licences.scan(df)
    assert scanned.columns[:7] == ["doc_id", "text", *names] and licences.scan(df.limit(0)).count() == 0
    got = {r.doc_id: (r.sentence_ids, r.licences, r.kinds) for r in scanned.collect()}
    assert [got[k][1] for k in range(len(rows))] == [n for _, n in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert {r[0]: r[1:] for r in con.execute(licences.sql()).fetchall()} == got


def test_every_known_sentence_has_a_cue():
    assert all(any(c in s for c in licences.CUES) for s in licences.SENTENCES.values())
    assert all(any(c in s for c in licences.CUES) for s in licences._KNOWN)
    assert all(i in licences._KNOWN.values() for _, _, ids in licences.RULES for i in ids)


# --- top-k ------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in own:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_topk_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "GROUP", 60)
    monkeypatch.setattr(topk, "BATCH", 4)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, scale) for _ in range(8)]) for i in range(200)]
    rows[3] = (3, None)
    rows[4] = (4, [1.0, None] + [0.0] * 6)
    rows[40] = (40, [float("nan")] * 8)
    rows[5] = (5, [float("inf")] * 8)
    for i in range(60, 120):
        rows[i] = (i, list(rows[60][1]))  # ties
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()))
    want = brute_topk(rows, 5)
    assert scale == 1 or max(abs(x[3]) for x in want) > 1 << 53  # beyond what doubles hold exactly
    assert got == want


def test_topk_raises_where_scores_do_not_fit(spark):
    df = spark.createDataFrame([(0, [1e17 / 64, 1.0]), (1, [1e17 / 64, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 20 == 0)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def test_decontamination_edges(spark):
    item = " ".join(f"w{k}" for k in range(40))
    edited = item.replace("w20", "zzz")
    docs = [(1, f"before {item} after"), (2, edited), (3, " ".join(f"w{k}" for k in range(10))), (4, None), (5, ""), (6, "one two"), (1, f"before {item} after"), (7, ("x y " * 500) + item), (8, item.upper() + "!"), (9, " ".join(item.split()[3:] + ["and", "more", "words"]))]
    bench = [(10, item), (11, item.upper()), (12, None), (13, "too short"), (14, " ".join(f"v{k}" for k in range(30)))]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.links(d, b).collect()}
    assert set(got) == {(k, 10) for k in (1, 7, 8, 9)} and abs(got[9, 10][1] - 0.916667) < 1e-3
    assert got[1, 10] == (1, 1.0) and got[7, 10] == (1000, 1.0) and got[8, 10] == (0, 1.0)
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).select("doc_id").collect()) == sorted(x[0] for x in docs if (x[0], 10) not in got)
    assert decontaminate.links(d.limit(0), b).count() == 0 and decontaminate.links(d, b.limit(0)).count() == 0


def test_short_items_are_whole_texts(spark):
    d = spark.createDataFrame([(1, "Too short!"), (2, "it is too short"), (3, "too"), (4, "..."), (5, "too short too")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "too short"), (2, "?"), (3, " "), (4, "TOO")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.links(d, b).collect()} == {(1, 1, 1.0), (3, 4, 1.0)}


def test_clean_goes_by_text(spark):
    """Null ids, and ids that several texts share."""
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, f"a {item}", "x"), (None, "nothing here at all today", "y"), (1, f"b {item} c", "x"), (1, "a clean text of some words", "y"), (2, None, "y"), (2, "", "y"), (3, f"a {item}", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = decontaminate.clean(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == d.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted((r for r in rows if r[2] == "y"), key=str)


def test_links_equal_their_sql(spark):
    """Items of several lengths that overlap each other, and windows of one that are similar to another."""
    import duckdb

    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(90)]
    bench = [(1, base[:60]), (2, base[:52]), (3, base[10:80]), (4, base[:60] * 2), (5, [f"v{k}" for k in range(25)]), (6, base[:5])]
    docs = []
    for k in range(60):
        own = list(r.choice([base, base[:55], base[5:70], base[:60] * 2, bench[4][1], base[:5]]))
        for _ in range(r.choice([0, 0, 1, 2])):
            own[r.randrange(len(own))] = f"q{k}"
        docs.append((k, " ".join([*("x y z " * r.randrange(3)).split(), *own, "end"])))
    docs += [(70, None), (71, ""), (72, ("far " * 30_000) + " ".join(base[:60]))]
    docs += [(73, "Two words"), (74, "two"), (75, "two words more")]
    bench = [(i, " ".join(w)) for i, w in bench] + [(8, None), (9, "two words!"), (10, "...")]
    got = {(x.doc_id, x.item_id, x.start_word, x.similarity) for x in decontaminate.links(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    want = {tuple(x) for x in con.execute(decontaminate.SQL).fetchall()}
    assert len(want) > 60 and got == want


def test_radius_keeps_what_is_similar(spark):
    r = random.Random(4)
    base = [f"t{r.randrange(9**9)}" for _ in range(60)]
    docs = []
    for k in range(60):
        own = base[:]
        own[r.choice([0, 1, 58, 59, 30])] = f"q{k}"
        docs.append((k, " ".join(own)))
    got = decontaminate.links(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(base))], "item_id long, text string"))
    assert got.count() == 60


# --- language identification ------------------------------------------------------------------------------------------


def test_language_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    rows = langid.predict(docs, model).where(langid.held_out() & F.col("lang").isNotNull()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "the and of " * 3000, "x"), (4, "the and of " * 3000, "x")], "doc_id long, text string, score string").withColumn("prediction", F.lit(1))
    got = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and [r.score for r in got][:3] == [0.0] * 3 and got[3].lang_pred == got[4].lang_pred == "en"
    assert langid.fit(docs.limit(0), ~langid.held_out()) is None
    assert [r.lang_pred for r in langid.predict(odd, None).collect()] == ["und"] * 5


def test_a_text_is_judged_from_itself(spark):
    r = random.Random(2)
    texts = ["der", "si", "no", "", None, "a", "ein Haus am Meer", "x" * 3000, *["".join(r.choice("abc dé.") for _ in range(r.randrange(1, 60))) for _ in range(40)]]
    alone = np.concatenate([langid.features([t]) for t in texts])
    assert np.array_equal(langid.features(texts), alone) and np.array_equal(langid.features(texts[::-1])[::-1], alone)
    take = quality.TextFeatures()
    together = take(texts)
    for i, t in enumerate(texts):
        one, (_, column, value) = take([t]), together.take(np.array([i]))
        assert np.array_equal(one.column, column) and np.array_equal(one.value.astype(np.float32), value)


def test_decoding_is_the_nearest_codeword():
    r = np.random.default_rng(3)
    x = r.random((40, langid.FEATURES)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Ecoc(x, ["a", "b", "c", "d"] * 10, rounds=5)
    got = model.scores(x)
    for row, p in zip(x, got):
        f = row @ model.w[:-1] + model.w[-1]
        loss = [sum(w * np.logaddexp(0, -v * c) for w, v, c in zip(model.bits, f, code)) for code in model.codes]
        e = np.exp(-len(model.bits) * (np.array(loss) - min(loss)))
        assert np.allclose(p, e / e.sum(), atol=1e-5) and p.argmax() == np.argmin(loss)


def test_held_out_is_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert c.shape[0] == n and len({tuple(x) for x in c}) == n
    if n == 4:
        assert min((c[i] != c[j]).sum() for i in range(4) for j in range(i)) == 4


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality.fit(docs, even)
    rows = quality.score(docs.join(odd, "doc_id", "left_semi"), model).join(odd, "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean([r.quality_score < 0.5 for r in bad]) > 0.95 and np.mean([r.keep for r in good]) > 0.96
    assert np.mean([r.toxic_score > 0.5 for r in rows if r.toxic == 1]) > 0.8
    assert model.exchanged and all(0 < n <= 2 * quality.EXCHANGE for count in model.exchanged for n in count.values())


def test_views_teach_each_other(spark):
    """Here the source tells the quality as well as the words do, so both views label for the other one."""
    r = random.Random(6)
    words = lambda good: " ".join(r.choice(["fine", "sound", "clear"] if good else ["junk", "spam", "noise"]) if r.random() < 0.3 else f"w{r.randrange(50)}" for _ in range(60))
    rows = [(i, words(i % 2), "en", f"{'good' if i % 2 else 'bad'}{r.randrange(3)}", 300) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, exchange=20)
    assert len(model.exchanged) == quality.ROUNDS and model.exchanged[0] == {("quality", "text"): 40, ("quality", "meta"): 40}
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    assert all((got[i].quality_score >= 0.5) == bool(i % 2) == (got[i].metadata_score >= 0.5) for i in range(300, 900))
    other = docs.where("doc_id >= 300").withColumn("text", F.lit("nothing known here"))
    assert np.mean([(x.quality_score >= 0.5) == bool(x.doc_id % 2) for x in quality.score(other, model).collect()]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, True), (2, "", "en", "s", True), (3, "x", "en", None, None), (3, "x", "en", None, None)], "doc_id long, text string, lang string, source string, keep boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == 4 and all(r.keep and r.quality_score == 0.5 for r in got)
    assert quality.score(docs.limit(0), quality.CoTrained()).count() == 0
    assert quality.kept(docs, quality.CoTrained()).count() == 4
    some = spark.createDataFrame([(1, 1, None), (2, 0, None), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, some)).count() == 4


# --- LM scoring -------------------------------------------------------------------------------------------------------


def test_scores_are_the_sum_of_conditionals(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * (k % 5 + 1), 1.5) for k in range(80)] + [(90, None, None), (91, "", None), (92, "zebra", None), (92, "zebra", None)], "doc_id long, text string, n_words double")
    vocab = lm.vocabulary(docs)
    net = lm.fit(docs, vocab)
    rows = {r.doc_id: r for r in lm.score(docs, vocab, net).collect()}
    assert rows[90].n_words == 0 and rows[90].log_likelihood == 0 and rows[90].mean_log_likelihood is None and rows[92].n_words == 1
    from specton.llm.common import Words

    h, bounds = Words()([("the cat sat on the mat " * 3)])
    ids = vocab.of(h)
    total = 0.0
    for i in range(len(ids)):  # by the definition, a word at a time
        ctx = [ids[i + d] if 0 <= i + d < len(ids) else 1 for d in (-2, -1, 1, 2)]
        hid = np.tanh(sum(net.table[k][c] for k, c in enumerate(ctx)) + net.bias)
        z = hid @ net.out + net.out_bias
        total += z[vocab.classes[ids[i]]] - np.log(np.exp(z).sum())
        own = np.flatnonzero(vocab.classes == vocab.classes[ids[i]])
        u = net.words[own, :-1] @ hid + net.words[own, -1] + vocab.within[own]
        total += vocab.within[0] if ids[i] == 0 else (u - np.log(np.exp(u).sum()))[ids[i] == own].item()
    assert abs(rows[2].log_likelihood - total) < 1e-2


def test_probabilities_sum_to_one(spark):
    """Over all words of the vocabulary, whatever the context: both levels see it."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j * 7) % 401}" for j in range(60))) for k in range(80)], "doc_id long, text string")
    vocab = lm.vocabulary(docs)
    net = lm.fit(docs, vocab)
    ids = np.arange(1, len(vocab.classes))
    each = []
    for c in ([2, 3, 4, 5], [5, 1, 1, 7]):
        one = np.tile(np.array([c], np.int32), (len(ids), 1))
        lp = net.log_probabilities(one, ids, vocab)
        each.append(lp)
        unknown = net.log_probabilities(one[:1], np.zeros(1, int), vocab)[0] - vocab.within[0]
        assert abs(np.exp(lp).sum() + np.exp(unknown) - 1) < 1e-4
    assert np.abs(each[0] - each[1]).max() > 1e-3


def test_network_learns_and_prefers_seen_order(spark, monkeypatch):
    r = random.Random(0)
    texts = [" ".join(f"{a}{k} {b}{k}" for k in (r.randrange(20) for _ in range(40)) for a, b in [("left", "right")]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = lm.vocabulary(docs)
    monkeypatch.setattr(lm, "BATCH", 64)
    untrained, net = lm.Network(), lm.fit(docs, vocab, rounds=1)
    mean = lambda n: np.mean([x.mean_log_likelihood for x in lm.score(docs, vocab, n).collect()])
    assert mean(net) > mean(untrained) + 0.3
    flat = [x for t in texts[:1] for x in t.split()]
    mixed = spark.createDataFrame([(1, " ".join(flat)), (2, " ".join(r.sample(flat, len(flat))))], "doc_id long, text string")
    a, b = (x.log_likelihood for x in lm.score(mixed, vocab, net).orderBy("doc_id").collect())
    assert a > b


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same table in 1 or 16 partitions, in another order, with several replicas: the same scores."""
    monkeypatch.setattr(lm, "SHARE", 1500)
    monkeypatch.setattr(lm, "BATCH", 256)
    r = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(90)}" for _ in range(r.randrange(5, 90)))) for k in range(150)] + [(None, "null id"), (None, None), (7, "again"), (7, "again")], "doc_id long, text string")
    scores = []
    for own in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(16)):
        vocab = lm.vocabulary(own)
        assert vocab.total // lm.SHARE > 2
        scores.append(sorted(((x.doc_id, x.text, x.log_likelihood) for x in lm.score(own, vocab, lm.fit(own, vocab)).collect()), key=str))
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]]
    assert max(abs(a[2] - b[2]) for a, b in zip(*scores, strict=True)) < 1e-3


def test_lm_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vocab = lm.vocabulary(docs)
    assert lm.score(docs, vocab, lm.fit(docs, vocab)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_match_their_parts(spark, sf_dir):
    import corpus_pipeline as p
    from specton.llm.common import staged

    assert [k for k, _ in p.STAGES] == ["quality_classifier", "language_id", "near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns and docs.exceptAll(before).count() == 0
        if name == "near_dedup":
            from tests.llm.test_neardup import brute

            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = brute(spark, rows)
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(k for k, c in want.items() if k == c)
    last = docs.groupBy("doc_id").count().count()
    assert last == before.count()


def test_pipeline_takes_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, empty texts, null and repeated ids, repeated rows; and an empty table."""
    import os

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.where("text IS NOT NULL").orderBy("doc_id").first()
    odd = [(None, kept.text, None, None, None), (-1, None, "en", "s", 3), (-2, "", None, None, None), (None, None, None, None, None), (kept.doc_id, "another text", "en", None, None), tuple(kept), tuple(kept)]
    for name, rows in (("odd", docs.unionByName(spark.createDataFrame(odd, docs.schema))), ("none", docs.limit(0))):
        folder = tmp_path / name
        rows.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            os.symlink(f"{sf_dir}/{other}.parquet", f"{folder}/{other}.parquet")
        before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
        out = p.run(spark, str(folder))
        assert (out.count() > 0) == (name == "odd") and "sequence_id" in out.columns
        assert len({x for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if x.startswith("scratch-")}) <= 1


def test_network_steps_with_and_without_maxima_taken_off(monkeypatch):
    r = np.random.default_rng(3)
    classes = np.concatenate([[0], np.sort(r.integers(1, lm.CLASSES, lm.VOCABULARY - 1))]).astype(np.int32)
    v = lm.Vocabulary(np.arange(lm.VOCABULARY - 2, dtype=np.uint64), np.arange(2, lm.VOCABULARY, dtype=np.int32), classes, np.full(lm.VOCABULARY, -4.0, np.float32))
    context, ids = r.integers(0, lm.VOCABULARY, (2000, 2 * lm.WINDOW)).astype(np.int32), r.integers(0, lm.VOCABULARY, 2000).astype(np.int32)
    start = lm.Network().flat + r.normal(0, 0.2, lm.Network().flat.shape).astype(np.float32)

    def after(reach, factor=1.0):
        monkeypatch.setattr(lm, "REACH", reach)
        net = lm.Network(start * np.float32(factor))
        net.train(context, ids, v)
        return net.flat, net.log_probabilities(context, ids, v)

    assert not lm._far(lm.Network(start.copy()).words)
    for a, b in zip(after(60.0), after(-1.0), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)
    # Sums far over what a single-precision exponential takes.
    assert lm._far(lm.Network(start * np.float32(200)).words) and lm._far(np.full((2, 2), np.nan, np.float32))
    assert all(np.isfinite(x).all() for x in after(60.0, 200.0))
