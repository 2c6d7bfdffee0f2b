"""Operators against brute force on small fixtures, with the odd cases each must bear."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import ann, components, decontaminate, langid, licenses, lines, lm, mixing, ngram_join, packed, quality, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, LM_Score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, blanks and ties."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(120)] + ["É", "İx", "a b", "%%%"]
    passage = " ".join(r.choices(vocabulary, k=45))
    texts = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.choice([1, 2, 4, 20, 60, 90]))
        if i % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        t = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        texts.append(t)
    near = texts[10].split() if len(texts[10].split()) > 50 else texts[0].split()
    texts += [texts[3], texts[3], texts[0], " ".join(near), " ".join(near[:-2] + ["z"]), " ".join(near[:40] + ["y"] + near[40:])]
    texts += [None, "", " \n\t ", "one", "ONE", "\x1fx \x0b y", " ".join(["same"] * 80), "a\nb\nc\nd\na\nb\nc\nd"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "S"][i % 4], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "null id " * 50, None, None, 0, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_ngram_join(docs, none, k, num, den):
    rows = [tuple(r) for r in docs.collect()]
    sets = [shingles(r[1], k) for r in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    want = sorted((str(r[0]), len(sets[i]), str(least[find(i)] if sets[i] else r[0])) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_join(docs, k=k, num=num, den=den).collect())
    assert got == want
    assert ngram_join.ngram_join(none, k=k, num=num, den=den).count() == 0


def test_hot_group_of_near_copies(spark):
    r = random.Random(3)
    base = ["b%d" % i for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = "r%d" % r.randrange(10**6)
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_join(df, k=3, num=90, den=100).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("length", [1, 2, 5, 12, 35])
def test_substring_dedup(docs, none, length):
    rows = docs.collect()
    seen = Counter()
    for r in rows:
        w = words(r.text)
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    want = []
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        want.append((str(r.doc_id), len(w), sum(gone), None if r.text is None else " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring.substring_dedup(docs, length=length)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_removed, r.kept)) for r in got.collect())
    assert substring.substring_dedup(none, length=length).count() == 0


def test_blocks_do_not_matter(docs, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    one = key(substring.substring_dedup(docs.select("doc_id", "text"), length=5)), key(lm.lm_scores(docs.select("doc_id", "text")))
    monkeypatch.setattr(packed, "BLOCK_BYTES", 700)
    monkeypatch.setattr(packed, "PART_KEYS", 40)
    assert one == (key(substring.substring_dedup(docs.select("doc_id", "text"), length=5)), key(lm.lm_scores(docs.select("doc_id", "text"))))


def test_lm(docs, none):
    rows = docs.collect()
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in (words(r.text) for r in rows)]
    total, size = sum(grams, Counter()), sum(len(words(r.text)) for r in rows)
    want = []
    for r, own in zip(rows, grams):
        w, c = words(r.text), lambda g: total[g] - own[g]  # noqa: B023
        s = 0.0
        for i in range(len(w)):
            rest, weight = size - len(w), 1.0
            for n in (3, 2):
                if i >= n - 1:
                    g = tuple(w[i - n + 1 : i + 1])
                    if c(g) > 0:
                        s += np.log(weight * c(g) / c(g[:-1]))
                        break
                    weight *= 0.4
            else:
                s += np.log(weight * (c((w[i],)) / rest if c((w[i],)) else 1 / (rest + 1)))
        want.append((str(r.doc_id), len(w), round(float(s) / len(w), 8) if w else None))
    got = lm.lm_scores(docs)
    assert got.columns == [c for c in docs.columns if c != "LM_Score"] + ["n_tokens", "lm_score"]
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_tokens, None if r.lm_score is None else round(r.lm_score, 8))) for r in got.collect())
    assert lm.lm_scores(none).count() == 0


def test_line_dedup(docs, none):
    got = lines.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "kept"]
    rows = docs.where("doc_id is not null").dropDuplicates().orderBy("doc_id").collect()
    seen, want = set(), {}
    for r in rows:
        ls = (r.text or "").split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            k = tuple(ls[i : i + 3])
            if k in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(k)
        want[r.doc_id] = None if r.text is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
    assert {r.doc_id: r.kept for r in got.where("doc_id is not null").collect()} == want
    assert got.count() == docs.count() and lines.line_dedup(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:  # give by weight, take back what is above, again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert len(got) == docs.count() and [r.finish for r in got] == sorted(r.finish for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0


def test_targets_of_many_shapes(spark):
    r = random.Random(5)
    for _ in range(6):
        sizes = {("s%02d" % i): r.choice([0, 1, 5, 50, 1000]) for i in range(r.randrange(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x.source: x.target for x in mixing.source_targets(df, "source", "size").collect()}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        lo, hi, total = 0.0, 1e6, 1.5 * sum(sizes.values())
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * weight[s]) for s in sizes) < total else (lo, mid)
        assert got == pytest.approx({s: min(2 * sizes[s], hi * weight[s]) for s in sizes}, abs=1e-6)


def test_decontaminate(spark, docs, none, monkeypatch):
    r = random.Random(9)
    item = ["q%d" % r.randrange(400) for _ in range(30)]
    other = ["q%d" % r.randrange(400) for _ in range(18)]
    far = list(item)
    far[3], far[11], far[17], far[25] = "x", "y", "z", "v"
    texts = {1: "pre " + " ".join(item) + " post", 2: " ".join(["pre"] * 30 + item[:27] + ["v"]), 3: " ".join(far), 4: "a b c " + " ".join(other).upper(), 5: None, 6: "", 7: " ".join(item[:10]), 8: "tiny item"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, " "), (5, "tiny item"), (2, " ".join(other))], "item_id long, text string")

    def brute():
        out = set()
        for d, t in texts.items():
            w = (t or "").lower().split()
            for i, b in ((1, item), (2, other), (5, ["tiny", "item"])):
                k = min(5, len(b))
                grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))  # noqa: B023, E731
                for j in range(len(w) - len(b) + 1):
                    x, y = grams(w[j : j + len(b)]), grams(b)
                    if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                        out.add((d, i))
        return out

    assert {(1, 1), (4, 2), (8, 5)} <= brute() and (3, 1) not in brute()
    key = lambda: {(x.doc_id, x.item_id) for x in decontaminate.decontaminate(df, bench).collect()}
    assert key() == brute()
    monkeypatch.setattr(decontaminate, "INLINE", 3)  # the joined way
    assert key() == brute()
    clash = df.withColumnRenamed("text", "body").selectExpr("*", "1 as text_hash")
    kept = decontaminate.drop_contaminated(clash, bench, text="body")
    assert kept.columns == clash.columns and {x.doc_id for x in kept.collect()} == set(texts) - {d for d, _ in brute()}
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_simhash_counts_bits(spark):
    r = random.Random(2)
    for n in (1, 2, 7, 40):
        h = [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        want = sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > n)
        assert spark.createDataFrame([(h,)], "h array<long>").select(decontaminate.simhash(F.col("h")).alias("s")).first().s % (1 << 64) == want


def test_licenses(spark, none):
    mit = ["mit-grant", "mit-keep", "as-is", "mit-liability"]
    wrapped = "\n\n".join(re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n", licenses.SENTENCES[i]).upper() + "." for i in mit)
    cases = {1: wrapped, 2: "Foo bar.\nReleased under the MIT License.\nx", 3: "junk | a\nLicensed under CC BY-NC 4.0.\nmore", 4: licenses.SENTENCES["mit-keep"], 5: None, 6: "", 7: "the mit license is nice", 8: "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."}
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["CC-BY-NC-4.0"], 4: [], 5: [], 6: [], 7: [], 8: ["MIT", "GPL-3.0"]}
    assert licenses.scan(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12)) * rng.choice([0.5, 1, 3], (3000, 1))
    x[1000:1600] = x[1000]
    rows = [(int(i), [float(a) for a in v], 1) for i, v in enumerate(x.astype(np.float32))]
    odd = [(5001, None, 1), (5002, [0.0] * 12, 1), (5003, [float("nan")] * 12, 1), (5004, [1.0, None] + [0.0] * 10, 1), (None, [1.0] * 12, 1), (5000, [float("inf")] + [1.0] * 11, 1), (5020, [1.0, 2.0], 1)]
    df = spark.createDataFrame([*rows, rows[7], *odd], "vec_id long, embedding array<float>, label int")
    got = ann.top_neighbours(df, df.where("vec_id % 20 = 0")).toPandas()
    v = x.astype(np.float32).astype(float)
    found = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = v @ v[q]
        s[q] = -np.inf
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id]) and q not in set(g.vec_id)
        assert [(-b, a) for a, b in zip(g.vec_id, g.score)] == sorted((-b, a) for a, b in zip(g.vec_id, g.score))
        want = np.sort(s)[::-1][19]
        found += (g.score >= want - 1e-9).sum()
        total += 20
    assert got.query_id.nunique() == 150 and found / total >= 0.9
    few = spark.createDataFrame(rows[:4], df.schema)
    assert ann.top_neighbours(few, few.where("vec_id = 0")).count() == 3
    assert ann.top_neighbours(df.limit(0), df.limit(0)).count() == 0


DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark, none):
    from siftline.llm import queries

    full = spark.read.parquet(f"{DATA}/documents.parquet")
    x = queries.op9_language(spark, str(DATA)).where("held_out").join(full.select("doc_id", "lang"), "doc_id").toPandas()
    assert (x.lang == x.lang_pred).mean() >= 0.97 and x.score.between(0, 1).all()
    y = queries.op10_quality(spark, str(DATA)).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    rank, good = y.score.rank(), y.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc >= 0.9 and (y.predicted == (y.score >= 0.3)).all()
    assert langid.train(none, "text", "lang") is None and quality.train(none.selectExpr("text", "n_chars as y"), "text", "y", quality.word_vectors(none)) is None


def test_language_edges(spark, docs):
    net = langid.Network(["en", "fr"], np.random.default_rng(1))
    got = langid.identify(docs.withColumnRenamed("size", "SCORE"), net).collect()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert all(r.lang_pred == "und" for r in langid.identify(docs, None).collect())
    assert quality.score(docs, None).where("score = 0.5").count() == docs.count()


def test_digest_of_op3(spark, tmp_path, docs):
    from siftline.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    blank = hashlib.sha256(b"").hexdigest()
    got = queries.op3_substrings(spark, str(tmp_path)).where("n_words = 0").collect()
    assert len(got) == 4 and {r.kept_sha256 for r in got} == {blank}


GPL_NOTICE = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}://mozilla.org/MPL/2.0/."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
#: Official notices, each behind a copyright line, with the licences they give.
NOTICES = [
    (["GPL-3.0-or-later"], GPL_NOTICE.format(":", ",", 3)),
    (["GPL-3.0-or-later"], GPL_NOTICE.format(";", ";", 3)),
    (["GPL-2.0-or-later"], GPL_NOTICE.format(";", ";", 2)),
    (["GPL-2.0-or-later"], GPL_NOTICE.format(":", ";", 2)),
    *((licence, GPL_NOTICE.format(a, b, n).replace("General Public", kind + " General Public").replace("This program", "This " + what)) for licence, kind, what, n in ((["LGPL-2.1-or-later"], "Lesser", "library", "2.1"), (["LGPL-3.0-or-later"], "Lesser", "library", "3"), (["AGPL-3.0-or-later"], "Affero", "program", "3")) for a, b in ((":", ","), (";", ";"))),
    (["Apache-2.0"], """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    (["MPL-2.0"], MPL_NOTICE.format("https")),
    (["MPL-2.0"], MPL_NOTICE.format("http")),
    (["MIT"], """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""),
    (["ISC"], """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""),
    (["BSD-2-Clause"], BSD_NOTICE.format("")),
    (["BSD-3-Clause"], BSD_NOTICE.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n")),
    (["Unlicense"], "This is free and unencumbered software released into the public domain."),
    (["BSL-1.0"], "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)"),
    (["Zlib"], "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    (["Apache-2.0"], "Licensed under the Apache License, Version 2.0."),
    (["GPL-2.0"], "This work is licensed under the GNU General Public License, version 2."),
    (["GPL-3.0"], "This work is licensed under the GNU General Public License, version 3."),
    (["CC0-1.0"], "This work is dedicated to the public domain under CC0 1.0."),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "   "])
def test_official_notices(spark, mark):
    assert {x for licences, _ in NOTICES for x in licences} | {x for x, _ in licenses.RULES if x.startswith("CC-")} == {x for x, _ in licenses.RULES}
    texts = ["\n".join((mark + line).rstrip() for line in f"Copyright 2020 A. Person\n\n{t}\n\nimport x".split("\n")) for _, t in NOTICES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert got == {i: licences for i, (licences, _) in enumerate(NOTICES)}


def test_pieces_of_notices_alone(spark):
    cases = {1: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 3.0. x", 2: "2.0\n\n2.0. y", 3: MPL_NOTICE.format("https").replace("v. 2.0.", "v. or so. 2.0."), 4: "Foundation; either version 2 of the License, or (at your option) any later version."}
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: (["mpl-copy"], []), 4: ([], [])}


def test_texts_shorter_than_the_item(spark, monkeypatch):
    r = random.Random(12)
    item = ["q%d" % r.randrange(900) for _ in range(46)]
    texts = {1: item[:42], 2: item[4:], 3: item[:20] + item[21:], 4: item[:38], 5: item[:37], 6: item[:-1], 7: item[:30], 8: item[:36] + ["x"] * 4, 9: item[:4], 10: item[1:43] + ["x"], 11: ["a", "b", "c", "d"], 12: ["a", "b", "c", "d", "e"], 13: item}
    bench = {1: item, 2: ["a", "b", "c", "d", "e"], 3: ["a", "b", "c", "d", "e", "f"], 4: item[:44]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in bench.items()], "item_id long, text string")
    want = {}
    for d, w in texts.items():
        for i, b in bench.items():
            grams = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
            for j in range(max(1, len(w) - len(b) + 1)):
                x, y = grams(w[j : j + len(b)]), grams(b)
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.8:
                    want[d, i] = max(want.get((d, i), (0, 0)), (round(s, 9), -j))
    assert {(1, 1), (2, 1), (6, 1), (1, 4)} <= set(want) and not {(5, 1), (7, 1), (12, 3)} & set(want)
    key = lambda: {(x.doc_id, x.item_id): (round(x.similarity, 9), -x["at"]) for x in decontaminate.decontaminate(df, items).collect()}
    assert key() == want
    monkeypatch.setattr(decontaminate, "INLINE", 3)  # the joined way
    assert key() == want


def test_sample_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_A_LANG", 20)
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    monkeypatch.setattr(langid, "STEPS", 3)
    monkeypatch.setattr(quality, "MAX_ROWS", 40)
    monkeypatch.setattr(quality, "LEAST_ROWS", 10)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    seen = []
    fit = langid.Network.fit
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, y, rng: (seen.append((self.langs, y)), fit(self, x, y, rng)))
    # 20,000 rows over 8 texts, and a language and a label of one text
    rows = [("xx", "copied text %d" % (i % 8), i % 8 % 2) for i in range(20000)] + [("yy", "other words %d" % i, 0) for i in range(500)] + [("zz", "single", 1)]
    df = spark.createDataFrame(rows, "lang string, text string, y int")
    net = langid.train(df, "text", "lang")
    assert net.langs == ["xx", "yy", "zz"] and set(seen[0][1]) == {0, 1, 2}
    got = []
    scorer = quality.Scorer.fit
    monkeypatch.setattr(quality.Scorer, "fit", lambda self, x, y, seed=quality.SEED: (got.append(y), scorer(self, x, y, seed))[1])
    vectors = quality.word_vectors(df)
    assert quality.train(df.where("lang = 'xx'"), "text", "y", vectors) is not None and len(got[0]) == 8
    rare = quality.train(df.where("lang <> 'xx'"), "text", "y", vectors)
    assert rare is not None and set(got[1]) == {0.0, 1.0} and len(got[1]) < 100 and rare.shift < 0
    assert quality.train(df.where("y = 0"), "text", "y", vectors) is None
