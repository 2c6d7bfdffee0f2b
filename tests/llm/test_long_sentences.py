"""Known sentences behind long runs of characters that normalising drops."""

from siftline.llm import licenses


def test_length_does_not_matter(spark):
    notice = "Licensed under the MIT License."
    cases = {i: lead + notice for i, lead in enumerate(["", "*" * 5000 + " ", "\u0436" * 5000 + " ", "\u4e2d\u6587 " * 3000, "x y\n" + "=" * 9000 + " ", "-" * 3000 + "\n" * 1 + "#" * 3000 + " "])}
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(cases, ["MIT"])
