"""The keys by which n-grams are counted."""

from siftline.llm import lm, packed


def test_keys_are_whole_hashes(spark, monkeypatch):
    seen, made = [], packed.Layout.__init__

    def note(self, *a):
        made(self, *a)
        seen.append(self.bits)

    monkeypatch.setattr(packed.Layout, "__init__", note)
    assert lm.lm_scores(spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")).count() == 2
    assert seen == [64]
