"""op9: n-grams of four and five letters."""

import re
from collections import Counter

from kerbside.llm import language


def test_long_grams_against_plain_python():
    for text in ("Ab, cab!  éa", "the other mother bothers", " -x", "", None, "aaaaa aaaaaa b", "漢字かな交じり文 \U0001f600", "abcde"):
        for longest in (3, 4, 5):
            want = Counter()
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                w = f"_{w}_"
                want.update(g for n in range(1, longest + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
            codes, counts = language.grams(text, longest)
            assert sorted(counts.tolist()) == sorted(want.values())
            assert sorted(counts[codes < 0].tolist()) == sorted(n for g, n in want.items() if len(g) > 3)


def test_long_grams_are_learned(spark):
    a, b = "abcabd " * 20, "abdabc " * 20
    docs = spark.createDataFrame([(1, a, "a"), (2, b, "b")], "doc_id long, text string, lang string")
    profiles = language.learn(docs)
    assert all((p < 0).any() for p in profiles.values())
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()} == {1: ("a", 1.0), 2: ("b", 1.0)}
