"""Runs of words that documents share, against every window of plain Python."""

import random

import corpus_pipeline
from hushframe.llm.shared_spans import WINDOW, shared_spans, without_spans


def brute(texts):
    """{doc: positions of words in windows that an earlier document has}"""
    home, out = {}, {}
    for d in sorted(d for d, t in texts.items() if t):
        words = texts[d].lower().split()
        for i in range(len(words) - WINDOW + 1):
            w = tuple(words[i : i + WINDOW])
            if home.setdefault(w, d) != d:
                out.setdefault(d, set()).update(range(i, i + WINDOW))
    return out


def made():
    draw = random.Random(5)
    own = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    p, q, r = own(60), own(51), own(200)
    line = lambda *parts: " ".join(w for x in parts for w in x)
    texts = {
        1: line(own(90), p, own(80)), 2: line(own(30), p, own(7)).upper(), 3: line(own(5), p[:20]) + "\n" + line(p[20:], own(9)),
        4: line(own(70), q), 5: "\n".join(" ".join(q[i : i + 10]) for i in range(0, 51, 10)), 6: line(q[:50], own(60)),
        7: line(r), 8: line(own(3), r[40:160], own(4), p, q), 9: line(r), 10: None, 11: "", 12: line(["junk"] * 300), 13: "é " + line(p) + " ü",
    }
    return texts


def test_shared_spans(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts.items()] + [(None, texts[1], 3)], "doc_id long, text string, n_chars long").repartition(3)
    found = shared_spans(docs)
    rows = found.collect()
    got = {}
    for r in rows:
        assert r["n_words"] >= WINDOW and r["kept_doc_id"] < r["doc_id"]
        a, b = (texts[r[k]].lower().split()[r[w] :][:WINDOW] for k, w in (("doc_id", "first_word"), ("kept_doc_id", "kept_word")))
        assert a == b
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert got == brute(texts) and set(got) == {2, 3, 5, 8, 9, 13}
    left = {r["doc_id"]: r for r in without_spans(docs, found).collect() if r["doc_id"] is not None}
    assert set(left) == set(texts) - {5, 9} and left[13]["text"] == "é  ü" and left[13]["n_chars"] == 4 and left[10]["n_chars"] == 3
    for i, r in left.items():
        words = (texts[i] or "").split()
        assert (r["text"] or "").split() == [w for n, w in enumerate(words) if n not in got.get(i, ())]


def test_pipeline_takes_out_mid_line_passages(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert brute(left) == {} and left[1] == texts[1]
