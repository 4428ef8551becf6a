"""op4 as a whole: lines and runs, rows of one id, columns with clashing names."""

import random

from hushframe.llm.shared_spans import without_spans
from hushframe.llm.substring_dedup import removals, repeated_passages, without_passages

draw = random.Random(11)


def own(n):
    return [f"w{draw.randrange(10**7)}" for _ in range(n)]


def test_passages_wherever_they_stand(spark):
    p, line = own(60), own(60)
    near = [*line[:30], "changed", *line[31:]]
    texts = {
        1: " ".join([*own(45), *p, *own(45)]), 2: " ".join(own(9) + p[:25]) + "\n" + " ".join(p[25:] + own(8)),
        3: "short\n" + " ".join(line) + "\n" + " ".join(own(70)), 4: " ".join(near) + "\nshort", 5: "\n".join(" ".join(p[i : i + 6]) for i in range(0, 60, 6)),
        6: " ".join(own(300)), 7: None, 8: "", 9: "short\nshort",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = removals(docs)
    got = sorted((r["doc_id"], r["first_word"], r["n_words"], r["kept_doc_id"], r["kept_word"], r["kind"]) for r in found.collect())
    assert got == [(2, 9, 60, 1, 45, "run"), (4, 0, 60, 3, 1, "line"), (5, 0, 60, 1, 45, "run")]
    left = {r["doc_id"]: r["text"] for r in without_spans(docs, found).collect()}
    assert set(left) == set(texts) - {5} and left[4].split() == ["short"] and left[2].split() == texts[2].split()[:9] + texts[2].split()[69:]
    assert all(left[i] == texts[i] for i in (1, 3, 6, 7, 8, 9))


def test_rows_of_one_id_and_clashing_names(spark):
    p = " ".join(own(60))
    rows = [(1, p + "\n" + " ".join(own(50))), (2, p + "\nthis text's own line"), (2, " ".join(own(50)) + "\nanother text of the same id"), (2, p + "\nthis text's own line"), (None, p), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in rows], "doc_id long, text string, gone int, key int, _gone int, Id string, n int").repartition(2)
    for left in (without_spans(docs, removals(docs)), without_passages(docs, repeated_passages(docs))):
        assert left.columns == docs.columns
        got = sorted((str(r["doc_id"]), (r["text"] or "").strip()) for r in left.collect())
        assert got == sorted([("1", rows[0][1]), ("2", "this text's own line"), ("2", "this text's own line"), ("2", rows[2][1]), ("None", p), ("3", "")])
        assert all((r["gone"], r["key"], r["_gone"], r["Id"], r["n"]) == (1, 2, 3, "x", 4) for r in left.collect())
