"""Operators on single rows: media, tokens, pieces, pages, urls, quality."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import html_text, media_columns, quality, sentence_pieces, token_counts, url_filters

ODD = [None, "", "a", "x" * 192, "é" * 96 + "!", "日本 🙂\n\t", "word " * 3000, "a\x00b", "<|endoftext|> it's  two  spaces ", "▁ mark"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, t string, media binary")


def test_media_round_trip(spark, tmp_path):
    documents(spark, [*ODD, "a"]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media_columns.op3_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        full = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert got[2].asDict() | {"doc_id": 0} == got[len(ODD)].asDict() | {"doc_id": 0} and len(got[0]["feature"]) == 16
    stored = {r["doc_id"]: r for r in media_columns.encode_media(documents(spark, ODD)).collect()}
    assert got[4]["media_sha256"] == hashlib.sha256(stored[4]["media"]).hexdigest() and got[4]["media_bytes"] == len(stored[4]["media"])
    assert media_columns.encode_media(documents(spark, ODD).limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media_columns.decode_media(nulls).first()["payload"] is None


def png(lines, kinds, pixel=3):
    body = b"".join(bytes([k]) + bytes(x) for k, x in zip(kinds, lines))
    head = struct.pack(">IIBBBBB", len(lines[0]) // pixel, len(lines), 8, {1: 0, 3: 2}[pixel], 0, 0, 0)
    return media_columns.SIGNATURE + media_columns._chunk(b"IHDR", head) + media_columns._chunk(b"IDAT", zlib.compress(body)) + media_columns._chunk(b"IEND", b"")


def test_all_filters_are_undone():
    draw = np.random.default_rng(1)
    image = draw.integers(0, 256, (11, 15), dtype=np.int64)
    kinds = [1, 3, 4, 2, 0, 4, 4, 3, 2, 2, 1]
    lines = []
    for y, kind in enumerate(kinds):
        row = []
        for x in range(15):
            a = image[y, x - 3] if x >= 3 else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append(int(image[y, x] - [0, a, b, (a + b) // 2, best][kind]) % 256)
        lines.append(row)
    assert (media_columns.read_png(png(lines, kinds)).reshape(11, 15) == image).all()


def test_damage_is_found():
    good = media_columns.write_png(np.zeros((3, 64, 3), np.uint8))
    assert media_columns.read_png(good).shape == (3, 64, 3)
    for at in (2, 20, 45, len(good) - 3):
        with pytest.raises((ValueError, zlib.error)):
            media_columns.read_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    for bad in (good[:-5], good + b"x"):
        with pytest.raises(ValueError):
            media_columns.read_png(bad)


def test_hash_is_of_low_frequencies():
    coarse = np.random.default_rng(3).integers(20, 230, (9, 8, 3)).astype(np.uint8)  # has energy in all low terms
    smooth = coarse.repeat(10, axis=0).repeat(8, axis=1)
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(1).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(media_columns.cosine_hash(a), np.uint8))
    assert (bits(smooth) != bits(noisy)).sum() <= 10
    other = np.random.default_rng(2).integers(0, 256, smooth.shape).astype(np.uint8)
    assert (bits(smooth) != bits(other)).sum() > 16


def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_file()
    t = Tokenizer.from_file(path)
    texts = [*ODD, "a", "don't STOP 1234 ñandú\n\n  x", "ſ nbsp", "x" * 700]
    docs = documents(spark, texts)
    cache = f"{tmp_path}/cache"
    for _ in range(2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path, cache).collect()}
        assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
        assert spark.read.parquet(cache).count() == len({x or "" for x in texts})  # each text once, nothing more on the second run
    spark.createDataFrame([("other version", hashlib.sha256(b"new").digest(), 3, 99)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    version = token_counts.version_digest(path)
    spark.createDataFrame([(version, hashlib.sha256(b"known").digest(), 5, 42)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "new"), (1, "new"), (2, "known"), (None, "null id")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(more, path, cache).collect())
    assert got[:3] == [("1", 1), ("1", 1), ("2", 42)] and got[3][0] == "None"
    assert token_counts.count_tokens(more.limit(0), path, cache).count() == 0
    small = token_counts.count_tokens(documents(spark, ["a b"]), sentence_pieces.model_file(), f"{tmp_path}/pieces").first()
    assert small["n_tokens"] == 2


def test_quick_counts_are_the_librarys():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_file())
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdefgh  \n'stllreñéÜß.,!?|0123456789$*") for _ in range(draw.randrange(80))) for _ in range(3000)]
    assert token_counts._encoder(token_counts.tokenizer_file())(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = sentence_pieces.model_file()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(4)
    texts = [*ODD, "   ", "\n", "aaaaaaa" * 30] + ["".join(draw.choice("abcdefghinorst .,éñ\nABC019=-  ▁日本🙂") for _ in range(draw.randrange(60))) for _ in range(2000)]
    got = {r["doc_id"]: r for r in sentence_pieces.decode(sentence_pieces.encode(documents(spark, texts), path), path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), repr(t)
        assert got[i]["decoded"] == library.decode(got[i]["ids"]) == (t or "").replace("▁", " ")
    back = {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentence_pieces.encode(documents(spark, texts), path, back=True).collect()}
    assert back == {i: (r["ids"], r["decoded"]) for i, r in got.items()}
    assert sentence_pieces.encode(documents(spark, texts).limit(0), path).count() == 0


def test_unigram_pass_is_viterbi(tmp_path):
    """The same pass on a unigram model: the best sum of scores, held against all segmentations."""
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.2, "▁a": -3.1, "ba": -4.0, "aba": -5.1, "▁ab": -6.0}
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    piece = lambda name, score, kind: field(1, field(1, name.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    model = piece("<unk>", 0.0, 2) + b"".join(piece(k, v, 1) for k, v in scores.items()) + field(2, bytes([0x18, 1])) + field(3, bytes([0x18, 1, 0x20, 0]))
    (tmp_path / "m.model").write_bytes(model)
    m = sentence_pieces.Pieces(str(tmp_path / "m.model"))
    draw = random.Random(5)
    words = sorted({"▁" + "".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(60)})

    def best(w):
        if not w:
            return 0.0
        return max(scores[w[:i]] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in scores)

    for w, ids in m.encode_words(words).items():
        assert "".join(m.names[i] for i in ids) == w and abs(sum(m.score[i] for i in ids) - best(w)) < 1e-5
    assert [m.names[i] for i in m.encode(["acca"])[0]] == ["▁a", "<unk>", "a"]


PAGES = [
    ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br/>c", "a\nb\nc"), ("<ul><li>a<li>b<ol><li>x<li>y</ol></ul>t", "- a\n- b\n  1. x\n  2. y\n\nt"),
    ("<h1>H</h1>text <b>bold</b>, <i>it</i>", "H\n\ntext bold, it"), ("<div>a</div><div>b</div>", "a\nb"), ("x<script>var a='</p>';</script>y<style>p{}</style><!-- c -->z", "xyz"),
    ("<div hidden>no</div><p style='color:red; display : none'>no</p><span aria-hidden=true>no</span>yes", "yes"), ("<table><tr><th>Name<th>n<tr><td>Ann B<td>12</table>", "Name   n\nAnn B  12"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("&lt;b&gt; &amp; &copy;", "<b> & ©"), ("a   \n\t b", "a b"), ("<title>t</title><body>x", "x"), ("<img alt='pic'> x < y", "pic x < y"), ('<a title="a>b" href=x>l</a>', "l"),
    ("<blockquote>q</blockquote>", "  q"), ("<table><caption>c<tr><td>1<td>2<tr><td colspan=2>wide<tr><td>333<td>4</table>", "c\n1    2\nwide\n333  4"), ("</p></div>stray", "stray"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("", ""), ("<p>", ""),
    ("<ol start=4><li>a</ol>", "4. a"), ("<p>a<table><tr><td>b<table><tr><td>c</table></table>d", "a\n\nb c\n\nd"), ("<q>x</q>", '"x"'), ("<!doctype html><html><head><meta charset=x></head><body>b</body></html>", "b"), ("<p", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_rendering(page, text):
    assert html_text.html_text(page) == text


def test_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    tables = "<table><tr><td>" * 500 + "x"
    rows = [(i, p) for i, (p, _) in enumerate(PAGES)] + [(100, None), (101, deep), (None, "n"), (102, tables), (103, "<a " + "x='" * 500), (104, "\x00a")]
    df = spark.createDataFrame([(i, p, "u") for i, p in rows], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(got[i] == t for i, (_, t) in enumerate(PAGES)) and (got[100], got[101], got[None], got[102], got[104]) == ("", "x", "n", "x", "a")
    assert html_text.extract_text(df.limit(0)).count() == 0


URLS = [
    "http://a.example.com/en/1", "https://EXAMPLE.com/en/7x?q=1", "http://example.com/en/70", "http://x.net/de/1", "http://example.net/de/80#f", "http://b.example.net/de/8", "http://example.net/de/9", "http://q.org/es/",
    "http://q.org/es", "http://com/en/1", "http://xcom/en/1", None, "nothing", "http://h?x=/en/", "://host/p", "ftp://Q.ORG/es/?a=1&b=2", "http://example.com/EN/1", "http://u@q.org:80/es/x", "a://b://c/d",
]
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_rules_of_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    for i, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == RULES[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert url_filters.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filters.judge(df.where("url is null")).collect()} == {"block"}


def test_trees_learn(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        bad = draw.random() < 0.4
        depth = draw.randrange(4, 8) if bad else draw.randrange(1, 4)
        rows.append((i, f"http://{draw.choice(['a', 'bb', 'c-c'])}.example.{draw.choice(['com', 'net'])}" + "/p" * depth + ("?" + "&".join(f"k={n}" for n in range(4)) if bad and draw.random() < 0.5 else ""), bad))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    host, path = url_filters.parts(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    model = url_filters.fit(df.where("page_id % 2 = 0").select("url", "host", "path", "blocked"))
    held = model.with_rates(url_filters.lexical(df.where("page_id % 2 = 1"))).select("blocked", model.probability().alias("p")).collect()
    assert sum((r["p"] >= 0.5) == r["blocked"] for r in held) / len(held) > 0.97
    plan = url_filters.judge(df.select("page_id", "url"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_learns_and_holds_out(spark):
    draw = random.Random(2)
    clean = lambda: " ".join(draw.choice(["the", "of", "house", "river", "and", "a", "green", "walks.", "to", "is"]) for _ in range(60))
    junk = lambda: draw.choice([lambda: " ".join(draw.choice(["BUY!!", "NOW!!", "$$$", "CHEAP!!"]) for _ in range(60)), lambda: "again " * 60, lambda: " | ".join(f"x{draw.randrange(99)}" for _ in range(40))])()
    rows = [(i, clean() if i % 3 else junk(), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(9000, None, 0.5), (9001, "", 0.5)], "doc_id long, text string, score double")
    # labels of held-out rows are wrong: they must not matter
    labels = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [(got[i] >= 0.5) == q for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(held) / len(held) > 0.97
    assert quality.fit(docs, labels).scores(pa.array([b"the house"]))[0] == pytest.approx(model.scores(pa.array([b"the house"]))[0])
    assert quality.fit(docs, labels.limit(0)).scores(pa.array([b"x", None])).tolist() == [0.5, 0.5]
    assert quality.score(docs.limit(0), model).count() == 0
    one_kind = labels.withColumn("quality", F.lit(1))
    assert quality.keep_good(docs, one_kind).count() == 602


def test_pooling_in_blocks_is_the_mean():
    texts = pa.array([b"a b c", None, b"", b" d d d ", b"x " * 70000])
    context = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    shapes = quality.index_vectors(quality.SHAPES, 11)
    bucket, shape, bounds = quality.tokens(texts)
    got = quality.pool(bucket, shape, bounds, context, shapes)
    for i in (0, 3, 4):
        own = slice(bounds[i], bounds[i + 1])
        assert np.allclose(got[i, : quality.DIM], context[bucket[own]].astype(float).mean(axis=0)) and np.allclose(got[i, quality.DIM : 2 * quality.DIM], shapes[shape[own]].astype(float).mean(axis=0))
    assert not got[1].any() and not got[2].any()


def test_context_vectors_add_up_all_rows(spark):
    words = ["a", "bb", "Cc", "d1", "e."]
    texts = [" ".join(words[(i * j + j) % 5] for j in range(i % 9)) for i in range(60)] + [None, "", "a a a", "a a a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    index = quality.index_vectors(quality.BUCKETS, 7).astype(float)
    sums = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        bucket = quality.tokens(pa.array([(t or "").encode()], pa.binary()))[0]
        for i, b in enumerate(bucket):
            for j in range(max(0, i - quality.REACH), min(len(bucket), i + quality.REACH + 1)):
                if j != i:
                    sums[b] += index[bucket[j]]
    length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    assert (length > 0).sum() == 5
    assert np.allclose(quality.context_vectors(docs), sums / np.maximum(length, 1e-6), atol=1e-6)
    assert not quality.context_vectors(docs.limit(0)).any()
