"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

from sparkyard.llm.fill_in_middle import fill_in_middle, restored
from sparkyard.llm.queries import op12_fill_in_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    r = random.Random(5)
    odd = ["", None, "a", " ", "ab" * 40, "x <P> y", "<S>", "<M", "<<<S", "a<P", "日本語 text", "😀😀a😀bc", "İ́x", "\r\n\t", "[`@{"]
    made = ["".join(r.choices("abZ <>PSM.é😀\n", k=r.randint(1, 200))) for _ in range(200)]
    out = [(i, t, i) for i, t in enumerate(odd + made)]
    return [*out, (3, " ", 1), (None, "two words here", 2), (None, "two words here", 2), (-5, "A b c d e f", 3)]


def test_texts_and_cuts_equal_the_plain_version(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, output int")
    want = sorted((plain(i, t) for i, t, _ in rows()), key=repr)
    assert len({w[2] for w in want}) == 3
    # small chunks, and chunks as rows for texts of more than 10 bytes
    for chunk, long in ((1 << 16, 4 << 20), (7, 4 << 20), (7, 10), (1, 0)):
        made = fill_in_middle(docs, chunk=chunk, long=long).cache()
        assert sorted(map(tuple, made.collect()), key=repr) == want, (chunk, long)
        back = made.select("doc_id", restored(made.output, made.form).alias("t")).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, _ in rows()), key=repr)
        made.unpersist()


def test_query_digests(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id bigint, text string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t)) for i, t, _ in rows()]
    assert sorted(map(tuple, op12_fill_in_middle(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_very_long_text(spark):
    text = "word, " * 1_000_000 + "end"
    got = tuple(fill_in_middle(spark.createDataFrame([(12, text)], "doc_id bigint, text string")).first())
    assert got == plain(12, text)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
