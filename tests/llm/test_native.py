"""The native operators, against SQL over all documents and plain Python on hard rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duskboard.llm import licenses, linededup, quality, queries

SMALL = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(tuple("~" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(df.select(names).collect()) == canon(found.fetchall())


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_quality_of_hard_rows(hard, none):
    texts = hard.unionByName(hard.sparkSession.createDataFrame([(20, "a b c a b c\nx\nx\na b c # <|", "r", 0), (21, "p q " * 40, "r", 0)], hard.schema))
    rows = quality.judge(texts).collect()
    assert sorted((str(r["row"]["text"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in rows) == sorted(
        (str(r["text"]), *counts(r["text"] or "")) for r in texts.collect()
    )
    assert not any(r["kept"] for r in rows if r["base_failed"]) and quality.judge(none).count() == 0
    assert quality.keep_good(hard).columns == hard.columns


def test_each_rule_rejects(spark):
    rng = iter(range(10**6))
    word = lambda: hashlib.md5(str(next(rng)).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:6]
    good = [" ".join(word() for _ in range(12)) + "." for _ in range(10)]
    texts = {
        None: "\n".join(good), "symbols": "\n".join(x.replace(" ", "# ", 3) for x in good), "duplicate_lines": "\n".join(good + ["so it is"] * 9),
        "word_length": " ".join(a + b for a in "abcdefgh" for b in "abcdefghij"), "alphabetic": " ".join(f"{i}000 {word()}" for i in range(60)),
        "capitals": "\n".join(good).upper(), "ellipses": "\n".join(x + ".." for x in good),
    }
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, wanted string")
    for r in quality.judge(docs).collect():
        assert not r["base_failed"] and r["rejected_by"] == r["row"]["wanted"], r
    given = quality.rules()
    assert {r.name for r in quality.order_rules(docs, given)} == {r.name for r in given}


def kept_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), doc), doc)
    return [(doc, "\n".join(x for x in (text or "").split("\n") if doc is None or first.get(key(x), doc) == doc)) for doc, text in rows]


def test_lines_of_hard_rows(spark, hard, none):
    long = "\n".join(f"line number {i % 700} of them" for i in range(9000))
    docs = hard.unionByName(spark.createDataFrame([(30, long, "", 0), (31, "own first line\n" + long + "\nown last line", "", 0), (32, "x\n" + long, "", 0)], hard.schema))
    out = linededup.drop_lines(docs, linededup.keep_bitmaps(docs)).collect()
    assert sorted((str(r["row"]["doc_id"]), r["kept_text"]) for r in out) == sorted((str(d), t) for d, t in kept_lines([(r["doc_id"], r["text"]) for r in docs.collect()]))
    gone = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in out}
    assert gone[31] == (9002, 9000) and gone[3] == (1, 0) and out[0]["row"].asDict().keys() == {"doc_id", "row", "t"}
    assert linededup.drop_lines(none, linededup.keep_bitmaps(none)).count() == 0


def test_a_line_of_most_documents(spark):
    """One key with nearly all rows takes the way of its own and gives the same."""
    rows = [(i, f"the line that all documents hold\nline {i} of its own, it is\n{'x' * (i % 12)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.drop_lines(docs, linededup.keep_bitmaps(docs)).collect()
    assert sorted((r["row"]["doc_id"], r["kept_text"]) for r in out) == kept_lines(rows)


def test_bitmaps_are_compressed(spark):
    rows = [(1, "\n".join(["same line as ever"] + [f"a line with number {i}" for i in range(6400)])), (2, "\n".join([f"another line {i}" for i in range(6400)] + ["Same line as EVER "]))]
    maps = linededup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_dropped"], [tuple(e) for e in r["bitmap"]]) for r in maps] == [(2, 1, [(100, 1)])]


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_licenses_of_hard_rows(spark, hard, none):
    more = [
        (40, "Under the MIT License; under the\nmit  LICENSE", "", 0), (40, "Under the MIT License; under the\nmit  LICENSE", "", 0),
        (41, "x CC-BY-NC y\nApache License, Version 2 é", "", 0), (None, "released, under the MIT license", "", 0),
        (42, "understand the mit license. accby nc", "", 0), (43, "version 3 License Public General GNU, the under licensed is work this", "", 0),
        (44, "this work is licensed under the GNU General Public License", "", 0),
    ]
    docs = hard.unionByName(spark.createDataFrame(more, hard.schema))
    got = licenses.find_licenses(docs, licenses.templates(spark)).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert [p["word"] for p in by[40, 8]["places"]] == [0, 4] and by[40, 8]["score"] == 1.0
    assert [(p["word"], p["label"]) for p in by[41, 10]["places"]] == [(1, "cc-by-nc"), (5, "apache-2")]
    assert by[None, 5]["matched"] == ["mit"] and not by[42, 6]["places"] and not by[42, 6]["matched"]
    assert by[43, 12]["matched"] == ["gpl-3"] and not by[44, 10]["matched"]
    assert sorted(r["n_words"] for r in got) == sorted(len(license_words(r["text"] or "")) for r in docs.collect())
    assert licenses.find_licenses(none, licenses.templates(spark)).count() == 0


def test_join_is_exact(spark, con, documents):
    """Every line and template with enough common words, at a low share that lets many pairs through."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = spark.createDataFrame([(1, "a", "the and of that with"), (2, "b", "licensed under the apache license"), (3, "c", "the the in was is to er"), (4, "d", " ")], "template int, label string, text string")
    for share in (0.4, 0.6, 0.8):
        got = {(r["doc_id"], r["line"], r["template"], r["overlap"]) for r in licenses.match_blocks(docs, given, share).collect()}
        want = set()
        for k, _, body in given.collect():
            own = set(license_words(body))
            for doc, text in documents:
                for i, line in enumerate(text.split("\n")):
                    n = len(own & set(license_words(line)))
                    if own and n and n >= share * len(own) - 1e-9:
                        want.add((doc, i, k, n))
        assert got == want
    assert licenses.match_blocks(docs, given.filter("template = 4")).count() == 0
    with pytest.raises(ValueError):
        licenses.match_blocks(docs, given, max_vocabulary=3)


def test_hot_words_are_ordered_last(spark):
    docs = spark.createDataFrame([(1, "of the apache")], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("line", F.lit(2))
    found = licenses.match_blocks(docs, spark.createDataFrame([(7, "x", "The Apache")], "template int, label string, text string"), 1.0).collect()
    assert [(r["doc_id"], r["line"], r["template"], r["score"]) for r in found] == [(1, 0, 7, 1.0)]
