import re

import pytest

from foldwise.llm import quality_rules as Q

TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "the cat " * 30 + "end",
         "line one\nline one\n\n \nline two\nline one", "# * $ % & | < > word " * 6, "É\u00a0é\x0bÜ\x1cü",
         " ".join(f"w{i}" for i in range(300)), "THE BIG WORDS " * 10, "p q r s t u v w x " * 3 + "p q r s t u v w"]


def plain(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_measures_equal_plain_python(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = Q.apply_rules(d).orderBy("id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(t), t
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def test_filters_do_not_change_results(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("n_words", Q.F.lit("clash"))
    rows = Q.apply_rules(d)
    assert rows.where("kept").count() == sum(r["kept"] for r in rows.collect())
    assert Q.apply_rules(d.limit(0)).count() == 0


@pytest.mark.parametrize("text,rule", [("word " * 10 + " ".join(f"#{i}" for i in range(30)), "symbols"),
                                       (" ".join(f"WORD{i} the" for i in range(30)).upper(), "upper_case"),
                                       (" ".join(f"zq{i}" for i in range(50)), "stop_words")])
def test_rules_name_what_is_broken(spark, text, rule):
    assert rule in Q.apply_rules(spark.createDataFrame([(text,)], "text string")).first()["failed_rules"]


def test_long_text(spark):
    t = " ".join(f"the w{i % 30000}" for i in range(60_000))
    assert Q.apply_rules(spark.createDataFrame([(t,)], "text string")).first()["n_repeat_words"] == plain(t)[4]
