import re
from collections import Counter

import pytest
from tablewright.llm import quality_rules as q
from tablewright.llm.queries import op7_quality_rules

PROSE = "The river ran past the old mill and into the valley where it was always green. "


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "é€𝄞 # $|<>&*% é€𝄞", "a\x0bb\x0cc\rd\xa0e",
    PROSE * 8, "word " * 70, " ".join(f"w{i}" for i in range(3000)), ("abc ### " * 60).strip(),
]


def test_against_brute_force(docs_of, spark, table_dir):
    rows = {r.doc_id: r.asDict() for r in op7_quality_rules(spark, table_dir(docs_of(TEXTS))).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert {k: rows[i][k] for k in want} == want, text and text[:40]
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_rules_decide(docs_of):
    prose = " ".join(f"The {a}{b} of {b}{a} and that was {a}{a}{b}" for a in ("oak", "elm", "fir") for b in "pqrs")
    noisy = prose.replace(" ", "### ")
    kept = {r.doc_id: r.kept for r in q.quality_rules(docs_of([prose, noisy, prose.upper()])).collect()}
    assert kept == {0: True, 1: False, 2: False}


def test_keep_returns_own_columns_even_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 5, True)], "doc_id long, text string, n_words int, kept boolean")
    out = q.keep(df)
    assert out.columns == df.columns and out.count() == 0
    assert q.quality_rules(df).count() == 1


def test_empty_table_and_no_python(docs_of, spark):
    assert q.quality_rules(docs_of([]).limit(0)).count() == 0
    plan = q.quality_rules(docs_of(TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("rule", q.RULES + q.BASE)
def test_table_rows_name_measures(rule):
    assert rule.top in q.MEASURES and (rule.bottom is None or rule.bottom in q.MEASURES)
