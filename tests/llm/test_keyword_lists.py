import random

from narrascope.llm import quality


def test_keyword_lists_go_and_prose_stays(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9)))
    common = ["the", "of", "and", "to", "in", "is", "that", "it", "as", "with"]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.2 else word() for _ in range(n)) + "."
    rows = [(i, prose(300), "en") for i in range(200)]
    rows += [(1000 + i, " | ".join(word() for _ in range(n)), "en") for i, n in enumerate((60, 100, 400, 3000))]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept for i in range(4)) and not any(got[1000 + i].class_distance > 0.3 for i in range(4))
