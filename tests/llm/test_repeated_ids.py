from narrascope.llm import ngramjoin


def text(k):
    return " ".join(f"w{k}x{i}" for i in range(80))


def test_texts_of_one_id_lie_in_one_component_with_all_their_links(spark):
    near = lambda k: text(k) + " end"
    rows = [(2, text(1)), (5, text(1)), (5, text(2)), (7, near(2)), (5, text(3)), (9, near(3)), (5, ""), (8, text(4)), (3, near(4)), (4, None)]
    rows += [(None, text(5)), (None, text(6)), (11, near(6)), (12, near(5))]
    got = ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(2, 2), (5, 2), (7, 2), (9, 2), (8, 3), (3, 3), (4, 4), (None, None), (11, None), (12, None)}
