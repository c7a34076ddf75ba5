import pytest
from pyspark.sql import functions as F

from narrascope.llm import decontaminate
from test_decontaminate import found, prose

SUM = "Compute 12 + 7 - 3 * 4 + 18 / 6 - 2 and then 45 - 9 + 31 * 2 - 8 + 5 - 1."
NAMES = "Alice, Bob, Carol, Dave and Erin met Frank, Grace, Heidi, Ivan and Judy in Paris, Rome, Oslo and Bern."


@pytest.mark.parametrize("item", [SUM, NAMES, "What is 3 + 4?", "Paris"])
def test_word_for_word_copies_are_found_whatever_their_slots(spark, item):
    docs = [(1, f"{prose(1, 40)}. {item} {prose(2, 40)}"), (2, f"{prose(3, 40)} {item.lower()} {prose(4, 9)}"), (3, prose(5, 300))]
    assert found(spark, docs, [(7, item)]) == [(1, 7), (2, 7)]


def test_one_word_put_in_or_left_out(spark):
    w = prose(21, 20).split()
    docs = [
        (1, " ".join([prose(1, 30), *w[:10], "zzz", *w[10:], prose(2, 30)])),
        (2, " ".join([prose(3, 30), *w[:9], *w[10:], prose(4, 30)])),
        (3, " ".join([*w[:9], prose(5, 60), *w[11:]])),  # two pieces far apart
    ]
    assert found(spark, docs, [(7, " ".join(w))]) == [(1, 7), (2, 7)]


def test_slots_are_held_against_each_other_within_a_shift(spark):
    w = prose(22, 20).split()
    item = [*w[:6], "10", *w[6:9], *w[9:15], "10", *w[15:18]]
    docs = [(1, " ".join([*w[:6], "35", *w[6:9], "zzz", *w[9:15], "35", *w[15:18]]))]
    assert found(spark, docs, [(7, " ".join(item))]) == [(1, 7)]


TOM = "Tom has 5 apples and 3 pears. Tom gives 2 apples to Ann. How many does Tom have left?"
PRICE = "A shop sells a jacket for 40 dollars and a hat for 15 dollars, what is the price of both?"


@pytest.mark.parametrize(
    "item,other",
    [
        (TOM, TOM.replace("Tom", "Mary")),
        (TOM, TOM.replace("Tom", "Mary Lou").replace("Ann", "Bob")),
        (PRICE, PRICE.replace("40", "1,250").replace("15", "12.50")),
        (PRICE.replace("40", "1,250"), PRICE),
    ],
)
def test_other_names_and_numbers_of_other_shapes(spark, item, other):
    assert found(spark, [(1, f"{prose(1, 40)}. {other} {prose(2, 40)}"), (2, prose(3, 200))], [(7, item)]) == [(1, 7)]


def test_raw_and_template_tokens_go_together(spark):
    text = "Will Smith met Mary Lou, Ann and Will on 1,250.5 km. will.\x01 It costs $3,000. Tom ran. So Tom, 7,8."
    row = spark.createDataFrame([(text,)], "t string").select(decontaminate.token_lines(F.col("t")).alias("l")).first().l
    raw, template = row.raw.split(" "), row.template.split(" ")
    assert len(raw) == len(template) and row.words.startswith("will smith met mary lou ann and will on 1 250 5 km will it costs 3 000")
    assert [r.replace("\x01", "").replace("\x05", " ") for r, t in zip(raw, template) if t == "\x01"] == ["will smith", "mary lou", "ann", "will", "it", "tom", "so tom"]
    assert [r for r, t in zip(raw, template) if t == "\x02"] == ["1\x04250\x045", "3\x04000", "7\x048"]
