import random

from narrascope.llm import decontaminate

ITEM = "A train with Alice leaves at 9 and runs 120 km in 3 hours while Bob waits 40 minutes so how fast does the train of Alice go on average"


def found(spark, docs, items=((7, ITEM),), **how):
    d = spark.createDataFrame([(i, t, 0, "u") for i, t in docs], "doc_id long, text string, pos int, hash string").repartition(3)
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, **how).collect())


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_copies_and_new_slots_are_found_and_the_rest_is_not(spark):
    swapped = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("120 km", "75 miles").replace("at 9", "at 11").replace("3 hours", "2 days").replace("40", "15")
    docs = [
        (1, f"{prose(1, 60)}. {ITEM}. {prose(2, 60)}"),
        (2, f"{prose(3, 30)}\n{ITEM.upper().replace(' ', ', ')}"),
        (3, f"{prose(4, 30)}. {swapped} {prose(5, 9)}"),
        (4, prose(6, 300)),
        (5, None),
        (6, ""),
        (8, " ".join(ITEM.split()[:6])),
        (9, f"{prose(7, 2000)} {ITEM}"),
        (9, f"{prose(7, 2000)} {ITEM}"),
    ]
    assert found(spark, docs) == [(1, 7), (2, 7), (3, 7), (9, 7)]


def test_slots_must_agree(spark):
    item = "First x goes at 10 then y goes at 10 and z comes at 20 too"
    same = item.replace("10", "35").replace("20", "50")
    other = "First x goes at 35 then y goes at 36 and z comes at 50 too"
    assert found(spark, [(1, same), (2, other)], [(1, item)], least_tokens=14) == [(1, 1)]


def test_short_items_and_odd_tables(spark):
    assert found(spark, [(1, "well the quick brown fox jumps now"), (2, "the quick brown")], [(3, "The quick brown fox jumps!"), (4, None), (None, ITEM)]) == [(1, 3)]
    assert found(spark, [], [(1, ITEM)]) == [] and found(spark, [(1, ITEM)], []) == []
