"""Leaks against a plain reading of 15 successive words, and re-parameterised items."""

from granary.llm.leaks import leaked_items, readings, reworked_items

ITEM = "Suppose a component named OuterFrame passes the sealed output of decodeCrew straight into fetch while its parent keeps 448 copies of every menu in memory and waits."


def run(spark, docs, items, how=leaked_items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as id", "'x' as words")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as digest")
    return {(r.item_id, r.doc_id) for r in how(d, i, **options).collect()}


def test_case_markup_breaks_and_limits(spark):
    words = ITEM.split()
    docs = [
        (10, "x " + ITEM.upper()),
        (11, "\n".join("> " + w for w in words[:15])),
        (12, " ".join(words[:14])),
        (13, "<p>" + " ".join(words[3:12]) + " <b>" + " ".join(words[12:20]) + "</b></p>"),
        (14, "1. " + " ".join(words[:7]) + "\n2. " + " ".join(words[7:16])),
        (15, ITEM.replace("448", "449").replace("OuterFrame", "InnerFrame")),
        (16, None),
        (17, ""),
        (18, ITEM.lower().replace(" ", "&nbsp;")),
        (None, ITEM),
    ]
    assert run(spark, docs, [(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, "too short")]) == {(1, 10), (1, 11), (1, 13), (1, 14), (1, 18)}
    assert run(spark, docs, [], how=leaked_items) == set()
    assert run(spark, [], [(1, ITEM)]) == set()


def test_small_bit_tables_change_nothing(spark):
    docs = [(10, ITEM), (11, "a b c " * 40)]
    assert run(spark, docs, [(1, ITEM)], slot_bits=4) == {(1, 10)}


def test_reworked_needs_one_word_for_each_slot(spark):
    item = "Call OuterFrame with 448 and then call OuterFrame again with 448 so that it keeps the menu list open for every visitor of the page"
    good = item.replace("OuterFrame", "SealedBox").replace("448", "12")
    bad = item.replace("OuterFrame", "SealedBox", 1).replace("448", "12")
    assert run(spark, [(1, good), (2, bad), (3, item)], [(7, item)], how=reworked_items) == {(7, 1)}


def test_readings():
    assert readings("a_b **c**\n- d") == [["a", "b", "c", "d"]]
    assert readings("1. a") == [["1", "a"], ["a"]]
    assert readings("a<b>c") == [["a", "b", "c"], ["a", "c"]]
